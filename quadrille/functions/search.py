"""Search by ranges in short sorted lists, as Column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_below(value: Column, edges: Sequence[int]) -> Column:
    """How many of the sorted whole numbers are smaller than the value: a binary search in a constant array.

    Only for lists whose length is bounded, such as one of files or partitions; null stays null.
    """
    n = len(edges)
    array = F.from_json(F.lit(json.dumps([int(x) for x in edges])), "array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, n.bit_length())))])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(array, at + s - 1) < value), at + s).otherwise(at))
    return F.when(value.isNotNull(), found)
