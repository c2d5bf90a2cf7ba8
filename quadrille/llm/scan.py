"""Running totals along an order, without one task for a key.

Rows are dealt by ranges of key and order, so a key with many rows spans many
partitions. Each partition makes its own totals; what a partition hands on to
the next ones is a row for each partition, which the driver adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import materialize


def running(df: DataFrame, key: str, order: list[Column], sums: list[str], xors: list[str] = []) -> DataFrame:
    """``df`` with ``r_<c>``: totals of long columns over the rows of a key up to this one; bits are exclusively or'ed for ``xors``.

    ``key`` is a long without nulls. Rows that tie in ``order`` must be alike.
    """
    names = [*sums, *xors]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    made = [T.StructField(f"r_{c}", T.LongType()) for c in names] + [T.StructField("_part", T.LongType()), T.StructField("_at", T.LongType())]
    key_at, at = df.columns.index(key), [df.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, last, totals = TaskContext.get().partitionId(), 0, None, np.zeros(len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key_at).to_numpy()
            fresh = np.append(keys[0] != last, keys[1:] != keys[:-1])
            starts = np.flatnonzero(fresh)
            segment = np.cumsum(fresh) - 1  # -1: goes on from the batch before
            out = []
            for j, c in enumerate(at):
                adds = np.add if j < len(sums) else np.bitwise_xor
                back = np.subtract if j < len(sums) else np.bitwise_xor
                value = batch.column(c).to_numpy()
                all_so_far = adds.accumulate(value)
                before = np.append(back(all_so_far[starts], value[starts]), back(np.int64(0), totals[j]))
                out.append(back(all_so_far, before[segment]))
            last, totals = keys[-1], np.array([x[-1] for x in out], np.int64)
            rows = np.arange(done, done + batch.num_rows)
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out), pa.array(np.full(batch.num_rows, part)), pa.array(rows)], [*batch.schema.names, *[f.name for f in made]])

    local = materialize(dealt.mapInArrow(run, T.StructType([*df.schema.fields, *made])))
    ends = local.groupBy("_part").agg(F.min_by(key, "_at").alias("first"), F.max_by(key, "_at").alias("last"), F.max_by(F.struct(*[f"r_{c}" for c in names]), "_at").alias("totals"))
    carried, goes_on, totals = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        own = np.array(r["totals"], np.int64)
        if goes_on is not None and r["first"] == goes_on:
            carried.append((r["_part"], goes_on, *map(int, totals)))
            if r["last"] == goes_on:
                own[: len(sums)] += totals[: len(sums)]
                own[len(sums) :] ^= totals[len(sums) :]
        goes_on, totals = r["last"], own
    more = df.sparkSession.createDataFrame(carried, T.StructType([T.StructField(c, T.LongType()) for c in ("_p", "_k", *[f"_c{i}" for i in range(len(names))])]))
    joined = local.join(F.broadcast(more), (F.col("_part") == F.col("_p")) & (F.col(key) == F.col("_k")), "left")  # a row for each partition at most
    zero = lambda i: F.coalesce(F.col(f"_c{i}"), F.lit(0).cast("long"))
    whole = [(F.col(f"r_{c}") + zero(i) if i < len(sums) else F.col(f"r_{c}").bitwiseXOR(zero(i))).alias(f"r_{c}") for i, c in enumerate(names)]
    return joined.select(*df.columns, *whole)
