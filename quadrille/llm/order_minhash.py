"""Order MinHash: fingerprints whose likeness follows edit distance.

A text's k-mers (8 code points each) are told apart by 40-bit hashes and
numbered by their occurrence, so a repeated one counts as often as it stands
there. Each of 128 channels has an order of its own over these elements. It
takes the two smallest, puts them in the order in which they stand in the text
and hashes the pair. Two texts agree in a channel if they share both elements
and their order; so moved passages cost likeness, which they don't with plain
MinHash.

A channel's order is (round, number): in round r an element stands in one
channel, by an affine permutation of its own, and so in each channel exactly
once in 128 rounds. Rounds are made only until every channel has its elements:
one round for long texts, and a few more for short ones, with the same result
as if all had been made.

The next document is found without a window over all rows: ids are dealt to
groups by ranges (the driver gets a boundary and a first row a group), each
group gets a copy of the row that follows its last one, and a task reads its
groups in order, holding two texts at once.

Defined cases: a null text is empty; a text of fewer than 8 code points is one
element, an empty text too. Rows are ordered by descending id; those that
repeat an id by a hash of the text, then by the text; those without an id come
last. Such rows are split by the hash where they are many. A table of one row
is its own next one. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, map_texts

#: Code points of a k-mer, elements of a tuple, channels (a power of two; elements have 64 bits, of which 14 pick channels and 26 order them).
K, TUPLE, CHANNELS = 8, 2, 128
#: Elements that a channel should be offered at first.
OFFERED = 12
#: Hex digits of a channel in a fingerprint.
DIGITS = 4
#: Groups of neighbouring documents for each shuffle partition, and bytes of text of a partition at most.
GROUPS, PART_BYTES = 4, 128 << 20

_AT_BITS = 24
_AT = np.uint64((1 << _AT_BITS) - 1)
_U_BITS = 26
_NO_CODE = 0x110000
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def kmer_hashes(text: str) -> np.ndarray:
    """40-bit hashes of a text's k-mers, in order."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(codes) < K:
        codes = np.append(codes, np.full(K - len(codes), _NO_CODE, np.uint32))
    h = codes.astype(np.uint64)
    for step, factor in zip((1, 2, 4), _FACTORS):
        more = h[step:]
        h = h[:-step] * factor
        h += more
    h ^= h >> np.uint64(32)
    h *= _FACTORS[0]
    h >>= np.uint64(_AT_BITS)
    return h


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements (64-bit hashes of a k-mer and its occurrence number) and their places in the text."""
    n = len(h)
    if n <= 1 << _AT_BITS:  # hash and place fit into one number, which sorts faster
        h = h << np.uint64(_AT_BITS)
        h |= np.arange(n, dtype=np.uint64)
        h.sort()
        at = (h & _AT).view(np.int64)
        h >>= np.uint64(_AT_BITS)
    else:
        at = np.argsort(h, kind="stable")
        h = h[at]
    again = np.flatnonzero(h[1:] == h[:-1]) + 1
    if len(again):
        i = np.arange(len(again))
        i[1:][again[1:] == again[:-1] + 1] = 0
        occurrence = np.arange(1, len(again) + 1) - np.maximum.accumulate(i)
        h[again] += occurrence.view(np.uint64) * _FACTORS[1]
    return _mix(h), at


def signature(text: str) -> np.ndarray:
    """A 16-bit number for each channel."""
    e, at = numbered(kmer_hashes(text))
    n, need, offered = len(e), min(TUPLE, len(e)), OFFERED
    while True:
        if n >= offered * CHANNELS:  # the smallest of the first round are enough
            among = np.flatnonzero(e <= min((offered * CHANNELS << 64) // n, (1 << 64) - 1))
            chosen = e[among]
            key = chosen >> np.uint64(64 - _U_BITS)
            channel = chosen & np.uint64(CHANNELS - 1)
        else:
            r = np.arange(min(CHANNELS, -(-offered * CHANNELS // n)), dtype=np.uint64)[:, None]
            u = e ^ r * _FACTORS[1]
            u[1:] = _mix(u[1:])
            key = (u >> np.uint64(64 - _U_BITS) | r << np.uint64(_U_BITS)).ravel()
            channel = ((e + r * (e >> np.uint64(7) | np.uint64(1))) & np.uint64(CHANNELS - 1)).ravel()
            among = np.tile(np.arange(n), len(r))
        offers = np.bincount(channel.view(np.int64), minlength=CHANNELS)
        if offers.min() >= need:
            break
        offered *= 2
    # channel, round, number and place among the offered, in one number; elements are in the order of their k-mers' hashes
    key <<= np.uint64(_AT_BITS)
    key |= channel << np.uint64(57)
    key |= np.arange(len(among), dtype=np.uint64)
    key.sort()
    first = np.cumsum(offers) - offers
    chosen = [among[(key[first + j] & _AT).view(np.int64)] for j in range(need)]
    if need == 2:
        turned = at[chosen[0]] > at[chosen[1]]
        chosen = [np.where(turned, chosen[1], chosen[0]), np.where(turned, chosen[0], chosen[1])]
    out = np.zeros(CHANNELS, np.uint64)
    for c in chosen:
        out = _mix(out * _FACTORS[2] + e[c])
    return (out >> np.uint64(48)).astype(np.uint16)


def as_hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of channels in which two fingerprints agree."""
    agree = lambda i: (F.substring(a, i * DIGITS + 1, DIGITS) == F.substring(b, i * DIGITS + 1, DIGITS)).cast("int")
    return sum((agree(i) for i in range(CHANNELS)), F.lit(0)) / CHANNELS


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint), a row for each row of ``docs``."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([as_hex(signature(x)) for x in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

        return each

    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make, "doc_id long, n_chars long, fingerprint string")


def _grouped(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) with (grp, o, h): group, order of ids, hash of the text; and the number of partitions.

    Groups in order hold the documents in order. An id that many rows have takes up several boundaries;
    its rows are dealt to as many groups by their hash, as those without an id are.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    n = GROUPS * parts
    bounds = sorted(int(x) for x in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n))
    times = [1] * len(bounds)
    for i in range(1, len(bounds)):
        if bounds[i] == bounds[i - 1]:
            times[i] = times[i - 1] + 1
    array = lambda x: F.from_json(F.lit(json.dumps(x)), "array<long>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(bounds).bit_length())))])
    edges, multiples, total = array(bounds), array(times), F.lit(len(bounds))
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= total) & (F.get(edges, at + s - 1) <= F.col("doc_id")), at + s).otherwise(at))
    share = lambda k: F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * k), k - 1)
    many = F.get(multiples, F.col("place") - 1)
    sub = F.when((F.get(edges, F.col("place") - 1) == F.col("doc_id")) & (many > 1), share(many) + 1).otherwise(0)
    group = F.when(F.col("doc_id").isNull(), F.lit(n + 1) * (1 << 20) + share(F.lit(n))).otherwise((F.lit(n) - F.col("place")) * (1 << 20) + sub)
    keyed = docs.withColumn("h", F.xxhash64("text")).withColumn("o", F.bitwise_not("doc_id")).withColumn("place", found)
    return keyed.withColumn("grp", group.cast("long")).drop("place"), parts


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (grp, halo, doc_id, text) of ``docs`` (doc_id, text), dealt and sorted so that a row's next one follows it in its group."""
    grouped, parts = _grouped(docs)
    firsts = sorted((r.grp, r.f.o, r.f.h) for r in grouped.groupBy("grp").agg(F.min(F.struct("o", "h")).alias("f")).collect())
    copies = [(g, o, h, firsts[i - 1][0]) for i, (g, o, h) in enumerate(firsts)]  # the first one's copy goes to the last group
    copies = docs.sparkSession.createDataFrame(copies, "_grp long, _o long, _h long, to long")
    wanted = (F.col("grp") == F.col("_grp")) & F.col("o").eqNullSafe(F.col("_o")) & (F.col("h") == F.col("_h"))
    own = F.struct(F.col("grp").alias("grp"), F.lit(False).alias("halo"))
    copy = F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("grp"), F.lit(True).alias("halo")))
    places = F.inline(F.filter(F.array(own, copy), lambda x: x.isNotNull()))
    dealt = grouped.join(F.broadcast(copies), wanted, "left").select(places, "o", "h", "doc_id", "text")
    return dealt.repartition(parts, "grp").sortWithinPartitions("grp", "halo", "o", "h", "text").select("grp", "halo", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """PAIR_SCHEMA: each document's fingerprint, its edited text's, and how like it is to that one and to the next document."""
    bound_batches(docs.sparkSession)
    names = [x.split()[0] for x in PAIR_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in PAIR_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # group, id, text, signature of the row before
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                grp, halo, key, now = (batch.column(j)[i].as_py() for j in range(4))
                if halo and (before is None or before[0] != grp):
                    continue
                sig = signature(now)
                if before is not None and before[0] == grp:
                    new = edited(before[2], now)
                    near = signature(new)
                    rows.append((before[1], len(before[2]), hashlib.sha256(new.encode()).hexdigest(), as_hex(before[3]), as_hex(near), float((before[3] == near).mean()), float((before[3] == sig).mean())))
                before = None if halo else (grp, key, now, sig)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), schema.types)], schema=schema)
        pa.default_memory_pool().release_unused()

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return in_order(picked).mapInArrow(run, PAIR_SCHEMA)


def op11_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
