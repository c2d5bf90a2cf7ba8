"""Line deduplication with two Bloom filters.

Every task notes the line hashes of its documents in a once-seen filter, and
those that it meets again in a twice-seen filter. The tasks' filters are merged
segment by segment, in parallel: what is in two once-seen filters becomes
twice-seen. Only lines in the twice-seen filter (true repeats and a few false
ones) are shuffled, to be counted exactly. Lines that occur once never move.

What moves of a suspected line is a cryptographic digest of ``DIGEST_BYTES``, on
which lines are held equal, and its document's id, however long the line is.
Digests that hold more than a thousandth of all these rows are at most a thousand,
so they find their rows by a broadcast, and no line's rows meet in one task.

The filters have 16 bits for each line up to ``MOST_BITS``, which is also the
bound of what is broadcast and of what a task holds. Beyond that they fill up and
more lines are suspected: some 20 bytes move for each, and the result is the same.

Defined cases: a null or empty text is one empty line; empty lines (after
stripping) have no key and always stay; texts and lines of any length are taken
as a whole; every row counts as a document of its own, also if it repeats
another; null ids are matched like any other value; other columns, whatever their
names, pass through ``line_dedup``.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import as_bytes, map_texts, materialize, slices

LEAST_DOCS = 10
BITS_PER_LINE = 16
LEAST_BITS, MOST_BITS = 1 << 19, 1 << 29
SEGMENT_BYTES = 1 << 16
DIGEST_BYTES = 16
#: A digest with one in so many of the repeated lines' rows is joined by a broadcast of at most so many digests.
HOT_SHARE = 1000


def line_key(line: bytes) -> bytes:
    """A line's key: ASCII white space stripped, A-Z lower-cased."""
    return line.strip().lower()


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=DIGEST_BYTES).digest()


def line_keys(text: bytes) -> set[bytes]:
    """The digests of a text's keys."""
    keys = set(map(line_key, text.split(b"\n")))
    keys.discard(b"")
    return set(map(digest, keys))


def positions(keys: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two filter positions of each digest; ``bits`` is a power of two up to 2 ** 32."""
    h = np.frombuffer(b"".join(keys), "<u8").reshape(-1, DIGEST_BYTES // 8)[:, 0]
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


class TwoFilters:
    """Once-seen and twice-seen bits of a stream of keys."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    @staticmethod
    def has(bitmap: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

    @staticmethod
    def put(bitmap: np.ndarray, p: np.ndarray) -> None:
        np.bitwise_or.at(bitmap, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def add(self, keys: list[bytes]) -> None:
        """Keys of one or more documents; a key occurs once for each document that has it."""
        a, b = positions(keys, self.bits)
        pair = a * self.bits + b if self.bits <= 1 << 31 else a ^ (b << 31)
        _, first, inverse, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        again = (n[inverse] > 1) | (self.has(self.once, a) & self.has(self.once, b))
        for p in (a, b):
            self.put(self.twice, p[again])
        for p in (a, b):
            self.put(self.once, p)

    def segments(self) -> pa.RecordBatch:
        n = self.bits // 8 // SEGMENT_BYTES
        once, twice = self.once.reshape(n, -1), self.twice.reshape(n, -1)
        used = np.flatnonzero(once.any(axis=1))
        pack = lambda x: pa.array([zlib.compress(x[i].tobytes(), 1) for i in used], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pack(once), pack(twice)], ["segment", "once", "twice"])


def repeat_filter(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Bits of the merged twice-seen filter; at most MOST_BITS, whatever the data."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = docs.select(F.sum(F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"))) + 1)).first()[0] or 0
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_LINE * lines):
        bits *= 2

    def build(batches):
        filters = TwoFilters(bits)
        for part in slices(batches, "_text"):
            filters.add([k for x in as_bytes(part.column(0)) for k in line_keys(x)])
        out = filters.segments()
        for at in range(0, out.num_rows, 64):
            yield out.slice(at, 64)

    def merge(batches):
        """Rows come sorted by segment, so one segment is held at a time."""
        now, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["segment", "twice"])

        for batch in batches:
            for segment, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if segment != now:
                    if now is not None and twice.any():
                        yield done()
                    now, once, twice = segment, a, b
                else:
                    once, twice = once | a, twice | b | (once & a)
        if now is not None and twice.any():
            yield done()

    built = docs.select(F.col(f"`{text}`").alias("_text")).mapInArrow(build, "segment int, once binary, twice binary")
    merged = built.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    out = np.zeros((bits // 8 // SEGMENT_BYTES, SEGMENT_BYTES), np.uint8)
    for row in merged.toLocalIterator():
        out[row.segment] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return out.reshape(-1)


def repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, first): every document's digests that at least ``least_docs`` documents have; ``first`` is the smallest id with the digest."""
    seen = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, text))

    def make():
        bitmap = seen.value
        bits = len(bitmap) * 8

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, keys = [], []
            for i, x in enumerate(as_bytes(batch.column(1))):
                k = line_keys(x)
                keys += k
                rows += [i] * len(k)
            a, b = positions(keys, bits)
            hit = np.flatnonzero(TwoFilters.has(bitmap, a) & TwoFilters.has(bitmap, b))
            found = pa.array([keys[i] for i in hit.tolist()], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(rows, np.int64)[hit])), found], ["doc_id", "key"])

        return each

    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    suspects = materialize(map_texts(picked, make, "doc_id long, key binary"))
    exact = materialize(suspects.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= least_docs))
    total = exact.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE >= total
    hot = F.broadcast(exact.where(is_hot).select("key", "first"))  # at most HOT_SHARE digests
    others = suspects.join(hot.select("key"), "key", "left_anti").join(exact.where(~is_hot).select("key", "first"), "key")
    return suspects.join(hot, "key").unionByName(others)


def line_dedup(docs: DataFrame, least_docs: int = LEAST_DOCS, keep: str = "none", doc_id: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with the lines that repeat across documents taken out of the text.

    ``keep``: "none" takes such lines out everywhere, "first" leaves them in the
    document with the smallest id. With ``counts``, columns ``n_lines`` (before)
    and ``n_dropped`` follow.
    """
    repeated = repeated_lines(docs, least_docs, doc_id, text)
    if keep == "first":
        repeated = repeated.where(~F.col("doc_id").eqNullSafe(F.col("first")))
    drops = repeated.groupBy(F.col("doc_id").alias("_drop_id")).agg(F.collect_set("key").alias("_drops"))
    joined = docs.join(drops, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("_drop_id")), "left").drop("_drop_id")
    at = docs.columns.index(text)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, n_lines, n_dropped = [], [], []
            for x, drop in zip(as_bytes(batch.column(at)), as_lists(batch.column(len(docs_columns)))):
                lines = x.split(b"\n")
                kept = [w for w in lines if not ((k := line_key(w)) and digest(k) in drop)] if drop else lines
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = batch.columns[: len(docs_columns)]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            columns[at] = pc.if_else(batch.column(at).is_valid(), columns[at], pa.scalar(None, pa.string()))
            names = [*docs_columns]
            if counts:
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                names += ["n_lines", "n_dropped"]
            return pa.RecordBatch.from_arrays(columns, names)

        return each

    def as_lists(column):
        return [set(x) if x else None for x in column.to_pylist()]

    docs_columns = docs.columns
    more = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if counts else []
    return map_texts(joined, make, T.StructType([*docs.schema.fields, *more]), text)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines before, lines dropped, and a digest of the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = line_dedup(docs, counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
    SELECT doc_id, rid, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos
    FROM (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS body FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
    SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM (SELECT keyed.*, repeated.key IS NOT NULL AS dropped FROM keyed LEFT JOIN repeated ON keyed.key = repeated.key)
GROUP BY rid, doc_id
"""
