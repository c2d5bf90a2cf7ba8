"""Best-fit packing of documents into sequences of fixed length.

All planning is done on the histogram of piece lengths, which has no more
entries than a sequence has tokens, whatever the data: patterns of a few lengths
that fill a sequence are enumerated, non-negative least squares fits how often
to repeat each, the counts are rounded down, what that leaves is fitted again a
few times, and what is left over then is packed best-fit on the histogram,
longest first. Where lengths are such that fewer fits or none do better, that
plan is taken, so it is never worse than best fit. The plan is a table of slots; pieces
find theirs by their rank among the pieces of their length, which is made of
ranks within small buckets and running sums of bucket counts, so no length's
pieces ever meet in one task.

Defined cases: a null or empty text is the end id alone; texts of any length are
cut into pieces, none is left out; repeated rows are packed each by itself (rows with one id and text get their places in any order);
a null id is an id like any other; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import as_bytes, map_texts, materialize

CAPACITY = 2048
END_ID = 0
#: Words kept with their ids in each Python worker.
CACHED_WORDS = 250_000
#: Longest word that is kept, so that the store is bounded in bytes too.
KEPT_BYTES = 64
#: How often what a fit leaves is fitted again.
FITS = 3
#: Pieces of a length that are ranked together.
BUCKET_ROWS = 256
#: A full stop or comma that is a token by itself.
STOP = re.compile(rb"([a-z0-9])([.,])(?![^ \n])")
#: Letters below this one are Latin.
LATIN_END = "\u0250"

Plan = list[tuple[tuple[tuple[int, int], ...], int]]


class WordTokens:
    """Token ids of texts, word by word: the tokenizer never joins across ASCII white space.

    It also lower-cases, and takes a full stop or comma between a letter or
    digit and white space by itself; so such words are stored only once.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words. One of Latin letters alone is one input of the tokenizer's model; others take its whole way."""
        out: dict[bytes, bytes] = {}
        other = []
        for w in words:
            if w.isalpha():  # bytes: ASCII letters only
                letters = w.lower().decode()
            elif (x := self.normalizer.normalize_str(w.decode())).isalpha() and max(x) < LATIN_END:
                letters = self.byte_level.pre_tokenize_str(x)[0][0]
            else:
                other.append(w)
                continue
            out[w] = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        found = self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
        out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other, found))
        return out

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        """Words; a text that may hold a special token (they are spelt with ``<|``) keeps its case."""
        return text.split() if b"<|" in text else STOP.sub(rb"\1 \2", text.lower()).split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit numbers, without special ids.

        The first words met are the commonest, so they stay in the store when
        it is full; others, and long ones, are encoded for their slice alone.
        """
        split = [self.split(x) for x in texts]
        every = set().union(*split)
        new = list(every.difference(self.words))
        known = self.words
        if len(new) > CACHED_WORDS - len(self.words):
            known = {w: self.words[w] for w in every if w in self.words}
        for at in range(0, len(new), 4096):
            part = self._ids(new[at : at + 4096])
            known.update(part)
            if known is not self.words and len(self.words) < CACHED_WORDS:
                self.words.update(part)
        ids = [b"".join(map(known.__getitem__, x)) for x in split]
        for w in new:
            if len(w) > KEPT_BYTES:
                self.words.pop(w, None)
        return ids


@lru_cache(maxsize=2)
def word_tokens(path: str | None) -> WordTokens:
    """One store for all tasks of a Python worker."""
    return WordTokens(path)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document; with its ``ids`` on request."""

    def make():
        tokens = word_tokens(path)
        end = np.array([END_ID], "<u4").tobytes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, piece, start, length, crc, data = [], [], [], [], [], []
            for i, x in enumerate(tokens.encode(as_bytes(batch.column(1)))):
                x += end
                n = len(x) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    part = x[4 * s : 4 * (s + capacity)]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    data.append(part)
            out = {"doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]).astype(np.int32)), pa.array(np.frombuffer(b"".join(data), "<i4")))
            return pa.RecordBatch.from_pydict(out)

        return each

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(picked, make, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def candidate_patterns(present: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of two to four of the lengths that fill a sequence, ascending within each.

    All pairs that fill it exactly; of the larger ones, for each length, those
    whose other lengths lie at evenly spread places of what is left.
    """
    here = np.flatnonzero(present)
    has = set(here.tolist())
    found = {tuple(sorted((a, capacity - a))) for a in has if capacity - a in has}
    for a in has:
        left = capacity - a
        for f in (0.12, 0.24, 0.36, 0.48):
            at = int(np.searchsorted(here, left * f))
            for b in here[at : at + 1].tolist():
                if left - b in has:
                    found.add(tuple(sorted((a, b, left - b))))
                near = int(np.searchsorted(here, (left - b) * 0.4))
                for c in here[near : near + 1].tolist():
                    if left - b - c in has:
                        found.add(tuple(sorted((a, b, c, left - b - c))))
    return sorted(found)


def fit_counts(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 with the least squared difference of what patterns use from ``counts``.

    Accelerated projected gradient steps; the matrix has a few entries in each
    column, so products are sums by index. Rows are scaled by the root of their
    counts, as large counts vary more.
    """
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    length = np.array([x for p in patterns for x in p])
    scale = 1 / np.sqrt(counts + 1.0)
    target = counts * scale
    use = lambda x: np.bincount(length, x[column], len(counts)) * scale
    back = lambda r: np.bincount(column, (r * scale)[length], len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(use(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(use(v))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(use(y) - target))
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def pack_residuals(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit, longest first, on a histogram: bins with the same content are handled together."""
    bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {capacity: []}
    rests: list[int] = []

    def put(rest: int, content, many: int) -> None:
        if rest not in bins or not bins[rest]:
            bins[rest] = []
            if rest != capacity:
                insort(rests, rest)
        bins[rest].append((content, many))

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            at = bisect_left(rests, length)
            if at < len(rests):
                rest = rests[at]
                content, many = bins[rest].pop()
                if not bins[rest]:
                    rests.pop(at)
            else:
                rest, content, many = capacity, (), n
            each = rest // length
            full = min(many, n // each)
            if full:
                put(rest - each * length, (*content, (length, each)), full)
                n -= full * each
            if n and full < many:
                put(rest - min(n, each) * length, (*content, (length, min(n, each))), 1)
                n -= min(n, each)
                full += 1
            if content and full < many:
                put(rest, content, many - full)
    return [x for group in bins.values() for x in group]


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Patterns as ((length, times), ...) with repeats, that use up ``counts`` (by length, up to ``capacity``) exactly."""
    left = counts.astype(np.int64).copy()
    plan: Plan = []
    if left[capacity]:
        plan.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    size = lambda p: sum(many for _, many in p)
    best = plan + pack_residuals(left, capacity)
    for _ in range(FITS):
        added: Plan = []
        if patterns := candidate_patterns(left > 0, capacity):
            fitted = fit_counts(patterns, left.astype(float))
            for i in np.argsort(-fitted, kind="stable").tolist():
                if fitted[i] < 1:
                    break
                times = Counter(patterns[i])
                many = min(int(fitted[i]), *(left[x] // k for x, k in times.items()))
                if many > 0:
                    added.append((tuple(sorted(times.items(), reverse=True)), int(many)))
                    for x, k in times.items():
                        left[x] -= many * k
        if not added:
            break
        plan = plan + added
        best = min(best, plan + pack_residuals(left, capacity), key=size)
    return best


def slots(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lowest rank, end of ranks, first sequence, times, offset): where the pieces of a length go, by rank."""
    out = []
    used: Counter[int] = Counter()
    sequence = 0
    for pattern, many in plan:
        offset = 0
        for length, times in pattern:
            out.append((length, used[length], used[length] + many * times, sequence, times, offset))
            used[length] += many * times
            offset += length * times
        sequence += many
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a table that can be read twice alike, with doc_id, piece, length) with sequence_id and offset."""
    spark = pieces.sparkSession
    rows = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each length
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows:
        counts[r.length] = r.n
    total = int(counts.sum())
    per_bucket = max(BUCKET_ROWS, math.isqrt(total))
    lengths = spark.createDataFrame([(int(x), -(-int(counts[x]) // per_bucket)) for x in np.flatnonzero(counts)], "length long, buckets long")
    places = spark.createDataFrame(slots(plan_packing(counts, capacity)), "length long, low long, high long, first long, times long, at long")
    # Both tables are bounded by the length of a sequence, whatever the data.
    dealt = pieces.join(F.broadcast(lengths), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    ahead = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(ahead, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("ahead")).drop("own", "ahead", "bucket")
    placed = ranked.alias("p").join(F.broadcast(places.alias("s")), F.expr("p.length = s.length AND p.rank >= s.low AND p.rank < s.high"))
    sequence = F.expr("s.first + (p.rank - s.low) DIV s.times").alias("sequence_id")
    offset = F.expr("s.at + (p.rank - s.low) % s.times * s.length").alias("offset")
    return placed.select(*[F.col(f"p.`{c}`") for c in pieces.columns], sequence, offset)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece of each document: (doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset)."""
    return pack_pieces(materialize(token_pieces(docs, path, capacity, doc_id, text, ids)), capacity)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their places."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
