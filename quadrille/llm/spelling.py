"""Spelling variants: words one code point apart, without pairs.

Words are counted with one pass over the texts. Two words differ by a replaced
code point if they agree before and behind it: every word stands in one
wildcard group for each of its places (place, prefix, suffix), and a group
keeps its size and its two commonest words, which is all that its members need.
They differ by an inserted one if one of them is what a deletion leaves of the
other: the remains of deletions meet the word that is spelt like that. So a
word of n code points makes 2 n + 1 small rows, whatever many words are near it.

Words move as their rank by count (ties by code points), so the smallest rank
is the best form, and groups as 128-bit hashes, sums of a number for each place
and letter, so that a word of any length makes rows of fixed size. A group
holds at most a word for each letter and place, which bounds it.

Defined cases: a null text has no words; a null id is written as nothing in
front of the colon; repeated rows count each; words are as long as their run of
letters. Roots: forms at least double the count, so they are followed in a few
rounds. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import as_bytes, bound_batches, materialize, slices
from quadrille.llm.scan import running

#: Code points of a word and its occurrences, at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Occurrences of a form in those of the word, at least.
FORM_TIMES = 2
#: Deletion noise: one in so many (document, run) loses a code point.
NOISE = 97
#: Words and bytes of words that a task counts before it hands them on.
KEPT_WORDS, KEPT_BYTES = 400_000, 32 << 20
#: Code points of words whose group keys are made at once.
FLAT = 1 << 20

# Bytes of Latin-1 text: letters in lower case (A-Z only), a blank for all else.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 0xC0 else 32 for x in range(256))
_WILD = 256


def runs(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters of a text in UTF-8, as Latin-1: a byte is a code point."""
    return text.decode().encode("latin-1", "replace").translate(_LETTERS).split()


def changed(run: bytes, start: int) -> bytes:
    """The run, or what a deletion leaves of it; ``start`` is the crc32 of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: bool = True) -> DataFrame:
    """(word, n) of all words; tasks count before words move."""
    bound_batches(docs.sparkSession)

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        held = 0
        for batch in slices(batches):
            for key, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                start = zlib.crc32(b"%d:" % key if key is not None else b":")
                for w, c in Counter(runs(t)).items():
                    if len(w) >= LEAST_LENGTH:
                        if noise and len(w := changed(w, start)) < LEAST_LENGTH:
                            continue
                        if w not in total:
                            held += len(w)
                        total[w] += c
                        if len(total) >= KEPT_WORDS or held >= KEPT_BYTES:
                            yield out(total)
                            total.clear()
                            held = 0
        if total:
            yield out(total)
        pa.default_memory_pool().release_unused()

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbers(place: np.ndarray, letter: np.ndarray, seed: int) -> np.ndarray:
    """A random 64-bit number for each place and letter."""
    x = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + letter.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


OWN, DELETED, WILD = 0, 1, 2


def group_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's number, kind, k1, k2): a row for each word, for each of its places, and for each different deletion."""
    size = np.array(list(map(len, words)))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(words)), size)
    start = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(len(flat)) - start
    first = place == 0
    fresh = first.copy()  # of equal letters in a row, deleting one is like deleting another
    fresh[1:] |= flat[1:] != flat[:-1]
    keys = []
    for seed in (1, 2):
        z, shifted = _numbers(place, flat, seed), _numbers(place - 1, flat, seed)
        up, up_shifted = np.cumsum(z), np.cumsum(shifted)
        base, base_shifted = (up - z)[start], (up_shifted - shifted)[start]
        end = start + np.repeat(size, size) - 1
        whole = up[end] - base
        wild = whole - z + _numbers(place, np.full(len(flat), _WILD), seed)
        deleted = (up - z - base) + (up_shifted[end] - up_shifted)
        keys.append(np.concatenate([whole[first], deleted[fresh], wild]).view(np.int64))
    kind = np.repeat([OWN, DELETED, WILD], [len(words), int(fresh.sum()), len(flat)])
    return np.concatenate([word[first], word[fresh], word]), kind, *keys


def _keyed(ranked: DataFrame) -> DataFrame:
    """(rank, kind, k1, k2) of words (rank, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ranks: list[int], words: list[bytes]) -> Iterator[pa.RecordBatch]:
            number, kind, k1, k2 = group_keys(words)
            rank = np.array(ranks)[number]
            for at in range(0, len(rank), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(rank[part]), pa.array(kind[part].astype(np.int32)), pa.array(k1[part]), pa.array(k2[part])], ["rank", "kind", "k1", "k2"])

        for batch in batches:
            ranks, words, held = [], [], 0
            for r, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ranks.append(r)
                words.append(w.encode("latin-1"))
                held += len(w)
                if held >= FLAT:
                    yield from made(ranks, words)
                    ranks, words, held = [], [], 0
            if words:
                yield from made(ranks, words)

    return ranked.select("rank", "word").mapInArrow(run, "rank long, kind int, k1 long, k2 long")


def near_words(ranked: DataFrame) -> DataFrame:
    """(rank, n_near, best): of words (rank, word) those that have near ones, how many, and the smallest rank among these."""
    group = Window.partitionBy("k1", "k2")
    by_rank = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = lambda k: F.min(F.when(F.col("kind") == k, F.col("rank"))).over(by_rank)
    kept = _keyed(ranked).select("*", F.count("*").over(by_rank).alias("size"), F.first("rank").over(by_rank).alias("top"), F.nth_value("rank", 2).over(by_rank).alias("second"), least(OWN).alias("own"), least(DELETED).alias("longer"))
    kept = kept.where("size > 1")
    told = F.when(F.col("kind") == WILD, F.struct((F.col("size") - 1).alias("n"), F.when(F.col("rank") == F.col("top"), F.col("second")).otherwise(F.col("top")).alias("best")))
    told = told.when(F.col("kind") == DELETED, F.when(F.col("own").isNotNull(), F.struct(F.lit(1).cast("long").alias("n"), F.col("own").alias("best"))))
    told = told.otherwise(F.struct((F.col("size") - 1).alias("n"), F.col("longer").alias("best")))
    return kept.select("rank", told.alias("m")).where("m IS NOT NULL").groupBy("rank").agg(F.sum("m.n").alias("n_near"), F.min("m.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root) of links (rank, form): each round doubles the links that are followed, and ends those that arrived."""
    at = materialize(forms.select("rank", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        step = materialize(at.join(onward, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("rank", "root")
        if step.where("moved").isEmpty():
            return at


def spelling_variants(counts: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n)."""
    numbered = counts.select("word", "n", F.lit(0).cast("long").alias("_all"), F.lit(1).cast("long").alias("one"))
    ranked = running(numbered, "_all", [F.desc("n"), F.col("word")], ["one"]).select(F.col("r_one").alias("rank"), "word", "n")
    ranked = materialize(ranked)
    near = ranked.select("rank", "n").join(near_words(ranked), "rank")
    other = ranked.select(F.col("rank").alias("best"), F.col("n").alias("best_n"))
    near = near.join(other, "best").select("rank", "n_near", F.when(F.col("best_n") >= FORM_TIMES * F.col("n"), F.col("best")).alias("form"))
    near = materialize(near)
    led = roots(near.where("form IS NOT NULL"))
    spelt = lambda k: ranked.select(F.col("rank").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n"))
    out = ranked.join(near, "rank", "left").join(led, "rank", "left").join(spelt("form"), "form", "left").join(spelt("root"), "root", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = word_counts(docs).where(F.col("n") >= LEAST_COUNT)
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
