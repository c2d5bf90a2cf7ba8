"""Near copies by SimHash and pivot distance tables, completed by the exact similarity of their shingle sets.

Two documents are linked when the sets of their five-word shingles have a
Jaccard similarity of 0.8 or more; components of links are groups of near copies.

Fingerprints come first: documents within two bits, found through the pivot
distance tables of ``simhash``, are held against each other, and what is similar
is linked. At a similarity of 0.8 most fingerprints are further apart, and no
radius tells such pairs from others, so an exact join looks among the documents
of different components for the pairs that this leaves.

No pair is lost. With the shingles of a set in one order that holds for all sets,
sets of that similarity share one among the first fifth of each, so documents
meet on these prefixes alone. The order is that of the shingles' hashes, with
those last that a sample shows in many documents; which these are changes the
work, never the result. A pair is skipped when sizes, or the shingles that its
prefixes share, or how many are left from the first shared one on, exclude the
similarity; all others are counted shingle by shingle. Where very many documents meet on one shingle, each is first held
against its neighbours by size and in a few orders by hash; what these links join isn't compared again, all
others are.

Defined cases: letters A-Z count as a-z; a text of fewer words than a shingle
is one shingle, texts without words are equal; rows without an id can't be told
apart, so they link nothing and stay; rows that repeat a doc_id all go if one
does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import as_bytes, map_texts, materialize
from quadrille.llm.simhash import components, fingerprint, links

SHINGLE_WORDS = 5
SEED = 42
#: Documents at a shingle from which they are first held against their neighbours only.
CROWDED = 64
#: One document of so many is looked at for shingles that are common, and how many of these it takes.
SAMPLED, COMMON = 16, 4
#: Orders by hash, the same at all shingles, in which they have neighbours besides the one by size.
ORDERS = 4
#: Common shingles that come last in the order, the commonest ones.
COMMON_MOST = 1_000_000
#: Words whose hashes a task keeps.
KEPT_WORDS = 200_000

_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Known(dict):
    """Words' hashes, each found when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingle_set(text: bytes, known: Known) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    if len(known) > KEPT_WORDS:
        known.clear()
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE_WORDS + 1
    mixed = sum(each[j : j + n] * _FACTORS[j] for j in range(SHINGLE_WORDS))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    found = np.sort(mixed ^ (mixed >> np.uint64(32)))
    return found[np.append(True, found[1:] != found[:-1])]


def prefix_length(n: int) -> int:
    """Of n shingles in order, how many hold one that any set of similarity 0.8 shares."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _sets(docs: DataFrame, common=None) -> DataFrame:
    """(doc_id, sid, n, keys): a number for the set, its size, and its prefix, then with the text's fingerprint (fp); without ``common`` (a broadcast) the whole set."""
    whole = common is None

    def make():
        known = Known()
        late = None if common is None else common.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sid, n, keys, fp = [], [], [], []
            for x in as_bytes(batch.column(1)):
                found = shingle_set(x, known)
                sid.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                n.append(len(found))
                if late is not None:
                    fp.append(fingerprint(x))
                    if len(late) and len(found):
                        is_late = late[np.minimum(np.searchsorted(late, found), len(late) - 1)] == found
                        found = np.concatenate([found[~is_late], found[is_late]])
                    found = found[: prefix_length(len(found))]
                keys.append(found.view(np.int64))
            out = [batch.column(0), pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            out += [] if whole else [pa.array(np.array(fp, np.uint64).view(np.int64))]
            return pa.RecordBatch.from_arrays(out, ["doc_id", "sid", "n", "keys", "fp"][: len(out)])

        return each

    return map_texts(docs, make, "doc_id long, sid long, n int, keys array<long>" + ("" if whole else ", fp long"))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that a sample of the distinct texts shows in many."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = _sets(sample).dropDuplicates(["sid"]).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    found = counts.orderBy(F.desc("c"), "key").limit(COMMON_MOST).toPandas()
    return np.sort(found["key"].to_numpy(np.int64).view(np.uint64))


def _near_fingerprints(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``sets`` (sid, fp) whose fingerprints link: each with the least one of its fingerprint, and the least ones of linked fingerprints."""
    heads = materialize(sets.groupBy("fp").agg(F.min("sid").alias("head")))
    same = sets.join(heads, "fp").where("sid <> head").select(F.col("head").alias("u"), F.col("sid").alias("v"))
    side = lambda k: heads.select(F.col("fp").alias(k), F.col("head").alias(f"{k}_head"))
    near = links(heads.select("fp")).join(side("u"), "u").join(side("v"), "v")
    return materialize(same.union(near.select(F.least("u_head", "v_head"), F.greatest("u_head", "v_head"))).distinct())


def _met(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of different roots that meet at shingles which few have, and that sizes and shared shingles don't exclude.

    ``n_crowded`` counts the other shingles of a prefix. Beyond the prefix that ends first, no more can be
    shared than its document has left.
    """
    both = rows.alias("a").join(rows.alias("b"), F.expr("a.key = b.key AND a.sid < b.sid AND a.root <> b.root AND 5L * least(a.n, b.n) >= 4L * greatest(a.n, b.n)"))
    left = lambda n: f"((4L * {n} + 4) DIV 5 - 1)"
    counted = both.groupBy(F.col("a.sid").alias("u"), F.col("b.sid").alias("v"), F.col("a.n").alias("n"), F.col("b.n").alias("m"), F.least("a.n_crowded", "b.n_crowded").alias("more")).agg(F.count("*").alias("shared"))
    return counted.where(f"9L * (shared + more + greatest({left('n')}, {left('m')})) >= 4L * (n + m)").select("u", "v")


def _met_apart(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of different roots that meet at a crowded shingle which may be the first that they share.

    From the first one on, both must have as many shingles left as the similarity needs. If a similar pair's
    first one is not crowded, it has met there.
    """
    both = rows.alias("a").join(rows.alias("b"), F.expr("a.key = b.key AND a.sid < b.sid AND a.root <> b.root AND 9L * least(a.n - a.at, b.n - b.at) >= 4L * (a.n + b.n)"))
    return both.select(F.col("a.sid").alias("u"), F.col("b.sid").alias("v")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (u, v) that have similarity 0.8 or more."""
    side = lambda k: sets.select(F.col("sid").alias(k), F.col("keys").alias(f"{k}_keys"))
    shared = F.size(F.array_intersect("u_keys", "v_keys"))
    close = 9 * shared >= 4 * (F.size("u_keys") + F.size("v_keys"))
    return materialize(pairs.join(side("u"), "u").join(side("v"), "v").where(close).select("u", "v"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id): the smallest doc_id that links reach, a row for each row that has an id."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(picked))
    # Numbers of rows hold once they are written.
    prefixes = materialize(_sets(picked, common).withColumn("row", F.monotonically_increasing_id()))
    # Equal sets are one; its prefix stays in the first table, so it is written once only.
    one = materialize(prefixes.groupBy("sid").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("row").alias("row")))
    groups = one.select("sid", "least")

    def whole(pairs: DataFrame) -> DataFrame:
        """Whole sets of the documents that are compared."""
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
        ids = materialize(groups.join(wanted, "sid", "left_semi"))
        # Rows that repeat an id with other texts add sets that no pair names.
        texts = picked.join(ids.select(F.col("least").alias("doc_id")), "doc_id", "left_semi")
        return materialize(_sets(texts).select("sid", "keys").dropDuplicates(["sid"]))

    # By fingerprints first; then exactly what these leave apart.
    near = _near_fingerprints(one.select("sid", "fp"))
    linked = _similar(near, whole(near))
    rooted = one.select("sid", "n").join(components(linked).select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rows = one.select("row", "sid").join(prefixes.select("row", "keys"), "row").select("sid", F.posexplode("keys").alias("at", "key"))
    # All shingles move here, so what their sets have in common comes after.
    met = rows.withColumn("together", F.count("*").over(Window.partitionBy("key"))).where("together > 1").join(rooted, "sid")
    of_set = Window.partitionBy("sid")
    crowded = F.col("together") > CROWDED
    met = materialize(met.withColumn("n_crowded", F.count_if(crowded).over(of_set)))

    few, crowd = met.where(~crowded), met.where(crowded)
    at_key = Window.partitionBy("key")
    by_size = at_key.orderBy("n", "sid")
    shuffled = [F.lag("sid").over(at_key.orderBy(F.xxhash64("sid", F.lit(i)), "sid")) for i in range(ORDERS)]
    beside = crowd.select("sid", "n", F.array_distinct(F.array(F.lag("sid").over(by_size), F.first("sid").over(by_size), *shuffled)).alias("others"))
    beside = beside.select("sid", "n", F.explode("others").alias("other")).where("other <> sid")
    # Only those that are neighbours at many shingles: none is lost, as all that stay apart are compared below.
    beside = beside.groupBy("sid", "other", "n").agg(F.count("*").alias("times")).where("times * 15 >= n")
    pairs = _met(few).union(beside.select(F.least("sid", "other").alias("u"), F.greatest("sid", "other").alias("v")))
    pairs = materialize(pairs.distinct().join(near, ["u", "v"], "left_anti"))
    linked = materialize(linked.union(_similar(pairs, whole(pairs))))
    apart = crowd.drop("root").join(components(linked).select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    apart = materialize(apart)
    rest = materialize(_met_apart(apart).join(pairs.union(near), ["u", "v"], "left_anti"))
    roots = components(linked.union(_similar(rest, whole(rest))))

    rooted = groups.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = materialize(rooted.join(smallest, "root").select("sid", "component_id"))
    return prefixes.select("doc_id", "sid").join(table, "sid").select("doc_id", "component_id")


def near_copy_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller id."""
    gone = near_copies(docs, doc_id, text).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(f"`{doc_id}`").cast("long") == F.col("_gone"), "left_anti")
