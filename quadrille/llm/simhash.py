"""SimHash near-duplicates found through pivot distance tables.

Each distinct fingerprint gets a table row: its Hamming distances to reference
fingerprints (pivots). By the triangle inequality two fingerprints within
``RADIUS`` bits differ by at most that much in every coordinate, so a pair with
a larger difference in any coordinate is discarded, and only survivors are
compared bit by bit.

Comparing all rows with all rows would be quadratic. Some pivots therefore look
at one band of bits only: of five disjoint bands two flipped bits leave at least
three untouched, so a linked pair has equal distances to all pivots of some
three bands. Rows meet on those coordinates alone. A meeting point that holds
very many rows (thousands of near copies whose fingerprints are close together)
is split once more by the pivots of seven narrow bands of the bits that it
leaves free. Two of those hold at most 8 bits, so no point holds more than 256
rows then, and work stays in proportion to the rows.

Links join fingerprints into components by repeated minimum-label exchange
(large star, small star) over tables in the shared folder.

Defined cases: null and empty texts have no words and share the fingerprint
zero, as any other equal fingerprints do; a null ``doc_id`` keeps its row and
counts as no smallest id unless its whole component has none; repeated rows are
repeated in the result; other columns play no part.
"""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import as_bytes, map_texts, materialize

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Bands of bits; a linked pair agrees on all but RADIUS of them.
BANDS = 5
#: Narrow bands of the bits that a first meeting point leaves free.
FINE_BANDS = 7
#: Rows at a first meeting point from which it is split by the finer bands.
CROWDED = 128
#: Pivots that look at all bits, for the table that pairs are filtered by.
WIDE_PIVOTS = 8


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's shingles, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words)
    if n <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - SHINGLE_WORDS] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[s:e], SEED) for s, e in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, a row for each row."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(x) for x in as_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

        return each

    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bands(bits: list[int], parts: int) -> list[list[int]]:
    cuts = np.linspace(0, len(bits), parts + 1).round().astype(int)
    return [bits[a:z] for a, z in pairwise(cuts)]


def _references(bits: list[int]) -> list[tuple[int, int]]:
    """(mask, pivot) of a band: no bit, and each single bit. Their distances tell all values of the band apart."""
    mask = sum(1 << b for b in bits)
    return [(mask, p) for p in (0, *(1 << b for b in bits))]


def _literal(bands: list[list[tuple[int, int]]]) -> str:
    return "array(" + ",".join("array(" + ",".join(f"named_struct('m',{_signed(m)}L,'p',{_signed(p)}L)" for m, p in band) + ")" for band in bands) + ")"


def _distances(band: Column) -> Column:
    """A hash of the distances from fp to a band's references."""
    return F.xxhash64(F.transform(band, lambda r: F.bit_count(F.col("fp").bitwiseXOR(r["p"]).bitwiseAND(r["m"]))))


def _meetings(parts: int, name: str) -> Column:
    """Hashes of the equal coordinates of each choice of all but RADIUS bands (columns name0, name1, ...)."""
    return F.array(*[F.xxhash64(F.lit(i), *[f"{name}{j}" for j in chosen]) for i, chosen in enumerate(combinations(range(parts), parts - RADIUS))])


def pivot_table(fp: Column) -> Column:
    """Distances to the wide pivots, 8 bits each, in one long."""
    packed = F.lit(0).cast("long")
    for i in range(WIDE_PIVOTS):
        pivot = _signed(xxhash.xxh64_intdigest(f"pivot {i}", SEED))
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(pivot))).cast("long"), 8 * i))
    return packed


def _pairs(rows: DataFrame) -> DataFrame:
    """Rows (key, fp, pivots) that meet and are close: pivot filter, then the exact check."""
    rows = rows.select("key", "fp", "pivots")
    close = "a.key = b.key AND a.fp < b.fp"
    for i in range(0, 8 * WIDE_PIVOTS, 8):
        close += f" AND abs((shiftright(a.pivots, {i}) & 255) - (shiftright(b.pivots, {i}) & 255)) <= {RADIUS}"
    close += f" AND bit_count(a.fp ^ b.fp) <= {RADIUS}"
    return rows.alias("a").join(rows.alias("b"), F.expr(close)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def links(distinct: DataFrame) -> DataFrame:
    """(u, v), u < v: all pairs of fingerprints in ``distinct`` (column fp) within RADIUS bits."""
    bands = _bands(list(range(64)), BANDS)
    first = F.expr(_literal([_references(b) for b in bands]))
    coordinates = distinct.select("fp", pivot_table(F.col("fp")).alias("pivots"), *[_distances(first[j]).alias(f"band{j}") for j in range(BANDS)])
    met = materialize(coordinates.select("fp", "pivots", F.posexplode(_meetings(BANDS, "band")).alias("number", "key")))
    crowded = materialize(met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("key", F.lit(True).alias("crowded")))
    marked = met.join(crowded, "key", "left")
    few = _pairs(marked.where(F.col("crowded").isNull()))

    # What a meeting point leaves free, in narrow bands: by the point's number, then by band.
    free = [sorted(sum((bands[j] for j in range(BANDS) if j not in chosen), [])) for chosen in combinations(range(BANDS), BANDS - RADIUS)]
    narrow = F.expr("array(" + ",".join(_literal([_references(b) for b in _bands(bits, FINE_BANDS)]) for bits in free) + ")")
    again = marked.where("crowded").select("fp", "pivots", F.col("key").alias("first"), *[_distances(narrow[F.col("number")][j]).alias(f"narrow{j}") for j in range(FINE_BANDS)])
    split = again.select("fp", "pivots", "first", F.explode(_meetings(FINE_BANDS, "narrow")).alias("second"))
    many = _pairs(split.select("fp", "pivots", F.xxhash64("first", "second").alias("key")))
    return few.union(many).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (u, v) reaches; values compare as signed longs."""
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    def are_stars() -> bool:
        """Whether every node is either a root or in one edge only, so nothing is left to exchange."""
        ends = edges.selectExpr("v AS node", "1 AS below", "0 AS above").union(edges.selectExpr("u", "0", "1"))
        nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        return nodes.where("below > 1 OR below + above > 1").isEmpty()

    while not are_stars():
        # Large star: every node's larger neighbours point to its least neighbour.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # Small star: every node and its smaller neighbours point to the least of them.
        down = large.select(F.col("v").alias("n"), F.col("u").alias("s"))
        lowest = down.groupBy("n").agg(F.min("s").alias("m"))
        small = down.join(lowest, "n").select(F.col("m").alias("u"), F.col("s").alias("v")).union(lowest.select(F.col("m").alias("u"), F.col("n").alias("v")))
        edges = materialize(small.where("u <> v").distinct())
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links reach, a row for each row of ``docs``."""
    prints = materialize(fingerprints(docs, doc_id, text))
    # One row for each fingerprint, however many copies it has; summed before the shuffle.
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialize(components(links(groups.select("fp"))))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = materialize(rooted.join(smallest, "root").select("fp", "component_id"))
    return prints.join(table, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller id.

    Rows that repeat a doc_id with one text are one document: all stay or all
    go. Rows without an id can't be told apart and stay.
    """
    gone = near_duplicates(docs, doc_id, text).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(f"`{doc_id}`").cast("long") == F.col("_gone"), "left_anti")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Per document: fingerprint in hex and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
