"""Prefix tries of conversations, succinct and in level order.

Turns become 128-bit digests first; texts don't move. Running totals along each
conversation (``scan.running``) give every turn its place and the digest of the
whole prefix, so a node of the trie is a row of a grouped count. Nodes in a row
with the same members are one edge: as members only get fewer, an edge is known
by its smallest member and their number.

Edges whose members are few hang below the heavy upper levels in subtrees of
bounded size. Whole subtrees are dealt to shards by their first prefix; numpy
puts a shard's edges into level order, writes its shape as a LOUDS bit vector
(a one for each child, then a zero) beside an array of labels, and rolls up
from the last level to the first by ``add.at``. What the subtrees' tops hold is
summed for the heavy edges, which are rolled up in one trie of their own: an
edge is heavy with more members than 256 or a millionth of all turns, so there are
at most a million heavy nodes, however large the table is.

Defined cases: null role or text is empty; turns are ordered by their number,
null first, and those that tie by their digest; rows without a conv_id belong to
no conversation; rows that repeat are turns of their own. A table without
conversations has no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import materialize
from quadrille.llm.scan import running

#: Conversations that share the beginning of their first one, and how many turns of it at most.
FAMILY, MOST_SHARED = 20, 3
#: Members from which an edge may be heavy, and how many heavy nodes there may be.
LEAST_HEAVY, MOST_NODES = 256, 1_000_000
#: Edges of a shard, about.
SHARD_EDGES = 50_000
#: Ids of a piece of a node's ends.
PIECE_IDS = 1 << 15

WORD = r"[^\x20\x09-\x0D]+"


# Prefixes ---------------------------------------------------------------------


def digests(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, a, b, words): a 128-bit digest of role and text, and the text's words."""
    picked = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    n = F.regexp_count("text", F.lit(WORD)).cast("long")
    return picked.select("conv_id", "turn", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), n.alias("words"))


def ranked_turns(turns: DataFrame) -> DataFrame:
    """``turns`` of ``digests`` with ``rank``, from 1 in each conversation."""
    one = turns.withColumn("one", F.lit(1).cast("long"))
    return running(one, "conv_id", [F.asc_nulls_first("turn"), F.col("a"), F.col("b")], ["one"]).select("conv_id", F.col("r_one").alias("rank"), "a", "b", "words")


def shared_beginnings(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, pos, a, b, words), and conversations (conv_id, length).

    A conversation gets the first h turns of the first one of its family (or as many as that has) in
    place of its own first h; h is its id's crc32 modulo 4.
    """
    own = materialize(ranked.groupBy("conv_id").agg(F.count("*").alias("n")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = own.select("conv_id", "n", h.alias("h"), first.alias("first"))
    firsts = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.col("n").alias("first_n"))
    kept = F.least("h", F.coalesce("first_n", F.lit(0).cast("long")))
    convs = convs.join(firsts, "first", "left").select("conv_id", "first", "h", kept.alias("kept"), (kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialize(convs)
    heads = ranked.where((F.col("conv_id") % FAMILY == 0) & (F.col("rank") <= MOST_SHARED)).select(F.col("conv_id").alias("first"), "rank", "a", "b", "words")
    heads = heads.join(convs, "first").where("rank <= kept").select("conv_id", F.col("rank").alias("pos"), "a", "b", "words")
    tails = ranked.join(convs, "conv_id").where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("kept")).alias("pos"), "a", "b", "words")
    return heads.union(tails), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, p1, p2, words, cum): each prefix's digest, that of the prefix before, the last turn's words and all words so far.

    The prefix of no turns is a row of each conversation of ``convs``, too.
    """
    placed = turns.select("conv_id", "pos", F.xxhash64("pos", "a", "b").alias("g1"), F.xxhash64("b", "a", "pos").alias("g2"), "words")
    found = running(placed, "conv_id", [F.col("pos")], ["words"], ["g1", "g2"])
    rows = found.select("conv_id", "pos", F.col("r_g1").alias("h1"), F.col("r_g2").alias("h2"), F.col("r_g1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("r_g2").bitwiseXOR(F.col("g2")).alias("p2"), "words", F.col("r_words").alias("cum"))
    zero = F.lit(0).cast("long")
    return rows.union(convs.select("conv_id", *[zero.alias(c) for c in rows.columns[1:]]))


# Shards -----------------------------------------------------------------------

#: An edge as it comes: its place in the forest, and what hangs below it outside of the forest.
EDGE = "conv_id long, n_convs long, top long, bottom long, words long, cum long, h1 long, h2 long, p1 long, p2 long, label long, more_children long, more_leaves long, more_saved long"
#: What the trie adds: whether its parent is in another forest, its parent's member, and the roll-ups.
ROLLED = "outer boolean, parent_conv_id long, n_children long, n_leaves long, below long, saved long"


class Trie:
    """Edges in level order: ``bits`` (LOUDS, with a root above all trees), ``order`` and ``levels``.

    ``order[i]`` is the row of the i-th edge; ``levels`` are the offsets of the levels; edge i is number i + 1,
    as the root above is 0.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray, p1: np.ndarray, p2: np.ndarray, label: np.ndarray):
        n = len(h1)
        by = np.lexsort((h2, h1))
        s1, s2 = h1[by], h2[by]
        at = np.searchsorted(s1, p1)
        while True:  # ends at once, as equal first halves are as good as never different
            wrong = np.flatnonzero((at < n) & (s1[np.minimum(at, n - 1)] == p1) & (s2[np.minimum(at, n - 1)] != p2))
            if not len(wrong):
                break
            at[wrong] += 1
        inside = (at < n) & (s1[np.minimum(at, n - 1)] == p1) & (s2[np.minimum(at, n - 1)] == p2)
        parent = np.where(inside, by[np.minimum(at, n - 1)], -1)
        parent[parent == np.arange(n)] = -1
        children = np.lexsort((label, parent))
        count = np.bincount(parent + 1, minlength=n + 1)
        start = np.cumsum(count) - count
        level, self.levels, found = children[: count[0]], [0], []
        while len(level):
            found.append(level)
            self.levels.append(self.levels[-1] + len(level))
            k = count[level + 1]
            level = children[np.repeat(start[level + 1] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        self.order = np.concatenate(found) if found else np.zeros(0, np.int64)
        number = np.empty(n, np.int64)
        number[self.order] = np.arange(n)
        #: Of the i-th edge: its parent's place in the order, -1 for the root above, and its children.
        self.parent = np.where(parent[self.order] < 0, -1, number[parent[self.order]])
        self.count = count[self.order + 1]
        degrees = np.append(count[0], self.count)
        self.bits = np.ones(int(degrees.sum()) + n + 1, bool)
        self.bits[np.cumsum(degrees + 1) - 1] = False
        self.labels = label[self.order]

    def roll_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values in level order: from the last level to the first."""
        total = values.copy()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:1:-1]):
            np.add.at(total, self.parent[a:b], total[a:b])
        return total


def children_of(bits: np.ndarray, number: int) -> range:
    """Numbers of a node's children by select and rank on LOUDS bits; the root above is 0."""
    zeros = np.flatnonzero(~bits)
    begin = zeros[number - 1] + 1 if number else 0
    first = begin - number + 1  # ones before it, and the root that no one stands for
    return range(int(first), int(first + zeros[number] - begin))


def rolled(table: pa.Table) -> tuple[Trie, dict[str, np.ndarray]]:
    """The trie of a forest's edges (EDGE), and their columns with ROLLED's in level order."""
    raw = {c: table.column(c).to_numpy() for c in table.column_names}
    trie = Trie(raw["h1"], raw["h2"], raw["p1"], raw["p2"], raw["label"])
    e = {c: v[trie.order] for c, v in raw.items()}
    inside = trie.parent >= 0
    above = trie.parent * inside
    children = trie.count + e["more_children"]
    own = (e["n_convs"] - 1) * e["words"]
    saved = trie.roll_up(own + e["more_saved"])
    e |= {"outer": ~inside, "parent_conv_id": np.where(inside, e["conv_id"][above], 0) if len(above) else above, "n_children": children}
    e |= {"n_leaves": trie.roll_up((children == 0) + e["more_leaves"]), "below": saved - own, "saved": saved}
    return trie, e


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


SHARD = "shard long, n_trees long, bits binary, labels array<long>, edges array<struct<" + ", ".join(x.replace(" ", ":") for x in f"{EDGE}, {ROLLED}".split(", ")) + ">>"


def tries(edges: DataFrame) -> DataFrame:
    """SHARD of edges (shard, EDGE): a row for each shard, its arrays in level order."""
    names = _names(f"{EDGE}, {ROLLED}")
    kind = pa.struct([(c, pa.bool_() if c == "outer" else pa.int64()) for c in names])

    def build(table: pa.Table) -> pa.Table:
        trie, e = rolled(table.select(_names(EDGE)))
        rows = pa.StructArray.from_arrays([pa.array(e[c]) for c in names], fields=list(kind))
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table({"shard": table.column("shard").slice(0, 1), "n_trees": pa.array([int(trie.levels[1])]), "bits": pa.array([np.packbits(trie.bits).tobytes()], pa.binary()), "labels": whole(pa.array(trie.labels)), "edges": whole(rows)})

    return edges.groupBy("shard").applyInArrow(build, SHARD)


def edges_of(nodes: DataFrame) -> DataFrame:
    """EDGE of nodes (pos, h1, h2, n_convs, conv_id, words, cum, p1, p2)."""
    last = F.max_by(F.struct("h1", "h2"), "pos")
    first = F.min_by(F.struct("p1", "p2", F.col("h1").bitwiseXOR(F.col("p1")).alias("label"), (F.col("cum") - F.col("words")).alias("before")), "pos")
    found = nodes.groupBy("conv_id", "n_convs").agg(F.min("pos").alias("top"), F.max("pos").alias("bottom"), F.max("cum").alias("cum"), last.alias("z"), first.alias("a"))
    zero = F.lit(0).cast("long")
    # The root has no prefix before it; no edge ends in the digest that stands there.
    before = lambda c: F.when(F.col("top") > 0, F.col(f"a.{c}")).otherwise(F.lit(-1).cast("long"))
    return found.select("conv_id", "n_convs", "top", "bottom", (F.col("cum") - F.col("a.before")).alias("words"), "cum", "z.h1", "z.h2", before("p1").alias("p1"), before("p2").alias("p2"), "a.label", *[zero.alias(f"more_{c}") for c in ("children", "leaves", "saved")])


def prefix_tries(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of ``prefixes``, SHARD of the subtrees, and SHARD of the heavy edges above them (one row)."""
    anyone = lambda c: F.min(c).alias(c)  # noqa: E731  alike in all rows of a node
    nodes = materialize(rows.groupBy("pos", "h1", "h2").agg(F.count("*").alias("n_convs"), anyone("conv_id"), anyone("words"), anyone("cum"), anyone("p1"), anyone("p2")))
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    most = max(LEAST_HEAVY, total // MOST_NODES)
    heavy = (F.col("n_convs") > most) | (F.col("pos") == 0)
    edges = materialize(edges_of(nodes))
    heavy_edge = (F.col("n_convs") > most) | (F.col("top") == 0)
    # At most MOST_NODES rows of three numbers.
    above = F.broadcast(nodes.where(heavy).select("pos", "h1", "h2"))
    trees = rows.join(above, ["pos", "h1", "h2"], "left_anti").groupBy("conv_id").agg(F.min_by(F.struct("h1", "h2"), "pos").alias("tree"))
    light = edges.where(~heavy_edge)
    n = light.count() // SHARD_EDGES + int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = light.join(trees, "conv_id").withColumn("shard", F.pmod(F.xxhash64("tree"), F.lit(n).cast("long"))).drop("tree")
    lower = materialize(tries(dealt))
    tops = lower.select(F.inline("edges")).where("outer").groupBy("p1", "p2").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
    upper = edges.where(heavy_edge).join(tops.select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), "c", "l", "s"), ["h1", "h2"], "left")
    more = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    upper = upper.withColumns({"more_children": more("c"), "more_leaves": more("l"), "more_saved": more("s"), "shard": F.lit(-1).cast("long")}).drop("c", "l", "s")
    return nodes, lower, materialize(tries(upper))


# Ends -------------------------------------------------------------------------


def end_digests(ends: DataFrame) -> DataFrame:
    """(pos, h1, h2, ends_sha256) of the conversations (conv_id, pos, h1, h2) that end at a node.

    A node with many ends is spread over tasks, which join ids to pieces; pieces are hashed in their order.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["pos", "h1", "h2"]
    order = [*keys, "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, h1, h2, ids = (batch.column(i).to_numpy() for i in range(4))
            fresh = np.append(True, (pos[1:] != pos[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            starts = np.flatnonzero(fresh)
            stops = np.append(starts[1:], len(ids))
            cuts = [(a, min(a + PIECE_IDS, z)) for s, z in zip(starts.tolist(), stops.tolist()) for a in range(s, z, PIECE_IDS)]
            at = np.array([a for a, _ in cuts])
            text = list(map(str, ids.tolist()))
            yield pa.RecordBatch.from_arrays([*[pa.array(x[at]) for x in (pos, h1, h2, ids)], pa.array([",".join(text[a:z]) for a, z in cuts], pa.string())], [*order, "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if key != last:
                    if last:
                        done.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*keys, "ends_sha256"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, state.hexdigest())], [*keys, "ends_sha256"])

    dealt = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    joined = dealt.mapInArrow(pieces, "pos long, h1 long, h2 long, conv_id long, ids string")
    return joined.repartition(n, *keys).sortWithinPartitions(*order).mapInArrow(hashed, "pos long, h1 long, h2 long, ends_sha256 string")


# Nodes ------------------------------------------------------------------------


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations, from turns (conv_id, pos, a, b, words) and (conv_id, length)."""
    rows = materialize(prefixes(turns, convs))
    nodes, lower, upper = prefix_tries(rows)
    heavy = upper.select(F.inline("edges"))
    # Bounded like the heavy nodes: only their edges' ends.
    parents = F.broadcast(heavy.select(F.col("conv_id").alias("above"), F.col("h1").alias("p1"), F.col("h2").alias("p2")))
    light = lower.select(F.inline("edges")).join(parents, ["p1", "p2"], "left")
    columns = ["conv_id", "n_convs", "top", "bottom", "cum", "n_children", "n_leaves", "below"]
    edges = light.select(*columns, F.when(F.col("outer"), F.col("above")).otherwise(F.col("parent_conv_id")).alias("parent"))
    edges = edges.union(heavy.select(*columns, F.when(~F.col("outer"), F.col("parent_conv_id")).alias("parent"))).withColumnRenamed("cum", "last_cum")
    ends = end_digests(rows.join(convs.select("conv_id", F.col("length").alias("pos")), ["conv_id", "pos"]))
    found = nodes.join(edges, ["conv_id", "n_convs"]).join(ends, ["pos", "h1", "h2"], "left")
    bottom = F.col("pos") == F.col("bottom")
    saved = F.col("below") + (F.col("n_convs") - 1) * (F.col("last_cum") - F.col("cum") + F.col("words"))
    parent = F.when(F.col("pos") == 0, F.lit(None)).when(F.col("pos") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", F.col("pos").alias("depth"), parent.cast("long").alias("parent_conv_id"), "n_convs", F.when(bottom, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    ranked = materialize(ranked_turns(digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return trie_nodes(*shared_beginnings(ranked))
