"""Quality rules with thresholds learnt from the data of each language and source.

Every document gets integer measures. A mergeable quantile sketch (a histogram
with integer, logarithmically growing buckets: counts simply add up, in any
order, to the same sketch) of each measure gives the usual range for each
(language, source); a document far outside it is rejected. Both limits stand off
the median by the width of the lower half alone, so junk, which lies above, can't
widen the limit that is to stop it while it is fewer than half. Sketches of small
groups are too coarse, so they fall back on the language's, then on all data's
sketch, which are merges of the same counts.

Defined cases: texts of any length are measured as a whole; a null text has no words and fails the base rule; null language
or source is a group of its own; repeated rows count and are judged each by
itself; other columns, whatever their names, pass through ``quality_filter``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import as_bytes, map_texts, materialize

# The base rule.
WINDOW_WORDS = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Name, value from the measures (integer), least width in the same unit, sides judged.
RULES = {
    "word_length": ("word_chars * 100 DIV greatest(n_words, 1)", 150, "both"),
    "symbol_rate": ("n_symbols * 1000 DIV greatest(n_words, 1)", 50, "upper"),
    "dup_line_rate": ("n_dup_lines * 1000 DIV greatest(n_lines, 1)", 400, "upper"),
    "repeat_rate": ("n_repeat_words * 1000 DIV greatest(n_words, 1)", 200, "upper"),
}
#: Documents that a sketch must hold to be used for its own group.
LEAST_DOCS = 100
#: How far a value may lie from the median, in widths (low quantile to median).
REACH = 5
LOW, MIDDLE = 0.1, 0.5

_DROPPED = bytes(set(range(256)) - set(SYMBOLS))
_CONTINUATION = bytes(range(0x80, 0xC0))


def text_measures(text: bytes) -> tuple[int, ...]:
    """MEASURES of one whole text, in UTF-8."""
    words = text.split()  # bytes split at the six ASCII white-space characters only
    n = len(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > WINDOW_WORDS:
        flat = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[: n - WINDOW_WORDS])]
        windows = [flat[s:e] for s, e in zip(starts, ends[WINDOW_WORDS - 1 :])]
        if len(set(windows)) < len(windows):
            seen: set[bytes] = set()
            twice = {w for w in windows if w in seen or seen.add(w)}
            covered = 0  # words before this one are counted
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + WINDOW_WORDS - max(covered, i)
                    covered = i + WINDOW_WORDS
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= len(text) - len(text.translate(None, _CONTINUATION))
    return n, chars, len(text.translate(None, _DROPPED)), len(lines) - len(set(lines)), repeated, len(lines)


def add_measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and a struct ``_measures`` of long values."""
    keep = docs.columns if keep is None else keep
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [dict(zip(MEASURES, text_measures(x))) for x in as_bytes(batch.column(len(keep)))]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, kind)], [*keep, "_measures"])

        return each

    measures = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    schema = T.StructType([*picked.schema.fields[: len(keep)], T.StructField("_measures", measures)])
    return map_texts(picked, make, schema, "_text")


def base_failed(m: str = "_measures") -> Column:
    return (F.col(f"{m}.n_words") < LEAST_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MOST_REPEATED_PERCENT * F.col(f"{m}.n_words"))


def rule_value(name: str, m: str = "_measures") -> Column:
    return F.expr(re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"{m}.\1", RULES[name][0]))


def bucket(value: Column) -> Column:
    """Number of a value's bucket: exact below 64, then 32 buckets for each doubling."""
    shift = F.greatest(F.lit(0), F.length(F.conv(value.cast("string"), 10, 2)) - 6)
    return shift * 32 + F.call_function("shiftright", value, shift.cast("int"))


def bucket_value(number: Column) -> Column:
    """Least value of a bucket, the inverse of ``bucket``."""
    shift = F.greatest(F.lit(0), F.floor(number / 32).cast("int") - 1)
    return F.call_function("shiftleft", number - shift * 32, shift)


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rule, low, high) from all documents that pass the base rule.

    The counts are aggregated before the shuffle: what moves is a row for each
    occupied bucket, however many documents a source has.
    """
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), rule_value(r).cast("long").alias("v")) for r in RULES]))
    counts = measured.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), values.alias("x")).groupBy("lang", "source", "x.rule", bucket(F.col("x.v")).cast("long").alias("b")).agg(F.count("*").alias("n"))
    counts = materialize(counts)  # small: a row for each occupied bucket

    def ranges(keys: list[str]) -> DataFrame:
        merged = counts.groupBy(*keys, "rule", "b").agg(F.sum("n").alias("n"))
        at = Window.partitionBy(*keys, "rule")
        ranked = merged.withColumn("total", F.sum("n").over(at)).withColumn("up_to", F.sum("n").over(at.orderBy("b")))
        q = lambda p: F.min(F.when(F.col("up_to") >= F.ceil(F.col("total") * p), bucket_value(F.col("b"))))
        found = ranked.groupBy(*keys, "rule").agg(F.max("total").alias("total"), q(LOW).alias("lo"), q(MIDDLE).alias("mid"))
        least = F.create_map(*[F.lit(x) for r, v in RULES.items() for x in (r, v[1])])[F.col("rule")].cast("long")
        sides = F.create_map(*[F.lit(x) for r, v in RULES.items() for x in (r, v[2])])[F.col("rule")]
        reach = REACH * (F.col("mid") - F.col("lo")) + least
        low = F.when(sides == "both", F.col("mid") - reach)
        return found.select(*keys, "rule", "total", F.struct(low.alias("low"), (F.col("mid") + reach).alias("high")).alias("range"))

    own, by_lang, overall = ranges(["lang", "source"]), ranges(["lang"]).withColumnRenamed("range", "lang_range").withColumnRenamed("total", "lang_total"), ranges([]).withColumnRenamed("range", "all_range").drop("total")
    same_lang = own["lang"].eqNullSafe(by_lang["lang"]) & (own["rule"] == by_lang["rule"])
    picked = own.join(by_lang, same_lang, "left").drop(by_lang["lang"]).drop(by_lang["rule"]).join(overall, "rule", "left")
    choice = F.when(F.col("total") >= LEAST_DOCS, F.col("range")).when(F.col("lang_total") >= LEAST_DOCS, F.col("lang_range")).otherwise(F.col("all_range"))
    return picked.select("lang", "source", "rule", choice["low"].alias("low"), choice["high"].alias("high"))


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with ``_kept``. ``limits`` is small, so it is pivoted and joined; Spark broadcasts it by its size."""
    wide = limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, F.col(side))).alias(f"_{r}_{side}") for r in RULES for side in ("low", "high")])
    wide = materialize(wide.withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    fits = F.lit(True)
    for r in RULES:
        v = rule_value(r)
        fits &= F.coalesce(v >= F.col(f"_{r}_low"), F.lit(True)) & F.coalesce(v <= F.col(f"_{r}_high"), F.lit(True))
    joined = measured.join(wide, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    return joined.withColumn("_kept", ~base_failed() & fits).drop(*wide.columns)


def quality_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, the measures, base_failed, kept), a row for each row of ``docs``."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    measured = materialize(add_measures(keyed, "text", ["doc_id", "lang", "source"]))
    judged = judge(measured, thresholds(measured))
    return judged.select("doc_id", "_measures.*", base_failed().alias("base_failed"), F.col("_kept").alias("kept"))


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    Measures are cheap beside a shuffle of whole texts, so they are made twice:
    once for the sketches and once beside the text that is filtered.
    """
    keyed = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    limits = thresholds(add_measures(keyed, "text", ["lang", "source"]))
    judged = judge(add_measures(docs, text), limits, lang, source)
    return judged.where("_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Per document: the measures, the base rule's verdict and the method's."""
    return quality_table(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def _sql() -> str:
    def value(rule: str) -> str:
        return RULES[rule][0].replace("DIV", "//")

    values = "\n        UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {value(r)} AS v FROM measured WHERE NOT base_failed" for r in RULES)
    least = " ".join(f"WHEN '{r}' THEN {v[1]}" for r, v in RULES.items())
    both = ", ".join(f"'{r}'" for r, v in RULES.items() if v[2] == "both")
    fits = " AND ".join(f"coalesce({value(r)} >= (SELECT low FROM limits t WHERE t.lang IS NOT DISTINCT FROM m.lang AND t.source IS NOT DISTINCT FROM m.source AND rule = '{r}'), true) AND coalesce({value(r)} <= (SELECT high FROM limits t WHERE t.lang IS NOT DISTINCT FROM m.lang AND t.source IS NOT DISTINCT FROM m.source AND rule = '{r}'), true)" for r in RULES)

    def ranges(keys: str) -> str:
        by = f"{keys}, rule" if keys else "rule"
        q = lambda p: f"min(v) FILTER (WHERE up_to >= ceil(total * {p}e0))"
        reach = f"({REACH} * ({q(MIDDLE)} - {q(LOW)}) + CASE rule {least} END)"
        return f"""SELECT {by}, max(total) AS total, CASE WHEN rule IN ({both}) THEN {q(MIDDLE)} - {reach} END AS low, {q(MIDDLE)} + {reach} AS high
        FROM (SELECT {by}, CASE WHEN b < 64 THEN b ELSE (b - (b // 32 - 1) * 32) << (b // 32 - 1) END AS v, sum(n) OVER (PARTITION BY {by}) AS total, sum(n) OVER (PARTITION BY {by} ORDER BY b) AS up_to
              FROM (SELECT {by}, b, sum(n) AS n FROM counts GROUP BY {by}, b)) GROUP BY {by}"""

    return rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), split AS (
    SELECT *, regexp_extract_all(t, '[^ \x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS lines FROM docs
), windows AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i:i + 4], ' ')) AS seen
    FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5)
), repeats AS (
    SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS place FROM windows WHERE seen > 1) GROUP BY rid
), plain AS (
    SELECT rid, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(t, '[ \x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, len(lines) AS n_lines
    FROM split LEFT JOIN repeats USING (rid)
), measured AS (
    SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM plain
), counts AS (
    SELECT lang, source, rule, greatest(0, length(bin(v)) - 6) * 32 + (v >> greatest(0, length(bin(v)) - 6)) AS b, count(*) AS n
    FROM (
        {values}
    ) GROUP BY ALL
), own AS ({ranges("lang, source")}),
by_lang AS ({ranges("lang")}),
overall AS ({ranges("")}),
limits AS (
    SELECT o.lang, o.source, o.rule, CASE WHEN o.total >= {LEAST_DOCS} THEN o.low WHEN l.total >= {LEAST_DOCS} THEN l.low ELSE a.low END AS low,
           CASE WHEN o.total >= {LEAST_DOCS} THEN o.high WHEN l.total >= {LEAST_DOCS} THEN l.high ELSE a.high END AS high
    FROM own o LEFT JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule LEFT JOIN overall a ON o.rule = a.rule
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fits} AS kept, n_lines FROM measured m
"""


OP6_SQL = _sql()
