"""URL filter: rules first, then a character language-model ratio. Built-in functions only.

Two smoothed Markov models over characters are trained, one on the urls that a
rule accepts and one on those that a rule rejects. Their order varies: a
character's probability after two characters leans on that after one, and that
on the character alone, the more so the rarer the longer context is. A url's
score is the mean over its characters of the log-likelihood difference; the
least score that is accepted is calibrated on labelled urls that were not
trained on. The alphabet is fixed, so the model is a table of ``len(ALPHABET)
** 3`` rows whatever the data, which is what may be broadcast.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged by the model (a null one as an empty text); repeated
rows are judged each by itself and trained on once; without accepted or rejected
urls all scores are near 0 and the limit is 0; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rules of the registered query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digits count as 0, anything else that is missing here as ~; ^ pads the front and $ ends a url.
ALPHABET = LOWER + "0/:.?=&%_-#+,@~^$"
#: Weight of the shorter context, in characters seen.
LEAN = 4.0
#: Labelled urls with one of these first hex digits of their MD5 are kept for calibration.
HELD_OUT = ("0", "1", "2")


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules, host: Column, path: Column) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def model_text(url: Column) -> Column:
    """What the models read: the url after its scheme, in the alphabet, padded."""
    rest = F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), "^[^:/?#]*://", ""), UPPER + "0123456789", LOWER + "0" * 10)
    return F.concat(F.lit("^^"), F.regexp_replace(rest, "[^a-z0/:.?=&%_#+,@~-]", "~"), F.lit("$"))


def grams(texts: DataFrame) -> DataFrame:
    """A row for each character of each text, with the two before it."""
    return texts.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("text") - 2), lambda i: F.substring("text", i, F.lit(3)))))


def ratio_model(labelled: DataFrame) -> DataFrame:
    """(gram, delta): log-likelihood difference of each gram's last character, in millionths."""
    seen = grams(labelled).groupBy("gram").agg(*[F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")])
    a = len(ALPHABET)
    letter = lambda k: F.substring(F.lit(ALPHABET), (F.floor(F.col("id") / a**k) % a).cast("int") + 1, F.lit(1))
    every = labelled.sparkSession.range(a**3).select(F.concat(letter(2), letter(1), letter(0)).alias("gram"))
    table = every.join(seen, "gram", "left").na.fill(0).select("*", *[F.substring("gram", s, n).alias(k) for k, s, n in (("pair", 1, 2), ("last2", 2, 2), ("mid", 2, 1), ("last", 3, 1))])
    total = table.agg(*[F.sum(v).alias(v) for v in ("allow", "block")])
    over = lambda v, k: F.sum(v).over(Window.partitionBy(k))
    log = {}
    for v in ("allow", "block"):
        p1 = (over(v, "last") + 1) / (total.select(v).scalar() + a)
        p2 = (over(v, "last2") + LEAN * p1) / (over(v, "mid") + LEAN)
        log[v] = F.log((F.col(v) + LEAN * p2) / (over(v, "pair") + LEAN))
    return table.select("gram", F.round((log["allow"] - log["block"]) * 1e6).cast("long").alias("delta"))


def scores(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(text, score) of distinct texts. The model's size is fixed by the alphabet, so it is broadcast."""
    return grams(texts).join(F.broadcast(model), "gram").groupBy("text").agg((F.sum("delta") / F.count("*") / 1e6).alias("score"))


def limit(labelled_scores: DataFrame) -> DataFrame:
    """One row: the score from which most accepted and fewest rejected urls lie (balanced accuracy), halfway to the next lower score seen."""
    bins = labelled_scores.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(*[F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")])
    above = Window.orderBy(F.desc("bin"))  # a few hundred bins, whatever the data
    total = bins.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    gain = F.sum("allow").over(above) * F.greatest(total.select("block").scalar(), F.lit(1)) - F.sum("block").over(above) * F.greatest(total.select("allow").scalar(), F.lit(1))
    middle = (F.col("bin") + F.coalesce(F.lead("bin").over(above), F.col("bin"))) / 200
    return bins.select("bin", gain.alias("gain"), middle.alias("limit")).orderBy(F.desc("gain"), F.abs("bin"), "bin").limit(1).select("limit")


def filter_urls(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    parsed = pages.select(F.col(page_id).cast("long").alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), model_text(F.col(url)).alias("text"))
    parsed = parsed.withColumn("found", longest_rule(rules, F.col("host"), F.col("path")))
    labelled = parsed.where("found is not null").select("text", F.col("found.verdict").alias("verdict")).distinct()
    held_out = F.substring(F.md5("text"), 1, 1).isin(*HELD_OUT)
    model = ratio_model(labelled.where(~held_out))
    scored = scores(parsed.select("text").distinct(), model)
    least = limit(labelled.where(held_out).join(scored, "text"))
    judged = F.when(F.col("score") >= F.coalesce(least.scalar(), F.lit(0.0)), "allow").otherwise("block")
    return parsed.join(scored, "text").select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", judged).alias("verdict"), "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    cases = "\n".join(
        f"             WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}') THEN '{rule}:{verdict}'"
        for verdict, rule in sorted(RULES, key=lambda x: -len(x[1]))
        for own, _, rest in [rule.partition("/")]
    )
    a = len(ALPHABET)
    return rf"""
WITH parsed AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
           '^^' || regexp_replace(translate(regexp_replace(coalesce(url, ''), '^[^:/?#]*://', ''), '{UPPER}0123456789', '{LOWER}0000000000'), '[^a-z0/:.?=&%_#+,@~-]', '~', 'g') || '$' AS text
    FROM pages
), ruled AS (
    SELECT *, CASE
{cases}
             END AS found
    FROM parsed
), labelled AS (
    SELECT DISTINCT text, split_part(found, ':', 2) AS verdict, substr(md5(text), 1, 1) IN {HELD_OUT} AS held_out FROM ruled WHERE found IS NOT NULL
), train AS (
    SELECT verdict, substr(text, pos, 3) AS gram FROM (SELECT verdict, text, unnest(range(1, length(text) - 1)) AS pos FROM labelled WHERE NOT held_out)
), seen AS (
    SELECT gram, count(*) FILTER (WHERE verdict = 'allow') AS allow, count(*) FILTER (WHERE verdict = 'block') AS block FROM train GROUP BY gram
), letters AS (
    SELECT substr('{ALPHABET}', i, 1) AS c FROM (SELECT unnest(range(1, {a + 1})) AS i)
), full_table AS (
    SELECT x.c || y.c || z.c AS gram, x.c || y.c AS pair, y.c || z.c AS last2, y.c AS mid, z.c AS last, coalesce(allow, 0) AS allow, coalesce(block, 0) AS block
    FROM letters x, letters y, letters z LEFT JOIN seen ON seen.gram = x.c || y.c || z.c
), sums AS (
    SELECT *, sum(allow) OVER (PARTITION BY last) AS a1, sum(block) OVER (PARTITION BY last) AS b1, sum(allow) OVER (PARTITION BY last2) AS a2, sum(block) OVER (PARTITION BY last2) AS b2,
           sum(allow) OVER (PARTITION BY mid) AS am, sum(block) OVER (PARTITION BY mid) AS bm, sum(allow) OVER (PARTITION BY pair) AS ap, sum(block) OVER (PARTITION BY pair) AS bp,
           sum(allow) OVER () AS an, sum(block) OVER () AS bn
    FROM full_table
), model AS (
    SELECT gram, CAST(round((ln((allow + {LEAN}e0 * ((a2 + {LEAN}e0 * ((a1 + 1) / (an + {a}e0))) / (am + {LEAN}e0))) / (ap + {LEAN}e0))
                      - ln((block + {LEAN}e0 * ((b2 + {LEAN}e0 * ((b1 + 1) / (bn + {a}e0))) / (bm + {LEAN}e0))) / (bp + {LEAN}e0))) * 1e6) AS BIGINT) AS delta
    FROM sums
), scored AS (
    SELECT text, sum(delta) / count(*) / 1e6 AS score
    FROM (SELECT text, substr(text, pos, 3) AS gram FROM (SELECT text, unnest(range(1, length(text) - 1)) AS pos FROM (SELECT DISTINCT text FROM ruled))) JOIN model USING (gram)
    GROUP BY text
), bins AS (
    SELECT floor(score * 100) AS bin, count(*) FILTER (WHERE verdict = 'allow') AS allow, count(*) FILTER (WHERE verdict = 'block') AS block
    FROM labelled JOIN scored USING (text) WHERE held_out GROUP BY 1
), gains AS (
    SELECT bin, sum(allow) OVER w * greatest((SELECT sum(block) FROM bins), 1) - sum(block) OVER w * greatest((SELECT sum(allow) FROM bins), 1) AS gain, (bin + coalesce(lead(bin) OVER w, bin)) / 200 AS lim FROM bins WINDOW w AS (ORDER BY bin DESC)
), least AS (
    SELECT lim FROM gains ORDER BY gain DESC, abs(bin), bin LIMIT 1
)
SELECT page_id, host, path, nullif(split_part(found, ':', 1), '') AS rule,
       coalesce(nullif(split_part(found, ':', 2), ''), CASE WHEN score >= coalesce((SELECT lim FROM least), 0) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scored USING (text)
"""


OP1_SQL = _sql()
