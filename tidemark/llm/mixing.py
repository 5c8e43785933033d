"""Mixing sources to target weights.

Tokens are summed per source, targets are shared by weight, and each document is emitted floor(rate) times plus once more with
probability rate - floor(rate), by a draw that depends on the document's id and the seed only, so reruns agree.

Documents differ so much in size that independent draws can end far from a target. Draws are therefore compared with the source's own
threshold: of the draws' `BINS` bins, the one up to which the source's words come nearest to the fraction. It lies at the fraction on average. Where even that
one is farther than `CLOSE` from the target, as in sources of few documents, one of the two bins around it is taken by a draw on seed and source, with the chance that
makes the expected words the target: over seeds each document's extra copy then comes as often as the fraction says, however small its source.

Defined cases: a null or empty text has size 0 and follows its source's rate like any other; a null source is a source of its
own, last in order; rows of a source that share a doc_id share one draw (repeated rows are all kept or all left out); of bins that come
equally near the first is taken; a source without words has target 0 and rate 0; an empty table gives an empty mix; extra columns pass
through, ones named like a result (size, source_size, target, copies, in any case) are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BINS = 4096
#: Share of its target within which a source's words are as near as is asked for.
CLOSE = 0.05
RESULTS = ("size", "source_size", "target", "copies")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size). The weights repeat over the sources in order of code points, null last.

    Weights share the sum of all sizes; no target passes `most` times its source's size, and what that frees is shared anew by
    weight. That is one pass over the sources in order of size to weight: a source is at its bound while its bound is at most its share
    of what the sources before it have left. The order is over a row per source; beyond MOST_SOURCES of them it is refused."""
    scale = 1
    for w in set(weights):
        scale *= w
    total = common.written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n = total.count()
    if n > MOST_SOURCES:
        raise ValueError(f"{n} sources, more than {MOST_SOURCES}: weights are given by a source's place in order")
    pick = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return total.sparkSession.sql(SHARES.format(table="{sources}", n=len(weights), pick=pick, scale=scale, most=most), sources=total)


#: A source's weight is its place in the order of all: a table of so many rows is ordered in one task.
MOST_SOURCES = 1_000_000
SHARES = """
WITH o AS (SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM {table}),
w AS (SELECT source, source_size, k, CASE k % {n} {pick} END AS weight FROM o),
r AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights,
    coalesce(sum(source_size) OVER before, 0) AS size_before, coalesce(sum(weight) OVER before, 0) AS weight_before
  FROM (SELECT *, source_size * {scale} / weight AS ratio FROM w) z
  WINDOW before AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, CAST({most} * source_size AS double) * (all_weights - weight_before) <= CAST(total - {most} * size_before AS double) * weight AS bound FROM r),
l AS (SELECT CAST(max(total) - coalesce(sum(CASE WHEN bound THEN {most} * source_size END), 0) AS double) AS rest,
    CAST(max(all_weights) - coalesce(sum(CASE WHEN bound THEN weight END), 0) AS double) AS rest_weight FROM b)
SELECT source, CAST(source_size AS bigint) AS source_size,
  CASE WHEN bound THEN CAST({most} * source_size AS double) ELSE rest / rest_weight * weight END AS target FROM b CROSS JOIN l
"""


def rate_of(most: int) -> Column:
    return F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)


def thresholds(binned: DataFrame, shares: DataFrame, most: int = MOST_REPEATS, seed: int = 17) -> DataFrame:
    """shares with upto: the draws below this bin take their one copy more. binned: (source, bin, size); sizes are summed by bin before they meet,
    so a source of any number of documents is BINS rows."""
    sums = binned.where("size > 0").groupBy("source", "bin").agg(F.sum("size").alias("size")).withColumnRenamed("source", "_of")
    upward = Window.partitionBy("source").orderBy("bin")
    wanted = (F.col("rate") - F.floor("rate")) * F.col("source_size")
    at = shares.withColumn("rate", rate_of(most)).join(sums, common.same(F.col("source"), F.col("_of"))).withColumn("sum", F.sum("size").over(upward)).withColumn("wanted", wanted)
    side = F.struct("sum", (F.col("bin") + 1).alias("upto"))
    both = at.groupBy("source").agg(F.any_value("wanted").alias("wanted"), F.any_value("target").alias("_target"), F.max(F.when(F.col("sum") <= F.col("wanted"), side)).alias("lo"), F.min(F.when(F.col("sum") > F.col("wanted"), side)).alias("hi"))
    lo, low = F.coalesce("lo.sum", F.lit(0)), F.coalesce("lo.upto", F.lit(0))
    under, over = F.col("wanted") - lo, F.col("hi.sum") - F.col("wanted")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:source:"), F.coalesce("source", F.lit("")))), 1, 12), 16, 10).cast("double") / 2.0**48
    near = F.when(under <= over, low).otherwise(F.col("hi.upto"))
    drawn = F.when(draw < under / (F.col("hi.sum") - lo), F.col("hi.upto")).otherwise(low)
    chosen = F.when(F.col("hi").isNull(), low).when(F.least(under, over) <= CLOSE * F.col("_target"), near).otherwise(drawn)
    best = both.select(F.col("source").alias("_of"), chosen.cast("int").alias("upto"))
    return shares.join(best, common.same(F.col("source"), F.col("_of")), "left").select("source", "source_size", "target", F.coalesce("upto", F.lit(0)).alias("upto"))


def bin_of(doc_id: Column, seed: int) -> Column:
    """The bin of a document's draw, from the first bits of a digest of seed and id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 3), 16, 10).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 17, size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the row).

    Sizes alone are summed; the table of sources is broadcast if its counted rows allow, else joined by shuffle: texts stay where they are."""
    own = common.others(docs, RESULTS)
    words = n_words(F.col("text")) if size is None else size
    narrow = common.written(docs.select("source", words.alias("size"), bin_of(F.col("doc_id"), seed).alias("bin")), "draws")
    shares = common.written(targets(narrow, weights, most), "shares")
    shares = common.written(thresholds(narrow, shares, most, seed), "thresholds")
    of, upto = common.free_names(docs, "_share_of", "upto")
    shares = shares.select(F.col("source").alias(of), "source_size", "target", F.col("upto").alias(upto))
    copies = F.floor(rate_of(most)) + (bin_of(F.col("doc_id"), seed) < F.col(upto)).cast("int")
    joined = docs.select(*own, words.alias("size")).join(common.if_small(shares), common.same(F.col("source"), F.col(of)), "left")
    return joined.select(*own, "size", "source_size", "target", copies.cast("long").alias("copies"))


def repeated(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: the rows of docs, with all of its columns, each as often as it is taken."""
    clash = [c for c in docs.columns if c not in common.others(docs, RESULTS)]
    aside = common.free_names(docs, *(f"_own_{c}" for c in clash))
    mixed = mix(docs.withColumnsRenamed(dict(zip(clash, aside))), **kw)
    (at,) = common.free_names(mixed, "_copy")
    taken = mixed.where("copies > 0").withColumn(at, F.explode(F.expr("sequence(1, copies)")))
    back = dict(zip(clash, aside))
    return taken.select(*(F.col(back.get(c, c)).alias(c) for c in docs.columns))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mix(common.written(docs, "sizes"), size=F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


_N = r"coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)"
OP2_SQL = (
    f"WITH d AS (SELECT doc_id, source, CAST({_N} AS bigint) AS size, CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS varchar), '')), 1, 3) AS int) AS bin FROM documents), g AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source), t AS ("
    + SHARES.format(table="g", n=3, pick="WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 1", scale=10, most=3)
    + """), u AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM t),
  s AS (SELECT source, bin, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS upward FROM d WHERE size > 0 GROUP BY source, bin),
  e AS (SELECT u.source, any_value((rate - floor(rate)) * source_size) AS wanted, any_value(target) AS target, max(CASE WHEN upward <= (rate - floor(rate)) * source_size THEN {'s': upward, 'u': bin + 1} END) AS lo,
    min(CASE WHEN upward > (rate - floor(rate)) * source_size THEN {'s': upward, 'u': bin + 1} END) AS hi FROM u JOIN s ON u.source IS NOT DISTINCT FROM s.source GROUP BY u.source),
  f AS (SELECT source, target, coalesce(lo.u, 0) AS low, hi.u AS high, wanted - coalesce(lo.s, 0) AS under, hi.s - wanted AS over_, hi.s - coalesce(lo.s, 0) AS wide,
    CAST(CAST('0x' || substr(md5('17:source:' || coalesce(source, '')), 1, 12) AS bigint) AS double) / 281474976710656 AS draw FROM e),
  b AS (SELECT source, CASE WHEN high IS NULL THEN low WHEN least(under, over_) <= 0.05::double * target THEN CASE WHEN under <= over_ THEN low ELSE high END WHEN draw < under / wide THEN high ELSE low END AS upto FROM f),
  c AS (SELECT d.*, u.source_size, u.target, CAST(floor(rate) + CASE WHEN bin < coalesce(upto, 0) THEN 1 ELSE 0 END AS bigint) AS copies
    FROM d LEFT JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM c"""
)
