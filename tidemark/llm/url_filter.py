"""URL filter: allow and block rules by host and path, and gradient-boosted trees on lexical features for the URLs that no rule fits.

DataFrame expressions and Spark's own GBTClassifier only. Labelled URLs are those that a rule fits (or a given label column); trees are fitted
on about `sample` rows, half of each label where there are as many, drawn row by row. The suffix statistics count all rows; a row's own fifth
of the hosts is left out of its suffix's rate, so that no label is seen through it.

Defined cases: a null URL or one without :// has an empty host and path, fits no rule, and is judged by the trees like any other; equal
URLs get equal verdicts; URLs of any length are whole; without labels of both kinds there is nothing to learn, and the verdict is the only
label's, or allow; an empty table gives an empty result; extra columns pass through, ones named like a
result (in any case) are replaced; a probability of one half is block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: (rule, verdict): a host, then a path's start.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: About so many labelled rows are fitted on.
SAMPLE = 20_000
TREES, DEPTH = 20, 4
#: Parts of the hosts, of which a row's own is left out of its suffix's rate.
FOLDS = 5
RESULTS = ("host", "path", "rule", "verdict", "p_block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching(rules=RULES) -> Column:
    """The longest rule that fits (host, path), as a struct of rule and verdict, else null. A rule fits its host and all subdomains."""

    def fits(rule: str) -> Column:
        at = rule.index("/")
        own = F.lit(rule[:at])
        return ((F.col("host") == own) | F.endswith(F.col("host"), F.concat(F.lit("."), own))) & F.startswith(F.col("path"), F.lit(rule[at:]))

    kind = "struct<rule:string,verdict:string>"
    ordered = sorted(rules, key=lambda x: (-len(x[0]), x[0]))
    return reduce(lambda rest, x: F.when(fits(x[0]), F.struct(F.lit(x[0]).alias("rule"), F.lit(x[1]).alias("verdict"))).otherwise(rest), reversed(ordered), F.lit(None).cast(kind))


def features() -> dict[str, Column]:
    """Lexical features of url, host and path; each is a double and never null."""
    url = F.coalesce(F.col("url"), F.lit(""))
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    n = F.length(url).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(url, c, F.lit("")))).cast("double"))
    entropy = F.when(n > 0, F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * F.log2(c)) / n).otherwise(0.0)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    segment = lambda k: F.coalesce(F.get(F.split("path", "/"), F.lit(k)), F.lit(""))
    share = lambda pattern, of: F.when(F.length(of) > 0, F.regexp_count(of, F.lit(pattern)) / F.length(of)).otherwise(0.0)
    own = {
        "length": n, "host_length": F.length("host"), "path_length": F.length("path"), "depth": F.regexp_count(F.col("path"), F.lit("/[^/]")), "labels": F.size(F.split("host", r"\.")),
        "digit_ratio": share("[0-9]", url), "path_digit_ratio": share("[0-9]", F.col("path")), "symbol_ratio": share("[^A-Za-z0-9]", url), "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.length(query), "fragment": F.contains(url, F.lit("#")).cast("int"), "secure": F.startswith(url, F.lit("https:")).cast("int"),
        "first_length": F.length(segment(1)), "next_length": F.length(segment(2)), "letters": share("[A-Za-z]", F.col("path")),
        "suffix_rate": F.col("suffix_rate"), "suffix_share": F.col("suffix_share"),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in own.items()}


def judge(pages: DataFrame, rules=RULES, label: str | None = None, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """pages with host, path, rule, verdict and p_block (the trees' probability). label: a column of 'allow' or 'block' to learn from, else the rules'."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = common.others(pages, RESULTS)
    given = F.col(label) if label else F.lit(None).cast("string")
    # the table's own columns go along as one, so no name of theirs meets one of ours
    base = pages.select(F.struct(*names).alias("own"), F.col("url").alias("url"), given.alias("given")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("match", matching(rules))
    kind = F.col("given") if label else F.col("match.verdict")
    base = base.withColumn("label", F.when(kind == "block", 1.0).when(kind == "allow", 0.0)).withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    # a row per suffix and fold, with counts over all pages
    counted = common.written(base.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")), "suffixes")
    total = counted.agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked"))).first()
    n, labelled, blocked = total.n or 0, total.labelled or 0, total.blocked or 0.0
    prior, every = (blocked + 1) / (labelled + 2), Window.partitionBy("suffix")
    elsewhere = lambda c: F.sum(c).over(every) - F.col(c)
    rate = (elsewhere("blocked") + prior * 10) / (elsewhere("labelled") + 10)
    stats = counted.select(F.col("suffix").alias("of"), F.col("fold").alias("of_fold"), rate.alias("suffix_rate"), (F.sum("n").over(every) / F.lit(max(n, 1))).alias("suffix_share"))
    stats = common.if_small(common.written(stats, "rates"))
    lexical = features()
    rows = base.join(stats, (F.col("suffix") == F.col("of")) & (F.col("fold") == F.col("of_fold")), "left").withColumns({f"f_{k}": v for k, v in lexical.items()})
    out = [*(F.col("own")[c].alias(c) for c in names), F.col("host"), F.col("path"), F.col("match.rule").alias("rule")]
    verdict = lambda trees: F.coalesce("match.verdict", trees)
    if blocked in (0.0, labelled):
        only = "block" if blocked and labelled else "allow"
        return rows.select(*out, verdict(F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("p_block"))
    half = lambda m: min(1.0, max(sample / 2, sample - (labelled - m)) / max(m, 1))
    part = F.when(F.col("label") == 1.0, half(blocked)).otherwise(half(labelled - blocked))
    learn = rows.where(F.col("label").isNotNull()).select("label", part.alias("part"), *(f"f_{k}" for k in lexical)).where(F.rand(11) < F.col("part")).drop("part")
    learn = common.written(learn, "labelled")
    to_vector = VectorAssembler(inputCols=[f"f_{k}" for k in lexical], outputCol="x")
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=3, checkpointInterval=-1).fit(to_vector.transform(learn))
    p = F.get(vector_to_array("probability"), F.lit(1))
    judged = model.setPredictionCol("prediction").setRawPredictionCol("raw").setProbabilityCol("probability").transform(to_vector.transform(rows))
    return judged.select(*out, verdict(F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("p_block"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "p_block")
