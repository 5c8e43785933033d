"""Evaluation: error statistics, coverage, skill, confusion, precision and recall, calibration, parameter choice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import digitize
from .scratch import if_small, settle


def error_measures(error: str) -> list[Column]:
    return [F.median(error).alias("median"), F.avg(error).alias("mean"), F.percentile(error, 0.9).alias("p90"), F.count(error).alias("n")]


#: Values of a group that one task may hold for its quantiles, and how far to both sides of a quantile (as a share of the values) the exact search begins.
FEW, ASIDE = 500_000, 0.004


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by, and for each name the exact quantile (column, p) between order statistics, as `percentile` gives it; by is never null.

    `percentile` gathers all values of a group in one task. Beyond FEW of them, sketches give two values that should have the quantile between them: those below are
    counted where they are, and only those between are sorted. Where the quantile turns out to lie elsewhere, it is sought between values farther apart. df is read
    several times: a settled table."""
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most <= FEW:
        return df.groupBy(*by).agg(*(F.percentile(c, p).alias(name) for name, (c, p) in wanted.items()))
    out = df.select(*by).distinct()
    for name, (c, p) in wanted.items():
        values, aside = df.where(F.col(c).isNotNull()).select(*by, F.col(c).cast("double").alias("_v")), ASIDE
        while True:
            least = F.percentile_approx("_v", p - aside) if p > aside else F.lit(-math.inf)
            largest = F.percentile_approx("_v", p + aside) if p + aside < 1 else F.lit(math.nan)  # beyond all numbers, in Spark's order
            ends = values.groupBy(*by).agg(F.count("*").alias("_n"), least.alias("_least"), largest.alias("_most"))
            ends = settle(ends.withColumn("_at", (F.col("_n") - 1) * F.lit(float(p))), "ends")
            near = values.join(if_small(ends), by)
            below = near.where("_v < _least").groupBy(*by).agg(F.count("*").alias("_below"))
            between = near.where("_v >= _least AND _v <= _most").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
            upto = between.withColumn("_upto", F.sum("_c").over(W.partitionBy(*by).orderBy("_v")))
            upto = ends.join(below, by, "left").join(upto, by, "left").withColumn("_upto", F.coalesce("_below", F.lit(0)) + F.col("_upto"))
            nth = lambda k: F.min(F.when(F.coalesce("_below", F.lit(0)) <= k, F.when(F.col("_upto") > k, F.col("_v"))))
            found = upto.groupBy(*by, "_at").agg(nth(F.floor("_at")).alias("_a"), nth(F.ceil("_at")).alias("_b"))
            found = settle(found, "quantile")
            if found.where("_a IS NULL OR _b IS NULL").isEmpty():
                break
            aside *= 8
        share = F.col("_at") - F.floor("_at")
        value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_a") + share * F.col("_b"))
        out = out.join(found.select(*by, value.alias(name)), by, "left")
    return out


def error_stats(df: DataFrame, by: list[str], error: str) -> DataFrame:
    return df.groupBy(*by).agg(*error_measures(error))


def coverage(df: DataFrame, by: list[str], inside: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(inside.cast("int")).alias("coverage"), F.count("*").alias("n"))


def skill(df: DataFrame, by: list[str], model: str, baseline: str) -> DataFrame:
    """1 - median model error / median baseline error; null where the baseline is 0."""
    return df.groupBy(*by).agg((1 - F.try_divide(F.median(model), F.median(baseline))).alias("skill"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def precision_recall(matrix: DataFrame) -> DataFrame:
    """By class of a confusion table (truth, predicted, n): precision, recall, f1, support; 0 where undefined. One pass over the table."""
    roles = F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(1).alias("t")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("t"))))
    long = matrix.select("n", (F.col("truth") == F.col("predicted")).alias("hit"), roles.alias("r"))
    by = long.groupBy(F.col("r.class").alias("class")).agg(
        F.sum(F.when(F.col("hit") & (F.col("r.t") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("r.t") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("r.t") == 0, F.col("n")).otherwise(0)).alias("chosen")
    )
    p, r = F.coalesce(F.try_divide("tp", "chosen"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return by.select("class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def binary_scores(df: DataFrame, truth: Column, predicted: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Precision, recall and F1 of a group of classes against the rest."""
    c = lambda x: F.count_if(x)
    out = df.groupBy(*by).agg(c(truth & predicted).alias("tp"), c(truth).alias("support"), c(predicted).alias("chosen"))
    p, r = F.coalesce(F.try_divide("tp", "chosen"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return out.select(*by, p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def worst_confusions(matrix: DataFrame, k: int, by: str = "truth") -> DataFrame:
    w = W.partitionBy(by).orderBy(F.desc("n"), "truth", "predicted")
    return matrix.where("truth <> predicted").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def reliability(df: DataFrame, p: str, y: str, bins: int = 10, by: list[str] = []) -> DataFrame:  # noqa: B006
    return df.groupBy(*by, digitize(F.col(p), bins).alias("bin")).agg(F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("observed"), F.count("*").alias("n"))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10, by: list[str] = []) -> DataFrame:  # noqa: B006
    """ece, brier, positives, n. Sums go up from the bins, so rows are read once."""
    y_ = F.col(y).cast("double")
    part = df.groupBy(*by, digitize(F.col(p), bins).alias("bin")).agg(F.sum(p).alias("sp"), F.sum(y_).alias("sy"), F.sum((F.col(p) - y_) * (F.col(p) - y_)).alias("sq"), F.count("*").alias("n"))
    return part.groupBy(*by).agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"), F.sum("sy").cast("long").alias("positives"), F.sum("n").alias("n"))


def best(df: DataFrame, score: Column, order: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The row with the smallest score, the first in order on ties (of each group)."""
    cols = [c for c in df.columns if c not in by]
    x = df.groupBy(*by).agg(F.min(F.struct(score.alias("_s"), F.col(order).alias("_o"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(cols)))).alias("b"))
    return x.select(*by, *(F.col(f"b._{i}").alias(c) for i, c in enumerate(cols)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    every = n.agg(F.sum("n").alias("_all"), F.count("*").alias("_classes"))
    return n.crossJoin(F.broadcast(every)).select(label, "n", (F.col("_all") / (F.col("_classes") * F.col("n"))).alias("weight"))  # every: one row


def class_cap(df: DataFrame, label: str, key: Column, most: int, seed: int = 42) -> DataFrame:
    """At most so many rows of each class, drawn by the key's hash. A count per class turns the cap into a hash threshold with some room, which
    thins large classes before the window ranks what is left of each."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    room = F.least(F.lit(1.0), (most + 10 * F.sqrt(F.lit(float(most))) + 100) / F.col("_n"))
    thin = df.join(n, label).withColumn("_draw", draw).where(F.col("_draw") < room * float(1 << 40))
    return thin.withColumn("_k", F.row_number().over(W.partitionBy(label).orderBy("_draw", key))).where(F.col("_k") <= most).drop("_n", "_draw", "_k")


def spectra(df: DataFrame, label: str, values: str) -> DataFrame:
    """(label, band, mean, n): the mean of each component of an array column by class."""
    return df.select(label, F.posexplode(values).alias("band", "_v")).groupBy(label, "band").agg(F.avg("_v").alias("mean"), F.count("*").alias("n"))


def parameter_grid(cases: DataFrame, parameters: DataFrame) -> DataFrame:
    """Every case with every parameter row; the grid is a short list given by the caller, broadcast after a count."""
    n = parameters.count()
    if n > 10_000:
        raise ValueError(f"{n} parameter rows")
    return cases.crossJoin(F.broadcast(parameters))
