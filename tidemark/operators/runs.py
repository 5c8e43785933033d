"""Runs and catalogues: summaries, index, history, briefing, and the choice of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tier_counts(spots: DataFrame, run: str) -> DataFrame:
    return spots.groupBy(run).agg(*(F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("High", "Medium", "Low")))


def summaries(spots: DataFrame, run: str, sensor: str, seen: str) -> DataFrame:
    """(run, hotspots, high, sensors): sensors joined by ' + ' in order of first sight. Sensors are aggregated before they are gathered."""
    by = spots.groupBy(run, sensor).agg(F.min(seen).alias("_first"), F.count("*").alias("_n"), F.count_if(F.col("tier") == "High").alias("_high"))
    return by.groupBy(run).agg(F.sum("_n").alias("hotspots"), F.sum("_high").alias("high"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", sensor))), lambda s: s[sensor]), " + ").alias("sensors"))


def index(runs: DataFrame, run: str) -> DataFrame:
    return runs.select(run).distinct().orderBy(F.desc(run))


def history(runs: DataFrame, run: str) -> DataFrame:
    """(run, earlier): how many runs are strictly before each. Ranks over the short list of distinct runs."""
    w = W.partitionBy(F.lit(1)).orderBy(run)  # one row per run
    return runs.select(run).distinct().withColumn("earlier", (F.row_number().over(w) - 1).cast("long"))


def briefing(spots: DataFrame, run: str, landfall: float = 30.0) -> DataFrame:
    """(run, attention, first_landfall, fastest, passes): counts and the extreme hotspots, the smallest id on ties."""
    first = F.min(F.when(F.col("risk_score") >= landfall, F.struct(F.col("risk_score").alias("s"), F.col("id").alias("i"))))
    last = F.min(F.struct((-F.col("risk_score")).alias("s"), F.col("id").alias("i")))
    return spots.groupBy(run).agg(F.count_if(F.col("tier") != "Low").alias("attention"), first["i"].alias("first_landfall"), last["i"].alias("fastest"), F.count_distinct(F.to_date("observed")).alias("passes"))


def search(items: DataFrame, days: int = 6, max_cloud: float = 20.0, most: int = 20) -> DataFrame:
    """Scenes within days and under the cloud limit: the first `most` by id, then in order of days and cloud. The cut comes before the order."""
    few = items.where((F.col("days") <= days) & (F.col("cloud") < max_cloud)).orderBy("id").limit(most)
    w = W.partitionBy(F.lit(1)).orderBy("days", F.coalesce("cloud", F.lit(100.0)), "id")  # of at most `most` rows
    return few.withColumn("place", F.row_number().over(w)).select("id", "days", "cloud", "place")


def rank_granules(granules: DataFrame, least: float = 0.05) -> DataFrame:
    """Granules by coverage times clear share; a missing cloud cover, and one of 0, count as 100."""
    cloud = F.when(F.coalesce("cloud", F.lit(0)) == 0, 100).otherwise(F.col("cloud"))
    return granules.where(F.col("coverage") > least).withColumn("score", F.col("coverage") * (1 - cloud / 100.0)).orderBy(F.desc("score"), "id")


def recent_granules(granules: DataFrame, begin, end, least: float = 0.15) -> DataFrame:
    return rank_granules(granules.where((F.col("start") >= begin) & (F.col("start") <= end) & (F.col("coverage") >= least)), 0.0)


def cut(granules: DataFrame, most: int, name: str = "name") -> DataFrame:
    """The first so many by name."""
    return granules.orderBy(name).limit(most)


def weather_source(day, today, late_days: int = 6):
    """Which endpoint holds a day: forecasts reach back so many days, an archive holds the rest."""
    return F.when(day >= F.date_sub(today, late_days), "forecast").otherwise("archive")
