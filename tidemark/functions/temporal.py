"""Times: truncation, local time, ages, run names, night intervals. Inputs are UTC without a zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Minutes that local time (IST) is ahead.
LOCAL_MINUTES = 330


def _local(t: Column) -> Column:
    return t.cast("timestamp_ntz") + F.expr(f"INTERVAL {LOCAL_MINUTES} MINUTE")


def ist(t: Column) -> Column:
    return F.date_format(_local(t), "dd MMM yyyy HH:mm")


def hours_between(a: Column, b: Column) -> Column:
    """Whole hours from a to b, rounded."""
    return F.floor((F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))) / 3600 + 0.5)


def live_run_id(t: Column) -> Column:
    return F.date_format(F.date_trunc("hour", t), "'live_'yyyyMMdd'_'HH'00'")


def run_label(run_id: Column) -> Column:
    """When a run was issued, from its name: live_yyyymmdd_hhmm, or a day in front."""
    stamp = F.regexp_extract(run_id, r"(\d{4}-?\d{2}-?\d{2})(?:_(\d{4}))?", 1)
    clock = F.regexp_extract(run_id, r"(\d{8})_(\d{4})", 2)
    return F.try_to_timestamp(F.concat(F.replace(stamp, F.lit("-"), F.lit("")), F.when(clock == "", "0000").otherwise(clock)), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")


def stream_number(year: Column) -> Column:
    return F.when(year >= 2011, 400).when(year >= 2001, 300).when(year >= 1992, 200).otherwise(100)


def granule_time(name: Column) -> Column:
    """The time that a granule's file name holds; null without one."""
    stamp = F.regexp_extract(name, r"\.(\d{8}T\d{6})\.", 1)
    return F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")


def night_bands(starts: DataFrame, key: str, start: str, hours: int, step_minutes: int = 15) -> DataFrame:
    """(key, starts, ends): runs of night (18:00 to 06:00 local) in steps from each start: gaps and islands."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(hours * 60 // step_minutes))).alias("k")
    t = starts.select(key, start, steps).select(key, (F.col(start) + F.make_dt_interval(mins=F.col("k") * step_minutes)).alias("t"), "k")
    h = F.hour(_local(F.col("t")))
    night = t.withColumn("night", (h >= 18) | (h < 6))
    w = W.partitionBy(key).orderBy("t")
    new = F.when(F.col("night") & ~F.coalesce(F.lag("night").over(w), F.lit(False)), 1).otherwise(0)
    marked = night.withColumn("new", new).withColumn("run", F.sum("new").over(w)).where("night")
    return marked.groupBy(key, "run").agg(F.min("t").alias("starts"), F.max("t").alias("ends")).drop("run")
