"""Run tables: write, list, read, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(hotspots: DataFrame, path: str, run_id: str) -> None:
    """Replace one run's partition and leave the others."""
    hotspots.withColumn("run_id", F.lit(run_id)).write.option("partitionOverwriteMode", "dynamic").partitionBy("run_id").mode("overwrite").parquet(path)


def run_index(spark: SparkSession, path: str) -> DataFrame:
    """Run ids, the latest name first: live runs sort before dated ones."""
    return spark.read.parquet(path).select("run_id").distinct().orderBy(F.desc("run_id"))


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def metrics(df: DataFrame, path: str) -> None:
    """A short table of metrics as one JSON document per row."""
    df.coalesce(1).write.mode("overwrite").json(path)
