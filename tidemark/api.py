"""The serving surface as functions: each returns a DataFrame or plain values that a server can send as JSON."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import refdata
from .operators import decide, runs
from .sources import runs as store


def health() -> dict:
    return {"status": "ok"}


def _documents(df: DataFrame, most: int = 10_000) -> list[str]:
    """The rows as JSON; a table that no answer should hold is refused."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs, latest name first, with hotspots and how many are High."""
    spots = spark.read.parquet(path)
    return runs.summaries(spots, "run_id", "sensor", "observed").orderBy(F.desc("run_id"))


def run(spark: SparkSession, path: str, run_id: str) -> list[str]:
    return _documents(store.read_run(spark, path, run_id).orderBy("rank"))


def run_file(folder: str, name: str) -> str:
    """The path of a file of a run; names that lead out of its folder are refused."""
    root = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(root, name))
    if os.path.commonpath([root, path]) != root:
        raise ValueError("the file is outside the run's folder")
    return path


def metrics(spark: SparkSession, path: str) -> list[str]:
    return _documents(store.read_json(spark, path))


def ports() -> list[dict]:
    return [{"name": n, "lat": a, "lon": b} for n, a, b in refdata.PORTS]


def route(spark: SparkSession, path: str, run_id: str, port: str, land=None, **kw) -> DataFrame:
    """The route of a run from one port; unknown ports are refused."""
    chosen = tuple(p for p in refdata.PORTS if p[0] == port)
    if not chosen:
        raise ValueError(f"unknown port {port}")
    return decide.routes(store.read_run(spark, path, run_id), land, chosen, **kw)


def forecast(spark: SparkSession, lat: float, lon: float, start: float, forcing, confidence: float = 0.6, **kw) -> DataFrame:
    from .plans.pipeline import what_if

    return what_if(spark, lat, lon, start, forcing, confidence, **kw)
