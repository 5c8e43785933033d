"""Plans that compose the operators: a replay or live run from scenes to ranked hotspots with routes, and a what-if forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata
from ..functions.numeric import rounded
from ..operators import decide, detect, drift, joins
from ..operators.field import Grid
from ..operators.scratch import settle


@dataclass
class Forcing:
    currents: Grid
    wind: Grid
    land: drift.Land | None = None


def detected(pixels: DataFrame, pixel_km: float, block: int, per_scene: int = 10, coast: DataFrame | None = None, rings=(), model=None) -> DataFrame:
    """The best hotspots of scenes: candidates, less the shore strip and inland water where a coast is given, less what a model (`classify.Bundle`) rejects
    where there is one. Pixels finer than 100 m are from the sensor that the model learnt on."""
    fine = pixel_km < 0.1
    found = settle(detect.candidates(pixels, block, every_band=model is not None), "candidates")
    if coast is not None:
        found = settle(detect.off_shore(found, coast, rings, refdata.SHORE_KM[fine]), "off shore")
    if model is not None:
        found = settle(detect.classified(found, model, same_sensor=fine), "accepted")
    return decide.top_hotspots(detect.hotspots(found, pixel_km, same_sensor=fine), per_scene)


def merged(hotspots: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Sightings of several passes as one: the newest of each place stays, with how often it recurred. near: their pairs within 15 km, where a stream has found them."""
    kept = joins.greedy_dedup(hotspots, ["-observed", "id"], near=near)
    passes = hotspots.select("observed").distinct().agg((F.count("*") - 1).alias("_n"))
    return kept.crossJoin(F.broadcast(passes)).withColumn("recurrence", rounded((F.col("seen") - 1) / F.greatest(F.lit(1), "_n"), 3)).drop("seen", "_n")  # passes: one row


def assessed(spark: SparkSession, hotspots: DataFrame, forcing: Forcing, coast: DataFrame | None, history: DataFrame | None, run_id: str, **kw) -> DataFrame:
    """Forecast, risk, tier, action and rank of hotspots (id, lat, lon, radius_km, confidence, start, ashore, age_h)."""
    seeds = hotspots.select("id", "lat", "lon", F.greatest(F.lit(0.5), "radius_km").alias("radius_km"), "start")
    fc = settle(drift.forecast(seeds, forcing.currents, forcing.wind, forcing.land, **kw), "forecast")
    sites = decide.site_proximity(fc.select("id", "track"), refdata.sites(spark))
    rest = hotspots.drop("lat", "lon", "radius_km", "start", "beached_fraction", "spread_km").join(fc, "id").join(sites, "id", "left")
    if coast is None:
        rest = rest.withColumn("coast_km", F.lit(1e9))
    else:
        points = fc.select("id", F.posexplode("track").alias("pos", "p")).select(F.struct("id", "pos").alias("id"), "p.lat", "p.lon")
        near = joins.nearest_point(points, coast).groupBy(F.col("id.id").alias("id")).agg(F.min("distance_km").alias("coast_km"))
        rest = rest.join(near, "id")
    rest = joins.persistence(rest, history, "run") if history is not None else rest.withColumn("persistence", F.lit(0.0))
    last = F.element_at("horizons", 48)
    day = F.element_at("horizons", 24)["mean"]
    mean = lambda c: F.aggregate("beach_points", F.lit(0.0), lambda s, p: s + p[c]) / F.nullif(F.size("beach_points"), F.lit(0))
    rest = rest.withColumns({"spread": last["flow_spread_km"], "p24_lat": day["lat"], "p24_lon": day["lon"], "beach_lat": mean("lat"), "beach_lon": mean("lon")})
    return decide.ranked(decide.score(rest).withColumn("run", F.lit(run_id)))


def live(spark: SparkSession, sightings: DataFrame, now: float, forcing: Forcing, coast: DataFrame | None = None, history: DataFrame | None = None, run_id: str = "live", lookback_days: int = 3, near: DataFrame | None = None, **kw) -> DataFrame:
    """A run as of `now` (epoch seconds): sightings (id, lat, lon, radius_km, confidence, observed in epoch seconds) of the look-back are merged,
    moved to now, forecast and ranked. The same now and inputs give the same run. near: the sightings' pairs within 15 km, where a stream has found them."""
    recent = sightings.where((F.col("observed") <= now) & (F.col("observed") > now - lookback_days * 86_400))
    kept = settle(merged(recent, near).orderBy(F.desc("confidence"), "id").limit(refdata.MAX_HOTSPOTS), "merged")
    moved = settle(drift.nowcast(kept, now, forcing.currents, forcing.wind, forcing.land, **kw).withColumn("start", F.lit(float(now))), "nowcast")
    return assessed(spark, moved, forcing, coast, history, run_id, **kw)


def replay(spark: SparkSession, hotspots: DataFrame, forcing: Forcing, coast: DataFrame | None = None, history: DataFrame | None = None, run_id: str = "replay", **kw) -> DataFrame:
    """A run from its own observation times, with history of strictly earlier runs."""
    return assessed(spark, hotspots.withColumn("start", F.col("observed")).withColumn("ashore", F.lit(False)).withColumn("age_h", F.lit(0)), forcing, coast, history, run_id, **kw)


def what_if(spark: SparkSession, lat: float, lon: float, start: float, forcing: Forcing, confidence: float = 0.6, **kw) -> DataFrame:
    """A forecast from a point of the region, checked like a request: inside the box, at sea, confidence between 0 and 1."""
    import numpy as np

    r = refdata.REGION
    if not (r["lat_min"] <= lat <= r["lat_max"] and r["lon_min"] <= lon <= r["lon_max"]):
        raise ValueError("the point is outside the region")
    if not 0 <= confidence <= 1:
        raise ValueError("confidence is from 0 to 1")
    if forcing.land is not None and forcing.land(np.array([lat]), np.array([lon]))[0]:
        raise ValueError("the point is on land")
    one = spark.createDataFrame([("WHAT-IF", lat, lon, 2.0, confidence, start, False, 0)], "id string, lat double, lon double, radius_km double, confidence double, start double, ashore boolean, age_h int")
    return assessed(spark, one, forcing, None, None, "what-if", **kw)
