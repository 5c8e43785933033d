"""Readers: drifter tracks, point forecasts, swath cubes, labelled patches, coastlines, runs. Paths go to Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..operators.classify import annotator_weight
from ..operators.field import from_direction


def drifters(spark: SparkSession, path: str) -> DataFrame:
    """Tracks from CSV: the row of units after the header goes (its position is no number), so do rows without a place; times are parsed, and a
    drogue date that can't be is null."""
    raw = spark.read.csv(path, header=True, schema="ID string, time string, latitude string, longitude string, drogue_lost_date string", enforceSchema=False)
    time = lambda c: F.try_to_timestamp(F.regexp_replace(c, r"[TZ]", " ")).cast("timestamp_ntz")
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    out = raw.select("ID", time("time").alias("time"), number("latitude").alias("latitude"), number("longitude").alias("longitude"), time("drogue_lost_date").alias("drogue_lost_date"))
    return out.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.isnan("latitude") & ~F.isnan("longitude"))


def forecast_grid(lat_min: float, lat_max: float, lon_min: float, lon_max: float, step: float, spark: SparkSession) -> DataFrame:
    """(k, lat, lon): points of a regular grid in the order that forecasts are asked for, latitudes first."""
    ny, nx = int(round((lat_max - lat_min) / step)) + 1, int(round((lon_max - lon_min) / step)) + 1
    return spark.range(ny * nx).select(F.col("id").alias("k"), (lat_min + F.floor(F.col("id") / nx) * step).alias("lat"), (lon_min + F.col("id") % nx * step).alias("lon"))


def point_forecasts(spark: SparkSession, path: str, grid: DataFrame, kind: str) -> DataFrame:
    """A velocity field from one JSON document per grid point (column k names the point): speed and direction become u and v."""
    speed, direction = ("ocean_current_velocity", "ocean_current_direction") if kind == "currents" else ("wind_speed_10m", "wind_direction_10m")
    raw = spark.read.json(path, schema=f"k bigint, {schemas.POINT_FORECAST}")
    hours = raw.select("k", F.explode(F.arrays_zip("hourly.time", f"hourly.{speed}", f"hourly.{direction}")).alias("h")).select("k", F.try_to_timestamp(F.replace("h.time", F.lit("T"), F.lit(" "))).cast("timestamp_ntz").alias("t"), F.col(f"h.{speed}").alias("s"), F.col(f"h.{direction}").alias("d"))
    u, v = from_direction(F.col("s"), F.col("d"), towards=kind == "currents", unit=1 / 3.6 if kind == "currents" else 1.0)
    return hours.join(grid, "k").select(F.lit(kind).alias("kind"), "t", "lat", "lon", u.alias("u"), v.alias("v"))


def daily_fields(paths_by_product: dict[str, list[str]], spark: SparkSession, kind: str, box: tuple[float, float, float, float], shift_hours: int = 12) -> DataFrame:
    """Days of the first product that has any rows in the box, cut to it and stamped at mid-day."""
    lo_lat, hi_lat, lo_lon, hi_lon = box
    for product, paths in paths_by_product.items():
        if not paths:
            continue
        f = spark.read.parquet(*paths).where((F.col("lat") >= lo_lat) & (F.col("lat") <= hi_lat) & (F.col("lon") >= lo_lon) & (F.col("lon") <= hi_lon))
        if not f.isEmpty():
            return f.select(F.lit(kind).alias("kind"), F.lit(product).alias("source"), (F.col("time").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(shift_hours))).alias("t"), "lat", "lon", "u", "v")
    return spark.createDataFrame([], schemas.FIELD)


def synthetic_bands(cube: DataFrame, bands: DataFrame) -> DataFrame:
    """Bands (band, lo, hi) from a swath cube (row, col, wavelength, rhos): the mean over wavelengths inside, or the wavelength nearest to the middle.
    Which wavelengths make a band is settled on the short list of distinct wavelengths, which is then joined to the cube."""
    n = bands.count()
    if n > 1_000:
        raise ValueError(f"{n} bands")
    waves = cube.select("wavelength").distinct()
    both = waves.crossJoin(F.broadcast(bands))  # counted: a dozen rows
    gap = F.abs(F.col("wavelength") - (F.col("lo") + F.col("hi")) / 2)
    within = (F.col("wavelength") >= F.col("lo")) & (F.col("wavelength") <= F.col("hi"))
    w = W.partitionBy("band")
    chosen = both.withColumn("n", F.sum(within.cast("int")).over(w)).withColumn("k", F.row_number().over(w.orderBy(gap, "wavelength"))).where(within | ((F.col("n") == 0) & (F.col("k") == 1)))
    return cube.join(chosen.select("wavelength", "band"), "wavelength").groupBy("row", "col", "band").agg(F.avg(F.nanvl("rhos", F.lit(None))).alias("value"))


def swath(pixels: DataFrame, bands: DataFrame, names: list[str], box: tuple[float, float, float, float], least: int = 1000) -> DataFrame | None:
    """Wide pixels of the box, or None if it has fewer than so many."""
    lo_lat, hi_lat, lo_lon, hi_lon = box
    inside = pixels.where((F.col("lat") >= lo_lat) & (F.col("lat") <= hi_lat) & (F.col("lon") >= lo_lon) & (F.col("lon") <= hi_lon))
    if inside.limit(least).count() < least:
        return None
    wide = bands.groupBy("row", "col").pivot("band", names).agg(F.first("value"))
    return inside.join(wide, ["row", "col"])


def block_averaged(pixels: DataFrame, bands: list[str], factor: int) -> DataFrame:
    """Coarser pixels: means of blocks; a scene class is taken from each block's middle."""
    mid = F.min(F.when((F.col("row") % factor == factor // 2) & (F.col("col") % factor == factor // 2), F.col("scl")))
    return pixels.groupBy("scene", F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(*(F.avg(b).alias(b) for b in bands), mid.alias("scl"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def labelled_pixels(spark: SparkSession, path: str, patches: DataFrame, split: str, bands: list[str]) -> DataFrame:
    """Labelled pixels of a split with their patch's median bands as background, annotator weights, and finite bands only."""
    chosen = spark.read.parquet(path).join(patches.where(F.col("split") == split).select("patch").distinct(), "patch", "left_semi")
    mid = chosen.groupBy("patch").agg(*(F.median(b).alias(f"bg_{b}") for b in bands))
    finite = [F.col(b).isNotNull() & ~F.isnan(b) & (F.abs(F.col(b)) != float("inf")) for b in bands]
    out = chosen.where("cls > 0").join(mid, "patch").withColumn("weight", annotator_weight(F.col("conf")))
    for f in finite:
        out = out.where(f)
    return out


def coast_points(rings: DataFrame, spacing: float = 0.01) -> DataFrame:
    """Points no farther apart than the spacing (degrees) along lines (ring_id, seq, lat, lon)."""
    w = W.partitionBy("ring_id").orderBy("seq")
    seg = rings.withColumn("lat2", F.lead("lat").over(w)).withColumn("lon2", F.lead("lon").over(w)).withColumn("lat2", F.coalesce("lat2", "lat")).withColumn("lon2", F.coalesce("lon2", "lon"))
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("lat2") - F.col("lat"), F.col("lon2") - F.col("lon")) / spacing)).cast("int")
    each = seg.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    f = F.col("k") / F.col("n")
    return each.select("ring_id", (F.col("lat") + f * (F.col("lat2") - F.col("lat"))).alias("lat"), (F.col("lon") + f * (F.col("lon2") - F.col("lon"))).alias("lon"))


def land_rings(rings: DataFrame, most_points: int = 200_000) -> list[list[tuple[float, float]]]:
    """Rings as lists for the particle kernel; their number of points is checked first."""
    n = rings.count()
    if n > most_points:
        raise ValueError(f"{n} ring points, more than {most_points}")
    rows = rings.groupBy("ring_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p")).collect()
    return [[(x.lat, x.lon) for x in r.p] for r in rows]
