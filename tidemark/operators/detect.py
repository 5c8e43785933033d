"""Detection: from pixels to scored hotspots, by composition of the raster operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import on_land
from ..functions.numeric import clip
from ..functions.spectral import BANDS, debris_index, indices, relative
from ..refdata import MASK_STEPS, MASKED_CLASSES, MIN_PIXELS, REJECTED_CLASSES, SHORE_KM, WATER_CLASS, Z_THRESHOLD
from .joins import nearest_point
from .raster import block_medians, components, dilated, mad_z, nearest_filled, textures, upsampled
from .scratch import settle
from .show import class_name


def background(pixels: DataFrame, values: list[str], block: int) -> DataFrame:
    """pixels with bg_<value>: block medians, holes filled from the nearest block, read bilinearly."""
    size = settle(pixels.groupBy("scene").agg((F.ceil((F.max("row") + 1) / block) * block).cast("int").alias("rows"), (F.ceil((F.max("col") + 1) / block) * block).cast("int").alias("cols")), "sizes")
    grid = size.select("scene", F.explode(F.sequence(F.lit(0), (F.col("rows") / block).cast("int") - 1)).alias("br"), "cols").select("scene", "br", F.explode(F.sequence(F.lit(0), (F.col("cols") / block).cast("int") - 1)).alias("bc"))
    blocks = settle(grid.join(block_medians(pixels, values, block), ["scene", "br", "bc"], "left"), "blocks")
    blocks = settle(nearest_filled(blocks, values), "blocks")
    return upsampled(pixels, blocks, {v: f"bg_{v}" for v in values}, block, size)


def bright(b2: Column, bg2: Column, b11: Column) -> Column:
    return (F.coalesce(b2 - bg2, F.lit(1.0)) > 0.06) | (F.coalesce(b11, F.lit(1.0)) > 0.10)


def candidates(pixels: DataFrame, block: int, z_threshold: float = Z_THRESHOLD, every_band: bool = False) -> DataFrame:
    """pixels (scene, row, col, lat, lon, bands, valid) with FDI, NDVI, z, dFDI and candidate, and with the backgrounds of the bands that these need,
    or of every band."""
    named = pixels.withColumns({k: v for k, v in indices().items() if k in ("FDI", "NDVI")})
    values = ["FDI", *(BANDS if every_band else ("B2", "B6", "B8", "B11"))]
    bg = background(named, values, block)
    z = mad_z(bg, "FDI", "bg_FDI")
    d = F.col("FDI") - debris_index(F.col("bg_B6"), F.col("bg_B8"), F.col("bg_B11"))
    z = z.withColumn("dFDI", d)
    hit = F.col("valid") & (F.col("z") >= z_threshold) & (F.col("dFDI") > 0) & ~bright(F.col("B2"), F.col("bg_B2"), F.col("B11"))
    return z.withColumn("candidate", F.coalesce(hit, F.lit(False)))


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def scene_valid(pixels: DataFrame, bands: list[str], classes: str = "scl", steps: int = MASK_STEPS) -> DataFrame:
    """pixels (scene, row, col, bands, scene class) with valid: all bands finite, water, and not within so many steps of cloud or shadow."""
    masked = dilated(pixels.where(F.col(classes).isin(*MASKED_CLASSES)), steps).withColumn("_masked", F.lit(True))
    ok = (F.col(classes) == WATER_CLASS) & reduce(lambda a, b: a & b, map(finite, bands))
    return pixels.join(masked, ["scene", "row", "col"], "left").withColumn("valid", F.coalesce(ok, F.lit(False)) & F.col("_masked").isNull()).drop("_masked")


def off_shore(pixels: DataFrame, coast: DataFrame, rings: list[list[tuple[float, float]]], least_km: float = SHORE_KM[False]) -> DataFrame:
    """pixels whose candidates nearer than least_km to the coast (points lat, lon), or on land or inland water, are none any more. Only candidates
    are measured; they are few."""
    key = F.struct("scene", "row", "col").alias("id")
    found = settle(pixels.where("candidate").select(key, "lat", "lon"), "candidates")
    near = nearest_point(found, coast).where(F.col("distance_km") < least_km).select("id")
    drop = near.union(found.where(on_land(F.col("lat"), F.col("lon"), rings)).select("id")).distinct().select("id.*", F.lit(True).alias("_drop"))
    return pixels.join(drop, ["scene", "row", "col"], "left").withColumn("candidate", F.col("candidate") & F.col("_drop").isNull()).drop("_drop")


#: Columns of the feature image, in order: bands and indices relative to the background, texture at 3 and 7 pixels, then wider context and edges.
BASE = (*(f"d{b}" for b in BANDS), "dFDI", "dFAI", "dNDVI", "dNDWI")
TEXTURE = tuple(f"{x}_{k}" for x in ("dFDI", "dNDVI", "dB8", "dB2") for k in ("m3", "s3", "m7", "s7", "c7"))
CONTEXT = ("dFDI_m15", "dFDI_s15", "dNDVI_m15", "dNDVI_s15", "dFDI_grad", "dB8_grad", "dB2_grad", "dB4_s7", "dB11_s7")
FEATURES = {1: (*BASE, *TEXTURE), 2: (*BASE, *TEXTURE, *CONTEXT)}


def feature_image(pixels: DataFrame, version: int = 2) -> DataFrame:
    """(scene, row, col, features): the features of a version for each pixel of dense scenes (scene, row, col, rows, cols, all bands and their bg_
    backgrounds); missing values are 0."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    plain = pixels.select("scene", "row", "col", "rows", "cols", *(zero(b) for b in BANDS), *(zero(f"bg_{b}") for b in BANDS))
    x = settle(plain.select("scene", "row", "col", "rows", "cols", *(v.alias(k) for k, v in relative().items())), "relative")
    both = {"dFDI": (3, 7), "dNDVI": (3, 7), "dB8": (3, 7), "dB2": (3, 7)}
    if version == 2:
        both |= {"dFDI": (3, 7, 15), "dNDVI": (3, 7, 15), "dB4": (7,), "dB11": (7,)}
    out = textures(x, both, ("dFDI", "dB8", "dB2") if version == 2 else ())
    out = out.withColumns({f"{c}_c7": F.col(c) - F.col(f"{c}_m7") for c in ("dFDI", "dNDVI", "dB8", "dB2")})
    return out.select("scene", "row", "col", *FEATURES[version])


def classified(pixels: DataFrame, model, version: int = 2, same_sensor: bool = False) -> DataFrame:
    """pixels with the label and the group probabilities that a model gives its candidates, less those that it rejects. model: takes rows with
    features and adds p_forest and p_booster over its classes (`classify.Bundle`)."""
    from .classify import vectors

    rows = feature_image(pixels, version).join(pixels.where("candidate").select("scene", "row", "col"), ["scene", "row", "col"])
    seen = settle(model.judged(vectors(rows, list(FEATURES[version]))).select("scene", "row", "col", "label", "p_floating", "p_debris"), "classified")
    return accepted(pixels.join(seen, ["scene", "row", "col"], "left"), same_sensor)


def accepted(pixels: DataFrame, same_sensor: bool) -> DataFrame:
    """Candidates less the classes that a model (columns label, p_floating) recognises as something else; the training sensor also needs p >= 0.5."""
    ok = ~F.col("label").isin(*REJECTED_CLASSES) & ((F.col("p_floating") >= 0.5) if same_sensor else F.lit(True))
    return pixels.withColumn("candidate", F.col("candidate") & F.coalesce(ok, F.lit(False)))


def confidence(mean_z: Column, pixels: Column, ml: Column | None, edge: Column, same_sensor: bool, z_threshold: float = Z_THRESHOLD) -> Column:
    anomaly = clip(F.log10(F.greatest(mean_z, F.lit(z_threshold)) / z_threshold) / 1.5, 0, 1)
    size = clip(F.log1p(pixels) / F.log1p(F.lit(40)), 0, 1)
    raw = 0.85 * anomaly + 0.15 * size
    if ml is not None:
        raw = F.when(ml.isNull(), raw).otherwise((0.45 if same_sensor else 0.65) * anomaly + 0.15 * size + (0.40 if same_sensor else 0.20) * ml)
    return clip(raw * (1 - 0.5 * edge), 0, 1)


def hotspots(pixels: DataFrame, pixel_km: float, min_pixels: int = MIN_PIXELS, same_sensor: bool = False) -> DataFrame:
    """A row per component of at least so many candidate pixels: place (weighted by z), size, index means, edge share of invalid pixels, confidence."""
    pixels = settle(pixels, "pixels")
    found = components(pixels.where("candidate"), pixels.where("valid")).where("candidate").drop("candidate")
    found = settle(found, "components")
    p = pixels.join(found, ["scene", "row", "col"])
    w = F.greatest(F.col("z"), F.lit(0.0))
    has_ml = "p_floating" in pixels.columns
    agg = [
        F.count("*").alias("pixels"), (F.sum(w * F.col("lat")) / F.sum(w)).alias("lat"), (F.sum(w * F.col("lon")) / F.sum(w)).alias("lon"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z"),
        F.avg("FDI").alias("mean_fdi"), F.avg("NDVI").alias("mean_ndvi"),
    ]
    if has_ml:
        agg += [F.avg("p_floating").alias("p_floating_ml"), F.avg("p_debris").alias("p_debris_ml")]
    stats = p.groupBy("scene", "component").agg(*agg).where(F.col("pixels") >= min_pixels)
    if has_ml:  # the most frequent label, the smallest on ties
        counted = p.groupBy("scene", "component", "label").agg(F.count("*").alias("n"))
        mode = counted.groupBy("scene", "component").agg(F.max(F.struct("n", (-F.col("label")).alias("l")))["l"].alias("l"))
        stats = stats.join(mode.select("scene", "component", (-F.col("l")).alias("ml_label")), ["scene", "component"]).withColumn("ml_class", class_name(F.col("ml_label")))
    # the share of invalid pixels within four steps of each component
    marked = found.withColumn("key", F.struct("scene", "component"))
    ring = dilated(marked.select(F.col("key").alias("scene"), "row", "col"), 4).select(F.col("scene.scene").alias("scene"), F.col("scene.component").alias("component"), "row", "col")
    edge = ring.join(pixels.select("scene", "row", "col", "valid"), ["scene", "row", "col"]).groupBy("scene", "component").agg(F.avg((~F.col("valid")).cast("int")).alias("cloud_edge_fraction"))
    out = stats.join(edge, ["scene", "component"])
    area = F.col("pixels") * pixel_km * pixel_km
    conf = confidence(F.col("mean_z"), F.col("pixels"), F.col("p_floating_ml") if has_ml else None, F.col("cloud_edge_fraction"), same_sensor)
    return out.withColumns({
        "area_km2": F.round(area, 3), "radius_km": F.round(F.greatest(F.lit(pixel_km), F.sqrt(area / 3.141592653589793)), 2), "confidence": F.round(conf, 3), "lat": F.round("lat", 4), "lon": F.round("lon", 4),
        "max_z": F.round("max_z", 2), "mean_fdi": F.round("mean_fdi", 5), "mean_ndvi": F.round("mean_ndvi", 3), "cloud_edge_fraction": F.round("cloud_edge_fraction", 3),
    }).drop("mean_z")


def scene_stats(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("scene").agg(F.count_if("valid").alias("valid_pixels"), F.count_if("candidate").alias("candidate_pixels"), F.count("*").alias("pixels"))
