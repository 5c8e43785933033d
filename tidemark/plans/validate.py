"""Validation against drifters: cases from tracks, errors of the model, of currents alone and of standing still, cone coverage, and the search
over settings. A particle carries its setting, so all cases of all settings are one ensemble table, simulated and scored in one run."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, point_in_ring, ring_area_km2
from ..operators import drift, evaluate
from ..operators.field import Grid
from ..operators.joins import time_shifted
from ..operators.scratch import settle
from ..refdata import CURRENT_SIGMA, DIFFUSIVITY, WINDAGE


def cases(drifters: DataFrame, first_hour: int = 0) -> DataFrame:
    """Drifter-days (id, t0, lat0, lon0, lat24, lon24, lat48, lon48, drogued): tracks (ID, time, latitude, longitude, drogue_lost_date) with a
    row at a day's hour and at 24 and 48 hours after."""
    t = drifters.select(F.col("ID").alias("id"), F.col("time").alias("t0"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "drogue_lost_date")
    base = t.where((F.hour("t0") == first_hour) & (F.minute("t0") == 0)).dropDuplicates(["id", "t0"])
    j = time_shifted(base, "id", "t0", (1, 2))
    drogued = F.coalesce(F.col("drogue_lost_date") > F.col("t0"), F.lit(True))
    return j.select("id", "t0", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), *(F.col(f"{c}_{k}").alias(f"{c}{24 * k}") for k in (1, 2) for c in ("lat", "lon")), drogued.alias("drogued"))


@dataclass
class Setting:
    windage: tuple[float, float] = WINDAGE
    diffusivity: float = DIFFUSIVITY
    sigma: float = CURRENT_SIGMA
    scale: float = 1.0
    stage: str = "run"
    order: int = 0
    extra: dict = field(default_factory=dict)


#: Most settings of one search: they are an array of the plan.
MOST_SETTINGS = 2_000


def scored(found: DataFrame, currents: Grid, wind: Grid, settings: Sequence[Setting], n: int = 150, cones: bool = True, **kw) -> DataFrame:
    """(setting, id, drogued, h, error_km, inside, area_km2) of each case under each setting at 24 and 48 hours; setting: its place in the list. Without cones there are
    no inside and area_km2, and no hull is cut.

    Windage, diffusivity, sigma and scale are columns of a seed, and a case has the same draws under every setting: one simulation, whatever the
    number of settings, dealt by particle."""
    if len(settings) > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    number = lambda k, v: F.lit(float(v)).alias(k)
    options = F.array(*(F.struct(F.lit(i).alias("setting"), number("least", s.windage[0]), number("most", s.windage[1]), number("K", s.diffusivity), number("sigma", s.sigma), number("scale", s.scale)) for i, s in enumerate(settings)))
    c = found.withColumn("case", F.concat_ws("@", F.col("id"), F.col("t0").cast("string"))).withColumn("s", F.explode(options))
    c = c.select(F.concat_ws("#", F.col("s.setting"), "case").alias("run"), "case", "s.*", "drogued", "t0", "lat0", "lon0", *(f"{x}{h}" for h in (24, 48) for x in ("lat", "lon")))
    seeds = c.select(F.col("run").alias("id"), "case", "least", "most", "K", "sigma", "scale", F.col("lat0").alias("lat"), F.col("lon0").alias("lon"), F.lit(0.0).alias("radius_km"), F.unix_timestamp(F.col("t0").cast("timestamp")).cast("double").alias("start"))
    snaps = drift.simulate(seeds, currents, wind, hours=48, every=24, n=n, windage=("least", "most"), diffusivity="K", sigma="sigma", scale="scale", draws="case", central=False, together=True, **kw).where("h > 0")
    snaps = settle(snaps, "validate") if cones else snaps
    mean = snaps.groupBy("id", "h").agg(F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    truth = c.select("setting", F.col("run").alias("id"), "drogued", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"lat{h}").alias("lat"), F.col(f"lon{h}").alias("lon")) for h in (24, 48)))).alias("x")).select("setting", "id", "drogued", "x.*")
    j = truth.join(mean, ["id", "h"])
    of = ["setting", "id", "drogued", "h", haversine_km(F.col("mean_lat"), F.col("mean_lon"), F.col("lat"), F.col("lon")).alias("error_km")]
    if not cones:
        return j.select(*of)
    return j.join(drift.hulls(snaps), ["id", "h"]).select(*of, point_in_ring(F.col("lat"), F.col("lon"), F.col("hull")).alias("inside"), ring_area_km2(F.col("hull")).alias("area_km2"))


def still(found: DataFrame) -> DataFrame:
    """Errors of standing still."""
    return found.select("drogued", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), haversine_km(F.col("lat0"), F.col("lon0"), F.col(f"lat{h}"), F.col(f"lon{h}")).alias("error_km")) for h in (24, 48)))).alias("x")).select("drogued", "x.*")


def summary(scores: DataFrame, by: tuple[str, ...] = ("setting", "h")) -> DataFrame:
    """By setting and hour: median, mean and p90 error, and where scores have cones, coverage of the 90 % cone and its median area."""
    cones = ["inside", "area_km2"] if "inside" in scores.columns else []
    scores = settle(scores.select(*by, "error_km", *cones), "scores")
    plain = [F.avg("error_km").alias("mean"), F.count("error_km").alias("n"), *(F.avg(F.col(c).cast("int")).alias("coverage") for c in cones[:1])]
    exact = {"median": ("error_km", 0.5), "p90": ("error_km", 0.9)} | {"cone_area_km2": (c, 0.5) for c in cones[1:]}
    return scores.groupBy(*by).agg(*plain).join(evaluate.quantiles(scores, list(by), exact), list(by))


def report(found: DataFrame, currents: Grid, wind: Grid, setting: Setting | None = None, **kw) -> DataFrame:
    """(method, h, median, mean, p90, n): the model, currents alone, and standing still, in one table."""
    s = setting or Setting()
    calm = Setting((0.0, 0.0), s.diffusivity, s.sigma, s.scale)
    method = F.when(F.col("setting") == 0, "model").otherwise("currents only")
    every = scored(found, currents, wind, [s, calm], **kw).select("h", "error_km", method.alias("method")).unionByName(still(found).select("h", "error_km", F.lit("persistence").alias("method")))
    return evaluate.error_stats(every, ["method", "h"], "error_km")


def searched(found: DataFrame, currents: Grid, wind: Grid, settings: Iterable[Setting], cones: bool = True, **kw) -> DataFrame:
    """(stage, order, windage, K, cscale, sigma, h, median, p90, coverage, cone_area_km2, n): the summary of each setting, all from one simulation; without cones
    no coverage and no area."""
    settings = list(settings)
    if not settings:
        raise ValueError("no settings to search")
    names = F.array(*(F.struct(F.lit(s.stage).alias("stage"), F.lit(s.order).alias("order"), F.lit(str(s.windage)).alias("windage"), F.lit(float(s.diffusivity)).alias("K"), F.lit(float(s.scale)).alias("cscale"), F.lit(float(s.sigma)).alias("sigma")) for s in settings))
    found = summary(scored(found, currents, wind, settings, cones=cones, **kw)).withColumn("s", F.get(names, F.col("setting")))
    return found.select("s.*", "h", "median", "p90", *(["coverage", "cone_area_km2"] if cones else []), "n")


def chosen(results: DataFrame, rule: str) -> DataFrame:
    """The best setting: the least sum of median errors ('error'), or of distances of the coverage from 0.9 ('coverage'); the first in order on ties."""
    cols = ["stage", "order", "windage", "K", "cscale", "sigma"]
    total = results.groupBy(*cols).agg(F.sum("median").alias("error"), F.sum(F.abs(F.col("coverage") - 0.9)).alias("coverage"))
    return evaluate.best(total, F.round(rule, 6), "order")
