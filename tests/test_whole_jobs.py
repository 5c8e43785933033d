"""Queries over all rows, against brute force."""

import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import refdata
from tidemark.functions import numeric
from tidemark.operators import classify, decide, drift, evaluate, joins, raster
from tidemark.queries import QUERIES

from .test_queries import D

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


def test_nearest_in_time_is_brute_force_at_any_distance(spark):
    r = random.Random(4)
    slices = [(k, r.choice([0, 10, 40, 41]) * 86_400 + r.randrange(20_000)) for k in range(30)]
    slices += [(30 + k, t) for k, (_, t) in enumerate(slices[:5])]
    times = [(i, r.randrange(-5 * 86_400, 50 * 86_400)) for i in range(300)] + [(300 + k, t) for k, t in slices] + [(400, (slices[0][1] + slices[1][1]) // 2), (401, None)]
    got = {x.id: (x.k, x.gap) for x in joins.nearest_in_time(spark.createDataFrame(times, "id long, at long"), spark.createDataFrame(slices, "k long, t long")).collect()}
    want = {i: (lambda b: (b[2], b[0]))(min((abs(at - t), t, k) for k, t in slices)) if at is not None else (None, None) for i, at in times}
    assert got == want and max(g for _, g in want.values() if g is not None) > 5 * 86_400
    none = joins.nearest_in_time(spark.createDataFrame(times, "id long, at long"), spark.createDataFrame([], "k long, t long")).collect()
    assert len(none) == len(times) and all(x.k is None for x in none)


def unit(places):
    x = np.radians(np.array(places, float))
    return np.c_[np.cos(x[:, 0]) * np.cos(x[:, 1]), np.cos(x[:, 0]) * np.sin(x[:, 1]), np.sin(x[:, 0])]


def brute_nearest(points, targets):
    chord = np.sqrt(((unit(points)[:, None] - unit(targets)[None]) ** 2).sum(2)).min(1)
    return 2 * refdata.EARTH_KM * np.arcsin(np.minimum(chord / 2, 1))


def test_nearest_point_is_brute_force_anywhere(spark):
    """Poles, both sides of the 180th meridian, a dense group, repeated places, far points."""
    r = random.Random(3)
    far = lambda n: [(math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for _ in range(n)]
    targets = far(200) + [(min(r.gauss(88.9, 0.5), 90.0), r.uniform(-180, 180)) for _ in range(60)] + [(90.0, 3.0), (10.3, 179.9), (10.0, -179.9), (70.55, 0.49), (70.25, 1.01)]
    targets += [(10 + r.gauss(0, 0.01), -180 + abs(r.gauss(0, 0.01))) for _ in range(900)] + [(33.0, 44.0)] * 200
    points = far(300) + [(89.9, 10.0), (-90.0, 0.0), (90.0, 5.0), (89.0, -170.0), (70.25, 0.49), (10.0, 179.9), (33.0, 44.0), (0.0, 180.0), (0.0, -180.0)] + [(10 + r.gauss(0, 0.02), 179.99) for _ in range(300)]
    place = "lat double, lon double"
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, 3.0), (5, *points[5])], f"id long, {place}")
    got = joins.nearest_point(rows, spark.createDataFrame([*targets, (None, 1.0)], place)).collect()
    want = brute_nearest(points, targets)
    assert len(got) == len(points) + 2 and all(x.distance_km is None if x.id < 0 else abs(x.distance_km - want[x.id]) < 1e-6 for x in got)
    few = {x.id: x.distance_km for x in joins.nearest_point(rows.where("id between 304 and 305"), spark.createDataFrame([(70.55, 0.49), (70.25, 1.01), (10.0, -179.9), (10.3, 179.9)], place)).collect()}
    assert few[304] == pytest.approx(19.5387, abs=1e-3) and few[305] == pytest.approx(21.9, abs=0.05)
    assert {x.distance_km for x in joins.nearest_point(rows.limit(3), spark.createDataFrame([], place)).collect()} == {None}


def test_a_tree_cuts_only_cells_with_many_places(spark):
    r = random.Random(5)
    places = [(50 + r.gauss(0, 1e-4), 7 + r.gauss(0, 1e-4)) for _ in range(3000)] + [(r.uniform(-80, 80), r.uniform(-180, 180)) for _ in range(300)]
    cells, ends, sizes = joins.cell_tree(spark.createDataFrame(places, "lat double, lon double"))
    assert ends.count() == 3300 and ends.groupBy("level", "cell").count().agg(F.max("count")).first()[0] <= joins.LEAF
    assert sum(sizes.values()) == cells.count() < 3300 and max(sizes) > joins.AT_ONCE


@pytest.mark.parametrize("name", ["forecast", "nowcast", "backtrack", "route_plan"])
def test_ensembles_are_whole(spark, monkeypatch, name):
    simulate, sea, runs, seas = drift.simulate, decide.Sea, [], []
    monkeypatch.setattr(drift, "simulate", lambda seeds, *a, **kw: (runs.append(kw.get("n", refdata.PARTICLES)), simulate(seeds, *a, **kw))[1])
    monkeypatch.setattr(decide, "Sea", lambda land: (seas.append(land), sea(land))[1])
    rows = QUERIES[name](spark, D).count()
    assert runs == [refdata.PARTICLES]
    if name == "route_plan":
        assert rows and seas and seas[0].rings
    else:
        assert rows == refdata.MAX_HOTSPOTS


def test_cap_keeps_every_class(spark):
    rows = spark.range(20_100).select("id", (F.col("id") % 10_050).alias("label"))
    assert evaluate.class_cap(rows, "label", F.col("id"), 1).count() == 10_050


def test_holes_of_every_scene_are_filled(spark):
    blocks = spark.range(20_020).select((F.col("id") % 10_010).alias("scene"), F.lit(0).alias("br"), (F.col("id") >= 10_010).cast("int").alias("bc"), F.when(F.col("id") < 10_010, F.col("id").cast("double")).alias("v"))
    got = raster.nearest_filled(blocks.union(spark.sql("select 20000L, 0, 0, cast(null as double)")), ["v"])
    assert got.where("v = scene").count() == 20_020 and got.count() == 20_021


def test_classifier_learns_all_classes_with_the_default_fit(spark, tmp_path, monkeypatch):
    class Fitted(Exception):
        pass

    def fit(df, **kw):
        raise Fitted(df.count(), kw)

    spark.range(2_000).select(F.col("id").alias("vec_id"), F.col("id").cast("int").alias("label"), F.expr("array(1f, 2f)").alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(classify, "fit", fit)
    with pytest.raises(Fitted) as e:
        QUERIES["two_expert_classifier"](spark, str(tmp_path))
    assert e.value.args == (1_600, {"weight": "weight"})


def test_rounding_is_that_of_the_exact_binary_value(spark):
    """A million doubles, decimal ties among them, against Python's round."""
    r = np.random.default_rng(7)
    n = 200_000
    x = np.concatenate([r.uniform(-1000, 1000, n), r.integers(-10**6, 10**6, n) / 2**10, (r.integers(-10**7, 10**7, n) * 10 + 5) / 10**4, r.normal(size=n) * 10.0 ** r.integers(-8, 9, n), r.integers(-999, 999, n) / 16 + 0.0])
    x = np.concatenate([x, [0.0, 0.5, 1.5, 2.5, 2.675, 1.005, 0.0005, 1e15, 1e300, -1e-300, 4503599627370497.5]])
    frame = spark.createDataFrame(pd.DataFrame({"x": x}))
    for places in (0, 2, 3):
        got = frame.select("x", numeric.rounded(F.col("x"), places).alias("y")).toPandas()
        assert (got["y"].to_numpy() == np.array([round(v, places) for v in got["x"].tolist()])).all()
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(numeric.rounded(F.col("x"), 3).alias("y")).collect()
    assert odd[0].y is None and math.isnan(odd[1].y) and odd[2].y == math.inf
