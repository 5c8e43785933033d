"""Feature images, masks, classifiers kept in folders, projections and live runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.spectral import BANDS
from tidemark.operators import classify, detect, drift, field
from tidemark.plans import pipeline
from tidemark.sources import runs
from tidemark.streaming import recurrence


def square(x, w):
    """Mean of the w by w square around each pixel, edges mirrored."""
    r = w // 2
    p = np.pad(x, r, mode="symmetric")
    return np.mean([p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(w) for j in range(w)], axis=0)


def edges(x):
    p = np.pad(x, 1, mode="symmetric")
    at = lambda i, j: p[1 + i : 1 + i + x.shape[0], 1 + j : 1 + j + x.shape[1]]
    gx = sum(w * (at(i, 1) - at(i, -1)) for i, w in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(w * (at(1, j) - at(-1, j)) for j, w in ((-1, 1), (0, 2), (1, 1)))
    return np.hypot(gx, gy)


def scene(spark, n=9, seed=1):
    r = np.random.default_rng(seed)
    cubes = {b: r.random((n, n)) * 0.1 for b in BANDS} | {f"bg_{b}": r.random((n, n)) * 0.05 for b in BANDS}
    cubes["B4"][2, 3] = np.nan
    rows = [(0, i, j, n, n, 10 + 0.01 * i, 85 + 0.01 * j, True, *(float(c[i, j]) for c in cubes.values())) for i in range(n) for j in range(n)]
    return cubes, spark.createDataFrame(rows, "scene int, row int, col int, rows int, cols int, lat double, lon double, valid boolean, " + ", ".join(f"{c} double" for c in cubes))


def test_feature_image_is_worked_out_by_hand(spark):
    cubes, df = scene(spark)
    d = {b: np.nan_to_num(cubes[b]) - np.nan_to_num(cubes[f"bg_{b}"]) for b in BANDS}
    k = (832.8 - 664.8) / (1612.0 - 664.8)
    want = {f"d{b}": v for b, v in d.items()}
    want["dFDI"] = d["B8"] - (d["B6"] + (d["B11"] - d["B6"]) * k * 10)
    want["dFAI"] = d["B8"] - (d["B4"] + (d["B11"] - d["B4"]) * k)
    for name, a, b in (("dNDVI", "B8", "B4"), ("dNDWI", "B3", "B8")):
        want[name] = (d[a] - d[b]) / (abs(d[a]) + abs(d[b]) + 1e-3)
    for name in ("dFDI", "dNDVI", "dB8", "dB2", "dB4", "dB11"):
        x = want[name]
        for w in (3, 7, 15):
            want[f"{name}_m{w}"] = square(x, w)
            want[f"{name}_s{w}"] = np.sqrt(np.clip(square(x * x, w) - square(x, w) ** 2, 0, None))
        want[f"{name}_c7"], want[f"{name}_grad"] = x - square(x, 7), edges(x)
    got = detect.feature_image(df, 2).collect()
    assert len(got) == 81 and got[0].__fields__[3:] == list(detect.FEATURES[2]) and len(detect.FEATURES[2]) == 44 and detect.FEATURES[2][:35] == detect.FEATURES[1]
    for x in got:
        for c in detect.FEATURES[2]:
            assert x[c] == pytest.approx(want[c][x.row, x.col], abs=1e-7), c


def labelled(spark, n=300):
    r = np.random.default_rng(3)
    rows = [(k, float(k + r.normal() * 0.1), float(r.random()), 1.0) for _ in range(n // 3) for k in (1, 5, 7)]
    return spark.createDataFrame(rows, "label int, a double, b double, weight double")


def test_bundles_learn_are_kept_and_reject(spark, tmp_path):
    df = labelled(spark)
    found = classify.trained(classify.vectors(df, ["a", "b"]), trees=5, rounds=2, depth=3)
    found.save(spark, f"{tmp_path}/model")
    back = classify.Bundle.load(spark, f"{tmp_path}/model")
    assert classify.Bundle.load(spark, f"{tmp_path}/none") is None and back.classes == [1, 5, 7]
    scored = back.judged(classify.vectors(df.withColumnRenamed("label", "truth"), ["a", "b"]))
    assert scored.where("label = truth").count() / 300 > 0.95 and abs(scored.where("p_debris > 0.5").count() - 100) <= 5
    parts = classify.report(scored)
    assert parts["debris"].first().recall > 0.95 and parts["classes"].count() == 3 and classify.importances(found.forest, ["a", "b"])[0][0] == "a"
    pixels = scored.select("label", "p_floating", F.lit(True).alias("candidate"))
    assert detect.accepted(pixels, False).where("candidate").count() == scored.where("label <> 5").count()
    assert detect.accepted(pixels, True).where("candidate").count() == scored.where("label = 1 and p_floating >= 0.5").count()
    assert detect.accepted(pixels.withColumn("label", F.lit(None).cast("int")), False).where("candidate").isEmpty()


def test_experiments_compare_feature_sets_and_models(spark):
    df = labelled(spark, 150)
    got = {(x.features, x.model, x.weighted): x for x in classify.experiments(df, df, {"good": ["a"], "noise": ["b"]}, models=("forest",), trees=5, depth=3).collect()}
    assert len(got) == 4 and got["good", "forest", True].accuracy > 0.95 > got["noise", "forest", False].accuracy and got["good", "forest", False].macro_f1 > 0.95


def test_detection_runs_with_a_model_and_a_coast(spark):
    n = 24
    _, df = scene(spark, n)
    spot = (F.col("row").between(10, 12)) & (F.col("col").between(10, 12))
    calm = df.drop(*(c for c in df.columns if c.startswith("bg_"))).withColumns({b: F.lit(0.01) + F.col(b) * 0.01 for b in BANDS}).withColumn("B8", F.when(spot, 0.06).otherwise(F.col("B8")))
    calm = calm.withColumns({b: F.coalesce(F.nanvl(b, F.lit(None)), F.lit(0.01)) for b in BANDS})

    class Always:
        def __init__(self, label):
            self.label = label

        def judged(self, rows):
            return rows.select(*rows.columns, F.lit(self.label).alias("label"), F.lit(0.9).alias("p_floating"), F.lit(0.2).alias("p_debris"))

    out = pipeline.detected(calm, 1.0, 8, model=Always(1)).collect()
    assert len(out) == 1 and out[0].pixels == 9 and out[0].ml_label == 1 and out[0].ml_class == "Marine Debris" and out[0].id == "HS-01"
    assert pipeline.detected(calm, 1.0, 8, model=Always(5)).count() == 0 and pipeline.detected(calm, 1.0, 8).count() == 1
    shore = spark.createDataFrame([(10.11, 85.11)], "lat double, lon double")
    assert pipeline.detected(calm, 1.0, 8, coast=shore).count() == 0


def test_utm_of_known_places(spark):
    """The equator at a zone's middle, and a quarter of the meridian of the ellipsoid scaled by 0.9996."""
    df = spark.createDataFrame([(0.0, 87.0, 45), (90.0, 87.0, 45), (0.0, 87.0, -45)], "lat double, lon double, zone int")
    e, n = geo.to_utm(F.col("lat"), F.col("lon"), F.col("zone"))
    a, b, c = df.select(e.alias("e"), n.alias("n")).collect()
    assert (a.e, a.n, c.n) == pytest.approx((500_000, 0, 10_000_000), abs=1e-6) and b.n == pytest.approx(0.9996 * 10_001_965.729, abs=1e-2)


def test_live_runs_merge_move_and_are_written_once(spark, tmp_path):
    t0 = 1_700_000_000.0
    lat, lon, t = np.array([4.0, 23.0]), np.array([79.0, 96.0]), np.array([t0 - 1e6, t0 + 1e6])
    u = np.full((2, 2, 2), 0.2)
    forcing = pipeline.Forcing(field.Grid(t, lat, lon, u, u * 0), field.Grid(t, lat, lon, u * 0, u * 0), drift.Land([[(4.0, 95.0), (23.0, 95.0), (23.0, 96.0), (4.0, 96.0)]]))
    kind = "id string, lat double, lon double, radius_km double, confidence double, observed double, sensor string"
    passes = [[("a", 10.0, 85.0, 1.0, 0.5, t0, "x"), ("b", 15.0, 88.0, 1.0, 0.6, t0, "x")], [("c", 10.05, 85.0, 1.0, 0.7, t0 + 20 * 3600, "y"), ("old", 12.0, 86.0, 1.0, 0.9, t0 - 5 * 86_400, "y")]]
    folder = f"file://{tmp_path}/live"
    for rows in passes:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        recurrence.live_runs(stream, folder, forcing, n=10).awaitTermination()
    ids = [x.run_id for x in runs.run_index(spark, f"{folder}/runs").collect()]
    assert len(ids) == 2 and ids[0] > ids[1]
    first, second = (({x.id: x for x in runs.read_run(spark, f"{folder}/runs", k).collect()}) for k in reversed(ids))
    assert set(first) == {"a", "b"} and set(second) == {"b", "c"}
    assert second["c"].recurrence == 1.0 and second["b"].recurrence == 0 and second["b"].lon > 88.1 and second["c"].persistence == 1.0 and second["b"].age_h == 21
