"""Readers, run tables, serving functions, plans and streams on tiny inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_operators import T0, uniform_field
from tidemark import api
from tidemark.plans import pipeline
from tidemark.sources import readers, runs
from tidemark.streaming import recurrence


def test_drifter_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text("ID,time,latitude,longitude,drogue_lost_date\n,UTC,degrees_north,degrees_east,UTC\nA,2024-01-01T00:00:00Z,10.5,85.0,never\nB,2024-01-01T06:00:00Z,,85.0,\nC,2024-01-01T06:00:00Z,11,86,2023-12-01T00:00:00Z\n")
    rows = {x.ID: x for x in readers.drifters(spark, str(tmp_path / "d.csv")).collect()}
    assert set(rows) == {"A", "C"} and rows["A"].drogue_lost_date is None and rows["C"].drogue_lost_date == datetime.datetime(2023, 12, 1) and rows["A"].time == datetime.datetime(2024, 1, 1)


def test_point_forecasts(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"k": 0, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "wind_speed_10m": [10, null], "wind_direction_10m": [90, 0]}}\n')
    grid = readers.forecast_grid(4, 5, 79, 80, 1.0, spark)
    f = readers.point_forecasts(spark, str(tmp_path / "f.json"), grid, "wind").orderBy("t").collect()
    assert grid.count() == 4 and f[0].u == pytest.approx(-10) and abs(f[0].v) < 1e-9 and f[1].u is None and f[0].t == datetime.datetime(2024, 1, 1)


def test_bands_by_range_or_nearest(spark):
    cube = spark.createDataFrame([(0, 0, w, w / 1000) for w in (440.0, 445.0, 560.0)], "row int, col int, wavelength double, rhos double")
    bands = spark.createDataFrame([("B1", 435.0, 450.0), ("B3", 600.0, 610.0)], "band string, lo double, hi double")
    got = {x.band: x.value for x in readers.synthetic_bands(cube, bands).collect()}
    assert got["B1"] == pytest.approx(0.4425) and got["B3"] == pytest.approx(0.56)


def test_products_fall_back(spark, tmp_path):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1), 10.0, 85.0, 1.0, 2.0)], "time date, lat double, lon double, u double, v double")
    df.where("false").write.parquet(f"{tmp_path}/final")
    df.write.parquet(f"{tmp_path}/nrt")
    x = readers.daily_fields({"final": [f"{tmp_path}/final"], "interim": [], "nrt": [f"{tmp_path}/nrt"]}, spark, "currents", (4, 23, 79, 96)).first()
    assert x.source == "nrt" and x.t == datetime.datetime(2024, 1, 1, 12)


def test_coast_points_are_dense(spark):
    line = spark.createDataFrame([(1, 0, 10.0, 85.0), (1, 1, 10.0, 85.1)], "ring_id int, seq int, lat double, lon double")
    assert readers.coast_points(line).count() == 11 and readers.land_rings(line) == [[(10.0, 85.0), (10.0, 85.1)]]


def test_labelled_pixels(spark, tmp_path):
    rows = [("p", 0, i, 0.1 * i, i % 3, i % 4) for i in range(6)] + [("q", 0, 0, 1.0, 1, 1), ("p", 9, 9, float("nan"), 1, 1)]
    spark.createDataFrame(rows, "patch string, row int, col int, B2 double, cls int, conf int").write.parquet(f"{tmp_path}/x")
    got = readers.labelled_pixels(spark, f"{tmp_path}/x", spark.createDataFrame([("train", "p"), ("test", "q")], "split string, patch string"), "train", ["B2"]).collect()
    assert len(got) == 4 and {x.weight for x in got} <= {1.0, 0.7, 0.4}


def sightings(spark):
    rows = [("a", 10.0, 85.0, 1.0, 0.9, T0 - 7200, "x"), ("b", 10.05, 85.0, 1.0, 0.5, T0 - 90_000, "x"), ("c", 15.0, 90.0, 2.0, 0.6, T0 - 7200, "y"), ("old", 12.0, 88.0, 1.0, 0.9, T0 - 9e5, "x")]
    return spark.createDataFrame(rows, "id string, lat double, lon double, radius_km double, confidence double, observed double, sensor string")


def test_live_run_is_deterministic_and_served(spark, tmp_path):
    forcing = pipeline.Forcing(uniform_field(0.2, 0.1), uniform_field(0, 0))
    out = [pipeline.live(spark, sightings(spark), T0, forcing, n=20, run_id="live_1").orderBy("id").collect() for _ in range(2)]
    assert out[0] == out[1] and [x.id for x in out[0]] == ["a", "c"] and sorted(x["rank"] for x in out[0]) == [1, 2] and out[0][0].recurrence == 1.0
    runs.write_run(pipeline.live(spark, sightings(spark), T0, forcing, n=20, run_id="live_1"), f"{tmp_path}/runs", "live_1")
    runs.write_run(pipeline.live(spark, sightings(spark), T0, forcing, n=20, run_id="day_1"), f"{tmp_path}/runs", "day_1")
    assert [x.run_id for x in runs.run_index(spark, f"{tmp_path}/runs").collect()] == ["live_1", "day_1"]
    assert [x.hotspots for x in api.list_runs(spark, f"{tmp_path}/runs").collect()] == [2, 2] and len(api.run(spark, f"{tmp_path}/runs", "live_1")) == 2
    assert api.route(spark, f"{tmp_path}/runs", "live_1", "Chennai", include_low=True, max_range_km=2000.0).count() == 1
    with pytest.raises(ValueError):
        api.route(spark, f"{tmp_path}/runs", "live_1", "Nowhere")
    assert api.health()["status"] == "ok" and len(api.ports()) == 8


def test_what_if_is_checked(spark, tmp_path):
    from tidemark.operators.drift import Land

    forcing = pipeline.Forcing(uniform_field(0.2, 0.1), uniform_field(0, 0), Land([[(9.0, 84.0), (9.0, 84.5), (9.5, 84.5), (9.5, 84.0)]]))
    x = api.forecast(spark, 10.0, 85.0, T0, forcing, n=20).first()
    assert x.id == "WHAT-IF" and x.tier in ("Low", "Medium", "High") and x.action
    for bad in ((1.0, 85.0, 0.6), (10.0, 85.0, 2.0), (9.2, 84.2, 0.6)):
        with pytest.raises(ValueError):
            api.forecast(spark, bad[0], bad[1], T0, forcing, bad[2], n=5)
    with pytest.raises(ValueError):
        api.run_file(str(tmp_path), "../x")


def test_stateful_recurrence_and_late_rows(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, "a", 1.0, t), (10008, 1, "a", 1.0, t + datetime.timedelta(hours=1)), (1, 1, "a", 1.0, t)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz")
    once = recurrence.replayed(df, lambda e: recurrence.once_each(recurrence.observed(e)).select("event_id"), files=1)
    assert sorted(x.event_id for x in once.collect()) == [1, 10008]
    base = recurrence.replayed_counts(df).agg(F.sum("seen")).first()[0]
    assert base == 3


def passes_over(n, seed=2):
    """Passes over some places, near each other, at the pole and across the 180th meridian; some come late, one comes twice."""
    import random

    r = random.Random(seed)
    start = 1_700_000_000
    places = [(10.0, 85.0), (10.1, 85.05), (10.2, 85.1), (10.3, 85.15), (89.99, 10.0), (20.0, 179.99)]
    rows = []
    for i in range(n):
        la, lo = r.choice(places)
        lo = lo + r.uniform(-0.15, 0.15) if la < 80 else r.uniform(-180, 180)
        rows.append((f"h{i:03d}", min(la + r.uniform(-0.1, 0.1), 90.0), (lo + 180) % 360 - 180, float(start + 3600 * (i // 6) + (0 if r.random() < 0.8 else -7200)), 1.0))
    return rows, "id string, lat double, lon double, observed double, radius_km double"


def test_near_pairs_of_a_stream_are_those_of_all_rows(spark, tmp_path):
    """In five batches, with late rows and one delivered twice: each pair comes once, and the merge from them is that of the rows compared anew."""
    from tidemark.operators import joins
    from tidemark.plans.pipeline import merged

    rows, schema = passes_over(150)
    for k in range(5):
        part = rows[30 * k : 30 * k + 30] + (rows[:1] if k == 3 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = recurrence.near_pairs(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 5
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    nodes, pairs = [x for x in out if x.r_id is None], [(x.id, x.r_id) for x in out if x.r_id is not None]
    df = spark.createDataFrame(rows, schema)
    want = joins.within_radius(df, df, 15.0, F.col("id") > F.col("r_id")).select("id", "r_id").collect()
    assert sorted(pairs) == sorted(map(tuple, want)) and len(pairs) > 300
    assert sorted((x.id, x.lat, x.radius_km) for x in nodes) == sorted((r[0], r[1], r[4]) for r in rows)
    near = spark.createDataFrame(pairs, "id string, r_id string")
    a, b = (sorted(map(tuple, merged(df, n).collect())) for n in (near, None))
    assert a == b and 3 < len(a) < 60


def test_a_cell_forgets_what_is_older_than_the_look_back(spark, tmp_path):
    """A day's look-back: the place seen again after three days has no pair, and what is held of the first is dropped by a timer."""
    day, start = 86_400, 1_700_000_000.0
    schema = "id string, lat double, lon double, observed double"
    for k, (name, at) in enumerate([("a", 0), ("b", 0.5), ("far", 2.5), ("far2", 3), ("c", 3.5)]):
        place = (10.0, 85.0) if len(name) == 1 else (-40.0, 20.0 + 3 * k)
        spark.createDataFrame([(name, *place, start + at * day)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = recurrence.near_pairs(stream, late="1 hour", lookback_days=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((x.id, x.r_id) for x in out if x.r_id) == [("b", "a")] and len(out) == 6
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/state")
    names = {x.id for x in held.selectExpr("explode(list_value) AS v").select("v.id").collect()} if "list_value" in held.columns else {x.id for x in held.select("list_element.id").collect()}
    assert "c" in names and not names & {"a", "b"}


def test_validation_finds_the_current_that_drove_the_buoys(spark):
    from tidemark.plans import validate

    c = uniform_field(0.3, 0.0)
    step = 0.3 * 86_400 / (111_320 * 0.984807753)
    day = datetime.datetime(2023, 11, 14)
    rows = [(k, day + datetime.timedelta(hours=6 * i), 10.0, 85 + step * i / 4, None) for k in "AB" for i in range(13)]
    found = validate.cases(spark.createDataFrame(rows, "ID string, time timestamp_ntz, latitude double, longitude double, drogue_lost_date timestamp_ntz"))
    assert found.count() == 4 and found.where("drogued").count() == 4
    r = {(x.method, x.h): x for x in validate.report(found, c, uniform_field(0, 0), n=20).collect()}
    assert r["model", 24].median < 8 and r["persistence", 24].median == pytest.approx(25.9, abs=0.3) and len(r) == 6
    options = [validate.Setting((0.0, 0.0), 20.0, 0.05, scale, "1", i) for i, scale in enumerate((0.5, 1.0))]
    best = validate.chosen(validate.searched(found, c, uniform_field(0, 0), options, n=20), "error").first()
    assert best.cscale == 1.0


def test_search_is_one_simulation_with_each_settings_own_result(spark):
    """Settings side by side give what each gives alone: same draws, same summaries; names, order and an empty list."""
    from tidemark.plans import validate

    day = datetime.datetime(2023, 11, 14)
    rows = [(k, day + datetime.timedelta(hours=24 * i), 10.0 + i * 0.1, 85 + j + 0.2 * i, None) for j, k in enumerate("ABC") for i in range(4)]
    found = validate.cases(spark.createDataFrame(rows, "ID string, time timestamp_ntz, latitude double, longitude double, drogue_lost_date timestamp_ntz"))
    options = [validate.Setting((0.0, 0.02), 20.0, 0.1, 1.0, "1", 0), validate.Setting((0.01, 0.03), 5.0, 0.05, 1.3, "1", 1), validate.Setting((0.0, 0.0), 0.0, 0.0, 0.5, "2", 0)]
    grids = uniform_field(0.2, 0.1), uniform_field(3.0, -1.0)
    key = lambda x: (x.stage, x.order, x.h)
    together = {key(x): x for x in validate.searched(found, *grids, options, n=12).collect()}
    assert len(together) == 6 and {x.n for x in together.values()} == {6}
    for o in options:
        for x in validate.searched(found, *grids, [o], n=12).collect():
            y = together[key(x)]
            assert (x.windage, x.K, x.cscale, x.sigma) == (y.windage, y.K, y.cscale, y.sigma) == (str(o.windage), o.diffusivity, o.scale, o.sigma)
            assert [x[c] for c in ("median", "p90", "coverage", "cone_area_km2")] == pytest.approx([y[c] for c in ("median", "p90", "coverage", "cone_area_km2")], rel=1e-9, abs=1e-9)
    assert len({round(x.median, 6) for x in together.values()}) == 6
    with pytest.raises(ValueError, match="no settings"):
        validate.searched(found, *grids, [])
    assert validate.searched(found.limit(0), *grids, options, n=4).count() == 0
