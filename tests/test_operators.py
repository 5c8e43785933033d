"""Operators against small cases worked out by hand or by brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import geo, numeric, temporal
from tidemark.operators import decide, detect, drift, evaluate, field, joins, raster

T0 = 1_700_000_000.0


def far(a, b):
    return float(decide.km(np.array(a, float), np.array(b, float)))


def uniform_field(u, v):
    lat, lon, t = np.array([4.0, 23.0]), np.array([79.0, 96.0]), np.array([T0 - 1e6, T0 + 1e6])
    return field.Grid(t, lat, lon, np.full((2, 2, 2), u), np.full((2, 2, 2), v))


STILL = uniform_field(0.0, 0.0)


def seeds(spark, rows=(("a", 10.0, 85.0, 0.0),)):
    return spark.createDataFrame([(*r, T0) for r in rows], drift.SEEDS)


def test_still_water_and_constant_current(spark):
    end = drift.simulate(seeds(spark), STILL, STILL, n=1, diffusivity=0, sigma=0).where("h = 48").collect()
    assert all(x.lat == 10 and x.lon == 85 for x in end) and len(end) == 2
    end = drift.simulate(seeds(spark), uniform_field(1.0, 0.0), STILL, n=2, diffusivity=0, sigma=0).where("h = 48").collect()
    assert all(abs(x.lon - 85 - 172_800 / (111_320 * math.cos(math.radians(10)))) < 1e-9 and x.lat == 10 for x in end)


def test_forward_then_backward_returns(spark):
    c = uniform_field(0.4, 0.3)
    there = drift.simulate(seeds(spark), c, STILL, n=0, hours=24).where("h = 24").first()
    back = spark.createDataFrame([("a", there.lat, there.lon, 0.0, T0 + 86_400)], drift.SEEDS)
    home = drift.simulate(back, c, STILL, n=0, hours=24, backward=True).where("h = 24").first()
    assert abs(home.lat - 10) < 1e-6 and abs(home.lon - 85) < 2e-4


def test_no_seeds_and_reruns_agree(spark):
    assert drift.simulate(seeds(spark).limit(0), STILL, STILL, n=3).count() == 0
    one, two = (sorted(drift.simulate(seeds(spark, [("a", 10.0, 85.0, 3.0), ("b", 12.0, 86.0, 1.0)]).repartition(k), STILL, STILL, n=10, hours=6).collect()) for k in (1, 3))
    assert [x[:7] for x in one] == [x[:7] for x in two]


def test_errors_come_in_pairs(spark):
    end = drift.simulate(seeds(spark), STILL, STILL, n=20, diffusivity=0, hours=12).where("h = 12 and not central").collect()
    assert abs(np.mean([x.lat for x in end]) - 10) < 1e-9 and np.std([x.lat for x in end]) > 0.01


def test_beaching_counts_only_sea_to_land(spark):
    land = drift.Land([[(9.0, 85.5), (11.0, 85.5), (11.0, 87.0), (9.0, 87.0)]])
    snaps = drift.simulate(seeds(spark, [("sea", 10.0, 85.4, 0.0), ("inland", 10.0, 86.0, 0.0)]), uniform_field(1.0, 0.0), STILL, land, n=4, diffusivity=0, sigma=0)
    b = {x.id: x for x in drift.beaching(snaps).collect()}
    assert b["sea"].beached_fraction == 1 and b["sea"].first_beaching_h == 4 and b["sea"].half_beached_h == 4 and len(b["sea"].beach_points) == 4
    assert b["inland"].beached_fraction == 0 and b["inland"].half_beached_h is None and b["inland"].beach_points == []


def test_forecast_and_nowcast_rows(spark):
    f = drift.forecast(seeds(spark, [("a", 10.0, 85.0, 2.0)]), uniform_field(0.2, 0.1), STILL, n=30).first()
    assert set(f.horizons) == {24, 48} and len(f.track) == 49 and f.horizons[48].displacement_km > f.horizons[24].displacement_km and f.horizons[24].hull[0] == f.horizons[24].hull[-1]
    h = spark.createDataFrame([("old", 10.0, 85.0, 1.0, T0 - 36_000), ("new", 10.0, 85.0, 1.0, T0 - 600)], "id string, lat double, lon double, radius_km double, observed double")
    got = {x.id: x for x in drift.nowcast(h, T0, uniform_field(0.5, 0.0), STILL, n=20).collect()}
    assert got["new"].age_h == 0 and got["new"].lat == 10 and got["old"].age_h == 10 and got["old"].lon > 85.1 and got["old"].radius_km > 1 and not got["old"].ashore


@given(st.lists(st.tuples(st.floats(5, 20), st.floats(80, 95)), min_size=4, max_size=40))
@settings(max_examples=60, deadline=None)
def test_hull_holds_what_it_keeps(points):
    lat, lon = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    ring = drift.hull90(lat, lon, 1.0)
    assert ring[0] == ring[-1]
    turn = [(b[1] - a[1]) * (c[0] - b[0]) - (b[0] - a[0]) * (c[1] - b[1]) for a, b, c in zip(ring, ring[1:], ring[2:])]
    assert all(t >= -1e-3 for t in turn) and max(p[0] for p in ring) >= lat.max() - 1e-4 and min(p[1] for p in ring) <= lon.min() + 1e-4


def test_few_points_are_their_own_hull():
    assert drift.hull90(np.array([1.0, 2.0]), np.array([3.0, 4.0])) == [(1.0, 3.0), (2.0, 4.0)]


def test_grid_fills_gaps_and_single_steps():
    u = np.array([[[1.0, np.nan], [3.0, 4.0]]])
    g = field.Grid(np.array([T0]), np.array([0.0, 1.0]), np.array([0.0, 1.0]), u, np.full((1, 2, 2), np.nan))
    a, b = g.at(np.array([T0 + 99]), np.array([0.0]), np.array([1.0]))
    assert a[0] in (1.0, 4.0) and b[0] == 0


def test_components_are_brute_force(spark):
    r = random.Random(1)
    cells = {(s, r.randrange(12), r.randrange(12)) for s in (0, 1) for _ in range(45)}
    got = {(x.scene, x.row, x.col): x.component for x in raster.components(spark.createDataFrame(sorted(cells), "scene int, row int, col int")).collect()}

    def reach(c):
        seen, todo = {c}, [c]
        while todo:
            s, y, x = todo.pop()
            todo += [n for a in (-1, 0, 1) for b in (-1, 0, 1) if (n := (s, y + a, x + b)) in cells and n not in seen and not seen.add(n)]
        return min(y * (1 << 20) + x for _, y, x in seen)

    assert got == {c: reach(c) for c in cells}


def test_diagonals_join_and_gaps_only_through_valid(spark):
    at = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 1, 4)], "scene int, row int, col int")
    assert raster.components(at).select("component").distinct().count() == 2
    everywhere = spark.createDataFrame([(0, r, c) for r in range(3) for c in range(6)], "scene int, row int, col int")
    assert raster.components(at, everywhere).where("candidate").select("component").distinct().count() == 1


def test_spike_is_one_component(spark):
    px = [(0, r, c, 10 + r * 0.01, 85 + c * 0.01, *([0.02] * 6), True) for r in range(12) for c in range(12)]
    spiked = [(*p[:5], *((0.02, 0.02, 0.02, 0.02, 0.08 + p[2] * 1e-4, 0.02) if (p[1], p[2]) in ((5, 5), (5, 6)) else (0.02, 0.02, 0.02, 0.02 + p[2] * 1e-4, 0.02 + p[1] * 1e-4, 0.02)), True) for p in px]
    df = spark.createDataFrame(spiked, "scene int, row int, col int, lat double, lon double, B2 double, B3 double, B4 double, B6 double, B8 double, B11 double, valid boolean")
    found = detect.hotspots(detect.candidates(df, 6), 1.0).collect()
    assert len(found) == 1 and found[0].pixels == 2 and abs(found[0].lat - 10.05) < 1e-3 and 0 < found[0].confidence <= 1
    assert decide.top_hotspots(detect.hotspots(detect.candidates(df, 6), 1.0)).first().id == "HS-01"


def test_scene_without_any_value_stays_empty(spark):
    b = spark.createDataFrame([(0, r, c, None) for r in range(2) for c in range(2)] + [(1, 0, 0, 5.0), (1, 0, 1, None)], "scene int, br int, bc int, v double")
    got = {(x.scene, x.br, x.bc): x.v for x in raster.nearest_filled(b, ["v"]).collect()}
    assert got[1, 0, 1] == 5 and got[0, 1, 1] is None and len(got) == 6


def test_ring_and_area(spark):
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0))))
    inside = [(1.0, 1.0, True), (3.0, 1.0, False), (1.0, -0.5, False), (0.1, 1.9, True)]
    df = spark.createDataFrame(inside, "lat double, lon double, want boolean")
    assert df.where(geo.point_in_ring(F.col("lat"), F.col("lon"), ring) == F.col("want")).count() == 4
    assert geo.box_coverage([(0, 0), (0, 2), (2, 2), (2, 0)], (1, 3, 1, 3)) == pytest.approx(0.25)


@given(st.floats(4, 23), st.floats(79, 96), st.floats(4, 23), st.floats(79, 96))
@settings(max_examples=50, deadline=None)
def test_distance_is_symmetric_and_bounded(a, b, c, d):
    assert far((a, b), (c, d)) == pytest.approx(far((c, d), (a, b)), abs=1e-6)
    assert far((a, b), (a, b)) == 0 and far((a, b), (c, d)) < 3500


def test_perfect_calibration_and_bins(spark):
    df = spark.createDataFrame([(0.25, int(i % 4 == 0)) for i in range(400)], "p double, y int")
    x = evaluate.calibration(df, "p", "y").first()
    assert x.ece == 0 and x.n == 400 and x.positives == 100
    edge = spark.createDataFrame([(0.3,), (1.0,), (0.0,), (0.30000000000000004,)], "p double").select(numeric.digitize(F.col("p")).alias("b")).collect()
    assert [x.b for x in edge] == [2, 9, 0, 3]


def test_published_confusion_arithmetic(spark):
    m = spark.createDataFrame([(0, 0, 90), (0, 1, 10), (1, 1, 30), (1, 0, 20), (2, 0, 5)], "truth int, predicted int, n long")
    got = {x["class"]: x for x in evaluate.precision_recall(m).collect()}
    assert got[1].precision == 0.75 and got[1].recall == 0.6 and got[1].f1 == pytest.approx(2 / 3) and got[2].f1 == 0 and got[0].support == 100


def test_radius_pairs_are_brute_force(spark):
    r = random.Random(2)
    pts = [(i, 8 + r.random() * 2, 84 + r.random() * 2) for i in range(150)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(x.id, x.r_id) for x in joins.within_radius(df, df, 15, F.col("id") < F.col("r_id")).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and far(a[1:], b[1:]) <= 15}


def test_greedy_dedup_follows_the_sequential_rule(spark):
    r = random.Random(5)
    rows = [(i, 10 + r.random(), 85 + r.random(), r.randrange(6)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, observed long")
    got = {x.id: x.seen for x in joins.greedy_dedup(df, ["-observed", "id"]).collect()}
    kept = []
    for x in sorted(rows, key=lambda x: (-x[3], x[0])):
        near = next((k for k in kept if far(x[1:3], k[0][1:3]) <= 15), None)
        (near[1].add(x[3]) if near else kept.append((x, {x[3]})))
    assert got == {k[0][0]: len(k[1]) for k in kept}


def test_persistence_without_history_is_zero(spark):
    h = spark.createDataFrame([("a", 10.0, 85.0)], "id string, lat double, lon double")
    past = spark.createDataFrame([], "run string, lat double, lon double")
    assert joins.persistence(h, past, "run").first().persistence == 0


def test_persistence_counts_runs_by_cells_and_places(spark):
    """Against brute force at the poles, across the 180th meridian, in a dense place, and with nulls; ties at the same place included."""
    r = random.Random(3)
    bases = [(89.95, 10.0), (-89.9, 0.0), (10.0, 180.0), (0.0, 0.0), (60.0, -179.99)]

    def place():
        lat, lon = r.choice(bases)
        if r.random() < 0.2:
            return lat, lon
        east = r.uniform(-180, 180) if abs(lat) > 85 else lon + r.uniform(-0.4, 0.4)
        return max(-90.0, min(90.0, lat + r.uniform(-0.3, 0.3))), east - 360 if east > 180 else east

    hot = [(i, *place()) for i in range(150)] + [(150 + i, 0.0 + i % 9 * 1e-3, 0.0) for i in range(40)] + [(900, None, 1.0)]
    past = [(r.choice([*(f"r{k}" for k in range(12)), None]), *place()) for _ in range(90)] + [("dense", i * 1e-3, 0.1) for i in range(60)] + [("empty", None, None)]
    runs = len({p[0] for p in past})
    want = {i: len({run for run, *at in past if at[0] is not None and lat is not None and far((lat, lon), at) <= 15}) / runs for i, lat, lon in hot}
    frames = spark.createDataFrame(hot, "id long, lat double, lon double"), spark.createDataFrame(past, "run string, lat double, lon double")
    found = joins.persistence(*frames, "run")
    assert found.columns == ["id", "lat", "lon", "persistence"]
    assert {x.id: x.persistence for x in found.collect()} == want and sum(v > 0 for v in want.values()) > 100
    assert joins.persistence(frames[0].limit(0), frames[1], "run").count() == 0


def targets(*rows):
    return pd.DataFrame(rows, columns=["id", "rank", "risk_score", "tier", "lat", "lon", "start", "track"])


def still(lat, lon):
    return [{"h": float(h), "lat": lat, "lon": lon} for h in range(49)]


def test_route_meets_moving_targets():
    track = [{"h": float(h), "lat": 10.0 + 0.01 * h, "lon": 85.0} for h in range(49)]
    out = decide.route(targets(("a", 1, 80.0, "High", 10.0, 85.0, 0.0, track)), (10.0, 84.0), decide.Sea(drift.Land()), depart=0.0)
    stop = out["stops"][0]
    assert abs(stop["lat"] - (10 + 0.01 * stop["arrive_h"])) < 2e-3 and out["candidates"] == 1 and out["total_h"] > stop["arrive_h"]
    assert stop["leg_km"] == pytest.approx(far((10.0, 84.0), (stop["lat"], stop["lon"])), abs=0.1) and stop["via"] == [] and out["return_km"] == stop["leg_km"]


def test_route_takes_the_cheapest_of_its_targets_in_turn():
    """Targets that stand still: each stop is the least leg times (1.6 - risk / 100) from the one before, worked out one by one."""
    r = random.Random(6)
    rows = [(f"t{i}", i + 1, float(r.randrange(20, 95)), "High", 10 + 2 * r.random(), 85 + 2 * r.random(), 0.0) for i in range(9)]
    out = decide.route(targets(*((*x, still(x[4], x[5])) for x in rows)), (10.0, 84.5), decide.Sea(drift.Land()), depart=0.0, speed_kn=30.0)
    at, left, clock, want = (10.0, 84.5), list(rows), 0.0, []
    for _ in range(5):
        x = min(left, key=lambda x: far(at, x[4:6]) * (1.6 - x[2] / 100))
        clock += far(at, x[4:6]) / (30 * 1.852)
        want.append((x[0], round(clock, 1)))
        clock, at = clock + 2, x[4:6]
        left.remove(x)
    assert [(x["id"], x["arrive_h"]) for x in out["stops"]] == want
    assert out["total_h"] == pytest.approx(clock + far(at, (10.0, 84.5)) / (30 * 1.852), abs=0.06)


def test_legs_go_around_land_by_the_shortest_way_point():
    wall = decide.Sea(drift.Land([[(9.9, 84.4), (10.1, 84.4), (10.1, 84.6), (9.9, 84.6)]]))
    a, b = np.array([10.0, 84.0]), np.array([[10.0, 85.0], [10.5, 84.0], [10.02, 84.02]])
    d, via = wall.legs(a, b)
    assert wall.blocked(np.broadcast_to(a, b.shape), b).tolist() == [True, False, False] and np.isnan(via[1:]).all()
    best = np.inf
    for share in (0.25, 0.5, 0.75):
        for off in (10, 20, 40, 70, 110):
            for side in (1, -1):
                w = np.array([10.0 - side * 0 + 0.0, 84.0 + share])
                w = np.array([w[0] + side * off / 111.32, w[1]])
                legs = [(a[None], w[None]), (w[None], b[:1])]
                if not wall.land(w[:1], w[1:])[0] and not any(wall.blocked(*leg)[0] for leg in legs):
                    best = min(best, far(a, w) + far(w, b[0]))
    assert d[0] == pytest.approx(best, rel=1e-9) and d[0] > far(a, b[0])
    shut = decide.Sea(drift.Land([[(-60.0, 84.4), (60.0, 84.4), (60.0, 84.6), (-60.0, 84.6)]]))
    assert np.isinf(shut.legs(a, b[:1])[0][0])
    none = decide.route(targets(("a", 1, 80.0, "High", 10.0, 85.0, 0.0, still(10.0, 85.0))), (10.0, 84.0), shut, depart=0.0)
    assert none["stops"] == [] and none["total_km"] == 0


def test_runge_kutta_is_fourth_order():
    """dx/dt = x from 1: the error of one step shrinks by 2^5 when the step is halved."""
    errors = [abs(1 + h * drift.runge_kutta(lambda t, moved: 1 + moved, 0.0, h) - np.exp(h)) for h in (0.2, 0.1)]
    assert 28 < errors[0] / errors[1] < 36


def test_kept_hours_are_those_of_all_snapshots(spark):
    rows = seeds(spark, [("a", 10.0, 85.0, 5.0)])
    land = drift.Land([[(9.0, 85.3), (11.0, 85.3), (11.0, 87.0), (9.0, 87.0)]])
    whole = drift.simulate(rows, uniform_field(0.5, 0.1), STILL, land, n=20).where("central or h in (24, 48)")
    few = drift.simulate(rows, uniform_field(0.5, 0.1), STILL, land, n=20, keep=(24, 48))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, few.collect())) and whole.count() == 49 + 40


def test_radius_pairs_at_high_latitudes_and_across_the_date_line(spark):
    r = random.Random(7)
    pts = [(80.0, 10.0), (80.05, 10.6), (0.0, 179.99), (0.0, -179.99), (89.99, 0.0), (89.99, 180.0), (-90.0, 5.0), (-89.95, -120.0)]
    pts += [(r.choice([-1, 1]) * (60 + 30 * r.random() ** 0.3), r.uniform(-180, 180)) for _ in range(300)] + [(r.uniform(-40, 40), r.choice([-1, 1]) * (180 - 0.1 * r.random())) for _ in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, lat double, lon double")
    got = {(x.id, x.r_id) for x in joins.within_radius(df, df, 15, F.col("id") < F.col("r_id")).collect()}
    want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if far(pts[i], pts[j]) <= 15}
    assert got == want and {(0, 1), (2, 3), (4, 5), (6, 7)} <= want


def test_trilinear_takes_repeated_points_and_missing_cells(spark):
    cells = [("k", float(t), float(y), float(x), 1.0, 2.0 + t + 10 * y + 100 * x) for t in (0, 1) for y in (0, 1, 2) for x in (0, 1, 2)]
    full = spark.createDataFrame(cells, "kind string, t double, lat double, lon double, u double, v double")
    points = spark.createDataFrame([(1, 0.5, 0.25, 1.5), (1, 0.5, 0.25, 1.5), (2, 5.0, -3.0, 9.0)], "id int, t double, lat double, lon double")
    got = sorted((x.id, round(x.u, 9), round(x.v, 9)) for x in field.trilinear(points, full, "k").collect())
    assert got == [(1, 1.0, 155.0)] * 2 + [(2, 1.0, 203.0)]
    holes = full.where("not (t = 0 and lat = 0 and lon = 1)").withColumn("u", F.when(~((F.col("t") == 1) & (F.col("lat") == 0)), F.col("u")))
    filled = field.trilinear(points, holes, "k").collect()
    assert len(filled) == 3 and all(x.u == 1 for x in filled)
    grid = field.Grid.of(holes.withColumn("v", F.col("u")), "k")
    assert grid.at(np.array([0.5]), np.array([0.25]), np.array([1.5]))[0][0] == 1.0


def test_missing_cells_take_the_nearest(spark):
    r = np.random.default_rng(9)
    for k in range(20):
        x = np.where(r.random((r.integers(1, 12), r.integers(1, 12))) < 0.3, r.random(), np.nan)
        x = np.where(np.isnan(x), np.nan, r.random(x.shape))
        got, good = field._filled(x), np.argwhere(~np.isnan(x))
        for (i, j), v in np.ndenumerate(got):
            d = ((good - (i, j)) ** 2).sum(1)
            assert (v == 0 and not len(good)) or v in {x[tuple(g)] for g in good[d == d.min()]}
    cells = [(s, i, j, float(v)) for s, x in ((0, r.random((9, 14))), (1, r.random((5, 5)))) for (i, j), v in np.ndenumerate(x)]
    keep = {c[:3] for c in cells if r.random() < 0.15 and c[0] == 0} | {(1, 4, 0)}
    df = spark.createDataFrame([(*c[:3], c[3] if c[:3] in keep else None) for c in cells] + [(2, 0, 0, None)], "scene int, br int, bc int, v double")
    values = {c[:3]: c[3] for c in cells}
    for reach in (None, 2):
        got = {(x.scene, x.br, x.bc): x.v for x in raster.nearest_filled(df, ["v"], reach=reach).collect()}
        assert got.pop((2, 0, 0)) is None and len(got) == len(cells)
        for s, i, j in got:
            d, a, b = min(((a - i) ** 2 + (b - j) ** 2, a, b) for t, a, b in keep if t == s)
            assert got[s, i, j] == (values[s, a, b] if reach is None or d <= reach * reach else None)


def test_times(spark):
    df = spark.createDataFrame([("x.20240102T030405.L2.nc", "live_20240102_0300"), ("none", "2024-01-02")], "name string, run string")
    a, b = df.select(temporal.granule_time(F.col("name")).alias("t"), temporal.run_label(F.col("run")).alias("r")).collect()
    assert str(a.t) == "2024-01-02 03:04:05" and b.t is None and str(a.r) == "2024-01-02 03:00:00" and str(b.r) == "2024-01-02 00:00:00"
