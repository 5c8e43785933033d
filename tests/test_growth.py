"""Steps whose cost grew faster than their tables: results against plain loops, and what the plans may hold."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import geo, numeric
from tidemark.operators import evaluate, joins, scratch
from tidemark.operators.field import Grid
from tidemark.streaming import recurrence


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_legs_are_tested_in_batches_and_not_point_by_point_in_the_plan(spark):
    """Legs against two rings, a leg's points one by one; without an end, short ones and those of a ring of two corners never cross."""
    rings = [[(8.0, 82.0), (9.0, 92.0), (14.0, 94.0), (20.0, 90.0), (17.0, 84.0)], [(0.0, 60.0), (0.0, 61.0), (1.0, 61.0)], [(5.0, 70.0), (6.0, 71.0)]]
    ends = [(4 + 19 * (k * 7919 % 1009) / 1009, 60 + 36 * (k * 104729 % 1013) / 1013, 4 + 19 * (k * 31 % 97) / 97, 60 + 36 * (k * 57 % 89) / 89) for k in range(3000)]
    ends += [(12.0, 88.0, 12.01, 88.01), (12.0, 88.0, 12.0, 88.0), (None, 88.0, 12.0, 80.0), (12.0, 88.0, None, None), (0.5, 59.0, 0.5, 62.0), (5.5, 69.0, 5.5, 72.0)]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i long, a double, b double, c double, d double")
    found = df.select("i", geo.crosses_land(*map(F.col, "abcd"), rings).alias("x"))

    def inside(lat, lon, ring):
        return len(ring) > 2 and sum((p[0] > lat) != (q[0] > lat) and lon < p[1] + (lat - p[0]) / (q[0] - p[0]) * (q[1] - p[1]) for p, q in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    def want(a, b, c, d):
        if None in (a, b, c, d) or (km := haversine(a, b, c, d)) < 12:
            return False
        fractions = [6 / km + (1 - 12 / km) * k / 24 for k in range(25)]
        return any(inside(a + f * (c - a), b + f * (d - b), r) for f in fractions for r in rings)

    got = {r.i: r.x for r in found.collect()}
    assert got == {i: want(*e) for i, e in enumerate(ends)} and 300 < sum(got.values()) < 2900
    assert "lambdafunction" not in plan(found) and "ArrowEvalPython" in plan(found)


def test_many_rows_are_rounded_as_round_does(spark):
    """To the bit: ties of the decimal text and values beside them, negative, huge and missing ones, zeros without a sign."""
    values = [k / 20000 + e for k in range(-400, 400) for e in (0.0, 1e-12, -1e-12, 1e-9)] + [1.00005, 2.675, 14.99995, 1e17, 123456.78905, float("nan"), float("inf"), -0.00001, None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", numeric.round_many(F.col("x"), 4).alias("got"), F.round("x", 4).alias("want"))
    assert [str(r.got) for r in df.collect()] == [str(r.want) for r in df.collect()]


def test_near_pairs_of_one_file_are_dealt_to_all_tasks(spark):
    """Pairs of one partition's rows against a double loop, at both poles and across the 180th meridian; the rows are dealt before they are repeated."""
    places = [(round(10 + 0.05 * (k % 17), 3), round(85 + 0.07 * (k % 13), 3)) for k in range(90)] + [(89.95, 30.0 * k) for k in range(12)] + [(-89.99, 10.0), (-89.98, -170.0), (0.0, 179.97), (0.05, -179.99), (0.0, -179.9)]
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "id long, lat double, lon double").coalesce(1)
    found = joins.within_radius(rows, rows, 15.0, F.col("id") < F.col("r_id"))
    got = {(r.id, r.r_id): r.distance_km for r in found.collect()}
    want = {(i, j): d for j, q in enumerate(places) for i, p in enumerate(places[:j]) if (d := haversine(*p, *q)) <= 15.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and found.columns == ["id", "lat", "lon", "r_id", "r_lat", "r_lon", "distance_km"]
    assert "RoundRobinPartitioning" in plan(found) or "REPARTITION_BY_NUM" in plan(found)


def test_close_places_are_found_without_comparing_all(monkeypatch):
    """Against a double loop over places at a pole, across the 180th meridian and in heaps, in parts; far fewer are compared than there are pairs."""
    rng = np.random.default_rng(5)
    lat = np.concatenate([rng.uniform(9, 12, 500), np.full(60, 10.0), rng.uniform(89.7, 90, 60), rng.uniform(-0.2, 0.2, 60)])
    lon = np.concatenate([rng.uniform(84, 88, 500), np.full(60, 85.0), rng.uniform(-180, 180, 60), (179.9 + rng.uniform(0, 0.2, 60) + 180) % 360 - 180])
    mixed = rng.permutation(len(lat))
    lat, lon = lat[mixed], lon[mixed]
    monkeypatch.setattr(recurrence, "AT_ONCE", 700)
    measured = []
    real = recurrence.haversine
    monkeypatch.setattr(recurrence, "haversine", lambda *a: measured.append(len(a[0])) or real(*a))
    parts = list(recurrence.close(lat, lon, 200, 15.0))
    got = [(int(i), int(j)) for a, b in parts for i, j in zip(a, b)]
    want = {(i, j) for i in range(200, len(lat)) for j in range(i) if haversine(lat[i], lon[i], lat[j], lon[j]) <= 15.0}
    assert set(got) == want and len(got) == len(want) and len(parts) > 3
    assert sum(measured) <= len(want) + 5


def test_a_field_is_read_by_few_steps_whatever_its_axes():
    """Places inside, outside and on the edges of fields with one, two and more steps to an axis, against a sum over corners."""
    rng = np.random.default_rng(3)
    for shape in ((2, 2, 2), (1, 1, 1), (1, 3, 4), (5, 1, 3), (4, 3, 1), (6, 5, 4)):
        axes = [np.sort(rng.uniform(0, 10, m)) for m in shape]
        grid = Grid(*axes, *rng.normal(size=(2, *shape)))
        places = [np.concatenate([rng.uniform(-1, 11, 300), a[[0, -1]], a[:1]]) for a in axes]
        got = grid.at(*places)
        for field, values in zip((grid.u, grid.v), got):
            for n, place in enumerate(zip(*places)):
                low, part = [], []
                for a, x in zip(axes, place):
                    x = min(max(x, a[0]), a[-1])
                    k = max(min(int(np.searchsorted(a, x, "right")) - 1, len(a) - 2), 0)
                    low.append(k)
                    part.append((x - a[k]) / (a[k + 1] - a[k]) if len(a) > 1 else 0.0)
                want = sum(math.prod(f if d else 1 - f for f, d in zip(part, c)) * field[tuple(min(k + d, len(a) - 1) for k, d, a in zip(low, c, axes))] for c in np.ndindex(2, 2, 2))
                assert abs(values[n] - want) < 1e-12


def test_search_joins_no_spread_that_it_does_not_use(spark, monkeypatch):
    from tidemark.operators import drift
    from tidemark.plans import validate

    monkeypatch.setattr(drift, "moments", lambda *a: (_ for _ in ()).throw(AssertionError("spread")))
    calm = Grid(*(np.array([0.0, 1.0]),) * 3, *np.zeros((2, 2, 2, 2)))
    case = "named_struct('id', 'a', 't0', timestamp_ntz'2024-01-01', 'lat0', 10D, 'lon0', 85D, 'lat24', 10D, 'lon24', 85.1D, 'lat48', 10D, 'lon48', 85.2D, 'drogued', true)"
    found = spark.range(1).selectExpr(f"inline(array({case}))")
    out = validate.searched(found, calm, calm, [validate.Setting((0.0, 0.0), 0.0, 0.0, 1.0)], n=4).collect()
    assert {(r.h, round(r["median"], 2), r.n) for r in out} == {(24, 10.95, 1), (48, 21.9, 1)}


def test_nearest_points_go_down_the_tree_as_groups(spark, monkeypatch):
    """Groups of points, large ones dealt to several tasks and small ones cut further, against all distances; no row per point and cell is ordered on the way."""
    monkeypatch.setattr(joins, "DEALT", 40)
    monkeypatch.setattr(joins, "NEAR", 30)
    places = [(8 + 0.001 * (k * 37 % 101), -179.95 + 0.001 * (k * 53 % 97)) for k in range(900)] + [(-80 + 1.7 * k, (k * 77.7) % 360 - 180) for k in range(95)]
    points = [(math.degrees(math.asin(2 * (k * 7919 % 997) / 996 - 1)), (k * 104729 % 991) / 991 * 360 - 180) for k in range(400)] + [(8.05, 179.9)] * 200 + [(8 + 0.002 * k, -179.9) for k in range(60)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, 2.0)], "id long, lat double, lon double")
    found = joins.nearest_point(rows, spark.createDataFrame(places, "lat double, lon double"))
    got = {r.id: r.distance_km for r in found.collect()}
    assert got.pop(-1) is None and len(got) == len(points)
    assert all(abs(got[i] - min(haversine(*p, *q) for q in places)) < 1e-6 for i, p in enumerate(points))
    assert "Window" not in plan(found) and "MapInArrow" in plan(found)


def test_nearest_points_with_large_tables_fill_no_driver(spark, monkeypatch):
    """Tables of more rows than a join may broadcast go by no broadcast, however few bytes their files have; the distances are those by broadcast."""
    many = spark.range(300).selectExpr("id AS k")
    assert "BroadcastHashJoin" not in plan(spark.range(300).selectExpr("id AS k").join(scratch.if_small(scratch.settle(many), 200), "k"))
    points = spark.range(400).selectExpr("id", "4 + 19 * (id * 7919 % 1009) / 1009.0D AS lat", "79 + 17 * (id * 104729 % 1013) / 1013.0D AS lon")
    places = spark.range(3000).selectExpr("4 + 19 * (id * 15485863 % 1009) / 1009.0D AS lat", "79 + 17 * (id * 32452843 % 1013) / 1013.0D AS lon")
    want = {x.id: x.distance_km for x in joins.nearest_point(points, places).collect()}
    monkeypatch.setattr(joins, "CELLS", 0)
    monkeypatch.setattr(joins, "GROUPS", 0)
    found = joins.nearest_point(points, places)
    assert "BroadcastHashJoin" not in plan(found) and {x.id: x.distance_km for x in found.collect()} == want and len(want) == 400


def test_exact_quantiles_do_not_gather_a_group(spark, monkeypatch):
    """Quantiles of large groups by what lies around them against all values: spread ones, ties, a group of one value, one with nulls; the first guess may miss."""
    rows = spark.range(20_000).selectExpr("cast(id % 2 as int) AS g", "CASE WHEN id % 2 = 1 THEN floor(id % 7) ELSE ln(1 + id * 7919 % 10007) END AS x", "CASE WHEN id % 5 > 0 THEN id * 104729 % 10009 / 7.0D END AS y")
    rows = rows.union(spark.sql("SELECT 2, 3.25D, cast(null as double) UNION ALL SELECT 3, 1D, 1D UNION ALL SELECT 3, 2D, 4D"))
    wanted = {"median": ("x", 0.5), "p90": ("x", 0.9), "low": ("y", 0.001), "high": ("y", 1.0)}
    by = lambda df: {r.g: (r["median"], r["p90"], r["low"], r["high"]) for r in df.collect()}
    want = by(rows.groupBy("g").agg(*(F.percentile(c, p).alias(k) for k, (c, p) in wanted.items())))
    found = evaluate.quantiles(rows, ["g"], wanted)
    assert by(found) == want and "percentile(" in plan(found)
    monkeypatch.setattr(evaluate, "FEW", 1000)
    for aside in (0.004, 1e-6):
        monkeypatch.setattr(evaluate, "ASIDE", aside)
        found = evaluate.quantiles(rows, ["g"], wanted)
        assert by(found) == want and "percentile(" not in plan(found)


def test_search_without_cones_cuts_no_hulls(spark, monkeypatch):
    from tidemark.operators import drift
    from tidemark.plans import validate

    monkeypatch.setattr(drift, "hulls", lambda *a: (_ for _ in ()).throw(AssertionError("hulls")))
    field = Grid(*(np.array([0.0, 1.0]),) * 3, *np.zeros((2, 2, 2, 2)))
    case = "named_struct('id', 'a', 't0', timestamp_ntz'2024-01-01', 'lat0', 10D, 'lon0', 85D, 'lat24', 10D, 'lon24', 85.1D, 'lat48', 10D, 'lon48', 85.2D, 'drogued', true)"
    found = spark.range(1).selectExpr(f"inline(array({case}))")
    out = validate.searched(found, field, field, [validate.Setting((0.0, 0.0), 0.0, 0.0, 1.0)], n=4, cones=False)
    assert {(r.h, round(r["median"], 2), r.n) for r in out.collect()} == {(24, 10.95, 1), (48, 21.9, 1)} and "coverage" not in out.columns
