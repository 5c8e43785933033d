"""Spatial and temporal joins: nearest, within a radius, as of a time, shifted in time, and greedy proximity dedup."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import chord_km, haversine_km, unit_vector
from ..refdata import EARTH_KM, MOUTH_KM, RECURRENCE_KM
from .scratch import dealt, if_small, settle, spread


def nearest_in_dimension(points: DataFrame, dimension: DataFrame, columns: dict[str, str], lat: str = "lat", lon: str = "lon", most: int = 1_000) -> DataFrame:
    """points with the nearest row's columns (name there: name here) and distance_km; the first in `ord` wins ties.

    The dimension is a fixed list of at most `most` rows, counted here. It becomes one array literal of the plan, so each point is one row
    throughout: no join, no shuffle, and nothing to broadcast but the plan itself."""
    rows = dimension.orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the dimension has more than {most} rows; use nearest_point")
    names = list(columns)
    kind = dimension.schema
    entries = F.array(*(F.struct(F.lit(float(r["lat"])).alias("lat"), F.lit(float(r["lon"])).alias("lon"), F.lit(int(r["ord"])).alias("ord"), *(F.lit(r[c]).cast(kind[c].dataType).alias(c) for c in names)) for r in rows))
    measured = F.transform(entries, lambda e: F.struct(haversine_km(F.col(lat), F.col(lon), e["lat"], e["lon"]).alias("d"), e["ord"].alias("ord"), *(e[c].alias(c) for c in names)))
    best = points.withColumn("_best", F.array_min(measured))
    return best.select(*points.columns, *(F.col("_best")[c].alias(columns[c]) for c in names), F.col("_best.d").alias("distance_km"))


def nearest_mouth(points: DataFrame, mouths: DataFrame, near_km: float = MOUTH_KM) -> DataFrame:
    found = nearest_in_dimension(points, mouths, {"name": "mouth"})
    return found.withColumn("mouth", F.when(F.col("distance_km") <= near_km, F.col("mouth")).otherwise("other coastline"))


def sphere_cells(km: float) -> tuple[Callable[[Column], Column], Callable[..., Column]]:
    """(band of a latitude, cell of a band and longitude): bands are as high as km; a band is cut into equal cells of longitude, wide enough that whatever is
    within km lies in the cell or the ones beside it (step -1, 1), in its band or the ones beside that, around the globe."""
    size = math.degrees(km / EARTH_KM) * 1.0001
    reach = math.sin(km / EARTH_KM) * 1.0002

    def cell(band: Column, lon: Column, step: int = 0) -> Column:
        farthest = (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * size
        wide = F.when(farthest < 89, F.degrees(F.asin(F.least(F.lit(reach) / F.cos(F.radians(farthest)), F.lit(1.0))))).otherwise(360.0)
        n = F.greatest(F.floor(360.0 / wide), F.lit(1))
        return F.pmod(F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 360.0 * n), n - 1) + step, n)

    return lambda lat: F.floor(lat / size), cell


def to_neighbours(df: DataFrame, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df repeated for the nine cells (_cy, _cx) around each row's own."""
    band, cell = sphere_cells(km)
    out = df.withColumn("_cy", F.explode(F.sequence(band(F.col(lat)) - 1, band(F.col(lat)) + 1)))
    return out.withColumn("_cx", F.explode(F.array_distinct(F.array(*(cell(F.col("_cy"), F.col(lon), k) for k in (-1, 0, 1))))))


def within_radius(left: DataFrame, right: DataFrame, km: float, condition: Column | None = None) -> DataFrame:
    """Pairs of rows (columns of right with r_ in front) at most km apart, anywhere on the sphere, by an equi-join on cells and exact distances after.
    A right row is repeated for nine cells, so each pair meets in one. Chords of unit vectors, made before the join, drop what is clearly apart; only the rest is measured."""
    band, cell = sphere_cells(km)
    u, v = unit_vector(F.col("lat"), F.col("lon")), unit_vector(F.col("r_lat"), F.col("r_lon"))
    # a table of one file would be one task of pairs where the other side is broadcast
    near = spread(right).select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    near = to_neighbours(near.select("*", *(v[c].alias(f"_r{c}") for c in "xyz"), F.cos(F.radians("r_lat")).alias("_rcos")), km, "r_lat", "r_lon")
    own = left.select("*", *(u[c].alias(f"_l{c}") for c in "xyz"), F.cos(F.radians("lat")).alias("_lcos")).withColumn("_cy", band(F.col("lat")))
    gap = [F.col(f"_l{c}") - F.col(f"_r{c}") for c in "xyz"]
    reach = (2 * math.sin(min(km / EARTH_KM, math.pi) / 2)) ** 2 * (1 + 1e-6) + 1e-14  # more than what rounding may add
    pairs = own.withColumn("_cx", cell(F.col("_cy"), F.col("lon"))).join(near, ["_cy", "_cx"]).where(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= reach)
    if condition is not None:
        pairs = pairs.where(condition)
    pairs = pairs.withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"), (F.col("_lcos"), F.col("_rcos"))))
    return pairs.where(F.col("distance_km") <= km).drop("_cy", "_cx", "_lcos", "_rcos", *(f"_{n}{c}" for n in "lr" for c in "xyz"))


def persistence(hotspots: DataFrame, history: DataFrame, run: str, km: float = RECURRENCE_KM) -> DataFrame:
    """hotspots (id, lat, lon, ...) with persistence: the share of earlier runs that have a hotspot within km; 0 without earlier runs, and for a hotspot
    without a place. A run without places counts among the runs.

    Hotspots and each run's places are put into quarters of cells of km, kept as a ball each. A run whose ball in some cell lies within km of a whole
    cell of hotspots is settled for all of them by that row alone, however many places and hotspots there are. Only where a run reaches a cell's edge and settles it
    by no other cell are its distinct places there compared, with the cell's distinct places."""
    band, width, cell, quarter = _quarter_cells(km)
    place = [F.col(c).cast("double").alias(c) for c in ("lat", "lon")]
    at, of = ["cy", "cx", "cq"], ["dy", "dx", "dq"]
    celled = lambda df, y, x, q: df.withColumn(y, band(F.col("lat"))).withColumn(x, cell(F.col(y), F.col("lon"))).withColumn(q, quarter(F.col(y), F.col("lat"), F.col("lon")))
    spots = celled(hotspots.where("lat is not null and lon is not null").select(*place).distinct(), *at)
    past = celled(history.select(F.struct(run).alias("run"), *place), *of)
    runs = history.select(run).distinct().agg(F.count("*").alias("_runs"))
    own, there = _ball(spots, at, "c"), _ball(past.where("lat is not null and lon is not null"), [*of, "run"], "d")
    # the cells that a ball around the hotspots' may meet: bands beside it, and in each what a cap of that radius spans
    reach = (km * 1.0001 + F.col("c_km")) / EARTH_KM
    polar = F.abs(F.radians("c_lat")) + reach >= math.pi / 2
    span = F.when(polar, 360.0).otherwise(F.degrees(F.asin(F.least(F.sin(reach) / F.cos(F.radians("c_lat")), F.lit(1.0)))))
    high = F.degrees(reach)
    near = own.withColumn("_span", span).withColumn("dy", F.explode(F.sequence(band(F.col("c_lat") - high), band(F.col("c_lat") + high)))).withColumn("_n", width(F.col("dy")))
    first, last = (F.floor((F.pmod("c_lon", F.lit(360.0)) + s * F.col("_span")) / 360.0 * F.col("_n")) for s in (-1, 1))
    near = near.withColumn("dx", F.explode(F.sequence(first, F.least(last, first + F.col("_n") - 1)))).withColumn("dx", F.pmod("dx", "_n"))
    d = haversine_km(F.col("c_lat"), F.col("c_lon"), F.col("d_lat"), F.col("d_lon"))
    slack = 1e-6  # kilometres: what rounding may add to a bound is left to the exact comparison
    met = near.join(there, ["dy", "dx"]).withColumn("_d", d).where(F.col("_d") - F.col("c_km") - F.col("d_km") <= km + slack)
    whole = F.col("_d") + F.col("c_km") + F.col("d_km") <= km - slack
    # a run has a few cells at most around one cell
    met = settle(met.groupBy(*at, "run").agg(F.max(whole).alias("whole"), F.collect_list(F.struct(*of)).alias("cells")), "covers")
    covered = met.where("whole").groupBy(*at).agg(F.count("*").alias("_whole"))
    edges = met.where("not whole").select(*at, "run", F.explode("cells").alias("d")).select(*at, "run", "d.*")
    places = past.select("run", *of, F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).distinct()
    pairs = edges.join(places, [*of, "run"]).join(spots, at).where(haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= km)
    edge = pairs.groupBy("lat", "lon", "run").agg(F.lit(1).alias("one")).groupBy("lat", "lon").agg(F.count("*").alias("_edge"))
    hits = spots.join(covered, at, "left").join(edge, ["lat", "lon"], "left")
    hits = hits.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), (F.coalesce("_whole", F.lit(0)) + F.coalesce("_edge", F.lit(0))).alias("_hits")).where("_hits > 0")
    share = F.when(F.col("_runs") > 0, F.coalesce("_hits", F.lit(0)) / F.col("_runs")).otherwise(0.0)
    out = hotspots.join(hits, (F.col("lat").cast("double") == F.col("_lat")) & (F.col("lon").cast("double") == F.col("_lon")), "left")
    return out.crossJoin(F.broadcast(runs)).withColumn("persistence", share).drop("_hits", "_runs", "_lat", "_lon")  # runs: one row


def _quarter_cells(km: float) -> tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column], Callable[[Column, Column, Column], Column]]:
    """(band of a latitude, cells of a band, cell of a band and longitude, quarter of that cell): about km each way."""
    size = math.degrees(km / EARTH_KM)

    def width(band: Column) -> Column:
        widest = F.least(F.abs(band), F.abs(band + 1)) * size
        return F.greatest(F.floor(360.0 / size * F.cos(F.radians(F.least(widest, F.lit(90.0))))), F.lit(1))

    def cell(band: Column, lon: Column, parts: int = 1) -> Column:
        return F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 360.0 * width(band) * parts), width(band) * parts - 1)

    quarter = lambda band, lat, lon: F.pmod(F.floor(lat / size * 2), F.lit(2)) * 2 + F.pmod(cell(band, lon, 2), F.lit(2))
    return lambda lat: F.floor(lat / size), width, cell, quarter


def _ball(places: DataFrame, by: list[str], name: str) -> DataFrame:
    """The places (lat, lon) of each group within one cell as a ball around the middle of their box: <name>_lat, <name>_lon, <name>_km. No place of a
    box of latitude and longitude is farther from its middle than a corner."""
    east = F.pmod("lon", F.lit(360.0))
    box = places.groupBy(*by).agg(F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min(east).alias("_w"), F.max(east).alias("_e"))
    lat, lon = (F.col("_s") + F.col("_n")) / 2, (F.col("_w") + F.col("_e")) / 2
    corner = F.greatest(*(haversine_km(lat, lon, F.col(c), F.col("_e")) for c in ("_s", "_n")))
    return box.select(*by, lat.alias(f"{name}_lat"), lon.alias(f"{name}_lon"), corner.alias(f"{name}_km"))


#: Cells of a level go by FAN along each axis of the cube around the unit sphere; a cell of at most LEAF places is not cut further; levels counted at once, deepest one.
FAN, LEAF, AT_ONCE, DEEPEST = 4, 24, 8, 22
CELL = "struct<x: long, y: long, z: long>"


def _cell(level: Column, of: dict[str, Column]) -> Column:
    per = F.pow(F.lit(float(FAN)), level)
    return F.struct(*(F.least(F.floor((of[c] + 1) / 2 * per), per - 1).cast("long").alias(c) for c in "xyz"))


def cell_tree(targets: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """A tree of cells over targets (lat, lon) anywhere on the sphere. The cells divide the cube around the unit sphere, so poles and the 180th meridian are
    places like any other, and only cells with more than `leaf` distinct places are cut again.

    Returns the cells (level, parent, cell, open, the box of the cell's places, one of them), the places by their last cell (level, cell, t_lat, t_lon), and how many
    cells a level has. Some levels are counted at once, with sums before the shuffle; only places in cells still open go on to deeper ones."""
    u = unit_vector(F.col("t_lat"), F.col("t_lon"))
    places = targets.where("lat is not null and lon is not null").select(F.col("lat").cast("double").alias("t_lat"), F.col("lon").cast("double").alias("t_lon")).distinct()
    rest = settle(places.select("*", *(u[c].alias(c) for c in "xyz")), "places")
    xyz = {c: F.col(c) for c in "xyz"}
    box = [f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]
    parent = F.struct(*(F.floor(F.col(f"cell.{c}") / FAN).cast("long").alias(c) for c in "xyz"))
    cells = ends = None
    for first in range(1, DEEPEST + 1, AT_ONCE):
        last = min(first + AT_ONCE, DEEPEST + 1) - 1
        celled = rest.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("cell", _cell(F.col("level"), xyz))
        counted = celled.groupBy("level", "cell").agg(F.count("*").alias("n"), *box, F.min(F.struct("x", "y", "z")).alias("one")).withColumn("parent", parent)
        counted = settle(counted.withColumn("open", (F.col("n") > leaf) & (F.col("level") < DEEPEST)), "cells")
        opened = counted.where("open").select((F.col("level") + 1).alias("level"), F.col("cell").alias("parent"))
        new = counted.where(F.col("level") == first).union(counted.where(F.col("level") > first).join(dealt(opened), ["level", "parent"], "left_semi").select(counted.columns))
        new = settle(new, "tree")
        cells = new if cells is None else cells.union(new)
        done = celled.join(dealt(new.where("not open").select("level", "cell")), ["level", "cell"], "left_semi").select("level", "cell", "t_lat", "t_lon")
        ends = done if ends is None else ends.union(done)
        deeper = new.where(F.col("open") & (F.col("level") == last)).select("cell")
        if deeper.isEmpty():
            break
        rest = settle(celled.where(F.col("level") == last).join(if_small(settle(deeper, "open"), GROUPS), "cell", "left_semi").select("t_lat", "t_lon", "x", "y", "z"), "places")
    return cells, settle(ends, "ends"), {r.level: r["n"] for r in cells.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row per level


#: Points are counted in cells of BASE levels at once; a group of points is compared with its cells' places once these are NEAR at most, or where it has FEW
#: points and its cells can't be opened further; DEALT points of a group or so meet its places in one task.
BASE, NEAR, FEW, DEALT = 4, 512, 16, 20_000
#: Most rows of a level's cells with their boxes, and of groups, that a join may broadcast: several levels' tables are in the driver's memory at once.
CELLS, GROUPS = 10_000, 40_000


def nearest_point(points: DataFrame, targets: DataFrame, leaf: int = LEAF) -> DataFrame:
    """points (id, lat, lon) with the great-circle distance to the nearest of many targets (coastline points), anywhere on the sphere: distance_km.

    Groups of points go down the targets' tree of cells, not points: a group is a cell with the box of its points. Of the cells in hand it keeps those whose box may
    hold something as near to any of its points as one known place is to all of them. Group and cells are cut further until few places are left; then the group's points
    meet these in batches. Tables of groups and cells grow with the groups, and points are read a few times and shuffled once; nothing is missed, as a group that is
    far from everything, or sees many places as equally near, is cut down to single places. Large groups are dealt to several tasks.

    A point without a place, and every point where there is no target, has no distance."""
    cells, ends, sizes = cell_tree(targets, leaf)
    there = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    none = F.lit(None).cast("double").alias("distance_km")
    if not sizes:
        return there.select("id", none)
    u, v = unit_vector(F.col("lat"), F.col("lon")), unit_vector(F.col("t_lat"), F.col("t_lon"))
    placed = settle(there.where("lat is not null and lon is not null").select("id", *(u[c].alias(c) for c in "xyz")), "points")
    number = {c: F.nanvl(F.col(c), F.lit(0.0)) for c in "xyz"}  # what is no number has no place among others, and moves none
    at = lambda k: _cell(F.lit(k), number)
    above = lambda cell, by: F.struct(*(F.floor(F.col(f"{cell}.{c}") / by).cast("long").alias(c) for c in "xyz"))
    sides = [(c, f"lo_{c}", f"hi_{c}") for c in "xyz"]
    boxes = lambda of: [f(of(c, n)).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]
    base = settle(placed.groupBy(at(BASE).alias("cell")).agg(F.count("*").alias("points"), *boxes(lambda c, n: number[c])), "groups")
    square = lambda d: d * d
    box = ["level", "cell", "n", "open", "one", *(n for _, lo, hi in sides for n in (lo, hi))]
    root = F.struct(*(F.lit(0).cast("long").alias(c) for c in "xyz"))
    now, rest, ready = None, placed, []
    for k in range(1, DEEPEST + 1):
        if k <= BASE:
            kids = base.groupBy(above("cell", FAN ** (BASE - k)).alias("kid")).agg(F.sum("points").alias("points"), *boxes(lambda c, n: F.col(f"{n}_{c}")))
        else:
            rest = settle(rest.join(if_small(settle(more.select("group").distinct(), "open"), GROUPS), at(k - 1) == F.col("group"), "left_semi"), "points")  # noqa: F821
            kids = rest.groupBy(at(k).alias("kid")).agg(F.count("*").alias("points"), *boxes(lambda c, n: number[c]))
        kids = kids.select("kid", above("kid", FAN).alias("group"), "points", *(F.col(n).alias(f"p_{n}") for _, lo, hi in sides for n in (lo, hi)))
        table = cells.where(F.col("level") == k).select(F.col("parent"), *box)
        if now is None:
            seen = table.select(root.alias("group"), F.lit(3.0).alias("bound"), *box)
        else:
            seen = more.where("not open").select("group", "bound", *box)  # noqa: F821
            if k in sizes:
                opened = more.where("open").select("group", "bound", F.col("cell").alias("parent"))  # noqa: F821
                seen = seen.union(opened.join(F.broadcast(table) if sizes[k] <= CELLS else dealt(table), "parent").select("group", "bound", *box))
        apart = F.sqrt(sum((square(F.greatest(F.col(lo) - F.col(f"p_{hi}"), F.col(f"p_{lo}") - F.col(hi), F.lit(0.0))) for _, lo, hi in sides), F.lit(0.0)))
        within = F.sqrt(sum((square(F.greatest(F.abs(F.col(f"p_{hi}") - F.col(f"one.{c}")), F.abs(F.col(f"p_{lo}") - F.col(f"one.{c}")))) for c, lo, hi in sides), F.lit(0.0)))
        single = sum((F.col(f"p_{hi}") - F.col(f"p_{lo}") for _, lo, hi in sides), F.lit(0.0)) == 0
        each = Window.partitionBy("kid")
        met = seen.join(dealt(kids), "group").select("kid", "points", single.alias("single"), "bound", apart.alias("apart"), within.alias("within"), *box).where(F.col("apart") <= F.col("bound") + 1e-12)
        met = met.withColumn("bound", F.least("bound", F.min("within").over(each))).where(F.col("apart") <= F.col("bound") + 1e-12)
        met = met.withColumn("places", F.sum("n").over(each)).withColumn("any_open", F.max("open").over(each))
        enough = (F.col("places") <= NEAR) | (~F.col("any_open") & ((F.col("points") <= FEW) | F.col("single"))) | F.lit(k == DEEPEST)
        now = settle(met.select(F.col("kid").alias("group"), "points", "bound", enough.alias("enough"), *box), "met")
        ready.append((k, now.where("enough"), rest))
        more = now.where("not enough")
        if more.isEmpty():
            break
    return _met(ready, base, above, at, ends.select(*(v[c].alias(c) for c in "xyz")), min(k, max(sizes))).union(there.where("lat is null or lon is null").select("id", none))


def _met(ready: list, base: DataFrame, above: Callable, at: Callable, places: DataFrame, last: int) -> DataFrame:
    """(id, distance_km) of all points, by the groups that each level has made ready: (level, rows of groups and their cells, the points that hold them)."""
    pairs = None
    for k, rows, _ in ready:
        own = rows.select(F.lit(k).alias("k"), "group", "points", "level", "cell")
        pairs = own if pairs is None else pairs.union(own)
    groups = settle(pairs.groupBy("k", "group").agg(F.ceil(F.first("points") / DEALT).cast("int").alias("parts")).withColumn("g", F.monotonically_increasing_id()), "ready")
    early = None
    for k in range(1, BASE + 1):
        own = base.select("cell", above("cell", FAN ** (BASE - k)).alias("group")).join(dealt(groups.where(F.col("k") == k).select("group", "g", "parts")), "group").select("cell", "g", "parts")
        early = own if early is None else early.union(own)
    points = None
    for k, of, rest in [(BASE, early, ready[0][2]), *((k, groups.where(F.col("k") == k).select(F.col("group").alias("cell"), "g", "parts"), rest) for k, _, rest in ready if k > BASE)]:
        own = rest.join(if_small(settle(of, "dealt"), GROUPS), at(k) == F.col("cell"))
        own = own.select("g", F.pmod(F.xxhash64("id", "x", "y", "z"), "parts").cast("int").alias("part"), F.lit(1).alias("own"), "id", "x", "y", "z")
        points = own if points is None else points.union(own)
    celled = places.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(last)))).withColumn("cell", _cell(F.col("level"), {c: F.col(c) for c in "xyz"}))
    wanted = pairs.join(dealt(groups), ["k", "group"]).select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "level", "cell")
    sent = wanted.join(dealt(celled), ["level", "cell"]).select("g", "part", F.lit(0).alias("own"), F.lit(None).cast(points.schema["id"].dataType).alias("id"), "x", "y", "z")
    both = sent.union(points).repartition("g", "part").sortWithinPartitions("g", "part", "own")
    found = both.mapInArrow(_least_squares, T.StructType([points.schema["id"], T.StructField("_square", T.DoubleType())]))
    return found.select("id", chord_km(F.sqrt("_square")).alias("distance_km"))


def _least_squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, squared chord to the nearest place) of rows with own 1; their group's places (own 0) come before them."""
    key, held = None, []
    for b in batches:
        g, part, own, *xyz = (b.column(c).to_numpy() for c in ("g", "part", "own", "x", "y", "z"))
        square = np.empty(len(g))
        cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(part) != 0) | (np.diff(own) != 0)) + 1 if len(g) else []
        for i, j in zip([0, *cuts], [*cuts, len(g)]):
            if i == j:
                continue
            if key != (g[i], part[i]):
                key, held = (g[i], part[i]), []
            if not own[i]:
                held.append([c[i:j] for c in xyz])
                continue
            if len(held) > 1:
                held = [[np.concatenate(c) for c in zip(*held)]]
            step = max((1 << 16) // len(held[0][0]), 1)
            for a in range(i, j, step):
                e = min(a + step, j)
                d = 0.0
                for c, t in zip(xyz, held[0]):
                    gap = c[a:e, None] - t
                    gap *= gap
                    d = gap + d if isinstance(d, float) else np.add(d, gap, out=d)
                square[a:e] = d.min(1)
        mine = own == 1
        if mine.any():
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(mine)), pa.array(square[mine])], names=["id", "_square"])


def nearest_in_time(times: DataFrame, slices: DataFrame) -> DataFrame:
    """times (id, at seconds) with the key k of the nearest slice (k, t seconds) at any distance, the first on ties. Both meet by the slices'
    order: a union sorted by time carries the last slice forwards and the next one backwards within days, and a row per day carries both
    across days. Times without a value, and all times where there is no slice, have no key."""
    day = lambda c: F.floor(F.col(c) / 86_400).alias("_day")
    one = slices.where("t is not null").groupBy("t").agg(F.min("k").alias("k")).select(day("t"), F.struct("t", "k").alias("_s"), F.col("t").alias("_at"))
    asked = times.select("id", "at").distinct().select("id", "at", day("at"), F.col("at").alias("_at"))
    both = asked.unionByName(one, allowMissingColumns=True)
    upward, downward = Window.partitionBy("_day").orderBy("_at"), Window.partitionBy("_day").orderBy(F.desc("_at"))
    to = (Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_last", F.max("_s").over(upward.rangeBetween(*to))).withColumn("_next", F.min("_s").over(downward.rangeBetween(*to))).where("_s is null").drop("_s", "_at")
    days = both.where("_day is not null").groupBy("_day").agg(F.max("_s").alias("_hi"), F.min("_s").alias("_lo"))  # a row per day
    days = days.select("_day", F.max("_hi").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_lo").over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    found = lambda c: F.when(F.col("at").isNotNull() & F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.t")).alias("gap"), F.col(f"{c}.t").alias("t"), F.col(f"{c}.k").alias("k")))
    best = near.join(days, "_day", "left").withColumn("b", F.least(*(found(c) for c in ("_before", "_last", "_next", "_after"))))
    return best.select("id", "at", F.col("b.k").alias("k"), F.col("b.gap").alias("gap"))


def time_shifted(track: DataFrame, key: str, time: str, shifts: tuple[int, ...], unit: str = "day") -> DataFrame:
    """Rows of a track whose key also has a row at each shift (in whole units) later: columns of those rows end in _<shift>."""
    out = track
    for s in shifts:
        later = track.select(F.col(key), F.expr(f"{time} - make_dt_interval({s if unit == 'day' else 0}, {s if unit == 'hour' else 0})").alias(time), *(F.col(c).alias(f"{c}_{s}") for c in track.columns if c not in (key, time)))
        out = out.join(later, [key, time])
    return out


def greedy_dedup(rows: DataFrame, order: list[str], km: float = RECURRENCE_KM, near: DataFrame | None = None) -> DataFrame:
    """Proximity dedup of rows (id, lat, lon, observed, ...) in an order of columns (descending with a - in front; ids are unique): a row within km of one already
    kept is absorbed by the first such, others are kept. Returns the kept rows with seen (distinct observed values of what each stands for).

    The rule is sequential, yet a row is settled once all earlier rows near it are: it is absorbed if one of them is kept, and kept if none is
    left. Each round settles all such rows by equi-joins over the near pairs, so a region of any size spreads over tasks; rounds grow with the longest
    chain of rows that wait for each other. near: the pairs (id, r_id, each once) of rows within km, where they are known already; rows are then not compared."""
    kinds = dict(rows.dtypes)

    def key(c: str) -> Column:
        name = c.lstrip("-")
        x = F.unix_micros(F.col(name).cast("timestamp")) if kinds[name].startswith("timestamp") else F.col(name)
        return (-x if c.startswith("-") else x).alias(name)

    places = settle(rows.select("id", "lat", "lon", F.struct(*(key(c) for c in order)).alias("o")), "places")
    if near is None:
        found = within_radius(places, places, km, F.col("r_o") < F.col("o"))
    else:
        both = near.select("id", "r_id").union(near.select("r_id", "id"))
        of = places.select("id", "o")
        found = both.join(of, "id").join(of.select(F.col("id").alias("r_id"), F.col("o").alias("r_o")), "r_id").where("r_o < o")
    pairs = settle(found.select("id", "r_id", "r_o"), "pairs")
    left, waiting = pairs.select("id", "r_id"), places.select("id")
    done = None
    while True:
        new = settle(waiting.join(left.select("id").distinct(), "id", "left_anti"), "kept")
        done = new if done is None else done.union(new)
        gone = settle(left.join(new.withColumnRenamed("id", "r_id"), "r_id", "left_semi").select("id").distinct(), "absorbed")
        waiting = settle(waiting.join(new.union(gone), "id", "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        left = settle(left.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "r_id"), "r_id", "left_anti"), "left")
    kept = settle(done, "kept")
    owner = pairs.join(kept.withColumnRenamed("id", "r_id"), "r_id", "left_semi").groupBy("id").agg(F.min(F.struct("r_o", "r_id"))["r_id"].alias("owner"))
    owner = owner.join(kept, "id", "left_anti").union(kept.select("id", F.col("id").alias("owner")))
    seen = rows.select("id", "observed").join(owner, "id").groupBy(F.col("owner").alias("id")).agg(F.count_distinct("observed").alias("seen"))
    return rows.join(seen, "id").select(*rows.columns, "seen")


def by_priority(sources: DataFrame, key: list[str], priority: str) -> DataFrame:
    """Of each key, the rows of the source with the best (lowest) priority that has any."""
    best = sources.groupBy(*key).agg(F.min(priority).alias("_best"))
    return sources.join(best, key).where(F.col(priority) == F.col("_best")).drop("_best")


def missing_from(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return wanted.join(cached.select(key).distinct(), key, "left_anti")
