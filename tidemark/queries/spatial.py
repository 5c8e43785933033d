"""Queries on places: distances, nearest, radius, containment, time joins, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import refdata
from ..functions import geo
from ..functions.numeric import clip, round_many
from ..operators import decide, evaluate, joins
from ..operators.raster import mad_z
from .views import Source, query

#: Great-circle distance in SQL.
KM = "(2 * 6371.0 * asin(least(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)), 1.0)))"


def km(a: str, b: str, c: str, d: str) -> str:
    return KM.format(a=a, b=b, c=c, d=d)


NEAREST_SITE = f"""(SELECT z.*, s.name AS site, s.type, s.weight, s.km FROM ({{rows}}) z CROSS JOIN LATERAL
  (SELECT name, type, weight, {km("z.lat", "z.lon", "t.lat", "t.lon")} AS km FROM sites19 t ORDER BY km, ord LIMIT 1) s)"""

RISK_RANK = f"""
WITH m AS (SELECT user_id, median(value) AS mid FROM obs GROUP BY user_id),
d AS (SELECT user_id, median(abs(value - mid)) AS mad, stddev_pop(value - mid) AS sd FROM obs JOIN m USING (user_id) GROUP BY user_id),
z AS (SELECT o.*, round((value - mid) / ((CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END) + 1e-9), 6) AS z FROM obs o JOIN m USING (user_id) JOIN d USING (user_id)),
n AS {NEAREST_SITE.format(rows="SELECT * FROM z WHERE z >= 3.5")},
r AS (SELECT *, round(100 * (0.35 * least(greatest(log10(z / 3.5) / 1.5, 0), 1) + 0.25 * (weight * exp(-km / 60.0))), 4) AS risk FROM n)
SELECT event_id, user_id, site, round(km, 4) AS site_km, z, risk, CASE WHEN risk >= 60 THEN 'High' WHEN risk >= 40 THEN 'Medium' ELSE 'Low' END AS tier,
  CAST(row_number() OVER (ORDER BY risk DESC, event_id) AS int) AS rank FROM r ORDER BY risk DESC, event_id LIMIT 25
"""


@query("risk_rank", RISK_RANK)
def risk_rank(s: Source) -> DataFrame:
    """The flagship: robust anomalies by user, nearest site, weighted risk, tier and the 25 first."""
    obs = s.view("obs").withColumn("valid", F.lit(True))
    obs = obs.join(obs.groupBy("user_id").agg(F.median("value").alias("usual")), "user_id")
    hot = mad_z(obs, "value", "usual", by="user_id").withColumn("z", F.round("z", 6)).where(F.col("z") >= refdata.Z_THRESHOLD)
    near = joins.nearest_in_dimension(hot, refdata.sites(s.spark), {"name": "site", "weight": "weight"})
    parts = {"confidence": clip(F.log10(F.col("z") / 3.5) / 1.5, 0, 1), "proximity": F.col("weight") * F.exp(-F.col("distance_km") / 60.0)}
    scored = near.withColumn("risk", F.round(decide.weighted(parts), 4)).orderBy(F.desc("risk"), "event_id").limit(refdata.MAX_HOTSPOTS)
    out = decide.ranked(scored.withColumn("run", F.lit("all")), order="risk", tie="event_id")
    return out.select("event_id", "user_id", "site", F.round("distance_km", 4).alias("site_km"), "z", "risk", decide.tier(F.col("risk")).alias("tier"), "rank")


@query("haversine_ports", f"SELECT o.event_id, p.name AS port, round({km('o.lat', 'o.lon', 'p.lat', 'p.lon')}, 4) AS km FROM obs o CROSS JOIN ports8 p")
def haversine_ports(s: Source) -> DataFrame:
    ports = evaluate.parameter_grid(s.view("obs").select("event_id", "lat", "lon"), refdata.ports(s.spark).select(F.col("name").alias("port"), F.col("lat").alias("plat"), F.col("lon").alias("plon")))
    return ports.select("event_id", "port", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")), 4).alias("km"))


@query("nearest_site", f"SELECT event_id, site, type, weight, round(km, 4) AS km FROM {NEAREST_SITE.format(rows='SELECT event_id, lat, lon FROM obs')}")
def nearest_site(s: Source) -> DataFrame:
    near = joins.nearest_in_dimension(s.view("obs").select("event_id", "lat", "lon"), refdata.sites(s.spark), {"name": "site", "type": "type", "weight": "weight"})
    return near.select("event_id", "site", "type", "weight", F.round("distance_km", 4).alias("km"))


@query("river_share", f"""
WITH n AS (SELECT o.user_id % 20 AS id, (SELECT CASE WHEN {km("o.lat", "o.lon", "t.lat", "t.lon")} <= 60 THEN t.name ELSE 'other coastline' END FROM mouths12 t ORDER BY {km("o.lat", "o.lon", "t.lat", "t.lon")}, t.ord LIMIT 1) AS mouth FROM obs o),
c AS (SELECT id, mouth, count(*) AS n FROM n GROUP BY id, mouth), t AS (SELECT id, sum(n) AS total FROM c GROUP BY id)
SELECT id, mouth, share FROM (SELECT c.id, mouth, round(0.5 * n / total, 3) AS share, row_number() OVER (PARTITION BY c.id ORDER BY round(0.5 * n / total, 3) DESC, mouth) AS k FROM c JOIN t ON c.id = t.id) z WHERE k <= 3""")
def river_share(s: Source) -> DataFrame:
    beach = s.view("obs").select((F.col("user_id") % 20).alias("id"), "lat", "lon")
    shares = decide.source_shares(beach, beach.select("id").distinct().withColumn("coastal_fraction", F.lit(0.5)), refdata.mouths(s.spark))
    return shares.select("id", F.explode("sources").alias("x")).select("id", F.col("x.name").alias("mouth"), F.col("x.share").alias("share"))


@query("radius_pairs", f"SELECT a.event_id AS a, b.event_id AS b, round({km('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) AS km FROM obs a JOIN obs b ON a.event_id < b.event_id AND abs(a.lat - b.lat) < 0.2 WHERE {km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 15")
def radius_pairs(s: Source) -> DataFrame:
    o = s.view("obs").select("event_id", "lat", "lon")
    return joins.within_radius(o, o, refdata.RECURRENCE_KM, F.col("event_id") < F.col("r_event_id")).select(F.col("event_id").alias("a"), F.col("r_event_id").alias("b"), round_many(F.col("distance_km"), 4).alias("km"))


@query("persistence_fraction", f"""
WITH h AS (SELECT CAST(date_trunc('day', ts) AS date) AS run, lat, lon FROM obs WHERE event_type <> 'error'), n AS (SELECT count(DISTINCT run) AS n FROM h),
k AS (SELECT o.event_id, count(DISTINCT h.run) AS hits FROM obs o JOIN h ON abs(o.lat - h.lat) < 0.2 AND {km('o.lat', 'o.lon', 'h.lat', 'h.lon')} <= 15 WHERE o.event_type = 'error' GROUP BY o.event_id)
SELECT o.event_id AS id, round(coalesce(hits, 0) / CAST(n AS double), 6) AS persistence FROM obs o CROSS JOIN n LEFT JOIN k ON o.event_id = k.event_id WHERE o.event_type = 'error'""")
def persistence_fraction(s: Source) -> DataFrame:
    o = s.view("obs")
    history = o.where("event_type <> 'error'").select(F.to_date(F.date_trunc("day", "ts")).alias("run"), "lat", "lon")
    found = joins.persistence(o.where("event_type = 'error'").select(F.col("event_id").alias("id"), "lat", "lon"), history, "run")
    return found.select("id", F.round("persistence", 6).alias("persistence"))


COAST = "SELECT c_custkey AS k, 4 + 19 * (((c_custkey * 15485863) % 1009) / CAST(1009 AS double)) AS lat, 79 + 17 * (((c_custkey * 32452843) % 1013) / CAST(1013 AS double)) AS lon FROM customer"


@query("coast_distance", f"""
WITH coast AS ({COAST}) SELECT s_suppkey AS id, round(min({km("p.lat", "p.lon", "c.lat", "c.lon")}), 3) AS km FROM
  (SELECT s_suppkey, 4 + 19 * (((s_suppkey * 7919) % 1009) / CAST(1009 AS double)) AS lat, 79 + 17 * (((s_suppkey * 104729) % 1013) / CAST(1013 AS double)) AS lon FROM supplier) p CROSS JOIN coast c GROUP BY s_suppkey""")
def coast_distance(s: Source) -> DataFrame:
    points = s.sql("SELECT s_suppkey AS id, 4 + 19 * (((s_suppkey * 7919) % 1009) / CAST(1009 AS double)) AS lat, 79 + 17 * (((s_suppkey * 104729) % 1013) / CAST(1013 AS double)) AS lon FROM supplier")
    return joins.nearest_point(points, s.sql(COAST)).select("id", F.round("distance_km", 3).alias("km"))


#: Places all over the sphere, poles and the 180th meridian among them.
ANYWHERE = "SELECT event_id AS k, degrees(asin(2 * (((event_id * 7919) % 10007) / CAST(10006 AS double)) - 1)) AS lat, 360 * (((event_id * 104729) % 10009) / CAST(10009 AS double)) - 180 AS lon FROM events"
SHORES = "SELECT c_custkey AS k, degrees(asin(2 * (((c_custkey * 15485863) % 1009) / CAST(1008 AS double)) - 1)) AS lat, 180 - ((c_custkey * 32452843) % 1013) * CAST(0.0419732461 AS double) * CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 8 END AS lon FROM customer WHERE c_nationkey < 5"


@query("coast_distance_anywhere", f"""
WITH p AS ({ANYWHERE}), coast AS ({SHORES}) SELECT p.k AS id, round(min({km("p.lat", "p.lon", "c.lat", "c.lon")}), 3) AS km FROM p CROSS JOIN coast c GROUP BY p.k""")
def coast_distance_anywhere(s: Source) -> DataFrame:
    return joins.nearest_point(s.sql(ANYWHERE).withColumnRenamed("k", "id"), s.sql(SHORES)).select("id", F.round("distance_km", 3).alias("km"))


@query("bearings", """
WITH b AS (SELECT o.event_id, p.name AS port, (degrees(atan2((p.lon - o.lon) * cos(radians((o.lat + p.lat) / 2)), p.lat - o.lat)) + 360) % 360 AS plane,
  (degrees(atan2(sin(radians(p.lon - o.lon)) * cos(radians(p.lat)), cos(radians(o.lat)) * sin(radians(p.lat)) - sin(radians(o.lat)) * cos(radians(p.lat)) * cos(radians(p.lon - o.lon)))) + 360) % 360 AS sphere
  FROM obs o CROSS JOIN ports8 p)
SELECT event_id, port, list_extract(['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'], CAST(floor((plane + 22.5) / 45) AS int) % 8 + 1) AS towards, round(sphere, 4) AS sphere FROM b""")
def bearings(s: Source) -> DataFrame:
    ports = refdata.ports(s.spark).select(F.col("name").alias("port"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    g = evaluate.parameter_grid(s.view("obs").select("event_id", "lat", "lon"), ports)
    a = (F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return g.select("event_id", "port", geo.bearing_text(*a).alias("towards"), F.round(geo.spherical_bearing(*a), 4).alias("sphere"))


RING = [(8.0, 82.0), (9.0, 92.0), (14.0, 94.0), (20.0, 90.0), (17.0, 84.0)]
_edges = " UNION ALL ".join(f"SELECT {a[0]} AS alat, {a[1]} AS alon, {b[0]} AS blat, {b[1]} AS blon" for a, b in zip(RING, RING[1:] + RING[:1]))


@query("point_in_ring", f"""
WITH e AS ({_edges}) SELECT event_id, coalesce(sum(CASE WHEN (alat > lat) <> (blat > lat) AND lon < alon + (lat - alat) / nullif(blat - alat, 0.0) * (blon - alon) THEN 1 ELSE 0 END), 0) % 2 = 1 AS inside FROM obs CROSS JOIN e GROUP BY event_id""")
def point_in_ring(s: Source) -> DataFrame:
    return s.view("obs").select("event_id", geo.on_land(F.col("lat"), F.col("lon"), [RING]).alias("inside"))


@query("cone_coverage", f"""
WITH e AS ({_edges}), i AS (SELECT user_id % 10 AS grp, event_id, sum(CASE WHEN (alat > lat) <> (blat > lat) AND lon < alon + (lat - alat) / nullif(blat - alat, 0.0) * (blon - alon) THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM obs CROSS JOIN e GROUP BY user_id % 10, event_id)
SELECT grp, round(avg(CASE WHEN inside THEN 1 ELSE 0 END), 6) AS coverage, count(*) AS n FROM i GROUP BY grp""")
def cone_coverage(s: Source) -> DataFrame:
    o = s.view("obs").withColumn("grp", F.col("user_id") % 10)
    c = evaluate.coverage(o, ["grp"], geo.on_land(F.col("lat"), F.col("lon"), [RING]))
    return c.select("grp", F.round("coverage", 6).alias("coverage"), "n")


@query("shoelace_area", """
WITH p AS (SELECT s_suppkey AS id, 10 + s_suppkey % 7 AS y, 85 + s_suppkey % 5 AS x, 0.5 + s_suppkey % 3 AS h, 1.0 + s_suppkey % 4 AS w FROM supplier)
SELECT id, round(h * w * 111.32 * 111.32 * cos(radians(y + h / 2)), 3) AS km2 FROM p""")
def shoelace_area(s: Source) -> DataFrame:
    p = s.sql("SELECT s_suppkey AS id, CAST(10 + s_suppkey % 7 AS double) AS y, CAST(85 + s_suppkey % 5 AS double) AS x, CAST(0.5 + s_suppkey % 3 AS double) AS h, CAST(1.0 + s_suppkey % 4 AS double) AS w FROM supplier")
    corner = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    y, x, h, w = (F.col(c) for c in "yxhw")
    ring = F.array(corner(y, x), corner(y, x + w), corner(y + h, x + w), corner(y + h, x))
    return p.select("id", F.round(geo.ring_area_km2(ring), 3).alias("km2"))


@query("leg_crosses_land", f"""
WITH e AS ({_edges}), l AS (SELECT o.event_id, p.name AS port, o.lat AS a, o.lon AS b, p.lat AS c, p.lon AS d, {km("o.lat", "o.lon", "p.lat", "p.lon")} AS km FROM obs o CROSS JOIN ports8 p),
f AS (SELECT event_id, port, km >= 12 AND list_bool_or([list_aggregate([{{inside}}], 'sum') % 2 = 1 FOR k IN range(25)]) AS crosses FROM l)
SELECT event_id, port, crosses FROM f""".replace("{inside}", ", ".join(
    "CASE WHEN ({a0} > {y}) <> ({b0} > {y}) AND {x} < {a1} + ({y} - {a0}) / ({b0} - {a0}) * ({b1} - {a1}) THEN 1 ELSE 0 END".format(a0=p[0], a1=p[1], b0=q[0], b1=q[1], y="(a + (6.0 / km + (1 - 12.0 / km) * k / 24) * (c - a))", x="(b + (6.0 / km + (1 - 12.0 / km) * k / 24) * (d - b))")
    for p, q in zip(RING, RING[1:] + RING[:1]))))
def leg_crosses_land(s: Source) -> DataFrame:
    ports = refdata.ports(s.spark).select(F.col("name").alias("port"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    g = evaluate.parameter_grid(s.view("obs").select("event_id", "lat", "lon"), ports)
    return g.select("event_id", "port", geo.crosses_land(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"), [RING]).alias("crosses"))


@query("time_shift_cases", """
SELECT a.user_id, a.d, round(a.lat, 6) AS lat, round(b.lat, 6) AS lat_1, round(c.lat, 6) AS lat_2 FROM track a JOIN track b ON a.user_id = b.user_id AND b.d = a.d + INTERVAL 1 DAY JOIN track c ON a.user_id = c.user_id AND c.d = a.d + INTERVAL 2 DAY""")
def time_shift_cases(s: Source) -> DataFrame:
    t = joins.time_shifted(s.view("track").withColumn("d", F.col("d").cast("timestamp_ntz")), "user_id", "d", (1, 2))
    return t.select("user_id", "d", F.round("lat", 6).alias("lat"), F.round("lat_1", 6).alias("lat_1"), F.round("lat_2", 6).alias("lat_2"))


SLICES = "SELECT o_orderkey AS k, CAST(1704067200 + (o_orderkey * 104729) % 30000000 AS bigint) AS t FROM orders"
TIMES = "SELECT event_id AS id, CAST(1704067200 + (event_id * 7919) % 30000000 AS bigint) AS moment FROM events"


@query("asof_nearest_slice", f"""
WITH s AS (SELECT t, min(k) AS k FROM ({SLICES}) z GROUP BY t), e AS ({TIMES}),
b AS (SELECT e.id, moment, s.t, s.k FROM e ASOF LEFT JOIN s ON s.t <= e.moment), a AS (SELECT b.*, n.t AS t2, n.k AS k2 FROM b ASOF LEFT JOIN s n ON n.t >= b.moment)
SELECT id, CASE WHEN t2 IS NULL OR moment - t <= t2 - moment THEN k ELSE k2 END AS k, CASE WHEN t2 IS NULL OR moment - t <= t2 - moment THEN t ELSE t2 END AS t,
  least(coalesce(moment - t, t2 - moment), coalesce(t2 - moment, moment - t)) AS gap FROM a""")
def asof_nearest_slice(s: Source) -> DataFrame:
    slices = s.sql(SLICES)
    found = joins.nearest_in_time(s.sql(TIMES).withColumnRenamed("moment", "at"), slices)
    return found.join(slices, "k").select("id", "k", "t", "gap")


@query("source_priority", """
WITH u AS (SELECT 1 AS priority, o_custkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O')
SELECT k, priority, count(*) AS n, round(sum(v), 2) AS total FROM u JOIN (SELECT k, min(priority) AS priority FROM u GROUP BY k) b USING (k, priority) GROUP BY k, priority""")
def source_priority(s: Source) -> DataFrame:
    o = s.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    u = o.where("o_orderstatus = 'F'").withColumn("priority", F.lit(1)).unionByName(o.where("o_orderstatus = 'O'").withColumn("priority", F.lit(2)))
    return joins.by_priority(u, ["k"], "priority").groupBy("k", "priority").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("cache_antijoin", "SELECT DISTINCT p_partkey AS granule FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def cache_antijoin(s: Source) -> DataFrame:
    cached = s.table("lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("granule"))
    return joins.missing_from(s.table("part").select(F.col("p_partkey").alias("granule")), cached, "granule").distinct()
