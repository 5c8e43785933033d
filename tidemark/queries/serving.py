"""Queries behind maps, briefings and detection's masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import refdata
from ..functions import geo, numeric, spectral
from ..operators import classify, detect, runs, show
from ..sources import readers
from .analysis import SPOTS, _spots
from .spatial import RING, km
from .views import Source, query


def r(c, n: int = 6):
    return F.round(c, n)


@query("tier_filter", f"SELECT id, tier FROM ({SPOTS}) s WHERE tier IN ('High', 'Low') UNION ALL SELECT -1 - id, tier FROM ({SPOTS}) s")
def tier_filter(s: Source) -> DataFrame:
    """Hotspots of two tiers; and, with ids below 0, what an empty choice shows."""
    spots = _spots(s)
    return show.of_tiers(spots, {"High", "Low"}).select("id", "tier").union(show.of_tiers(spots, set()).select(-1 - F.col("id"), "tier"))


@query("sorted_list", f"SELECT id, run, CAST(row_number() OVER (PARTITION BY run ORDER BY coalesce(CASE WHEN id % 3 <> 0 THEN lat END, 0) DESC, id) AS int) AS place FROM ({SPOTS}) s")
def sorted_list(s: Source) -> DataFrame:
    return show.listed(_spots(s).withColumn("drift_km", F.when(F.col("id") % 3 != 0, F.col("lat"))), "run", "drift").select("id", "run", "place")


@query("shown_shares", "SELECT o_orderkey AS id, CAST(len(list_filter([o_orderkey % 13 / 100.0, o_custkey % 7 / 100.0, 0.2], lambda x: x >= 0.05)) AS int) AS shown FROM orders")
def shown_shares(s: Source) -> DataFrame:
    share = lambda c: F.struct(F.lit("x").alias("name"), c.cast("decimal(10,6)").alias("share"))
    sources = F.array(share(F.col("o_orderkey") % 13 / 100), share(F.col("o_custkey") % 7 / 100), share(F.lit(0.2)))
    return s.table("orders").select(F.col("o_orderkey").alias("id"), F.size(show.shares_shown(sources)).alias("shown"))


@query("shown_bins", "SELECT l_suppkey AS bin, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 20")
def shown_bins(s: Source) -> DataFrame:
    return show.bins_shown(s.table("lineitem").groupBy(F.col("l_suppkey").alias("bin")).agg(F.count("*").alias("n")))


@query("region_tags", "SELECT s_suppkey AS id, 'run/' || s_name AS file, 'Bay' AS region FROM supplier")
def region_tags(s: Source) -> DataFrame:
    return show.tagged(s.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("file")), "Bay", "run", "file")


@query("class_names", "SELECT l_linenumber + 11 AS label, CASE l_linenumber + 11 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in refdata.CLASS_NAMES.items()) + " ELSE 'unknown' END AS name, count(*) AS n FROM lineitem GROUP BY 1, 2")
def class_names(s: Source) -> DataFrame:
    label = F.col("l_linenumber") + 11
    return s.table("lineitem").groupBy(label.alias("label"), show.class_name(label).alias("name")).agg(F.count("*").alias("n"))


@query("source_flags", "SELECT p_partkey AS id, p_size % 2 = 1 OR contains(p_name, 'PACE') AS pace, p_size % 3 = 0 AS oscar FROM part")
def source_flags(s: Source) -> DataFrame:
    p = s.table("part")
    text = {"detection": F.concat("p_name", F.when(F.col("p_size") % 2 == 1, " PACE OCI").otherwise(" ")), "currents": F.when(F.col("p_size") % 3 == 0, "NASA OSCAR v2.0"), "wind": F.lit(None).cast("string")}
    flags = show.source_flags(text)
    return p.select(F.col("p_partkey").alias("id"), flags["PACE"].alias("pace"), flags["OSCAR"].alias("oscar"))


@query("track_prefix", """
WITH t AS (SELECT o_orderkey AS id, o_orderkey % 11 / 2.0::double - 0.5 AS hour FROM orders), c AS (SELECT id, hour, least(greatest(hour, 0), 4) AS h FROM t),
p AS (SELECT id, hour, h, least(CAST(floor(h) AS int), 3) AS k FROM c)
SELECT id, CAST(greatest(floor(least(hour, 4)) + 1, 0) + 1 AS int) AS points, round((10 + sin(id + k)) + (h - k) * (sin(id + k + 1) - sin(id + k)), 6) AS last FROM p""")
def track_prefix(s: Source) -> DataFrame:
    key = F.col("o_orderkey")
    track = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda h: F.struct(h.alias("h"), (10 + F.sin(key + h)).alias("lat"), (80 + F.cos(key + h)).alias("lon")))
    upto = s.table("orders").select(key.alias("id"), show.track_up_to(track, key % 11 / 2 - 0.5).alias("t"))
    return upto.select("id", F.size("t").alias("points"), r(F.element_at("t", -1)["lat"]).alias("last"))


@query("frames_between", """
WITH f AS (SELECT o_custkey AS particle, o_orderkey % 5 * 3 AS h, avg(o_totalprice) * 0.000097312461::double AS lat, max(o_orderkey) % 2 = 0 AS beached FROM orders GROUP BY 1, 2),
a AS (SELECT particle, max(h) FILTER (h <= 7) AS lo, min(h) FILTER (h > 7) AS hi FROM f GROUP BY particle), b AS (SELECT particle, coalesce(lo, hi) AS lo, coalesce(hi, lo) AS hi FROM a),
w AS (SELECT *, CASE WHEN hi > lo THEN least(greatest((7 - lo) / CAST(hi - lo AS double), 0), 1) ELSE 0 END AS w FROM b)
SELECT w.particle, round(x.lat + w * (y.lat - x.lat), 6) AS lat, CASE WHEN w < 0.5 THEN x.beached ELSE y.beached END AS beached FROM w JOIN f x ON x.particle = w.particle AND x.h = lo JOIN f y ON y.particle = w.particle AND y.h = hi""")
def frames_between(s: Source) -> DataFrame:
    o = s.table("orders").groupBy(F.col("o_custkey").alias("particle"), (F.col("o_orderkey") % 5 * 3).alias("h")).agg((F.avg("o_totalprice") * 0.000097312461).alias("lat"), (F.max("o_orderkey") % 2 == 0).alias("beached"))
    return show.frames_at(o.withColumn("lon", F.col("lat")), 7.0, ("particle",)).select("particle", r("lat").alias("lat"), "beached")


@query("flow_grid", """
WITH y AS (SELECT DISTINCT lat FROM field), x AS (SELECT DISTINCT lon FROM field), v AS (SELECT sqrt(u * u + v * v) AS s FROM field WHERE u IS NOT NULL AND v IS NOT NULL)
SELECT (SELECT min(lat) FROM y) AS lat0, (SELECT min(lon) FROM x) AS lon0, (SELECT count(*) FROM y) AS nlat, (SELECT count(*) FROM x) AS nlon, round((SELECT greatest(list_sort(list(s))[count(*) // 2 + 1], 0.02) FROM v), 6) AS median""")
def flow_grid(s: Source) -> DataFrame:
    return show.flow_grid(s.view("field")).select("lat0", "lon0", F.col("nlat").cast("long").alias("nlat"), F.col("nlon").cast("long").alias("nlon"), r("median").alias("median"))


_PLACES = "SELECT event_id AS id, 3.5 + (event_id % 61) / CAST(10 AS double) AS lat, 79.5 + (event_id % 103) / CAST(10 AS double) AS lon FROM events"
_FIRST = "SELECT 'k' AS kind, lat, lon, u, v FROM field WHERE t = 1 AND CAST(lat * 3 + lon AS int) % 4 <> 0"


@query("sampled_flow", f"""
WITH f AS ({_FIRST}), g AS (SELECT min(lat) AS y0, max(lat) AS y1, min(lon) AS x0, max(lon) AS x1 FROM f), p AS (SELECT id, lat, lon, floor(lat) AS i, floor(lon) AS j FROM ({_PLACES}) z),
c AS (SELECT p.id, p.i, p.j, sum(w) AS w, sum(w * u) / sum(w) AS u, sum(w * v) / sum(w) AS v FROM (SELECT p.id, p.i, p.j, f.u, f.v, (CASE WHEN f.lat = p.i THEN 1 - (p.lat - p.i) ELSE p.lat - p.i END) * (CASE WHEN f.lon = p.j THEN 1 - (p.lon - p.j) ELSE p.lon - p.j END) AS w
  FROM p JOIN f ON f.lat - p.i IN (0, 1) AND f.lon - p.j IN (0, 1)) p GROUP BY p.id, p.i, p.j)
SELECT p.id, CASE WHEN c.w > 0.35 AND p.i >= y0 AND p.j >= x0 AND p.i < y1 AND p.j < x1 THEN round(u, 5) END AS u, CASE WHEN c.w > 0.35 AND p.i >= y0 AND p.j >= x0 AND p.i < y1 AND p.j < x1 THEN round(v, 5) END AS v
FROM p CROSS JOIN g LEFT JOIN c ON c.id = p.id""")
def sampled_flow(s: Source) -> DataFrame:
    return show.sampled(s.sql(_PLACES), s.sql(_FIRST)).select("id", r("u", 5).alias("u"), r("v", 5).alias("v"))


@query("bounds", "SELECT user_id, round(min(lat) - (max(lat) - min(lat)) * 0.25, 6) AS lo_lat, round(max(lat) + (max(lat) - min(lat)) * 0.25, 6) AS hi_lat, round(min(lon) - (max(lon) - min(lon)) * 0.25, 6) AS lo_lon, round(max(lon) + (max(lon) - min(lon)) * 0.25, 6) AS hi_lon FROM obs GROUP BY user_id")
def bounds(s: Source) -> DataFrame:
    return show.bounds(s.view("obs"), "user_id").select("user_id", *(r(c).alias(c) for c in ("lo_lat", "hi_lat", "lo_lon", "hi_lon")))


@query("route_line", "SELECT s_suppkey AS id, CAST(4 + s_suppkey % 3 + s_suppkey % 2 AS int) AS points, CAST(CASE WHEN s_suppkey % 2 = 1 THEN -7 ELSE 10 + s_suppkey % 3 END AS double) AS before_last FROM supplier")
def route_line(s: Source) -> DataFrame:
    """Stops at 10 on, the first by a way point; back by another for odd keys."""
    key = F.col("s_suppkey")
    place = lambda y: F.struct(y.cast("double").alias("lat"), F.lit(85.0).alias("lon"))
    none = F.array().cast("array<struct<lat:double,lon:double>>")
    stops = F.transform(F.sequence(F.lit(0).cast("long"), key % 3), lambda k: F.struct((10 + k).alias("lat"), F.lit(85.0).alias("lon"), F.when(k == 0, F.array(place(F.lit(9)))).otherwise(none).alias("via")))
    line = show.route_line(place(F.lit(0)), stops, F.when(key % 2 == 1, F.array(place(F.lit(-7)))).otherwise(none))
    return s.table("supplier").select(key.alias("id"), line.alias("l")).select("id", F.size("l").alias("points"), F.element_at("l", -2)["lat"].alias("before_last"))


_BEARING = "(degrees(atan2(sin(radians(p.lon - o.lon)) * cos(radians(p.lat)), cos(radians(o.lat)) * sin(radians(p.lat)) - sin(radians(o.lat)) * cos(radians(p.lat)) * cos(radians(p.lon - o.lon)))) + 360) % 360"


@query("drift_summary", f"""
WITH b AS (SELECT o.event_id AS id, {_BEARING} AS deg, {km("o.lat", "o.lon", "p.lat", "p.lon")} AS km FROM obs o JOIN ports8 p ON p.ord = o.event_id % 8)
SELECT id, round(deg, 4) AS deg, list_extract(['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'], CAST(floor((deg + 22.5) / 45) AS int) % 8 + 1) AS towards, round(km, 4) AS km48 FROM b""")
def drift_summary(s: Source) -> DataFrame:
    ports = refdata.ports(s.spark).select("ord", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    o = s.view("obs").join(F.broadcast(ports), F.col("event_id") % 8 == F.col("ord"))  # ports: eight rows
    km48 = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    value = F.struct(F.struct(F.col("plat").alias("lat"), F.col("plon").alias("lon")).alias("mean"), km48.alias("displacement_km"))
    x = o.select(F.col("event_id").alias("id"), show.drift_summary(F.col("lat"), F.col("lon"), F.create_map(F.lit(48), value)).alias("d"))
    return x.select("id", r("d.deg", 4).alias("deg"), "d.towards", r("d.km48", 4).alias("km48"))


@query("most_drift", "SELECT max(l_extendedprice) AS km FROM lineitem")
def most_drift(s: Source) -> DataFrame:
    stops = s.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("drift_since_seen_km"))).alias("stops"))
    return show.most_drift(stops)


_SEEN = "SELECT l_linenumber % 8 AS truth, CAST((l_linenumber + CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 4 ELSE 0 END) % 9 AS int) AS predicted FROM lineitem"


@query("found_and_false", f"SELECT count(*) FILTER (truth = 1) AS targets, count(*) FILTER (truth = 1 AND predicted = 1) AS found, count(*) FILTER (truth > 3 AND predicted IN (1, 2, 3)) AS false_alarms FROM ({_SEEN}) z")
def found_and_false(s: Source) -> DataFrame:
    return show.found_and_false(s.sql(_SEEN), F.col("truth"), F.col("predicted"), 1, refdata.FLOATING_CLASSES)


@query("threshold_override", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN 1 ELSE l_linenumber END AS label FROM lineitem")
def threshold_override(s: Source) -> DataFrame:
    return s.table("lineitem").select("l_orderkey", "l_linenumber", classify.threshold_override(F.col("l_linenumber"), F.col("l_discount"), 0.05, 1).alias("label"))


@query("utm_round_trip", "SELECT event_id AS id, CAST(floor((lon + 180) / 6) + 1 AS int) AS zone, true AS back, lon > floor((lon + 180) / 6) * 6 - 177 AS east FROM obs")
def utm_round_trip(s: Source) -> DataFrame:
    """Places to their UTM zone and back within some millimetres, and whether they are east of its middle."""
    zone = (F.floor((F.col("lon") + 180) / 6) + 1).cast("int")
    x = s.view("obs").withColumn("zone", zone)
    e, n = geo.to_utm(F.col("lat"), F.col("lon"), F.col("zone"))
    lat, lon = geo.from_utm(F.col("e"), F.col("n"), F.col("zone"))
    same = (F.abs(lat - F.col("lat")) < 1e-8) & (F.abs(lon - F.col("lon")) < 1e-8)
    return x.withColumns({"e": e, "n": n}).select(F.col("event_id").alias("id"), "zone", same.alias("back"), (F.col("e") > 500_000).alias("east"))


_SCL = "SELECT p.*, CASE WHEN (row * 11 + col * 17 + scene) % 53 = 0 THEN 8 WHEN (row + col * 3) % 19 = 0 THEN 5 ELSE 6 END AS scl FROM pix p"


@query("scene_mask", f"""
WITH s AS ({_SCL}), m AS (SELECT scene, row, col FROM s WHERE scl = 8)
SELECT s.scene, s.row, s.col, scl = 6 AND B2 IS NOT NULL AND B8 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.scene = s.scene AND abs(m.row - s.row) + abs(m.col - s.col) <= 2) AS valid FROM s""")
def scene_mask(s: Source) -> DataFrame:
    return detect.scene_valid(s.sql(_SCL), ["B2", "B8"], steps=2).select("scene", "row", "col", "valid")


@query("block_average", f"""
WITH s AS ({_SCL}) SELECT scene, CAST(row // 4 AS int) AS row, CAST(col // 4 AS int) AS col, round(avg(B2), 8) AS B2, round(avg(B8), 8) AS B8, min(CASE WHEN row % 4 = 2 AND col % 4 = 2 THEN scl END) AS scl, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon
FROM s GROUP BY scene, row // 4, col // 4""")
def block_average(s: Source) -> DataFrame:
    """Pixels four times as coarse, each with the class of its middle."""
    return readers.block_averaged(s.sql(_SCL), ["B2", "B8"], 4).select("scene", "row", "col", r("B2", 8).alias("B2"), r("B8", 8).alias("B8"), "scl", r("lat").alias("lat"), r("lon").alias("lon"))


_BANDS = " UNION ALL ".join(f"SELECT scene, row, col, '{b}' AS band, {b} AS value FROM pix" for b in ("B2", "B8", "B11"))


@query("swath_window", "SELECT row, col, B2, B8 FROM pix WHERE scene = 0 AND lat >= 10.05 AND lat <= 10.3001 AND lon >= 85.1 AND lon <= 85.3001")
def swath_window(s: Source) -> DataFrame:
    """Two bands of a swath's pixels in a box, from a long table of bands."""
    one = s.view("pix").where("scene = 0")
    bands = s.sql(_BANDS).where("scene = 0").select("row", "col", "band", "value")
    return readers.swath(one.select("row", "col", "lat", "lon"), bands, ["B2", "B8"], (10.05, 10.3001, 85.1, 85.3001), least=50).select("row", "col", "B2", "B8")


@query("reflectance_scaled", "SELECT l_orderkey, l_linenumber, CASE WHEN dn <> 0 THEN round(dn * 0.0001::double - 0.1::double, 6) END AS reflectance FROM (SELECT l_orderkey, l_linenumber, l_quantity * (l_linenumber % 4) AS dn FROM lineitem) z")
def reflectance_scaled(s: Source) -> DataFrame:
    return s.table("lineitem").select("l_orderkey", "l_linenumber", r(spectral.scaled(F.col("l_quantity") * (F.col("l_linenumber") % 4), 0.0001, -0.1)).alias("reflectance"))


@query("recent_granules", """
WITH g AS (SELECT o_orderkey AS id, o_orderdate AS start, (o_custkey % 100) / CAST(100 AS double) AS coverage, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 * 25 END AS cloud FROM orders)
SELECT id, round(coverage * (1 - (CASE WHEN coalesce(cloud, 0) = 0 THEN 100 ELSE cloud END) / CAST(100 AS double)), 6) AS score FROM g WHERE start >= TIMESTAMP '1996-01-01' AND start <= TIMESTAMP '1996-12-31' AND coverage >= 0.15""")
def recent_granules(s: Source) -> DataFrame:
    o = F.col("o_orderkey")
    g = s.table("orders").select(o.alias("id"), F.col("o_orderdate").alias("start"), ((F.col("o_custkey") % 100) / 100.0).alias("coverage"), F.when(o % 5 != 0, o % 4 * 25).alias("cloud"))
    return runs.recent_granules(g, F.expr("TIMESTAMP_NTZ '1996-01-01'"), F.expr("TIMESTAMP_NTZ '1996-12-31'")).select("id", r("score").alias("score"))


@query("weather_endpoint", "SELECT o_orderkey AS id, CASE WHEN CAST(o_orderdate AS date) >= DATE '1998-01-01' - 6 THEN 'forecast' ELSE 'archive' END AS endpoint FROM orders")
def weather_endpoint(s: Source) -> DataFrame:
    return s.table("orders").select(F.col("o_orderkey").alias("id"), runs.weather_source(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")).alias("endpoint"))


@query("first_mode", "SELECT l_orderkey AS id, CAST(l_linenumber AS int) AS mode FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_linenumber) AS k FROM (SELECT l_orderkey, l_partkey % 3 AS l_linenumber FROM lineitem) y GROUP BY l_orderkey, l_linenumber) z WHERE k = 1")
def first_mode(s: Source) -> DataFrame:
    """Of each order the most frequent class of its lines, the smallest on ties."""
    lines = s.table("lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 3).cast("int")).alias("v"))
    return lines.select(F.col("l_orderkey").alias("id"), numeric.first_mode(F.col("v")).alias("mode"))


#: A small island's ring; its corners stand for the coast.
ISLAND = [(10.1, 85.1), (10.1, 85.22), (10.25, 85.2), (10.2, 85.1)]
_edges = " UNION ALL ".join(f"SELECT {a[0]} AS alat, {a[1]} AS alon, {b[0]} AS blat, {b[1]} AS blon" for a, b in zip(ISLAND, ISLAND[1:] + ISLAND[:1]))


@query("off_shore", f"""
WITH e AS ({_edges}), p AS (SELECT p.scene, p.row, p.col, p.lat, p.lon, s.row IS NOT NULL AS c FROM pix p LEFT JOIN spots s ON s.scene = p.scene AND s.row = p.row AND s.col = p.col),
d AS (SELECT scene, row, col, min({km("lat", "lon", "alat", "alon")}) AS km, sum(CASE WHEN (alat > lat) <> (blat > lat) AND lon < alon + (lat - alat) / nullif(blat - alat, 0.0) * (blon - alon) THEN 1 ELSE 0 END) % 2 = 1 AS land FROM p CROSS JOIN e GROUP BY scene, row, col)
SELECT p.scene, p.row, p.col, c AND km >= 2.5 AND NOT land AS candidate FROM p JOIN d ON d.scene = p.scene AND d.row = p.row AND d.col = p.col""")
def off_shore(s: Source) -> DataFrame:
    marked = s.view("pix").join(s.view("spots").withColumn("c", F.lit(True)), ["scene", "row", "col"], "left").withColumn("candidate", F.coalesce("c", F.lit(False))).select("scene", "row", "col", "lat", "lon", "candidate")
    coast = s.spark.createDataFrame(ISLAND, "lat double, lon double")
    return detect.off_shore(marked, coast, [ISLAND]).select("scene", "row", "col", "candidate")


def all_bands(s: Source) -> DataFrame:
    """The pixels with every band: those that the tables lack are shares of the ones beside them."""
    p = s.view("pix")
    return p.withColumns({b: F.col(near) * f for b, near, f in (("B1", "B2", 0.9), ("B5", "B4", 1.1), ("B7", "B6", 1.05), ("B8A", "B8", 0.97), ("B12", "B11", 0.8))})


@query("feature_image")
def feature_image(s: Source) -> DataFrame:
    """All 44 features of each pixel."""
    from ..functions.spectral import BANDS

    return detect.feature_image(detect.background(all_bands(s), list(BANDS), 8))
