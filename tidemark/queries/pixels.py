"""Queries on pixel grids and velocity fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..operators import detect, field, raster
from .views import Source, query

S = repr(spectral.SLOPE)
FDI = f"(B8 - (B6 + (B11 - B6) * {S} * 10))"


def r(c, n: int = 6):
    return F.round(c, n)


@query("spectral_indices", f"""
SELECT scene, row, col, round((B8 - B4) / (B8 + B4 + 1e-6), 6) AS ndvi, round({FDI}, 6) AS fdi, round(B8 - (B4 + (B11 - B4) * {S}), 6) AS fai, round((B3 - B8) / (B3 + B8 + 1e-6), 6) AS ndwi FROM pix""")
def spectral_indices(s: Source) -> DataFrame:
    x = spectral.indices()
    return s.view("pix").select("scene", "row", "col", *(r(x[k]).alias(k.lower()) for k in ("NDVI", "FDI", "FAI", "NDWI")))


_USED = ("B2", "B3", "B4", "B6", "B8", "B11")


@query("background_relative", f"""
WITH m AS (SELECT scene, {", ".join(f"median(CASE WHEN valid THEN {b} END) AS bg_{b}" for b in _USED)} FROM pix GROUP BY scene),
d AS (SELECT p.scene, row, col, {", ".join(f"{b} - bg_{b} AS d{b}" for b in _USED)} FROM pix p JOIN m ON p.scene = m.scene)
SELECT scene, row, col, {", ".join(f"round(d{b}, 6) AS d_{b.lower()}" for b in _USED)}, round(dB8 - (dB6 + (dB11 - dB6) * {S} * 10), 6) AS d_fdi,
  round((dB8 - dB4) / (abs(dB8) + abs(dB4) + 1e-3), 6) AS d_ndvi, round((dB3 - dB8) / (abs(dB3) + abs(dB8) + 1e-3), 6) AS d_ndwi FROM d""")
def background_relative(s: Source) -> DataFrame:
    p = s.view("pix")
    m = p.groupBy("scene").agg(*(F.median(F.when(F.col("valid"), F.col(b))).alias(f"bg_{b}") for b in _USED))
    x = spectral.relative(_USED)
    names = {f"d{b}": f"d_{b.lower()}" for b in _USED} | {"dFDI": "d_fdi", "dNDVI": "d_ndvi", "dNDWI": "d_ndwi"}
    return p.join(m, "scene").select("scene", "row", "col", *(r(x[k]).alias(v) for k, v in names.items()))


FLAGS = {"land": 2, "cloud": 16 + 512, "glint": 8}


@query("flag_decode", "SELECT o_orderkey AS k, (o_custkey & 2) <> 0 AS land, (o_custkey & 528) <> 0 AS cloud, (o_custkey & 8) <> 0 AS glint FROM orders")
def flag_decode(s: Source) -> DataFrame:
    return s.table("orders").select(F.col("o_orderkey").alias("k"), *(v.alias(k) for k, v in raster.flags(F.col("o_custkey"), FLAGS).items()))


@query("haze_bright", "SELECT scene, row, col, coalesce(B8, 1.0) > 0.06 AS hazy, coalesce(B2 - 0.01, 1.0) > 0.06 OR coalesce(B11, 1.0) > 0.10 AS bright, round(least(greatest(pow(greatest(B2, 0) / 0.12, 1 / 2.2), 0), 1), 6) AS shown FROM pix")
def haze_bright(s: Source) -> DataFrame:
    return s.view("pix").select("scene", "row", "col", (F.coalesce("B8", F.lit(1.0)) > 0.06).alias("hazy"), detect.bright(F.col("B2"), F.lit(0.01), F.col("B11")).alias("bright"), r(spectral.stretched(F.col("B2"))).alias("shown"))


@query("block_median", "SELECT scene, row // 8 AS br, col // 8 AS bc, round(median(CASE WHEN valid THEN v END), 6) AS v, round(median(CASE WHEN valid THEN B2 END), 6) AS b2 FROM pix GROUP BY scene, row // 8, col // 8")
def block_median(s: Source) -> DataFrame:
    return raster.block_medians(s.view("pix"), ["v", "B2"], 8).select("scene", "br", "bc", r("v").alias("v"), r("B2").alias("b2"))


@query("mad_zscore", """
WITH f AS (SELECT scene, row, col, CASE WHEN valid THEN v - 10 END AS r FROM pix), m AS (SELECT scene, median(r) AS mid, stddev_pop(r) AS sd FROM f GROUP BY scene),
d AS (SELECT f.scene, median(abs(r - mid)) AS mad, max(sd) AS sd FROM f JOIN m ON f.scene = m.scene GROUP BY f.scene)
SELECT f.scene, row, col, round(r / ((CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END) + 1e-9), 6) AS z FROM f JOIN d ON f.scene = d.scene""")
def mad_zscore(s: Source) -> DataFrame:
    return raster.mad_z(s.view("pix").withColumn("bg", F.lit(10)), "v", "bg").select("scene", "row", "col", r("z").alias("z"))


def _focal_sql(n: int) -> str:
    k = n // 2
    mirror = lambda a: f"CASE WHEN {a} < 0 THEN -{a} - 1 WHEN {a} > 39 THEN 79 - {a} ELSE {a} END"
    return f"""WITH o AS (SELECT unnest(range({-k}, {k + 1})) AS a), n AS (SELECT p.scene, p.row, p.col, {mirror("(p.row + y.a)")} AS r2, {mirror("(p.col + x.a)")} AS c2 FROM pix p CROSS JOIN o y CROSS JOIN o x)
SELECT n.scene, n.row, n.col, round(avg(coalesce(q.B2, 0)), 6) AS m, round(sqrt(greatest(avg(coalesce(q.B2, 0) * coalesce(q.B2, 0)) - avg(coalesce(q.B2, 0)) * avg(coalesce(q.B2, 0)), 0)), 5) AS s
FROM n JOIN pix q ON q.scene = n.scene AND q.row = n.r2 AND q.col = n.c2 GROUP BY n.scene, n.row, n.col"""


def _focal(n: int):
    @query(f"focal_mean_std_{n}", _focal_sql(n))
    def run(s: Source) -> DataFrame:
        return raster.focal(s.view("pix"), "B2", n).select("scene", "row", "col", r(f"B2_m{n}").alias("m"), r(f"B2_s{n}", 5).alias("s"))

    return run


focal_3, focal_7, focal_15 = map(_focal, (3, 7, 15))


@query("local_contrast", _focal_sql(7).replace("round(avg(coalesce(q.B2, 0)), 6) AS m", "round(coalesce(max(p0.B2), 0) - avg(coalesce(q.B2, 0)), 6) AS contrast").split(", round(sqrt")[0] + "\nFROM n JOIN pix q ON q.scene = n.scene AND q.row = n.r2 AND q.col = n.c2 JOIN pix p0 ON p0.scene = n.scene AND p0.row = n.row AND p0.col = n.col GROUP BY n.scene, n.row, n.col")
def local_contrast(s: Source) -> DataFrame:
    return raster.focal(s.view("pix"), "B2", 7, ("mean",)).select("scene", "row", "col", r(F.coalesce("B2", F.lit(0.0)) - F.col("B2_m7")).alias("contrast"))


@query("sobel_grad", """
WITH o AS (SELECT unnest([-1, 0, 1]) AS a, unnest([1, 2, 1]) AS w), n AS (SELECT p.scene, p.row, p.col, y.a AS dy, x.a AS dx, y.w AS wy, x.w AS wx, least(greatest(p.row + y.a, 0), 39) AS r2, least(greatest(p.col + x.a, 0), 39) AS c2 FROM pix p CROSS JOIN o y CROSS JOIN o x)
SELECT n.scene, n.row, n.col, round(sqrt(pow(sum(dx * wy * coalesce(q.B2, 0)), 2) + pow(sum(dy * wx * coalesce(q.B2, 0)), 2)), 5) AS grad FROM n JOIN pix q ON q.scene = n.scene AND q.row = n.r2 AND q.col = n.c2 GROUP BY n.scene, n.row, n.col""")
def sobel_grad(s: Source) -> DataFrame:
    return raster.sobel(s.view("pix"), "B2").select("scene", "row", "col", r("B2_grad", 5).alias("grad"))


@query("dilate", "WITH o AS (SELECT unnest(range(-2, 3)) AS a) SELECT DISTINCT scene, CAST(row + y.a AS int) AS row, CAST(col + x.a AS int) AS col FROM spots CROSS JOIN o y CROSS JOIN o x WHERE abs(y.a) + abs(x.a) <= 2")
def dilate(s: Source) -> DataFrame:
    return raster.dilated(s.view("spots"), 2)


COMPONENTS = """WITH RECURSIVE g AS (SELECT scene, row, col, CAST(row AS bigint) * 1048576 + col AS k FROM spots),
r(scene, k, root) AS (SELECT scene, k, k FROM g UNION SELECT b.scene, b.k, r.root FROM r JOIN g a ON a.scene = r.scene AND a.k = r.k JOIN g b ON b.scene = a.scene AND abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 WHERE r.root < b.k),
c AS (SELECT scene, k, min(root) AS component FROM r GROUP BY scene, k)"""


#: Components of the cells and of the valid cells one step around them.
RINGED = COMPONENTS.replace("WITH RECURSIVE g AS (SELECT scene, row, col, CAST(row AS bigint) * 1048576 + col AS k FROM spots)", """WITH RECURSIVE near AS (SELECT DISTINCT s.scene, s.row + y.a AS row, s.col + x.a AS col FROM spots s CROSS JOIN (SELECT unnest(range(-1, 2)) AS a) y CROSS JOIN (SELECT unnest(range(-1, 2)) AS a) x WHERE abs(y.a) + abs(x.a) <= 1),
every AS (SELECT scene, row, col FROM spots UNION SELECT n.scene, n.row, n.col FROM near n JOIN pix p ON p.scene = n.scene AND p.row = n.row AND p.col = n.col WHERE p.valid),
g AS (SELECT e.scene, e.row, e.col, CAST(e.row AS bigint) * 1048576 + e.col AS k, s.row IS NOT NULL AS candidate FROM every e LEFT JOIN spots s ON s.scene = e.scene AND s.row = e.row AND s.col = e.col)""")


@query("components", RINGED + " SELECT g.scene, g.row, g.col, candidate, component FROM g JOIN c ON c.scene = g.scene AND c.k = g.k")
def components(s: Source) -> DataFrame:
    return raster.components(s.view("spots"), s.view("pix").where("valid")).select("scene", "row", "col", "candidate", "component")


@query("component_stats", RINGED + """, h AS (SELECT g.scene, component, p.* EXCLUDE (scene) FROM g JOIN c ON c.scene = g.scene AND c.k = g.k JOIN pix p ON p.scene = g.scene AND p.row = g.row AND p.col = g.col WHERE candidate),
a AS (SELECT scene, component, count(*) AS pixels, sum(B2 * lat) / sum(B2) AS lat, sum(B2 * lon) / sum(B2) AS lon, max(B2) AS max_z, avg(B2) AS mean_z, avg(B3) AS fdi, avg(B4) AS ndvi FROM h GROUP BY scene, component HAVING count(*) >= 2),
o AS (SELECT unnest(range(-4, 5)) AS a), ring AS (SELECT DISTINCT h.scene, component, h.row + y.a AS row, h.col + x.a AS col FROM h CROSS JOIN o y CROSS JOIN o x WHERE abs(y.a) + abs(x.a) <= 4),
e AS (SELECT ring.scene, component, avg(CASE WHEN valid THEN 0 ELSE 1 END) AS edge FROM ring JOIN pix p ON p.scene = ring.scene AND p.row = ring.row AND p.col = ring.col GROUP BY ring.scene, component),
l AS (SELECT scene, component, label FROM (SELECT scene, component, label, row_number() OVER (PARTITION BY scene, component ORDER BY count(*) DESC, label) AS k FROM (SELECT scene, component, (row + col) % 3 + 1 AS label FROM h) q GROUP BY scene, component, label) z WHERE k = 1)
SELECT a.scene, a.component, pixels, round(lat, 4) AS lat, round(lon, 4) AS lon, round(max_z, 2) AS max_z, round(fdi, 5) AS mean_fdi, round(pixels * 1.0, 3) AS area_km2, round(greatest(1.0, sqrt(pixels / 3.141592653589793)), 2) AS radius_km, round(edge, 3) AS cloud_edge_fraction, label AS ml_label,
  round(least(greatest((0.65 * least(greatest(log10(greatest(mean_z, 3.5) / 3.5) / 1.5, 0), 1) + 0.15 * least(greatest(ln(1 + pixels) / ln(41), 0), 1) + 0.20 * 0.5) * (1 - 0.5 * edge), 0), 1), 3) AS confidence
FROM a JOIN e ON e.scene = a.scene AND e.component = a.component JOIN l ON l.scene = a.scene AND l.component = a.component""")
def component_stats(s: Source) -> DataFrame:
    """Hotspots of given candidates, with a band as z and made-up labels and probabilities."""
    spots = s.view("spots").withColumn("candidate", F.lit(True))
    p = s.view("pix").join(spots, ["scene", "row", "col"], "left").withColumn("candidate", F.coalesce("candidate", F.lit(False)))
    p = p.withColumns({"z": F.col("B2"), "FDI": F.col("B3"), "NDVI": F.col("B4"), "label": (F.col("row") + F.col("col")) % 3 + 1, "p_floating": F.lit(0.5), "p_debris": F.lit(0.1)})
    return detect.hotspots(p, 1.0).select("scene", "component", "pixels", "lat", "lon", "max_z", "mean_fdi", "area_km2", "radius_km", "cloud_edge_fraction", "ml_label", "confidence")


@query("scene_stats", "SELECT scene, count(*) FILTER (valid) AS valid_pixels, count(*) FILTER (B2 > 0.055) AS candidate_pixels, count(*) AS pixels FROM pix GROUP BY scene")
def scene_stats(s: Source) -> DataFrame:
    return detect.scene_stats(s.view("pix").withColumn("candidate", F.coalesce(F.col("B2") > 0.055, F.lit(False))))


@query("swath_grid", "SELECT scene, CAST(floor((lat - 10) / CAST(0.045 AS double)) AS int) AS iy, CAST(floor((lon - 85) / CAST(0.045 AS double)) AS int) AS ix, round(avg(v), 6) AS v, count(*) AS n FROM pix WHERE v IS NOT NULL GROUP BY 1, 2, 3")
def swath_grid(s: Source) -> DataFrame:
    return raster.gridded(s.view("pix"), "v", 10.0, 85.0, 0.045).withColumn("v", r("v"))


_HOLES = "SELECT scene, row AS br, col AS bc, CASE WHEN valid AND row % 5 < 2 AND col % 7 < 3 THEN v END AS v FROM pix"


@query("nearest_fill", f"""
WITH h AS ({_HOLES}), f AS (SELECT * FROM h WHERE v IS NOT NULL),
d AS (SELECT h.scene, h.br, h.bc, arg_min(f.v, ((f.br - h.br) * (f.br - h.br) + (f.bc - h.bc) * (f.bc - h.bc)) * 10000 + f.br * 100 + f.bc) AS v FROM h JOIN f ON f.scene = h.scene WHERE h.v IS NULL GROUP BY h.scene, h.br, h.bc)
SELECT scene, br, bc, round(v, 6) AS v FROM f UNION ALL SELECT scene, br, bc, round(v, 6) FROM d""")
def nearest_fill(s: Source) -> DataFrame:
    return raster.nearest_filled(s.sql(_HOLES), ["v"]).select("scene", "br", "bc", r("v").alias("v"))


@query("bilinear_up", """
WITH b AS (SELECT scene, row // 8 AS br, col // 8 AS bc, median(v) AS v FROM pix GROUP BY 1, 2, 3), a AS (SELECT scene, row, col, row * 4 / 39.0 AS y, col * 4 / 39.0 AS x FROM pix),
i AS (SELECT *, least(CAST(floor(y) AS int), 3) AS y0, least(CAST(floor(x) AS int), 3) AS x0 FROM a)
SELECT i.scene, i.row, i.col, round((a.v * (1 - (x - x0)) + b.v * (x - x0)) * (1 - (y - y0)) + (c.v * (1 - (x - x0)) + d.v * (x - x0)) * (y - y0), 5) AS v FROM i
JOIN b a ON a.scene = i.scene AND a.br = y0 AND a.bc = x0 JOIN b b ON b.scene = i.scene AND b.br = y0 AND b.bc = x0 + 1 JOIN b c ON c.scene = i.scene AND c.br = y0 + 1 AND c.bc = x0 JOIN b d ON d.scene = i.scene AND d.br = y0 + 1 AND d.bc = x0 + 1""")
def bilinear_up(s: Source) -> DataFrame:
    p = s.view("pix")
    blocks = raster.block_medians(p.withColumn("all", F.lit(True)), ["v"], 8, valid="all")
    size = p.select("scene").distinct().select("scene", F.lit(40).alias("rows"), F.lit(40).alias("cols"))
    return raster.upsampled(p.select("scene", "row", "col"), blocks, {"v": "v"}, 8, size).select("scene", "row", "col", r("v", 5).alias("v"))


@query("pixel_window", """
WITH d AS (SELECT *, pow(lat - 10.2, 2) + pow((lon - 85.17) * cos(radians(10.2)), 2) AS d FROM pix), b AS (SELECT scene, arg_min(row, d * 1e6 + row * 1e-6) AS r0, arg_min(col, d * 1e6 + row * 1e-6) AS c0 FROM d GROUP BY scene)
SELECT p.scene, row, col, round(v, 6) AS v FROM pix p JOIN b ON b.scene = p.scene WHERE abs(row - r0) <= 3 AND abs(col - c0) <= 3""")
def pixel_window(s: Source) -> DataFrame:
    return raster.nearest_pixel(s.view("pix"), 10.2, 85.17, 3).select("scene", "row", "col", r("v").alias("v"))


@query("detect_hotspots")
def detect_hotspots(s: Source) -> DataFrame:
    """Detection end to end: background, anomaly, candidates by all their rules, components, confidence. The tables' values spread little: z counts from 0.3."""
    return detect.hotspots(detect.candidates(s.view("pix").withColumn("B2", F.col("B2") * 0.5).withColumn("B11", F.col("B11") * 0.5), 8, z_threshold=0.3), 1.0)


@query("field_summary", """
WITH l AS (SELECT DISTINCT kind, lat FROM field), g AS (SELECT kind, lat - lag(lat) OVER (PARTITION BY kind ORDER BY lat) AS gap FROM l)
SELECT f.kind, count(DISTINCT t) AS steps, round(avg(sqrt(u * u + v * v)), 6) AS mean_speed, (SELECT median(gap) FROM g) AS spacing FROM field f GROUP BY f.kind""")
def field_summary(s: Source) -> DataFrame:
    return field.summary(s.view("field")).select("kind", "steps", r("mean_speed").alias("mean_speed"), "spacing")


@query("field_thin", "WITH i AS (SELECT *, dense_rank() OVER (ORDER BY lat) - 1 AS yi, dense_rank() OVER (ORDER BY lon) - 1 AS xi FROM field) SELECT t, lat, lon, u, v FROM i WHERE yi % 2 = 0 AND xi % 2 = 0 AND u IS NOT NULL AND v IS NOT NULL")
def field_thin(s: Source) -> DataFrame:
    return field.thinned(s.view("field")).select("t", "lat", "lon", "u", "v")


@query("field_scale", "SELECT t, lat, lon, round(u * 1.1, 6) AS u, round(v * 1.1, 6) AS v FROM field")
def field_scale(s: Source) -> DataFrame:
    return field.scaled(s.view("field"), 1.1).select("t", "lat", "lon", r("u").alias("u"), r("v").alias("v"))


@query("dir_to_uv", "SELECT event_id, round(-(value / 3.6) * sin(radians(event_id % 360)), 6) AS u, round(-(value / 3.6) * cos(radians(event_id % 360)), 6) AS v FROM events")
def dir_to_uv(s: Source) -> DataFrame:
    u, v = field.from_direction(F.col("value"), F.col("event_id") % 360, towards=False, unit=1 / 3.6)
    return s.table("events").select("event_id", r(u).alias("u"), r(v).alias("v"))


_POINTS = "SELECT event_id AS id, (event_id % 77) / CAST(10 AS double) AS t, 3.5 + (event_id % 61) / CAST(10 AS double) AS lat, 79.5 + (event_id % 103) / CAST(10 AS double) AS lon FROM events"


@query("trilinear_at", f"""
WITH p AS ({_POINTS}), c AS (SELECT id, least(greatest(t, 0), 7) AS t, least(greatest(lat, 4), 9) AS y, least(greatest(lon, 80), 89) AS x FROM p),
g AS (SELECT a.t, b.lat, d.lon FROM (SELECT DISTINCT t FROM field) a CROSS JOIN (SELECT DISTINCT lat FROM field) b CROSS JOIN (SELECT DISTINCT lon FROM field) d),
whole AS (SELECT g.t, g.lat, g.lon, arg_min(n.u, pow(n.lat - g.lat, 2) * 1e6 + pow(n.lon - g.lon, 2) * 1e6 + n.lat * 100 + n.lon) AS u, arg_min(n.v, pow(n.lat - g.lat, 2) * 1e6 + pow(n.lon - g.lon, 2) * 1e6 + n.lat * 100 + n.lon) AS v FROM g JOIN field n ON n.t = g.t GROUP BY g.t, g.lat, g.lon),
i AS (SELECT *, least(floor(t), 6) AS t0, least(floor(y), 8) AS y0, least(floor(x), 88) AS x0 FROM c), o AS (SELECT unnest([0, 1]) AS k)
SELECT id, round(sum(f.u * w), 5) AS u, round(sum(f.v * w), 5) AS v FROM (SELECT i.*, a.k AS dt, b.k AS dy, d.k AS dx,
  (CASE WHEN a.k = 1 THEN t - t0 ELSE 1 - (t - t0) END) * (CASE WHEN b.k = 1 THEN y - y0 ELSE 1 - (y - y0) END) * (CASE WHEN d.k = 1 THEN x - x0 ELSE 1 - (x - x0) END) AS w FROM i CROSS JOIN o a CROSS JOIN o b CROSS JOIN o d) q
JOIN whole f ON f.t = t0 + dt AND f.lat = y0 + dy AND f.lon = x0 + dx GROUP BY id""")
def trilinear_at(s: Source) -> DataFrame:
    return field.trilinear(s.sql(_POINTS), s.view("field"), "currents").select("id", r("u", 5).alias("u"), r("v", 5).alias("v"))
