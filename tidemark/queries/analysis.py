"""Queries on statistics: errors, calibration, confusion, classes, runs, time, text and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import refdata
from ..functions import temporal
from ..operators import classify, decide, evaluate, runs
from .spatial import km
from .views import Source, query


def r(c, n: int = 6):
    return F.round(c, n)


CASES = f"""WITH c AS (SELECT a.event_type, {km("a.lat", "a.lon", "b.lat", "b.lon")} AS model, {km("a.lat", "a.lon", "c.lat", "c.lon")} AS still FROM track a
  JOIN track b ON a.user_id = b.user_id AND b.d = a.d + INTERVAL 1 DAY JOIN track c ON a.user_id = c.user_id AND c.d = a.d + INTERVAL 2 DAY)"""


def _cases(s: Source) -> DataFrame:
    from ..functions.geo import haversine_km
    from ..operators.joins import time_shifted

    t = time_shifted(s.view("track").withColumn("d", F.col("d").cast("timestamp_ntz")), "user_id", "d", (1, 2))
    d = lambda k: haversine_km(F.col("lat"), F.col("lon"), F.col(f"lat_{k}"), F.col(f"lon_{k}"))
    return t.select("event_type", d(1).alias("model"), d(2).alias("still"))


@query("error_stats", CASES + " SELECT event_type, round(median(model), 5) AS median, round(avg(model), 5) AS mean, round(quantile_cont(model, 0.9), 5) AS p90, count(model) AS n FROM c GROUP BY event_type")
def error_stats(s: Source) -> DataFrame:
    return evaluate.error_stats(_cases(s), ["event_type"], "model").select("event_type", *(r(c, 5).alias(c) for c in ("median", "mean", "p90")), "n")


@query("skill", CASES + " SELECT event_type, round(1 - median(model) / median(still), 6) AS skill FROM c GROUP BY event_type")
def skill(s: Source) -> DataFrame:
    return evaluate.skill(_cases(s), ["event_type"], "model", "still").select("event_type", r("skill").alias("skill"))


@query("metrics_cube", CASES + ", l AS (SELECT event_type, 24 AS h, model AS e FROM c UNION ALL SELECT event_type, 48, still FROM c) SELECT event_type, h, count(*) AS n, round(median(e), 5) AS median FROM l GROUP BY CUBE (event_type, h)")
def metrics_cube(s: Source) -> DataFrame:
    long = _cases(s).select("event_type", F.explode(F.array(F.struct(F.lit(24).alias("h"), F.col("model").alias("e")), F.struct(F.lit(48).alias("h"), F.col("still").alias("e")))).alias("x")).select("event_type", "x.h", "x.e")
    return long.cube("event_type", "h").agg(F.count("*").alias("n"), r(F.median("e"), 5).alias("median"))


MATRIX = "SELECT y AS truth, predicted, count(*) AS n FROM preds GROUP BY y, predicted"


@query("confusion_matrix", MATRIX)
def confusion_matrix(s: Source) -> DataFrame:
    return evaluate.confusion(s.view("preds"), "y", "predicted").withColumn("truth", F.col("truth"))


PAIRS = "SELECT l_linenumber % 5 AS truth, CAST((l_linenumber + CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 4 ELSE 0 END) % 5 AS int) AS predicted FROM lineitem"


@query("prf1", f"""
WITH p AS ({PAIRS}), c AS (SELECT truth AS class FROM p UNION SELECT predicted FROM p),
m AS (SELECT class, count(*) FILTER (truth = class AND predicted = class) AS tp, count(*) FILTER (truth = class) AS support, count(*) FILTER (predicted = class) AS chosen FROM c CROSS JOIN p GROUP BY class)
SELECT class, round(coalesce(tp / nullif(CAST(chosen AS double), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(support AS double), 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(chosen + support, 0), 0), 6) AS f1, support FROM m""")
def prf1(s: Source) -> DataFrame:
    scores = evaluate.precision_recall(evaluate.confusion(s.sql(PAIRS), "truth", "predicted"))
    return scores.select("class", *(r(c).alias(c) for c in ("precision", "recall", "f1")), F.col("support").cast("long").alias("support"))


@query("binary_group", f"WITH p AS ({PAIRS}), c AS (SELECT count(*) FILTER (truth IN (1, 2, 3) AND predicted IN (1, 2, 3)) AS tp, count(*) FILTER (truth IN (1, 2, 3)) AS support, count(*) FILTER (predicted IN (1, 2, 3)) AS chosen FROM p) SELECT round(tp / CAST(chosen AS double), 6) AS precision, round(tp / CAST(support AS double), 6) AS recall, round(2.0 * tp / (chosen + support), 6) AS f1, support FROM c")
def binary_group(s: Source) -> DataFrame:
    b = evaluate.binary_scores(s.sql(PAIRS), F.col("truth").isin(*refdata.FLOATING_CLASSES), F.col("predicted").isin(*refdata.FLOATING_CLASSES))
    return b.select(*(r(c).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("worst_confusions", f"WITH m AS (SELECT truth, predicted, count(*) AS n FROM ({PAIRS}) p GROUP BY truth, predicted) SELECT * FROM (SELECT truth, predicted, n, CAST(row_number() OVER (PARTITION BY truth ORDER BY n DESC, predicted) AS int) AS place FROM m WHERE truth <> predicted) z WHERE place <= 2")
def worst_confusions(s: Source) -> DataFrame:
    return evaluate.worst_confusions(evaluate.confusion(s.sql(PAIRS), "truth", "predicted"), 2).select("truth", "predicted", "n", "place")


BIN = "CAST(least(greatest((SELECT count(*) FROM (SELECT unnest(range(11)) AS i) z WHERE p >= i * 0.1::double) - 1, 0), 9) AS int)"


@query("reliability", f"SELECT {BIN} AS bin, round(avg(p), 6) AS confidence, round(avg(y), 6) AS observed, count(*) AS n FROM preds GROUP BY 1")
def reliability(s: Source) -> DataFrame:
    return evaluate.reliability(s.view("preds"), "p", "y").select("bin", r("confidence").alias("confidence"), r("observed").alias("observed"), "n")


@query("ece_brier", f"WITH b AS (SELECT source, {BIN} AS bin, sum(p) AS sp, sum(y) AS sy, sum((p - y) * (p - y)) AS sq, count(*) AS n FROM preds GROUP BY 1, 2) SELECT source, round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier, CAST(sum(sy) AS bigint) AS positives, CAST(sum(n) AS bigint) AS n FROM b GROUP BY source")
def ece_brier(s: Source) -> DataFrame:
    return evaluate.calibration(s.view("preds"), "p", "y", by=["source"]).select("source", r("ece").alias("ece"), r("brier").alias("brier"), "positives", "n")


@query("nearest_bin", f"WITH b AS (SELECT {BIN} AS bin, avg(p) AS confidence FROM preds GROUP BY 1) SELECT bin, round(confidence, 6) AS confidence FROM b ORDER BY abs(confidence - 0.65), bin LIMIT 1")
def nearest_bin(s: Source) -> DataFrame:
    return evaluate.best(evaluate.reliability(s.view("preds"), "p", "y").select("bin", "confidence"), F.abs(F.col("confidence") - 0.65), "bin").select("bin", r("confidence").alias("confidence"))


@query("class_weights", "WITH n AS (SELECT l_linenumber AS label, count(*) AS n FROM lineitem GROUP BY l_linenumber) SELECT label, n, round((SELECT sum(n) FROM n) / CAST((SELECT count(*) FROM n) * n AS double), 6) AS weight FROM n")
def class_weights(s: Source) -> DataFrame:
    return evaluate.class_weights(s.table("lineitem").select(F.col("l_linenumber").alias("label")), "label").select("label", "n", r("weight").alias("weight"))


@query("class_cap", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, least(n, 25) AS n, least(n, 25) AS vectors, true AS own FROM n")
def class_cap(s: Source) -> DataFrame:
    """How many rows of each class the cap leaves, how many vectors these are, and whether all are rows of the class."""
    e = s.table("embeddings").select("vec_id", "label")
    few = evaluate.class_cap(e, "label", F.col("vec_id"), 25)
    true = few.join(e.select("vec_id", F.col("label").alias("own")), "vec_id")
    return true.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("vectors"), F.bool_and(F.col("label") == F.col("own")).alias("own"))


@query("annotator_weight", "SELECT l_linenumber AS conf, CASE l_linenumber WHEN 1 THEN 1.0::double WHEN 2 THEN 0.7::double WHEN 3 THEN 0.4::double ELSE 0.4::double END AS weight, count(*) AS n FROM lineitem GROUP BY 1, 2")
def annotator_weight(s: Source) -> DataFrame:
    return s.table("lineitem").groupBy(F.col("l_linenumber").alias("conf"), classify.annotator_weight(F.col("l_linenumber")).alias("weight")).agg(F.count("*").alias("n"))


GRID = "SELECT c_custkey % 7 AS windage, o_orderpriority AS stage, o_totalprice AS e FROM orders JOIN customer ON o_custkey = c_custkey"


@query("best_setting", f"WITH g AS (SELECT stage, windage, median(e) AS m FROM ({GRID}) x GROUP BY stage, windage) SELECT stage, windage, round(m, 4) AS median FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY m, windage) AS k FROM g) z WHERE k = 1")
def best_setting(s: Source) -> DataFrame:
    g = s.sql(GRID).groupBy("stage", "windage").agg(F.median("e").alias("m"))
    return evaluate.best(g, F.col("m"), "windage", ["stage"]).select("stage", "windage", r("m", 4).alias("median"))


@query("param_grid", "SELECT w, k, count(*) AS n, round(sum(value * w + k), 4) AS total FROM events CROSS JOIN (SELECT unnest([0.01, 0.02, 0.03])::double AS w) a CROSS JOIN (SELECT unnest([10, 20]) AS k) b GROUP BY w, k")
def param_grid(s: Source) -> DataFrame:
    grid = s.spark.createDataFrame([(w, k) for w in (0.01, 0.02, 0.03) for k in (10, 20)], "w double, k int")
    return evaluate.parameter_grid(s.table("events"), grid).groupBy("w", "k").agg(F.count("*").alias("n"), r(F.sum(F.col("value") * F.col("w") + F.col("k")), 4).alias("total"))


@query("topk_per_scene", "SELECT l_linenumber AS scene, l_orderkey, l_extendedprice, CAST(k AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice DESC, l_orderkey) AS k FROM lineitem) z WHERE k <= 10")
def topk_per_scene(s: Source) -> DataFrame:
    w = W.partitionBy("scene").orderBy(F.desc("l_extendedprice"), "l_orderkey")
    return s.table("lineitem").select(F.col("l_linenumber").alias("scene"), "l_orderkey", "l_extendedprice").withColumn("rank", F.row_number().over(w)).where("rank <= 10")


SPOTS = """SELECT event_id AS id, CAST(date_trunc('day', ts) AS date) AS run, lat, lon, round(value, 1) AS risk_score, CASE WHEN round(value, 1) >= 60 THEN 'High' WHEN round(value, 1) >= 40 THEN 'Medium' ELSE 'Low' END AS tier,
  event_type AS sensor, ts AS observed FROM obs"""


def _spots(s: Source) -> DataFrame:
    o = s.view("obs")
    risk = F.round("value", 1)
    return o.select(F.col("event_id").alias("id"), F.to_date(F.date_trunc("day", "ts")).alias("run"), "lat", "lon", risk.alias("risk_score"), decide.tier(risk).alias("tier"), F.col("event_type").alias("sensor"), F.col("ts").alias("observed"))


@query("tier_pivot", f"SELECT run, count(*) FILTER (tier = 'High') AS high, count(*) FILTER (tier = 'Medium') AS medium, count(*) FILTER (tier = 'Low') AS low FROM ({SPOTS}) s GROUP BY run")
def tier_pivot(s: Source) -> DataFrame:
    return runs.tier_counts(_spots(s), "run")


@query("run_summary", f"SELECT run, count(*) AS hotspots, count(*) FILTER (tier = 'High') AS high, array_to_string(list(sensor ORDER BY first, sensor), ' + ') AS sensors FROM (SELECT run, tier, sensor, min(observed) OVER (PARTITION BY run, sensor) AS first, row_number() OVER (PARTITION BY run, sensor ORDER BY observed) AS k FROM ({SPOTS}) a) b GROUP BY run HAVING false".replace("HAVING false", "HAVING true").replace("list(sensor ORDER BY first, sensor)", "list(sensor ORDER BY first, sensor) FILTER (k = 1)"))
def run_summary(s: Source) -> DataFrame:
    return runs.summaries(_spots(s), "run", "sensor", "observed")


@query("run_index", f"SELECT DISTINCT 'live_' || strftime(run, '%Y%m%d') AS run_id FROM ({SPOTS}) s")
def run_index(s: Source) -> DataFrame:
    return runs.index(_spots(s).select(F.concat(F.lit("live_"), F.date_format("run", "yyyyMMdd")).alias("run_id")), "run_id")


@query("ranked_spots", f"SELECT run, id, risk_score, CAST(row_number() OVER (PARTITION BY run ORDER BY risk_score DESC, id) AS int) AS rank FROM ({SPOTS}) s")
def ranked_spots(s: Source) -> DataFrame:
    return decide.ranked(_spots(s)).select("run", "id", "risk_score", "rank")


@query("briefing_insights", f"""
SELECT run, count(*) FILTER (tier <> 'Low') AS attention, arg_min(id, CASE WHEN risk_score >= 30 THEN risk_score * 1e7 + id END) AS first_landfall, arg_max(id, risk_score * 1e7 - id) AS fastest, count(DISTINCT CAST(observed AS date)) AS passes FROM ({SPOTS}) s GROUP BY run""")
def briefing_insights(s: Source) -> DataFrame:
    return runs.briefing(_spots(s), "run")


@query("earlier_runs", f"SELECT a.run, count(DISTINCT b.run) AS earlier FROM (SELECT DISTINCT run FROM ({SPOTS}) s) a LEFT JOIN (SELECT DISTINCT run FROM ({SPOTS}) t) b ON b.run < a.run GROUP BY a.run")
def earlier_runs(s: Source) -> DataFrame:
    return runs.history(_spots(s).select("run"), "run")


@query("night_bands", """
WITH g AS (SELECT user_id, min(date_trunc('hour', ts)) AS t0 FROM events GROUP BY user_id), q AS (SELECT user_id, t0 + to_minutes(15 * k) AS t FROM g CROSS JOIN (SELECT unnest(range(193)) AS k) z),
n AS (SELECT *, extract(hour FROM t + INTERVAL 330 MINUTE) >= 18 OR extract(hour FROM t + INTERVAL 330 MINUTE) < 6 AS night FROM q),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - row_number() OVER (PARTITION BY user_id, night ORDER BY t) AS grp FROM n)
SELECT user_id, min(t) AS starts, max(t) AS ends FROM i WHERE night GROUP BY user_id, grp""")
def night_bands(s: Source) -> DataFrame:
    events = s.table("events")
    starts = events.groupBy("user_id").agg(F.min(F.date_trunc("hour", "ts")).cast("timestamp_ntz").alias("t0"))
    return temporal.night_bands(starts, "user_id", "t0", 48)


@query("local_time", "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%d %b %Y %H:%M') AS ist, CAST(floor(date_diff('second', date_trunc('hour', ts), ts) / 3600.0 + 0.5) AS bigint) AS age_h, strftime(date_trunc('hour', ts), 'live_%Y%m%d_%H00') AS run_id FROM events")
def local_time(s: Source) -> DataFrame:
    return s.table("events").select("event_id", temporal.ist(F.col("ts")).alias("ist"), temporal.hours_between(F.date_trunc("hour", "ts"), F.col("ts")).alias("age_h"), temporal.live_run_id(F.col("ts")).alias("run_id"))


@query("stream_id", "SELECT DISTINCT CAST(year(o_orderdate) AS int) AS y, CASE WHEN year(o_orderdate) >= 2011 THEN 400 WHEN year(o_orderdate) >= 2001 THEN 300 WHEN year(o_orderdate) >= 1992 THEN 200 ELSE 100 END AS stream FROM orders")
def stream_id(s: Source) -> DataFrame:
    return s.table("orders").select(F.year("o_orderdate").alias("y"), temporal.stream_number(F.year("o_orderdate")).alias("stream")).distinct()


@query("granule_time", "SELECT p_partkey AS id, CAST(TIMESTAMP '2024-01-01' + to_seconds(p_partkey * 61) AS timestamp) AS t FROM part")
def granule_time(s: Source) -> DataFrame:
    named = s.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("PACE_OCI."), F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 61), "yyyyMMdd'T'HHmmss"), F.lit(".L2.OC_AOP.nc")).alias("name"))
    return named.select("id", temporal.granule_time(F.col("name")).alias("t"))


@query("catalogue_search", """
WITH c AS (SELECT p_partkey AS id, CAST(p_size % 31 AS double) AS cloud, p_retailprice, abs(p_size - 25) AS days FROM part)
SELECT id, days, cloud, CAST(row_number() OVER (ORDER BY days, cloud, id) AS int) AS place FROM (SELECT * FROM c WHERE days <= 6 AND cloud < 20 ORDER BY id LIMIT 20) z""")
def catalogue_search(s: Source) -> DataFrame:
    c = s.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 31).cast("double").alias("cloud"), F.abs(F.col("p_size") - 25).alias("days"))
    return runs.search(c, days=6, max_cloud=20.0, most=20)


@query("granule_rank", """
WITH g AS (SELECT p_partkey AS id, p_size / 50.0 AS coverage, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 4 * 25 END AS cloud FROM part)
SELECT id, round(coverage * (1 - (CASE WHEN coalesce(cloud, 0) = 0 THEN 100 ELSE cloud END) / 100.0), 6) AS score FROM g WHERE coverage > 0.05""")
def granule_rank(s: Source) -> DataFrame:
    g = s.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("coverage"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 4 * 25).alias("cloud"))
    return runs.rank_granules(g).select("id", r("score").alias("score"))


@query("concat_sources", "SELECT 'a' AS label, count(*) AS n, count(extra) AS extras FROM (SELECT o_orderkey AS id, NULL AS extra FROM orders UNION ALL SELECT c_custkey, c_name FROM customer) z UNION ALL SELECT 'b', count(DISTINCT id), 0 FROM (SELECT o_custkey AS id FROM orders UNION ALL SELECT c_custkey FROM customer) y")
def concat_sources(s: Source) -> DataFrame:
    o, c = s.table("orders"), s.table("customer")
    a = o.select(F.col("o_orderkey").alias("id")).unionByName(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("extra")), allowMissingColumns=True).agg(F.lit("a").alias("label"), F.count("*").alias("n"), F.count("extra").alias("extras"))
    b = o.select(F.col("o_custkey").alias("id")).union(c.select("c_custkey")).distinct().agg(F.lit("b").alias("label"), F.count("*").alias("n"), F.lit(0).cast("long").alias("extras"))
    return a.union(b)


@query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS bigint)) AS bigint) AS total, count(*) FILTER (json_extract(props, '$.none') IS NULL) AS missing FROM events GROUP BY event_type")
def json_props(s: Source) -> DataFrame:
    k = F.from_json("props", "k bigint, none bigint")
    return s.table("events").withColumn("j", k).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("j.k").alias("total"), F.count_if(F.col("j.none").isNull()).alias("missing"))


@query("hour_window", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(max(value), 4) AS top FROM events GROUP BY 1, 2")
def hour_window(s: Source) -> DataFrame:
    return s.table("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), r(F.max("value"), 4).alias("top")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "top")


@query("percentile_stretch", "SELECT l_returnflag AS band, round(quantile_cont(l_extendedprice, 0.01), 4) AS low, round(quantile_cont(l_extendedprice, 0.997), 4) AS high FROM lineitem GROUP BY l_returnflag")
def percentile_stretch(s: Source) -> DataFrame:
    p = F.percentile("l_extendedprice", F.array(F.lit(0.01), F.lit(0.997)))
    return s.table("lineitem").groupBy(F.col("l_returnflag").alias("band")).agg(p.alias("p")).select("band", r(F.get("p", F.lit(0)), 4).alias("low"), r(F.get("p", F.lit(1)), 4).alias("high"))


@query("class_spectra", "SELECT label, CAST(i - 1 AS int) AS band, round(avg(embedding[i]), 6) AS mean, count(*) AS n FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i) z GROUP BY label, i")
def class_spectra(s: Source) -> DataFrame:
    return evaluate.spectra(s.table("embeddings"), "label", "embedding").select("label", "band", r("mean").alias("mean"), "n")


@query("format_labels", "SELECT s_suppkey AS id, printf('HS-%02d', s_suppkey) AS label, printf('%.2fN %.2fE', s_acctbal, s_acctbal / 7) AS place, printf('%.0f%%', s_suppkey % 100 * 1.0) AS pct FROM supplier")
def format_labels(s: Source) -> DataFrame:
    return s.table("supplier").select(F.col("s_suppkey").alias("id"), F.format_string("HS-%02d", "s_suppkey").alias("label"), F.format_string("%.2fN %.2fE", F.col("s_acctbal"), F.col("s_acctbal") / 7).alias("place"), F.format_string("%.0f%%", (F.col("s_suppkey") % 100).cast("double")).alias("pct"))
