"""Derived inputs, as SQL that Spark and other engines read alike, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import refdata

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings")

VIEWS = {
    # observations: events at places of the region
    "obs": """SELECT event_id, user_id, event_type, ts, value, 4 + 19 * (((event_id * 7919) % 10007) / CAST(10007 AS double)) AS lat,
      79 + 17 * (((event_id * 104729) % 10009) / CAST(10009 AS double)) AS lon FROM events""",
    "sites19": refdata.values_sql(refdata.SITES, "name, type, lat, lon, weight"),
    "mouths12": refdata.values_sql(refdata.MOUTHS, "name, lat, lon"),
    "ports8": refdata.values_sql(refdata.PORTS, "name, lat, lon"),
    # pixels: two scenes of 40 by 40 with bands from averages; every cell is there, some without a value. The odd factors keep values off
    # the ties of later rounding, which engines may break either way
    "cells": """SELECT l_linenumber % 2 AS scene, CAST(l_orderkey % 40 AS int) AS row, CAST(l_partkey % 40 AS int) AS col, count(*) AS n,
      avg(l_discount) * CAST(0.9731246137 AS double) AS B2, avg(l_tax) * CAST(0.9817253931 AS double) AS B3, avg(l_quantity) * CAST(0.0019732461 AS double) AS B4, avg(l_extendedprice) * CAST(0.0000009731246 AS double) AS B6,
      avg(l_quantity * l_discount) * CAST(0.0497312461 AS double) AS B8, avg(l_tax * l_discount) * CAST(19.731246137 AS double) AS B11, avg(l_quantity + l_suppkey % 7) * CAST(0.9897312461 AS double) AS v
      FROM lineitem GROUP BY l_linenumber % 2, l_orderkey % 40, l_partkey % 40""",
    "frame": """SELECT s.r_regionkey AS scene, a.k AS row, b.k AS col FROM (SELECT r_regionkey FROM region WHERE r_regionkey < 2) s
      CROSS JOIN (SELECT DISTINCT CAST(l_orderkey % 40 AS int) AS k FROM lineitem) a CROSS JOIN (SELECT DISTINCT CAST(l_partkey % 40 AS int) AS k FROM lineitem) b""",
    "pix": """SELECT f.scene, f.row, f.col, 40 AS rows, 40 AS cols, 10 + f.row * CAST(0.01 AS double) AS lat, 85 + f.col * CAST(0.01 AS double) AS lon, B2, B3, B4, B6, B8, B11, v,
      c.n IS NOT NULL AND (f.row * 7 + f.col * 3) % 29 <> 0 AS valid FROM frame f LEFT JOIN cells c ON c.scene = f.scene AND c.row = f.row AND c.col = f.col""",
    "spots": "SELECT scene, row, col FROM pix WHERE valid AND B2 > 0.055 AND B3 > 0.042",
    # a velocity field: eight times, six latitudes, ten longitudes
    "field": """SELECT 'currents' AS kind, CAST(o_orderkey % 8 AS double) AS t, CAST(4 + o_custkey % 6 AS double) AS lat, CAST(80 + (o_orderkey + o_custkey) % 10 AS double) AS lon,
      avg(o_totalprice) * CAST(0.0000019731246 AS double) - CAST(0.4 AS double) AS u, avg(o_totalprice % 1000) * CAST(0.00099731246 AS double) - CAST(0.5 AS double) AS v FROM orders GROUP BY o_orderkey % 8, o_custkey % 6, (o_orderkey + o_custkey) % 10""",
    # tracks: the first observation of each user on each day
    "track": """SELECT user_id, d, lat, lon, event_type FROM (SELECT user_id, date_trunc('day', ts) AS d, lat, lon, event_type,
      row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS k FROM obs) z WHERE k = 1""",
    "preds": """SELECT l.doc_id, l.quality AS y, (d.n_chars % 1000) * CAST(0.00099731246137 AS double) AS p, CASE WHEN d.n_chars % 1000 >= 400 THEN 1 ELSE 0 END AS predicted, d.source, d.lang
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    # snapshots of ensembles: orders as particles of their customers
    "parts": """SELECT o_custkey % 40 AS id, o_orderkey AS particle, 10 + (o_orderkey % 97) * CAST(0.0101246137 AS double) AS lat, 85 + (o_orderkey % 89) * CAST(0.0099731246 AS double) AS lon, o_orderpriority = '1-URGENT' AS beached,
      CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderkey % 48 + 1 AS double) END AS beach_h FROM orders""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Source:
    """The tables and derived views of one directory. Views go by their plain names in the session: a query's plan is made before the next one's."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run text with tables and views as common table expressions would: each name it mentions is registered first."""
        import re

        words = set(re.findall(r"\w+", text))
        for name in TABLES:
            if name in words:
                self.table(name).createOrReplaceTempView(name)
        for name in VIEWS:
            if name in words:
                self.view(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])


def unsigned_zeros(text: str) -> str:
    """text with each round(...) made to give 0 rather than -0, as Spark's does."""
    out, i = "", 0
    while (at := text.find("round(", i)) >= 0:
        end, depth = at + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        call = text[at:end]
        out += text[i:at] + f"(CASE WHEN {call} = 0 THEN 0 ELSE {call} END)"
        i = end
    return out + text[i:]


def oracle(text: str) -> str:
    """text with the views that it mentions put in front."""
    import re

    text = unsigned_zeros(text)

    wanted: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]) and other not in wanted:
                need(other)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            need(name)
    recursive = "WITH RECURSIVE" in text
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = re.sub(r"^\s*WITH( RECURSIVE)?\s", ", ", text) if re.match(r"\s*WITH\s", text) else f" {text}"
    return f"WITH {'RECURSIVE ' * recursive}{parts}{body}" if wanted else text


def query(name: str, sql: str | None = None):
    """Register a query over a Source, with its SQL where there is some."""

    def wrap(f: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return wrap
