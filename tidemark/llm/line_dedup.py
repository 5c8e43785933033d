"""Line dedup: windows of three consecutive lines that occur again, in the same or another document, are removed where they recur.

Every document's lines (split at \\n) form overlapping windows. A window's first occurrence, in order of document and position, stays;
the positions that its later occurrences cover are merged and their lines removed. Each removed line is thus left at an earlier place.

Defined cases: a null text stays null with 0 lines; texts of fewer than three lines have no window and stay; windows without any word
are not compared; documents are ordered by doc_id, null last, then by a digest of the text, so rows that repeat id and text are one
document and are treated alike; an empty table gives an empty result; extra columns pass through, ones named n_lines or n_removed (in any case) are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(at, h1, h2): at = struct of the document's order and the window's first position, h1 and h2 the 128-bit key of its lines.
    Lines are hashed once each; a window's key is that of its lines' hashes."""
    lines = F.split("text", "\n")
    keyed = docs.select(
        F.col("doc_id").isNull().alias("last"), "doc_id", F.md5("text").alias("fp"),
        F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"), F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")).alias("word"))).alias("lines"),
    ).where(F.size("lines") >= size)
    part = lambda f: [F.get("lines", F.col("pos") + i).getField(f) for i in range(size)]
    return (
        keyed.distinct().select("*", F.explode(F.expr(f"sequence(0, size(lines) - {size})")).alias("pos"))
        .where(" OR ".join(f"lines[pos + {i}].word" for i in range(size)))
        .select(F.struct("last", "doc_id", "fp", "pos").alias("at"), F.xxhash64(*part("a")).alias("h1"), F.xxhash64(*part("b"), F.lit(size)).alias("h2"))
    )


def removals(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, fp, gone): the sorted positions to remove of each document that has any.

    First places are aggregated before the shuffle; only windows that occur twice or more join back, by a plain equi-join whose hot keys
    AQE splits; what is gathered in one row is a single document's positions."""
    w = common.written(windows(docs.select("doc_id", "text"), size), "windows")
    first = w.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = w.join(first, ["h1", "h2"]).where(F.col("at") != F.col("first"))
    return (
        later.select("at.doc_id", "at.fp", "at.pos").groupBy("doc_id", "fp").agg(F.collect_set("pos").alias("starts"))
        .select("doc_id", "fp", F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (size - 1)))))).alias("gone"))
    )


def dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with text rewritten, and n_lines and n_removed (long)."""
    own = common.others(docs, ("n_lines", "n_removed"))
    i, fp, at, key = common.free_names(docs, "_id", "_fp", "_gone", "_key")
    gone = removals(docs, size).select(F.col("doc_id").alias(i), F.col("fp").alias(fp), F.col("gone").alias(at))
    lines, places = F.split("text", "\n"), F.col(at)
    # positions are sorted, so runs of kept lines are the slices between them
    edges = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), lambda k: F.slice(lines, F.get(edges, k) + 2, F.get(edges, k + 1) - F.get(edges, k) - 1)))
    joined = docs.select(*own).withColumn(key, F.md5("text")).join(gone, common.same(F.col("doc_id"), F.col(i)) & (F.col(key) == F.col(fp)), "left")
    text = F.when(places.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    n = lambda there, value: F.when(there, 0).otherwise(value).cast("long")
    return joined.select(*(text if c.lower() == "text" else F.col(c) for c in own), n(F.col("text").isNull(), F.size(lines)).alias("n_lines"), n(places.isNull(), F.size(places)).alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS body
  FROM (SELECT *, unnest(range(len(l) - 2)) AS pos FROM d WHERE len(l) >= 3) z),
n AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST, md5(text), pos) AS k FROM w WHERE regexp_matches(body, '[^\x20\x09-\x0D]')),
g AS (SELECT DISTINCT doc_id, text, pos + o AS pos FROM n CROSS JOIN (SELECT unnest(range(3)) AS o) z WHERE k > 1),
a AS (SELECT p.doc_id, p.text, p.pos, p.l[p.pos + 1] AS line, g.pos IS NULL AS kept
  FROM (SELECT *, unnest(range(len(l))) AS pos FROM d) p LEFT JOIN g ON g.doc_id = p.doc_id AND g.text = p.text AND g.pos = p.pos),
r AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '') AS new FROM a GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE new END AS text
FROM documents d LEFT JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.text = r.text
"""
