"""A Merkle manifest of a table of documents: a tree of 16 for each source, and one over the sources' roots.

Leaves are dealt into aligned blocks of 16 ** LEVELS. A block is traversed in postorder: each subtree returns its digest, and while the
recursion unwinds each subtree's siblings are appended to the leaves that it holds. The blocks' roots are the leaves of the next traversal, which is distributed
in the same way, until one node of each source is left; the sources' roots go through the same rounds. Paths then come down: a
block's own path is appended to those of its leaves, so that a leaf's path leads to the root of the whole.

A path is an array of steps (left, right), one for each level: the digests of a run that stand left and right of the node, joined. A run of one node has a
step with neither.

Defined cases: nulls of the five columns are `-` in a leaf; a null source is a source, the first; a null doc_id comes first in its source; rows that share
source and doc_id are ordered by leaf, repeated rows are leaves beside each other; a source of one document has its leaf as its root, and a table of one source that
source's root; an empty table gives an empty manifest; texts of any length are whole; extra columns pass through `manifest` unless a result has
their name (in any case), and are no part of a leaf."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FAN = 16
#: Levels of a block: it holds FAN ** LEVELS nodes at most.
LEVELS = 2
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULTS = ("leaf", "subroot", "root", "path")
STEPS = "array<struct<left: string, right: string>>"
HEX = 64


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf(*fields: Column) -> Column:
    """The digest of some values, each with its length in bytes before it."""
    said = [f.cast("string") for f in fields]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said)))


def traverse(nodes: list[str], levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and paths of a block of consecutive nodes, raised by so many levels."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]

    def subtree(first: int, level: int) -> str:
        if level == 0:
            return nodes[first]
        width = FAN ** (level - 1)
        starts = range(first, min(first + FAN * width, len(nodes)), width)
        run = "".join([subtree(i, level - 1) for i in starts])
        for k, i in enumerate(starts):
            step = run[: HEX * k], run[HEX * (k + 1) :]
            for held in paths[i : i + width]:
                held.append(step)
        return hashlib.sha256(run.encode()).hexdigest()

    return subtree(0, levels), paths


def height(n: int) -> int:
    """Levels by which a block of a tree of n nodes is raised: up to its root, or whole blocks."""
    levels = 0
    while levels < LEVELS and FAN**levels < n:
        levels += 1
    return levels


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with place (long, from 0): its rows' places in an order over all of them. Rows are dealt by range and numbered in their partitions; the partitions'
    sizes, a row each, give what stands before. Equal rows are dealt by where they come from, so that many of them fill no single task."""
    aside = df.withColumn("_from", F.monotonically_increasing_id())
    order = [*order, F.col("_from")]
    placed = aside.repartitionByRange(*order).sortWithinPartitions(*order).drop("_from").withColumn("_id", F.monotonically_increasing_id())
    placed = common.written(placed.select("*", F.shiftright("_id", 33).alias("_part")), name)
    upto = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(upto, F.lit(0)).alias("_before"))
    own = [c for c in placed.columns if c not in ("_id", "_part")]
    return placed.join(F.broadcast(parts), "_part").select(*own, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("place"))


def raised(nodes: DataFrame) -> DataFrame:
    """The roots of the blocks of (tree, place, n, digest), as nodes of the next traversal."""

    def root(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        n = block["n"][0].as_py()
        found, _ = traverse(block["digest"].to_pylist(), height(n))
        return pa.table({"tree": block["tree"][:1], "place": block["block"][:1], "n": pa.array([-(-n // BLOCK)]), "digest": pa.array([found])})

    blocks = nodes.select("tree", F.shiftright("place", BLOCK.bit_length() - 1).alias("block"), "place", "n", "digest")
    return blocks.groupBy("tree", "block").applyInArrow(root, "tree long, place long, n long, digest string")


def climbed(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The tables of all traversals from (tree, place, n, digest), which is the first of them, written, to the trees' roots. A round is 1/256 of the one before."""
    levels = [nodes]
    while (most := levels[-1].agg(F.max("n")).first()[0]) is not None and most > 1:
        levels.append(common.written(raised(levels[-1].where("n > 1")), name))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of all trees: a tree ends at the level where it has one node."""
    found = [x.where("n = 1").select("tree", "digest") for x in levels]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def lowered(nodes: DataFrame, above: DataFrame, tops: DataFrame, extra: dict[str, str]) -> DataFrame:
    """nodes with path, subroot and root. above: those of their blocks (tree, place, path, subroot, root); tops: those of the trees' roots (tree, path, subroot, root).
    extra: further columns of nodes that stay, with their types."""
    keep = ["tree", "place", *extra]
    types = {"tree": "long", "place": "long"} | extra | {"path": STEPS, "subroot": "string", "root": "string"}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items())
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def append(key: tuple, block: pa.Table, top: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        _, paths = traverse(block["digest"].to_pylist(), height(block["n"][0].as_py()))
        rest = [(s["left"], s["right"]) for s in top["path"][0].as_py()]
        both = [p + rest for p in paths]
        ends = pa.array([0, *(i * len(both[0]) for i in range(1, len(both) + 1))], pa.int32())
        steps = [s for p in both for s in p]
        path = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.string())], ["left", "right"])).cast(kind)
        repeat = lambda c: pa.array([top[c][0].as_py()] * block.num_rows, pa.string())
        return pa.table([*(block[c] for c in keep), path, repeat("subroot"), repeat("root")], names=list(types))

    blocks = nodes.where("n > 1").withColumn("block", F.shiftright("place", BLOCK.bit_length() - 1))
    held = blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "place")).applyInArrow(append, schema)
    done = nodes.where("n = 1").join(common.if_small(tops), "tree").select(*types)
    return held.union(done)


def paths(levels: list[DataFrame], tops: DataFrame, extra: dict[str, str], name: str) -> DataFrame:
    """The first level's nodes with path, subroot and root: from the top downwards, each traversal's table is written but the last one's."""
    above = levels[-1].where("n = 1").join(common.if_small(tops), "tree").select("tree", "place", "path", "subroot", "root")
    for nodes in levels[-2:0:-1]:
        above = common.written(lowered(nodes, above, tops, {}), name)
    if len(levels) == 1:
        return levels[0].join(common.if_small(tops), "tree").select("tree", "place", *extra, "path", "subroot", "root")
    return lowered(levels[0], above, tops, extra)


def manifest(docs: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """docs' rows (its columns but text, and what `keep` computes from docs) with leaf, subroot, root (hex digests) and path.

    Texts are read once and moved nowhere: what is dealt by range, traversed and written is a digest and the narrow columns for each document."""
    keep = keep or {}
    own = [c for c in common.others(docs, RESULTS) if c not in ("text", *keep)]
    spark = docs.sparkSession
    names = dict(zip(own, (f"c{i}" for i in range(len(own))))) | {c: f"k{i}" for i, c in enumerate(keep)}
    narrow = docs.select(*(F.col(c).alias(names[c]) for c in own), *(x.alias(names[c]) for c, x in keep.items()), leaf(*(F.col(c) for c in FIELDS)).alias("digest"))
    source, doc = names["source"], names["doc_id"]
    rows = numbered(common.written(narrow, "leaves"), [F.col(source).asc_nulls_first(), F.col(doc).asc_nulls_first(), F.col("digest")], "placed")
    sources = common.written(rows.groupBy(source).agg(F.min("place").alias("tree"), F.count("*").alias("n")), "sources").withColumnRenamed(source, "_of")
    nodes = rows.join(common.if_small(sources), common.same(F.col(source), F.col("_of"))).withColumn("place", F.col("place") - F.col("tree")).drop("_of")
    levels = climbed(common.written(nodes, "nodes"), "raised")

    upper = numbered(roots(levels).withColumnRenamed("tree", "of"), [F.col("of")], "subroots").withColumn("tree", F.lit(0).cast("long"))
    upper = common.written(upper.crossJoin(F.broadcast(upper.agg(F.count("*").alias("n")))), "subroots")
    over = climbed(upper, "raised")
    top = roots(over).select("tree", F.expr(f"CAST(array() AS {STEPS})").alias("path"), F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"))
    kinds = {"of": "long", "digest": "string"}
    tops = common.written(paths(over, top, kinds, "lowered").select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "tops")

    extra = {names[c]: nodes.schema[names[c]].dataType.simpleString() for c in names} | {"digest": "string"}
    out = paths(levels, tops, extra, "lowered")
    back = {v: k for k, v in names.items()} | {"digest": "leaf"}
    return out.select(*(F.col(c).alias(back[c]) for c in extra), "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def siblings(path: Column) -> Column:
    """All siblings' digests on a path, joined, level by level and from left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


#: ASCII letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(*FIELDS)
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    small = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.translate("text", UPPER, LOWER))
    m = manifest(docs, {"tampered": F.when(chosen, small)})
    root = m.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return root.withColumn("verified", F.col("folded_root") == F.col("root"))


_F = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
_T = lambda text: "sha256(" + " || ".join([*(_F(f"CAST({c} AS varchar)") for c in FIELDS[:4]), _F(text)]) + ")"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS varchar), ''), lambda c: CAST(ord(c) AS bigint))), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
OP12_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, source, {_T('text')} AS leaf,
    {_T(f"translate(text, '{UPPER}', '{LOWER}')")} AS small, {_CRC} % 5 = 0 AS chosen FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM l),
up AS (SELECT source, 0 AS level, place, n, leaf AS digest FROM o UNION ALL
  SELECT source, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY source, level, place // 16, n),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
over_s AS (SELECT 0 AS level, place, n, subroot AS digest FROM s UNION ALL
  SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM over_s WHERE n > 1 GROUP BY level, place // 16, n),
runs AS (SELECT source, level, place // 16 AS run, string_agg(digest, '' ORDER BY place) AS d FROM up WHERE n > 1 GROUP BY source, level, place // 16),
over_runs AS (SELECT level, place // 16 AS run, string_agg(digest, '' ORDER BY place) AS d FROM over_s WHERE n > 1 GROUP BY level, place // 16),
w AS (SELECT doc_id, source, leaf, 0 AS level, place, n, '' AS proof, CASE WHEN chosen THEN small ELSE leaf END AS node FROM o UNION ALL
  SELECT w.doc_id, w.source, leaf, w.level + 1, place // 16, (n + 15) // 16, proof || substr(d, 1, 64 * (place % 16)) || substr(d, 64 * (place % 16) + 65),
    sha256(substr(d, 1, 64 * (place % 16)) || node || substr(d, 64 * (place % 16) + 65)) FROM w JOIN runs r ON w.source IS NOT DISTINCT FROM r.source AND w.level = r.level AND w.place // 16 = r.run WHERE n > 1),
v AS (SELECT doc_id, leaf, subroot, 0 AS level, s.place, s.n, proof, node FROM w JOIN s ON w.source IS NOT DISTINCT FROM s.source WHERE w.n = 1 UNION ALL
  SELECT v.doc_id, leaf, subroot, v.level + 1, place // 16, (n + 15) // 16, proof || substr(d, 1, 64 * (place % 16)) || substr(d, 64 * (place % 16) + 65),
    sha256(substr(d, 1, 64 * (place % 16)) || node || substr(d, 64 * (place % 16) + 65)) FROM v JOIN over_runs r ON v.level = r.level AND v.place // 16 = r.run WHERE n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM v CROSS JOIN (SELECT digest AS root FROM over_s WHERE n = 1) z WHERE v.n = 1
"""
