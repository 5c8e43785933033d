"""Embedding near-dedup by product quantisation: inverted lists, residual subspace codes, asymmetric distances, exact cosine rerank.

Equal vectors of a label are one before anything else. Coarse centroids and subspace codebooks are fitted on a bounded sample (`sample` vectors,
drawn by hash); every vector is indexed: its list, the codes of its residual, and the distance between it and what the codes stand for.

Probes suffice by geometry, not by a count. On unit vectors cosine >= t is distance <= r = sqrt(2 - 2t). A vector has others within r in
list c only if it is within r of the plane between c and its own list, and within r of the list's ball (its radius over all members); its codes are
sent to all such lists. There the list's own vectors are the queries: |ADC - error| <= distance, so a candidate is dropped only if its table-lookup
distance less its code error is above r. What is left is ranked by exact cosine in double precision. No link at or above the threshold is lost
for any centroids.

Lists number with the square root of the largest label, so codes sent grow with less than the square. A vector itself is sent to its own list only, and once
more for the blocks in which the table lookup leaves it a candidate: codes and ids go first. Work in a list is dealt in blocks of queries and
of members. A block returns counts per vector and a forest of its links, never the pairs, so a large group of near copies costs its comparisons but no rows.

Defined cases: a vector that is null, zero, holds a null or non-finite component, or has no label or vec_id links with nothing; vectors of different lengths
are compared within their length only; rows that repeat (also with one vec_id) count as linked to each other; rows that share a vec_id but not vector and
label are vectors of their own, each with its links; an empty table gives an empty result; extra columns are left out, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import grouped

LEAST = 0.98
SAMPLE = 20_000
#: Lists: the square root of the largest label's distinct vectors, divided by this.
ROOTS_PER_LIST = 8
SUBSPACES, CODES = 8, 64
#: Queries and members of a block.
QUERIES, MEMBERS = 256, 768


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    draw = np.random.default_rng(seed)
    c = x[draw.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, clipped at 0."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids and subspace codebooks for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 11):
        self.coarse = _kmeans(sample, lists, seed)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [_kmeans(rest[:, a:b], CODES, seed + 1) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, code error and distance from the list's centroid of each vector."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)], 1).astype(np.uint8)
        return at, codes, np.sqrt(((rest - self.stands_for(codes)) ** 2).sum(1)), np.sqrt((rest * rest).sum(1))

    def stands_for(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], 1)

    def probes(self, x: np.ndarray, at: np.ndarray, r: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list that can hold a vector within r; radius: of each list's ball, below 0 for an empty one."""
        d = distances(x, self.coarse)
        own = d[np.arange(len(x)), at][:, None]
        apart = np.sqrt(distances(self.coarse, self.coarse))[at]
        plane = (d - own <= 2 * (r + 1e-6) * apart) | (apart == 0)
        return np.nonzero(plane & (np.sqrt(d) <= radius + r + 1e-6) & (radius >= 0))

    def adc(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """(members, queries): distances from q to what the members' codes in list `at` stand for, by table lookup: a row of a table holds
        one code's distances from all queries."""
        rest = q - self.coarse[at]
        total = np.zeros((len(codes), len(q)), np.float32)
        for s, ((a, b), book) in enumerate(zip(zip(self.cuts, self.cuts[1:]), self.books)):
            total += distances(book, rest[:, a:b]).astype(np.float32)[codes[:, s]]
        return np.sqrt(total)


class Forest(dict):
    """Union-find over what is put in; smaller ids lead."""

    def find(self, x):
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self.setdefault(up, up)
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    size = np.diff(b.column("embedding").offsets.to_numpy())
    for d in np.unique(size):
        yield int(d), b.filter(pa.array(size == d))


def fitted(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, Index]:
    """An index for each length of vectors (label, embedding), from about `sample` of them."""
    lengths = [x.d for x in vectors.select(F.size("embedding").alias("d")).distinct().collect()]
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    part, lists = min(1.0, sample / max(sizes["all"] or 0, 1)), max(1, round((sizes["most"] or 0) ** 0.5 / ROOTS_PER_LIST))
    drawn = vectors.where(F.pmod(F.xxhash64("embedding", F.lit("sample")), F.lit(1 << 30)) < int(part * (1 << 30))).select("embedding").toArrow().column(0).combine_chunks()
    length = np.diff(drawn.offsets.to_numpy()) if len(drawn) else np.zeros(0, np.int64)
    out = {}
    for d in lengths:
        rows = np.flatnonzero(length == d)
        # a rare length that the sample missed: one list at the origin, one code, exact rerank of what the error leaves
        out[d] = Index(unit(_matrix(drawn.take(pa.array(rows)))), lists) if len(rows) else Index(np.zeros((1, d)), 1)
    return out


def linked(vectors: DataFrame, least: float = LEAST, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors (node, label, embedding, n): (node, n_links) of those with links to others, and forest edges (a, b)."""
    spark = vectors.sparkSession
    r = float(np.sqrt(max(0.0, 2 - 2 * least)))
    limit = np.float32(r + 1e-4)  # the table lookup is in single precision
    shared = spark.sparkContext.broadcast(fitted(vectors, sample))
    label = f"label {vectors.schema['label'].dataType.simpleString()}"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, own in _by_length(b):
                at, codes, error, far = shared.value[d].encode(unit(_matrix(own.column("embedding"))))
                new = [pa.array(np.full(len(at), d, np.int32)), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(far)]
                yield pa.RecordBatch.from_arrays([*own.columns, *new], names=[*own.schema.names, "d", "at", "codes", "error", "far"])

    indexed = vectors.select("node", "label", "embedding", "n").mapInArrow(index, f"node string, {label}, embedding {vectors.schema['embedding'].dataType.simpleString()}, n long, d int, at int, codes binary, error double, far double")
    indexed = common.written(indexed, "indexed")
    radius = {d: np.full(len(ix.coarse), -1.0) for d, ix in shared.value.items()}
    for x in indexed.groupBy("d", "at").agg(F.max("far").alias("far")).collect():  # a row per list
        radius[x.d][x.at] = x.far
    balls = spark.sparkContext.broadcast(radius)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, own in _by_length(b):
                row, lists = shared.value[d].probes(unit(_matrix(own.column("embedding"))), own.column("at").to_numpy(), r, balls.value[d])
                cut = np.searchsorted(row, np.arange(own.num_rows + 1))
                probes = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(lists.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("node", "label", "d", "at", "codes", "error")), probes], names=["node", "label", "d", "home", "codes", "error", "probes"])

    sent = indexed.select("node", "label", "embedding", "d", "at", "codes", "error").mapInArrow(probe, f"node string, {label}, d int, home int, codes binary, error double, probes array<int>")
    sent = common.written(sent.select("node", "label", "d", "home", "codes", "error", F.explode("probes").alias("at")), "probes")
    # queries lie in blocks and meet each block of the codes sent to their list
    task = ["label", "d", "at", "mb", "qb"]
    blocks = lambda df, size, name: df.groupBy("label", "d", "at").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = common.if_small(common.written(blocks(indexed, QUERIES, "q_blocks").join(blocks(sent, MEMBERS, "m_blocks"), ["label", "d", "at"]), "lists"))
    own_block = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = lambda kind: F.lit(None).cast(kind)
    members = sent.join(grid, ["label", "d", "at"]).withColumn("mb", own_block("m_blocks", 1)).withColumn("qb", every("q_blocks"))
    queries = indexed.join(grid, ["label", "d", "at"]).withColumn("qb", own_block("q_blocks", 2)).withColumn("mb", every("m_blocks"))
    dealt = members.select(*task, F.lit(True).alias("member"), "node", "home", "codes", "error", none(indexed.schema["embedding"].dataType).alias("embedding")).union(
        queries.select(*task, F.lit(False), "node", none("int"), none("binary"), none("double"), "embedding"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block, the queries and members that are candidates of each other."""
        for key, group in grouped(batches, task):
            member = group.column("member").to_numpy()
            m, q = np.flatnonzero(member), np.flatnonzero(~member)
            if not len(m) or not len(q):
                continue
            names, ix = group.column("node").to_numpy(), shared.value[key[1]]
            x = unit(_matrix(group.column("embedding").take(pa.array(q)).combine_chunks()))
            part = group.take(pa.array(m))
            home, error = part.column("home").to_numpy(), part.column("error").to_numpy().astype(np.float32)
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(m), -1)
            i, j = [], []
            for at in np.unique(home):
                own = np.flatnonzero(home == at)
                a, b = np.nonzero(ix.adc(x, int(at), codes[own]) - error[own, None] <= limit)
                i.append(m[own[a]])
                j.append(q[b])
            i, j = np.concatenate(i), np.concatenate(j)
            good = names[i] != names[j]
            kept = np.concatenate([np.unique(i[good]), np.unique(j[good])])
            if len(kept):
                yield from group.select([*task, "member", "node"]).take(pa.array(kept)).combine_chunks().to_batches()

    kept = common.written(dealt.repartition(*task).sortWithinPartitions(*task).mapInArrow(look_up, f"{label}, d int, at int, mb int, qb int, member boolean, node string"), "candidates")
    full = kept.join(indexed.select("node", "embedding", "n"), "node").select(*task, "member", "node", "embedding", "n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact cosines of each block's candidates: counts of queries, and a forest of the links."""
        for _, group in grouped(batches, task):
            member, names, n = group.column("member").to_numpy(), np.array(group.column("node").to_pylist()), group.column("n").to_numpy()
            x = unit(_matrix(group.column("embedding").combine_chunks()))
            m, q = np.flatnonzero(member), np.flatnonzero(~member)
            i, j = np.nonzero(x[q] @ x[m].T >= least - 1e-9)
            i, j = q[i], m[j]
            i, j = i[names[i] != names[j]], j[names[i] != names[j]]
            cosine = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
            i, j = i[cosine >= least], j[cosine >= least]
            if not len(i):
                continue
            sums, forest = np.bincount(i, n[j], len(names)), Forest()
            some = np.unique(i)
            edges = [(a, b) for a, b in zip(names[i].tolist(), names[j].tolist()) if forest.join(a, b)]
            a, b, links = [*names[some].tolist(), *(e[0] for e in edges)], [*[None] * len(some), *(e[1] for e in edges)], [*sums[some].astype(int).tolist(), *[0] * len(edges)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.string()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    found = common.written(full.repartition(*task).sortWithinPartitions(*task).mapInArrow(compare, "a string, b string, links long"), "found")
    return found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links")), found.where("b is not null").select("a", "b")


def dedup(vectors: DataFrame, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of vectors (vec_id, embedding, label)."""
    common.small_batches(vectors.sparkSession)
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    node = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("array<string>")))
    rows = vectors.select("vec_id", "label", "embedding", F.when(good, node).alias("node"))
    one = rows.where("node is not null").groupBy("node").agg(F.any_value("label").alias("label"), F.min("vec_id").alias("first"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    one = common.written(one, "distinct")
    counts, edges = linked(one, least, sample)
    comp = common.components(edges)
    info = one.select("node", "first", "n").join(counts, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    info = common.written(info, "info")
    ids = common.written(info.groupBy("component").agg(F.min("first").alias("component_id")), "ids")
    info = info.join(common.if_small(ids), "component").select(F.col("node").alias("_node"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.drop("embedding", "label").join(common.if_small(common.written(info, "found")), F.col("node") == F.col("_node"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", common.same(F.col("vec_id"), F.col("component_id")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS double)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE list_count(e) = len(e) AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {LEAST}),
r(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.seen FROM r JOIN l ON r.node = l.a WHERE r.seen < l.b),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = node LEFT JOIN n ON a = vec_id
"""
