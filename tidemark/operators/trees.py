"""Tree ensembles grown level by level over distributed rows: extra trees, and gradient boosting of many classes on histograms.

Features are binned once. A level is a pass over the rows or two: each task follows its own rows down the trees as they are, sums what the level's open nodes
need, and Spark adds up the sums by node; the driver sees a row per open node. Trees of an ensemble (and of a boosting round, a tree per class) grow side by side.

Random choices are hashes of (seed, node, feature), and sums are exact (fixed point), so a fit depends neither on partitions nor on their order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle

#: Bins of a feature; rows that a task holds (binned, a byte a feature); nodes of an ensemble, which the driver holds.
BINS, TASK_ROWS, MOST_NODES = 255, 100_000, 4_000_000
#: Weights, gradients and curvatures are whole multiples of this, so that their sums are exact in any order.
UNIT = 2.0**-24
#: Rounds of boosting after which the rows' scores are written anew.
SETTLED = 5


class Trees:
    """Nodes of all trees in one list, roots first: feature (-1 for a leaf), threshold (right if above), first child (the second is beside it), a row of values."""

    def __init__(self, roots: int, width: int):
        self.roots = roots
        self.feature = np.full(roots, -1, np.int32)
        self.threshold, self.bin = np.zeros(roots), np.zeros(roots, np.int16)
        self.child = np.zeros(roots, np.int64)
        self.value = np.zeros((roots, width))
        self.gain = np.zeros(roots)

    def split(self, node: np.ndarray, feature: np.ndarray, at: np.ndarray, threshold: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Split nodes; returns the first children, in the nodes' order."""
        n = len(self.feature)
        first = n + 2 * np.arange(len(node))
        self.feature[node], self.bin[node], self.threshold[node], self.child[node], self.gain[node] = feature, at, threshold, first, gain
        more = 2 * len(node)
        if n + more > MOST_NODES:
            raise ValueError(f"more than {MOST_NODES} nodes: grow fewer or lower trees")
        self.feature = np.concatenate([self.feature, np.full(more, -1, np.int32)])
        self.bin = np.concatenate([self.bin, np.zeros(more, np.int16)])
        self.threshold, self.child, self.gain = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.threshold, self.child, self.gain))
        self.value = np.concatenate([self.value, np.zeros((more, self.value.shape[1]))])
        return first

    def leaf(self, root: int, x: np.ndarray, binned: bool = False) -> np.ndarray:
        """The node where each row (of bins, or of features) ends in one tree."""
        at, row = np.full(len(x), root, np.int64), np.arange(len(x))
        limit = self.bin if binned else self.threshold
        while len(row):
            f = self.feature[at[row]]
            row = row[f >= 0]
            here = at[row]
            at[row] = self.child[here] + (x[row, self.feature[here]] > limit[here])
        return at

    def importances(self, features: int) -> np.ndarray:
        total = np.bincount(self.feature[self.feature >= 0], self.gain[self.feature >= 0], features)
        return total / total.sum() if total.sum() else total


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of whole numbers, elementwise."""
    out = np.zeros(np.broadcast(*parts).shape, np.uint64)
    for p in parts:
        out = out + np.asarray(p).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return out


class Binned:
    """Rows as (label index, weight, a byte per feature), written, and the features' edges: a value's bin is how many edges lie below it."""

    def __init__(self, df: DataFrame, features: str, label: str, weight: str | None, bins: int = BINS):
        ranks = F.array(*(F.lit(k / bins) for k in range(1, bins)))
        values = df.select(F.posexplode(F.col(features)).alias("f", "v")).where("v is not null and not isnan(v)")
        found = values.groupBy("f").agg(F.percentile_approx("v", ranks, 10_000).alias("e"), F.max("v").alias("most")).collect()  # a row per feature
        self.edges = [np.zeros(0)] * (max((r.f for r in found), default=-1) + 1)
        for r in found:
            e = np.unique(np.array(r.e, float))
            self.edges[r.f] = e[e < r.most]
        self.features = len(self.edges)
        edges, n = self.edges, self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(0), n)
                cut = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1).astype(np.uint8) if len(x) else np.zeros((0, n), np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([r.tobytes() for r in cut], pa.binary())], names=["y", "w", "x"])

        w = F.round(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) / UNIT) * UNIT if weight else F.lit(1.0)
        rows = settle(df.where(F.col(label).isNotNull()).select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"), w.alias("w")).mapInArrow(run, "y int, w double, x binary"), "binned")
        n = rows.count()
        self.rows = settle(rows.repartition(max(1, -(-n // TASK_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, n // 2000))), "binned")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as a matrix; what is missing, in rows or in values, is 0."""
    out = np.zeros((len(column), width))
    lists = column.to_pylist() if column.null_count else None
    if lists is None and len(column):
        flat = column.flatten()
        sizes = np.diff(column.offsets.to_numpy())
        if not flat.null_count and (sizes == width).all():
            return np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))
        lists = column.to_pylist()
    for i, x in enumerate(lists or ()):
        for k, v in enumerate((x or ())[:width]):
            out[i, k] = 0.0 if v is None or v != v else v
    return out


def over(rows: DataFrame, width: int, each: Callable, schema: str, scores: int = 0) -> DataFrame:
    """What `each` makes of a task's rows: (labels, weights, matrix of bins[, matrix of scores]) to record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, w, x, s = [], [], [], []
        for b in batches:
            y.append(b.column("y").to_numpy())
            w.append(b.column("w").to_numpy())
            x.append(np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(-1, width))
            if scores:
                s.append(matrix(b.column("s"), scores))
        if y:
            yield from each(*(np.concatenate(v) for v in ((y, w, x, s) if scores else (y, w, x))))

    return rows.mapInArrow(run, schema)


def threshold_bins(edges: list[np.ndarray], feature: np.ndarray, lo: np.ndarray, hi: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The bins below thresholds that lie at shares u of the way between the edges above the bins lo and below the bins hi (of values, as extra trees draw them)."""
    out = lo.copy()
    for f in np.unique(feature):
        at = (feature == f) & (hi > lo)
        e = edges[f]
        first, last = e[lo[at]], e[hi[at] - 1]
        out[at] = np.clip(np.searchsorted(e, first + u[at] * (last - first), "right") - 1, lo[at], hi[at] - 1)
    return out


def extra_trees(data: Binned, classes: int, trees: int = 40, depth: int = 12, tried: int | None = None, least: int = 2, seed: int = 42) -> Trees:
    """Extremely randomised trees: at a node `tried` features (the root of their number, rounded up) are drawn, and for each a threshold between the node's least and
    largest value; the split that leaves the least Gini impurity is taken. All rows count in each tree."""
    width, tried = data.features, tried or max(1, math.ceil(data.features**0.5))
    forest = Trees(trees, classes)
    start, total = 0, None
    for level in range(depth + 1):
        n = len(forest.feature) - start
        if not n:
            break
        nodes = np.arange(start, start + n)
        drawn = np.argsort(mixed(seed, nodes[:, None], np.arange(width)[None]), 1, kind="stable")[:, :tried].astype(np.int32)
        state = forest, start

        def ranges(y: np.ndarray, w: np.ndarray, x: np.ndarray, drawn=drawn, state=state) -> Iterator[pa.RecordBatch]:
            forest, start = state
            for t in range(forest.roots):
                at = forest.leaf(t, x, binned=True) - start
                row = np.flatnonzero(at >= 0)
                if not len(row):
                    continue
                found, group = np.unique(at[row], return_inverse=True)
                lo, hi = np.full((len(found), drawn.shape[1]), 255), np.zeros((len(found), drawn.shape[1]), int)
                for k in range(drawn.shape[1]):
                    v = x[row, drawn[at[row], k]].astype(int)
                    np.minimum.at(lo[:, k], group, v)
                    np.maximum.at(hi[:, k], group, v)
                yield pa.RecordBatch.from_arrays([pa.array(found + start), pa.array(lo.tolist(), pa.list_(pa.int32())), pa.array(hi.tolist(), pa.list_(pa.int32()))], names=["node", "lo", "hi"])

        lo, hi = np.zeros((n, tried), int), np.zeros((n, tried), int)
        if level < depth:
            bounds = over(data.rows, width, ranges, "node long, lo array<int>, hi array<int>").groupBy("node")
            for r in bounds.agg(F.array(*(F.min(F.get("lo", F.lit(k))) for k in range(tried))).alias("lo"), F.array(*(F.max(F.get("hi", F.lit(k))) for k in range(tried))).alias("hi")).collect():  # a row per open node
                lo[r.node - start], hi[r.node - start] = r.lo, r.hi
        u = mixed(seed + 1, nodes[:, None], drawn) / 2.0**64
        limit, open_ = threshold_bins(data.edges, drawn, lo, hi, u), hi > lo

        def sums(y: np.ndarray, w: np.ndarray, x: np.ndarray, drawn=drawn, limit=limit, state=state) -> Iterator[pa.RecordBatch]:
            forest, start = state
            for t in range(forest.roots):
                at = forest.leaf(t, x, binned=True) - start
                row = np.flatnonzero(at >= 0)
                if not len(row):
                    continue
                found, group = np.unique(at[row] * np.int64(classes) + y[row], return_inverse=True)
                n = np.bincount(group, w[row])
                left = [np.bincount(group, w[row] * (x[row, drawn[at[row], k]] <= limit[at[row], k])) for k in range(drawn.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(found // classes + start), pa.array((found % classes).astype(np.int32)), pa.array(np.bincount(group)), pa.array(n), pa.array(np.stack(left, 1).tolist(), pa.list_(pa.float64()))], names=["node", "y", "rows", "n", "left"])

        counted = over(data.rows, width, sums, "node long, y int, rows long, n double, left array<double>").groupBy("node", "y")
        counted = counted.agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.array(*(F.sum(F.get("left", F.lit(k))) for k in range(tried))).alias("left"))
        one = counted.groupBy("node").agg(F.sum("rows").alias("rows"), F.collect_list(F.struct("y", "n", "left")).alias("of")).collect()  # a row per open node, of an entry per class
        total, lefts, rows = np.zeros((n, classes)), np.zeros((n, classes, tried)), np.zeros(n, int)
        for r in one:
            rows[r.node - start] = r.rows
            for c in r.of:
                total[r.node - start, c.y], lefts[r.node - start, c.y] = c.n, c.left
        forest.value[nodes] = total / np.maximum(total.sum(1, keepdims=True), 1e-300)
        if level == depth:
            break
        right = total[:, :, None] - lefts
        with np.errstate(divide="ignore", invalid="ignore"):
            pure = (lefts**2).sum(1) / lefts.sum(1) + (right**2).sum(1) / right.sum(1)
            gain = np.where(open_ & (lefts.sum(1) > 0) & (right.sum(1) > 0), pure - ((total**2).sum(1) / total.sum(1))[:, None], -1.0)
        best = gain.argmax(1)
        go = (gain[nodes - start, best] >= 0) & (rows >= least) & ((total > 0).sum(1) > 1)
        at, k = np.flatnonzero(go), best[go]
        start = len(forest.feature)
        forest.split(nodes[at], drawn[at, k], limit[at, k], np.array([data.edges[f][b] for f, b in zip(drawn[at, k], limit[at, k])]), gain[at, k])
    return forest


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def boosted(data: Binned, classes: int, rounds: int = 20, depth: int = 4, rate: float = 0.1, ridge: float = 1.0, least: float = 1e-3, losses: list | None = None) -> tuple[np.ndarray, list[Trees]]:
    """Gradient boosting of all classes at once, on the softmax of their scores: (first scores, a round's trees). One pass a level gathers gradients and curvatures by (node,
    feature, bin) for the trees of all classes. losses gets the mean log-loss before each round and after the last."""
    width = data.features
    share = {r.y: r.w for r in data.rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}  # a row per class
    every = sum(share.values())
    first = np.log(np.array([max(share.get(c, 0.0), 1e-9 * every) for c in range(classes)]) / every) if every else np.zeros(classes)
    rows = settle(data.rows.withColumn("s", F.array(*map(F.lit, first.tolist()))), "scores")
    out: list[Trees] = []
    pending: list[Trees] = []  # rounds that the written scores don't have yet

    def loss() -> float:
        now = moved(rows, pending, width, classes)
        s = lambda x: F.aggregate("s", F.lit(0.0), lambda a, v: a + F.exp(v - x))
        top = F.array_max("s")
        return now.agg(F.sum(F.col("w") * (F.log(s(top)) + top - F.get("s", F.col("y")))) / F.sum("w")).first()[0]

    for _ in range(rounds):
        if losses is not None:
            losses.append(loss())
        trees, start = Trees(classes, 1), 0
        for level in range(depth):
            n = len(trees.feature) - start
            if not n:
                break

            def sums(y: np.ndarray, w: np.ndarray, x: np.ndarray, s: np.ndarray, trees=trees, start=start, pending=tuple(pending)) -> Iterator[pa.RecordBatch]:
                p = softmax(added(s, x, pending))
                for c in range(trees.roots):
                    at = trees.leaf(c, x, binned=True) - start
                    row = np.flatnonzero(at >= 0)
                    if not len(row):
                        continue
                    g = np.round(w[row] * (p[row, c] - (y[row] == c)) / UNIT) * UNIT
                    h = np.round(w[row] * np.maximum(p[row, c] * (1 - p[row, c]), 1e-6) / UNIT) * UNIT
                    n = int(at.max()) + 1
                    gs, hs = np.zeros(n * width * 256), np.zeros(n * width * 256)
                    for i in range(0, len(row), 10_000):
                        part = row[i : i + 10_000]
                        key = ((at[part][:, None] * width + np.arange(width)) * 256 + x[part]).ravel()
                        gs += np.bincount(key, np.repeat(g[i : i + 10_000], width), len(gs))
                        hs += np.bincount(key, np.repeat(h[i : i + 10_000], width), len(hs))
                    found = np.flatnonzero(hs)
                    cols = [found // 256 // width + start, (found // 256 % width).astype(np.int32), (found % 256).astype(np.int32), gs[found], hs[found]]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=["node", "f", "b", "g", "h"])

            binned = over(rows, width, sums, "node long, f int, b int, g double, h double", classes)
            best = splits(binned, ridge, least).collect()  # a row per open node
            leaf = lambda g, h: -rate * g / (h + ridge)
            if level == 0:
                for r in best:
                    trees.value[r.node, 0] = leaf(r.G, r.H)
            go = [r for r in best if r.gain is not None and r.gain > 1e-9]
            start = len(trees.feature)
            if not go:
                break
            node, f, b = (np.array([r[c] for r in go]) for c in ("node", "f", "b"))
            child = trees.split(node, f, b, np.array([data.edges[i][j] for i, j in zip(f, b)]), np.array([r.gain for r in go]))
            for k, r in zip(child, go):
                trees.value[k, 0], trees.value[k + 1, 0] = leaf(r.gl, r.hl), leaf(r.G - r.gl, r.H - r.hl)
        out.append(trees)
        pending.append(trees)
        if len(pending) == SETTLED:
            rows = settle(moved(rows, pending, width, classes), "scores")
            pending = []
    if losses is not None:
        losses.append(loss())
    return first, out


def splits(binned: DataFrame, ridge: float, least: float) -> DataFrame:
    """(node, G, H, gain, f, b): each node's sums and its best split of (node, f, b, g, h), of equal ones that of the first feature and bin; gain is null where none is allowed."""
    upto = Window.partitionBy("node", "f").orderBy("b")
    each = Window.partitionBy("node", "f")
    q = lambda g, h: g * g / (h + ridge)
    # tasks have summed theirs; one shuffle by (node, f) serves the sums and both windows
    x = binned.repartition("node", "f").groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    x = x.select("node", "f", "b", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(each).alias("G"), F.sum("h").over(each).alias("H"))
    x = x.withColumn("gain", F.when((F.col("hl") >= least) & (F.col("H") - F.col("hl") >= least), q(F.col("gl"), F.col("hl")) + q(F.col("G") - F.col("gl"), F.col("H") - F.col("hl")) - q(F.col("G"), F.col("H"))))
    found = F.struct("gain", (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), "gl", "hl")
    best = x.groupBy("node").agg(F.max("G").alias("G"), F.max("H").alias("H"), F.max(F.when(F.col("gain").isNotNull(), found)).alias("s"))
    return best.select("node", "G", "H", "s.gain", (-F.col("s.f")).alias("f"), (-F.col("s.b")).alias("b"), "s.gl", "s.hl")


def added(s: np.ndarray, x: np.ndarray, rounds) -> np.ndarray:
    """Scores of binned rows with some rounds' values added."""
    s = s.copy()
    for trees in rounds:
        for c in range(trees.roots):
            s[:, c] += trees.value[trees.leaf(c, x, binned=True), 0]
    return s


def moved(rows: DataFrame, rounds: list[Trees], width: int, classes: int) -> DataFrame:
    """Rows with some rounds' values added to their scores."""
    rounds = tuple(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(-1, width)
            s = added(matrix(b.column("s"), classes), x, rounds)
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("w"), b.column("x"), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["y", "w", "x", "s"])

    return rows.mapInArrow(run, "y int, w double, x binary, s array<double>")


def _probabilities(column: Column, width: int, of: Callable[[np.ndarray], np.ndarray]) -> Column:
    @F.pandas_udf("array<double>")
    def p(x: pd.Series) -> pd.Series:
        return pd.Series(list(of(matrix(pa.array(x.tolist(), pa.list_(pa.float64())), width))), dtype=object)

    return p(column)


def forest_probabilities(column: Column, forest: Trees, width: int) -> Column:
    """The mean of the trees' class shares at a row's leaves."""
    return _probabilities(column, width, lambda x: sum((forest.value[forest.leaf(t, x)] for t in range(forest.roots)), np.zeros((len(x), forest.value.shape[1]))) / forest.roots)


def boosted_probabilities(column: Column, model: tuple[np.ndarray, list[Trees]], width: int) -> Column:
    """The softmax of the scores."""
    first, rounds = model

    def of(x: np.ndarray) -> np.ndarray:
        s = np.tile(first, (len(x), 1))
        for trees in rounds:
            for c in range(len(first)):
                s[:, c] += trees.value[trees.leaf(c, x), 0]
        return softmax(s) if len(x) else s

    return _probabilities(column, width, of)
