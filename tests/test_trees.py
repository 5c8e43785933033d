"""Tree ensembles against brute force in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify, trees

SCHEMA = "y int, w double, x array<double>"


def table(spark, n=600, seed=1, width=5):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, width)), 2)
    y = (x[:, 0] + x[:, 1] > 0) * 1 + (x[:, 2] > 0.5) * 1
    w = r.integers(1, 4, n).astype(float)
    return x, y, w, spark.createDataFrame([(int(a), float(b), c.tolist()) for a, b, c in zip(y, w, x)], SCHEMA)


def brute_tree(cut, y, w, data, classes, root, depth, tried, least, seed, forest):
    """One extra tree grown alone, node by node, with the ensemble's draws: the class shares of each row's leaf by depth first search."""
    out = np.zeros((len(y), classes))

    def grow(node, rows, level):
        total = np.bincount(y[rows], w[rows], classes)
        out[rows] = total / total.sum()
        if level == depth or len(rows) < least or (total > 0).sum() < 2:
            assert forest.feature[node] < 0
            return
        drawn = np.argsort(trees.mixed(seed, np.array([node])[:, None], np.arange(data.features)[None]), 1, kind="stable")[0, :tried]
        best = None
        for f in drawn:
            v = cut[rows, f]
            lo, hi = int(v.min()), int(v.max())
            if lo == hi:
                continue
            u = trees.mixed(seed + 1, np.array([node]), np.array([f]))[0] / 2.0**64
            limit = data.edges[f][lo] + u * (data.edges[f][hi - 1] - data.edges[f][lo])
            at = min(max(b for b in range(lo, hi) if data.edges[f][b] <= limit), hi - 1)
            a, b = (np.bincount(y[rows][m], w[rows][m], classes) for m in (v <= at, v > at))
            gain = (a**2).sum() / a.sum() + (b**2).sum() / b.sum() - (total**2).sum() / total.sum()
            if best is None or gain > best[0]:
                best = gain, f, at
        if best is None or best[0] < 0:
            assert forest.feature[node] < 0
            return
        assert forest.feature[node] == best[1] and forest.bin[node] == best[2]
        left = cut[rows, best[1]] <= best[2]
        grow(forest.child[node], rows[left], level + 1)
        grow(forest.child[node] + 1, rows[~left], level + 1)

    grow(root, np.arange(len(y)), 0)
    return out


def test_extra_trees_equal_trees_grown_alone(spark):
    x, y, w, df = table(spark)
    data = trees.Binned(df, "x", "y", "w", bins=16)
    cut = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(data.edges)], 1)
    forest = trees.extra_trees(data, 3, trees=4, depth=6, tried=2, seed=9)
    want = [brute_tree(cut, y, w, data, 3, t, 6, 2, 2, 9, forest) for t in range(4)]
    for t in range(4):
        assert np.allclose(forest.value[forest.leaf(t, x)], want[t]) and (forest.leaf(t, x) == forest.leaf(t, cut, binned=True)).all()
    got = df.select(trees.forest_probabilities(F.col("x"), forest, 5).alias("p")).collect()
    assert np.allclose(np.array([r.p for r in got]), sum(want) / 4)
    again = trees.extra_trees(trees.Binned(df.repartition(7), "x", "y", "w", bins=16), 3, trees=4, depth=6, tried=2, seed=9)
    assert (again.feature == forest.feature).all() and (again.bin == forest.bin).all() and (again.value == forest.value).all()


def brute_boost(cut, y, w, classes, rounds, depth, rate, ridge=1.0, least=1e-3, bins=16):
    share = np.bincount(y, w, classes) / w.sum()
    s = np.tile(np.log(share), (len(y), 1))
    losses = []
    loss = lambda: -(w * np.log(trees.softmax(s)[np.arange(len(y)), y])).sum() / w.sum()
    for _ in range(rounds):
        losses.append(loss())
        p = trees.softmax(s)
        add = np.zeros_like(s)
        for c in range(classes):
            g = np.round(w * (p[:, c] - (y == c)) / trees.UNIT) * trees.UNIT
            h = np.round(w * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6) / trees.UNIT) * trees.UNIT

            def grow(rows, level, c=c, g=g, h=h):
                G, H = g[rows].sum(), h[rows].sum()
                add[rows, c] = -rate * G / (H + ridge)
                best = (1e-9, None)
                for f in range(cut.shape[1]) if level < depth else ():
                    for b in range(bins):
                        left = cut[rows, f] <= b
                        gl, hl = g[rows][left].sum(), h[rows][left].sum()
                        if left.any() and hl >= least and H - hl >= least:
                            gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                            if gain > best[0]:
                                best = (gain, (f, b))
                if best[1]:
                    left = cut[rows, best[1][0]] <= best[1][1]
                    grow(rows[left], level + 1)
                    grow(rows[~left], level + 1)

            grow(np.arange(len(y)), 0)
        s = s + add
    return trees.softmax(s), [*losses, loss()]


def test_boosting_equals_numpy_and_its_loss_falls(spark):
    x, y, w, df = table(spark, 300, 2, 4)
    data = trees.Binned(df, "x", "y", "w", bins=16)
    cut = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(data.edges)], 1)
    losses = []
    model = trees.boosted(data, 3, rounds=4, depth=2, rate=0.3, losses=losses)
    p, want = brute_boost(cut, y, w, 3, 4, 2, 0.3)
    got = np.array([r.p for r in df.select(trees.boosted_probabilities(F.col("x"), model, 4).alias("p")).collect()])
    assert np.allclose(losses, want, atol=1e-9) and np.allclose(got, p, atol=1e-9) and all(a > b for a, b in zip(losses, losses[1:]))


def test_awkward_rows(spark):
    """Missing and infinite-free values, empty and null vectors, unlabelled rows, one class, no rows."""
    rows = [(0, 1.0, [1.0, None]), (1, 1.0, [float("nan"), 2.0]), (None, 1.0, [5.0, 5.0]), (1, None, None), (0, 2.0, []), (0, 1.0, [3.0, 4.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    data = trees.Binned(df, "x", "y", "w")
    assert data.rows.count() == 5 and data.features == 2
    forest = trees.extra_trees(data, 2, trees=3, depth=3)
    assert df.select(trees.forest_probabilities(F.col("x"), forest, 2).alias("p")).where("size(p) = 2").count() == 6
    one, booster = classify.fit(df.where("y = 0").select(F.col("y").alias("label"), F.col("x").alias("features")), rounds=2)
    assert one.numClasses == 1 and {tuple(r.p) for r in df.select(booster.p(F.col("x")).alias("p")).collect()} == {(1.0,)}
    none, _ = classify.fit(df.where("false").select(F.col("y").alias("label"), F.col("x").alias("features")), rounds=1)
    assert none.numClasses == 1


@pytest.mark.parametrize("partitions", [1, 6])
def test_both_experts_learn_planes(spark, partitions):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 8))
    y = 2 * (x[:, 0] + x[:, 1] > 0) + (x[:, 2] - x[:, 3] > 0)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "label int, features array<double>").repartition(partitions)
    forest, booster = classify.fit(df.where("crc32(to_json(features)) % 5 <> 0"), trees=20, rounds=8, depth=9)
    held = classify.probabilities(df.where("crc32(to_json(features)) % 5 = 0"), forest, booster)
    for p in ("p_forest", "p_booster"):
        right = held.select(F.avg((classify.argmax_class(F.col(p), [0, 1, 2, 3]) == F.col("label")).cast("int"))).first()[0]
        assert right > 0.8, (p, right)
