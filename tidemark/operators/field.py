"""Velocity fields (kind, t, lat, lon, u, v) on regular grids: conversion, summaries, thinning and interpolation."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def from_direction(speed: Column, direction: Column, towards: bool, unit: float = 1.0) -> tuple[Column, Column]:
    """(u, v) of a speed and a direction in degrees; winds are named by where they come from."""
    s = speed * unit * (1 if towards else -1)
    return s * F.sin(F.radians(direction)), s * F.cos(F.radians(direction))


def indexed(field: DataFrame) -> DataFrame:
    """field with ti, yi, xi: places of its coordinates in ascending order. The axes are short distinct lists, ranked apart and joined back."""
    out = field
    for name, c in (("ti", "t"), ("yi", "lat"), ("xi", "lon")):
        axis = field.select("kind", c).distinct().withColumn(name, F.row_number().over(W.partitionBy("kind").orderBy(c)) - 1)
        out = out.join(axis, ["kind", c])
    return out


def thinned(field: DataFrame, every: int = 2) -> DataFrame:
    return indexed(field).where((F.col("yi") % every == 0) & (F.col("xi") % every == 0) & F.col("u").isNotNull() & F.col("v").isNotNull()).drop("ti", "yi", "xi")


def scaled(field: DataFrame, factor: float) -> DataFrame:
    return field.withColumn("u", F.col("u") * factor).withColumn("v", F.col("v") * factor)


def summary(field: DataFrame) -> DataFrame:
    """By kind: time steps, mean speed over non-missing cells, median spacing of latitudes."""
    base = field.groupBy("kind").agg(F.count_distinct("t").alias("steps"), F.avg(F.hypot("u", "v")).alias("mean_speed"))
    lats = field.select("kind", "lat").distinct().withColumn("gap", F.col("lat") - F.lag("lat").over(W.partitionBy("kind").orderBy("lat")))
    return base.join(lats.groupBy("kind").agg(F.median("gap").alias("spacing")), "kind")


def completed(field: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """(ti, yi, xi, values) of every cell of one kind's grid; a missing one takes the nearest cell's of its time, 0 where its time has none."""
    from .raster import nearest_filled
    from .scratch import settle

    f = settle(indexed(field).select("ti", "yi", "xi", *values), "field")
    n = f.agg(*((F.max(i) + 1).alias(i) for i in ("ti", "yi", "xi")), F.count("*").alias("rows"), *(F.count(v).alias(v) for v in values)).first()
    if not n.rows or all(n[v] == n.ti * n.yi * n.xi for v in values):
        return f
    every = field.sparkSession.range(n.ti * n.yi * n.xi).select(F.expr(f"cast(id div {n.yi * n.xi} as int)").alias("ti"), F.expr(f"cast(id div {n.xi} % {n.yi} as int)").alias("yi"), F.expr(f"cast(id % {n.xi} as int)").alias("xi"))
    full = settle(every.join(f, ["ti", "yi", "xi"], "left").withColumnRenamed("ti", "scene"), "field")
    filled = nearest_filled(full, list(values), "yi", "xi")
    return filled.select(F.col("scene").alias("ti"), "yi", "xi", *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))


def trilinear(points: DataFrame, field: DataFrame, kind: str, values: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """points (t, lat, lon in the field's units, any other columns) with the field's values, linear in time and space and clamped to its box. Equal points
    are points of their own; missing cells are those of `completed`.

    Index arithmetic finds a point's cell of the regular grid. The field is packed to a row per cell with its eight corners, so one equi-join
    fetches them: the field may be of any size. `Grid` is the broadcast form for fields whose size is checked."""
    own = field.where(F.col("kind") == kind)
    box = own.agg(*(g(c).alias(f"_{n}{c}") for c in ("t", "lat", "lon") for n, g in (("lo", F.min), ("hi", F.max))), *(F.count_distinct(c).alias(f"_n{c}") for c in ("t", "lat", "lon")))
    p = points.crossJoin(F.broadcast(box))  # box: one row
    axes = (("t", "ti"), ("lat", "yi"), ("lon", "xi"))
    for c, i in axes:
        x = F.least(F.greatest(F.col(c).cast("double"), F.col(f"_lo{c}")), F.col(f"_hi{c}"))
        at = F.when(F.col(f"_n{c}") > 1, (x - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * (F.col(f"_n{c}") - 1)).otherwise(0.0)
        p = p.withColumn(f"_at{i}", at).withColumn(f"_{i}", F.greatest(F.least(F.floor(f"_at{i}"), F.col(f"_n{c}") - 2), F.lit(0)).cast("int")).withColumn(f"_w{i}", F.col(f"_at{i}") - F.col(f"_{i}"))
    corners = list(np.ndindex(2, 2, 2))
    offsets = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(x).alias(i) for x, (_, i) in zip(c, axes))) for k, c in enumerate(corners))))
    each = completed(own, values).withColumn("_c", offsets).select("_c.k", *((F.col(i) - F.col(f"_c.{i}")).alias(f"_{i}") for _, i in axes), *values).where("_ti >= 0 and _yi >= 0 and _xi >= 0")
    packed = each.groupBy(*(f"_{i}" for _, i in axes)).agg(*(F.max(F.when(F.col("k") == k, F.col(v))).alias(f"_{v}{k}") for v in values for k in range(8)))
    weight = lambda c: reduce(lambda a, b: a * b, (F.col(f"_w{i}") if d else 1 - F.col(f"_w{i}") for d, (_, i) in zip(c, axes)))
    # beyond the last cell of an axis a corner's weight is 0
    total = lambda v: sum((F.when(weight(c) != 0, weight(c) * F.col(f"_{v}{k}")).otherwise(0.0) for k, c in enumerate(corners)), F.lit(0.0))
    return p.join(packed, [f"_{i}" for _, i in axes], "left").select(*points.columns, *(total(v).alias(v) for v in values))


class Grid:
    """A field in memory for the particle kernel: axes ascending, missing cells filled from the nearest one, trilinear and clamped."""

    #: Cells that may be collected and broadcast; larger fields are cut to the seeds' time and box first, or interpolated by `trilinear`.
    MOST = 20_000_000

    def __init__(self, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, u: np.ndarray, v: np.ndarray):
        self.axes = t, lat, lon
        self.u, self.v = (np.stack([_filled(x) for x in a]) for a in (u, v))

    @classmethod
    def of(cls, field: DataFrame, kind: str, most: int | None = None) -> Grid:
        rows = field.where(F.col("kind") == kind).select(F.col("t").cast("double").alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
        n, most = rows.count(), most or cls.MOST
        if n > most:
            raise ValueError(f"the field has {n} cells, more than the {most} that may be broadcast")
        x = rows.toPandas()
        axes = [np.sort(x[c].unique()) for c in ("t", "lat", "lon")]
        at = tuple(np.searchsorted(a, x[c]) for a, c in zip(axes, ("t", "lat", "lon")))
        u, v = (np.full([len(a) for a in axes], np.nan) for _ in range(2))
        u[at], v[at] = x["u"], x["v"]
        return cls(*axes, u, v)

    def at(self, t, lat, lon) -> tuple[np.ndarray, np.ndarray]:
        n = [len(a) for a in self.axes]
        index, weights = 0, []
        for axis, x in zip(self.axes, (t, lat, lon)):
            x, k = np.minimum(np.maximum(x, axis[0]), axis[-1]), 0
            if len(axis) > 2:
                k = np.minimum(np.searchsorted(axis, x, "right") - 1, len(axis) - 2)
            weights.append((x - axis[k]) / (axis[k + 1] - axis[k]) if len(axis) > 1 else None)
            index = index * len(axis) + k
        corners = [(i * n[1] + j) * n[2] + k for i, j, k in np.ndindex(*(min(2, m) for m in n))]
        out = []
        for field in (self.u.ravel(), self.v.ravel()):
            x = [field[index + c] for c in corners]
            for w in weights[::-1]:  # one axis after the other, the last first: neighbours along it are beside each other
                if w is not None:
                    x = [a + (b - a) * w for a, b in zip(x[::2], x[1::2])]
            out.append(np.broadcast_to(x[0], np.shape(t)))
        return tuple(out)


def _filled(x: np.ndarray) -> np.ndarray:
    """Missing cells of a slice from the nearest cell that is not; a slice without any is 0. Each column's nearest row first, then for each row
    the column whose two steps together are least."""
    bad = ~np.isfinite(x)
    if bad.all():
        return np.zeros_like(x)
    if not bad.any():
        return x
    row, col = np.arange(len(x))[:, None], np.arange(x.shape[1])
    above = np.maximum.accumulate(np.where(bad, -(1 << 30), row))
    below = np.minimum.accumulate(np.where(bad, 1 << 30, row)[::-1])[::-1]
    near = np.where(row - above <= below - row, above, below)
    away = (near - row).astype(float) ** 2
    out = x.copy()
    for i in np.flatnonzero(bad.any(1)):
        holes = np.flatnonzero(bad[i])
        best = ((holes[:, None] - col) ** 2 + away[i]).argmin(1)
        out[i, holes] = x[near[i, best], best]
    return out
