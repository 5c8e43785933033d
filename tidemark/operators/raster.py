"""Kernels on pixel grids (scene, row, col, ...), as windows, equi-joins on neighbours and aggregations: a scene is never one row or one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle


def block_medians(pixels: DataFrame, values: list[str], block: int, valid: str = "valid") -> DataFrame:
    """(scene, br, bc, <value>...): exact medians over the valid pixels of each block; null where a block has none."""
    keys = ("scene", F.floor(F.col("row") / block).cast("int").alias("br"), F.floor(F.col("col") / block).cast("int").alias("bc"))
    return pixels.groupBy(*keys).agg(*(F.median(F.when(F.col(valid), F.col(v))).alias(v) for v in values))


def mad_z(pixels: DataFrame, value: str, background: str, valid: str = "valid", by: str = "scene") -> DataFrame:
    """pixels with z: robust z-scores of value less background over the valid pixels of each scene; the standard deviation stands in where
    the median deviation is 0. Medians are aggregated by scene and joined back, so no window gathers a scene."""
    r = pixels.withColumn("_r", F.when(F.col(valid), F.col(value) - F.col(background)))
    mid = r.groupBy(by).agg(F.median("_r").alias("_mid"), F.stddev_pop("_r").alias("_sd"))
    r = r.join(mid, by)
    mad = r.groupBy(by).agg(F.median(F.abs(F.col("_r") - F.col("_mid"))).alias("_mad"))
    sigma = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise(F.col("_sd"))
    return r.join(mad, by).withColumn("z", F.col("_r") / (sigma + 1e-9)).drop("_r", "_mid", "_sd", "_mad")


def nearest_filled(blocks: DataFrame, values: list[str], row: str = "br", col: str = "bc", reach: int | None = None) -> DataFrame:
    """Cells without a value take that of the nearest cell with one (by squared steps, then row and column), no farther than reach if given; a scene without
    any keeps none.

    Two passes, whatever the distance: windows carry each column's nearest values down and up, then each row that has holes looks for the column
    whose two steps together are least. A task holds a row or a column of a scene, never a scene."""
    import numpy as np
    import pandas as pd

    r = F.col(row)
    down, up = (W.partitionBy("scene", col).orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (r.asc(), r.desc()))
    carried = {v: F.when(F.col(v).isNotNull(), F.struct(r.alias("r"), F.col(v).cast("double").alias("v"))) for v in values}
    near = blocks.select("scene", row, col, *values, *(F.last(c, True).over(w).alias(f"{n}_{v}") for n, w in (("a", down), ("b", up)) for v, c in carried.items()))
    from_up = lambda v: F.col(f"b_{v}").isNull() | (r - F.col(f"a_{v}.r") <= F.col(f"b_{v}.r") - r)
    near = near.select("scene", row, col, *values, *(F.when(from_up(v), F.col(f"a_{v}")).otherwise(F.col(f"b_{v}")).alias(f"n_{v}") for v in values))
    near = near.select("scene", row, col, *values, *(F.col(f"n_{v}.{c}").alias(f"n{c}_{v}") for v in values for c in "rv"))

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(col)
        at, r0 = p[col].to_numpy(np.int64), int(p[row].iloc[0])
        done = {"scene": p["scene"], row: p[row], col: p[col]}
        for value in values:
            has = p[p[f"nr_{value}"].notna()]
            holes = np.flatnonzero(p[value].isna().to_numpy())
            out = p[value].to_numpy(float).copy()
            c, nr, nv = has[col].to_numpy(np.int64), has[f"nr_{value}"].to_numpy(np.int64), has[f"nv_{value}"].to_numpy(float)
            order = np.lexsort((c, nr))  # of equally near cells the first row, then the first column
            c, nr, nv = c[order], nr[order], nv[order]
            for i in range(0, len(holes) if len(c) else 0, 512):
                h = holes[i : i + 512]
                d = (at[h][:, None] - c) ** 2 + (nr - r0) ** 2
                best = d.argmin(1)
                ok = d[np.arange(len(h)), best] <= (np.inf if reach is None else reach * reach)
                out[h[ok]] = nv[best[ok]]
            done[value] = pd.Series(out, p.index).astype(object).where(~np.isnan(out), None)
        return pd.DataFrame(done)

    kind = ", ".join([*(f"`{c}` {t}" for c, t in blocks.select("scene", row, col).dtypes), *(f"`{v}` double" for v in values)])
    return near.groupBy("scene", row).applyInPandas(one, kind)


def upsampled(pixels: DataFrame, blocks: DataFrame, values: dict[str, str], block: int, size: DataFrame) -> DataFrame:
    """pixels with values (name in blocks: name here) read from the block grid by corner-aligned bilinear interpolation; size: (scene, rows, cols) of the padded
    pixel grid. The four corners of a cell with all their values are packed to one row, so pixels are joined once, whatever the number of values."""
    shape = size.select("scene", (F.col("rows") / block).cast("int").alias("_nr"), (F.col("cols") / block).cast("int").alias("_nc"), F.col("rows").alias("_rows"), F.col("cols").alias("_cols"))
    # a block is the near corner of its own cell and the far one of the cell before; on an axis of one block it is both of one cell
    ends = lambda b, n: F.array(*(F.struct(F.lit(i).alias("i"), F.when(F.col(n) > 1, F.col(b) - i).otherwise(F.col(b)).alias("at")) for i in (0, 1)))
    sides = blocks.select("scene", "br", "bc", F.struct(*values).alias("_v")).join(shape, "scene").withColumn("_a", F.explode(ends("br", "_nr"))).withColumn("_b", F.explode(ends("bc", "_nc")))
    corner = {(i, j): F.first(F.when((F.col("_a.i") == i) & (F.col("_b.i") == j), F.col("_v")), True).alias(f"_v{i}{j}") for i in (0, 1) for j in (0, 1)}
    packed = sides.groupBy("scene", F.col("_a.at").alias("_y0"), F.col("_b.at").alias("_x0")).agg(*corner.values())
    p = pixels.join(shape, "scene")
    at = lambda i, n, full: F.when(F.col(n) > 1, F.col(i) * (F.col(n) - 1) / (F.col(full) - 1)).otherwise(0.0)
    p = p.withColumn("_y", at("row", "_nr", "_rows")).withColumn("_x", at("col", "_nc", "_cols"))
    p = p.withColumn("_y0", F.least(F.floor("_y").cast("int"), F.greatest(F.col("_nr") - 2, F.lit(0)))).withColumn("_x0", F.least(F.floor("_x").cast("int"), F.greatest(F.col("_nc") - 2, F.lit(0))))
    p = p.join(packed, ["scene", "_y0", "_x0"], "left")
    fy, fx = F.col("_y") - F.col("_y0"), F.col("_x") - F.col("_x0")

    def read(v: str) -> Column:
        top, low = (F.col(f"_v{i}0.{v}") * (1 - fx) + F.col(f"_v{i}1.{v}") * fx for i in (0, 1))
        return top * (1 - fy) + low * fy

    return p.select(*(c for c in pixels.columns if c not in values.values()), *(read(v).alias(here) for v, here in values.items()))


def reflected(pixels: DataFrame, axis: str, n: str, reach: int) -> DataFrame:
    """A dense grid with its edge rows (columns) mirrored, the edge itself included; column n holds the grid's size."""
    a = F.col(axis)
    before = pixels.where(a < reach).withColumn(axis, -a - 1)
    after = pixels.where(a >= F.col(n) - reach).withColumn(axis, 2 * F.col(n) - 1 - a)
    return pixels.union(before.select(pixels.columns)).union(after.select(pixels.columns))


def focal(pixels: DataFrame, value: str, width: int, stats: tuple[str, ...] = ("mean", "std")) -> DataFrame:
    """pixels (dense: scene, row, col, rows, cols) with <value>_m<width> and <value>_s<width>: mean and deviation of the square around each,
    edges mirrored, missing as 0. Two one-dimensional windows, each over one row or column of a scene."""
    r = width // 2
    base = pixels.select("scene", "row", "col", "rows", "cols", F.coalesce(F.nanvl(F.col(value), F.lit(None)), F.lit(0.0)).alias("x")).withColumn("xx", F.col("x") * F.col("x"))
    frame = lambda part, order: W.partitionBy("scene", part).orderBy(order).rowsBetween(-r, r)
    h = reflected(base, "col", "cols", r)
    h = h.withColumn("x", F.avg("x").over(frame("row", "col"))).withColumn("xx", F.avg("xx").over(frame("row", "col"))).where("col >= 0 and col < cols")
    v = reflected(h, "row", "rows", r)
    v = v.withColumn("x", F.avg("x").over(frame("col", "row"))).withColumn("xx", F.avg("xx").over(frame("col", "row"))).where("row >= 0 and row < rows")
    out = [F.col("x").alias(f"{value}_m{width}")] if "mean" in stats else []
    out += [F.sqrt(F.greatest(F.col("xx") - F.col("x") * F.col("x"), F.lit(0.0))).alias(f"{value}_s{width}")] if "std" in stats else []
    return pixels.join(v.select("scene", "row", "col", *out), ["scene", "row", "col"])


def sobel(pixels: DataFrame, value: str) -> DataFrame:
    """pixels with <value>_grad: the magnitude of the Sobel gradients, edges mirrored, missing as 0."""
    base = pixels.select("scene", "row", "col", "rows", "cols", F.coalesce(F.nanvl(F.col(value), F.lit(None)), F.lit(0.0)).alias("x"))
    near = lambda w, c: (F.lag(c).over(w), F.col(c), F.lead(c).over(w))
    w = W.partitionBy("scene", "row").orderBy("col")
    a, b, c = near(w, "x")
    h = reflected(base, "col", "cols", 1).withColumn("d", c - a).withColumn("s", a + 2 * b + c).where("col >= 0 and col < cols")
    w = W.partitionBy("scene", "col").orderBy("row")
    da, db, dc = near(w, "d")
    sa, _, sc = near(w, "s")
    v = reflected(h, "row", "rows", 1).withColumn("gx", da + 2 * db + dc).withColumn("gy", sc - sa).where("row >= 0 and row < rows")
    return pixels.join(v.select("scene", "row", "col", F.hypot("gx", "gy").alias(f"{value}_grad")), ["scene", "row", "col"])


def textures(pixels: DataFrame, widths: dict[str, tuple[int, ...]], grads: tuple[str, ...] = ()) -> DataFrame:
    """pixels (dense: scene, row, col, rows, cols) with <value>_m<width> and <value>_s<width> of every value's widths and <value>_grad of some: what `focal`
    and `sobel` give, for all at once. Rows go through one window by row of a scene and one by column, with all their columns; no join."""
    values = sorted({*widths, *grads})
    reach = max([1, *(w // 2 for ws in widths.values() for w in ws)])
    own = [(v, w) for v, ws in widths.items() for w in ws]
    across, down = W.partitionBy("scene", "row").orderBy("col"), W.partitionBy("scene", "col").orderBy("row")
    mean = lambda c, part, w: F.avg(c).over(part.rowsBetween(-(w // 2), w // 2))
    base = pixels.withColumns({f"_{v}": F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(None)), F.lit(0.0)) for v in values}).withColumns({f"_{v}2": F.col(f"_{v}") * F.col(f"_{v}") for v in values})
    h = reflected(base, "col", "cols", reach)
    made = {f"_{v}_{w}": mean(f"_{v}", across, w) for v, w in own} | {f"_{v}2_{w}": mean(f"_{v}2", across, w) for v, w in own}
    made |= {f"_{v}_d": F.lead(f"_{v}").over(across) - F.lag(f"_{v}").over(across) for v in grads} | {f"_{v}_t": F.lag(f"_{v}").over(across) + 2 * F.col(f"_{v}") + F.lead(f"_{v}").over(across) for v in grads}
    h = h.withColumns(made).where("col >= 0 and col < cols").drop(*(f"_{v}{k}" for v in values for k in ("", "2")))
    v_ = reflected(h, "row", "rows", reach)
    made = {f"{v}_m{w}": mean(f"_{v}_{w}", down, w) for v, w in own} | {f"_{v}_q{w}": mean(f"_{v}2_{w}", down, w) for v, w in own}
    made |= {f"_{v}_x": F.lag(f"_{v}_d").over(down) + 2 * F.col(f"_{v}_d") + F.lead(f"_{v}_d").over(down) for v in grads} | {f"_{v}_y": F.lead(f"_{v}_t").over(down) - F.lag(f"_{v}_t").over(down) for v in grads}
    out = v_.withColumns(made).where("row >= 0 and row < rows")
    spread = {f"{v}_s{w}": F.sqrt(F.greatest(F.col(f"_{v}_q{w}") - F.col(f"{v}_m{w}") * F.col(f"{v}_m{w}"), F.lit(0.0))) for v, w in own}
    out = out.withColumns(spread | {f"{v}_grad": F.hypot(f"_{v}_x", f"_{v}_y") for v in grads})
    return out.select(*pixels.columns, *(f"{v}_{k}{w}" for v, w in own for k in "ms"), *(f"{v}_grad" for v in grads))


def dilated(cells: DataFrame, n: int = 1) -> DataFrame:
    """(scene, row, col) within n steps (up, down, left, right) of any of the cells; not cut at the grid's edge."""
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-n, n + 1) for b in range(-n, n + 1) if abs(a) + abs(b) <= n))
    grown = cells.select("scene", "row", "col", F.explode(offsets).alias("o"))
    return grown.select("scene", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col")).distinct()


def min_label(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, label): the smallest node that the edges (a, b) reach. Labels spread to neighbours and then jump to their label's label, so
    rounds grow with the logarithm of a component's width; each round's table is written."""
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(limit):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = settle(spread.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        moved = not new.where("label <> old").isEmpty()
        labels = new.drop("old")
        if not moved:
            return labels
    raise RuntimeError("labels did not settle")


def components(cells: DataFrame, valid: DataFrame | None = None, width: int = 1 << 20) -> DataFrame:
    """Connected components, eight neighbours, of the cells and of the valid cells one step around them: (scene, row, col, candidate, component).
    A component's id is its smallest scene, row and column, as a number within the scene."""
    grown = cells.select("scene", "row", "col", F.lit(True).alias("candidate"))
    if valid is not None:
        ring = dilated(cells, 1).join(valid.select("scene", "row", "col"), ["scene", "row", "col"], "left_semi").join(grown.drop("candidate"), ["scene", "row", "col"], "left_anti")
        grown = grown.union(ring.withColumn("candidate", F.lit(False)))
    grown = settle(grown.withColumn("pixel", F.struct("scene", (F.col("row").cast("long") * width + F.col("col")).alias("at"))), "cells")
    ahead = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    probe = grown.select("pixel", "scene", "row", "col", F.explode(ahead).alias("o")).select(F.col("pixel").alias("a"), "scene", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"))
    edges = probe.join(grown.select("scene", "row", "col", F.col("pixel").alias("b")), ["scene", "row", "col"]).select("a", "b")
    labels = min_label(edges).withColumnRenamed("node", "pixel")
    return grown.join(labels, "pixel", "left").withColumn("component", F.coalesce("label", "pixel")["at"]).select("scene", "row", "col", "candidate", "component")


def gridded(points: DataFrame, value: str, lat0: float, lon0: float, step: float) -> DataFrame:
    """Mean of a value in each cell of a regular grid."""
    iy, ix = F.floor((F.col("lat") - lat0) / step).cast("int"), F.floor((F.col("lon") - lon0) / step).cast("int")
    return points.where(F.col(value).isNotNull()).groupBy("scene", iy.alias("iy"), ix.alias("ix")).agg(F.avg(value).alias(value), F.count("*").alias("n"))


def nearest_pixel(pixels: DataFrame, lat: float, lon: float, half: int) -> DataFrame:
    """The square of pixels around the one nearest to a point (by squared degrees, longitude scaled), per scene."""
    import math

    d2 = F.pow(F.col("lat") - lat, 2) + F.pow((F.col("lon") - lon) * math.cos(math.radians(lat)), 2)
    best = pixels.groupBy("scene").agg(F.min(F.struct(d2.alias("d"), "row", "col")).alias("m")).select("scene", F.col("m.row").alias("r0"), F.col("m.col").alias("c0"))
    return pixels.join(best, "scene").where((F.abs(F.col("row") - F.col("r0")) <= half) & (F.abs(F.col("col") - F.col("c0")) <= half)).drop("r0", "c0")


def flags(mask: Column, names: dict[str, int]) -> dict[str, Column]:
    """Booleans of named bits."""
    return {k: mask.bitwiseAND(F.lit(v)) != 0 for k, v in names.items()}
