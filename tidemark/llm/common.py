"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a table that a join may broadcast; counted before the join is planned.
BROADCAST_ROWS = 200_000
#: Most hashes of keys (longs) that `parted` broadcasts.
BROADCAST_HASHES = 2_000_000
#: Edges that one task of `forest` holds.
FOREST = 200_000
#: Pointers that `components` follows before it looks whether it is at their ends.
HOPS = 2

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only a local session, whose executors share the driver's disk,
    gets a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the session's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(discard)
    _made.append((spark, path))
    return path


def discard(path: str | None = None) -> None:
    """Remove one scratch path, or all of them."""
    for spark, p in [x for x in _made if path in (None, x[1])]:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have stopped: nothing is left to remove with
            pass
        _made.remove((spark, p))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that lost executors cost no more than one stage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 4096, size: str = "16m") -> None:
    """Bound what a Python worker holds at once, by bytes as well as rows: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tidy() -> None:
    """Hand back what a task has freed: a Python worker lives on after its task, and the next one's executor has the same memory to do with."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows, else as it is: then the join shuffles, and AQE splits hot keys.
    df should be cheap to count (a written table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parted(df: DataFrame, key: Column, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df's rows whose key may be among those of the one column of `of`, and those whose key is surely not, or is null.

    Hashes of the keys are broadcast, so no row of df moves, and an exact join has only the first part to send. Where there are more than
    BROADCAST_HASHES of them, all rows with a key are in the first part."""
    (name,) = free_names(df, "_hash")
    hashes = written(of.select(F.xxhash64(of.columns[0]).alias(name)).distinct(), "hashes")
    if hashes.limit(BROADCAST_HASHES + 1).count() > BROADCAST_HASHES:
        return df.where(key.isNotNull()), df.where(key.isNull())
    keyed = df.withColumn(name, F.when(key.isNotNull(), F.xxhash64(key)))
    return tuple(keyed.join(F.broadcast(hashes), name, how).select(*df.columns) for how in ("left_semi", "left_anti"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, results: Iterable[str]) -> list[str]:
    """df's columns but those that an operator's results replace, in any case."""
    replaced = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in replaced]


def grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys (none null), each as one table; rows come sorted by key."""
    import numpy as np
    import pyarrow.compute as pc

    held, last = [], None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new = np.zeros(n - 1, bool)
        for k in key:
            new |= pc.not_equal(b.column(k).slice(1), b.column(k).slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for i, j in zip(cuts, cuts[1:]):
            now = tuple(b.column(k)[i].as_py() for k in key)
            if held and now != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(i, j - i))
    if held:
        yield last, pa.Table.from_batches(held)


def forest(edges: DataFrame) -> DataFrame:
    """Of edges (a, b), some that join what all of them join: in each of a few parts those that form no circle. Tasks that find links on their own find the
    same groups joined again and again; a part has FOREST edges or so, and no more are left of it than it has nodes."""
    edges = written(edges, "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        for batch in batches:
            kept = []
            for k, (a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                x, y = find(a), find(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    kept.append(k)
            if kept:
                yield batch.take(pa.array(kept))

    parts = -(-edges.count() // FOREST)
    return edges.repartition(parts).mapInArrow(run, edges.schema) if parts else edges


def components(edges: DataFrame, known: DataFrame | None = None, limit: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that the edges (a, b) reach; a node that is its own component is not listed.
    known: what this gave for earlier edges; edges are then new ones only, and what is known is carried over.

    In a round each node with a smaller neighbour points to its smallest one, pointers are followed to their ends, and edges are drawn between these
    ends. An end that nobody pointed to has a smaller neighbour in the next round, so two rounds halve what is left: their number is logarithmic.
    Hot nodes: minima are aggregated before the shuffle, which is a round's only one while there are few pointers, as their table is then broadcast;
    beyond that the joins are plain equi-joins whose hot keys AQE splits. Each round is written to the shared folder."""

    def followed(df: DataFrame, column: str, to: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
        to = few(to.toDF("_from", "_to"))
        return df.join(to, df[column] == to["_from"], "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")

    def between(e: DataFrame, to: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return followed(followed(e, "u", to, few), "v", to, few)

    def ordered(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    e, done = written(ordered(e if known is None else between(e, known, if_small)), "edges"), known
    for _ in range(limit):
        if e.isEmpty():
            break
        low = written(e.groupBy("u").agg(F.min("v").alias("v")), "low")
        many = low.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS
        few = (lambda df: df) if many else F.broadcast
        up = low
        for _ in range(HOPS):
            up = followed(up, "v", low, few)
        up = written(up, "up")
        while not up.join(few(low.select(F.col("u").alias("v"))), "v", "left_semi").isEmpty():  # not at their ends yet: twice as far
            up = written(followed(up, "v", up, few), "up")
        new = ordered(between(e, up, few))
        e = written(new.distinct() if many else new, "edges")
        done = up if done is None else followed(done.toDF("u", "v"), "v", up, few).union(up)
    else:
        raise RuntimeError("components did not settle")
    return (e if done is None else written(done, "components")).toDF("node", "component")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
