"""Tables written between rounds of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that a join may broadcast.
BROADCAST_ROWS = 200_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only a local session, whose executors share the driver's disk,
    gets a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='settle-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str = "round") -> DataFrame:
    """Write df to the shared folder and read it back: lineage stays short and a lost executor costs one stage. The table goes when the session's
    process ends, as frames that were handed out may read it until then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(discard)
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (a settled table, cheap to count) marked for broadcast if it has no more than so many rows; else the join shuffles, and AQE splits hot keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else dealt(df)


def dealt(df: DataFrame) -> DataFrame:
    """df marked for a join that shuffles. Spark goes by the bytes of files, which are compressed: what it takes for small may fill the driver."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to as many tasks as the session has partitions to a shuffle: for rows of few files whose work is far larger than their bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def discard() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have stopped: nothing is left to remove with
            return
