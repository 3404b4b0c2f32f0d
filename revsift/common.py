"""Session helpers: tables, the shared folder, and joins whose broadcast side is checked."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The most rows, and bytes by Spark's estimate, of a side that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where it is set, else a local one (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(shared_dir, "own", None)
        if at is None:
            shared_dir.own = at = tempfile.mkdtemp(prefix="revsift-")
            atexit.register(shutil.rmtree, at, True)
    return at.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and losing an executor costs nothing.

    The files carry their size, so that later joins can choose by it.
    """
    path = f"{shared_dir(df.sparkSession)}/revsift-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.revsift_path = path
    return out


def forget(*dfs: DataFrame) -> None:
    """Removes the files of tables that were cut and that no later plan reads, such as the last round's state of a loop."""
    for df in dfs:
        path = getattr(df, "revsift_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's own file system names it, scheme and all, for readers outside of Spark."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def dataset(uri: str):
    """The Parquet files below a qualified path, for tasks that look rows up by their key."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    at = urlparse(uri)
    system, path = (fs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else fs.FileSystem.from_uri(uri)
    return ds.dataset(path, filesystem=system, format="parquet")


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it is estimated at so many bytes and has so many rows at most, else unchanged (a shuffle
    join, split by AQE where skewed).

    df should be cheap to count: a table that was cut, or a scan. The count stops just beyond the bound.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most_bytes and df.limit(most + 1).count() <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list, made: dict[str, tuple[str, str]], before: bool = False) -> DataFrame:
    """df with running aggregates over all its rows in an order: made maps a new column to (sum or max, column). With
    `before`, a row itself is left out, and the first has null.

    No row is moved but by one range sort: each partition aggregates its own rows, and the partitions' totals, a row for each,
    are added up. So no task holds more than its range.
    """
    n = partitions(df.sparkSession)
    x = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    x = cut(x, "sorted")
    fold = {"sum": F.sum, "max": F.max}
    total = x.groupBy("_part").agg(*[fold[f](c).alias(f"_t{k}") for k, (f, c) in made.items()])
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over the partitions
    total = total.select("_part", *[fold[f](f"_t{k}").over(w).alias(f"_b{k}") for k, (f, _) in made.items()])
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    x = x.join(F.broadcast(total), "_part")  # a row for each partition
    join = {"sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": F.greatest}
    return x.withColumns({k: join[f](fold[f](c).over(w), F.col(f"_b{k}")) for k, (f, c) in made.items()}).drop("_part", *[f"_b{k}" for k in made])
