"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_root


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody uses yet; it goes when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """What Spark's planner takes for the size of df: for files, theirs. 0 where it has no idea."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


_inside: ContextVar[str | None] = ContextVar("inside", default=None)


@contextmanager
def folder(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables that are written meanwhile go at the end, but those to keep."""
    path = new_path(spark, name)
    before = _inside.set(path)
    try:
        yield
    finally:
        _inside.reset(before)
        drop_path(spark, path)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: what comes after no longer depends on its lineage."""
    spark, inside = df.sparkSession, _inside.get()
    path = f"{inside}/{name}-{uuid.uuid4().hex}" if inside and not keep else new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict[str, object]]:
    """As materialise, with aggregates of df that are taken while it is written: no query of their own, whose plan the driver would keep."""
    seen = Observation()
    out = materialise(df.observe(seen, *[c.alias(k) for k, c in sums.items()]), name)
    return out, seen.get


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As materialise, with df's number of rows."""
    out, seen = measured(df, name, n=F.count(F.lit(1)))
    return out, seen["n"]


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """rows (a written table; n: how many, if known) with the columns of table (written; one row a key), or nulls. Keys with more rows than a task's fair share are
    no more than there are tasks: they get theirs by broadcast, and their rows don't move, nor do those without a key."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n__"))
    hot = [r[0] for r in counts.where(F.col("n__") > max(1000, (rows.count() if n is None else n) // tasks)).collect()]  # tasks of them at most
    if not hot:
        return rows.join(table, key, "left")
    hot = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(key).schema))
    some = F.broadcast(table.join(hot, key, "left_semi"))  # as few
    held = rows.join(hot, key, "left_semi").join(some, key, "left")
    rest = rows.join(hot, key, "left_anti")
    out = rest.where(F.col(key).isNotNull()).join(table, key, "left")
    none = rest.where(F.col(key).isNull()).select(*rest.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != key])
    return held.unionByName(out).unionByName(none)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, by Hadoop's own file system for that path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    for k in range(0, len(data), 1 << 20):
        out.write(bytearray(data[k : k + (1 << 20)]))
    out.close()
