"""A place that driver and executors share, for what a query writes and reads again."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a folder of our own if all tasks run on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="framelake-")
        found = _own[app]
    return found.rstrip("/")


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It goes when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written in the shared folder and read from there: later steps don't compute it again, and don't depend on executors that made it."""
    spark, path = df.sparkSession, shared(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One small file of JSON, which is there whole or not at all: written beside its place, then moved into it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    write_text(spark, f"{path}.tmp", json.dumps(value))
    to, conf = hadoop.Path(path), spark.sparkContext._jsc.hadoopConfiguration()
    fs = to.getFileSystem(conf)
    if fs.exists(to):
        fs.delete(to, False)
    if not fs.rename(hadoop.Path(f"{path}.tmp"), to):
        raise OSError(f"{path} could not be moved into its place")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def renamed(spark: SparkSession, raw: str, path: str, suffix: str) -> None:
    """Files that Spark wrote under raw, moved to path with another suffix. Only names pass through the driver."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(raw).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in fs.globStatus(hadoop.Path(raw, "part-*")):
        if not fs.rename(part.getPath(), hadoop.Path(path, part.getPath().getName().partition(".")[0] + suffix)):
            raise OSError(f"{part.getPath()} could not be moved")
    fs.delete(hadoop.Path(raw), True)
