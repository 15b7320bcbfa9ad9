"""Tables written on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tasks_of(spark: SparkSession) -> int:
    """Tasks for few bytes with much work each, which would else share one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the default file system where it has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster that is an error, since executors
    would not see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.matchloom.shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.matchloom.shared", base)
    return f"{qualified(spark, base).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows read back from Parquet in the shared folder: lineage ends there, lost executors cost nothing."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing is going to read any more; other tables are left alone."""
    for df in tables:
        if at := getattr(df, "_written_at", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
