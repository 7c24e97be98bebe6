"""Written tables in the shared folder: computed once, readable after the loss of any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder; on a cluster it is an error, as executors
    would write to disks that others cannot read.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="quernstone-")
    return _OWN[app]


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with its own schema."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quernstone/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def sided(small: DataFrame, limit: int) -> DataFrame:
    """``small``, a written table, hinted for a join: broadcast if its counted rows fit ``limit``, else merged by sorting."""
    return small.hint("broadcast" if small.count() <= limit else "merge")


def discard(table: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more; what was derived from it is lost with it."""
    _delete(table.sparkSession, table.scratch_path)


def clear(spark: SparkSession) -> None:
    """Delete every table of ``written`` in the shared folder: for the end of an application."""
    _delete(spark, f"{scratch_root(spark)}/quernstone")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
