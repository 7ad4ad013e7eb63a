"""Tables in the folder that all executors share, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir).  Where that is unset it lies below the
    warehouse folder on a single machine, as in tests; elsewhere RuntimeError, since executors may not share that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_thicket_shared"
    _made.append(f"{base.rstrip('/')}/thicket-{uuid.uuid4().hex}")
    return _made[-1]


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI of its file system; it is made where it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().toString()


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """The rows of df, written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, name: str = "t") -> DataFrame:
    """df, stored if it would be computed anew wherever it is read: if its plan joins, groups, sorts or explodes."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return stored(df, name) if any(x in plan for x in ("Join", "Aggregate", "Window", "Sort", "Generate", "Map", "Distinct")) else df


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more, and has Spark delete what exchanges left that no result needs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def clear_stored(spark: SparkSession) -> None:
    """Deletes every folder that this process has made; call it when no result that reads them is needed any more."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
