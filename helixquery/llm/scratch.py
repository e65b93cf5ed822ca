"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of this machine is set for a local session only:
    executors of a cluster would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, into: list[str] | None = None) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again. into: gets the path, for `deleted`.

    Cuts lineage: a lost executor costs a re-read of files, and columns that depend on the
    partitioning (row ids) never change afterwards. The tables have no success marker: nothing reads it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    if into is not None:
        into.append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, *paths: str) -> None:
    """Removes tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and broadcasts of plans that are over: it does so when the driver's collector finds
    that nothing refers to them, which on a driver with a free heap may be long after."""
    gc.collect()  # Python's handles of plans first
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> Iterator[None]:
    """Jobs that run inside send Python functions batches of at most so many rows and bytes; for functions whose
    results are larger than their inputs."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
