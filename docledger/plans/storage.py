"""Lineage cuts on shared storage.

Iterative operators write their intermediate tables as Parquet below the folder
named by ``spark.checkpoint.dir``; a lost executor then costs a re-read, not a
recomputation of the whole lineage. Nothing is kept on executor-local disks.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set: the warehouse folder, if every process can see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (":" not in place or place.startswith("file:")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return place + "/docledger-stage"


#: Tables this process wrote and has not deleted yet.
_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to shared storage and return a frame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docledger/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _written[path] = spark
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by ``materialize`` once no pending plan reads it."""
    path = getattr(df, "stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def sweep() -> int:
    """Delete every table that ``materialize`` wrote in this process; for jobs whose results are stored or collected."""
    done = list(_written.items())
    for path, spark in done:
        _delete(spark, path)
    return len(done)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    _written.pop(path, None)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases, which it does when plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
