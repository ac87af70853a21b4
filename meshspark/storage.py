"""Durable intermediates in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder.  Where the setting is absent a local session gets a temporary one, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="meshspark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "state") -> DataFrame:
    """Write ``df`` and return a DataFrame that reads it: one computation, no lineage, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/meshspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``cut`` wrote (others are left alone); nothing may read them any more."""
    for df in tables:
        if (path := getattr(df, "written_to", None)) is not None:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            df.written_to = None


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write ``df`` in one sorted file a bucket of ``key``; joins on the key with as many partitions don't shuffle it."""
    spark, tag = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    table = "meshspark_" + tag.replace("-", "_")
    path = f"{shared_dir(spark)}/meshspark/{tag}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table, format="parquet")
    out = spark.table(table)
    out.written_to, out.table = path, table
    return out
