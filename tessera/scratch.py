"""Tables that jobs write between steps, in a folder that all machines share.

``materialize`` cuts a plan's lineage by a written table: the rows are computed
once, later steps read them by column, and a lost executor costs no recompute
beyond its own tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder within ``spark.checkpoint.dir``, which goes when the application ends.

    A local run without that setting gets a new temp folder. On a cluster it is an
    error, since executors don't see each other's disks.
    """
    held = getattr(spark, "_tessera_scratch", None)
    if held:
        return held
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that all machines share")
    base = found.rstrip("/") if found else "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
    spark._tessera_scratch = f"{base}/tessera-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(spark._tessera_scratch)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return spark._tessera_scratch


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """``df``, written to the shared folder as Parquet and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete the files of a materialized table that no later step reads."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
