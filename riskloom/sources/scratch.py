"""Tables written for the duration of a session, which cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests in local mode) a
    temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return sc.getCheckpointDir().rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stashed table, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again. The files are removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riskloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def clean() -> None:
        try:
            discard(spark, path)
        except Exception:  # the session is already gone; the folder's owner clears what is left
            pass

    atexit.register(clean)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out
