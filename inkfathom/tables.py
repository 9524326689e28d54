"""Tables in the folder that driver and executors share: they cut lineage and outlive executors.

A session's tables lie in a folder of its own. `discard` takes away one that nothing reads any more, `clean` all of a session,
once its results are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and the session is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="inkfathom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def table(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages don't recompute it, and a lost executor loses nothing."""
    path = f"{_session_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what table() wrote for these; they can't be read any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)


def clean(spark: SparkSession) -> None:
    """Deletes all tables of this session."""
    _delete(spark, _session_dir(spark))
