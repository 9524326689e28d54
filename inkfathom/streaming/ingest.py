"""Structured Streaming at the edge: records that arrive once count once, and sessions close as time passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inkfathom.operators.sessions import GAP_APP, GAP_NONE
from inkfathom.tables import exists


def once(batch: DataFrame, known: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of a batch whose id is neither known nor earlier in the batch."""
    return batch.dropDuplicates([id_col]).join(known.select(id_col), id_col, "left_anti")


def ingest(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, id_col: str = "id", every: str | None = None) -> StreamingQuery:
    """Appends each new id to a table once. A batch that ran before writes its own folder again, so a retry adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        here = f"{target}/batch={number}"
        new = batch.dropDuplicates([id_col])
        if exists(spark, target):  # else this is the first batch
            schema = T.StructType([*transform(new).schema.fields, T.StructField("batch", T.LongType())])
            known = spark.read.schema(schema).option("basePath", target).parquet(target).where(F.col("batch") != number)
            new = once(batch, known, id_col)
        transform(new).write.mode("overwrite").parquet(here)

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def files(spark: SparkSession, path: str, schema: str, most_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).parquet(path)


def session_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """source_app, first, last, size of sessions of a stream (source_app, captured_at): the gap is an app's or none's.

    A session is given out once the watermark has passed it; rows later than `late` change nothing.
    """
    source = F.coalesce("source_app", F.lit(""))
    gap = F.when(source == "", F.lit(f"{GAP_NONE} seconds")).otherwise(F.lit(f"{GAP_APP} seconds"))
    timed = events.where("captured_at is not null").select(source.alias("source_app"), F.col("captured_at").cast("timestamp").alias("at"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    out = timed.groupBy("source_app", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("size"), F.min("at").alias("first"), F.max("at").alias("last"))
    return out.where("size >= 2").select("source_app", "first", "last", "size")
