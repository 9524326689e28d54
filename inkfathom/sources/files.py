"""Sources: image files, manifests, lists, rules and notes, all by Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfathom.functions.text import content_id, name_parts
from inkfathom.operators.records import latest

# Extensions of images.
IMAGES = ("png", "jpg", "jpeg", "webp", "heic", "heif", "tif", "tiff", "bmp")

LINE = T.StructType([T.StructField("text", T.StringType()), T.StructField("conf", T.DoubleType()), T.StructField("box", T.StructType([T.StructField(c, T.DoubleType()) for c in "xywh"]))])


def image_files(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """path, id, bytes, modified, captured_at, source_app of images under a folder, in order of path; hidden files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    some = raw.where(F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*IMAGES) & ~name.startswith("."))
    out = some.select("path", content_id(F.col("content")).alias("id"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), name_parts(name).alias("n"))
    out = out.select("path", "id", "bytes", "modified", F.coalesce("n.captured_at", F.col("modified").cast("timestamp_ntz")).alias("captured_at"), "n.source_app")
    return out.orderBy("path").limit(limit) if limit else out


def photos(found: DataFrame, now: Column, settle: int, since: Column | None = None) -> DataFrame:
    """Files (path, modified) that a watcher takes, with settled: named as phones and computers name pictures, or, of any name, arrived since it was switched on.

    Downloads (column downloaded, if there is one) of other names are never taken. What was modified less than `settle`
    seconds ago is still being written: settled is false, and it waits.
    """
    named = F.col("name_parts").isNotNull() & (F.col("name_parts.captured_at").isNotNull())
    out = found.withColumn("name_parts", name_parts(F.regexp_extract("path", r"([^/]*)$", 1)))
    arrived = F.lit(False) if since is None else (F.col("modified") >= since) & (~F.coalesce("downloaded", F.lit(False)) if "downloaded" in found.columns else F.lit(True))
    base = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    image = base.rlike(r"^[^.].*\.(" + "|".join(IMAGES) + ")$")
    out = out.where(image & (F.coalesce(named, F.lit(False)) | F.coalesce(arrived, F.lit(False))))
    return out.withColumn("settled", F.timestamp_diff("SECOND", F.col("modified"), now) >= settle).drop("name_parts")


def manifests(spark: SparkSession, path: str, schema: T.StructType | str, id_col: str = "id") -> DataFrame:
    """The latest record of each id in JSON-lines manifests: by file name, then by place in the file. Lines that are no JSON are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    rows = raw.select(F.from_json("value", schema).alias("r"), "_file", "_block", "_at").where(F.col(f"r.{id_col}").isNotNull())
    return latest(rows.select("r.*", "_file", "_block", "_at"), id_col, "_file", "_block", "_at").drop("_file", "_block", "_at")


def job_log(spark: SparkSession, path: str, schema: T.StructType | str, limit: int = 20) -> DataFrame:
    """The newest entries of a log of JSON lines (column at); what is malformed is left out."""
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("r")).where("r.at is not null")
    return rows.select("r.*").orderBy(F.desc("at")).limit(limit)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word of a list with one on each line; lines that begin with # are comments."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> '' and not startswith(word, '#')").distinct()


def ranks(spark: SparkSession, path: str) -> DataFrame:
    """domain, rank of a list of rank,domain lines; the first of a domain, its best rank, counts."""
    rows = spark.read.schema("rank int, domain string").csv(path)
    return rows.where("rank is not null").groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.min("rank").alias("rank"))


def rules_text(spark: SparkSession, path: str) -> str:
    """A rules file; rules are configuration, of a size for the driver."""
    return spark.read.text(path, wholetext=True).head()["value"]


# The marks of a note's own part.
FRONT, TEXT_BLOCK = r"(?s)\A---\n(.*?)\n---\n?(.*)\z", r"(?s)```(?:text)?\n(.*?)\n```"


def notes(spark: SparkSession, path: str) -> DataFrame:
    """path, front (map of keys and raw values), body, text (the block of text) of Markdown notes."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    front = F.regexp_extract("value", FRONT, 1)
    pairs = F.filter(F.transform(F.split(front, "\n"), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:\s][^:]*):", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"))), lambda p: p["key"] != "")
    body = F.when(F.col("value").rlike(FRONT), F.regexp_extract("value", FRONT, 2)).otherwise(F.col("value"))
    return raw.select("path", F.map_from_entries(pairs).alias("front"), body.alias("body"), F.regexp_extract(body, TEXT_BLOCK, 1).alias("text"))
