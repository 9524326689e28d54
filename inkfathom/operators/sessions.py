"""Sessions, episodes, and what members of a session pass on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

# Seconds that end a session, from an app and without one; members that make an episode; a majority.
GAP_APP, GAP_NONE = 600, 1800
EPISODE_APP, EPISODE_NONE = 5, 3
MAJORITY_OF, MAJORITY = 3, 0.60


#: Seconds of a stretch of time that one task orders; sessions go on from one stretch to the next.
STRETCH = 86_400


def _micros(rows: DataFrame, name: str) -> Column:
    """Microseconds of a column of times; those without a zone are not read in the session's, whose clocks change."""
    if not isinstance(rows.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    since = F.col(name) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20, 6)") * 1_000_000).cast("long")


def sessions(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Adds session (first member's id), part and size to rows (id, source_app, captured_at) in runs of two or more.

    Rows without a time are in none; of rows at one time, one without an id comes last. A gap of exactly the limit does not end
    a session. Rows are ordered within stretches of time of a source, and stretches among each other, so that a source that
    gives a third of all rows is no single task. A session is told by its source and the time of its start, as an id may be null.
    """
    timed = rows.where("captured_at is not null").withColumns({"_source": F.coalesce("source_app", F.lit("")), "_at": _micros(rows, "captured_at")})
    timed = timed.withColumn("_stretch", F.floor(F.col("_at") / (stretch * 1_000_000)))
    limit = F.when(F.col("_source") == "", GAP_NONE).otherwise(GAP_APP)
    key, before, order = ["_source", "_stretch"], Window.partitionBy("_source").orderBy("_stretch"), ["_at", F.asc_nulls_last("id")]
    ends = timed.groupBy(*key).agg(F.max("_at").alias("_last"))
    ends = ends.select(*key, F.lag("_last").over(before).alias("_ahead"))
    inside = Window.partitionBy(*key).orderBy(*order)
    gap = F.col("_at") - F.coalesce(F.lag("_at").over(inside), F.col("_ahead"))  # whole seconds would let a part of one pass
    marked = timed.join(ends, key).withColumn("_starts", F.coalesce(gap > limit * 1_000_000, F.lit(True)))
    marked = marked.withColumn("_own", F.last(F.when(F.col("_starts"), F.struct("_at", "id")), ignorenulls=True).over(inside)).drop("_ahead")
    # What is before a stretch's first start belongs to the session that the stretches before left open.
    opened = marked.groupBy(*key).agg(F.max(F.when(F.col("_starts"), F.struct("_at", "id"))).alias("_open"))
    opened = opened.select(*key, F.last("_open", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    named = marked.join(opened, key).withColumn("_start", F.coalesce("_own", "_carried")).drop("_own", "_carried", "_starts")
    named = named.withColumns({"session": F.col("_start.id"), "_start": F.col("_start._at")})
    counts = named.groupBy("_source", "_start", "_stretch").agg(F.count("*").alias("_n"))
    one = Window.partitionBy("_source", "_start")
    counts = counts.select("_source", "_start", "_stretch", F.coalesce(F.sum("_n").over(one.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(one).alias("size")).where("size >= 2")
    out = named.join(counts, ["_source", "_start", "_stretch"])
    part = F.col("_before") + F.row_number().over(Window.partitionBy("_source", "_stretch", "_start").orderBy(*order))
    return out.withColumn("part", part.cast("int")).select(*rows.columns, "session", "part", "size")


def episodes(in_sessions: DataFrame) -> DataFrame:
    """The sessions with members enough; episode is named after the first member."""
    least = F.when(F.coalesce("source_app", F.lit("")) == "", EPISODE_NONE).otherwise(EPISODE_APP)
    return in_sessions.where(F.col("size") >= least).withColumn("episode", F.concat(F.lit("ep-"), F.substring(F.regexp_replace(F.col("session").cast("string"), "^[^:]*:", ""), 1, 8)))


def episode_summary(in_episodes: DataFrame, kind: str = "kind") -> DataFrame:
    """episode, size, first, last and most common kind; of kinds as common, the one that comes first."""
    kinds = in_episodes.groupBy("episode", kind).agg(F.count("*").alias("n"), F.min("part").alias("at"))
    modal = kinds.groupBy("episode").agg(F.max_by(kind, F.struct("n", -F.col("at"))).alias("modal_kind"))
    return in_episodes.groupBy("episode").agg(F.count("*").alias("size"), F.min("captured_at").alias("first"), F.max("captured_at").alias("last")).join(modal, "episode")


def inherited_topics(in_sessions: DataFrame) -> DataFrame:
    """id, topics that members without any take from their session.

    in_sessions has id, session, topics, added, removed (arrays). What users added to members goes before a majority of
    those that have topics; a member whose topics were removed takes none.
    """
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    bare = in_sessions.where((size("topics") == 0) & (size("removed") == 0)).select("id", "session")
    seeds = in_sessions.select("session", F.explode("added").alias("topic")).distinct().groupBy("session").agg(F.array_sort(F.collect_list("topic")).alias("seeded"))
    having = in_sessions.where(size("topics") > 0)
    members = having.groupBy("session").agg(F.count("*").alias("m"))
    counts = having.select("session", F.explode("topics").alias("topic")).groupBy("session", "topic").agg(F.count("*").alias("n"))
    agreed = counts.join(members, "session").where((F.col("m") >= MAJORITY_OF) & (F.col("n") / F.col("m") >= MAJORITY)).groupBy("session").agg(F.array_sort(F.collect_list("topic")).alias("agreed"))
    out = bare.join(seeds, "session", "left").join(agreed, "session", "left")
    return out.select("id", F.coalesce("seeded", "agreed").alias("topics")).where("topics is not null")


def folded(in_episodes: DataFrame) -> DataFrame:
    """episode, position, best, time, also: an episode's members in order, each duplicate group once where it first comes.

    in_episodes: episode, id, captured_at, group_id, rank. The member of a group that ranks best within the episode stands
    for it, and also lists the others in order.
    """
    unit = F.coalesce(F.concat(F.lit("g:"), "group_id"), F.concat(F.lit("i:"), F.col("id").cast("string")))
    rows = in_episodes.withColumn("_unit", unit)
    once = rows.groupBy("episode", "_unit").agg(F.min(F.struct("captured_at", "id")).alias("first"), F.min_by("id", F.struct("rank", "captured_at", "id")).alias("best"), F.array_sort(F.collect_list(F.struct("captured_at", "id"))).alias("every"))
    order = Window.partitionBy("episode").orderBy("first")
    also = F.transform(F.filter("every", lambda x: x["id"] != F.col("best")), lambda x: x["id"])
    return once.select("episode", F.row_number().over(order).alias("position"), "best", F.date_format("first.captured_at", "HH:mm").alias("time"), also.alias("also"))
