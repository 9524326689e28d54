"""Records over time: the latest of each id, upserts, changes, known and blocked, journals."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, id_col: str, *order: Column | str) -> DataFrame:
    """The last row of each id by the columns given."""
    w = Window.partitionBy(id_col).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, id_col: str = "id", once: str = "added_at") -> DataFrame:
    """New rows in place of old ones; what is set once stays as first set."""
    kept = old.join(new.select(id_col), id_col, "left_anti")
    first = old.select(id_col, F.col(once).alias("_first"))
    return kept.unionByName(new.join(first, id_col, "left").withColumn(once, F.coalesce("_first", once)).drop("_first").select(*old.columns))


def changed(old: DataFrame, new: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """The new rows that are new or differ in a column, null being a value."""
    before = old.select(id_col, F.struct(*columns).alias("_before"))
    return new.join(before, id_col, "left").where(~F.struct(*columns).eqNullSafe(F.col("_before"))).drop("_before")


def planned(found: DataFrame, known: DataFrame, blocked: DataFrame, id_col: str = "id") -> DataFrame:
    """id, action of found files: blocked, known, copy (of an earlier one found) or new."""
    w = Window.partitionBy(id_col).orderBy("path")
    has = lambda df, what: df.select(id_col).distinct().withColumn(what, F.lit(True))
    out = found.withColumn("_n", F.row_number().over(w)).join(has(blocked, "_b"), id_col, "left").join(has(known, "_k"), id_col, "left")
    return out.select(id_col, "path", F.when(F.col("_b"), "blocked").when(F.col("_k"), "known").when(F.col("_n") > 1, "copy").otherwise("new").alias("action"))


def new_copies(found: DataFrame, listed: DataFrame) -> DataFrame:
    """id, paths where an item's bytes lie besides those listed."""
    seen = found.groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return seen.join(listed.groupBy("id").agg(F.collect_set("path").alias("known")), "id", "left").select("id", F.array_except("paths", F.coalesce("known", F.array().cast("array<string>"))).alias("paths")).where(F.size("paths") > 0)


def dissolved(before: DataFrame, after: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups that are no more."""
    return before.select(group).where(F.col(group).isNotNull()).distinct().join(after.select(group).distinct(), group, "left_anti")


def cache_misses(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions (id, question, model) without a kept answer."""
    return asked.join(cache, ["id", "question", "model"], "left_anti")


def with_texts(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Items with the text of each, those without one included."""
    return items.join(texts.select("id", "text"), "id", "left")


def parsed(rows: DataFrame, json: str, schema: str) -> DataFrame:
    """Rows whose record is JSON, with its fields as columns in its place."""
    return rows.withColumn("_r", F.from_json(json, schema)).where(F.col(json).isNotNull() & F.col("_r").isNotNull()).select(*[c for c in rows.columns if c != json], "_r.*")


# Who may set a kind in a note.
WRITERS = ("llm", "user")


def overridden(items: DataFrame, notes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Items with what their notes (id, kind, decided_by, evidence) say: set_kind, set_by, set_why, and legacy_topic where a caller's kind is none of today's."""
    n = notes.select("id", F.col("kind").alias("_k"), F.col("decided_by").alias("_by"), F.col("evidence").alias("_e"))
    out = items.join(n, "id", "left").withColumn("_set", F.col("_by").isin(*WRITERS)).withColumn("_now", F.col("_k").isin(*kinds))
    real, why = F.col("_set") & F.col("_now"), F.concat(F.lit("set by "), "_by", F.when(F.col("_e") != "", F.concat(F.lit(", quoting '"), "_e", F.lit("'"))).otherwise(""))
    legacy = F.when(F.col("_set") & ~F.col("_now") & ~F.col("_k").isin("", "uncategorized"), F.col("_k"))
    return out.withColumns({"set_kind": F.when(real, F.col("_k")), "set_by": F.when(real, F.col("_by")), "set_why": F.when(real, why), "legacy_topic": legacy}).drop("_k", "_by", "_e", "_set", "_now")


def migrated_topics(added: Column, legacy: Column) -> Column:
    """Topics a user added, with a kind of old times as one more."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(added, none), F.when(legacy.isNotNull(), F.array(legacy)).otherwise(none))))


def copies_to_quarantine(items: DataFrame) -> DataFrame:
    """id, number, path of the copies (array of path, state, restored_at) that go once an item's file has left its source; restored ones stay."""
    gone = items.where("source_state <> 'present'").select("id", F.posexplode("copies").alias("k", "c"))
    return gone.where((F.col("c.state") == "present") & F.col("c.restored_at").isNull()).select("id", (F.col("k") + 1).alias("number"), F.col("c.path").alias("path"))


def files_of(items: DataFrame) -> DataFrame:
    """id, path of every file of an item once: its note, its image where it lies now, its copies where they lie."""
    image = F.coalesce("stored_path", F.when(F.col("source_state") == "present", F.col("source_path")))
    copies = F.transform(F.coalesce("copies", F.expr("cast(array() as array<struct<path:string,state:string,restored_at:string,stored_path:string>>)")), lambda c: F.when(c["state"] == "quarantined", c["stored_path"]).when(c["state"] == "present", c["path"]))
    return items.select("id", F.explode(F.array_distinct(F.filter(F.concat(F.array("note_path", image), copies), lambda p: p != ""))).alias("path"))


# ---- journals: rows (journal, seq, body) where body is canonical JSON ----


def row_hash(previous: Column, body: Column) -> Column:
    return F.sha2(F.concat(previous, body), 256)


def sign(rows: DataFrame, key: bytes, of: str = "row_hash") -> DataFrame:
    """Adds expected_sig, the keyed signature of a hash."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            yield s.map(lambda h: hmac.new(key, h.encode(), hashlib.sha256).hexdigest() if h is not None else None)

    return rows.withColumn("expected_sig", F.pandas_udf(run, "string")(of))


def verify(rows: DataFrame, key: bytes) -> DataFrame:
    """journal, intact, rows (those before the first that is wrong) of rows (journal, seq, body, prev_hash, row_hash, sig).

    A row's own hash follows from what it stores, so every row is checked for itself; the chain is a comparison with
    the row before.
    """
    w = Window.partitionBy("journal").orderBy("seq")
    checked = sign(rows, key).withColumns({"_linked": F.col("prev_hash") == F.coalesce(F.lag("row_hash").over(w), F.lit("")), "_n": F.row_number().over(w)})
    right = F.col("_linked") & (F.col("row_hash") == row_hash(F.col("prev_hash"), F.col("body"))) & (F.col("sig") == F.col("expected_sig"))
    wrong = F.min(F.when(~F.coalesce(right, F.lit(False)), F.col("_n")))
    return checked.groupBy("journal").agg(wrong.isNull().alias("intact"), F.coalesce(wrong - 1, F.count("*")).alias("rows"))


def append(bodies: list[str], key: bytes, previous: str = "") -> list[dict]:
    """Rows of a journal, each chained to the one before and signed."""
    out = []
    for n, body in enumerate(bodies):
        h = hashlib.sha256((previous + body).encode()).hexdigest()
        out.append({"seq": n, "body": body, "prev_hash": previous, "row_hash": h, "sig": hmac.new(key, h.encode(), hashlib.sha256).hexdigest()})
        previous = h
    return out
