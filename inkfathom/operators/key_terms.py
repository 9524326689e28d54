"""Key terms: tf * ln(n / df), the best few of each text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.functions.redaction import redact
from inkfathom.functions.text import key_words
from inkfathom.functions.wordlists import GIVEN_NAMES
from inkfathom.tables import table

TOP, LEAST_DF, MOST_SHARE = 5, 2, 0.25
#: Terms whose counts are broadcast at most.
BROADCAST = 2_000_000


def redacted_terms(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Terms of which redaction takes out an occurrence anywhere: they are no terms anywhere."""
    clean = redact(rows.select(id_col, text_col), text_col, "_clean", "_n").where("_n > 0")  # most texts have nothing to redact
    signed = lambda c, n: F.transform(key_words(F.col(c)), lambda t: F.struct(t.alias("term"), F.lit(n).alias("n")))
    both = clean.select(F.monotonically_increasing_id().alias("_row"), F.concat(signed(text_col, 1), signed("_clean", -1)).alias("t")).select("_row", F.explode("t").alias("t"))
    lost = both.groupBy("_row", "t.term").agg(F.sum("t.n").alias("n")).where("n > 0")
    given = rows.sparkSession.createDataFrame([(g.lower(),) for g in GIVEN_NAMES], "term string")
    return lost.select("term").union(given).distinct()


def scored_terms(rows: DataFrame, id_col: str = "id", text_col: str = "text", excluded: DataFrame | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """id, term, tf, df, weight, rank (1 is best, ties alphabetically) of the best terms; excluded has a column term.

    Texts are taken apart once. Terms meet their counts where they lie if these are at most `broadcast`, else in hash joins, and
    are dealt by id once, as numbers, to be counted and ranked. Texts of one id are one.
    """
    words = table(rows.select(id_col, key_words(F.col(text_col)).alias("_terms")), "key-terms")
    n = F.lit(words.count())
    several = table(words.groupBy(id_col).agg(F.count("*").alias("_rows")).where("_rows > 1"), "several-texts")
    own = F.explode(F.array_distinct("_terms")).alias("term")
    if several.isEmpty():
        once = words.select(own)
    else:
        ids = several.select(F.col(id_col).alias("_id"), "_rows")
        marked = words.join(ids, words[id_col].eqNullSafe(ids["_id"]), "left").drop("_id")
        once = marked.where("_rows is null").select(own).union(marked.where("_rows is not null").select(id_col, own).distinct().select("term"))
    df = once.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= LEAST_DF) & (F.col("df") <= F.greatest(F.lit(float(LEAST_DF)), MOST_SHARE * n)))
    if excluded is not None:
        df = df.join(excluded.select("term").distinct(), "term", "left_anti")
    df = table(df.orderBy("term").withColumn("_t", F.monotonically_increasing_id()), "term-counts")  # numbers in the order of terms
    df = F.broadcast(df) if df.count() <= broadcast else df.hint("shuffle_hash")
    met = words.select(id_col, F.explode("_terms").alias("term")).join(df, "term").select(id_col, "_t", "df").repartition(id_col)
    scored = met.groupBy(id_col, "_t", "df").agg(F.count("*").alias("tf")).withColumn("weight", F.round(F.col("tf") * F.log(n / F.col("df")), 9))
    order = Window.partitionBy(id_col).orderBy(F.desc("weight"), "_t")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return best.join(df.select("_t", "term"), "_t").select("term", id_col, "tf", "df", "weight", "rank")


def key_terms(rows: DataFrame, id_col: str = "id", text_col: str = "text", stop: DataFrame | None = None) -> DataFrame:
    """id, terms (best first) of every row; what redaction removes and the user's stop terms are left out."""
    excluded = redacted_terms(rows, id_col, text_col)
    excluded = excluded.union(stop.select(F.lower("term"))) if stop is not None else excluded
    best = scored_terms(rows, id_col, text_col, excluded).groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return rows.select(id_col).join(best, id_col, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
