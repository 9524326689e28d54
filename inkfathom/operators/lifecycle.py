"""What becomes of an item's file: verdict, decision, retention, audit. Plans only; no file is touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of verdicts and decisions, and the retention in seconds.
LEAST_CHARS, LEAST_CONFIDENCE = 3, 0.5
VISUAL = {"coverage": 0.08, "chars": 300, "grays": 180, "edges": 0.03}
DIAGRAM = {"hlines": 14, "vlines": 8, "saturation": 0.30}
RETENTION = 604_800


def verdict(undecoded: Column, decoded: Column, chars: Column, confidence: Column) -> Column:
    """status_reason of an extraction; null if it is ok. undecoded, decoded: whether there is such a code."""
    return F.when(undecoded & ~decoded, "qr_undecodable").when((chars < LEAST_CHARS) & ~decoded, "no_text").when((confidence < LEAST_CONFIDENCE) & ~decoded, "low_confidence")


def mean_confidence(lines: Column) -> Column:
    """Confidence of lines (text, conf), weighted by length; null without text."""
    total = F.aggregate(lines, F.lit(0.0), lambda a, x: a + F.length(x["text"]) * x["conf"])
    chars = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x["text"]))
    return F.when(chars > 0, F.bround(total / chars, 3))


def is_visual(r: dict[str, Column]) -> Column:
    """Little text and rich pixels; unknown coverage counts as full."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (F.coalesce(r["text_coverage"], F.lit(1.0)) < VISUAL["coverage"]) & (zero(r["text_chars"]) < VISUAL["chars"]) & (zero(r["grays"]) >= VISUAL["grays"]) & (zero(r["edges"]) >= VISUAL["edges"]) & (zero(r["n_qr"]) == 0) & (F.coalesce(r["kind"], F.lit("")) != "system")


def is_diagram(r: dict[str, Column]) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    ruled = (zero(r["hlines"]) >= DIAGRAM["hlines"]) | (zero(r["vlines"]) >= DIAGRAM["vlines"])
    return ruled & (zero(r["n_qr"]) == 0) & (zero(r["saturation"]) <= DIAGRAM["saturation"]) & ~F.coalesce(r["kind"], F.lit("")).isin("system", "game")


def decision(r: dict[str, Column]) -> Column:
    """struct(outcome, reason); the order decides. r names keep, has_secrets, status, status_reason, confirmed_by, unverified (array) and what the predicates need."""
    keep, secrets = F.coalesce(r["keep"], F.lit(False)), F.coalesce(r["has_secrets"], F.lit(False))
    out = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), reason.alias("reason"))
    shown = F.array_join(F.slice(r["unverified"], 1, 3), ", ")
    percent = F.format_string("visual: text covers %d%% of the screen", F.bround(F.coalesce(r["text_coverage"], F.lit(0.0)) * 100).cast("int"))
    return (
        F.when(keep & ~secrets, out("attach", F.lit("kept on request")))
        .when((r["status"] != "ok") & r["confirmed_by"].isNull(), out("hold", F.coalesce(r["status_reason"], F.lit("failed"))))
        .when(secrets, out("quarantine", F.lit("contains secrets: image purged after 7 days")))
        .when(is_visual(r), out("attach", percent))
        .when(is_diagram(r), out("attach", F.format_string("diagram: %d horizontal / %d vertical lines", r["hlines"], r["vlines"])))
        .when(F.size(r["unverified"]) > 0, out("quarantine", F.concat(F.lit("content captured in the note; unverified URL kept as text: "), shown)))
        .otherwise(out("quarantine", F.lit("content captured in the note")))
    )


def purge_after(quarantined_at: Column) -> Column:
    return quarantined_at + F.make_dt_interval(secs=F.lit(float(RETENTION)))


def is_due(after: Column, now: Column) -> Column:
    return F.coalesce(now >= after, F.lit(False))


def audit(decided: DataFrame) -> DataFrame:
    """outcome, cause (what stands before the reason's first colon), n."""
    return decided.groupBy("outcome", F.substring_index("reason", ":", 1).alias("cause")).agg(F.count("*").alias("n"))


def purge_queue(rows: DataFrame, now: Column) -> DataFrame:
    """Quarantined rows (id, purge_after) by seconds left, with due."""
    left = F.timestamp_diff("SECOND", now, F.col("purge_after"))
    return rows.where("purge_after is not null").select("id", left.alias("seconds_left"), (left <= 0).alias("due")).orderBy("seconds_left", "id")
