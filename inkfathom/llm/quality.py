"""Quality rules learned as a decision list: ordered conjunctions of thresholds, applied as one Spark conditional expression.

Statistics of a text are built-in column expressions only, one row at a time, without a shuffle. Rules are grown and
pruned by sequential covering on at most `sample` labelled documents (those whose hashed id is smallest), then emitted
as a CASE WHEN over the statistics of every document.

Null, empty and white-space texts have no words and fail the base rule (n_words < 10). Repeated rows get equal results.
Without labels the list is empty and only the base rule rejects. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, words_column

SYMBOLS = "[#*$%&|<>]"
#: Labelled documents that a list is fitted on, at most.
SAMPLE = 20_000
#: A rule needs this precision on the rows kept for pruning, and this many rejected rows that it is right about.
PRECISION, SUPPORT, MAX_RULES, MAX_TERMS = 0.95, 3, 12, 3
#: Words of a window for repeats; positions below this take the fast path.
WINDOW, _SHIFT = 5, 21
FEATURES = ("symbols_per_mille", "bangs_per_mille", "upper_per_mille", "digits_per_mille", "mean_word_centichars", "dup_lines_per_mille", "repeat_per_mille", "n_words")


def _with_repeat_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words from _words, _hashes and _n: equal windows stand side by side once (hash, position) are sorted.

    Each step is a projection of its own, for an expression named inside a lambda would run again for each element.
    """
    low = (1 << _SHIFT) - 1
    starts = F.sequence(F.lit(0), F.col("_n") - WINDOW)
    gram = lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
    fits = (F.col("_n") > WINDOW) & (F.col("_n") < low)
    packed = F.when(fits, F.sort_array(F.transform(starts, lambda i: gram(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))))
    wide = F.when(F.col("_n") >= low, F.sort_array(F.transform(starts, lambda i: F.struct(gram(i).alias("h"), i.alias("i")))))
    rows = rows.withColumns({"_packed": packed, "_wide": wide})

    def same(p: Column, q: Column) -> Column:
        return F.slice("_words", p + 1, WINDOW) == F.slice("_words", q + 1, WINDOW)

    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    alike = lambda x, y: F.coalesce((F.shiftright(x, _SHIFT) == F.shiftright(y, _SHIFT)) & same(place(x), place(y)), F.lit(False))
    alike_wide = lambda x, y: F.coalesce((x["h"] == y["h"]) & same(x["i"], y["i"]), F.lit(False))

    def hits(c: str, equal, at) -> Column:
        return F.transform(c, lambda x, i: F.when(equal(x, F.get(c, i - 1)) | equal(x, F.get(c, i + 1)), at(x)))

    hit = F.when(F.col("_packed").isNotNull(), hits("_packed", alike, place)).when(F.col("_wide").isNotNull(), hits("_wide", alike_wide, lambda x: x["i"]))
    rows = rows.withColumn("_at", F.sort_array(F.filter(hit, lambda p: p.isNotNull())))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
    covered = F.aggregate("_at", zero, step, lambda a: a["n"].cast("long"))
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_packed", "_wide", "_at")


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base statistics and FEATURES of every document, and the columns named by keep (each as kept_<name>)."""
    text = F.coalesce(docs["text"], F.lit(""))
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("_text"), *[docs[c].alias(f"kept_{c}") for c in keep])
    out = out.withColumn("_words", words_column(F.col("_text")))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    out = out.select("*", F.size("_words").alias("_n"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"), lines.alias("_lines"))
    out = _with_repeat_words(out)
    less = lambda c: (F.length("_text") - F.length(F.translate("_text", c, ""))).cast("long")
    out = out.select(
        "doc_id",
        *[f"kept_{c}" for c in keep],
        F.col("_n").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        "n_repeat_words",
        less("!").alias("_bangs"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("_upper"),
        F.regexp_count("_text", F.lit("[0-9]")).cast("long").alias("_digits"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.expr(f"({a} * 1000) div {b}")).otherwise(F.lit(0).cast("long"))
    return out.select(
        "*",
        share("n_symbols", "word_chars").alias("symbols_per_mille"),
        share("_bangs", "word_chars").alias("bangs_per_mille"),
        share("_upper", "word_chars").alias("upper_per_mille"),
        share("_digits", "word_chars").alias("digits_per_mille"),
        F.when(F.col("n_words") > 0, F.expr("(word_chars * 100) div n_words")).otherwise(F.lit(0).cast("long")).alias("mean_word_centichars"),
        share("n_dup_lines", "_n_lines").alias("dup_lines_per_mille"),
        share("n_repeat_words", "n_words").alias("repeat_per_mille"),
    ).drop("_n_lines", "_bangs", "_upper", "_digits")


def base_failed() -> Column:
    """The fixed rule: fewer than ten words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Term:
    feature: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.at_least else F.col(self.feature) <= self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects the document. None holding keeps it."""

    rules: tuple[tuple[Term, ...], ...] = ()

    def column(self) -> Column:
        """Number of the first rule that holds, from 1; 0 if none does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            condition = reduce(lambda a, b: a & b, [t.column() for t in rule])
            out = F.when(condition, F.lit(i)) if out is None else out.when(condition, F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{t.feature} {'>=' if t.at_least else '<='} {t.threshold}" for t in r) for r in self.rules) or "keep"


def _holds(rule: list[Term], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(lambda a, t: a & t.holds(x), rule, np.ones(n, bool))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Term]:
    """Adds the term with the largest FOIL gain until no good row is covered."""
    rule: list[Term] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_TERMS and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 1e-9
        for f in FEATURES:
            v, b = x[f][inside], bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 65), method="nearest"))
            order = np.argsort(v, kind="stable")
            v, upto = v[order], np.concatenate([[0], np.cumsum(b[order])])
            for at_least in (True, False):
                k = np.searchsorted(v, cuts, "left" if at_least else "right")
                pos = upto[-1] - upto[k] if at_least else upto[k]
                every = len(v) - k if at_least else k
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / every) - np.log2(p / (p + n))), -1.0)
                j = int(np.argmax(g))
                if g[j] > gain:
                    best, gain = Term(f, at_least, int(cuts[j])), g[j]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _worth(rule: list[Term], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    inside = _holds(rule, x, len(bad))
    right = int((bad & inside).sum())
    return (right + 1) / (int(inside.sum()) + 2), right


def fit_rows(x: dict[str, np.ndarray], bad: np.ndarray) -> DecisionList:
    """Sequential covering: two of three rows grow a rule, the third prunes it; rows that it covers go, until no rule is good enough."""
    rules: list[tuple[Term, ...]] = []
    there = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < MAX_RULES:
        sub = lambda m: ({f: x[f][m] for f in FEATURES}, bad[m])
        (gx, gb), (px, pb) = sub(there & ~third), sub(there & third)
        if gb.sum() < SUPPORT:
            break
        rule = _grow(gx, gb)
        while len(rule) > 1 and _worth(rule[:-1], px, pb)[0] >= _worth(rule, px, pb)[0]:
            rule.pop()
        inside = _holds(rule, px, len(pb)) if rule else np.zeros(len(pb), bool)
        right = int((pb & inside).sum())
        if not rule or right < SUPPORT or right < PRECISION * inside.sum():
            break
        rules.append(tuple(rule))
        there &= ~_holds(rule, x, len(bad))
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """A list fitted on at most `sample` labelled documents; a document labelled twice counts by its lowest quality."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    judged = statistics(text, keep=("quality",)).withColumn("failed", base_failed())
    got = judged.select("doc_id", "kept_quality", "failed", *FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).toPandas()
    got = got[~got["failed"]]  # the list decides on no others
    x = {f: got[f].to_numpy(np.int64) for f in FEATURES}
    return fit_rows(x, got["kept_quality"].to_numpy() == 0)


def judge(docs: DataFrame, rules: DecisionList, keep: tuple[str, ...] = ()) -> DataFrame:
    """The statistics, base_failed, rule (first that holds, 0 for none) and kept of every document."""
    out = statistics(docs, keep)
    return out.withColumn("base_failed", base_failed()).withColumn("rule", rules.column()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_only(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that base rule and list keep, unchanged."""
    held = [c for c in docs.columns if c != "doc_id"]
    out = judge(docs, rules, tuple(held)).withColumn("_here", F.monotonically_increasing_id())
    # A filter on _here can't move below the statistics, where every use of a column would compute it again.
    return out.where(F.col("kept") & (F.col("_here") >= 0)).select(*[F.col("doc_id") if c == "doc_id" else F.col(f"kept_{c}").alias(c) for c in docs.columns])
