"""Information-theoretic sanitisation: personal data by pattern, and the terms that the corpus shows to reveal it.

Base spans are emails, addresses of hosts, payment cards and phone numbers. Each distinct value is a protected entity e,
of a kind k. A term t (a run of letters, of any length) anywhere in a document of e is evidence; with c() the number of documents
that hold something and c(t, e) of those that hold both, so that repeated wording counts alike everywhere,

    PMI(t; e) = log N c(t, e) / (c(t) c(e))   discloses e if it is at least   IC(k) = log N / c(k),

that is, if the term tells more of the entity than its kind would: c(t, e) c(k) >= c(t) c(e), in whole numbers. Such a
term is sanitised wherever it stands in the documents of e: if it occurs nowhere but with e, so that PMI reaches IC(e), it
is removed; else it is generalised to the least general of its classes that does not disclose e by the same test: all
terms with its first three letters (`zeb*`), with its first letter (`z*`), or any term (`[TERM]`). One document is no
evidence (`SUPPORT`). Letters within base spans are no terms. Everything is built-in expressions, joins and sums; only
texts with entities are shuffled, so that copies are worked on once. Of all other texts, only terms in question are: a bit
set of fixed size, which may let others pass, tells them.

Null and empty texts have no spans; very long texts are searched as a whole; equal texts in one document id are judged row
by row; rows without id and repeated rows count as documents of their own; an empty table gives an empty result. Other
columns are kept by `sanitise` and cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, table

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
#: As the stated patterns, but possessive, and never tried again within a run that failed, so that they take linear time.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
_CARD = r"[0-9](?:[\x20-]?+[0-9]){12,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
SUPPORT = 2
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: Letters of the classes that a term is generalised to, the least general first, and what stands for the most general.
CLASSES, ANY_TERM = (3, 1), "[TERM]"
REMOVE = len(CLASSES) + 2
#: Bits of the set of terms in question, as a power of two; maps that a text's terms are dealt to.
BITS, MAPS = 22, 64
_NOT_LETTERS = r"[^\p{L}]+"
_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, i + 1, F.lit(1)).cast("int")
    doubled = lambda i: F.when((n - i) % 2 == 0, 2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "ip":
        return x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def with_base_spans(rows: DataFrame, text: str = "_text", out: str = "_base") -> DataFrame:
    """Adds an array of (kind number, start, end, value), by kind and start. A regular expression gives matches and what lies between them; their lengths give positions."""
    patterns = {"email": (_EMAIL, F.contains(text, F.lit("@"))), "ip": (_IP, F.contains(text, F.lit("."))), "card": (_CARD, F.lit(True)), "phone": (_PHONE, F.contains(text, F.lit("+")))}
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"_m_{k}": F.when(guard & F.col(text).isNotNull(), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, (p, guard) in patterns.items()})
    rows = rows.withColumns({f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.transform(F.split(text, p, -1), lambda x: F.length(x))) for k, (p, _) in patterns.items()})
    empty = F.array().cast(_SPANS)

    def spans(number: int, kind: str) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), empty.alias("out"))

        def step(a: Column, m: Column) -> Column:
            start = a["at"] + F.get(f"_p_{kind}", a["i"])
            end = start + F.length(m)
            one = F.struct(F.lit(number).alias("kind"), start.alias("start"), end.alias("end"), m.alias("value"))
            return F.struct(end.alias("at"), (a["i"] + 1).alias("i"), F.concat(a["out"], F.array(one)).alias("out"))

        found = F.aggregate(f"_m_{kind}", zero, step, lambda a: a["out"])
        return F.when(F.size(f"_m_{kind}") > 0, F.filter(found, lambda s: _valid(kind, s["value"]))).otherwise(empty)

    rows = rows.withColumn(out, F.concat(*[spans(i, k) for i, k in enumerate(patterns)]))
    return rows.drop(*[f"_{x}_{k}" for x in "mp" for k in patterns])


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    runs = F.array_distinct(F.split(text, _NOT_LETTERS))
    return F.array_distinct(F.transform(F.filter(runs, lambda t: t != ""), lambda t: F.lower(t)))


def _with_classes(terms: Column) -> Column:
    """Distinct terms and the classes of each, which end in an asterisk as no term does."""
    of = lambda n: F.transform(F.filter(terms, lambda t: F.length(t) > n), lambda t: F.concat(F.substring(t, 1, n), F.lit("*")))
    return F.concat(terms, *[F.array_distinct(of(n)) for n in CLASSES])


def _outside(text: str, base: str) -> Column:
    """The text with blanks in place of base spans, so that places stay."""
    by_start = F.array_sort(base, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        start = F.greatest(s["start"], a["at"])  # spans of two kinds may overlap
        pieces = F.array(F.substring(F.col(text), a["at"] + 1, start - a["at"]), F.repeat(F.lit(" "), s["end"] - start))
        return F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], pieces).alias("out")))

    return F.aggregate(by_start, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text), a["at"] + 1, F.length(text))))


def _dealt(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(MAPS)).cast("int")


def _instead(term: Column, level: Column) -> Column:
    """What a term is replaced by: its class of that level, any term, or nothing."""
    out = reduce(lambda c, i: c.when(level == i + 1, F.concat(F.substring(term, 1, CLASSES[i]), F.lit("*"))), range(1, len(CLASSES)), F.when(level == 1, F.concat(F.substring(term, 1, CLASSES[0]), F.lit("*"))))
    return out.when(level == REMOVE, F.lit("")).otherwise(F.lit(ANY_TERM))


def _places(text: Column, over: Column) -> Column:
    """The runs of letters that are keys of the maps over (term to level), as _base, kinds 4 and 5; value is what replaces them."""
    runs = F.filter(F.split(text, _NOT_LETTERS, -1), lambda t: t != "")
    gaps = F.split(text, r"\p{L}+", -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["run"])
        one = F.struct(F.when(x["level"] == REMOVE, 5).otherwise(4).alias("kind"), start.alias("start"), end.alias("end"), _instead(F.lower(x["run"]), x["level"]).alias("value"))
        return F.struct(end.alias("at"), F.when(x["level"].isNotNull(), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    level = lambda t: F.element_at(F.get(over, _dealt(t)), t)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(runs)), runs, lambda g, t: F.struct(F.length(g).alias("gap"), t.alias("run"), level(F.lower(t)).alias("level")))
    return F.aggregate(pairs, zero, step, lambda a: a["out"])


def _entities() -> Column:
    """The distinct (kind, value) of _base."""
    return F.array_distinct(F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"))))


def evidence(texts: DataFrame, terms: Column) -> DataFrame:
    """_row, n_docs, kind, value, term: each of the terms of a text with each entity of it; texts has distinct _row, n_docs, _e (entities) and _rest."""
    one = texts.select("_row", "n_docs", "_e", F.explode(terms).alias("term"))
    return one.select("_row", "n_docs", F.explode("_e").alias("e"), "term").select("_row", "n_docs", "e.kind", "e.value", "term")


def _based(docs: DataFrame, whole: bool) -> DataFrame:
    """doc_id, _row (hash of the text, which tells rows of one doc_id apart), _base, _text (where there are spans) and, if wanted, all columns of docs as _whole."""
    more = [F.struct(*[docs[c] for c in docs.columns]).alias("_whole")] if whole else []
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("_text"), *more).withColumn("_row", F.xxhash64("_text"))
    based = with_base_spans(rows)
    return table(based.withColumn("_text", F.when(F.size("_base") > 0, F.col("_text"))), "pii-base")


def _extra(docs: DataFrame, based: DataFrame) -> DataFrame:
    """_row, _extra: the spans of kinds 4 and 5 of each distinct text that has some."""
    copies = based.where(F.size("_base") > 0).groupBy("_row").agg(F.first("_text").alias("_text"), F.first("_base").alias("_base"), F.count("*").alias("n_docs"))
    some = table(copies.withColumn("_rest", _outside("_text", "_base")), "pii-texts")  # the distinct texts with entities only
    each = some.select("_row", "n_docs", F.explode(_entities()).alias("e"))
    c_e = table(each.groupBy("e").agg(F.sum("n_docs").alias("c_e")).where(F.col("c_e") >= SUPPORT), "pii-entities")
    known = each.join(c_e, "e").groupBy("_row").agg(F.collect_list("e").alias("_e"))  # an entity of one document has no evidence
    texts = table(some.select("_row", "n_docs", "_rest").join(known, "_row"), "pii-evidence")
    found = evidence(texts.withColumn("_terms", _terms(F.col("_rest"))), _with_classes(F.col("_terms")))
    pairs = table(found.groupBy("kind", "value", "term").agg(F.sum("n_docs").alias("c_te")).where(F.col("c_te") >= SUPPORT), "pii-pairs")
    over = table(_levels(_disclosing(docs, some, c_e, pairs)), "pii-disclosing")
    hits = evidence(texts, _terms(F.col("_rest"))).join(over, ["kind", "value", "term"]).groupBy("_row", "term").agg(F.max("level").alias("level"))
    hits = hits.groupBy("_row", _dealt(F.col("term")).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("term", "level"))).alias("own"))
    hits = hits.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("m", "own"))).alias("maps"))
    none = F.create_map().cast("map<string,int>")
    dealt = hits.select("_row", F.transform(F.sequence(F.lit(0), F.lit(MAPS - 1)), lambda i: F.coalesce(F.element_at("maps", i), none)).alias("_over"))
    out = texts.select("_row", "_rest").join(dealt, "_row").select("_row", _places(F.col("_rest"), F.col("_over")).alias("_extra"))
    return table(out, "pii-terms")  # a table, so that a text with many copies can be split


def _in_question(pairs: DataFrame) -> DataFrame:
    """One row: a bit set of the terms, as an array of 2 ** (BITS - 6) numbers."""
    words = 1 << (BITS - 6)
    place = F.pmod(F.xxhash64("term"), F.lit(1 << BITS))
    own = pairs.select(F.shiftright(place, 6).cast("long").alias("id"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit")).distinct()
    own = own.groupBy("id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    every = pairs.sparkSession.range(words).join(own, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("_set"))  # `words` rows, whatever the size


def _disclosing(docs: DataFrame, some: DataFrame, c_e: DataFrame, pairs: DataFrame) -> DataFrame:
    """kind, value, term, remove: the pairs over the threshold, all four counts in documents; terms may be classes."""
    kinds = F.array_distinct(F.transform("_base", lambda s: s["kind"]))
    c_k = some.select("n_docs", F.explode(kinds).alias("kind")).groupBy("kind").agg(F.sum("n_docs").alias("c_k"))  # four rows at most
    asked = F.broadcast(_in_question(pairs))  # half a megabyte
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(1 << BITS))
    listed = lambda t: F.getbit(F.element_at("_set", (F.shiftright(place(t), 6) + 1).cast("int")), place(t).bitwiseAND(F.lit(63)).cast("int")) == 1
    count = lambda df, terms, n: df.join(asked).select(F.explode(F.filter(terms, listed)).alias("term"), n.alias("n"))
    # Terms of whole texts, less those that only base spans hold; columns of their own, so that a text is split once.
    words = docs.select(_terms(F.coalesce(docs["text"], F.lit(""))).alias("_terms"))
    words = count(words, _with_classes(F.col("_terms")), F.lit(1).cast("long"))
    both = some.select("n_docs", *[_terms(F.col(c)).alias(c) for c in ("_text", "_rest")])
    text, rest = (_with_classes(F.col(c)) for c in ("_text", "_rest"))
    within = count(both, F.array_except(text, rest), -F.col("n_docs"))
    beside = count(both, F.array_except(rest, text), F.col("n_docs"))
    c_t = words.union(within).union(beside).groupBy("term").agg(F.sum("n").alias("c_t"))
    counted = pairs.join(c_e.select("e.kind", "e.value", "c_e"), ["kind", "value"]).join(F.broadcast(c_k), "kind").join(c_t, "term")
    return table(counted.where(F.col("c_te") * F.col("c_k") >= F.col("c_t") * F.col("c_e")).select("kind", "value", "term", (F.col("c_te") >= F.col("c_t")).alias("remove")), "pii-over")


def _levels(over: DataFrame) -> DataFrame:
    """kind, value, term, level of the terms over the threshold: the first class that is not over it, from 1, any term, or REMOVE."""
    out = over.where(~F.col("term").endswith("*"))
    classes = over.where(F.col("term").endswith("*"))
    level = F.when(F.col("remove"), REMOVE)
    for i, n in enumerate(CLASSES):
        bad = classes.select("kind", "value", F.col("term").alias(f"class_{i}"), F.lit(True).alias(f"bad_{i}"))
        out = out.withColumn(f"class_{i}", F.when(F.length("term") > n, F.concat(F.substring("term", 1, n), F.lit("*")))).join(bad, ["kind", "value", f"class_{i}"], "left")
        level = level.when(F.col(f"class_{i}").isNotNull() & F.col(f"bad_{i}").isNull(), i + 1)
    return out.select("kind", "value", "term", level.otherwise(len(CLASSES) + 1).alias("level"))


def _joined(*lists: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    name = lambda k: reduce(lambda c, i: c.when(k == i, KINDS[i]), range(1, len(KINDS)), F.when(k == 0, KINDS[0]))
    return F.array_join(F.transform(F.concat(*[F.col(x) for x in lists]), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_generalise, n_remove."""
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    own = id_and_text(docs)
    based = _based(own, False).select("doc_id", "_row", "_base", "_text")
    out = based.drop("_text").join(_extra(own, based), "_row", "left").withColumn("_extra", F.coalesce("_extra", F.array().cast(_SPANS)))
    return out.select(
        "doc_id",
        *[count("_base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(F.encode(_joined("_base"), "UTF-8"), 256).alias("base_sha256"),
        _joined("_base", "_extra").alias("spans"),
        *[count("_extra", i).alias(f"n_{KINDS[i]}") for i in (4, 5)],
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the same columns, the text's spans replaced by MASKS and terms by what they are generalised to; of spans that overlap, the earlier and longer counts.

    Rows without spans of the base kinds have none, and pass without a shuffle.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("all"))
    based = _based(rows, True)
    plain = based.where(F.size("_base") == 0).select("_whole.all.*")
    out = based.where(F.size("_base") > 0).join(_extra(id_and_text(docs, id_col, text_col), based), "_row", "left")
    every = F.concat("_base", F.coalesce("_extra", F.array().cast(_SPANS)))
    out = out.withColumn("_spans", F.array_sort(every, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from:int,to:int,next:int,mask:string>>").alias("out"))
    mask = lambda s: reduce(lambda c, i: c.when(s["kind"] == i, MASKS[KINDS[i]]), range(1, 4), F.when(s["kind"] == 0, MASKS[KINDS[0]])).otherwise(s["value"])
    keep = lambda a, s: F.when(s["start"] < a["end"], a).otherwise(F.struct(s["end"].alias("end"), F.concat(a["out"], F.array(F.struct(a["end"].alias("from"), s["start"].alias("to"), s["end"].alias("next"), mask(s).alias("mask")))).alias("out")))
    out = out.withColumn("_cuts", F.aggregate("_spans", zero, keep, lambda a: a["out"]))
    pieces = F.transform("_cuts", lambda c: F.concat(F.substring("_text", c["from"] + 1, c["to"] - c["from"]), c["mask"]))
    clean = F.concat(F.array_join(pieces, ""), F.substring("_text", F.element_at("_cuts", -1)["next"] + 1, F.length("_text")))
    masked = out.select(*[clean.alias(c) if c == text_col else F.col("_whole.all")[c].alias(c) for c in docs.columns])
    return plain.union(masked)
