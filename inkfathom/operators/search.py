"""Full-text search over postings, conjunctive filters, and what a hit shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# BM25's constants.
K1, B = 1.2, 0.75
WORD = r"(?U)[\w'-]+"
TERM = r"(?U)[^\W_]+"
# Lines that are a clock, and lines of an interface.
CLOCK = r"(?U)^[\d:.%/\s-]+(am|pm)?$|^\d{1,2}:\d{2}"
INTERFACE = r"(?iU)^(follow|following|reply|replies|like|likes|share|send( message)?|more|see more|view|comment|comments|save|saved|details|print|back|next|done|ok|cancel|search|home|menu|type a message|ketik pesan|\W+)$"


def terms(text: Column) -> Column:
    """Terms of a text in order: runs of letters and digits, lower-case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def postings(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """term, id, tf, positions, length: the inverted index, to be written by term."""
    found = rows.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t")).withColumn("length", F.size("t"))
    return found.select("id", "length", F.posexplode("t").alias("pos", "term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.max("length").alias("length"))


def query_phrases(query: str) -> list[list[str]]:
    """A query as phrases that must all be there: each word, and the parts of a word in turn. Operators are plain words."""
    import re

    parts = [re.findall(r"[^\W_]+", w.lower()) for w in re.findall(r"[\w'-]+", query)]
    return [p for p in parts if p]


def search(rows: DataFrame, query: str, id_col: str = "id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """id, score of the rows that have every phrase; a smaller (more negative) score is better. rows gives the corpus' size and mean length."""
    phrases = query_phrases(query)
    if not phrases:
        return rows.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    wanted = sorted({t for p in phrases for t in p})
    if index is None:  # only what the query names is kept of each text
        found = rows.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t"))
        sizes = found.select("id", F.size("t").alias("length"), "t")
        corpus = sizes.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        hits = sizes.where(F.arrays_overlap("t", F.array(*[F.lit(w) for w in wanted])))
        lists = hits.select("id", "length", *[F.transform(F.filter(F.transform("t", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), _is(w)), lambda s: s["i"]).alias(f"p_{k}") for k, w in enumerate(wanted)])
    else:
        sizes = rows.select(F.size(terms(F.col(text_col))).alias("length"))
        corpus = sizes.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        own = index.where(F.col("term").isin(*wanted))
        lists = own.groupBy("id").agg(F.max("length").alias("length"), *[F.coalesce(F.max(F.when(F.col("term") == w, F.col("positions"))), F.array().cast("array<int>")).alias(f"p_{k}") for k, w in enumerate(wanted)])
    at = {w: f"p_{k}" for k, w in enumerate(wanted)}

    def places(phrase: list[str]) -> Column:
        first = F.col(at[phrase[0]])
        for k, w in enumerate(phrase[1:], 1):
            first = F.filter(first, _follows(at[w], k))
        return F.size(first)

    lists = lists.withColumns({f"tf_{k}": places(p) for k, p in enumerate(phrases)})
    counts = lists.agg(*[F.count_if(F.col(f"tf_{k}") > 0).alias(f"df_{k}") for k in range(len(phrases))])
    scored = lists.join(F.broadcast(corpus)).join(F.broadcast(counts))  # one row each
    total = F.lit(0.0)
    for k in range(len(phrases)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df_{k}") + 0.5) / (F.col(f"df_{k}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf_{k}")
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    every = F.lit(True)
    for k in range(len(phrases)):
        every = every & (F.col(f"tf_{k}") > 0)
    return scored.where(every).select("id", (-total).alias("score"))


def _is(word: str):
    return lambda s: s["x"] == word


def _follows(column: str, k: int):
    return lambda p: F.array_contains(F.col(column), p + k)


def page(hits: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return hits.orderBy("score", "id").offset(offset).limit(limit)


def newest(rows: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows (id, captured_at) from the newest on, those without a time last, ties by id."""
    return rows.orderBy(F.desc_nulls_last("captured_at"), "id").offset(offset).limit(limit)


def board(rows: DataFrame, query: str = "", category: str | None = None, state: str | None = None, limit: int = 200) -> DataFrame:
    """A board of results: a kind, or topic/<name>, and a state narrow it; with words it is what has them all, best first, else the newest."""
    topic = category.removeprefix("topic/") if category and category.startswith("topic/") else None
    some = filtered(rows, kind=None if topic else category or None, topic=topic, state=state or None)
    if not query_phrases(query):
        return newest(some, limit)
    scored = search(rows.select("id", "text"), query)
    return some.join(scored, "id").orderBy("score", "id").limit(limit)


def dispatched(token: str, kinds: tuple[str, ...], states: tuple[str, ...] = ("present", "quarantined", "attached", "held", "purged")) -> dict[str, str]:
    """What a word given to the board is: a state, a kind, or else a query."""
    return {"state" if token in states else "category" if token in kinds else "query": token}


def hits(rows: DataFrame, length: int = 200) -> DataFrame:
    """What may be shown of hits: their columns but the text, the excerpt of which is redacted as a whole before it is cut, and the number of redactions in the text."""
    from inkfathom.functions.redaction import redact

    out = redact(rows, "text", "_clean", "redactions")
    return out.withColumn("excerpt", F.substring("_clean", 1, length)).drop("text", "_clean")


def snippet(text: Column, words: list[str], around: int = 16) -> Column:
    """The first `around` words from just before the first word of the query, those of the query in « »."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))
    match = lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\w]+", "")).isin(*[x.lower() for x in words])
    first = F.greatest(F.array_position(F.transform(parts, match), True) - 4, F.lit(1)).cast("int")
    shown = F.transform(F.slice(parts, first, F.lit(around)), lambda w: F.when(match(w), F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w))
    return F.concat(F.when(first > 1, "…").otherwise(""), F.array_join(shown, " "), F.when(F.size(parts) >= first + around, "…").otherwise(""))


def filtered(rows: DataFrame, kind: str | None = None, topic: str | None = None, no_topic: bool = False, app: str | None = None, since: str | None = None, until: str | None = None, group: str | None = None, state: str | None = None, domain: str | None = None) -> DataFrame:
    """rows (kind, topics, app, captured_at, group_id, state, domains) that meet every condition given."""
    out = rows
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if topic is not None:
        out = out.where(F.array_contains("topics", topic))
    if no_topic:
        out = out.where(F.size(F.coalesce("topics", F.array().cast("array<string>"))) == 0)
    if app is not None:  # as SQL's LIKE there: ASCII case does not count, % and _ are wild
        out = out.where(F.lower("app").like(app.lower() + "%"))
    day = F.substring(F.date_format("captured_at", "yyyy-MM-dd"), 1, 10)
    if since is not None:
        out = out.where(day >= since)
    if until is not None:
        out = out.where(day <= until)
    if group is not None:
        out = out.where(F.col("group_id") == group)
    if state is not None:
        out = out.where(F.col("state") == state)
    if domain is not None:
        d = domain.lower()
        out = out.where(F.exists("domains", lambda x: (x == d) | x.endswith("." + d)))
    return out


def resolve(rows: DataFrame, given: str) -> DataFrame:
    """The rows (id, note) that a full id, eight or more of its hex digits, or a note's stem may mean; one is an answer."""
    out = F.col("id") == given
    if len(given.removeprefix("sha256:")) >= 8:
        out = out | F.col("id").startswith("sha256:" + given.removeprefix("sha256:").lower())
    return rows.where(out | (F.regexp_extract("note", r"([^/]*?)(?:\.md)?$", 1) == given))


def _body(text: Column, top: Column, bottom: Column) -> Column:
    lines = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))
    return F.slice(lines, F.coalesce(top, F.lit(0)) + 1, F.greatest(F.size(lines) - F.coalesce(top, F.lit(0)) - F.coalesce(bottom, F.lit(0)), F.lit(0)))


def content_only(text: Column, top: Column, bottom: Column) -> Column:
    """struct(lines, hidden): lines of content, without bars, clocks and symbols."""
    keep = F.filter(_body(text, top, bottom), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(CLOCK) & x.rlike("[A-Za-z]{2}"))
    every = F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, "\n", -1)))
    return F.struct(keep.alias("lines"), (every - F.size(keep)).alias("hidden"))


def headline(text: Column, top: Column, bottom: Column, words: list[str], key_terms: Column) -> Column:
    """The line worth reading: the first with a word of the query, else with a key term, else the longest of the first fifteen."""
    body = F.transform(_body(text, top, bottom), lambda x: F.trim(x))
    good = F.filter(body, lambda x: (F.length(x) >= 12) & ~x.rlike(INTERFACE) & ~x.rlike(CLOCK))
    has = lambda x, w: F.contains(F.lower(x), F.lower(w))
    asked = F.get(F.filter(good, lambda x: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: has(x, w))), F.lit(0)) if words else F.lit(None).cast("string")
    termed = F.get(F.filter(good, lambda x: F.exists(F.coalesce(key_terms, F.array().cast("array<string>")), lambda w: F.contains(F.lower(x), w))), F.lit(0))
    longest = F.array_max(F.transform(F.slice(good, 1, 15), lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    return F.regexp_replace(F.coalesce(asked, termed, longest, F.get(body, F.lit(0)), F.lit("")), r"\s+", " ")


def grounded(text: Column, quote: Column, least: int = 8) -> Column:
    """Whether a quote of some length stands in a text, white space and case aside."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return (F.length(plain(quote)) >= least) & F.contains(plain(text), plain(quote))


def short_reason(reason: Column) -> Column:
    """A reason with hosts in place of links."""
    rest = F.regexp_extract(reason, "(?s)^unverified URL: (.+)$", 1)
    hosts = F.array_distinct(F.transform(F.split(rest, ", "), lambda u: F.lower(F.substring_index(F.regexp_replace(u, "^.*?://", ""), "/", 1))))
    return F.when(rest == "", reason).otherwise(F.concat(F.lit("unverified URL: "), F.array_join(hosts, ", ")))
