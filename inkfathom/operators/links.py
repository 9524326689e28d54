"""Links over ordered lines, registrable domains, and hosts that were misread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.functions.text import LINK, TRAILING, domain, host, normal_link, raw_host

# What is shown, and what it may stand for.
CONFUSIONS = (
    ("I", "l"), ("|", "l"), ("|", "i"), ("1", "l"), ("1", "i"), ("l", "1"), ("l", "i"), ("i", "l"), ("q", "g"), ("g", "q"), ("0", "o"), ("o", "0"), ("O", "o"), ("O", "0"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("5", "s"), ("s", "5"), ("cl", "d"),
)
# The limits of a correction.
TRUSTED_RANK, BEATS_RAW, BEATS_NEXT = 100_000, 100, 10
HOST = r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$"
WRAPPED = r"^[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+$"


_ELLIPSIS = r"^(?:…|\.\.\.)"
_TAIL = "[" + "".join("\\" + c for c in TRAILING) + "]+$"


def _carried(lines: Column) -> Column:
    """For each line, what it could carry on of a link that reached the end of the line before it: piece, whether it can at all, and whether it needs no joint there."""

    def of(line: Column, i: Column) -> Column:
        piece = F.regexp_replace(F.trim(F.coalesce(line["text"], F.lit(""))), "[<>|]+$", "")
        before = F.get(lines, i - 1)
        gap = line["y"] - (before["y"] + before["h"])
        near = F.coalesce(gap.between(-0.5 * before["h"], 1.5 * before["h"]), F.lit(True))  # a missing box says nothing
        fits = (F.length(piece) >= 2) & piece.rlike(WRAPPED) & piece.rlike("[A-Za-z]") & ~piece.rlike(r"(?i)^(https?://|www\.)") & near
        return F.struct(piece.alias("piece"), fits.alias("fits"), piece.rlike("[/-]").alias("free"), line["conf"].alias("conf"))

    return F.transform(lines, of)


def _joined(raw: Column, conf: Column, cut: Column, after: Column) -> Column:
    """A link at the end of its line with what the lines after it carry on."""
    zero = F.struct(raw.alias("raw"), conf.alias("conf"), F.lit(0).alias("joined"), cut.alias("cut"), F.lit(True).alias("on"))

    def step(a: Column, x: Column) -> Column:
        on = a["on"] & ~a["cut"] & (a["raw"] != "") & x["fits"] & (x["free"] | a["raw"].rlike("[/=?&_-]$"))
        more = F.struct(F.concat(a["raw"], F.regexp_replace(x["piece"], _TAIL, "")).alias("raw"), F.least(a["conf"], x["conf"]).alias("conf"), (a["joined"] + 1).alias("joined"), x["piece"].rlike(r"(?:…|\.\.\.)$").alias("cut"), F.lit(True).alias("on"))
        return F.when(on, more).otherwise(F.struct(a["raw"].alias("raw"), a["conf"].alias("conf"), a["joined"].alias("joined"), a["cut"].alias("cut"), F.lit(False).alias("on")))

    return F.aggregate(after, zero, step)


def found_in_lines(lines: DataFrame) -> DataFrame:
    """id, seq, raw, url, confidence, joined, truncated of the links of items, each once by its normal form.

    lines: id, line_no, text, conf, x, y, w, h (a box may be null). Links are found line by line; one that reaches the end of
    its line goes on with the lines below that can carry it. Expressions over an item's lines alone.
    """
    row = F.struct("line_no", "text", F.col("conf").cast("double").alias("conf"), "x", "y", "w", "h")
    # A line without dot and scheme can only carry a link on: items without any other line have none.
    whole = lines.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("lines"), F.max(F.contains("text", F.lit("."))).alias("any")).where("any")
    whole = whole.withColumn("carried", _carried(F.col("lines")))
    each = whole.select("id", "carried", F.posexplode("lines").alias("i", "line")).withColumn("text", F.coalesce("line.text", F.lit("")))
    each = each.withColumn("found", F.regexp_extract_all("text", F.lit(LINK), F.lit(0))).where(F.size("found") > 0)
    each = each.withColumn("between", F.split("text", LINK, -1)).select("id", "carried", "i", "line", "between", F.posexplode("found").alias("k", "m"))
    each = each.where(~F.contains(F.substring_index(F.substring_index("m", "//", -1), "/", 1), F.lit("@")))
    rest = F.element_at("between", F.col("k") + 2)
    raw, cut = F.regexp_replace("m", _TAIL, ""), F.col("m").rlike(r"(?:…|\.\.\.)$") | rest.rlike(_ELLIPSIS)
    at_end = (F.trim(rest) == "") & (F.col("k") + 2 == F.size("between"))
    after = F.when(at_end, F.slice("carried", F.col("i") + 2, F.size("carried"))).otherwise(F.slice("carried", 1, 0))
    out = each.select("id", F.struct("i", "k").alias("seq"), _joined(raw, F.col("line.conf"), cut, after).alias("j"))
    out = out.select("id", "seq", "j.raw", "j.conf", "j.joined", F.col("j.cut").alias("truncated"))
    numbered = out.withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy("seq")) - 1)
    return first_by_url(numbered.withColumn("url", normal_link(F.col("raw"))).where(host(F.col("url")) != "")).select("id", "seq", "raw", "url", F.bround("conf", 2).alias("confidence"), "joined", "truncated")


def first_by_url(found: DataFrame) -> DataFrame:
    """The first row of each id and url, by seq."""
    order = Window.partitionBy("id", "url").orderBy("seq")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def found_in_text(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, seq, raw, url of the links of texts, each once; built-ins only, no line goes on with another."""
    from inkfathom.functions.text import links

    found = rows.select(F.col(id_col).alias("id"), F.posexplode(links(F.col(text_col))).alias("seq", "raw"))
    return first_by_url(found.withColumn("url", normal_link(F.col("raw"))).where(host(F.col("url")) != ""))


def parse_suffixes(text: str) -> list[tuple[str, str]]:
    """(rule, kind) of a public suffix list; kinds are rule, wild and exception."""
    out = []
    for line in text.splitlines():
        if (line := line.strip()) and not line.startswith("//"):
            rule = line.split()[0].lower()
            out.append((rule[1:], "exception") if rule.startswith("!") else (rule[2:], "wild") if rule.startswith("*.") else (rule, "rule"))
    return out


def registrable(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """host, registrable (null for a public suffix itself) of distinct hosts; suffixes: rule, kind, a list of known size."""
    some = hosts.select("host").distinct().withColumn("labels", F.split(F.lower(F.btrim("host", F.lit("."))), r"\.", -1))
    n = F.size("labels")
    places = some.select("host", "labels", F.posexplode("labels").alias("i", "label"))
    tail = lambda k: F.array_join(F.slice("labels", F.col("i") + k, F.greatest(n - F.col("i") - k + 1, F.lit(0))), ".")
    places = places.withColumns({"own": tail(1), "above": F.when(F.col("i") + 1 < n, tail(2))})
    rules = F.broadcast(suffixes)
    pick = lambda kind, name: rules.where(F.col("kind") == kind).select(F.col("rule").alias(name)).distinct()
    marked = places.join(pick("rule", "r"), F.col("own") == F.col("r"), "left").join(pick("wild", "w"), F.col("above") == F.col("w"), "left").join(pick("exception", "e"), F.col("own") == F.col("e"), "left")
    size = n - F.col("i")
    best = marked.groupBy("host", "labels").agg(F.max(F.when(F.col("e").isNotNull(), size - 1)).alias("exception"), F.max(F.when(F.col("r").isNotNull() | F.col("w").isNotNull(), size)).alias("rule"))
    suffix = F.coalesce("exception", "rule", F.lit(1))
    return best.select("host", F.when(n > suffix, F.array_join(F.slice("labels", n - suffix, suffix + 1), ".")).alias("registrable"))


def candidates(hosts: DataFrame) -> DataFrame:
    """raw, candidate, edits of distinct raw hosts: what one or two exchanges of CONFUSIONS in different places make of them, by the fewest."""
    table_ = F.array(*[F.struct(F.lit(shown).alias("shown"), F.lit(meant).alias("meant")) for shown, meant in CONFUSIONS])
    raw = hosts.select("raw").distinct().where(F.length("raw") > 0)
    at = lambda i: F.transform(F.filter(table_, lambda c: F.substring(F.col("raw"), i, F.length(c["shown"])) == c["shown"]), lambda c: F.struct(i.alias("at"), (i + F.length(c["shown"])).alias("to"), c["meant"].alias("meant")))
    raw = raw.withColumn("places", F.flatten(F.transform(F.sequence(F.lit(1), F.length("raw")), at)))
    one = raw.select("raw", "places", F.explode("places").alias("a"))
    two = one.select("raw", "a", F.explode(F.filter("places", lambda p: p["at"] >= F.col("a.to"))).alias("b"))
    part = lambda a, b: F.substring(F.col("raw"), a, b - a)
    end = F.length("raw") + 1
    single = one.select("raw", F.concat(part(F.lit(1), F.col("a.at")), "a.meant", part(F.col("a.to"), end)).alias("candidate"), F.lit(1).alias("edits"))
    double = two.select("raw", F.concat(part(F.lit(1), F.col("a.at")), "a.meant", part(F.col("a.to"), F.col("b.at")), "b.meant", part(F.col("b.to"), end)).alias("candidate"), F.lit(2).alias("edits"))
    made = single.union(double).withColumn("candidate", F.lower("candidate")).where((F.col("candidate") != F.lower("raw")) & F.col("candidate").rlike(HOST))
    return made.groupBy("raw", "candidate").agg(F.min("edits").alias("edits"))


def resolve(hosts: DataFrame, ranks: DataFrame, suffixes: DataFrame, tlds: DataFrame, evidence: DataFrame, allowed: DataFrame) -> DataFrame:
    """raw, host, verified_by, corrected, reason, flag of distinct raw hosts.

    ranks: domain, rank. evidence and allowed: domain, decoded from codes anywhere, and on the user's list. A raw host
    that evidence, the list or a good rank bears out stands; else the one candidate that is far likelier than the rest
    and than the raw reading; else a ranked raw reading without a rival; else it is flagged.
    """
    raw = hosts.select("raw").distinct()
    made = candidates(raw)
    every = raw.select("raw", F.lower("raw").alias("name"), F.lit(0).alias("edits")).union(made)
    named = registrable(every.select(F.col("name").alias("host")), suffixes).withColumnRenamed("host", "name").withColumnRenamed("registrable", "domain")
    flag = lambda df, what: df.select("domain").distinct().withColumn(what, F.lit(True))
    every = every.join(named, "name").join(ranks.groupBy("domain").agg(F.min("rank").alias("rank")), "domain", "left").join(flag(evidence, "coded"), "domain", "left").join(flag(allowed, "listed"), "domain", "left")
    top = tlds.select(F.lower("tld").alias("tld")).distinct().withColumn("real", F.lit(True))
    every = every.withColumn("tld", F.substring_index("name", ".", -1)).join(F.broadcast(top), "tld", "left").withColumn("valid", F.col("name").rlike(HOST))
    own = every.where("edits = 0").select("raw", "valid", "real", F.when(F.col("valid"), F.struct("domain", "rank", "coded", "listed")).alias("own"))
    placed = F.when(F.col("coded") | F.col("listed"), 0).otherwise(F.col("rank"))
    rivals = every.where("edits > 0 and real").withColumn("place", placed).where("place is not null")
    order = Window.partitionBy("raw").orderBy("place", "edits", "name")
    why = F.when(F.col("coded"), F.concat("domain", F.lit(" decoded from a QR code"))).when(F.col("listed"), F.concat("domain", F.lit(" is on your allowlist"))).otherwise(F.concat("domain", F.lit(" Tranco rank "), "rank"))
    rivals = rivals.withColumns({"_n": F.row_number().over(order), "why": why, "by": F.when(F.col("coded"), "crossref").when(F.col("listed"), "allowed").otherwise("known")}).where("_n <= 3")
    best = rivals.groupBy("raw").agg(F.max(F.when(F.col("_n") == 1, F.struct("name", "domain", "place", "why", "by"))).alias("a"), F.max(F.when(F.col("_n") == 2, F.struct("domain", "place"))).alias("b"), F.array_sort(F.collect_list(F.struct("_n", "name"))).alias("shown"))
    out = own.join(best, "raw", "left")
    a, b, o = F.col("a"), F.col("b"), F.col("own")
    floor = F.greatest(a["place"], F.lit(1))
    unique = b.isNull() | (b["place"] >= floor * BEATS_NEXT) | (b["domain"] == a["domain"])
    beats = o.isNull() | o["rank"].isNull() | (o["rank"] >= floor * BEATS_RAW)
    answer = lambda name, by, corrected, reason, fl=None: F.struct(name.alias("host"), by.alias("verified_by"), F.lit(corrected).alias("corrected"), reason.alias("reason"), F.lit(fl).cast("string").alias("flag"))
    lower, text = F.lower("raw"), F.lit
    rank_text = F.concat(o["domain"], text(" Tranco rank "), o["rank"].cast("string"))
    reading = F.when(o.isNull(), "not a valid host").when(o["rank"].isNotNull(), F.concat(text("rank "), o["rank"].cast("string"))).otherwise("unranked")
    doubt = F.when(a.isNotNull() & ~unique, F.concat(text("ambiguous: "), F.array_join(F.transform("shown", lambda x: x["name"]), ", ")))
    none = lambda fl: answer(lower, text("none"), False, F.coalesce(doubt, text(None).cast("string")), fl)
    result = (
        F.when(o["coded"], answer(lower, text("crossref"), False, text("domain also decoded from a QR code")))
        .when(o["listed"], answer(lower, text("allowed"), False, F.concat(o["domain"], text(" is on your allowlist"))))
        .when(o["rank"] <= TRUSTED_RANK, answer(lower, text("known"), False, rank_text))
        .when(a.isNotNull() & unique & beats, answer(a["name"], a["by"], True, F.concat(a["why"], text("; raw reading "), reading)))
        .when(o["rank"].isNotNull() & doubt.isNull(), answer(lower, text("known"), False, F.concat(rank_text, text(", no likelier lookalike"))))
        .when(~F.col("valid"), none("invalid_host"))
        .when(F.col("real").isNull(), none("invalid_tld"))
        .otherwise(none(None))
    )
    return out.select("raw", result.alias("r")).select("raw", "r.*")


def verified(urls: DataFrame, resolved: DataFrame) -> DataFrame:
    """urls (id, seq, raw, url, truncated, verified_by) with corrected hosts; one that becomes an earlier one of its item goes."""
    read = urls.where("verified_by <> 'qr'").drop("verified_by").withColumn("_host", raw_host(F.col("raw")))
    fixed = read.join(resolved.withColumnRenamed("raw", "_host").withColumnRenamed("host", "_to"), "_host")
    fixed = fixed.withColumn("url", F.concat(F.regexp_extract("url", "^([a-z]+://)", 1), "_to", F.regexp_extract("url", "^[a-z]+://[^/?]*(.*)$", 1)))
    fixed = fixed.withColumn("flag", F.when(F.col("truncated"), "truncated").otherwise(F.col("flag"))).select("id", "seq", "raw", "url", "truncated", "verified_by", "corrected", "reason", "flag")
    coded = urls.where("verified_by = 'qr'").select("id", "seq", "raw", "url", "truncated", "verified_by", F.lit(False).alias("corrected"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("flag"))
    order = Window.partitionBy("id", "url").orderBy(F.when(F.col("verified_by") == "qr", 0).otherwise(1), "seq")
    return coded.union(fixed).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def cross_referenced(urls: DataFrame, coded: DataFrame) -> DataFrame:
    """urls with crossref: whether the link's domain was decoded from a code anywhere (column domain of coded)."""
    known = coded.select("domain").distinct().withColumn("crossref", F.lit(True))
    return urls.withColumn("domain", domain(F.col("url"))).join(known, "domain", "left").withColumn("crossref", F.coalesce("crossref", F.lit(False)))


def suggested(urls: DataFrame) -> DataFrame:
    """domain, urls, notes, held, examples of domains without verification, those that hold most first. urls: id, seq, raw, registrable, verified_by, flag, state."""
    open_ = urls.where("verified_by = 'none' and flag is null")
    once = open_.groupBy("registrable", "raw").agg(F.min(F.struct("id", "seq")).alias("first"))
    shown = once.withColumn("_n", F.row_number().over(Window.partitionBy("registrable").orderBy("first"))).where("_n <= 3")
    shown = shown.groupBy("registrable").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "raw"))), lambda x: x["raw"]).alias("examples"))
    out = open_.groupBy("registrable").agg(F.count("*").alias("urls"), F.countDistinct("id").alias("notes"), F.countDistinct(F.when(F.col("state") == "held", F.col("id"))).alias("held"))
    out = out.join(shown, out["registrable"].eqNullSafe(shown["registrable"])).select(out["registrable"].alias("domain"), "urls", "notes", "held", "examples")
    return out.orderBy(F.desc("held"), F.desc("notes"), "domain")


def allow_targets(given: DataFrame, suffixes: DataFrame, tlds: DataFrame) -> DataFrame:
    """given, domain, error of what a user (column given) wants to allow: the registrable domain, or why there is none.

    A scheme and a path are taken off. Without a suffix list nothing is allowed, for a host's domain is then not known.
    """
    name = F.lower(F.trim("given"))
    for scheme in ("https://", "http://"):
        name = F.when(name.startswith(scheme), F.substring(name, len(scheme) + 1, 1 << 30)).otherwise(name)
    asked = given.select("given").distinct().withColumn("host", F.substring_index(name, "/", 1))
    found = registrable(asked.select("host"), suffixes)
    top = tlds.select(F.lower("tld").alias("tld")).distinct().withColumn("real", F.lit(True))
    out = asked.join(found, "host").withColumn("tld", F.substring_index("host", ".", -1)).join(top, "tld", "left")
    known = suffixes.agg((F.count("*") > 0).alias("listed"))  # one row
    error = F.when(~F.col("listed"), "no suffix list").when(~F.col("host").rlike(HOST), "not a domain name").when(F.col("real").isNull(), "not a real top-level domain").when(F.col("registrable").isNull(), "a public suffix, not a site")
    out = out.join(F.broadcast(known)).withColumn("error", error)
    return out.select("given", F.when(F.col("error").isNull(), F.col("registrable")).alias("domain"), "error")


def linkable(verified_by: Column, flag: Column) -> Column:
    return verified_by.isin("qr", "crossref", "known", "allowed") & flag.isNull()
