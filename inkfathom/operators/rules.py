"""Rules as data, compiled to column expressions that also say why they match.

A rule names apps (package prefixes), qr_types, domains (suffixes), text patterns (text_min distinct ones), code_langs
("*" is any), mode any or all, and patterns that must match also. Input columns: app, qr_types, domains, text, lang, and what `prepared` adds.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache, reduce
from re import _constants, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfathom.plans import default_rules

from .lifecycle import is_visual

#: What an item can be.
KINDS = ("chat", "social", "web", "email", "receipt", "document", "code", "slide", "photo", "game", "system", "screenshot")
CAMERA = r"(?i)^(IMG|PXL|MVIMG)_\d{8}_\d{6}"


#: Ways to spell a pattern that are looked at, and parts of words of a pattern that are searched for, at most; a pattern with more is tried on every text.
MOST_SPELLED, MOST_PARTS = 2000, 8
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class RuleError(ValueError):
    """A rule that can't be used, and why."""


class _NotSpelled(Exception):
    """A pattern of which it is not known what its matches contain."""


def _spelled(parsed: Iterable) -> list[tuple[str | None, ...]]:
    """Every way in which a pattern can be spelled: letters and figures, " " where certainly none is next, None for what is not known."""
    char = lambda c: (c if c in _ALNUM else " ",)
    out: list[tuple[str | None, ...]] = [()]
    for op, av in parsed:
        some: list[tuple[str | None, ...]] = [(None,)]
        if op is _constants.LITERAL:
            some = [char(chr(av))]
        elif op is _constants.IN and all(o is _constants.LITERAL or (o, a) == (_constants.CATEGORY, _constants.CATEGORY_SPACE) for o, a in av):
            some = list({char(chr(a)) if o is _constants.LITERAL else (" ",) for o, a in av})
        elif op is _constants.AT and av is _constants.AT_BOUNDARY:
            some = [(" ",)]
        elif op is _constants.SUBPATTERN:
            if av[1] or av[2]:
                raise _NotSpelled
            some = _spelled(av[3])
        elif op is _constants.BRANCH:
            some = [x for p in av[1] for x in _spelled(p)]
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and av[:2] == (0, 1):
            some = [(), *_spelled(av[2])]
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and av[0] and set(_spelled(av[2])) == {(" ",)}:
            some = [(" ",)]
        if len(out) * len(some) > MOST_SPELLED:
            raise _NotSpelled
        out = [a + b for a in out for b in some]
    return out


@cache
def needs(pattern: str) -> tuple[frozenset[str], frozenset[str]] | None:
    """(words, parts) of which every text with a match has one: a word between other signs than a-z and 0-9, or a part of one.

    None if there is no such list, or the pattern is one that Python and Java may read differently.
    """
    if re.search(r"&&|\[\^?\]|\[[^\]]*\[|\\(?![bdswBDSW])\w", pattern):
        return None
    try:
        parsed = _parser.parse(pattern)
        if parsed.state.flags & ~re.UNICODE:
            return None
        ways = _spelled(parsed)
    except (_NotSpelled, re.error):
        return None
    words, parts = set(), set()
    for way in ways:
        runs = re.findall(r"(?<=( ))?([a-z0-9]+)(?=( ))?", "".join("?" if c is None else c for c in way))
        whole, some = ([r for a, r, b in runs if a and b], [r for _, r, _ in runs if len(r) > 2])
        if whole:
            words.add(max(whole, key=len))
        elif some:
            parts.add(max(some, key=len))
        else:
            return None
    return (frozenset(words), frozenset(parts)) if len(parts) <= MOST_PARTS else None


def _can_match(pattern: str) -> Column:
    """Whether the text has what every match of a lower-case pattern has; much faster than the pattern, which few texts then meet."""
    known = needs(pattern)
    if known is None:
        return F.lit(True)
    words = [F.arrays_overlap("_words", F.array(*[F.lit(w) for w in sorted(known[0])]))] if known[0] else []
    return reduce(lambda a, b: a | b, words + [F.contains("low", F.lit(p)) for p in sorted(known[1])])


@dataclass(frozen=True)
class Rule:
    name: str
    mode: str = "any"
    apps: tuple[str, ...] = ()
    qr_types: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    text_min: int = 1
    also: tuple[str, ...] = ()
    code_langs: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, raw: dict, source: str = "rules") -> Rule:
        name = raw.get("kind") or raw.get("category") or raw.get("name") or ""
        if not re.fullmatch(r"[a-z0-9][a-z0-9-]{0,30}", name) or not name[0].isalpha():
            raise RuleError(f"{source}: {name!r} is no name of lower-case letters, digits and hyphens")
        if raw.get("mode", "any") not in ("any", "all"):
            raise RuleError(f"{source}: {name} has a mode other than any and all")
        for p in (*raw.get("text", ()), *raw.get("also", ())):
            try:
                re.compile(p)
            except re.error as e:
                raise RuleError(f"{source}: {name} has a pattern that is none: {e}") from e
        many = {k: tuple(raw.get(k, ())) for k in ("apps", "qr_types", "text", "also", "code_langs")}
        return cls(name, raw.get("mode", "any"), domains=tuple(d.lower() for d in raw.get("domains", ())), text_min=int(raw.get("text_min", 1)), **many)

    def why(self) -> Column:
        """The reason that the rule matches, null if it does not. What is quoted is only looked for once the rule is known to match."""
        quote = lambda p: F.concat(F.lit("'"), F.trim(F.regexp_extract("text", "(?iU)" + p, 0)), F.lit("'"))
        # A lower-case pattern over the lower-case text (column low) is several times as fast as one that minds no case.
        plain = lambda p: not re.search(r"(?<!\\)[A-Z]", p)
        has = lambda p: _can_match(p) & F.col("low").rlike("(?U)" + p) if plain(p) else F.col("text").rlike("(?iU)" + p)
        checks: list[tuple[Column, Column]] = []
        if self.code_langs:
            hit = F.col("lang").isNotNull() if "*" in self.code_langs else F.col("lang").isin(*self.code_langs)
            checks.append((hit, F.concat(F.lit("code "), "lang")))
        if self.apps:
            checks.append((reduce(lambda c, a: c | F.col("app").startswith(a), self.apps, F.lit(False)), F.concat(F.lit("app "), "app")))
        if self.qr_types:
            hit = F.array_sort(F.array_intersect("qr_types", F.array(*[F.lit(x) for x in self.qr_types])))
            checks.append((F.size(hit) > 0, F.concat(F.lit("QR "), F.array_join(hit, ", "))))
        if self.domains:
            ends = F.array(*[F.lit(d) for d in self.domains])
            hit = F.array_sort(F.array_distinct(F.filter("domains", lambda d: F.exists(ends, lambda s: (d == s) | d.endswith(F.concat(F.lit("."), s))))))
            checks.append((F.size(hit) > 0, F.concat(F.lit("domain "), F.array_join(hit, ", "))))
        if self.text:
            enough = reduce(lambda c, p: c | has(p), self.text, F.lit(False)) if self.text_min == 1 else reduce(lambda c, p: c + has(p).cast("int"), self.text, F.lit(0)) >= self.text_min
            quoted = F.array_compact(F.array(*[F.when(has(p), quote(p)) for p in self.text]))
            checks.append((enough, F.concat(F.lit("text "), F.array_join(F.slice(quoted, 1, 3), ", "))))
        if not checks:
            return F.lit(None).cast("string")
        true = [F.coalesce(c, F.lit(False)) for c, _ in checks]
        ok = reduce(lambda a, b: a & b if self.mode == "all" else a | b, true)
        for p in self.also:
            ok = ok & has(p)
        parts = [F.when(c, w) for c, (_, w) in zip(true, checks)] + [F.concat(F.lit("and "), quote(p)) for p in self.also]
        return F.when(ok, F.array_join(F.array_compact(F.array(*parts)), "; "))


def prepared(rows: DataFrame) -> DataFrame:
    """Rows with what rules read, once for all of them: low, the text in lower case, and _words, its runs of a-z and 0-9."""
    return rows.withColumn("low", F.lower("text")).withColumn("_words", F.array_distinct(F.split("low", "[^a-z0-9]+", -1)))


def load(toml: str | None = None) -> tuple[list[Rule], list[Rule]]:
    """(kind rules, topic rules) of a TOML text; what it has no table of is as built in."""
    raw = tomllib.loads(toml) if toml else {}
    kinds, topics = raw.get("rule") if toml else None, raw.get("topic")
    return [Rule.of(r, "kinds") for r in (default_rules.KINDS if kinds is None else kinds)], [Rule.of(r, "topics") for r in topics or default_rules.TOPICS]


def classify(rules: Iterable[Rule]) -> Column:
    """struct(kind, why) of the first rule that matches, null if none does; rules behind it are not tried.

    Whoever reads it more than once gives it a column of its own first.
    """
    first = F.coalesce(*[F.concat(F.lit(f"{r.name}\0"), r.why()) for r in rules])
    return F.when(first.isNotNull(), F.struct(F.substring_index(first, "\0", 1).alias("kind"), F.regexp_replace(first, r"(?s)\A[^\x00]*\x00", "").alias("why")))


def topics(rules: Iterable[Rule]) -> Column:
    """map of each topic that matches to its first reason."""
    by_name: dict[str, list[Column]] = {}
    for r in rules:
        by_name.setdefault(r.name, []).append(r.why())
    every = F.array(*[F.struct(F.lit(n).alias("key"), F.coalesce(*w).alias("value")) for n, w in by_name.items()])
    return F.map_from_entries(F.filter(every, lambda x: x["value"].isNotNull()))


def is_camera(app: Column, file_name: Column) -> Column:
    return F.coalesce(app == "com.apple.camera", F.lit(False)) | ((F.coalesce(app, F.lit("")) == "") & F.coalesce(F.regexp_extract(file_name, r"([^/]*)$", 1).rlike(CAMERA), F.lit(False)))


def kind(first: Column, item: dict[str, Column], camera: Column, set_by: Column, set_kind: Column, callers: tuple[str, ...] = ("llm", "user")) -> Column:
    """struct(kind, why): a caller's kind, then code and receipts, pictures, camera photos with text, the app's kind, a screenshot."""
    pair = lambda k, w: F.struct(k.alias("kind"), w.alias("why"))
    visual = is_visual(item | {"kind": first["kind"]})
    percent = F.format_string("visual: text covers %d%% of the image", F.bround(F.coalesce(item["text_coverage"], F.lit(0.0)) * 100).cast("int"))
    return (
        F.when(set_by.isin(*callers) & set_kind.isin(*KINDS), pair(set_kind, F.concat(F.lit("set by "), set_by)))
        .when(first["kind"].isin("code", "receipt"), first)
        .when(visual, pair(F.lit("photo"), percent))
        .when(camera, pair(F.lit("slide"), F.lit("camera photo with text")))
        .when(first.isNotNull(), first)
        .otherwise(pair(F.lit("screenshot"), F.lit("no kind rule matched")))
    )


def final_topics(found: Column, added: Column, removed: Column) -> Column:
    """map of topics to reasons, with what users added and without what they removed."""
    none = F.array().cast("array<string>")
    added, removed = F.coalesce(added, none), F.coalesce(removed, none)
    kept = F.map_filter(found, lambda k, v: ~F.array_contains(removed, k) & ~F.array_contains(added, k))
    own = F.map_from_entries(F.transform(F.array_except(added, removed), lambda t: F.struct(t.alias("key"), F.lit("added by user").alias("value"))))
    return F.map_concat(kept, own)


def suggestions(tagged: DataFrame, totals: DataFrame, least: int = 3, rules: Iterable[Rule] = ()) -> DataFrame:
    """kind, value, topic, tags of rules that users' topics suggest and that rules do not give already.

    tagged: domains, app, topic (one row for each topic a user added); totals: app, n. A domain needs `least` tags
    of one topic and none of another; an app five or more that agree and cover 60 % of its notes.
    """
    by_domain = tagged.select(F.explode("domains").alias("value"), "topic").groupBy("value").agg(F.count("*").alias("tags"), F.countDistinct("topic").alias("topics"), F.min("topic").alias("topic"))
    domains = by_domain.where((F.col("tags") >= least) & (F.col("topics") == 1)).select(F.lit("domain").alias("kind"), "value", "topic", "tags")
    by_app = tagged.where("app is not null").groupBy(F.col("app").alias("value")).agg(F.count("*").alias("tags"), F.countDistinct("topic").alias("topics"), F.min("topic").alias("topic"))
    apps = by_app.join(totals.select(F.col("app").alias("value"), "n"), "value").where((F.col("tags") >= max(least, 5)) & (F.col("topics") == 1) & (F.col("tags") / F.col("n") >= 0.6))
    found = domains.union(apps.select(F.lit("app").alias("kind"), "value", "topic", "tags"))
    rules = list(rules)
    if not rules:
        return found
    none, domain = F.array().cast("array<string>"), F.col("kind") == "domain"  # what the rules say of the domain or the app alone
    asked = prepared(found.withColumns({"app": F.when(~domain, F.col("value")), "domains": F.when(domain, F.array("value")).otherwise(none), "qr_types": none, "text": F.lit(""), "lang": F.lit(None).cast("string")}))
    return asked.where(~F.coalesce(F.array_contains(F.map_keys(topics(rules)), F.col("topic")), F.lit(False))).select("kind", "value", "topic", "tags")
