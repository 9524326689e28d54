"""Column expressions over texts, names, links and codes. Built-ins only; regular expressions use (?U) where Unicode classes are meant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import LINK_TLDS, STOP_WORDS

TRAILING = ".,;:!?)]}>'\"’”…"
_EDGE = "[" + "".join("\\" + c if c in "]}[" else c for c in TRAILING) + "]"


def content_id(content: Column) -> Column:
    """Identity of a file by its bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def key_words(text: Column) -> Column:
    """Candidate key terms of a text, in order and with repeats."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z'-]{3,}+"), F.lit(0))
    stripped = F.transform(found, lambda w: F.struct(w.alias("w"), F.btrim(w, F.lit("'-")).alias("s")))
    return F.transform(F.filter(stripped, lambda x: ~x["s"].isin(*STOP_WORDS)), lambda x: x["s"])


def content_tokens(text: Column) -> Column:
    """The set of words and figures that duplicates are told by; figures carry a #."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z0-9]{2,}"), F.lit(0))
    figures = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b\d[\d.,:%/]*\d\b|\b\d\b"), F.lit(0))
    return F.array_distinct(F.concat(words, F.transform(figures, lambda n: F.concat(F.lit("#"), n))))


def line_key(line: Column) -> Column:
    """What two readings of one line have in common."""
    return F.regexp_replace(F.lower(line), "[^0-9a-z]", "")


def slug(label: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), F.lit("-")), 1, 40)


# Parts of package names that say nothing.
PACKAGE_NOISE = ("com", "org", "net", "my", "io", "co", "app", "android", "apple")


def app_slug(package: Column) -> Column:
    """The telling part of a package name: the first longer part, else the first that says something."""
    parts = F.split(package, r"\.", -1)
    noise = F.array(*[F.lit(x) for x in PACKAGE_NOISE])
    telling = F.filter(parts, lambda p: ~F.array_contains(noise, p))
    longer = F.filter(telling, lambda p: F.length(p) > 3)
    first = F.coalesce(F.get(longer, F.lit(0)), F.get(telling, F.lit(0)), F.get(parts, F.lit(0)))
    return F.when(F.coalesce(package, F.lit("")) == "", F.lit("image")).otherwise(F.substring(first, 1, 24))


def countdown(seconds: Column) -> Column:
    part = lambda unit, within: F.floor((seconds % within) / unit) if within else F.floor(seconds / unit)
    return F.when(seconds <= 0, F.lit("due now")).otherwise(F.format_string("%dd %02dh %02dm %02ds", part(86400, 0), part(3600, 86400), part(60, 3600), (seconds % 60).cast("long")))


# ---- file names ----


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


# How names carry a time, in the order tried, and the app that each means.
NAME_PATTERNS = (
    (r"^WhatsApp Image (\d{4})-(\d{2})-(\d{2}) at (\d{1,2})\.(\d{2})\.(\d{2})", "com.whatsapp"),
    (r"^Screenshot (\d{4})-(\d{2})-(\d{2}) at (\d{1,2})\.(\d{2})\.(\d{2})", "com.apple.macos.screenshot"),
    (r"^(?:IMG|VID|PXL|MVIMG)_(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})", None),
    (r"^Screenshot_(\d{4})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})", None),
)
ANDROID_NAME = r"^Screenshot_(\d{8})_(\d{6})_(.+)$"


def name_parts(name: Column) -> Column:
    """struct(captured_at timestamp_ntz, source_app) that a file name tells; null where it does not."""
    stem = _stem(name)
    half = F.upper(F.right(F.rtrim(stem), F.lit(2)))

    def dated(pattern: str, app: str | None) -> tuple[Column, Column]:
        g = [F.regexp_extract(stem, pattern, i) for i in range(1, 7)]
        hour = g[3].cast("int")
        hour = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
        when = F.try_to_timestamp(F.format_string("%s-%s-%s %02d:%s:%s", g[0], g[1], g[2], hour, g[4], g[5]), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
        return stem.rlike(pattern), F.struct(when.alias("captured_at"), F.when(when.isNotNull(), F.lit(app)).cast("string").alias("source_app"))

    digits = F.concat(F.regexp_extract(stem, ANDROID_NAME, 1), F.regexp_extract(stem, ANDROID_NAME, 2))
    rest = F.split(F.regexp_extract(stem, ANDROID_NAME, 3), "_", -1)
    # The package is the run of plain lower-case parts at the beginning, two at least.
    good = F.transform(rest, lambda t: t.rlike("^[a-z0-9]+$"))
    run = F.coalesce(F.array_position(good, False).cast("int"), F.lit(0))
    run = F.when(run == 0, F.size(rest)).otherwise(run - 1)
    package = F.when(run >= 2, F.array_join(F.slice(rest, F.lit(1), F.greatest(run, F.lit(0))), "."))
    android = F.struct(F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("captured_at"), package.alias("source_app"))
    none = F.struct(F.lit(None).cast("timestamp_ntz").alias("captured_at"), F.lit(None).cast("string").alias("source_app"))
    cases = [dated(*p) for p in NAME_PATTERNS] + [(stem.rlike(ANDROID_NAME), android)]
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])).otherwise(none)


# ---- links ----
LINK = (
    r"(?i)(?:https?://[^\s<>\"'`]+)|(?:\bwww\.[^\s<>\"'`]+)"
    r"|(?:(?<![@\w.-])[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.(?:" + "|".join(LINK_TLDS) + r")\b(?:/[^\s<>\"'`]*)?)"
)


def trim_link(url: Column) -> Column:
    return F.rtrim(F.trim(url), F.lit(TRAILING))


def _with_scheme(url: Column) -> Column:
    u = trim_link(url)
    return F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def host(url: Column) -> Column:
    """Lower-case host of a link with a scheme, without user and port."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def normal_link(url: Column) -> Column:
    """A link in its comparable form: scheme, lower-case host, path without closing slashes, query."""
    u = _with_scheme(url)
    rest = F.regexp_replace(F.regexp_replace(u, r"#.*$", ""), r"^[A-Za-z]+://[^/?#]*", "")
    path = F.rtrim(F.regexp_extract(rest, r"^([^?]*)", 1), F.lit("/"))
    query = F.regexp_extract(rest, r"^[^?]*(\?.+)$", 1)
    return F.concat(F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1)), F.lit("://"), host(u), path, query)


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def raw_host(raw: Column) -> Column:
    """The host as it was read, case and odd characters kept."""
    return F.regexp_extract(F.regexp_replace(raw, "(?i)^https?://", ""), r"^([^/?#:]*)", 1)


def links(text: Column) -> Column:
    """Links of one line or text in order, without those that are mail addresses."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINK), F.lit(0))
    return F.filter(found, lambda u: ~F.contains(F.regexp_extract(F.regexp_replace(u, "^.*//", ""), r"^([^/]*)", 1), F.lit("@")))


# ---- codes ----
def qr_type(payload: Column, is_payment: Column) -> Column:
    """What a decoded code is; the order decides. is_payment: whether it parses as a merchant's code."""
    p = F.lower(F.trim(payload))
    out = F.when(p.rlike("^https?://"), "url").when(p.startswith("wifi:"), "wifi").when(is_payment, "payment").when(p.rlike("^(begin:vcard|mecard:)"), "contact")
    for scheme in ("mailto", "tel", "smsto", "geo"):
        out = out.when(p.startswith(scheme + ":"), scheme)
    return out.otherwise("text")


def qr_stored(payload: Column) -> Column:
    """What is kept of a code: a network's password is not."""
    p = F.trim(payload)
    return F.when(F.lower(p).startswith("wifi:"), F.regexp_replace(p, r"(?i)(P:)((?:\\.|[^;])*)", "$1<redacted>")).otherwise(p)


# ---- program text ----
_GLYPHS = (("→", "->"), ("⇒", "=>"), ("≠", "!="), ("≤", "<="), ("≥", ">="), ("≡", "==="), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("—", "--"), ("…", "..."), (" ", " "))
# Words that keep the space before a bracket.
_KEEP_SPACE = "if for while switch return and or not in catch with elif typeof await yield function await sizeof case else do of match select from join on where values".split()


def code_line(line: Column) -> Column:
    """A line of program text in plain characters, calls without a space before the bracket."""
    out = F.regexp_replace(F.regexp_replace(line, "-?→>?", "->"), "=?⇒>?", "=>")
    for glyph, plain in _GLYPHS:
        out = F.replace(out, F.lit(glyph), F.lit(plain))
    return F.regexp_replace(out, r"(?U)\b(?!(?:" + "|".join(_KEEP_SPACE) + r")\b)([A-Za-z_]\w*) \((?=[\w)\"'\[{*&-]|$)", "$1(")
