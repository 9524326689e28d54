"""Every query with a SQL twin against DuckDB on the smallest tables."""

import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from inkfathom.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_sql_gives(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    own = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    other = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in cur.fetchall())
    assert own == other


# ---- queries without a twin, against plain Python ----
def documents(duck, table="documents", columns="doc_id, text"):
    return duck.execute(f"SELECT {columns} FROM {table}").fetchall()


def test_redacted_and_scrubbed_documents(spark, duck):
    """Nothing that a pattern takes out is left, nothing else is changed, and once more changes nothing."""
    from pyspark.sql import functions as F

    from inkfathom.functions import redaction

    texts = {i: t or "" for i, t in documents(duck)}
    got = {r.doc_id: r for r in QUERIES["redacted_documents"](spark, str(DATA)).collect()}
    mail = re.compile(redaction.EMAIL.removeprefix("(?U)"))
    assert got.keys() == texts.keys() and sum(r.redactions > 0 for r in got.values()) > 3
    for i, t in texts.items():
        assert not mail.search(got[i].clean) and (got[i].clean == t) == (got[i].redactions == 0) and got[i].clean.count("\n") == t.count("\n")
    shown = {r.id: r for r in QUERIES["shown_hits"](spark, str(DATA)).collect()}
    assert all(shown[i].excerpt == got[i].clean[:200] and shown[i].redactions == got[i].redactions for i in texts)
    clean = {r.doc_id: r for r in QUERIES["scrubbed_documents"](spark, str(DATA)).collect()}
    assert clean.keys() == texts.keys()
    for i, t in texts.items():
        assert (clean[i].clean == t) == (not clean[i].kinds) and ("[SECRET:" in clean[i].clean) == (bool(clean[i].kinds) or "[SECRET:" in t)
    once = spark.createDataFrame([(i, r.clean) for i, r in clean.items()], "doc_id long, text string")
    again, kinds = redaction.scrub(F.col("text"))
    assert all(r.a == r.text and not r.k for r in once.select("text", again.alias("a"), kinds.alias("k")).collect())


def test_key_terms_of_documents(spark, duck):
    """Counted in Python from the redacted texts: no term loses an occurrence to redaction, and the best five are as weighted."""
    from inkfathom.functions.wordlists import GIVEN_NAMES, STOP_WORDS

    def words(t):
        found = [w.strip("'-") for w in re.findall(r"[a-z][a-z'-]{3,}", (t or "").lower())]
        return Counter(w for w in found if w not in STOP_WORDS)

    texts = dict(documents(duck))
    clean = {r.doc_id: r.clean for r in QUERIES["redacted_documents"](spark, str(DATA)).collect()}
    lost = {g.lower() for g in GIVEN_NAMES} | {w for i, t in texts.items() for w, n in words(t).items() if n > words(clean[i])[w]}
    tf = {i: {w: n for w, n in words(t).items() if w not in lost} for i, t in texts.items()}
    df = Counter(w for c in tf.values() for w in c)
    most = max(2.0, 0.25 * len(tf))
    want = {i: sorted((-round(n * math.log(len(tf) / df[w]), 9), w) for w, n in c.items() if 2 <= df[w] <= most)[:5] for i, c in tf.items()}
    got = {r.id: r.terms for r in QUERIES["key_terms_of_documents"](spark, str(DATA)).collect()}
    assert got == {i: [w for _, w in x] for i, x in want.items()} and sum(map(len, got.values())) > 100


def test_links_in_pages(spark, duck):
    from inkfathom.functions.text import LINK, TRAILING

    want = {}
    for i, t in documents(duck, "pages", "page_id, html"):
        raws = [m[0] for m in re.finditer(LINK, t or "") if "@" not in m[0].split("//")[-1].split("/")[0]]
        want[i] = {x for x in raws if x.rstrip(TRAILING)}
    got = {}
    for r in QUERIES["links_in_pages"](spark, str(DATA)).collect():
        got.setdefault(r.id, {})[r.url] = r.raw
    assert sum(map(len, got.values())) >= 50
    for i, found in got.items():  # each by its normal form once, in the text, and none is missed
        assert set(found.values()) <= want[i] and all(u.startswith("http") and u == u.rstrip("/") for u in found)
        hosts = {re.sub(r"^[a-z]+://", "", u).split("/")[0].split("?")[0] for u in found}
        assert hosts == {re.sub(r":\d*$", "", re.sub(r"(?i)^https?://", "", x).split("/")[0].split("?")[0].split("#")[0].lower().rstrip(TRAILING)) for x in want[i]} - {""}


def test_minhash_signatures(spark, duck):
    """Equal token sets have equal signatures, and shares of equal values are near the similarity of the sets."""
    from inkfathom.operators import duplicates

    rows = duplicates.with_tokens(spark.read.parquet(f"{DATA}/documents.parquet")).select("doc_id", "tokens").collect()
    sets = {r.doc_id: frozenset(r.tokens) for r in rows}
    got = {r.doc_id: tuple(r.signature) for r in QUERIES["minhash_signatures"](spark, str(DATA)).collect()}
    assert all(len(s) == (64 if sets[i] else 0) for i, s in got.items())
    ids = [i for i in sets if sets[i]]
    wrong = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 : k + 40]:
            real = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            wrong.append(abs(real - sum(x == y for x, y in zip(got[a], got[b])) / 64))
            assert (got[a] == got[b]) or sets[a] != sets[b]
    assert sum(wrong) / len(wrong) < 0.06


def test_rules_links_and_hosts_of_queries(spark, duck):
    texts = dict(documents(duck))
    rules_ = {r.id: r for r in QUERIES["built_in_rules"](spark, str(DATA)).collect()}
    kinds = {"chat", "social", "web", "email", "receipt", "document", "code", "slide", "photo", "game", "system", "screenshot"}
    assert rules_.keys() == texts.keys() and {r.kind for r in rules_.values()} <= kinds and all(r.why for r in rules_.values())
    for i, r in rules_.items():  # what is quoted stands in the text
        for quote in re.findall(r"(?<=')[^']+(?=')", r.why) if r.why.startswith("text '") and r.why.count("'") == 2 else []:
            assert quote.lower() in (texts[i] or "").lower()
    programs = {r.doc_id: r for r in QUERIES["program_texts"](spark, str(DATA)).collect()}
    assert programs.keys() == texts.keys() and all(r.lang is None or r.score >= 5 for r in programs.values())
    cards = {r.doc_id: r for r in QUERIES["result_cards"](spark, str(DATA)).collect()}
    for i, r in cards.items():
        t = " ".join((texts[i] or "").split())
        assert r.headline.strip() in t and r.grounded == (texts[i] is not None and len(" ".join(texts[i][4:34].split())) >= 8) if texts[i] is not None else True
    urls = dict(documents(duck, "pages", "page_id, url"))
    over = QUERIES["links_over_lines"](spark, str(DATA)).collect()
    assert {r.id for r in over} == {i for i, u in urls.items() if u} == {r.id for r in over if r.raw.startswith(urls[r.id][:12])}
    assert any(r.joined == 1 for r in over)
    hosts = QUERIES["misread_hosts"](spark, str(DATA)).collect()
    assert any(r.corrected and r.host == r.raw.replace("1", "l") for r in hosts) and {r.verified_by for r in hosts} <= {"known", "crossref", "allowed", "none"} and all(r.reason for r in hosts if r.corrected)
    groups = QUERIES["stable_group_ids"](spark, str(DATA)).collect()
    assert len({r.root for r in groups}) == len(groups) and len({r.gid for r in groups}) == len(groups)


def test_every_query_is_tested():
    tested = {"redacted_documents", "shown_hits", "scrubbed_documents", "key_terms_of_documents", "links_in_pages", "minhash_signatures", "built_in_rules", "program_texts", "result_cards", "links_over_lines", "misread_hosts", "stable_group_ids", "scroll_sequences"}
    assert set(QUERIES) - set(ORACLES) == tested  # scroll_sequences: test_operators.py


def test_excerpts_not_texts_go_through_the_joins_of_shown_hits(spark):
    """Redaction lies below the join with events."""
    plan = QUERIES["shown_hits"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("regexp_replace(")
