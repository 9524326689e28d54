"""Every operator as a query over the given tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfathom.functions import code_text, payments, redaction
from inkfathom.functions import text as T
from inkfathom.functions.wordlists import STOP_WORDS
from inkfathom.operators import ask, duplicates, key_terms, layout, lifecycle, links, pixels, records, rules, search, sequences, sessions
from inkfathom.sources import files, sinks
from inkfathom.streaming import ingest
from inkfathom.tables import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- items: documents as captures, with what labels say and the time of the event of their number ----
_ITEMS = """items AS (
  SELECT d.doc_id AS id, d.text, d.lang, d.n_chars, CASE WHEN d.source = 'src0' THEN NULL ELSE d.source END AS app, CAST(e.ts AS TIMESTAMP) AS captured_at,
         l.quality, l.toxic, coalesce(l.toxic, 0) = 1 AS has_secrets, CASE WHEN l.quality = 0 THEN 'failed' ELSE 'ok' END AS status
  FROM documents d LEFT JOIN (SELECT event_id, min(ts) AS ts FROM events GROUP BY 1) e ON e.event_id = d.doc_id LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id
)"""


def items(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None, *shown: str) -> DataFrame:
    """documents: what stands for the table, with columns shown instead of its texts, so that no text goes through the joins."""
    events = read(spark, sf_dir, "events").groupBy("event_id").agg(F.min("ts").alias("captured_at"))
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    documents = read(spark, sf_dir, "documents") if documents is None else documents
    out = documents.join(events, F.col("doc_id") == F.col("event_id"), "left").join(labels, "doc_id", "left")
    return out.select(
        F.col("doc_id").alias("id"), *(shown or ["text"]), "lang", "n_chars", F.when(F.col("source") != "src0", F.col("source")).alias("app"), "captured_at",
        "quality", "toxic", (F.coalesce("toxic", F.lit(0)) == 1).alias("has_secrets"), F.when(F.col("quality") == 0, "failed").otherwise("ok").alias("status"),
    )


# ---- scans and records ----
@query("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS id FROM documents")
def content_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.content_id(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("id"))


@query("SELECT event_id, date_trunc('second', ts) AS captured_at, 'com.app' || user_id AS source_app FROM events")
def file_names(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    name = F.concat(F.lit("Screenshot_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_com_app"), "user_id", F.lit("_Main.png"))
    return e.select("event_id", T.name_parts(name).alias("n")).select("event_id", "n.captured_at", "n.source_app")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def latest_records(spark, sf_dir):
    return records.latest(read(spark, sf_dir, "events").where("user_id is not null"), "user_id", "ts", "event_id").select("user_id", "event_id", "ts")


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status, CAST(1 AS BIGINT) AS added_at FROM orders WHERE o_orderkey % 3 <> 0),
     n AS (SELECT o_orderkey AS id, o_orderpriority AS status, CAST(2 AS BIGINT) AS added_at FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.status, o.status) AS status, coalesce(o.added_at, n.added_at) AS added_at FROM o FULL JOIN n ON o.id = n.id""")
def index_upsert(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(1).cast("long").alias("added_at"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("status"), F.lit(2).cast("long").alias("added_at"))
    return records.upsert(old, new)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status, o_custkey AS cust FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def changed_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    new = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_custkey").alias("cust"))
    old = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))
    return records.changed(old, new, ["status", "cust"])


@query("""
WITH found AS (SELECT sha256(coalesce(text, '')) AS id, doc_id AS path FROM documents), known AS (SELECT sha256(coalesce(text, '')) AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
     blocked AS (SELECT sha256(coalesce(text, '')) AS id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT id, path, CASE WHEN id IN (SELECT id FROM blocked) THEN 'blocked' WHEN id IN (SELECT id FROM known) THEN 'known' WHEN row_number() OVER (PARTITION BY id ORDER BY path) > 1 THEN 'copy' ELSE 'new' END AS action FROM found""")
def ingest_plan(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("id"), F.col("doc_id").alias("path"))
    l = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "path")
    return records.planned(d, d.join(l.where("quality = 1"), "path"), d.join(l.where("toxic = 1"), "path"))


@query("SELECT DISTINCT o_custkey AS group_id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def dissolved_groups(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), "o_orderstatus")
    return records.dissolved(o, o.where("o_orderstatus = 'F'"))


@query("SELECT event_id AS id, event_type AS question, 'm1' AS model FROM events WHERE NOT (event_id % 3 = 0)")
def answer_cache_misses(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("question"), F.lit("m1").alias("model"))
    return records.cache_misses(e, e.where("id % 3 = 0"))


@query("SELECT 'nation' AS journal, true AS intact, count(*) AS rows FROM nation UNION ALL SELECT 'edited', false, 3")
def journal_check(spark, sf_dir):
    n = read(spark, sf_dir, "nation").orderBy("n_nationkey").selectExpr("to_json(struct(n_name, n_nationkey)) as body").collect()  # 25 rows in every size
    good = records.append([r["body"] for r in n], b"key")
    edited = [dict(r, body=r["body"] + " ") if r["seq"] == 3 else r for r in good]
    rows = [dict(r, journal=j) for j, rs in (("nation", good), ("edited", edited)) for r in rs]
    return records.verify(spark.createDataFrame(rows, "seq int, body string, prev_hash string, row_hash string, sig string, journal string"), b"key")


# ---- aggregations ----
@query("SELECT lang, source, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY lang, source")
def facet_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


@query("""SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key UNION ALL SELECT '(none)', count(*) FROM events WHERE props IS NULL OR len(json_keys(props)) = 0""")
def unnested_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.json_object_keys("props").alias("k"))
    return e.select(F.explode("k").alias("key")).groupBy("key").agg(F.count("*").alias("n")).union(e.where(F.size(F.coalesce("k", F.array().cast("array<string>"))) == 0).select(F.lit("(none)"), F.count("*")))


@query("""SELECT event_type, count(*) FILTER (value > 50) AS high, count(*) FILTER (value <= 50) AS low, max(CASE WHEN value > 50 THEN ts END) AS last_high, min(ts) AS first, round(median(value), 6) AS median_value, round(max(value), 6) AS max_value FROM events GROUP BY event_type""")
def conditional_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("event_type")
    high = F.col("value") > 50
    return e.agg(F.count_if(high).alias("high"), F.count_if(F.col("value") <= 50).alias("low"), F.max(F.when(high, F.col("ts"))).alias("last_high"), F.min("ts").alias("first"), F.round(F.median("value"), 6).alias("median_value"), F.round(F.max("value"), 6).alias("max_value"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 8")
def top_apps(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(8)


@query("SELECT conv_id, round_even(sum(length(text) * ((turn + 1) / 10.0)::DOUBLE) / sum(length(text)), 3) AS confidence FROM conversations WHERE text IS NOT NULL GROUP BY conv_id HAVING sum(length(text)) > 0")
def weighted_confidence(spark, sf_dir):
    line = F.struct("text", ((F.col("turn") + 1) / F.lit(10.0)).alias("conf"))
    c = read(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return c.select("conv_id", lifecycle.mean_confidence(F.col("lines")).alias("confidence")).where("confidence is not null")


# ---- windows: sessions, episodes, topics of sessions ----
_CAPTURES = "captures AS (SELECT event_id AS id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'app' || user_id END AS source_app, ts AS captured_at, event_type, value FROM events)"
_SESSIONS = f"""{_CAPTURES}, gaps AS (
  SELECT *, coalesce(source_app, '') AS src, CASE WHEN date_diff('microsecond', lag(captured_at) OVER w, captured_at) <= 1000000 * CASE WHEN source_app IS NULL THEN 86400 ELSE 43200 END THEN 0 ELSE 1 END AS starts
  FROM captures WHERE captured_at IS NOT NULL WINDOW w AS (PARTITION BY coalesce(source_app, '') ORDER BY captured_at, id)
), runs AS (SELECT *, sum(starts) OVER (PARTITION BY src ORDER BY captured_at, id) AS run FROM gaps),
sess AS (
  SELECT id, source_app, captured_at, event_type, value, first_value(id) OVER w AS session, CAST(row_number() OVER w AS INTEGER) AS part, count(*) OVER (PARTITION BY src, run) AS size FROM runs WINDOW w AS (PARTITION BY src, run ORDER BY captured_at, id)
)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("app"), "user_id")).alias("source_app"), F.col("ts").alias("captured_at"), "event_type", "value")


_REFERENCE_GAPS = _SESSIONS.replace("86400", "1800").replace("43200", "600").replace("date_diff('microsecond'", "date_diff('microsecond'")


@query(f"WITH {_REFERENCE_GAPS} SELECT id, session, part, size FROM sess WHERE size >= 2")
def capture_sessions(spark, sf_dir):
    return sessions.sessions(captures(spark, sf_dir)).select("id", "session", "part", "size")


@query(f"""WITH {_REFERENCE_GAPS}, ep AS (SELECT *, 'ep-' || session AS episode FROM sess WHERE size >= CASE WHEN source_app IS NULL THEN 3 ELSE 5 END),
kinds AS (SELECT episode, event_type, count(*) AS n, min(part) AS first_part FROM ep GROUP BY ALL)
SELECT episode, count(*) AS size, min(captured_at) AS first, max(captured_at) AS last, (SELECT arg_max(event_type, (n, -first_part)) FROM kinds k WHERE k.episode = ep.episode) AS modal_kind FROM ep GROUP BY episode""")
def episodes(spark, sf_dir):
    return sessions.episode_summary(sessions.episodes(sessions.sessions(captures(spark, sf_dir))), "event_type")


@query(f"""WITH {_REFERENCE_GAPS}, m AS (SELECT id, session, CASE WHEN value > 60 THEN [event_type] ELSE CAST([] AS VARCHAR[]) END AS topics, CASE WHEN value > 95 THEN ['pinned'] ELSE CAST([] AS VARCHAR[]) END AS added FROM sess WHERE size >= 2),
having_ AS (SELECT session, count(*) AS m FROM m WHERE len(topics) > 0 GROUP BY session),
agreed AS (SELECT session, list(topic ORDER BY topic) AS topics FROM (SELECT session, topic, count(*) AS n FROM (SELECT session, unnest(topics) AS topic FROM m) GROUP BY ALL) JOIN having_ USING (session) WHERE m >= 3 AND n / m >= 0.6 GROUP BY session),
seeded AS (SELECT session, list(DISTINCT topic) AS topics FROM (SELECT session, unnest(added) AS topic FROM m) GROUP BY session)
SELECT id, array_to_string(coalesce(s.topics, a.topics), ',') AS topics FROM m LEFT JOIN seeded s USING (session) LEFT JOIN agreed a USING (session) WHERE len(m.topics) = 0 AND coalesce(s.topics, a.topics) IS NOT NULL""")
def session_topics(spark, sf_dir):
    none = F.array().cast("array<string>")
    s = sessions.sessions(captures(spark, sf_dir)).select("id", "session", F.when(F.col("value") > 60, F.array("event_type")).otherwise(none).alias("topics"), F.when(F.col("value") > 95, F.array(F.lit("pinned"))).otherwise(none).alias("added"), none.alias("removed"))
    return sessions.inherited_topics(s).select("id", F.array_join("topics", ",").alias("topics"))


# ---- key terms ----
_WORDS = "SELECT doc_id AS id, trim(w, '''-') AS term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''-]{3,}')) AS w FROM documents)"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


@query(f"""WITH tf AS (SELECT id, term, count(*) AS tf FROM ({_WORDS}) WHERE term NOT IN ({_STOP}) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= greatest(2.0, 0.25 * (SELECT n FROM n))),
scored AS (SELECT id, term, tf, df, round(tf * ln(n / df), 9) AS weight FROM tf JOIN df USING (term), n)
SELECT * FROM (SELECT id, term, tf, df, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM scored) WHERE rank <= 5""")
def key_terms_without_redaction(spark, sf_dir):
    return key_terms.scored_terms(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).withColumn("weight", F.round("weight", 6))


@query()
def key_terms_of_documents(spark, sf_dir):
    return key_terms.key_terms(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


# ---- similarity ----
_TOKENS = """list_distinct(list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9]{2,}'), list_transform(regexp_extract_all(coalesce(text, ''), '\\b\\d[\\d.,:%/]*\\d\\b|\\b\\d\\b'), lambda x: '#' || x)))"""


@query(f"""WITH b AS (SELECT item_id, unnest({_TOKENS}) AS t FROM benchmark), d AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents),
nb AS (SELECT item_id, count(*) AS nb FROM b GROUP BY 1), nd AS (SELECT doc_id, count(*) AS nd FROM d GROUP BY 1),
i AS (SELECT item_id, doc_id, count(*) AS n_both FROM b JOIN d USING (t) GROUP BY ALL)
SELECT item_id, doc_id, n_both, CASE WHEN n_both / (nb + nd - n_both) >= 0.8 THEN 'text' WHEN n_both / least(nb, nd) >= 0.85 THEN 'contained' END AS why
FROM i JOIN nb USING (item_id) JOIN nd USING (doc_id) WHERE nb >= 10 AND nd >= 10 AND (n_both / (nb + nd - n_both) >= 0.8 OR n_both / least(nb, nd) >= 0.85)""")
def benchmark_containment(spark, sf_dir):
    own = lambda name, key: duplicates.with_tokens(read(spark, sf_dir, name)).select(F.col(key).alias("id"), "tokens")
    d, b = own("documents", "doc_id"), own("benchmark", "item_id")
    both = duplicates.contained_candidates(d, b)
    return both.select(F.col("y").alias("item_id"), F.col("x").alias("doc_id"), F.col("both").alias("n_both"), duplicates.decide(F.col("both"), F.col("n_y"), F.col("n_x"), F.lit(64)).alias("why")).where("why is not null")


@query(f"""WITH RECURSIVE {_ITEMS}, s AS (SELECT id, captured_at, round(least(coalesce(n_chars, 0) / 300, 4.0) + 2 * coalesce(quality, 0), 3) AS score, {_TOKENS} AS t FROM items),
g AS (SELECT id, len(t) AS n, unnest(t) AS t FROM s WHERE len(t) >= 10), p AS (SELECT a.id AS a, b.id AS b, count(*) AS n_both, min(a.n) AS na, min(b.n) AS nb FROM g a JOIN g b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id),
l AS (SELECT a, b FROM p WHERE n_both / (na + nb - n_both) >= 0.8 OR n_both / least(na, nb) >= 0.85), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), m AS (SELECT a AS id, min(b) AS root FROM r GROUP BY a)
SELECT id, root, CAST(row_number() OVER (PARTITION BY root ORDER BY score DESC, captured_at DESC NULLS LAST, id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY root) AS size FROM m JOIN s USING (id)""")
def duplicate_groups(spark, sf_dir):
    rows = duplicates.with_tokens(items(spark, sf_dir).withColumn("dhash", F.lit(None).cast("string")))
    rows = rows.withColumn("score", duplicates.score(F.lit(0), F.lit(0), F.col("n_chars"), F.col("quality"), F.lit(None)))
    return duplicates.groups(rows, duplicates.links(rows, duplicates.exact_candidates(rows)))


@query()
def minhash_signatures(spark, sf_dir):
    return duplicates.with_tokens(read(spark, sf_dir, "documents")).select("doc_id", duplicates.minhash(F.col("tokens")).alias("signature"))


@query(f"""WITH {_ITEMS}, g AS (SELECT text, min(id) AS root, count(*) AS size FROM items GROUP BY text HAVING count(*) > 1 AND text IS NOT NULL),
s AS (SELECT id, root, size, captured_at, round(least(coalesce(n_chars, 0) / 300, 4.0) + 2 * coalesce(quality, 0), 3) AS score FROM items JOIN g USING (text))
SELECT id, root, size, CAST(row_number() OVER (PARTITION BY root ORDER BY score DESC, captured_at DESC NULLS LAST, id) AS INTEGER) AS rank FROM s""")
def copies_ranked(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("score", duplicates.score(F.lit(0), F.lit(0), F.col("n_chars"), F.col("quality"), F.lit(None)))
    return duplicates.groups(rows, duplicates.code_links(rows.where("text is not null").select("id", F.col("text").alias("payload"))))


@query("""WITH h AS (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(32 - i AS BIGINT) ELSE 0 END)) AS h FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(CAST(a.h AS BIGINT), CAST(b.h AS BIGINT))) AS INTEGER) AS bits FROM h a JOIN h b ON b.vec_id = a.vec_id + 1""")
def hash_distance(spark, sf_dir):
    bits = F.array_join(F.transform(F.slice("embedding", 1, 32), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    h = read(spark, sf_dir, "embeddings").select("vec_id", F.lpad(F.conv(bits, 2, 16), 16, "0").alias("h"))
    nxt = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("h").alias("g"))
    return h.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), "b", duplicates.hamming(F.col("h"), F.col("g")).alias("bits"))


@query()
def stable_group_ids(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("sha256:"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("root"), F.concat(F.lit("grp-"), F.col("o_orderkey") % 50).alias("old"))
    return duplicates.stable_ids(o.select("root").distinct(), o.where("old <> 'grp-0'").groupBy("root", "old").agg(F.count("*").alias("n")), "grp-")


# ---- rules ----
_RULES = [rules.Rule.of(r) for r in ({"name": "listing", "text": [r"\|"], "apps": ["src1"]}, {"name": "data", "mode": "all", "text": ["@", r"[0-9]{4}"], "text_min": 1, "also": ["the"]}, {"name": "shout", "text": ["!!", r"\$\$"], "text_min": 1})]


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return items(spark, sf_dir).withColumns({"text": F.coalesce("text", F.lit("")), "qr_types": none, "domains": none, "lang": F.lit(None).cast("string")}).transform(rules.prepared)


_LISTING, _DATA, _SHOUT = "(contains(t, '|') OR coalesce(starts_with(app, 'src1'), false))", "((contains(t, '@') OR regexp_matches(t, '[0-9]{4}')) AND regexp_matches(t, '(?i)the'))", "(contains(t, '!!') OR contains(t, '$$'))"


@query(f"WITH {_ITEMS}, r AS (SELECT *, coalesce(text, '') AS t FROM items) SELECT id, CASE WHEN {_LISTING} THEN 'listing' WHEN {_DATA} THEN 'data' WHEN {_SHOUT} THEN 'shout' ELSE 'screenshot' END AS kind FROM r")
def rule_kinds(spark, sf_dir):
    return _ruled(spark, sf_dir).select("id", F.coalesce(rules.classify(_RULES)["kind"], F.lit("screenshot")).alias("kind"))


@query(f"WITH {_ITEMS}, r AS (SELECT *, coalesce(text, '') AS t FROM items) SELECT topic, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN {_LISTING} THEN 'listing' END, CASE WHEN {_DATA} THEN 'data' END, CASE WHEN {_SHOUT} THEN 'shout' END], lambda x: x IS NOT NULL)) AS topic FROM r) GROUP BY topic")
def rule_topics(spark, sf_dir):
    return _ruled(spark, sf_dir).select(F.explode(F.map_keys(rules.topics(_RULES))).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@query()
def built_in_rules(spark, sf_dir):
    kinds, topics = rules.load()
    rows = _ruled(spark, sf_dir)
    rows = rows.withColumn("lang", code_text.language(F.col("text"))["lang"])
    rows = rows.withColumns({"first": rules.classify(kinds), "found": rules.topics(topics)})
    first, found = F.col("first"), F.col("found")
    pixels = {"text_coverage": F.lit(None).cast("double"), "text_chars": F.col("n_chars"), "grays": F.lit(0), "edges": F.lit(0.0), "n_qr": F.lit(0)}
    kind = rules.kind(first, pixels, rules.is_camera(F.col("app"), F.lit("")), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return rows.select("id", kind.alias("k"), found.alias("topics")).select("id", "k.kind", "k.why", F.array_join(F.array_sort(F.map_keys("topics")), ",").alias("topics"))


_GIVEN = [rules.Rule.of({"name": "even", "domains": ["d3.com", "d4.com"], "apps": ["app7"]})]


@query("""WITH e AS (SELECT 'd' || (user_id % 40) || '.com' AS value, CASE WHEN user_id % 40 < 20 THEN 'even' ELSE event_type END AS topic FROM events WHERE value > 40),
a AS (SELECT 'app' || (user_id % 30) AS value, CASE WHEN user_id % 40 < 20 THEN 'even' ELSE event_type END AS topic FROM events WHERE value > 40),
t AS (SELECT 'app' || (user_id % 30) AS value, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT 'domain' AS kind, value, min(topic) AS topic, count(*) AS tags FROM e GROUP BY value HAVING count(*) >= 3 AND count(DISTINCT topic) = 1
UNION ALL SELECT 'app', a.value, min(topic), count(*) FROM a JOIN t ON t.value = a.value GROUP BY a.value HAVING count(*) >= 5 AND count(DISTINCT topic) = 1 AND count(*) / max(n) >= 0.6)
SELECT * FROM s WHERE NOT (topic = 'even' AND (kind = 'domain' AND value IN ('d3.com', 'd4.com') OR kind = 'app' AND starts_with(value, 'app7')))""")
def rule_suggestions(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumns({"app": F.concat(F.lit("app"), F.col("user_id") % 30), "domains": F.array(F.concat(F.lit("d"), F.col("user_id") % 40, F.lit(".com"))), "topic": F.when(F.col("user_id") % 40 < 20, "even").otherwise(F.col("event_type"))})
    return rules.suggestions(e.where("value > 40").select("domains", "app", "topic"), e.groupBy("app").agg(F.count("*").alias("n")), rules=_GIVEN)


# ---- links ----
_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '')"


@query(f"""WITH p AS (SELECT page_id, url, {_HOST} AS host, regexp_replace(regexp_replace(rtrim(url, '.,;:!?)]}}>''"’”…'), '#.*$', ''), '^[A-Za-z]+://[^/?#]*', '') AS rest FROM pages WHERE regexp_matches(url, '^https?://'))
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || host || rtrim(regexp_extract(rest, '^([^?]*)', 1), '/') || regexp_extract(rest, '^[^?]*(\\?.+)$', 1) AS link, regexp_replace(host, '^www\\.', '') AS domain FROM p""")
def link_forms(spark, sf_dir):
    p = read(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://"))
    return p.select("page_id", T.normal_link(F.col("url")).alias("link")).withColumn("domain", T.domain(F.col("link")))


@query()
def links_in_pages(spark, sf_dir):
    return links.found_in_text(read(spark, sf_dir, "pages"), "page_id", "html")


@query()
def links_over_lines(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.posexplode(F.array(F.concat(F.lit("see "), F.substring("url", 1, 20)), F.substring("url", 21, 1 << 30), F.lit("end"))).alias("line_no", "text"))
    none = F.lit(None).cast("double")
    return links.found_in_lines(p.select("id", "line_no", "text", F.lit(0.9).alias("conf"), none.alias("x"), none.alias("y"), none.alias("w"), none.alias("h")))


_SUFFIXES = [("com", "rule"), ("net", "rule"), ("org", "rule"), ("example.org", "rule"), ("example.net", "wild"), ("m.example.net", "exception"), ("my", "rule"), ("com.my", "rule")]
_SUFFIX_SQL = "(VALUES " + ", ".join(f"('{r}', '{k}')" for r, k in _SUFFIXES) + ") AS s(rule, kind)"


@query(f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages WHERE regexp_matches(url, '^https?://')), l AS (SELECT host, string_split(host, '.') AS labels FROM h), s AS (SELECT * FROM {_SUFFIX_SQL}),
t AS (SELECT host, labels, unnest(range(1, len(labels) + 1)) AS i FROM l), own AS (SELECT host, labels, len(labels) - i + 1 AS size, array_to_string(labels[i:], '.') AS own, CASE WHEN i < len(labels) THEN array_to_string(labels[i + 1:], '.') END AS above FROM t),
m AS (SELECT host, labels, max(CASE WHEN own IN (SELECT rule FROM s WHERE kind = 'exception') THEN size - 1 END) AS e, max(CASE WHEN own IN (SELECT rule FROM s WHERE kind = 'rule') OR above IN (SELECT rule FROM s WHERE kind = 'wild') THEN size END) AS r FROM own GROUP BY ALL)
SELECT host, CASE WHEN len(labels) > coalesce(e, r, 1) THEN array_to_string(labels[len(labels) - coalesce(e, r, 1):], '.') END AS registrable FROM m""")
def registrable_domains(spark, sf_dir):
    hosts = read(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://")).select(T.host(F.col("url")).alias("host"))
    return links.registrable(hosts, spark.createDataFrame(_SUFFIXES, "rule string, kind string"))


@query(f"""WITH p AS (SELECT page_id, url, {_HOST} AS host FROM pages WHERE regexp_matches(url, '^https?://')), r AS (SELECT page_id, url, array_to_string(string_split(host, '.')[-2:], '.') AS domain, CASE WHEN page_id % 7 = 0 THEN 'held' ELSE 'present' END AS state FROM p)
SELECT domain, count(*) AS urls, count(DISTINCT page_id) AS notes, count(DISTINCT CASE WHEN state = 'held' THEN page_id END) AS held, array_to_string((list(url ORDER BY page_id))[:3], ' ') AS examples FROM r GROUP BY domain""")
def domain_suggestions(spark, sf_dir):
    p = read(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://"))
    parts = F.split(T.host(F.col("url")), r"\.")
    rows = p.select(F.col("page_id").alias("id"), F.lit(0).alias("seq"), F.col("url").alias("raw"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".").alias("registrable"), F.lit("none").alias("verified_by"), F.lit(None).cast("string").alias("flag"), F.when(F.col("page_id") % 7 == 0, "held").otherwise("present").alias("state"))
    return links.suggested(rows).withColumn("examples", F.array_join("examples", " "))


@query(f"""WITH p AS (SELECT page_id AS id, regexp_replace({_HOST}, '^www\\.', '') AS domain FROM pages WHERE regexp_matches(url, '^https?://')) SELECT id, domain, domain IN (SELECT domain FROM p WHERE id % 10 = 0) AS crossref FROM p""")
def cross_references(spark, sf_dir):
    p = read(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://")).select(F.col("page_id").alias("id"), "url")
    return links.cross_referenced(p, p.where("id % 10 = 0").select(T.domain(F.col("url")).alias("domain"))).select("id", "domain", "crossref")


@query()
def misread_hosts(spark, sf_dir):
    p = read(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://")).select(T.host(F.col("url")).alias("h")).distinct()
    raw = p.select(F.regexp_replace("h", "l", "1").alias("raw"))
    suffixes = spark.createDataFrame(_SUFFIXES, "rule string, kind string")
    ranks = links.registrable(p.select(F.col("h").alias("host")), suffixes).where("registrable is not null").select(F.col("registrable").alias("domain")).distinct().withColumn("rank", F.pmod(F.xxhash64("domain"), F.lit(900_000)).cast("int"))
    list_of = lambda rows, s: spark.createDataFrame(rows, s)
    return links.resolve(raw, ranks, suffixes, list_of([("com",), ("net",), ("org",)], "tld string"), list_of([("nothing.com",)], "domain string"), list_of([], "domain string"))


def _merchant(city: str, amount: str) -> str:
    fields = "".join(f"{t}{len(v):02d}{v}" for t, v in (("00", "01"), ("54", amount), ("59", "Kedai Satu"), ("60", city))) + "6304"
    return fields + f"{payments.checksum(fields.encode()):04X}"


_PAID = _merchant("Kuala Lumpur", "12.50")
_PAYLOADS = f"""p AS (SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'WIFI:S:x;P:secret' || c_custkey || ';;' WHEN 1 THEN 'tel:' || c_mktsegment WHEN 2 THEN ' HTTPS://a.com/' || c_custkey WHEN 3 THEN 'BEGIN:VCARD' WHEN 4 THEN 'geo:3.1,101.6' WHEN 5 THEN '{_PAID}' WHEN 6 THEN '{_PAID[:-1]}~' ELSE c_name END AS payload FROM customer)"""
_TYPES = "CASE id % 8 WHEN 0 THEN 'wifi' WHEN 1 THEN 'tel' WHEN 2 THEN 'url' WHEN 3 THEN 'contact' WHEN 4 THEN 'geo' WHEN 5 THEN 'payment' ELSE 'text' END"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    payload = F.when(k % 8 == 0, F.concat(F.lit("WIFI:S:x;P:secret"), k, F.lit(";;"))).when(k % 8 == 1, F.concat(F.lit("tel:"), "c_mktsegment")).when(k % 8 == 2, F.concat(F.lit(" HTTPS://a.com/"), k)).when(k % 8 == 3, "BEGIN:VCARD").when(k % 8 == 4, "geo:3.1,101.6")
    payload = payload.when(k % 8 == 5, _PAID).when(k % 8 == 6, _PAID[:-1] + "~").otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").select(k.alias("id"), payload.alias("payload")).withColumn("pay", payments.payment(F.col("payload"))).withColumn("type", T.qr_type(F.col("payload"), F.col("pay.valid")))


@query(f"WITH {_PAYLOADS} SELECT id, {_TYPES} AS type, CASE WHEN id % 8 = 0 THEN 'WIFI:S:x;P:<redacted>;;' ELSE trim(payload) END AS stored FROM p")
def code_types(spark, sf_dir):
    return _payloads(spark, sf_dir).select("id", "type", T.qr_stored(F.col("payload")).alias("stored"))


@query(f"WITH {_PAYLOADS} SELECT id, CASE id % 8 WHEN 5 THEN '[PAYMENT QR]' WHEN 1 THEN 'clean' WHEN 3 THEN 'clean' ELSE payload END AS payload, CASE WHEN id % 8 = 5 THEN '[NAME]' END AS merchant_name, CASE WHEN id % 8 = 5 THEN 'Kuala Lumpur' END AS merchant_city, CASE WHEN id % 8 = 5 THEN '12.50' END AS amount FROM p")
def shown_codes(spark, sf_dir):
    return _payloads(spark, sf_dir).select("id", redaction.redact_code(F.col("type"), F.col("payload"), F.lit("clean"), F.col("pay")).alias("c")).select("id", "c.*")


# ---- redaction and code ----
@query()
def redacted_documents(spark, sf_dir):
    return redaction.redact(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "clean", "redactions")


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\w.+-]+@[\\w-]+\\.[\\w.]+')) AS emails FROM documents")
def redacted_emails(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(redaction.EMAIL.removeprefix("(?U)"))).cast("long").alias("emails"))


@query()
def scrubbed_documents(spark, sf_dir):
    text, kinds = redaction.scrub(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("clean"), kinds.alias("kinds"))


@query()
def program_texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("code", code_text.language(F.col("text")))
    return d.select("doc_id", "code.lang", "code.score", F.array_join(code_text.imports(F.col("text"), F.col("code.lang")), ",").alias("imports"))


@query("""WITH c AS (SELECT conv_id AS id, turn % 3 AS step, turn, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', ' ', 'g')) AS t FROM conversations),
r AS (SELECT *, min(step) OVER (PARTITION BY id) AS least, max(length(t)) OVER (PARTITION BY id) AS most FROM c WHERE t <> '')
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY turn, t) - 1 AS INTEGER) AS line_no, CASE WHEN most >= 4 THEN repeat(' ', CAST(4 * (step - least) AS INTEGER)) ELSE '' END || t AS text FROM r""")
def program_layout(spark, sf_dir):
    """Each turn's text, in plain characters, as a line on a screen, indented by up to two units of four characters."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", " "))
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", plain.alias("text"))
    c = c.withColumn("line_no", F.row_number().over(Window.partitionBy("id").orderBy("turn", "text")))
    x = (F.col("turn") % 3) * 0.04 + 0.1
    return layout.program_lines(c.select("id", "line_no", "text", x.cast("double").alias("x"), (F.col("line_no") * 0.02).cast("double").alias("y"), (F.length("text") * 0.01).cast("double").alias("w"), F.lit(0.015).alias("h")))


# ---- lifecycle ----
@query(f"""WITH {_ITEMS}, d AS (SELECT id, CASE WHEN id % 11 = 0 AND NOT has_secrets THEN 'attach' WHEN status <> 'ok' THEN 'hold' WHEN has_secrets THEN 'quarantine' WHEN n_chars < 300 AND id % 3 = 0 THEN 'attach' WHEN (id % 20 >= 14 OR id % 10 >= 8) AND id % 7 <= 3 THEN 'attach' ELSE 'quarantine' END AS outcome,
CASE WHEN id % 11 = 0 AND NOT has_secrets THEN 'kept on request' WHEN status <> 'ok' THEN 'low_confidence' WHEN has_secrets THEN 'contains secrets' WHEN n_chars < 300 AND id % 3 = 0 THEN 'visual' WHEN (id % 20 >= 14 OR id % 10 >= 8) AND id % 7 <= 3 THEN 'diagram' ELSE 'content captured in the note' END AS cause FROM items)
SELECT outcome, cause, count(*) AS n FROM d GROUP BY ALL""")
def lifecycle_audit(spark, sf_dir):
    third = F.col("id") % 3 == 0
    r = {"keep": F.col("id") % 11 == 0, "has_secrets": F.col("has_secrets"), "status": F.col("status"), "status_reason": F.lit("low_confidence"), "confirmed_by": F.lit(None).cast("string"), "unverified": F.array().cast("array<string>"), "text_coverage": F.when(third, 0.05), "text_chars": F.col("n_chars"), "grays": F.lit(200), "edges": F.lit(0.1), "n_qr": F.lit(0), "kind": F.lit("web"), "hlines": F.col("id") % 20, "vlines": F.col("id") % 10, "saturation": (F.col("id") % 7) / F.lit(10.0)}
    return lifecycle.audit(items(spark, sf_dir).select("id", lifecycle.decision(r).alias("d")).select("id", "d.*"))


@query("""WITH q AS (SELECT event_id AS id, CAST(date_diff('second', TIMESTAMP '2024-01-20 00:00:00', date_trunc('second', ts) + INTERVAL 604800 SECOND) AS BIGINT) AS s FROM events WHERE ts IS NOT NULL)
SELECT id, s AS seconds_left, s <= 0 AS due, CASE WHEN s <= 0 THEN 'due now' ELSE (s // 86400) || 'd ' || lpad(CAST(s % 86400 // 3600 AS VARCHAR), 2, '0') || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS countdown FROM q""")
def purge_queue(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("ts is not null").select(F.col("event_id").alias("id"), lifecycle.purge_after(F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("purge_after"))
    return lifecycle.purge_queue(e, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).withColumn("countdown", T.countdown(F.col("seconds_left")))


# ---- search ----
_TERMS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


@query(f"""WITH d AS (SELECT doc_id AS id, {_TERMS} AS t FROM documents), c AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
h AS (SELECT id, len(t) AS len, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'tion')) AS b FROM d),
f AS (SELECT count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM h)
SELECT id, round(-(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / mean)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h, c, f WHERE a > 0 AND b > 0""")
def text_search(spark, sf_dir):
    return search.search(read(spark, sf_dir, "documents"), "tion the", "doc_id").withColumn("score", F.round("score", 6))


@query(f"SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def postings(spark, sf_dir):
    return search.postings(read(spark, sf_dir, "documents"), "doc_id").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("n"))


@query(f"WITH {_ITEMS} SELECT id FROM items WHERE lang = 'en' AND app LIKE 'src1%' AND strftime(captured_at, '%Y-%m-%d') >= '2024-01-02' AND strftime(captured_at, '%Y-%m-%d') <= '2024-03-01' AND status = 'ok'")
def filtered_list(spark, sf_dir):
    rows = items(spark, sf_dir).withColumns({"kind": F.col("lang"), "state": F.col("status")})
    return search.filtered(rows, kind="en", app="SRC1", since="2024-01-02", until="2024-03-01", state="ok").select("id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE coalesce(text, '') <> '')
SELECT doc_id, CAST(count(*) FILTER (trim(line) <> '' AND NOT regexp_matches(trim(line), '^[\\d:.%/\\s-]+(am|pm)?$|^\\d{1,2}:\\d{2}') AND regexp_matches(line, '[A-Za-z]{2}')) AS INTEGER) AS lines, CAST(count(*) FILTER (NOT (trim(line) <> '' AND NOT regexp_matches(trim(line), '^[\\d:.%/\\s-]+(am|pm)?$|^\\d{1,2}:\\d{2}') AND regexp_matches(line, '[A-Za-z]{2}'))) AS INTEGER) AS hidden FROM l GROUP BY doc_id""")
def content_of_cards(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("coalesce(text, '') <> ''").select("doc_id", search.content_only(F.col("text"), F.lit(0), F.lit(0)).alias("c"))
    return d.select("doc_id", F.size("c.lines").alias("lines"), "c.hidden")


@query()
def result_cards(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    head = search.headline(F.col("text"), F.lit(0), F.lit(0), ["heating"], F.array().cast("array<string>"))
    return d.select("doc_id", head.alias("headline"), search.snippet(F.col("text"), ["heating"]).alias("snippet"), search.grounded(F.col("text"), F.substring("text", 5, 30)).alias("grounded"))


@query("SELECT event_id AS id, value FROM events WHERE value >= 90 AND event_type = 'click' ORDER BY value DESC, id LIMIT 10")
def ask_ranking(spark, sf_dir):
    return read(spark, sf_dir, "events").where("value >= 90 and event_type = 'click'").select(F.col("event_id").alias("id"), "value").orderBy(F.desc("value"), "id").limit(10)


def _longer_is_better():
    return lambda states, q: [{"score": float(len(x))} for x in states]


@query("""SELECT doc_id AS id, CAST(length('app: ' || source || chr(10) || 'category (rules): ' || lang || chr(10) || 'qr: none' || chr(10) || 'domains: none' || chr(10) || 'terms: none' || chr(10) || '---' || chr(10) || substr(coalesce(text, ''), 1, 600)) AS DOUBLE) AS value FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL ORDER BY value DESC, id LIMIT 10""")
def asked_of_a_model(spark, sf_dir):
    none = F.array().cast("array<string>")
    notes = read(spark, sf_dir, "documents").where("source is not null and lang is not null").select(F.col("doc_id").alias("id"), ask.state_text(F.col("source"), F.col("lang"), none, none, none, F.col("text")).alias("state"))
    return ask.ranked(ask.answers(notes, {"type": "score", "instructions": "how long", "criteria": ["length"]}, _longer_is_better, "length")).select("id", "value")


@query("""SELECT conv_id, round(round(sum(CASE WHEN (turn + 1) / 20.0 BETWEEN 0.045 AND 0.96 THEN 0.5 * length(text) / 10000.0 ELSE 0 END) / 0.915, 4), 2) AS coverage, CAST(count(*) FILTER ((turn + 1) / 20.0 > 0.96) AS INTEGER) AS bottom FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def covered_by_text(spark, sf_dir):
    box = F.struct(F.lit(0.1).alias("x"), ((F.col("turn") + 1) / 20.0).cast("double").alias("y"), F.lit(0.5).alias("w"), (F.length("text") / 10000).alias("h"))
    c = read(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.collect_list(F.struct("text", F.lit(0.9).alias("conf"), box.alias("box"))).alias("lines"))
    return c.select("conv_id", F.round(pixels.text_coverage(F.col("lines")), 2).alias("coverage"), pixels.bar_lines(F.col("lines"))["bottom"].alias("bottom"))


# ---- records, boards, notes ----
@query(f"WITH {_ITEMS} SELECT i.id, i.lang, d.text FROM items i LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 4 <> 0) d ON d.doc_id = i.id")
def index_load(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), "text")
    return records.with_texts(items(spark, sf_dir).select("id", "lang"), texts)


@query("SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events WHERE CAST(props->>'k' AS INTEGER) > 50")
def record_scan(spark, sf_dir):
    return records.parsed(read(spark, sf_dir, "events").select("event_id", "props"), "props", "k int").where("k > 50")


@query(f"WITH {_ITEMS} SELECT id, captured_at FROM items ORDER BY captured_at DESC NULLS LAST, id LIMIT 300")
def newest_items(spark, sf_dir):
    return search.newest(items(spark, sf_dir), 300).select("id", "captured_at")


@query(f"WITH {_ITEMS} SELECT id FROM items WHERE lang = 'de' AND status = 'ok' ORDER BY captured_at DESC NULLS LAST, id LIMIT 200")
def results_board(spark, sf_dir):
    rows = items(spark, sf_dir).withColumns({"kind": F.lit("web"), "topics": F.array("lang"), "state": F.col("status")})
    return search.board(rows, category="topic/de", state="ok").select("id")


@query(f"""WITH {_ITEMS}, f AS (SELECT id, id % 3 AS g, CASE WHEN lang = 'en' THEN 'x.d.com' WHEN lang = 'de' THEN 'd.com' ELSE 'notd.com' END AS domain, lang FROM items)
SELECT id, 'topic' AS filter FROM f WHERE lang = 'en' UNION ALL SELECT id, 'no topic' FROM f WHERE lang IS NULL OR lang NOT IN ('en', 'de') UNION ALL SELECT id, 'group' FROM f WHERE g = 1 UNION ALL SELECT id, 'domain' FROM f WHERE lang IN ('en', 'de')""")
def filtered_by_parts(spark, sf_dir):
    topics = F.when(F.col("lang").isin("en", "de"), F.array("lang")).otherwise(F.array().cast("array<string>"))
    rows = items(spark, sf_dir).select("id", topics.alias("topics"), (F.col("id") % 3).alias("group_id"), F.array(F.when(F.col("lang") == "en", "x.d.com").when(F.col("lang") == "de", "d.com").otherwise("notd.com")).alias("domains"))
    parts = {"topic": {"topic": "en"}, "no topic": {"no_topic": True}, "group": {"group": "1"}, "domain": {"domain": "D.com"}}
    found = [search.filtered(rows, **f).select("id", F.lit(name).alias("filter")) for name, f in parts.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query("SELECT DISTINCT 'sha256:' || sha256(coalesce(text, '')) AS id FROM documents WHERE starts_with(sha256(coalesce(text, '')), (SELECT substr(min(sha256(coalesce(text, ''))), 1, 8) FROM documents))")
def resolved_id(spark, sf_dir):
    """An item by the first eight digits of its id: the smallest id there is."""
    ids = content_ids(spark, sf_dir).select("id", F.lit("none.md").alias("note")).distinct()
    return search.resolve(ids, ids.agg(F.min("id").alias("id")).head()["id"].removeprefix("sha256:")[:8]).select("id")


@query("""WITH q AS (SELECT d.doc_id, d.text, substr(o.text, 3, 12) AS other, substr(d.text, 5, 30) AS own FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id + 1),
p AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(own, '\\s+', ' ', 'g'))) AS own, lower(trim(regexp_replace(other, '\\s+', ' ', 'g'))) AS other FROM q)
SELECT doc_id, length(own) >= 8 AND contains(t, own) AS own, length(other) >= 8 AND contains(t, other) AS other FROM p""")
def grounded_quotes(spark, sf_dir):
    """Whether a quote from a text, and one from the text of the next number, stand in it."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.substring("text", 3, 12).alias("other")), "doc_id", "left")
    return both.select("doc_id", search.grounded(F.col("text"), F.substring("text", 5, 30)).alias("own"), search.grounded(F.col("text"), F.col("other")).alias("other"))


@query("SELECT event_id AS id, (user_id % 30 >= 14 OR user_id % 11 >= 8) AND event_id % 5 <> 0 AND value / 100 <= 0.30 AND event_type <> 'click' AS diagram FROM events")
def diagrams(spark, sf_dir):
    r = {"hlines": F.col("user_id") % 30, "vlines": F.col("user_id") % 11, "n_qr": (F.col("event_id") % 5 == 0).cast("int"), "saturation": F.col("value") / 100, "kind": F.when(F.col("event_type") == "click", "game").otherwise("web")}
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), lifecycle.is_diagram(r).alias("diagram"))


@query("SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'qr_undecodable' WHEN event_id % 7 < 3 AND event_id % 4 <> 0 THEN 'no_text' WHEN value / 100 < 0.5 AND event_id % 4 <> 0 THEN 'low_confidence' END AS reason FROM events")
def verdicts(spark, sf_dir):
    e = F.col("event_id")
    decoded = (e % 4 == 0) & (e % 9 != 0)
    return read(spark, sf_dir, "events").select(e.alias("id"), lifecycle.verdict(e % 9 == 0, decoded, F.when(e % 9 == 0, 9).otherwise(e % 7), F.when(e % 9 == 0, 1.0).otherwise(F.col("value") / 100)).alias("reason"))


@query("""SELECT event_id AS id, epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(date_trunc('second', ts)) >= 30 AS settled FROM events
WHERE (event_id % 4 = 0 OR (event_id % 4 = 1 AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND event_id % 8 <> 1)) AND event_id % 16 <> 4""")
def watched_photos(spark, sf_dir):
    e = F.col("event_id")
    name = F.when(e % 16 == 4, F.concat(F.lit("Screenshot_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_com_app_Main.txt"))).when(e % 4 == 0, F.concat(F.lit("Screenshot_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_com_app_Main.png"))).when(e % 4 == 1, "image.png").when(e % 4 == 2, ".hidden.png").otherwise("notes.txt")
    found = read(spark, sf_dir, "events").select(e.alias("id"), F.concat(F.lit("/in/"), e.cast("string"), F.lit("/"), name).alias("path"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("modified"), (e % 8 == 1).alias("downloaded"), "ts")
    since = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return files.photos(found, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 30, since).select("id", "settled")


@query("SELECT page_id AS id, page_id % 5 <> 4 AND page_id % 3 <> 0 AS linkable FROM pages")
def linkable_urls(spark, sf_dir):
    by = F.element_at(F.array(*[F.lit(x) for x in ("qr", "crossref", "known", "allowed", "none")]), (F.col("page_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), links.linkable(by, F.when(F.col("page_id") % 3 == 0, "truncated")).alias("linkable"))


@query(f"""WITH {_CAPTURES}, n AS (SELECT source_app AS app, id AS a, lead(id) OVER w AS b, captured_at, lead(captured_at) OVER w AS later, event_type, lead(event_type) OVER w AS next_type FROM captures WHERE source_app IS NOT NULL WINDOW w AS (PARTITION BY source_app ORDER BY captured_at, id))
SELECT app, a, b FROM n WHERE b IS NOT NULL AND date_diff('microsecond', captured_at, later) < 3601000000 AND event_type <> next_type""")
def screen_neighbours(spark, sf_dir):
    rows = captures(spark, sf_dir).select("id", F.col("source_app").alias("app"), "captured_at", F.col("event_type").alias("group_id"), F.array().cast("array<string>").alias("lines"))
    return sequences.neighbours(rows, 3600).select("app", "a", "b")


@query(f"SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'low_confidence' ELSE 'unverified URL: ' || lower({_HOST}) || CASE WHEN page_id % 3 = 2 THEN ', other.my' ELSE '' END END AS reason FROM pages WHERE regexp_matches(url, '^https?://[^/]+/')")
def short_reasons(spark, sf_dir):
    p = read(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://[^/]+/"))
    reason = F.when(F.col("page_id") % 3 == 0, "low_confidence").otherwise(F.concat(F.lit("unverified URL: "), "url", F.when(F.col("page_id") % 3 == 2, ", https://other.my/x, OTHER.my").otherwise("")))
    return p.select(F.col("page_id").alias("id"), search.short_reason(reason).alias("reason"))


@query(f"""WITH g AS (SELECT DISTINCT CASE page_id % 6 WHEN 0 THEN ' ' || url WHEN 1 THEN {_HOST} WHEN 2 THEN 'com.my' WHEN 3 THEN 'bad_host.com' WHEN 4 THEN 'a.zzz' ELSE 'HTTP://Www.Shop.COM.my/x' END AS given FROM pages WHERE regexp_matches(url, '^https?://')),
h AS (SELECT given, string_split(regexp_replace(lower(trim(given)), '^https?://', ''), '/')[1] AS host FROM g), l AS (SELECT given, host, string_split(host, '.') AS labels FROM h), s AS (SELECT * FROM {_SUFFIX_SQL}),
t AS (SELECT given, host, labels, unnest(range(1, len(labels) + 1)) AS i FROM l), own AS (SELECT given, host, labels, len(labels) - i + 1 AS size, array_to_string(labels[i:], '.') AS own, CASE WHEN i < len(labels) THEN array_to_string(labels[i + 1:], '.') END AS above FROM t),
m AS (SELECT given, host, labels, max(CASE WHEN own IN (SELECT rule FROM s WHERE kind = 'exception') THEN size - 1 END) AS e, max(CASE WHEN own IN (SELECT rule FROM s WHERE kind = 'rule') OR above IN (SELECT rule FROM s WHERE kind = 'wild') THEN size END) AS r FROM own GROUP BY ALL),
x AS (SELECT given, CASE WHEN NOT regexp_matches(host, '^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$') THEN 'not a domain name' WHEN labels[-1] NOT IN ('com', 'net', 'org', 'my') THEN 'not a real top-level domain' WHEN len(labels) <= coalesce(e, r, 1) THEN 'a public suffix, not a site' END AS error, CASE WHEN len(labels) > coalesce(e, r, 1) THEN array_to_string(labels[len(labels) - coalesce(e, r, 1):], '.') END AS domain FROM m)
SELECT given, CASE WHEN error IS NULL THEN domain END AS domain, error FROM x""")
def allow_targets(spark, sf_dir):
    p, k = read(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://")), F.col("page_id") % 6
    given = F.when(k == 0, F.concat(F.lit(" "), "url")).when(k == 1, T.host(F.col("url"))).when(k == 2, "com.my").when(k == 3, "bad_host.com").when(k == 4, "a.zzz").otherwise("HTTP://Www.Shop.COM.my/x")
    tlds = spark.createDataFrame([("COM",), ("NET",), ("ORG",), ("MY",)], "tld string")
    return links.allow_targets(p.select(given.alias("given")), spark.createDataFrame(_SUFFIXES, "rule string, kind string"), tlds)


@query("""WITH f AS (SELECT o_custkey AS id, 'p' || o_orderkey AS path FROM orders), k AS (SELECT id, path FROM f WHERE length(path) % 2 = 0 OR ends_with(path, '1'))
SELECT id, list_sort(list(DISTINCT path)) AS paths FROM f WHERE NOT (length(path) % 2 = 0 OR ends_with(path, '1')) GROUP BY id""")
def copies_found(spark, sf_dir):
    f = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("p"), "o_orderkey").alias("path"))
    return records.new_copies(f, f.where((F.length("path") % 2 == 0) | F.col("path").endswith("1")))


def _kept_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    copy = lambda p, state, back: F.struct(p.alias("path"), state.alias("state"), back.cast("string").alias("restored_at"), F.concat(F.lit("q/"), p).alias("stored_path"))
    one = copy(F.concat(F.lit("c/"), k), F.when(k % 3 == 0, "present").otherwise("quarantined"), F.when(k % 2 == 0, "2024"))
    two = copy(F.concat(F.lit("d/"), k), F.lit("present"), F.lit(None))
    return read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 0, "present").otherwise("held").alias("source_state"), F.concat(F.lit("s/"), k).alias("source_path"), F.when(k % 4 == 1, F.concat(F.lit("h/"), k)).alias("stored_path"), F.when(k % 5 > 0, F.concat(F.lit("n/"), k)).alias("note_path"), F.array(one, two).alias("copies"))


@query("""SELECT o_orderkey AS id, 1 AS number, 'c/' || o_orderkey AS path FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0
UNION ALL SELECT o_orderkey, 2, 'd/' || o_orderkey FROM orders WHERE o_orderkey % 4 <> 0""")
def copies_routed(spark, sf_dir):
    return records.copies_to_quarantine(_kept_items(spark, sf_dir))


@query("""SELECT o_orderkey AS id, 'n/' || o_orderkey AS path FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey, 'h/' || o_orderkey FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT o_orderkey, 's/' || o_orderkey FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'q/' END || 'c/' || o_orderkey FROM orders UNION ALL SELECT o_orderkey, 'd/' || o_orderkey FROM orders""")
def item_files(spark, sf_dir):
    return records.files_of(_kept_items(spark, sf_dir))


@query("""SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M') || '–' || CASE WHEN strftime(ts, '%Y-%m-%d') = strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d') THEN strftime(ts + INTERVAL 5 HOUR, '%H:%M') ELSE strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') END AS span FROM events WHERE ts IS NOT NULL""")
def episode_spans(spark, sf_dir):
    return read(spark, sf_dir, "events").where("ts is not null").select(F.col("event_id").alias("id"), sinks.episode_span(F.col("ts"), F.col("ts") + F.expr("interval 5 hours")).alias("span"))


@query("SELECT doc_id, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS hash FROM documents")
def token_hashes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", duplicates.token_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query("SELECT page_id, regexp_extract(regexp_replace('HTTP://' || upper(url), '^HTTP://HTTPS?://', ''), '^([^/?#:]*)', 1) AS host FROM pages WHERE regexp_matches(url, '^https?://')")
def raw_hosts(spark, sf_dir):
    return read(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://")).select("page_id", T.raw_host(F.upper("url")).alias("host"))


@query("""SELECT p_partkey AS id, substr(trim(regexp_replace(lower(p_name || ' ' || p_type || ' & Co.'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40) AS label,
CASE p_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'whatsapp' WHEN 2 THEN 'tv' ELSE 'com' END AS app FROM part""")
def slugs(spark, sf_dir):
    k = F.col("p_partkey") % 4
    app = F.when(k == 1, "com.whatsapp").when(k == 2, "org.tv.io").when(k == 3, "com.my")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.slug(F.concat_ws(" ", "p_name", "p_type", F.lit("& Co."))).alias("label"), T.app_slug(app).alias("app"))


@query(f"""WITH {_CAPTURES}, g AS (SELECT coalesce(source_app, '') AS source_app, captured_at, CASE WHEN date_diff('microsecond', lag(captured_at) OVER w, captured_at) < 1000000 * CASE WHEN source_app IS NULL THEN 1800 ELSE 600 END THEN 0 ELSE 1 END AS starts FROM captures WHERE captured_at IS NOT NULL WINDOW w AS (PARTITION BY coalesce(source_app, '') ORDER BY captured_at)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY source_app ORDER BY captured_at ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT source_app, count(*) AS size, min(captured_at)::TIMESTAMP AS first, max(captured_at)::TIMESTAMP AS last FROM r GROUP BY source_app, run HAVING count(*) >= 2""")
def watermarked_sessions(spark, sf_dir):
    return ingest.session_counts(captures(spark, sf_dir)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("SELECT o_custkey AS id, o_orderpriority AS url, min(o_orderkey) AS seq FROM orders GROUP BY ALL")
def first_links(spark, sf_dir):
    return links.first_by_url(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("url"), F.col("o_orderkey").alias("seq")))


@query("""SELECT doc_id, doc_id % 4 = 3 AS conflict, CASE WHEN doc_id % 4 <> 3 THEN '---' || chr(10) || 'kind: "web"' || chr(10) || coalesce('lang: "' || lang || '"' || chr(10), '') || CASE WHEN doc_id % 4 IN (1, 2) THEN 'mine: yes' || chr(10) || '  - a' || chr(10) ELSE '' END
|| '---' || chr(10) || chr(10) || '%% generated: begin %%' || chr(10) || chr(10) || 'body ' || doc_id || chr(10) || chr(10) || '%% generated: end %%' || CASE WHEN doc_id % 4 IN (1, 2) THEN chr(10) || 'tail ' || doc_id ELSE chr(10) || chr(10) || '## Notes' || chr(10) END END AS note FROM documents""")
def owned_notes(spark, sf_dir):
    """Notes written anew over none, over ones with a user's fields and words, and over ones whose marks are gone."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id") % 4
    old = F.concat(F.lit('---\nkind: "old"\nmine: yes\n  - a\nlang: "xx"\n---\n\nwords before\n'), F.when(k == 3, "no marks").otherwise(f"{sinks.BEGIN}\nold body\n{sinks.END}"), F.lit("\ntail "), "doc_id")
    made = sinks.owned_note({"kind": F.lit("web"), "lang": F.col("lang")}, F.concat(F.lit("body "), "doc_id"), F.when(k > 0, old))
    return d.select("doc_id", made.alias("n")).select("doc_id", "n.conflict", "n.note")


@query(f"""WITH {_REFERENCE_GAPS}, ep AS (SELECT id, 'ep-' || session AS episode, captured_at, CASE WHEN id % 3 = 0 THEN event_type END AS g, value AS rank FROM sess WHERE size >= CASE WHEN source_app IS NULL THEN 3 ELSE 5 END),
u AS (SELECT episode, coalesce('g:' || g, 'i:' || id) AS unit, arg_min(id, (rank, captured_at, id)) AS best, min((captured_at, id)) AS first, list(id ORDER BY captured_at, id) AS every FROM ep GROUP BY ALL),
l AS (SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY first) AS position, best, strftime(first[1], '%H:%M') AS time, list_filter(every, lambda x: x <> best) AS also FROM u)
SELECT episode, count(*) AS size, '## ' || CASE WHEN length(episode) % 2 = 0 THEN 'Talk ' || episode ELSE episode END || chr(10) || chr(10) || string_agg(position || '. ' || time || ' [[' || best || ']]' || CASE WHEN len(also) > 0 THEN ' also [[' || array_to_string(also, ']], [[') || ']]' ELSE '' END, chr(10) ORDER BY position) AS body FROM l GROUP BY episode""")
def episode_hubs(spark, sf_dir):
    e = sessions.episodes(sessions.sessions(captures(spark, sf_dir))).select("episode", "id", "captured_at", F.when(F.col("id") % 3 == 0, F.col("event_type")).alias("group_id"), F.col("value").alias("rank"))
    named = e.select("episode").distinct().where(F.length("episode") % 2 == 0).withColumn("label", F.concat(F.lit("Talk "), "episode"))
    return sinks.episode_hub(sessions.folded(e), named)


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'chat' END AS set_kind, CASE WHEN doc_id % 4 = 1 THEN 'user' END AS set_by, CASE WHEN doc_id % 4 = 1 THEN 'set by user' || CASE WHEN doc_id % 3 = 0 THEN ', quoting ' || chr(39) || 'x' || chr(39) ELSE '' END END AS set_why, CASE WHEN doc_id % 4 = 2 THEN 'a,event' ELSE 'a' END AS topics_added FROM documents""")
def user_overrides(spark, sf_dir):
    d, k = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), F.col("id") % 4
    notes = d.where("id % 4 > 0").select("id", F.when(k == 1, "chat").when(k == 2, "event").otherwise("web").alias("kind"), F.when(k == 3, "rules").otherwise("user").alias("decided_by"), F.when(F.col("id") % 3 == 0, "x").alias("evidence"))
    out = records.overridden(d, notes, rules.KINDS)
    return out.select("id", "set_kind", "set_by", "set_why", F.array_join(records.migrated_topics(F.array(F.lit("a")), F.col("legacy_topic")), ",").alias("topics_added"))


@query("""WITH l AS (SELECT conv_id, turn, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS x FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE text <> ''))
SELECT conv_id, turn, count(*) AS lines, CAST(sum(length(x)) AS BIGINT) AS chars FROM l WHERE length(regexp_replace(x, '[^0-9a-z]', '', 'g')) >= 4 GROUP BY conv_id, turn""")
def content_line_counts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(sequences.content_lines(F.col("text"), F.lit(0), F.lit(0))).alias("x"))
    return c.groupBy("conv_id", "turn").agg(F.count("*").alias("lines"), F.sum(F.length("x")).alias("chars"))


@query()
def shown_hits(spark, sf_dir):
    excerpts = search.hits(read(spark, sf_dir, "documents"))
    return items(spark, sf_dir, excerpts, "redactions", "excerpt").select("id", "app", "captured_at", "redactions", "excerpt")


# ---- sequences and streams ----
@query()
def scroll_sequences(spark, sf_dir):
    """Texts in lines of eight words, seen through screens of twelve lines that move by eight; what is left at the end is a screen if it has as many new lines as a link takes, or else part of the last. head is id/screen."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text"), F.xxhash64("text"))).alias("item"), F.split(F.lower("text"), r"\s+").alias("w"))
    d = d.withColumn("all_lines", F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / 8).cast("int") - 1), lambda i: F.array_join(F.slice("w", i * 8 + 1, 8), " ")))
    last = F.greatest(F.floor((F.size("all_lines") - 12 + 8 - sequences.LEAST_NEW) / 8).cast("int"), F.lit(0))
    shots = d.withColumn("last", last).select("item", "all_lines", "last", F.explode(F.sequence(F.lit(0), "last")).alias("k"))
    at = F.timestamp_add("SECOND", F.col("k") * 20, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    seen = F.slice("all_lines", F.col("k") * 8 + 1, F.when(F.col("k") == F.col("last"), F.size("all_lines")).otherwise(12))
    lines = F.filter(seen, lambda x: F.length(F.regexp_replace(x, "[^0-9a-z]", "")) >= 4)
    rows = shots.select(F.concat_ws("/", "item", "k").alias("id"), F.col("item").alias("app"), at.alias("captured_at"), F.lit(None).cast("string").alias("group_id"), lines.alias("lines"))
    return sequences.sequences(rows).select("head", "size", F.length("text").alias("chars"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streamed_once(spark, sf_dir):
    schema = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).schema.simpleString().removeprefix("struct<").removesuffix(">")
    stream = spark.readStream.schema(", ".join(f"{p.split(':', 1)[0]} {p.split(':', 1)[1]}" for p in schema.split(","))).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    target, checkpoint = (f"{shared_dir(spark)}/{w}-{uuid.uuid4().hex}" for w in ("stream", "stream-state"))
    ingest.ingest(stream, target, checkpoint, id_col="event_id").awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"))
