"""Tool calls of conversations: linked to their results, ordered, validated, and written as canonical JSON.

Calls are (conv_id, call_id, turn, name, arguments), results (conv_id, call_id, content). They meet in a hash join on
(conv_id, call_id), so a conversation of any length is spread by its calls and no conversation is gathered in one task.
`"$ref": "<call_id>"` in arguments names a call that must come first; levels are longest paths along such references, and
(level, turn, call_id) is a topological order. They are found by joins: a call that waits for one other only takes that
one's place and adds its length, so a chain of any length takes a logarithm of it in rounds; calls that wait for several
are done once these are. Arguments are parsed as variants and checked against schemas field by field. Canonical JSON has
sorted keys, no spaces, and numbers as parsed. Everything is built-in expressions and joins.

No row is lost. Equal rows are one, and n_copies tells how often it came. Of calls that share conversation and id, the
least by turn, name and arguments is the call; the others have the status `repeat`. Of results for one id the least is
linked; the others are rows with the status `further result`. A call without result is `unanswered`, a result without
call a `result without call`; where conversation or id is missing, the status is `no id`. Rows that are no call have no
level; neither has a call in or behind a cycle. A reference to no call is none. Arguments that are no JSON object are
invalid. Null text has no calls and becomes empty content; texts of any length are searched whole. Empty tables give an
empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: type: string, integer, number, boolean, object or array; required; enum, minimum, maximum, max_length where given.
Schemas = dict[str, dict[str, dict]]
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT<.*", "array": "^ARRAY<.*"}
_CALL, _RESULT = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", r"(?s)<tool_response>\s*(\{.*?\})\s*</tool_response>"
_REF = r'"\$ref"\s*:\s*"([^"]*)"'
#: The schema of the call that a user's turn makes of the assistant.
TURN_SCHEMAS: Schemas = {"respond": {"after": {"type": "object"}, "message": {"type": "string", "required": True, "min_length": 1, "max_length": 100_000}, "turn": {"type": "integer", "required": True, "minimum": 0}}}


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


def calls_in_text(conversations: DataFrame) -> DataFrame:
    """Calls written as <tool_call>{"id", "name", "arguments"}</tool_call> in assistants' turns."""
    found = _turns(conversations).where("role = 'assistant'").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(_CALL), F.lit(1))).alias("raw"))
    get = lambda k: F.get_json_object("raw", f"$.{k}")
    return found.select("conv_id", get("id").alias("call_id"), "turn", get("name").alias("name"), get("arguments").alias("arguments"))


def results_in_text(conversations: DataFrame) -> DataFrame:
    """Results written as <tool_response>{"id", "content"}</tool_response> in turns of the role tool."""
    found = _turns(conversations).where("role = 'tool'").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit(_RESULT), F.lit(1))).alias("raw"))
    return found.select("conv_id", F.get_json_object("raw", "$.id").alias("call_id"), F.get_json_object("raw", "$.content").alias("content"))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each user's turn as a call `respond` that comes after the user's turn before it, and each assistant's turn as the result of the turn before it."""
    turns = _turns(conversations)
    after = F.when(F.col("turn") >= 2, F.struct(F.concat(F.lit("turn-"), F.col("turn") - 2).alias("$ref")))
    arguments = F.to_json(F.struct(after.alias("after"), F.coalesce("text", F.lit("")).alias("message"), "turn"))
    calls = turns.where("role = 'user'").select("conv_id", F.concat(F.lit("turn-"), "turn").alias("call_id"), "turn", F.lit("respond").alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", F.concat(F.lit("turn-"), F.col("turn") - 1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


def canonical(json: Column) -> Column:
    """Canonical JSON of a JSON text; null if it is none."""
    return F.to_json(F.try_parse_json(json))


def _errors(schemas: Schemas) -> Column:
    """What is wrong with column arguments (parsed: _variant) of a call of column name."""

    def checks(name: str, fields: dict[str, dict]) -> Column:
        out = [F.when(~F.coalesce(F.schema_of_variant("_variant").startswith("OBJECT"), F.lit(False)), F.lit("not an object"))]
        for field, rule in sorted(fields.items()):
            value = F.try_variant_get("_variant", f"$.{field}", "variant")
            kind = F.schema_of_variant(value)
            there = value.isNotNull() & (kind != "VOID")
            if rule.get("required"):
                out.append(F.when(~F.coalesce(there, F.lit(False)), F.lit(f"{field}: missing")))
            if "type" in rule:
                out.append(F.when(there & ~kind.rlike(_TYPES[rule["type"]]), F.lit(f"{field}: not {rule['type']}")))
            number, text = F.try_variant_get("_variant", f"$.{field}", "double"), F.try_variant_get("_variant", f"$.{field}", "string")
            if "minimum" in rule:
                out.append(F.when(number < rule["minimum"], F.lit(f"{field}: too small")))
            if "maximum" in rule:
                out.append(F.when(number > rule["maximum"], F.lit(f"{field}: too large")))
            if "min_length" in rule:
                out.append(F.when(F.length(text) < rule["min_length"], F.lit(f"{field}: too short")))
            if "max_length" in rule:
                out.append(F.when(F.length(text) > rule["max_length"], F.lit(f"{field}: too long")))
            if "enum" in rule:
                out.append(F.when(there & ~text.isin(*rule["enum"]), F.lit(f"{field}: not allowed")))
        known = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
        extra = F.array_sort(F.array_except(F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")), known))
        return F.concat(F.array_compact(F.array(*out)), F.transform(extra, lambda k: F.concat(k, F.lit(": unknown"))))

    unknown = F.array(F.lit("unknown tool"))
    cases = [(F.col("name") == n, checks(n, f)) for n, f in schemas.items()]
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])).otherwise(unknown) if cases else unknown


#: Stands for what is in place already; lengths of paths stay below MOST, so that a cycle's can't overflow.
_DONE, MOST = "", 1 << 40


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of those of calls(conv_id, call_id, arguments) that wait for others; null in or behind a cycle."""
    key = ["conv_id", "call_id"]
    named = F.array_distinct(F.regexp_extract_all("arguments", F.lit(_REF), F.lit(1)))
    edges = calls.where(F.contains("arguments", F.lit('"$ref"'))).select(*key, F.explode(named).alias("parent"))
    known = calls.select("conv_id", F.col("call_id").alias("parent"))
    edges = edges.join(known, ["conv_id", "parent"], "left_semi").select(*key, F.struct(F.lit(False).alias("done"), F.col("parent").alias("id")).alias("p"), F.lit(1).cast("long").alias("w"))
    edges = table(edges, "call-edges")
    free = F.struct(F.lit(True).alias("done"), F.lit(_DONE).alias("id"))
    # What waits for nothing is in place: paths to it begin there.
    waiting = edges.select("conv_id", F.struct(F.lit(False).alias("done"), F.col("call_id").alias("id")).alias("p")).distinct().withColumn("waits", F.lit(True))
    edges = edges.join(waiting, ["conv_id", "p"], "left").withColumn("p", F.when(F.col("waits"), F.col("p")).otherwise(free)).drop("waits")
    edges = table(edges.groupBy(*key, "p").agg(F.max("w").alias("w")), "call-edges")
    placed = -1
    while True:
        one = edges.groupBy(*key).agg(F.count("*").alias("n"), F.max("p").alias("p"), F.max("w").alias("w")).where("n = 1")
        now = one.where("p.done").count()
        if now == placed:  # what is left waits for itself
            break
        placed = now
        jump = one.select("conv_id", F.struct(F.lit(False).alias("done"), F.col("call_id").alias("id")).alias("p"), F.col("p").alias("q"), F.col("w").alias("more"))
        step = edges.join(jump, ["conv_id", "p"], "left").select(*key, F.coalesce("q", "p").alias("p"), F.least(F.col("w") + F.coalesce("more", F.lit(0).cast("long")), F.lit(MOST)).alias("w"))
        edges = table(step.groupBy(*key, "p").agg(F.max("w").alias("w")), "call-edges")
    found = edges.groupBy(*key).agg(F.every(F.col("p.done")).alias("done"), F.max("w").alias("w"))
    return found.select(*key, F.when(F.col("done"), F.col("w").cast("int")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, call_id, turn, name, n_copies, status, level, answered, n_results, valid, errors, line (canonical JSON) of each call, repeat, and result that is linked to none."""
    key = ["conv_id", "call_id"]
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.groupBy(*key, "turn", "name", "arguments").agg(F.count("*").alias("n_copies"))
    results = results.groupBy(*key, "content").agg(F.count("*").alias("n_copies"))
    one = F.struct("turn", "name", "arguments")
    firsts = table(calls.where(has_id).groupBy(*key).agg(F.min(one).alias("first")), "first-calls")
    kept = table(results.where(has_id).groupBy(*key).agg(F.min(F.struct("content")).alias("linked"), F.sum("n_copies").alias("n_results")), "first-results")
    none = F.lit(None)
    out = calls.where(has_id).join(firsts, key).withColumn("is_call", one.eqNullSafe(F.col("first"))).join(kept, key, "left")
    status = F.when(~F.col("is_call"), "repeat").when(F.col("linked").isNull(), "unanswered").otherwise("answered")
    out = out.select(*key, "turn", "name", "arguments", "n_copies", status.alias("status"), F.when(F.col("is_call"), F.col("linked.content")).alias("content"), F.when(F.col("is_call"), F.coalesce("n_results", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n_results"))
    beside = lambda df, s: df.select(*key, none.cast("long").alias("turn"), none.cast("string").alias("name"), none.cast("string").alias("arguments"), "n_copies", F.lit(s).alias("status"), "content", F.col("n_copies").alias("n_results"))
    others = results.where(has_id).join(firsts.select(*key, F.lit(True).alias("called")), key, "left").join(kept.select(*key, "linked"), key)
    further = others.where(F.col("called") & ~F.struct("content").eqNullSafe(F.col("linked")))
    lost = calls.where(~has_id).select(*key, "turn", "name", "arguments", "n_copies", F.lit("no id").alias("status"), none.cast("string").alias("content"), F.lit(0).cast("long").alias("n_results"))
    out = out.union(lost).union(beside(further, "further result")).union(beside(others.where("called is null"), "result without call")).union(beside(results.where(~has_id), "no id"))
    is_call = F.col("status").isin("answered", "unanswered")
    named = firsts.select(*key, F.col("first.arguments").alias("arguments"))
    if not named.where(F.contains("arguments", F.lit('"$ref"'))).isEmpty():
        ordered = table(levels(named).withColumn("_waits", F.lit(True)), "call-levels")
        out = out.join(ordered, key, "left").withColumn("level", F.when(is_call & F.col("_waits"), F.col("level")).when(is_call, 0)).drop("_waits")
    else:
        out = out.withColumn("level", F.when(is_call, 0))
    out = out.withColumn("_variant", F.try_parse_json("arguments")).withColumn("errors", F.when(F.col("name").isNotNull() | F.col("arguments").isNotNull() | is_call, _errors(schemas)).otherwise(F.array(F.lit("no call"))))
    quoted = lambda c: F.coalesce(F.to_json(F.try_parse_json(F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":|\}$", ""))), F.lit("null"))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("_variant"), quoted("arguments")), F.lit(',"content":'), quoted("content"), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit("}")
    )
    return out.select(*key, "turn", "name", "n_copies", "status", "level", (is_call & (F.col("n_results") > 0)).alias("answered"), "n_results", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), line.alias("line"))


def format_conversations(conversations: DataFrame, schemas: Schemas = TURN_SCHEMAS) -> DataFrame:
    """link() of the calls that turns make and of those written in their texts."""
    calls, results = turns_as_calls(conversations)
    return link(calls.unionByName(calls_in_text(conversations)), results.unionByName(results_in_text(conversations)), schemas)
