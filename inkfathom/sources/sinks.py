"""Sinks: manifests, notes and hubs as text columns, and the answer's envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def _yaml(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def note(fields: dict[str, Column], title: Column, links: Column, text: Column) -> Column:
    """A note: front matter of the fields that are set, a title, links (array of Markdown lines) and the text block."""
    front = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{k}: "), _yaml(v.cast("string"))) for k, v in fields.items()])), "\n")
    listed = F.when(F.size(links) > 0, F.concat(F.lit("## Links\n\n"), F.array_join(F.transform(links, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("---\n"), front, F.lit("\n---\n\n# "), title, F.lit("\n\n"), F.coalesce(listed, F.lit("")), F.lit("```text\n"), F.coalesce(text, F.lit("")), F.lit("\n```\n"))


#: Marks of the part of a note that is written anew each time, and what follows it in a new note.
BEGIN, END, TAIL = "%% generated: begin %%", "%% generated: end %%", "\n\n## Notes\n"
_FRONT = r"(?s)\A---\n(.*?)\n---\n?"


def owned_note(fields: dict[str, Column], body: Column, existing: Column) -> Column:
    """struct(note, conflict): a note whose front matter of these fields and whose generated part are new.

    Of an existing note (null for none), fields of other names, with the lines below them, and all that follows the generated
    part stay as they are. An existing note without both marks, in order, is a conflict: note is null, nothing is lost.
    """
    front = F.filter(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), _yaml(v.cast("string")))) for k, v in fields.items()]), lambda x: x.isNotNull())
    # A field is a line that begins with its name, and the lines below it that are indented.
    blocks = F.regexp_extract_all(F.concat(F.regexp_extract(existing, _FRONT, 1), F.lit("\n")), F.lit(r"(?m)^[^\s:][^:\n]*:[^\n]*\n(?:[ \t-][^\n]*\n)*"), F.lit(0))
    own = F.array(*[F.lit(k) for k in fields])
    foreign = F.transform(F.filter(blocks, lambda x: ~F.array_contains(own, F.trim(F.substring_index(x, ":", 1)))), lambda x: F.rtrim(x, F.lit("\n")))
    head = F.concat(F.lit("---\n"), F.array_join(F.concat(front, F.coalesce(foreign, F.array().cast("array<string>"))), "\n"), F.lit("\n---\n\n"))
    begin, end = F.locate(BEGIN, existing), F.locate(END, existing)
    conflict = existing.isNotNull() & ~((begin > 0) & (end > begin))
    tail = F.coalesce(F.substring(existing, end + len(END), F.length(existing)), F.lit(TAIL))
    whole = F.concat(head, F.lit(BEGIN + "\n\n"), F.coalesce(body, F.lit("")), F.lit("\n\n" + END), tail)
    return F.struct(F.when(~conflict, whole).alias("note"), F.coalesce(conflict, F.lit(False)).alias("conflict"))


def hub(rows: DataFrame, group: str, part: str, note_col: str) -> DataFrame:
    """group, body: the list of a group's notes in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(part, note_col))), lambda x: F.concat(F.lit("- [["), x[note_col], F.lit("]]")))
    return rows.groupBy(group).agg(F.count("*").alias("size"), F.array_join(parts, "\n").alias("body"))


def sequence_hub(sequences: DataFrame) -> DataFrame:
    """head, body: of sequences (head, members, text), the parts in order and the stitched text."""
    parts = F.transform("members", lambda m, i: F.concat((i + 1).cast("string"), F.lit(". [["), m.cast("string"), F.lit("]]")))
    return sequences.select("head", F.concat(F.lit("## Scrolled page, parts: "), F.size("members").cast("string"), F.lit("\n\n"), F.array_join(parts, "\n"), F.lit("\n\n```text\n"), F.coalesce("text", F.lit("")), F.lit("\n```")).alias("body"))


def episode_hub(members: DataFrame, named: DataFrame) -> DataFrame:
    """episode, size, body: of folded members (episode, position, best, time, also) a list under the user's label (named: episode, label), or none."""
    line = F.concat(F.col("position").cast("string"), F.lit(". "), "time", F.lit(" [["), F.col("best").cast("string"), F.lit("]]"), F.when(F.size("also") > 0, F.concat(F.lit(" also [["), F.array_join(F.col("also").cast("array<string>"), "]], [["), F.lit("]]"))).otherwise(""))
    listed = members.groupBy("episode").agg(F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    titled = listed.join(named, "episode", "left")
    return titled.select("episode", "size", F.concat(F.lit("## "), F.coalesce("label", "episode"), F.lit("\n\n"), "lines").alias("body"))


def episode_span(first: Column, last: Column) -> Column:
    """From when to when, the day once if it is one."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    end = F.when(day(first) == day(last), F.date_format(last, "HH:mm")).otherwise(F.date_format(last, "yyyy-MM-dd HH:mm"))
    return F.concat(F.date_format(first, "yyyy-MM-dd HH:mm"), F.lit("–"), end)


def envelope(tool: str, version: str, result: dict, error: str | None = None) -> dict:
    return {"tool": tool, "version": version, "ok": error is None, "result": result} | ({"error": error} if error else {})
