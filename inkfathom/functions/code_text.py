"""Program text: whether a text is one, in which language, and what it imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures (pattern, weight) of each language, languages in the order that breaks ties.
SIGNATURES: dict[str, list[tuple[str, int]]] = {
    "python": [(r"^\s*def \w+\(.*\)\s*(->\s*[\w\[\], .]+)?:\s*$", 3), (r"^\s*from [\w.]+ import [\w*]", 3), (r"^\s*import \w[\w.]*(\s+as \w+)?\s*$", 2), (r"^\s*class \w+(\(.*\))?:\s*$", 3), (r"^\s*(if|elif|for|while|with|try|except)\b.*:\s*$", 2), (r"\bself\.\w", 2), (r"^\s*@\w[\w.]*(\(.*\))?\s*$", 1), (r"\b(None|True|False)\b", 1), (r"\bprint\(", 1), (r"^\s*return\b", 1), (r"\bf\"[^\"]*\{", 2), (r"__\w+__", 2)],
    "go": [(r"^package \w+\s*$", 4), (r"\bfunc (\(\w+ \*?\w+\) )?\w+\(", 3), (r":= ", 2), (r"\bif err != nil\b", 4), (r"\bfmt\.\w+\(", 3), (r"^import \($", 3), (r"\b(chan|go func|defer)\b", 2), (r"\[\]\w+\{", 2), (r"\bstruct \{", 2)],
    "typescript": [(r"\binterface \w+(<.*>)? \{", 3), (r"\w\??: (string|number|boolean|any|void|unknown|never)\b", 3), (r"^\s*(export )?type \w+(<.*>)? = ", 3), (r"\b(as const|readonly|implements|enum \w+ \{)", 2), (r"\):\s*(Promise<|string|number|boolean|void)", 3), (r"<\w+(\[\])?>\(", 1)],
    "javascript": [(r"^\s*(export )?(const|let|var) \w+ = ", 2), (r"=> ?[{(\w]", 2), (r"^\s*import .* from ['\"][@\w./-]+['\"];?\s*$", 3), (r"\brequire\(['\"]", 3), (r"\bconsole\.log\(", 3), (r"\bmodule\.exports\b", 3), (r"^\s*(async )?function \w+\(", 2), (r"\b(document|window)\.\w", 2), (r"\bawait \w", 1), (r"===", 2)],
    "rust": [(r"\bfn \w+(<.*>)?\(", 3), (r"\blet mut\b", 3), (r"^\s*use \w+(::\w+)+", 3), (r"\bimpl\b", 2), (r"\bprintln!\(", 4), (r"-> (Result|Option)<", 3), (r"&(mut )?self\b", 3), (r"\w::\w", 1)],
    "java": [(r"\bpublic (static )?(final )?(class|void|interface)\b", 3), (r"\bSystem\.out\.print", 4), (r"\bprivate (final )?\w+(<.*>)? \w+;", 3), (r"@Override\b", 3), (r"^import java\.", 4), (r"\bnew \w+(<.*>)?\(", 1)],
    "kotlin": [(r"\bfun \w+\(", 3), (r"^\s*val \w+(: \w+)? = ", 2), (r"\bdata class\b", 3), (r"\bprintln\(", 1)],
    "swift": [(r"\bfunc \w+\(.*\) -> ", 3), (r"^import (SwiftUI|UIKit|Foundation)\s*$", 4), (r"\bguard let\b", 3), (r"^\s*(var|let) \w+: \w+", 2), (r"\bstruct \w+: View\b", 4)],
    "c": [(r"^#include [<\"]", 4), (r"\bint main\(", 3), (r"\bprintf\(", 2), (r"\w->\w", 1)],
    "cpp": [(r"\bstd::", 4), (r"^#include <(iostream|vector|string|map)>", 4), (r"\bcout <<", 4), (r"\btemplate ?<", 3)],
    "csharp": [(r"^using System", 4), (r"^namespace \w", 3), (r"\bConsole\.WriteLine\(", 4), (r"\bpublic (async )?(Task|void|string|int)\b", 2)],
    "php": [(r"<\?php", 5), (r"\$\w+ = ", 2), (r"\becho \$", 3), (r"->\w+\(", 1)],
    "ruby": [(r"^\s*def \w+[!?]?(\(.*\))?\s*$", 2), (r"^\s*end\s*$", 2), (r"\bputs ", 2), (r"^require ['\"]", 3), (r"\bdo \|\w+\|", 3)],
    "sql": [(r"(?i)\bselect\b.+\bfrom\b", 3), (r"(?i)\binsert into\b", 4), (r"(?i)\bcreate table\b", 4), (r"(?i)\b(inner |left |right )?join\b.+\bon\b", 2), (r"(?i)\bwhere\b.+=", 1), (r"(?i)\b(group|order) by\b", 2)],
    "shell": [(r"^#!/(usr/)?bin/(env )?(ba|z)?sh", 5), (r"^\s*[$%❯] ", 2), (r"^\s*([$%❯] )?(sudo|brew|apt(-get)?|npm|npx|pnpm|yarn|pip3?|uv|git|curl|wget|docker|kubectl|cd|ls|mkdir|chmod|export|ssh|make|go (run|build|mod)|cargo)\b", 2), (r" && ", 1), (r"\| ?(grep|awk|sed|xargs)\b", 2)],
    "dockerfile": [(r"^(FROM|RUN|COPY|CMD|ENTRYPOINT|WORKDIR|EXPOSE|ENV|ARG) ", 3)],
    "yaml": [(r"^(apiVersion|kind|services|jobs|steps|on):", 3), (r"^\s*- (name|uses|run): ", 3), (r"^\s*[\w-]+: [\w\"'./-]+\s*$", 1)],
    "json": [(r"^\s*\"[\w-]+\": [\"\d\[{tfn]", 2), (r"^\s*[{\[]\s*$", 1)],
    "html": [(r"<(html|head|body|div|span|script|a|p|ul|li)\b[^>]*>", 2), (r"</\w+>", 2), (r"<!DOCTYPE", 5)],
    "css": [(r"^\s*[.#]?[\w-]+(\s*[,>]\s*[.#]?[\w-]+)*\s*\{\s*$", 2), (r"^\s*[\w-]+: [^;]+;\s*$", 2), (r"@media\b", 3)],
}
# What a line of program text looks like, the share of such lines, and the least score.
CODE_LINE = r"(?U)[{}\[\]();:,]\s*$|^\s*(#|//|/\*|\*|--)|\s(=|==|=>|:=|->|\+=|&&|\|\|)\s|^\s*[$%❯] |^\s*(def|class|func|fn|fun|import|from|package|return|if|for|while|const|let|var|public|private|use|SELECT|FROM|WHERE|RUN|FROM)\b"
LEAST_SHARE, LEAST_SCORE = 0.4, 5
# How languages import.
IMPORTS: dict[str, list[str]] = {
    "python": [r"^\s*from ([\w]+)[\w.]* import", r"^\s*import ([\w]+)"],
    "go": [r"^\s*(?:import )?\"([\w.-]+(?:/[\w.-]+){0,2})\"\s*$"],
    "typescript": [r"from ['\"]((?:@[\w-]+/)?[\w-]+)", r"require\(['\"]((?:@[\w-]+/)?[\w-]+)"],
    "javascript": [r"from ['\"]((?:@[\w-]+/)?[\w-]+)", r"require\(['\"]((?:@[\w-]+/)?[\w-]+)"],
    "rust": [r"^\s*use (\w+)::", r"^\s*extern crate (\w+)"],
    "java": [r"^import (?:static )?([\w]+\.[\w]+)"],
    "kotlin": [r"^import ([\w]+\.[\w]+)"],
    "swift": [r"^import (\w+)"],
    "c": [r"^#include [<\"]([\w./]+)[>\"]"],
    "cpp": [r"^#include [<\"]([\w./]+)[>\"]"],
    "csharp": [r"^using ([\w.]+);"],
    "php": [r"^use ([\w\\]+)"],
    "ruby": [r"^require ['\"]([\w/-]+)"],
}
MOST_IMPORTS = 12


def code_share(text: Column) -> Column:
    """Share of lines that look like program text; null below two lines."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]", -1), lambda x: F.trim(x) != "")
    return F.when(F.size(lines) >= 2, F.size(F.filter(lines, lambda x: x.rlike(CODE_LINE))) / F.size(lines))


def language(text: Column) -> Column:
    """struct(lang, score) of a text that reads as program text, else null. Each signature counts once."""
    score = {k: reduce(lambda a, b: a + b, [F.when(text.rlike("(?mU)" + p), w).otherwise(0) for p, w in s]) for k, s in SIGNATURES.items()}
    plain = F.array(*[score[k] for k in SIGNATURES])
    at = {k: i for i, k in enumerate(SIGNATURES)}
    own = lambda x, i: (
        F.when((i == at["typescript"]) & (x >= 3), x + F.get(plain, F.lit(at["javascript"]))).when((i == at["cpp"]) & (x > 0), x + F.get(plain, F.lit(at["c"]))).otherwise(x)
    )
    ranked = F.transform(plain, lambda x, i: F.struct(own(x, i).alias("score"), (-i).alias("order")))
    best = F.array_max(ranked)
    names = F.array(*[F.lit(k) for k in SIGNATURES])
    found = F.struct(F.get(names, -best["order"]).alias("lang"), best["score"].alias("score"))
    return F.when((F.coalesce(code_share(text), F.lit(0.0)) >= LEAST_SHARE) & (best["score"] >= LEAST_SCORE), found)


def imports(text: Column, lang: Column) -> Column:
    """Imported packages, each once, in order of first place; the place of a match is what comes before it."""

    def hits(pattern: str, k: int) -> Column:
        p = "(?mU)" + pattern
        names = F.regexp_extract_all(text, F.lit(p), F.lit(1))
        whole = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        gaps = F.transform(F.split(text, p, -1), lambda g: F.length(g))
        total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + x)
        return F.transform(names, lambda n, i: F.struct((total(gaps, i + 1) + total(F.transform(whole, lambda w: F.length(w)), i)).alias("at"), n.alias("name")))

    def of(patterns: list[str]) -> Column:
        found = F.array_sort(F.concat(*[hits(p, k) for k, p in enumerate(patterns)]))
        names = F.array_distinct(F.transform(found, lambda x: x["name"]))
        return F.slice(F.filter(names, lambda n: ~n.startswith(".")), 1, MOST_IMPORTS)

    cases = list(IMPORTS.items())
    out = F.when(lang == cases[0][0], of(cases[0][1]))
    for k, p in cases[1:]:
        out = out.when(lang == k, of(p))
    return out.otherwise(F.array().cast("array<string>"))
