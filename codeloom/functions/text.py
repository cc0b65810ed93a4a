"""Functions on names, paths, comments, commit messages and source text, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide the same way as elsewhere.
SOURCE_WORDS = ("input", "request", "req", "param", "params", "arg", "args", "argv", "recv", "read", "env", "user", "untrusted", "stdin", "body", "query", "cookie", "header", "payload", "form", "upload", "external", "remote", "raw")
SINK_WORDS = ("exec", "execute", "query", "system", "eval", "write", "command", "cmd", "render", "html", "sql", "spawn", "shell", "popen", "deserialize", "load", "send", "open", "delete", "remove", "run")
STRONG_SINKS = ("exec", "execute", "system", "eval", "command", "cmd", "shell", "spawn", "popen", "deserialize", "unmarshal", "unpickle", "sql", "query", "html", "render", "template", "fetch", "http", "url", "curl", "request", "webhook", "redirect")
SANITIZERS = ("sanitize", "escape", "validate", "verify", "clean", "encode", "quote", "authorize", "authz", "ensure", "permit", "guard", "filter", "scrub", "normalize", "canonical", "whitelist", "allowlist")
BUG_WORDS = ("fix", "bug", "error", "broken", "crash", "issue", "problem", "not working", "fails", "undefined", "null", "panic", "segfault", "regression")
EXPLORATION_WORDS = ("how does", "where is", "what is", "find", "show me", "explain", "understand", "explore", "trace", "walk through")
FEATURE_WORDS = ("add", "create", "implement", "build", "enable", "allow", "new feature", "support for", "ability to", "want to", "should be able", "need to add", "swap", "edit", "modify", "introduce", "make it")
FIX_WORDS = ("fix", "bug", "patch", "vuln", "security", "cve", "regression", "hotfix", "exploit", "overflow", "injection", "bypass", "leak", "race", "deadlock")
SURPRISE = 10.0
#: Classes of code points that reviewers should see, as ranges.
HAZARDS = {
    "control": ((0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x9F)),
    "bidi": ((0x061C, 0x061C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069)),
    "zero_width": ((0xAD, 0xAD), (0x200B, 0x200D), (0x2060, 0x2064), (0xFEFF, 0xFEFF)),
    "private_use": ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)),
    "noncharacter": ((0xFDD0, 0xFDEF), *((p * 0x10000 + 0xFFFE, p * 0x10000 + 0xFFFF) for p in range(17))),
}


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words anywhere, in any case; false for null."""
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def name_parts(name: Column) -> Column:
    """Lower-case parts of an identifier, in order, repeats kept: execSQLQuery gives exec, sql, query."""
    cut = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.split(F.lower(cut), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def name_class(name: Column) -> Column:
    """struct(source, sink): the shares of a name's parts that are source-like and sink-like words."""
    parts = name_parts(name)
    share = lambda words: F.when(F.size(parts) > 0, F.size(F.filter(parts, lambda x: x.isin(*words))) / F.size(parts)).otherwise(0.0)
    return F.struct(share(SOURCE_WORDS).alias("source"), share(SINK_WORDS).alias("sink"))


def flow_priority(source: Column, sink: Column) -> Column:
    """How much a flow between two names is worth a look: the evidence of the names, and SURPRISE where neither tells what it is."""
    a, b = name_class(source), name_class(sink)
    told = (a["source"] > a["sink"]) | (b["sink"] > b["source"])
    return a["source"] + b["sink"] + F.when(told, 0.0).otherwise(SURPRISE)


def intent(task: Column) -> Column:
    """bug, exploration, feature or unknown: the first whose words the task holds."""
    return F.when(holds_any(task, BUG_WORDS), "bug").when(holds_any(task, EXPLORATION_WORDS), "exploration").when(holds_any(task, FEATURE_WORDS), "feature").otherwise("unknown")


def is_fix(message: Column) -> Column:
    return holds_any(message, FIX_WORDS)


def should_retrieve(unresolved: Column, cross_module: Column, external: Column) -> Column:
    """Whether a site needs more than its own file: a type is unresolved, or it refers out of its module or to an external symbol."""
    return (F.coalesce(unresolved, F.lit(0)) > 0) | (F.coalesce(cross_module, F.lit(0)) > 0) | F.coalesce(external, F.lit(False))


def proximity(a: Column, b: Column) -> Column:
    """15 for each directory that two file paths share from the start, at most 80."""
    dirs = lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    same = F.zip_with(dirs(a), dirs(b), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    differs = F.array_position(same, F.lit(False))
    return F.least(F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int") * 15, F.lit(80))


def normal_path(path: Column) -> Column:
    """Slashes forward, no ./ parts, no doubled slash, no slash at the end."""
    out = F.regexp_replace(path, r"\\", "/")
    out = F.regexp_replace(F.regexp_replace(out, r"/{2,}", "/"), r"(?<=/|^)(?:\./)+", "")
    return F.regexp_replace(out, r"(?<=.)/$", "")


def escaped_glob(text: Column) -> Column:
    """The text as a glob pattern that matches only itself."""
    return F.regexp_replace(text, r"([*?\[\]])", r"[$1]")


#: Parts of a pattern for paths and what each stands for; any other character is itself.
_GLOB = re.compile(r"(?P<folders>\*\*/)|(?P<all>\*\*)|(?P<some>\*)|(?P<one>\?)|\{(?P<either>[^{}]*[^{},][^{}]*)\}|(?P<self>.)", re.S)
_STANDS = {"folders": "(?:.*/)?", "all": ".*", "some": "[^/]*", "one": "[^/]"}


def path_glob(pattern: str) -> str:
    """A regular expression of a pattern for whole paths: * and ? stop at slashes, ** does not, **/ is any folders or none, {a,b} is either."""
    out = []
    for m in _GLOB.finditer(pattern):
        kind, text = m.lastgroup, m[m.lastgroup]
        out.append(_STANDS.get(kind) or ("(?:" + "|".join(re.escape(x) for x in text.split(",") if x) + ")" if kind == "either" else re.escape(text)))
    return "^" + "".join(out) + "$"


def matches_glob(path: Column, *patterns: str) -> Column:
    """Whether a path matches one of the patterns; none of no patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(path_glob(p))
    return F.coalesce(hit, F.lit(False))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def clean_docstring(comment: Column) -> Column:
    """A comment without its markers."""
    out = F.regexp_replace(comment, r"\A/\*\*?|\*/\z", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)^//\s?", ""), r"(?m)^\s*\*\s?", "")
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits of the UTF-8 bytes."""
    hexed = F.hex(F.encode(F.coalesce(text, F.lit("")), "utf-8"))
    steps = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed), F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substr(hexed, i, F.lit(2)), 16, 10).cast("long")
    # the product of 32 bits and the prime 2^24 + 403, modulo 2^32
    times = lambda h: (F.shiftleft(h.bitwiseAND(F.lit(255)), 24) + h * 403).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(steps, F.lit(2166136261).cast("long"), lambda h, i: times(h.bitwiseXOR(byte(i))))


def hazards(text: Column) -> Column:
    """array of struct(codepoint, line, column, category): code points that hide or turn text around; lines and columns from 1."""
    one = lambda lo, hi: f"\\x{{{lo:x}}}-\\x{{{hi:x}}}"
    spans = {k: "".join(one(lo, hi) for lo, hi in v) for k, v in HAZARDS.items()}
    anything = "[" + "".join(spans.values()) + "]"

    def of_line(line: Column, number: Column) -> Column:
        at = F.filter(F.transform(F.split(line, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].rlike(anything))

        def told(x: Column) -> Column:
            category = F.lit(None).cast("string")
            for k, span in reversed(spans.items()):
                category = F.when(x["c"].rlike(f"[{span}]"), k).otherwise(category)
            # UTF-32 gives the code point of one character
            return F.struct(F.conv(F.hex(F.encode(x["c"], "UTF-32")), 16, 10).cast("int").alias("codepoint"), (number + 1).cast("int").alias("line"), (x["i"] + 1).cast("int").alias("column"), category.alias("category"))

        return F.when(line.rlike(anything), F.transform(at, told)).otherwise(F.array().cast("array<struct<codepoint:int,line:int,column:int,category:string>>"))

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), of_line))


def halstead(operators: Column, operands: Column, total_operators: Column, total_operands: Column) -> dict[str, Column]:
    """The derived measures of Halstead from counts of distinct and of all operators and operands."""
    words, length = operators + operands, total_operators + total_operands
    volume = F.when(words > 0, length * F.log2(words.cast("double"))).otherwise(0.0)
    difficulty = F.when(operands > 0, operators / 2.0 * (total_operands / operands)).otherwise(0.0)
    return {"vocabulary": words, "length": length, "volume": volume, "difficulty": difficulty, "effort": difficulty * volume, "bugs": volume / 3000.0}


def maintainability(volume: Column, cyclomatic: Column, lines: Column) -> Column:
    """171 - 5.2 ln V - 0.23 G - 16.2 ln L, at least 0; null without volume or lines."""
    return F.when((volume > 0) & (lines > 0), F.greatest(171 - 5.2 * F.ln(volume) - 0.23 * cyclomatic - 16.2 * F.ln(lines.cast("double")), F.lit(0.0)))


def semantic_hash(text: Column) -> Column:
    """A hash that // and # comments, /* */ comments and white space do not change."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)/\*.*?\*/|(?-s)(?://|#).*", " ")
    return F.sha2(F.trim(F.regexp_replace(bare, r"\s+", " ")), 256)
