"""Declarations, references and per-function measures of source files in many languages.

A language is a row of LANGUAGES: its endings, how comments and blocks look,
and patterns of declarations. One scanner serves all: comments and strings are
blanked, declarations are matched, a body ends where its block does, and what
is called, imported or inherited inside belongs to the innermost declaration.
Markup files are cut into the script they embed and the tags they use.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, language string, tag string, kind string, name string, qualified_name string, line int, end_line int, owner string, target string, cyclomatic int, nesting int, parameters int"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_ID = r"[A-Za-z_$][\w$]*"
_CALL = re.compile(r"(?<![\w$])(" + _ID + r"[!?]?)\s*(?:::<[^>()]*>)?\(")
_NOT_CALLED = set("if else elif for foreach while until switch case match when return catch function func fn fun def sub sizeof typeof new in not and or do try with using lock super this self constructor print echo require await async yield throw assert defined isset class array list unless where on as is end loop var let const static public private protected".split())
_NOT_DECLARED = set("if for foreach while switch catch return else new throw do try using lock match with".split())
_BRANCH = re.compile(r"\b(?:if|elif|elsif|elseif|for|foreach|while|until|case|when|catch|except|rescue)\b|&&|\|\||\?(?=[^?.:>]*:)")


@dataclass(frozen=True)
class Language:
    name: str
    endings: tuple[str, ...]
    functions: tuple[str, ...] = ()
    types: tuple[tuple[str, str], ...] = ()  # pattern, node kind
    imports: tuple[str, ...] = ()
    supers: str = ""  # in a type's header
    line_comments: tuple[str, ...] = ("//",)
    block_comment: tuple[str, str] | None = ("/*", "*/")
    block: str = "brace"  # brace, indent, end, none
    strings: str = "\"'"
    flags: int = re.M
    calls: str = ""  # a pattern of calls beside name(


def _c_like(*types: str) -> tuple[tuple[str, str], ...]:
    kinds = {"class": "Struct", "struct": "Struct", "record": "Struct", "object": "Struct", "actor": "Struct", "contract": "Struct", "library": "Struct", "union": "Struct", "impl": "Struct", "interface": "Interface", "protocol": "Interface", "trait": "Trait", "enum": "Enum", "namespace": "Module", "module": "Module", "mod": "Module"}
    return tuple((rf"\b{t}\s+(?P<name>{_ID})", kinds[t]) for t in types)


_METHOD = r"(?:^|(?<=[{};]))[ \t]*(?:@\w+(?:\([^)\n]*\))?\s+)*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|synchronized|native|global|testmethod|webservice|extern|unsafe|partial|default|inline|constexpr|explicit|const)\s+)*(?:<[^>\n]+>\s*)?[A-Za-z_][\w<>\[\],.?*&: ]*[\s*&]+(?P<name>~?[A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}=]*\{"
_JS_FUNCTIONS = (
    rf"\bfunction\s*\*?\s*(?P<name>{_ID})\s*(?:<[^>\n]*>)?\(",
    rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^)\n]*\)|{_ID})\s*(?::[^=\n]+)?=>)",
    rf"^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?P<name>(?!(?:if|for|while|switch|catch|function|return|with)\b){_ID})\s*(?:<[^>\n]*>)?\((?:[^;(){{}}]|\{{[^{{}}]*\}}|\([^()]*\))*\)\s*(?::[^{{;\n]+)?\{{",
)
_JS_IMPORTS = (r"\bimport\b[^'\"\n]*['\"](?P<name>[^'\"]+)['\"]", r"\brequire\(\s*['\"](?P<name>[^'\"]+)['\"]")
_JVM_IMPORTS = (r"^\s*import\s+(?:static\s+)?(?P<name>[\w.*]+)",)
_EXTENDS = rf"(?:extends|implements|:|,|with)\s*(?P<name>{_ID})"
_FN = rf"\bfn\s+(?P<name>{_ID})"
_MODULE_LANGUAGES_IMPORT = (r"^\s*use\s+(?P<name>[\w:]+)",)

_JAVASCRIPT = Language("javascript", ("js", "jsx", "mjs", "cjs"), _JS_FUNCTIONS, _c_like("class"), _JS_IMPORTS, _EXTENDS, strings="\"'`")
_TYPESCRIPT = replace(_JAVASCRIPT, name="typescript", endings=("ts", "tsx", "mts"), types=(*_c_like("class", "interface", "enum", "namespace"), (rf"\btype\s+(?P<name>{_ID})\s*(?:<[^>\n]*>)?=", "TypeAlias")))
_C = Language("c", ("c", "h"), (_METHOD,), (*_c_like("struct", "union", "enum"), (r"\btypedef\b[^;{]*?\b(?P<name>\w+)\s*;", "TypeAlias")), (r"^\s*#\s*include\s*[<\"](?P<name>[^>\"]+)",))
_CSHARP = Language("csharp", ("cs",), (_METHOD,), _c_like("class", "struct", "record", "interface", "enum", "namespace"), (r"^\s*using\s+(?:static\s+)?(?P<name>[\w.]+)\s*;",), _EXTENDS)
_JAVA = Language("java", ("java",), (_METHOD,), _c_like("class", "interface", "enum", "record"), _JVM_IMPORTS, _EXTENDS)
_LUA = Language("lua", ("lua",), (r"\bfunction\s+(?:[\w.]+[.:])?(?P<name>\w+)\s*\(", r"\b(?P<name>\w+)\s*=\s*function\s*\("), (), (r"\brequire\s*\(?\s*['\"](?P<name>[^'\"]+)",), line_comments=("--",), block_comment=("--[[", "]]"), block="end")
_RUST = Language("rust", ("rs",), (_FN,), (*_c_like("struct", "enum", "trait", "mod"), (r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)", "Struct"), (r"\btype\s+(?P<name>\w+)\s*(?:<[^>]*>)?=", "TypeAlias")), _MODULE_LANGUAGES_IMPORT, r"\bimpl(?:<[^>]*>)?\s+(?P<name>\w+)(?:<[^>]*>)?\s+for\b", strings='"')
_CF = Language("cfscript", ("cfs",), (r"\bfunction\s+(?P<name>\w+)\s*\(",), ((r"\bcomponent\b(?P<name>)", "Struct"),), (r"\bimport\s+(?P<name>[\w.]+)",), r"extends\s*=\s*['\"](?P<name>[\w.]+)", flags=re.M | re.I)
_PASCAL = Language("pascal", ("pas", "dpr", "pp"), (r"^\s*(?:class\s+)?(?:procedure|function|constructor|destructor)\s+(?:\w+\.)?(?P<name>\w+)",), ((r"^\s*(?P<name>\w+)\s*=\s*(?:class|record|interface)\b", "Struct"),), (r"^\s*uses\s+(?P<name>[\w.]+)",), r"class\s*\(\s*(?P<name>\w+)", ("//",), ("{", "}"), "none", "'", re.M | re.I)

#: Endings and keywords of the languages.
LANGUAGES: dict[str, Language] = {
    x.name: x
    for x in (
        Language("apex", ("cls", "trigger"), (_METHOD, r"\btrigger\s+(?P<name>\w+)\s+on\b"), _c_like("class", "interface", "enum"), (), _EXTENDS, flags=re.M | re.I),
        replace(_TYPESCRIPT, name="arkts", endings=("ets",), types=_c_like("class", "struct", "interface", "enum")),
        Language("bash", ("sh", "bash"), (r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\s*\)\s*\{", r"^\s*function\s+(?P<name>[\w-]+)\s*\{"), (), (r"^\s*(?:source|\.)\s+(?P<name>\S+)",), line_comments=("#",), block_comment=None, calls=r"^\s*(?P<name>[A-Za-z_][\w-]*)(?=\s|$)(?!\s*\()"),
        _C,
        replace(_C, name="cpp", endings=("cpp", "cc", "cxx", "hpp", "hh", "metal", "cu", "cuh"), types=(*_C.types, *_c_like("class", "namespace")), supers=rf"(?::|,)\s*(?:public|private|protected|virtual|\s)*(?P<name>{_ID})"),
        Language("cairo", ("cairo",), (_FN,), _c_like("struct", "enum", "trait", "mod"), _MODULE_LANGUAGES_IMPORT, strings="'\""),
        replace(_CF, name="cfquery", endings=("cfq",), functions=(), types=(), calls=r"\b(?:from|join|into|update)\s+(?P<name>\w+)"),
        _CF,
        Language("cobol", ("cbl", "cob", "cpy"), (r"^.{0,7}\s*(?P<name>[A-Z0-9][A-Z0-9-]*)\s+SECTION\s*\.", r"^ {7}(?P<name>[A-Z0-9][A-Z0-9-]*)\s*\.\s*$"), ((r"PROGRAM-ID\s*\.\s*(?P<name>[\w-]+)", "Module"),), (r"\bCOPY\s+(?P<name>[\w-]+)",), "", ("*>",), None, "none", "\"'", re.M | re.I, r"\b(?:PERFORM|CALL)\s+['\"]?(?P<name>[A-Z0-9][A-Z0-9-]*)"),
        _CSHARP,
        Language("dart", ("dart",), (_METHOD, r"^[ \t]*(?:static\s+)?[\w<>?]+\s+(?P<name>\w+)\s*\([^;{}]*\)\s*(?:async\s*)?=>"), _c_like("class", "enum"), (r"^\s*import\s+['\"](?P<name>[^'\"]+)",), _EXTENDS),
        Language("erlang", ("erl", "hrl"), (r"^(?P<name>[a-z]\w*)\s*\([^)\n]*\)\s*(?:when[^\n]*)?->",), ((r"^-module\(\s*(?P<name>\w+)", "Module"), (r"^-record\(\s*(?P<name>\w+)", "Struct")), (r"^-include(?:_lib)?\(\s*\"(?P<name>[^\"]+)", r"^-import\(\s*(?P<name>\w+)", r"^-behaviou?r\(\s*(?P<name>\w+)"), "", ("%",), None, "none", '"'),
        Language("fe", ("fe",), (_FN,), _c_like("struct", "enum", "trait", "contract"), _MODULE_LANGUAGES_IMPORT),
        Language("go", ("go",), (r"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(",), ((r"\btype\s+(?P<name>\w+)\s+struct\b", "Struct"), (r"\btype\s+(?P<name>\w+)\s+interface\b", "Interface"), (r"^package\s+(?P<name>\w+)", "Module")), (r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<name>[\w./-]+)\"\s*$",), strings="\"'`"),
        _JAVA,
        _JAVASCRIPT,
        Language("kotlin", ("kt", "kts"), (r"\bfun\s+(?:<[^>\n]*>\s*)?(?:[\w<>?.]+\.)?(?P<name>\w+)\s*\(",), _c_like("class", "interface", "object"), _JVM_IMPORTS, _EXTENDS),
        _LUA,
        replace(_LUA, name="luau", endings=("luau",), types=((r"^\s*(?:export\s+)?type\s+(?P<name>\w+)\s*(?:<[^>]*>)?=", "TypeAlias"),)),
        Language("move", ("move",), (r"\bfun\s+(?P<name>\w+)",), _c_like("struct", "module"), _MODULE_LANGUAGES_IMPORT),
        Language("nix", ("nix",), (r"^\s*(?P<name>[\w-]+)\s*=\s*(?:\{[^}\n]*\}|\w+)\s*:",), (), (r"\bimport\s+(?P<name>[./][\w./-]+)",), "", ("#",), ("/*", "*/"), "none", '"'),
        Language("objc", ("m", "mm"), (r"^\s*[-+]\s*\([^)]*\)\s*(?P<name>\w+)", _METHOD), ((r"@(?:implementation|interface)\s+(?P<name>\w+)", "Struct"), (r"@protocol\s+(?P<name>\w+)", "Interface")), (r"^\s*#\s*import\s*[<\"](?P<name>[^>\"]+)", r"^\s*@import\s+(?P<name>[\w.]+)"), r":\s*(?P<name>\w+)", calls=r"\[\s*[\w.]+\s+(?P<name>\w+)"),
        _PASCAL,
        Language("php", ("php",), (r"\bfunction\s+&?(?P<name>\w+)\s*\(",), _c_like("class", "interface", "trait", "enum"), (r"^\s*use\s+(?P<name>[\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<name>[^'\"]+)"), _EXTENDS, ("//", "#")),
        Language("python", ("py", "pyi"), (r"^[ \t]*(?:async\s+)?def\s+(?P<name>\w+)\s*\(",), ((r"^[ \t]*class\s+(?P<name>\w+)", "Struct"),), (r"^\s*from\s+(?P<name>[\w.]+)\s+import", r"^\s*import\s+(?P<name>[\w.]+)"), r"[(,]\s*(?P<name>\w+)", ("#",), None, "indent"),
        Language("r", ("r", "R"), (r"^[ \t]*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\(",), ((r"setClass\(\s*['\"](?P<name>\w+)", "Struct"),), (r"\b(?:library|require|source)\(\s*['\"]?(?P<name>[\w./]+)",), "", ("#",), None),
        Language("ruby", ("rb", "rake"), (r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!=]?)",), ((r"^[ \t]*class\s+(?P<name>[A-Z]\w*)", "Struct"), (r"^[ \t]*module\s+(?P<name>[A-Z]\w*)", "Module")), (r"^\s*require(?:_relative)?\s+['\"](?P<name>[^'\"]+)",), r"<\s*(?P<name>[A-Z]\w*)", ("#",), ("=begin", "=end"), "end", calls=r"\.(?P<name>\w+[?!]?)(?=[\s.)]|$)"),
        _RUST,
        Language("scala", ("scala", "sc"), (r"\bdef\s+(?P<name>\w+)",), _c_like("class", "object", "trait"), _JVM_IMPORTS, rf"(?:extends|with)\s+(?P<name>{_ID})"),
        Language("solidity", ("sol",), (r"\b(?:function|modifier)\s+(?P<name>\w+)\s*\(",), _c_like("contract", "interface", "library", "struct", "enum"), (r"^\s*import\b[^'\"\n]*['\"](?P<name>[^'\"]+)",), r"(?:\bis|,)\s+(?P<name>\w+)"),
        Language("sway", ("sw",), (_FN,), _c_like("struct", "enum", "trait", "contract"), _MODULE_LANGUAGES_IMPORT),
        Language("swift", ("swift",), (r"\bfunc\s+(?P<name>\w+)",), _c_like("class", "struct", "enum", "protocol", "actor"), (r"^\s*import\s+(?P<name>\w+)",), rf"(?::|,)\s*(?P<name>{_ID})"),
        Language("terraform", ("tf", "hcl"), (), ((r"^\s*resource\s+\"(?:[\w-]+)\"\s+\"(?P<name>[\w-]+)\"", "Struct"), (r"^\s*module\s+\"(?P<name>[\w-]+)\"", "Module"), (r"^\s*(?:variable|output|data|provider)\s+\"(?P<name>[\w-]+)\"", "Constant")), (r"\bsource\s*=\s*\"(?P<name>[^\"]+)",), "", ("#", "//"), ("/*", "*/"), "brace", "", re.M, r"\b(?:var|local|module)\.(?P<name>[\w-]+)"),
        _TYPESCRIPT,
        Language("vbnet", ("vb",), (r"^[ \t]*(?:(?:Public|Private|Protected|Friend|Shared|Overrides|Overridable|Async)\s+)*(?:Sub|Function)\s+(?P<name>\w+)",), ((r"^[ \t]*(?:(?:Public|Private|Friend|Partial|MustInherit)\s+)*(?:Class|Structure)\s+(?P<name>\w+)", "Struct"), (r"^[ \t]*(?:Public\s+)?Interface\s+(?P<name>\w+)", "Interface"), (r"^[ \t]*(?:Public\s+)?Module\s+(?P<name>\w+)", "Module")), (r"^\s*Imports\s+(?P<name>[\w.]+)",), r"(?:Inherits|Implements)\s+(?P<name>\w+)", ("'",), None, "vb", '"', re.M | re.I),
        Language("vyper", ("vy",), (r"^[ \t]*def\s+(?P<name>\w+)\s*\(",), ((r"^[ \t]*(?:struct|event)\s+(?P<name>\w+)", "Struct"), (r"^[ \t]*interface\s+(?P<name>\w+)", "Interface")), (r"^\s*(?:from|import)\s+(?P<name>[\w.]+)",), "", ("#",), None, "indent"),
    )
}
_BY_ENDING = {e: x.name for x in LANGUAGES.values() for e in x.endings}
#: Endings of markup files and of the decompiler's output.
MARKUP = {"svelte": "svelte", "vue": "vue", "astro": "astro", "razor": "razor", "cshtml": "razor", "cfm": "cfml", "cfc": "cfml", "liquid": "liquid", "xml": "mybatis", "html": "lwc", "page": "visualforce", "component": "visualforce", "cmp": "aura", "dfm": "delphi_form", "fmx": "delphi_form", "pseudo": "decompiled_c", "ida": "ida_c"}


def language_of(path: str) -> str | None:
    ending = path.rsplit(".", 1)[-1]
    return _BY_ENDING.get(ending) or _BY_ENDING.get(ending.lower()) or MARKUP.get(ending.lower())


def blanked(text: str, lang: Language, strings: bool = True) -> str:
    """The text with comments, and strings if asked for, as blanks; lines and places stay."""
    parts = [re.escape(c) + r"[^\n]*" for c in lang.line_comments]
    if lang.block_comment:
        parts.insert(0, re.escape(lang.block_comment[0]) + r"(?:.|\n)*?" + re.escape(lang.block_comment[1]))
    quoted = [r"(?P<s" + str(i) + r">" + ("'''(?:.|\n)*?'''|\"\"\"(?:.|\n)*?\"\"\"|" if lang.block == "indent" and not i else "") + (rf"{q}(?:\\.|[^{q}\\])*{q}" if q == "`" else rf"{q}(?:\\.|[^{q}\\\n])*{q}") + ")" for i, q in enumerate(lang.strings)]
    pattern = re.compile("|".join([*quoted, *parts])) if quoted or parts else None

    def blank(m: re.Match) -> str:
        if m.lastgroup and not strings:
            return m[0]
        body = re.sub(r"[^\n]", " ", m[0])
        return m[0][0] + body[1:-1] + m[0][-1] if m.lastgroup and len(body) > 1 else body

    return pattern.sub(blank, text) if pattern else text


@dataclass
class Declared:
    kind: str
    name: str
    start: int
    header: int
    end: int
    owner: str = ""
    qualified: str = field(default="")


def _body_end(text: str, lang: Language, start: int, head_end: int) -> tuple[int, int]:
    """Where a declaration's header and body end."""
    if lang.name == "objc" and text.startswith("@", start):
        stop = text.find("@end", head_end)
        return head_end, len(text) if stop < 0 else stop + 4
    if lang.name == "go" and text.startswith("package", start):
        return head_end, head_end  # the package is no block
    if lang.block == "brace":
        m = re.compile(r"[{;]").search(text, max(start, head_end - 1))
        if not m or m[0] == ";" or text.count("\n", head_end, m.start()) > 12:
            stop = text.find("\n", head_end)
            return (m.start() if m and m[0] == ";" else max(stop, head_end),) * 2
        depth = 0
        for b in re.compile(r"[{}]").finditer(text, m.start()):
            depth += 1 if b[0] == "{" else -1
            if not depth:
                return m.start(), b.end()
        return m.start(), len(text)
    line_end = text.find("\n", head_end)
    line_end = len(text) if line_end < 0 else line_end
    if lang.block == "indent":
        first = text.rfind("\n", 0, start) + 1
        indent = len(re.match(r"[ \t]*", text[first:])[0])
        end = line_end
        for m in re.compile(r"^([ \t]*)(\S)[^\n]*", re.M).finditer(text, line_end):
            if len(m[1]) <= indent and m[2] not in ")]}":
                break
            end = m.end()
        return line_end, end
    if lang.block in ("end", "vb"):
        open_ = r"^[ \t]*(?:(?:Public|Private|Protected|Friend|Shared|Overrides|Overridable|Async|Partial|MustInherit)\s+)*(?:Sub|Function|Class|Structure|Interface|Module)\b|^[ \t]*End\s+(?:Sub|Function|Class|Structure|Interface|Module)\b" if lang.block == "vb" else r"(?:^|(?<=[=;(]))[ \t]*(?:if|unless|while|until|case|begin|class|module|def|for)\b|\b(?:do|function)\b|\bend\b"
        depth = 0
        for m in re.compile(open_, lang.flags).finditer(text, text.rfind("\n", 0, start) + 1):
            word = m[0].strip().lower()
            if word.startswith("end"):
                depth -= 1
            elif not (word == "do" and re.search(r"^[ \t]*(?:while|until|for)\b[^\n]*$", text[text.rfind("\n", 0, m.start()) + 1 : m.start()])):
                depth += 1
            if depth <= 0:
                return line_end, m.end()
        return line_end, len(text)
    return line_end, -1  # up to the next declaration of its kind


def scan(path: str, text: str, lang: Language, first_line: int = 1, outer: str = "") -> list[tuple]:
    """Rows of SCHEMA of one text: nodes, and edges by name."""
    clean, kept = blanked(text, lang), blanked(text, lang, strings=False)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: first_line + bisect_right(starts, at) - 1
    found: dict[int, Declared] = {}
    for kind, patterns in (*((k, (p,)) for p, k in lang.types), ("Function", lang.functions)):
        for p in patterns:
            for m in re.finditer(p, kept if "'\\\"" in p or '\\"' in p else clean, lang.flags):
                if m["name"] and m["name"] not in _NOT_DECLARED and m.start("name") not in found:
                    header, end = _body_end(clean, lang, m.start(), m.end("name"))
                    found[m.start("name")] = Declared(kind, m["name"], m.start("name"), header, end, (m.groupdict().get("owner") or ""))
    own = sorted(found.values(), key=lambda d: d.start)
    for i, d in enumerate(own):
        if d.end < 0:  # up to the next of its kind, a module to the end
            d.end = len(text) if d.kind == "Module" else next((x.start for x in own[i + 1 :]), len(text))
    stack: list[Declared] = []
    rows: list[tuple] = []
    spans: list[Declared] = []
    for d in own:
        while stack and stack[-1].end <= d.start:
            stack.pop()
        above = d.owner or (stack[-1].qualified if stack else outer)
        d.qualified = f"{above}::{d.name}" if above else d.name
        d.owner = above
        stack.append(d)
        spans.append(d)
        body = clean[d.header : d.end] if d.kind == "Function" else ""
        depth = most = 0
        for b in re.findall(r"[{}]", body):
            depth += 1 if b == "{" else -1
            most = max(most, depth)
        if lang.block == "indent" and body:
            steps = sorted({len(x) for x in re.findall(r"^([ \t]+)\S", body, re.M)})
            most = len(steps)
        inside = re.match(r"[^(]*\(([^)]*)\)", clean[d.start : d.header + 1])
        params = len([p for p in inside[1].split(",") if p.strip()]) if inside and d.kind == "Function" else 0
        measures = (1 + len(_BRANCH.findall(body)), max(most - 1, 0), params) if d.kind == "Function" else (None, None, None)
        rows.append((path, lang.name, "node", d.kind, d.name, d.qualified, line(d.start), line(max(d.end - 1, d.start)), above or None, None, *measures))
        if above:
            rows.append((path, lang.name, "edge", "Contains", d.name, above, line(d.start), line(d.start), above, d.qualified, None, None, None))
        if lang.supers and d.kind != "Function":
            head = clean[text.rfind("\n", 0, d.start) + 1 : max(d.header, d.start)] if lang.name == "rust" else clean[d.start : d.header + (200 if lang.block == "vb" else 0)]
            for m in re.finditer(lang.supers, head, lang.flags):
                if m["name"] != d.name:
                    rows.append((path, lang.name, "edge", "Extends", d.name, d.qualified, line(d.start), line(d.start), d.qualified, m["name"], None, None, None))

    def owner(at: int) -> str | None:
        best = None
        for d in spans[: bisect_right([s.start for s in spans], at)]:
            if d.start <= at < d.end and d.kind in ("Function", "Struct", "Module"):
                best = d.qualified
        return best or outer or None

    names = {d.start for d in own}
    for pattern in (_CALL, *([re.compile(lang.calls, lang.flags)] if lang.calls else [])):
        for m in pattern.finditer(clean):
            group = "name" if "name" in pattern.groupindex else 1
            if m.start(group) not in names and m[group].lower() not in _NOT_CALLED and (who := owner(m.start(group))):
                rows.append((path, lang.name, "edge", "Calls", m[group], who, line(m.start()), line(m.start()), who, m[group], None, None, None))
    for p in lang.imports:
        for m in re.finditer(p, kept, lang.flags):
            rows.append((path, lang.name, "edge", "Imports", m["name"], path, line(m.start()), line(m.start()), path, m["name"], None, None, None))
    return rows


#: What each kind of markup refers to, as (edge kind, pattern of the name).
_TAGS = {
    "svelte": (("References", r"<([A-Z]\w*)"), ("Calls", r"on:\w+=\{(\w+)\}")),
    "vue": (("References", r"<([A-Z]\w*|[a-z]+-[\w-]+)"), ("Calls", r"@\w+=\"(\w+)")),
    "astro": (("References", r"<([A-Z]\w*)"),),
    "razor": (("References", r"<([A-Z]\w*)"), ("Calls", r"@on\w+=\"(\w+)\""), ("TypeOf", r"@(?:model|inject|inherits)\s+([\w.]+)")),
    "cfml": (("References", r"<cfinclude\s+template=\"([^\"]+)"), ("Calls", r"<cfinvoke[^>]*method=\"(\w+)")),
    "liquid": (("References", r"\{%-?\s*(?:render|include|section)\s+['\"]([\w/-]+)"),),
    "mybatis": (("References", r"<include\s+refid=\"([\w.]+)"), ("TypeOf", r"result(?:Type|Map)=\"([\w.]+)")),
    "lwc": (("References", r"<(c-[\w-]+)"), ("Calls", r"on\w+=\{(\w+)\}")),
    "visualforce": (("TypeOf", r"controller=\"(\w+)"), ("Calls", r"action=\"\{!(\w+)")),
    "aura": (("TypeOf", r"controller=\"(\w+)"), ("References", r"<c:(\w+)"), ("Calls", r"\{!c\.(\w+)")),
    "delphi_form": (("Calls", r"\bOn\w+\s*=\s*(\w+)"),),
}
_SCRIPT = {"svelte": r"<script[^>]*>(.*?)</script>", "vue": r"<script[^>]*>(.*?)</script>", "astro": r"\A---\n(.*?)\n---", "razor": r"@(?:code|functions)\s*\{(.*)\}", "cfml": r"<cfscript>(.*?)</cfscript>"}
_SCRIPT_LANGUAGE = {"svelte": "typescript", "vue": "typescript", "astro": "typescript", "razor": "csharp", "cfml": "cfscript"}
_DECLARED = {
    "cfml": (("Function", r"<cffunction\s+[^>]*name=\"(\w+)"),),
    "mybatis": (("Function", r"<(?:select|insert|update|delete|sql)\s+[^>]*id=\"(\w+)"),),
    "delphi_form": (("Field", r"^\s*(?:object|inherited)\s+(\w+)\s*:"),),
    "liquid": (("Function", r"\{%-?\s*(?:macro|block)\s+(\w+)"),),
}


def scan_markup(path: str, text: str, kind: str) -> list[tuple]:
    """A component for the file, what it declares, the script it embeds and what its tags refer to."""
    if kind in ("decompiled_c", "ida_c"):
        rows = scan(path, text, LANGUAGES["c"])
        rows = [(r[0], kind, *r[2:]) for r in rows]
        # addresses in comments and data symbols
        at = lambda i: text.count("\n", 0, i) + 1
        rows += [(path, kind, "node", "Constant", m[1], m[1], at(m.start()), at(m.start()), None, None, None, None, None) for m in re.finditer(r"^\s*(?:_?[A-Z]+\w*\s+)?((?:dword|qword|byte|off|unk|DAT)_[0-9A-Fa-f]+)\b(?=\s*[=;])", text, re.M)]
        return rows
    name = re.sub(r"\.\w+$", "", path.rsplit("/", 1)[-1])
    space = re.search(r"namespace=\"([\w.]+)\"", text)
    if kind == "mybatis":
        if not space:
            return []
        name = space[1].rsplit(".", 1)[-1]
    lines = lambda i: text.count("\n", 0, i) + 1
    rows = [(path, kind, "node", "Struct", name, name, 1, text.count("\n") + 1, None, None, None, None, None)]
    for what, p in _DECLARED.get(kind, ()):
        for m in re.finditer(p, text, re.M | re.I):
            rows.append((path, kind, "node", what, m[1], f"{name}::{m[1]}", lines(m.start()), lines(m.start()), name, None, None, None, None))
            rows.append((path, kind, "edge", "Contains", m[1], name, lines(m.start()), lines(m.start()), name, f"{name}::{m[1]}", None, None, None))
    rest = text
    if kind in _SCRIPT:
        for m in re.finditer(_SCRIPT[kind], text, re.S):
            rows += scan(path, m[1], LANGUAGES[_SCRIPT_LANGUAGE[kind]], lines(m.start(1)), name)
            rest = rest.replace(m[0], re.sub(r"[^\n]", " ", m[0]))
    for what, p in _TAGS.get(kind, ()):
        for m in re.finditer(p, rest, re.M):
            rows.append((path, kind, "edge", what, m[1], name, lines(m.start()), lines(m.start()), name, m[1], None, None, None))
    return rows


def extract(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA of files(path, content), each file by itself; files of no known language give none, null contents are empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for path, content in zip(f.path, f.content, strict=True):
                kind, text = language_of(path or ""), content or ""
                rows += scan(path, text, LANGUAGES[kind]) if kind in LANGUAGES else scan_markup(path, text, kind) if kind else []
            out = pd.DataFrame(rows, columns=_COLUMNS)
            yield out.astype({c: "Int32" for c in ("line", "end_line", "cyclomatic", "nesting", "parameters")})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def symbols(extracted: DataFrame) -> DataFrame:
    """Nodes with an id of file, kind, name and line."""
    digest = F.substring(F.sha2(F.concat_ws(":", "path", "kind", "qualified_name", "line"), 256), 1, 32)
    return extracted.where("tag = 'node'").select(F.concat_ws(":", "kind", digest).alias("id"), "kind", "name", "qualified_name", F.col("path").alias("file_path"), "language", "line", "end_line", "owner", "cyclomatic", "nesting", "parameters")


def references(extracted: DataFrame) -> DataFrame:
    """(ref_id, kind, name, path, owner, line) of what is called, inherited, imported or used by name."""
    refs = extracted.where("tag = 'edge' and kind <> 'Contains'")
    return refs.select(F.sha2(F.concat_ws(":", "path", "kind", "owner", "target", "line"), 256).alias("ref_id"), "kind", F.regexp_extract("target", r"([^.:/\\]+)$", 1).alias("name"), "path", "owner", "line").distinct()
