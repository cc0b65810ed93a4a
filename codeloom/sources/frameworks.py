"""What frameworks declare by convention: routes, handlers, modules and bridges, one row of RULES for each form.

A rule says in which files a pattern stands and what its groups mean: verb,
path and handler of a route; name and, where there is one, target of anything
else. Handlers are resolved to functions by name, those of the same file first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    framework: str
    kind: str  # route, component, module, bridge, reference
    endings: tuple[str, ...]
    pattern: str
    verb: str = ""  # where the pattern has no group of it
    by_path: str = ""  # the file's place gives the route: a pattern of it


_JS = ("js", "jsx", "ts", "tsx", "mjs", "svelte", "vue", "astro")
_VERBS = "get|post|put|patch|delete|options|head|all|any"
_Q = r"['\"`]"

#: The forms in which frameworks declare what they serve.
RULES = (
    Rule("astro", "route", ("astro", "ts", "js"), "", "GET", r"(?:^|/)src/pages/(?P<path>.+?)(?:/?index)?\.(?:astro|ts|js)$"),
    Rule("cargo_workspace", "module", ("toml",), r"^\s*name\s*=\s*\"(?P<name>[\w-]+)\""),
    Rule("cargo_workspace", "reference", ("toml",), r"^\s*(?P<name>[\w-]+)\s*=\s*\{[^}]*path\s*=\s*\"(?P<target>[^\"]+)\""),
    Rule("cics", "reference", ("cbl", "cob"), r"EXEC\s+CICS\s+(?:LINK|XCTL)\s+PROGRAM\s*\(\s*'?(?P<target>(?P<name>[\w-]+))"),
    Rule("aspnet", "route", ("cs",), r"\[Http(?P<verb>Get|Post|Put|Delete|Patch)(?:\(\s*\"(?P<path>[^\"]*)\")?[^\]]*\]\s*(?:\[[^\]]*\]\s*)*(?:public|async|static|virtual|\s)*[\w<>\[\]?]+\s+(?P<handler>\w+)\s*\("),
    Rule("aspnet", "route", ("cs",), r"\bMap(?P<verb>Get|Post|Put|Delete|Patch)\(\s*\"(?P<path>[^\"]+)\"\s*,\s*(?P<handler>[\w.]*)"),
    Rule("drupal", "route", ("yml", "yaml"), r"^\s*path:\s*['\"]?(?P<path>/[^'\"\n]*)['\"]?(?:.*\n)*?\s*_(?:controller|form):\s*['\"]?[\w\\:]*?(?P<handler>\w+)['\"]?\s*$", "ANY"),
    Rule("drupal", "bridge", ("module", "inc", "install"), r"^function\s+(?P<target>\w+?)_(?P<name>(?:form_alter|menu|theme|cron|install|preprocess_\w+|node_\w+|entity_\w+))\s*\("),
    Rule("expo_modules", "bridge", ("swift", "kt"), r"\b(?:Async)?Function\(\s*\"(?P<name>\w+)\""),
    Rule("expo_modules", "module", ("swift", "kt"), r"\bName\(\s*\"(?P<name>\w+)\""),
    Rule("express", "route", _JS, rf"\b(?:app|router|server|api|route)\.(?P<verb>{_VERBS}|use)\(\s*{_Q}(?P<path>[^'\"`]*){_Q}(?:\s*,\s*[\w.]+)*?\s*,\s*(?:(?P<handler>[\w.]+)\s*\)|(?:async\s*)?(?:\(|function))"),
    Rule("fabric", "component", _JS, rf"\bcodegenNativeComponent(?:<[^>]*>)?\(\s*{_Q}(?P<name>\w+)"),
    Rule("go", "route", ("go",), rf"\.(?P<verb>GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete|Any|HandleFunc|Handle)\(\s*\"(?P<path>[^\"]*)\"(?:\s*,\s*[\w.]+)*?\s*,\s*(?:[\w]+\.)*(?P<handler>\w+)\s*\)"),
    Rule("goframe", "route", ("go",), r"g\.Meta\s+`[^`]*path:\"(?P<path>[^\"]+)\"[^`]*method:\"(?P<verb>\w+)\""),
    Rule("spring", "route", ("java", "kt"), r"@(?P<verb>Get|Post|Put|Delete|Patch|Request)Mapping\s*(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?\{?\s*\"(?P<path>[^\"]*)\"[^)]*\))?\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public|private|protected|fun|suspend|\s)*[\w<>\[\], ?]*?(?P<handler>\w+)\s*\("),
    Rule("spring", "reference", ("java", "kt"), r"@Value\(\s*\"\$\{(?P<target>(?P<name>[\w.-]+))"),
    Rule("laravel", "route", ("php",), r"Route::(?P<verb>get|post|put|patch|delete|any)\(\s*['\"](?P<path>[^'\"]*)['\"]\s*,\s*(?:\[\s*[\w\\]+::class\s*,\s*['\"]|['\"]\w+@)(?P<handler>\w+)"),
    Rule("nestjs", "route", ("ts",), r"@(?P<verb>Get|Post|Put|Delete|Patch|All|Query|Mutation|Subscription|MessagePattern|EventPattern|SubscribeMessage)\(\s*(?:['\"`](?P<path>[^'\"`]*)['\"`]|[^)]*)?\)\s*(?:@\w+\([^)]*\)\s*)*(?:public|private|async|\s)*(?P<handler>\w+)\s*\("),
    Rule("play", "route", ("routes",), r"^(?P<verb>GET|POST|PUT|PATCH|DELETE|HEAD)\s+(?P<path>/\S*)\s+[\w.@]*?(?P<handler>\w+)\s*(?:\(|$)"),
    Rule("django", "route", ("py",), r"\b(?:re_)?path\(\s*r?['\"](?P<path>[^'\"]*)['\"]\s*,\s*(?:\w+\.)*?(?P<handler>\w+)(?=\.as_view|\s*[,)])", "ANY"),
    Rule("flask", "route", ("py",), r"@\w+\.route\(\s*['\"](?P<path>[^'\"]*)['\"](?:[^)\n]*methods\s*=\s*\[\s*['\"](?P<verb>\w+))?[^)\n]*\)\s*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(?P<handler>\w+)", "GET"),
    Rule("fastapi", "route", ("py",), r"@\w+\.(?P<verb>get|post|put|patch|delete|websocket)\(\s*['\"](?P<path>[^'\"]*)['\"][^\n]*\)\s*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(?P<handler>\w+)"),
    Rule("react", "route", _JS, r"<Route\b[^>]*\bpath\s*=\s*\{?['\"](?P<path>[^'\"]*)['\"][^>]*\b(?:element\s*=\s*\{\s*<\s*|component\s*=\s*\{\s*)(?P<handler>\w+)", "GET"),
    Rule("react", "component", ("jsx", "tsx", "js"), r"\b(?:function|const|class)\s+(?P<name>[A-Z]\w*)\s*(?:\(|=\s*(?:React\.)?(?:memo|forwardRef)?\(?\(?|extends\s+(?:React\.)?(?:Pure)?Component)"),
    Rule("react_native", "bridge", ("m", "mm"), r"RCT_EXPORT_METHOD\(\s*(?P<name>\w+)"),
    Rule("react_native", "bridge", ("java", "kt"), r"@ReactMethod\s*(?:\([^)]*\)\s*)?(?:public|fun|void|\s)*(?P<name>\w+)\s*\("),
    Rule("react_native", "module", ("m", "mm"), r"RCT_EXPORT_MODULE\(\s*(?P<name>\w+)"),
    Rule("react_native", "reference", _JS, r"\bNativeModules\.(?P<target>\w+)\.(?P<name>\w+)\s*\("),
    Rule("rails", "route", ("rb",), r"^\s*(?P<verb>get|post|put|patch|delete)\s+['\"](?P<path>[^'\"]*)['\"]\s*(?:,\s*to:|=>)\s*['\"][\w/]+#(?P<handler>\w+)"),
    Rule("rails", "reference", ("rb",), r"^\s*(?P<name>has_many|belongs_to|has_one)\s+:(?P<target>\w+)"),
    Rule("rust", "route", ("rs",), r"#\[(?P<verb>get|post|put|patch|delete)\(\s*\"(?P<path>[^\"]*)\"[^\]]*\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)"),
    Rule("rust", "route", ("rs",), r"\.route\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?:\w+::)*(?P<verb>get|post|put|patch|delete)\(\s*(?:\w+::)*(?P<handler>\w+)"),
    Rule("salesforce", "reference", ("js", "html", "cmp"), r"@salesforce/apex/(?P<target>\w+)\.(?P<name>\w+)"),
    Rule("salesforce", "bridge", ("cls",), r"@AuraEnabled(?:\([^)]*\))?\s*(?:public|global|static|\s)*[\w<>]+\s+(?P<name>\w+)\s*\("),
    Rule("svelte", "route", ("svelte",), "", "GET", r"(?:^|/)src/routes/(?P<path>(?:.*/)?)\+page\.svelte$"),
    Rule("svelte", "route", ("ts", "js"), rf"\bexport\s+(?:async\s+)?(?:function|const)\s+(?P<handler>(?P<verb>GET|POST|PUT|PATCH|DELETE))\b"),
    Rule("swiftui", "component", ("swift",), r"\bstruct\s+(?P<name>\w+)\s*:\s*[^{\n]*\bView\b"),
    Rule("uikit", "component", ("swift",), r"\bclass\s+(?P<name>\w+)\s*:\s*UI\w*(?:ViewController|View)\b"),
    Rule("vapor", "route", ("swift",), r"\b(?:app|routes|router|\w*[rR]outes?)\.(?P<verb>get|post|put|patch|delete)\(\s*\"(?P<path>[^\"]*)\"(?:[^)]*use:\s*(?:\w+\.)*(?P<handler>\w+))?"),
    Rule("swift_objc", "bridge", ("swift",), r"@objc(?:\((?P<target>[\w:]+)\))?\s+(?:public|open|override|static|class|\s)*func\s+(?P<name>\w+)"),
    Rule("terraform", "reference", ("tf",), r"\b(?P<name>module|var|local|data)\.(?P<target>[\w-]+)"),
    Rule("vue", "route", _JS, r"\bpath:\s*['\"](?P<path>[^'\"]*)['\"][^}]*?\bcomponent:\s*(?:\(\)\s*=>\s*import\(\s*['\"][^'\"]*?)?(?P<handler>\w+)(?:\.vue)?", "GET"),
    Rule("vue", "route", ("vue",), "", "GET", r"(?:^|/)pages/(?P<path>.+?)(?:/?index)?\.vue$"),
)
_SCHEMA = "path string, framework string, kind string, verb string, route string, name string, target string, line int"


def claims(files: DataFrame) -> DataFrame:
    """(path, framework, kind, verb, route, name, target, line) of what the rules find in files(path, content); name is a route's handler. Null contents hold nothing; a file in a form of several frameworks gives rows of each."""
    compiled = [(r, re.compile(r.pattern, re.M) if r.pattern else None, re.compile(r.by_path) if r.by_path else None) for r in RULES]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f.path, f.content, strict=True):
                path, text = path or "", content or ""
                ending = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1]
                for rule, pattern, place in compiled:
                    if ending not in rule.endings:
                        continue
                    if place and (m := place.search(path)):
                        rows.append((path, rule.framework, rule.kind, rule.verb, "/" + m["path"].strip("/"), None, None, 1))
                    for m in pattern.finditer(text) if pattern else ():
                        g = m.groupdict()
                        verb = (g.get("verb") or rule.verb).upper() if rule.kind == "route" else None
                        route = (g.get("path") or "") if rule.kind == "route" else None
                        name = g.get("handler").rsplit(".", 1)[-1] if g.get("handler") else g.get("name")
                        rows.append((path, rule.framework, rule.kind, verb, route, name, g.get("target"), text.count("\n", 0, m.start()) + 1))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")]).astype({"line": "Int32"})

    return files.select("path", "content").mapInPandas(run, _SCHEMA)


def route_edges(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, kind, framework): from each route, named verb and path, to its handler; a function of the same file before others, then the smallest id."""
    r = found.where("kind = 'route' and name is not null").select("path", "framework", F.concat_ws(" ", "verb", "route").alias("route"), "name").distinct()
    s = symbols.where("kind in ('Function', 'Struct')").select("id", F.col("name").alias("known"), "file_path")
    w = Window.partitionBy("path", "framework", "route", "name").orderBy(F.desc("same"), "id")
    both = r.join(s, r.name == s.known).withColumn("same", F.col("path") == F.col("file_path"))
    return both.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.concat(F.lit("route:"), "route").alias("src"), F.col("id").alias("dst"), F.lit("References").alias("kind"), "framework")
