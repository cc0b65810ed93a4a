"""Text sources as DataFrames."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.text import matches_glob

#: Directories that hold no sources of a project's own.
IGNORED = r"(^|/)(node_modules|target|dist|build|\.git|__pycache__|\.venv|vendor)/"
#: Language of a file by its ending.
LANGUAGES = {"py": "python", "rs": "rust", "go": "go", "js": "javascript", "ts": "typescript", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "scala": "scala", "sh": "bash", "lua": "lua", "sql": "sql"}


def scan_directory(spark: SparkSession, root: str, include: tuple[str, ...] = (), forced: tuple[str, ...] = (), exclude: tuple[str, ...] = (), endings: dict[str, str] | None = None) -> DataFrame:
    """(path, language, size, content, content_hash) of files whose ending is known, ignored directories left out.

    Patterns are for paths below the root (see text.path_glob): with `include`
    only what matches is taken, `exclude` is left out, and `forced` is taken
    though its directory is ignored, but not what is excluded. endings add
    languages by ending, or say others.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in (LANGUAGES | (endings or {})).items() for x in kv])
    inside = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    wanted = ~F.col("path").rlike(IGNORED) | matches_glob(inside, *forced)
    if include:
        wanted = wanted & (matches_glob(inside, *include) | matches_glob(inside, *forced))
    wanted = wanted & ~matches_glob(inside, *exclude)
    out = f.where(wanted).withColumn("language", F.try_element_at(known, ending)).where("language is not null")
    return out.select("path", "language", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))


def git_log(lines: DataFrame) -> DataFrame:
    """(commit, path) of lines(file, no, value) as `git log --name-only --format=%H` prints them."""
    sha = F.when(F.col("value").rlike("^[0-9a-f]{40}$"), F.col("value"))
    w = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("commit", F.last(sha, ignorenulls=True).over(w)).where((F.col("value") != "") & sha.isNull() & F.col("commit").isNotNull()).select("commit", F.col("value").alias("path")).distinct()


def lcov(lines: DataFrame) -> DataFrame:
    """(file, line, hits) of lines(file, no, value) of a coverage report; lines that can't be read are left out."""
    w = Window.partitionBy("report").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumnRenamed("file", "report").withColumn("file", F.last(F.when(F.col("value").startswith("SF:"), F.substring("value", 4, 10_000)), ignorenulls=True).over(w))
    part = F.split(F.expr("substring(value, 4)"), ",")
    da = own.where(F.col("value").startswith("DA:")).select("file", F.expr("try_cast(split(substring(value, 4), ',')[0] as int)").alias("line"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("hits"))
    return da.where("file is not null and line is not null and hits is not null")


_SCHEMA = "path string, tag string, name string, qualified_name string, kind string, line int, end_line int, target string"


def _extract(path: str, source: str) -> list[tuple]:
    rows: list[tuple] = []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [(path, "error", path, path, "error", 0, 0, None)]

    def visit(node: ast.AST, outer: list[str], owner: str | None, in_class: bool) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = ".".join([*outer, x.name])
                kind = "Struct" if isinstance(x, ast.ClassDef) else "Function"
                rows.append((path, "node", x.name, name, kind, x.lineno, x.end_lineno, owner))
                if isinstance(x, ast.ClassDef):
                    rows.extend((path, "edge", x.name, name, "Implements", x.lineno, x.lineno, ast.unparse(b)) for b in x.bases)
                visit(x, [*outer, x.name], name, isinstance(x, ast.ClassDef))
                continue
            if isinstance(x, ast.Call) and owner and not in_class:
                f = x.func
                target = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
                if target:
                    rows.append((path, "edge", owner, owner, "Calls", x.lineno, x.lineno, target))
            if isinstance(x, (ast.Import, ast.ImportFrom)):
                base = f"{x.module}." if isinstance(x, ast.ImportFrom) and x.module else ""
                rows.extend((path, "edge", path, path, "Imports", x.lineno, x.lineno, base + a.name) for a in x.names)
            visit(x, outer, owner, in_class)

    visit(tree, [], None, False)
    return rows


def extract_python(files: DataFrame) -> DataFrame:
    """Declarations (tag node) and references by name (tag edge) of files(path, content), by Python's own parser; a file it refuses gives one error row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, c in zip(f.path, f.content, strict=True) for r in _extract(p, c or "")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, _SCHEMA)


def resolve(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, id, confidence, how) of references(ref_id, name, path) among symbols(id, name, path).

    Same file and only there 0.95; a name of one symbol 0.9; several: the one
    of the nearest path, by shared directories, 0.7 with two shared or more,
    else 0.4; no exact name but one in lower case 0.5.
    """
    r, s = references.alias("r"), symbols.select("id", "name", F.col("path").alias("at")).alias("s")
    shared = F.aggregate(F.zip_with(F.split("r.path", "/"), F.split("s.at", "/"), lambda a, b: a.eqNullSafe(b)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda t, x: F.struct((t["n"] + F.when(t["on"] & x, 1).otherwise(0)).alias("n"), (t["on"] & x).alias("on")), lambda t: t["n"])
    exact = r.join(s, F.col("r.name") == F.col("s.name")).select("ref_id", "id", (F.col("r.path") == F.col("s.at")).alias("same"), shared.alias("shared"))
    w = Window.partitionBy("ref_id")
    ranked = exact.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("same"), F.desc("shared"), "id")))
    best = ranked.where("k = 1").select("ref_id", "id", F.when(F.col("same"), 0.95).when(F.col("n") == 1, 0.9).when(F.col("shared") >= 2, 0.7).otherwise(0.4).alias("confidence"), F.lit("exact").alias("how"))
    low = symbols.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
    rest = references.join(best.select("ref_id"), "ref_id", "left_anti").withColumn("low", F.lower("name"))
    return best.unionByName(rest.join(low, "low").select("ref_id", "id", F.lit(0.5).alias("confidence"), F.lit("fuzzy").alias("how")))
