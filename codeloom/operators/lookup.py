"""The symbol search: a query is read into filters and words, tiers are tried in turn, hits are scored again and paged."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.scalars import words_of
from codeloom.operators import search
from codeloom.operators.facade import is_low_value, is_test
from codeloom.sources.terms import TermIndex

#: Fields that a query may name, and what kinds add to a score.
FIELDS = {"kind": "kind", "type": "kind", "lang": "language", "language": "language", "path": "file_path", "file": "file_path", "name": "name"}
KIND_BONUS = {"Function": 10, "Struct": 8, "Interface": 9, "Trait": 9, "Enum": 6, "Module": 4, "Constant": 3, "TypeAlias": 6, "Field": 2}


@dataclass
class Parsed:
    words: list[str] = field(default_factory=list)
    filters: dict[str, list[str]] = field(default_factory=dict)


def parse(text: str) -> Parsed:
    """`kind:Function path:"a b" word "two words"`: fields by FIELDS, any case; an unknown field is words."""
    out = Parsed()
    for m in re.finditer(r'(?:(\w+):)?(?:"([^"]*)"|(\S+))', text):
        name, value = (m[1] or "").lower(), m[2] if m[2] is not None else m[3]
        if name in FIELDS:
            out.filters.setdefault(FIELDS[name], []).append(value)
        else:
            out.words += [value] if not m[1] else [m[1], value]
    return out


def filtered(nodes: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """Nodes that pass every axis: one of the kinds or languages named, whatever the case, and a path and name that hold one of the texts."""
    out = nodes
    for column, values in filters.items():
        low = F.lower(F.coalesce(column, F.lit("")))
        one = [low == v.lower() if column in ("kind", "language") else low.contains(v.lower()) for v in values]
        cond = one[0]
        for c in one[1:]:
            cond = cond | c
        out = out.where(cond)
    return out


def kind_bonus(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in KIND_BONUS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0)).cast("double")


def path_relevance(path: Column, words: list[str]) -> Column:
    """+10 where the file's name holds a word, +5 a folder's, +3 any part; -15 for tests that no word asks for."""
    low = F.lower(F.coalesce(path, F.lit("")))
    base, folder = F.regexp_extract(low, r"([^/]*)$", 1), F.regexp_extract(low, r"^(.*)/", 1)
    score = F.lit(0.0)
    for w in (x.lower() for x in words):
        score = score + F.when(base.contains(w), 10.0).when(folder.contains(w), 5.0).when(low.contains(w), 3.0).otherwise(0.0)
    asked = any("test" in w.lower() or "spec" in w.lower() for w in words)
    return score if asked else score - F.when(is_test(path), 15.0).otherwise(0.0)


def name_bonus(name: Column, words: list[str]) -> Column:
    """80 for the name itself, 60 for its beginning, 10 for each word that it holds, 40 at most."""
    low, whole = F.lower(F.coalesce(name, F.lit(""))), " ".join(words).lower()
    held = sum((F.when(low.contains(w.lower()), 10.0).otherwise(0.0) for w in words), F.lit(0.0))
    return F.when(low == whole, 80.0).when(low.startswith(whole), 60.0).otherwise(F.least(held, F.lit(40.0)))


def bm25_fields(nodes: DataFrame, words: list[str], weights: dict[str, float]) -> DataFrame:
    """(id, score): BM25 of the words as prefixes over several columns, each by its weight; one pass over the rows for all words."""
    total = None
    for column, weight in weights.items():
        own = nodes.select("id", words_of(F.col(column)).alias("terms")).withColumn("length", F.size("terms"))
        stats = own.agg(F.count("*").alias("n"), F.greatest(F.avg("length"), F.lit(1e-9)).alias("mean"))
        asked = F.array(*[F.lit(w.lower()) for w in words])
        hit = own.withColumn("q", F.explode(asked)).withColumn("tf", F.size(F.filter("terms", lambda t: t.startswith(F.col("q"))))).where("tf > 0")
        df = hit.groupBy("q").agg(F.count("*").alias("df"))
        row = hit.join(F.broadcast(df), "q").join(F.broadcast(stats))  # as many rows as words, and one
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        part = weight * idf * F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("length") / F.col("mean")))
        one = row.select("id", part.alias("part"))
        total = one if total is None else total.unionByName(one)
    return total.groupBy("id").agg(F.sum("part").alias("score"))


def exact_names(nodes: DataFrame, names: list[str], per_name: int = 20) -> DataFrame:
    """(id, name, score): nodes of exactly these names, whatever the case; 20 more in a file that holds a rare one (in fewer than 10 files); `per_name` of each name."""
    hit = nodes.where(F.lower("name").isin([n.lower() for n in names])).select("id", "name", "file_path", F.lower("name").alias("low"))
    rare = hit.groupBy("low").agg(F.countDistinct("file_path").alias("files")).where("files < 10")
    at = hit.join(rare, "low", "left_semi").groupBy("file_path").agg(F.countDistinct("low").alias("held"))
    scored = hit.join(at, "file_path", "left").withColumn("score", F.when(F.col("held") >= 2, 20.0).otherwise(0.0))
    w = Window.partitionBy("low").orderBy(F.desc("score"), "id")
    return scored.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_name).select("id", "name", "score")


def find(nodes: DataFrame, text: str, limit: int = 20, offset: int = 0, index: TermIndex | None = None) -> DataFrame:
    """(id, name, kind, score): words by BM25 over name and qualified name, or else within names, or else within two edits; filters alone give rows by name.

    With an index of the nodes' words the first tier goes by stems, compounds
    and words that meet in a file, and no row's words are read.

    Hits are scored again by name, kind and path; files of little value lose
    20. Ties by name and id. A tier is tried where the one before has no row.
    """
    q = parse(text)
    rows = filtered(nodes, q.filters)
    if not q.words:
        return rows.orderBy("name", "id").offset(offset).limit(limit).select("id", "name", "kind", F.lit(0.0).alias("score"))
    if index is not None:
        hits = index.search(" ".join(q.words)).join(rows.select("id"), "id", "left_semi")
    else:
        hits = bm25_fields(rows, [w for x in q.words for w in _words(x)] or q.words, {"name": 10.0, "qualified_name": 5.0})
    if not hits.limit(1).count():
        hits = rows.select("id", search.like_score(F.col("name"), " ".join(q.words)).alias("score")).where("score is not null")
        if not hits.limit(1).count():
            near = search.fuzzy(rows, " ".join(q.words))
            hits = rows.join(near.withColumnRenamed("name", "low"), F.lower("name") == F.col("low")).select("id", (1.0 / (1 + F.col("distance"))).alias("score"))
    exact = exact_names(rows, q.words).select("id", F.col("score").alias("extra"))
    scored = rows.join(hits.withColumnRenamed("score", "hit"), "id").join(exact, "id", "left")
    total = F.col("hit") + F.coalesce("extra", F.lit(0.0)) + name_bonus(F.col("name"), q.words) + kind_bonus(F.col("kind")) + path_relevance(F.col("file_path"), q.words) - F.when(is_low_value(F.col("file_path")), 20.0).otherwise(0.0)
    return scored.select("id", "name", "kind", F.round(total, 6).alias("score")).orderBy(F.desc("score"), "name", "id").offset(offset).limit(limit)


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def outline(nodes: DataFrame, file: str) -> DataFrame:
    """The declarations of the files whose path ends so, by line."""
    return nodes.where(F.col("file_path").endswith(file)).orderBy("file_path", "line", "id")


def grep_symbols(docs: DataFrame, symbols: DataFrame, pattern: str, path_part: str = "") -> DataFrame:
    """(path, line, content, id): lines of docs(path, content) that match, with the innermost declaration around each, null outside all."""
    hit = search.grep(docs.where(F.col("path").contains(path_part)), "path", "content", pattern)
    s = symbols.select("id", "file_path", F.col("line").alias("from"), "end_line")
    both = hit.join(s, (F.col("path") == F.col("file_path")) & (F.col("line") >= F.col("from")) & (F.col("line") <= F.col("end_line")), "left")
    w = Window.partitionBy("path", "line").orderBy(F.desc_nulls_last("from"), "end_line", "id")
    return both.withColumn("k", F.row_number().over(w)).where("k = 1").select("path", "line", "content", "id")


def literal_lines(docs: DataFrame, key: str, text: str, literals: list[str]) -> DataFrame:
    """(key, line, content, literal): lines that hold a literal, whatever its case."""
    found = search.lines(docs, key, text)
    return found.withColumn("literal", F.explode(F.array(*[F.lit(x) for x in literals]))).where(F.lower("content").contains(F.lower("literal")))
