"""Contexts: from a task's words to entry symbols, what is around them, and the files worth showing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import lookup, paths, traverse
from codeloom.operators.facade import first_of_each, is_low_value, is_test
from codeloom.plans.cut import cut
from codeloom.plans.graph import CALL_KINDS, TYPE_KINDS, PropertyGraph

#: Edges along which values go, for seeds by data flow.
FLOW_KINDS = ("Calls", "UsesType", "Returns", "TypeOf")
#: Edges given back between the nodes of a context.
SHOWN_KINDS = ("Calls", "Extends", "Implements", "References", "UsesType")
# Points of a node for its file, the least a file needs, and what share of the best rank lets a file in.
NAMED, ENTRY, ADJACENT, OTHER, LEAST_POINTS, RANK_SHARE = 50, 10, 3, 1, 3, 0.06


def names_in(task: str) -> list[str]:
    """Words of a task that look like identifiers: with a capital inside, an underscore, :: or a call's bracket, in order, once each."""
    found = re.findall(r"[A-Za-z_]\w*(?:(?:::|\.)[A-Za-z_]\w*)*\(?", task)
    return list(dict.fromkeys(x.rstrip("(") for x in found if re.search(r"[a-z0-9][A-Z]|_|::|\w\.\w|\($", x) or re.match(r"[A-Z]\w+[A-Z]?\w*$", x) and not x.isupper()))


def expand_types(g: PropertyGraph, seeds: DataFrame, budget: int) -> DataFrame:
    """(id, src, dst): what seed types implement, then the others that implement it, `budget` at most, parents first, by id."""
    own = g.of_kind(*TYPE_KINDS).select("id").join(seeds.select("id"), "id", "left_semi")
    e = g.edges_of_kind("Implements").select("src", "dst").distinct()
    up = e.join(own.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("src")).select("id", "src", F.col("id").alias("dst"), F.lit(0).alias("pass"))
    up = cut(up.orderBy("id").limit(budget))
    down = e.join(up.select(F.col("id").alias("dst")), "dst", "left_semi").join(seeds.select(F.col("id").alias("src")), "src", "left_anti")
    down = down.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("dst")).select("id", F.col("id").alias("src"), "dst", F.lit(1).alias("pass")).join(up.select("id"), "id", "left_anti")
    return up.unionByName(down).orderBy("pass", "id").limit(budget).drop("pass")


def diverse(rows: DataFrame, roots: DataFrame, per_file: int, *order: str) -> DataFrame:
    """rows(id, file_path, ...) with at most `per_file` of a file besides the roots, which stay; 0 keeps all."""
    if not per_file:
        return rows
    marked = rows.join(roots.select("id", F.lit(True).alias("__root")).distinct(), "id", "left")
    first = first_of_each(marked.where("__root is null"), ["file_path"], per_file, *(order or ("id",)))
    return marked.where("__root").unionByName(first).drop("__root")


def capped_tests(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """rows(id, file_path, ...) with at most `most` of test files."""
    tests = is_test(F.col("file_path"))
    return rows.where(~tests).unionByName(rows.where(tests).orderBy(*(order or ("id",))).limit(most))


def recovered_edges(g: PropertyGraph, ids: DataFrame, kinds: tuple[str, ...] = SHOWN_KINDS) -> DataFrame:
    """(src, dst, kind) between ids, once each."""
    return g.induced(ids.select("id")).where(F.col("kind").isin(*kinds) if kinds else F.lit(True)).select("src", "dst", "kind").distinct()


def colocated(rows: DataFrame) -> DataFrame:
    """(id, boost): how many other names of rows(id, name, file_path) are in the same file."""
    held = rows.groupBy("file_path").agg((F.countDistinct(F.lower("name")) - 1).alias("boost"))
    return rows.join(held, "file_path").select("id", "boost")


def flow_seed(g: PropertyGraph, roots: DataFrame, depth: int) -> DataFrame:
    """(id, depth): what the roots take values from or give them to within `depth` hops, without the roots."""
    return traverse.bfs(g.edges_of_kind(*FLOW_KINDS), roots, depth).where("depth > 0")


def entries(g: PropertyGraph, task: str, limit: int = 3, least: float = 0.3) -> DataFrame:
    """(id, name, file_path, score): symbols named in the task first, then hits of its words; tests count 0.3 unless the task asks for them, names in one file add 20 for each other."""
    named = names_in(task)
    hits = lookup.find(g.nodes, " ".join(re.findall(r"\w+", task)), 3 * limit).select("id", "score")
    if named:
        last = [re.split(r"::|\.", n)[-1] for n in named]
        hits = hits.unionByName(lookup.exact_names(g.nodes, last, 5 * limit).select("id", (F.col("score") + 100).alias("score")))
    best = hits.groupBy("id").agg(F.max("score").alias("score"))
    rows = cut(g.nodes.select("id", "name", "file_path").join(best, "id"))
    rows = rows.join(colocated(rows), "id")
    asked = bool(re.search("test|spec", task.lower()))
    score = (F.col("score") + 20 * F.col("boost")) * (1.0 if asked else F.when(is_test(F.col("file_path")), 0.3).otherwise(1.0))
    return rows.select("id", "name", "file_path", F.round(score, 6).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit)


def build(g: PropertyGraph, task: str, limit: int = 3, depth: int = 1, most: int = 20, gate: bool = True) -> DataFrame:
    """(id, role, file_path, distance): entry symbols of a task and what is around them.

    Around means type families (a quarter of `most`) and both directions of
    edges but Contains; a file gives max(5, a fifth of `most`) nodes, tests
    max(3, 15 %). With the gate only entries that refer out of their file or
    to something unresolved are expanded.
    """
    first = cut(entries(g, task, limit))
    roots = first.select("id")
    e = g.edges.where("kind <> 'Contains'").select("src", "dst", "kind")
    grow = roots
    if gate:
        at = g.nodes.select("id", "file_path")
        own = e.join(roots.withColumnRenamed("id", "src"), "src", "left_semi").join(at.toDF("src", "from_file"), "src").join(at.toDF("dst", "to_file"), "dst", "left")
        grow = cut(own.where("kind = 'UnresolvedCall' or to_file is null or to_file <> from_file").select(F.col("src").alias("id")).distinct())
    near = traverse.bfs(traverse.both_ways(e.select("src", "dst")), grow, depth).where("depth > 0")
    family = expand_types(g, grow, max(most // 4, 1)).select("id", F.lit(1).alias("depth"))
    around = near.unionByName(family).groupBy("id").agg(F.min("depth").alias("distance")).join(roots, "id", "left_anti")
    rows = around.join(g.nodes.select("id", "file_path"), "id")
    rows = capped_tests(diverse(rows, roots, max(5, most // 5), "distance", "id"), max(3, most * 15 // 100), "distance", "id")
    rest = rows.orderBy("distance", "id").limit(max(most - limit, 0)).select("id", F.lit("related").alias("role"), "file_path", "distance")
    return first.select("id", F.lit("entry").alias("role"), "file_path", F.lit(0).alias("distance")).unionByName(rest)


def gate_measure(g: PropertyGraph, task: str, **options) -> DataFrame:
    """One row (without_gate, with_gate, saved, abstained): related nodes that the gate kept out."""
    both = [build(g, task, gate=gate, **options).where("role = 'related'").select(F.lit(gate).alias("gate")) for gate in (False, True)]
    n = lambda gate: F.count(F.when(F.col("gate") == gate, 1))
    counts = both[0].unionByName(both[1]).agg(n(False).alias("without_gate"), n(True).alias("with_gate"))
    saved = F.greatest(F.col("without_gate") - F.col("with_gate"), F.lit(0))
    return counts.select("without_gate", "with_gate", saved.alias("saved"), ((F.col("with_gate") < F.col("without_gate")) | (F.col("with_gate") == 0)).alias("abstained"))


def call_paths(g: PropertyGraph, ids: DataFrame, most: int = 6) -> DataFrame:
    """(source, target, path): least paths of calls between ids that stay among them, at most `most` hops."""
    own = ids.select("id").distinct()
    return paths.shortest_paths(g.induced(own).where(F.col("kind").isin(*CALL_KINDS)), own, own, most).where("source <> target")


def explore_files(g: PropertyGraph, task: str, limit: int = 5) -> DataFrame:
    """(file_path, points, rank, hits, place): files of a context in the order worth reading.

    A node gives its file 50 points if the task names it, 10 as an entry, 3
    next to one, else 1; files need 3. Rank restarts at the entries; a file
    stays with 6 % of the best, an entry, or two words of the task. Files of
    little value go where two others stay.
    """
    named = [re.split(r"::|\.", n)[-1].lower() for n in names_in(task)]
    ctx = cut(build(g, task, limit, gate=False).join(g.nodes.select("id", "name"), "id"))
    roots = ctx.where("role = 'entry'").select("id")
    around = g.edges.where("kind <> 'Contains'")
    rank = paths.ranks_around(around, roots, 10)
    point = F.when(F.lower("name").isin(named) if named else F.lit(False), NAMED).when(F.col("role") == "entry", ENTRY).when(F.col("distance") == 1, ADJACENT).otherwise(OTHER)
    words = [w for w in dict.fromkeys(re.findall(r"\w{3,}", task.lower()))]
    held = F.size(F.array_distinct(F.flatten(F.collect_list(F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(F.lower("name"), w))))))
    files = ctx.join(rank, "id", "left").groupBy("file_path").agg(F.sum(point).alias("points"), F.sum(F.coalesce("rank", F.lit(0.0))).alias("rank"), held.alias("hits"), F.max((F.col("role") == "entry").cast("int")).alias("entry"), F.max(point).alias("best"))
    w = Window.partitionBy()  # as many rows as a context has files
    files = files.where(F.col("points") >= LEAST_POINTS).withColumn("top", F.max("rank").over(w)).withColumn("low", is_low_value(F.col("file_path"))).withColumn("good", F.sum((~F.col("low")).cast("int")).over(w))
    kept = files.where((F.col("rank") >= F.col("top") * RANK_SHARE) | (F.col("entry") == 1) | (F.col("hits") >= 2)).where(~F.col("low") | (F.col("good") < 2))
    order = F.row_number().over(Window.orderBy(F.desc(F.col("best") == NAMED), F.desc(F.round(F.col("rank") / F.greatest("top", F.lit(1e-12)), 2)), F.desc("hits"), "low", F.desc("points"), "file_path"))
    return kept.withColumn("place", order).select("file_path", "points", F.round("rank", 6).alias("rank"), "hits", "place")
