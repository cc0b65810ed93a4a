"""Questions about a graph as a whole: contexts, dependencies between files, usages, hierarchies, summaries; and distances between all nodes of a small one."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import paths, structure, traverse
from codeloom.plans.cut import cut, drop
from codeloom.plans.graph import CALL_KINDS, PropertyGraph

#: What marks a test file, and a file of little value, by its path.
TEST_FILE = r"(?i)(^|/)(tests?|__tests__|spec|specs|testing)/|[._-](test|spec|tests)\.[a-z]+$|(^|/)test_[^/]*$|_test\.[a-z]+$"
LOW_VALUE_FILE = r"(?i)(^|/)(node_modules|vendor|dist|build|generated|fixtures|examples?)/|\.min\.|\.d\.ts$|\.(lock|snap|map)$"
HIERARCHY_KINDS = ("Extends", "Implements")


def is_test(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(TEST_FILE)


def is_low_value(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(LOW_VALUE_FILE)


def usages(g: PropertyGraph, ids: DataFrame) -> DataFrame:
    """(id, kind, user, user_name) of every edge into ids(id) but Contains."""
    e = g.edges.where("kind <> 'Contains'").join(ids, g.edges.dst == ids.id, "left_semi")
    return e.join(g.nodes.select(F.col("id").alias("user"), F.col("name").alias("user_name")), e.src == F.col("user")).select(F.col("dst").alias("id"), "kind", "user", "user_name")


def relation_layers(edges: DataFrame, seeds: DataFrame, depth: int, kinds: tuple[str, ...] = (*CALL_KINDS, "References", "Imports"), back: bool = False) -> DataFrame:
    """(id, depth, from, kind) of what the kinds' edges lead to in `depth` hops at most, with the first edge that does: the least of its start and kind. Seeds are not in it."""
    e = edges.where(F.col("kind").isin(*kinds))
    links = cut((traverse.reversed_edges(e) if back else e).select("src", "dst", "kind").distinct())
    known = cut(seeds.select("id").distinct())
    out = frontier = None
    for k in range(1, depth + 1):
        at = (known if frontier is None else frontier).select(F.col("id").alias("src"))
        seen = known if out is None else known.unionByName(out.select("id"))
        new = links.join(at, "src", "left_semi").join(seen, F.col("dst") == F.col("id"), "left_anti")
        frontier = cut(new.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("src", "kind")).alias("e")).select("id", F.lit(k).alias("depth"), F.col("e.src").alias("from"), F.col("e.kind").alias("kind")))
        if not frontier.limit(1).count():
            break
        out = frontier if out is None else out.unionByName(frontier)
    return frontier if out is None else out


def call_graph(g: PropertyGraph, seeds: DataFrame, depth: int) -> DataFrame:
    """The calls between the seeds and what they call or are called by within `depth` hops."""
    both = seeds.select("id")
    for back in (False, True):
        both = both.unionByName(relation_layers(g.edges, seeds, depth, CALL_KINDS, back).select("id"))
    return PropertyGraph(g.nodes, g.edges_of_kind(*CALL_KINDS)).induced(cut(both.distinct()))


def type_hierarchy(g: PropertyGraph, seeds: DataFrame) -> DataFrame:
    """(id, above): what the seeds extend or implement, however far, and what extends or implements them."""
    e = g.edges_of_kind(*HIERARCHY_KINDS)
    up, down = traverse.closure(e, seeds), traverse.closure(traverse.reversed_edges(e), seeds)
    return up.withColumn("above", F.lit(True)).unionByName(down.withColumn("above", F.lit(False)))


def node_context(g: PropertyGraph, seeds: DataFrame) -> DataFrame:
    """(id, role, other, kind): each seed's containers at any height, children, and references in and out, whatever other seeds there are."""
    inner, rest = g.edges_of_kind("Contains"), g.edges.where("kind <> 'Contains'")
    ids = seeds.select("id").distinct()
    pick = lambda e, own, far, role: e.join(ids, e[own] == ids.id, "left_semi").select(F.col(own).alias("id"), F.lit(role).alias("role"), F.col(far).alias("other"), "kind")
    out = pick(inner, "src", "dst", "child").unionByName(pick(rest, "dst", "src", "incoming")).unionByName(pick(rest, "src", "dst", "outgoing"))
    up = paths.containers(g.edges, ids).select("id", F.lit("ancestor").alias("role"), F.col("container").alias("other"), F.lit("Contains").alias("kind"))
    return out.unionByName(up)


def file_edges(g: PropertyGraph) -> DataFrame:
    """(src, dst): distinct pairs of different files of which the first uses a node of the second."""
    at = g.nodes.select("id", "file_path")
    e = g.edges.where("kind <> 'Contains'").select("src", "dst").distinct()
    a, b = at.select(F.col("id").alias("src"), F.col("file_path").alias("a")), at.select(F.col("id").alias("dst"), F.col("file_path").alias("b"))
    return e.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def folder_of(path: str = "file_path") -> Column:
    """The folder of a path, '' where it has none."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*[/:])?[^/:]*$", 1), r"[/:]$", "")


def module_structure(nodes: DataFrame) -> DataFrame:
    """(folder, file_path, n): a row for each file, with the number of files of its folder; a file of none is in ''."""
    files = nodes.select("file_path").distinct().withColumn("folder", folder_of())
    return files.join(files.groupBy("folder").agg(F.count("*").alias("n")), "folder").select("folder", "file_path", "n")


def circular_files(edges: DataFrame) -> DataFrame:
    """(id, component): the files that lead back to themselves through others."""
    parts = traverse.strong_components(edges)
    return parts.join(parts.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "component", "left_semi").select("id", "component")


def top_file(rows: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """(file_path, n): the file with the most rows, if it has `least` of them and that share of all; ties to the smaller path."""
    per = rows.groupBy("file_path").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.orderBy(F.desc("n"), "file_path").limit(1).crossJoin(F.broadcast(total)).where((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("file_path", "n")


def affected_tests(edges: DataFrame, changed: DataFrame, most: int = 5) -> DataFrame:
    """(id, depth): test files that depend on changed(id) over `most` files at most; nothing is followed through a test."""
    links = traverse.reversed_edges(edges).where(~is_test(F.col("src"))).select("src", "dst")
    first = traverse.reversed_edges(edges).join(changed.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
    return traverse.bfs(links.unionByName(first).distinct(), changed, most).where(is_test(F.col("id")) & (F.col("depth") > 0))


def code_slice(docs: DataFrame, key: str, text: str, first: Column, last: Column) -> DataFrame:
    """(key, slice): the lines from first to last of each text."""
    size = F.greatest(last - first + 1, F.lit(0))
    return docs.select(key, F.array_join(F.slice(F.split(text, "\n"), first, size), "\n").alias("slice"))


def architecture(g: PropertyGraph, part: Column) -> DataFrame:
    """(part, definitions, uses, used): nodes of each part, and edges but Contains that leave it for others or come from them; part is a column of the nodes."""
    own = g.nodes.select("id", part.alias("part"))
    defined = own.groupBy("part").agg(F.count("*").alias("definitions"))
    a, b = own.select(F.col("id").alias("src"), F.col("part").alias("a")), own.select(F.col("id").alias("dst"), F.col("part").alias("b"))
    across = g.edges.where("kind <> 'Contains'").join(a, "src").join(b, "dst").where("a <> b")
    ends = across.groupBy("a", "b").agg(F.count("*").alias("n"))
    uses = ends.groupBy(F.col("a").alias("part")).agg(F.sum("n").alias("uses"))
    used = ends.groupBy(F.col("b").alias("part")).agg(F.sum("n").alias("used"))
    return defined.join(uses, "part", "left").join(used, "part", "left").select("part", "definitions", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("used", F.lit(0)).alias("used"))


def first_of_each(rows: DataFrame, keys: list[str], k: int, *order: str) -> DataFrame:
    """At most k rows of each group, in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def xref(g: PropertyGraph, ids: DataFrame, most: int) -> DataFrame:
    """The usages of ids, `most` of each id and kind, by the user's id."""
    return first_of_each(usages(g, ids), ["id", "kind"], most, "user")


def blast_radius(g: PropertyGraph, seeds: DataFrame, depth: int) -> DataFrame:
    """(dependents, files, tests): how many nodes depend on the seeds within `depth` hops, in how many files, of which tests."""
    e = g.edges.where("kind <> 'Contains'")
    near = traverse.bfs(traverse.reversed_edges(e), seeds, depth).where("depth > 0")
    at = near.join(g.nodes, "id")
    return at.agg(F.count("*").alias("dependents"), F.countDistinct("file_path").alias("files"), F.countDistinct(F.when(is_test(F.col("file_path")), F.col("file_path"))).alias("tests"))


def disambiguate(nodes: DataFrame, text: str) -> DataFrame:
    """(id, qualified_name, score): nodes whose qualified name ends with the parts of the text, the whole name first, then by length."""
    want = [p for p in text.replace(".", "::").split("::") if p]
    parts = F.split(F.regexp_replace("qualified_name", r"\.", "::"), "::")
    ends = F.slice(parts, F.greatest(F.size(parts) - len(want) + 1, F.lit(1)), len(want)) == F.array(*[F.lit(p) for p in want])
    score = F.when(F.size(parts) == len(want), 2).otherwise(1)
    return nodes.where(ends).select("id", "qualified_name", score.alias("score")).orderBy(F.desc("score"), F.length("qualified_name"), "id")


def fingerprint(g: PropertyGraph) -> DataFrame:
    """(nodes, edges, digest): counts and a sum of row hashes, the same in any order of rows."""
    part = lambda *cols: F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")
    n = g.nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum(part("id", "kind", "name")), F.lit(0)).alias("x"))
    e = g.edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum(part("src", "dst", "kind")), F.lit(0)).alias("y"))
    return n.crossJoin(e).select("nodes", "edges", (F.col("x") + F.col("y")).alias("digest"))  # one row each


#: Nodes of a graph beyond which distances between all of them are refused, as their number is its square.
MOST_ALL_PAIRS = 2000


def all_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, distance): least weight of a path between every two nodes that have one, by doubling the hops until nothing gets shorter; a node's distance to itself is 0. Over MOST_ALL_PAIRS nodes it is an error."""
    ids = cut(edges.select(F.col("src").alias("a")).union(edges.select("dst")).distinct())
    if (n := ids.count()) > MOST_ALL_PAIRS:
        raise ValueError(f"{n} nodes are too many for all pairs")
    own = ids.select("a", F.col("a").alias("b"), F.lit(0.0).alias("distance"))
    d = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("double").alias("distance")).unionByName(own).groupBy("a", "b").agg(F.min("distance").alias("distance")))
    for _ in range(max(n, 1).bit_length() + 1):
        x, y = d.select("a", F.col("b").alias("m"), F.col("distance").alias("p")), d.select(F.col("a").alias("m"), "b", F.col("distance").alias("q"))
        new = cut(x.join(y, "m").groupBy("a", "b").agg(F.min(F.col("p") + F.col("q")).alias("distance")))
        same = not new.exceptAll(d).limit(1).count()
        drop(d)
        d = new
        if same:
            return d
    raise ValueError("a cycle of negative weight")


def distances_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, distance): least weights from each of sources(id) to all that it leads to, at 0 itself; a graph of any size, since only what sources reach is kept.

    A round relaxes what changed and writes improvements only. A cycle of
    negative weight is an error.
    """
    edges = cut(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    changed = cut(sources.select(F.col("id").alias("source"), "id").distinct().withColumn("distance", F.lit(0.0)))
    known, rounds, n = [changed], 0, None
    best = lambda: functools.reduce(DataFrame.unionByName, known).groupBy("source", "id").agg(F.min("distance").alias("distance"))
    while True:
        step = edges.join(changed.withColumnRenamed("id", "src"), "src").groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
        better = step.join(best(), ["source", "id"], "left").where("distance is null or new < distance")
        changed = cut(better.select("source", "id", F.col("new").alias("distance")))
        if not changed.limit(1).count():
            return best()
        known.append(changed)
        rounds += 1
        if rounds % 8 == 0:
            whole = cut(best())
            drop(*known[:-1])
            known = [whole, changed]
            n = n or edges.select("src").union(edges.select("dst")).union(sources.select("id")).distinct().count()
            if rounds >= n:
                raise ValueError("a cycle of negative weight")


def nearest(edges: DataFrame, seed: DataFrame, n: int) -> DataFrame:
    """(id, distance): the n nodes closest to the seeds by weight, themselves not; ties by id."""
    found = traverse.shortest_distances(edges, seed).join(seed.select("id"), "id", "left_anti")
    return found.orderBy("distance", "id").limit(n)


def post_dominators(edges: DataFrame, leave: DataFrame) -> DataFrame:
    """(id, dominator): what every path from id to the exits of leave(id) passes."""
    return structure.dominators(traverse.reversed_edges(edges), leave)


def strata(rules: DataFrame) -> DataFrame:
    """(id, stratum) of rules(head, body, negated): a head lies no lower than what it needs and higher than what it negates; a cycle through a negation is an error."""
    need = cut(rules.select("head", "body", F.col("negated").cast("int").alias("up")).groupBy("head", "body").agg(F.max("up").alias("up")))
    level = cut(need.select(F.col("head").alias("id")).union(need.select("body")).distinct().withColumn("stratum", F.lit(0)))
    n = level.count()
    while True:
        come = need.join(level, need.body == level.id).groupBy(F.col("head").alias("id")).agg(F.max(F.col("stratum") + F.col("up")).alias("least"))
        new = cut(level.join(come, "id", "left").select("id", F.col("stratum").alias("old"), F.greatest("stratum", F.coalesce("least", F.lit(0))).alias("stratum")))
        top = new.agg(F.max("stratum"), F.count(F.when(F.col("stratum") != F.col("old"), 1))).first()
        level = new.select("id", "stratum")
        if not top[1]:
            return level
        if top[0] > n:
            raise ValueError("a rule negates what needs it")


def page_after(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows by key after one; from the start where after is None."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def hottest(events: DataFrame, item: str, k: int) -> DataFrame:
    """(item, n): the k most frequent, ties by name."""
    return events.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item).limit(k)


def exported_symbols(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, id, name, kind): what files(file_path) show to others: symbols marked exported or public, and those that an edge from another file uses."""
    own = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi")
    shown = F.lit(False)
    if "exported" in nodes.columns:
        shown = shown | F.coalesce(F.col("exported"), F.lit(False))
    if "visibility" in nodes.columns:
        shown = shown | F.coalesce(F.col("visibility") == "Public", F.lit(False))
    at = nodes.select("id", "file_path")
    across = edges.where("kind <> 'Contains'").select("src", "dst").join(at.select(F.col("id").alias("src"), F.col("file_path").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("file_path").alias("b")), "dst").where("a <> b")
    used = own.join(across.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    return own.where(shown).union(used.select(own.columns)).select("file_path", "id", "name", "kind").distinct()


def partial_structs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, struct, used, fields, share): for each function and struct of which it uses some fields, how many, of how many. Fields are contained by structs; any edge to a field uses it."""
    fields = edges.where("kind = 'Contains'").select(F.col("src").alias("struct"), F.col("dst").alias("field")).join(nodes.where("kind = 'Field'").select(F.col("id").alias("field")), "field", "left_semi").distinct()
    sizes = fields.groupBy("struct").agg(F.count("*").alias("fields"))
    own = nodes.where("kind = 'Function'").select(F.col("id").alias("src"))
    uses = edges.where("kind <> 'Contains'").join(own, "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("field")).distinct()
    part = uses.join(fields, "field").groupBy("id", "struct").agg(F.count("*").alias("used")).join(sizes, "struct")
    return part.select("id", "struct", "used", "fields", (F.col("used") / F.col("fields")).alias("share"))


def field_projection(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, struct, field): the fields that the functions wanted(id) use of each struct: what of it a context must show."""
    fields = edges.where("kind = 'Contains'").select(F.col("src").alias("struct"), F.col("dst").alias("field")).join(nodes.where("kind = 'Field'").select(F.col("id").alias("field")), "field", "left_semi")
    uses = edges.where("kind <> 'Contains'").join(wanted.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("field"))
    return uses.join(fields, "field").select("id", "struct", "field").distinct()


def languages_of(files: DataFrame) -> DataFrame:
    """(language, files, nodes, last_indexed) of files(path, language, node_count, indexed_at), a language null where it is not known."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("node_count"), F.lit(0)).alias("nodes"), F.max("indexed_at").alias("last_indexed"))
