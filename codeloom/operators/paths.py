"""Paths between sets of nodes, what depends on a node, redundant edges and ranks around seeds, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.traverse import bfs, both_ways, reversed_edges, shortest_distances
from codeloom.plans.cut import cut, drop

#: Hops of a path where none are given.
HOPS = 32


def _trees(links: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(source, id, parent, depth) of shortest paths from each source of seeds(source, id); ties to the smallest parent."""
    kind = links.schema["src"].dataType
    seen = cut(seeds.select("source", "id").distinct().select("source", "id", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth")))
    frontier = seen
    for depth in range(1, most + 1):
        at = frontier.select("source", F.col("id").alias("src"))
        new = links.join(at, "src").groupBy("source", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = cut(new.join(seen, ["source", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if not new.limit(1).count():
            break
        seen, frontier = cut(seen.unionByName(new)), new
    return seen


def _walk_back(trees: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, path) of trees to each of targets(id) that they hold."""
    hits = trees.join(targets.select("id").distinct(), "id", "left_semi")
    open_ = cut(hits.select("source", F.col("id").alias("target"), "parent", F.array("id").alias("path")))
    done, step = None, trees.select("source", F.col("id").alias("parent"), F.col("parent").alias("up"))
    while open_.limit(1).count():
        own = open_.where("parent is null").select("source", "target", "path")
        done = own if done is None else done.unionByName(own)
        open_ = cut(open_.join(step, ["source", "parent"]).select("source", "target", F.col("up").alias("parent"), F.concat(F.array("parent"), "path").alias("path")))
    return open_.select("source", "target", "path") if done is None else done


def _links(edges: DataFrame) -> DataFrame:
    """Edges as they are: repeats fall out of the rounds."""
    return cut(edges.select("src", "dst"))


def _ahead(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(src, dst), each once, of the edges that paths of `most` hops at most from the sources may take."""
    links = _links(edges)
    near = bfs(links, sources, most - 1, kept=True).select(F.col("id").alias("src"))
    out = cut(links.join(near, "src", "left_semi").select("src", "dst").distinct())
    drop(links)
    return out


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int = HOPS) -> DataFrame:
    """(source, target, path): one path with fewest hops for each pair that has one of `most` hops at most; a node leads to itself in none."""
    trees = _trees(_links(edges), sources.select(F.col("id").alias("source"), "id"), most)
    return _walk_back(trees, targets)


def nearest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int = HOPS) -> DataFrame:
    """(target, path): for each target a path with fewest hops from any source."""
    trees = _trees(_links(edges), sources.select(F.lit(0).alias("source"), "id"), most)
    return _walk_back(trees, targets).select("target", "path")


def all_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int = HOPS) -> DataFrame:
    """(source, target, path): every simple path of `most` hops at most, for each pair; their number may be exponential.

    A path grows only to nodes from which the hops left suffice to a target,
    which are searched for among what the sources lead to.
    """
    links = _ahead(edges, sources, most)
    ends = targets.select("id").distinct()
    left = cut(bfs(reversed_edges(links), ends, most, kept=True))
    usable = cut(links.join(left.select(F.col("id").alias("dst"), F.col("depth").alias("left")), "dst"))
    open_ = cut(sources.select("id").distinct().select(F.col("id").alias("source"), F.col("id").alias("at"), F.array("id").alias("path")))
    done, hops = None, 0
    while open_.limit(1).count():
        own = open_.join(ends.select(F.col("id").alias("at")), "at", "left_semi").select("source", F.col("at").alias("target"), "path")
        done = own if done is None else done.unionByName(own)
        hops += 1
        near = usable.where(F.col("left") + hops <= most)
        grown = open_.join(near, open_["at"] == near.src).where(~F.array_contains("path", F.col("dst")))
        open_ = cut(grown.select("source", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")))
    return open_.select("source", F.col("at").alias("target"), "path") if done is None else done


def _hops(paths: DataFrame) -> DataFrame:
    """(path, src, dst) of the edges of each path."""
    at = paths.select("path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    return at.select("path", F.element_at("path", F.col("k")).alias("src"), F.element_at("path", F.col("k") + 1).alias("dst"))


def through_kind(paths: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Paths whose nodes between the ends are all of the kind."""
    inner = paths.where("size(path) > 2").select("path", F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("id"))
    bad = inner.join(nodes.where(F.col("kind") == kind).select("id"), "id", "left_anti").select("path").distinct()
    return paths.join(bad, "path", "left_anti")


def via_edge(paths: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Paths with at least one edge of the kind."""
    good = _hops(paths.where("size(path) > 1")).join(edges.where(F.col("kind") == kind).select("src", "dst").distinct(), ["src", "dst"], "left_semi").select("path").distinct()
    return paths.join(good, "path", "left_semi")


def _bounded_search(links: DataFrame, sources: DataFrame, ends: DataFrame, k: int, most: int, done: DataFrame | None, keep: int | None) -> tuple[DataFrame, bool]:
    """(source, target, path, cost) of simple paths that may be among the k cheapest, and whether any was left out for `keep`.

    links carry near, the least cost from dst to a target, and hops, the fewest.
    A path is dropped once its cost and what it must still cost are above the
    k-th cheapest found; with `keep`, each node keeps that many paths a source.
    """
    open_ = cut(sources.select("id").distinct().select(F.col("id").alias("source"), F.col("id").alias("at"), F.array("id").alias("path"), F.lit(0.0).alias("cost")))
    cut_off, hops = False, 0
    columns = ["source", "target", "path", "cost"]
    while open_.limit(1).count():
        own = open_.join(ends.select(F.col("id").alias("at")), "at", "left_semi").select("source", F.col("at").alias("target"), "path", "cost")
        found = own if done is None else done.unionByName(own).dropDuplicates(["path"])
        done = cut(found.orderBy("cost", "path").limit(k).select(columns))
        last = done.agg(F.count("*").alias("n"), F.max("cost").alias("c")).first()
        hops += 1
        near = links.where(F.col("hops") + hops <= most)
        grown = open_.join(near, open_["at"] == near.src).where(~F.array_contains("path", F.col("dst")))
        grown = grown.select("source", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("weight")).alias("cost"), "near")
        if last.n == k:  # sums of the same weights in another order may differ in the last bits
            grown = grown.where(F.col("cost") + F.col("near") <= last.c + 1e-9 * (1 + abs(last.c)))
        new = cut(grown.drop("near"))
        if keep:
            order = Window.partitionBy("source", "at").orderBy("cost", "path")
            kept = cut(new.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n"))
            cut_off = cut_off or kept.count() < new.count()
            drop(new)
            new = kept
        drop(open_)
        open_ = new
    return done if done is not None else open_.select("source", F.col("at").alias("target"), "path", "cost"), cut_off


def k_shortest(edges: DataFrame, sources: DataFrame, targets: DataFrame, k: int, most: int = HOPS) -> DataFrame:
    """(source, target, path, cost): the k cheapest simple paths by weight, of parallel edges the lightest; ties by path.

    Least costs to a target, on reversed edges, bound what a path must still
    cost. A first pass keeps the k best paths of each (source, node), which
    gives k costs; if it left any path out, a second one keeps every path that
    these do not rule out, so the result is exact, and paths that cost more
    than the k-th are not listed. A cycle of negative weight is an error.
    """
    light = cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    ends = cut(targets.select("id").distinct())
    back = light.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    near = shortest_distances(back, ends).select(F.col("id").alias("dst"), F.col("distance").alias("near"))
    left = bfs(back, ends, most).select(F.col("id").alias("dst"), F.col("depth").alias("hops"))
    links = cut(light.where("src <> dst").join(near, "dst").join(left, "dst"))
    done, cut_off = _bounded_search(links, sources, ends, k, most, None, k)
    if cut_off:
        done, _ = _bounded_search(links, sources, ends, k, most, done, None)
    return done.orderBy("cost", "path").limit(k)


def avoiding(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of ids(id)."""
    gone = ids.select("id").distinct()
    return edges.join(gone, edges.src == gone.id, "left_anti").join(gone, F.col("dst") == gone.id, "left_anti")


def impact(edges: DataFrame, seeds: DataFrame, most: int = 3) -> DataFrame:
    """(id, depth): what depends on the seeds within `most` hops against edges other than Contains; a reached container's children count at its depth."""
    inner = cut(edges.where("kind = 'Contains'").select("src", "dst").distinct())
    use = cut(edges.where("kind <> 'Contains'").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
    now = bfs(inner, seeds).select("id")
    seen = frontier = cut(now.withColumn("depth", F.lit(0)))
    for depth in range(1, most + 1):
        new = use.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        new = cut(bfs(inner, new).select("id").join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not new.limit(1).count():
            break
        seen, frontier = cut(seen.unionByName(new)), new
    return seen


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, ancestor, depth): the chain of containers of each seed; of several containers the smallest; a cycle ends the chain."""
    up = cut(edges.where("kind = 'Contains'").groupBy(F.col("dst").alias("at")).agg(F.min("src").alias("ancestor")))
    chain = frontier = cut(seeds.select("id").distinct().select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    depth = 0
    while True:
        depth += 1
        new = frontier.select("id", F.col("ancestor").alias("at")).join(up, "at").select("id", "ancestor", F.lit(depth).alias("depth"))
        frontier = cut(new.join(chain, ["id", "ancestor"], "left_anti"))
        if not frontier.limit(1).count():
            return chain.where("depth > 0")
        chain = cut(chain.unionByName(frontier))


def containers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, container, depth): all that contain each seed, at any height, by the shortest way; of several containers all."""
    up = _links(reversed_edges(edges.where("kind = 'Contains'").select("src", "dst")))
    trees = _trees(up, seeds.select(F.col("id").alias("source"), "id"), 1 << 30)
    return trees.where("depth > 0").select(F.col("source").alias("id"), F.col("id").alias("container"), "depth")


def redundant_edges(edges: DataFrame) -> DataFrame:
    """(src, dst): edges whose ends another path of two hops or more joins, one that does not return to its start; parallel edges count once.

    For each start and each node reached, the least and the largest first hop
    of the walks are kept: an edge is redundant where one of them is not its
    own end. Starts with one successor have no redundant edge and are left out.
    """
    links = _links(edges.where("src <> dst"))
    many = links.groupBy("src").agg(F.count("*").alias("n")).where("n > 1")
    own = links.join(many, "src", "left_semi")
    state = cut(own.select(F.col("src").alias("u"), F.col("dst").alias("x"), F.col("dst").alias("low"), F.col("dst").alias("high")))
    frontier = state
    while True:
        step = frontier.join(links, frontier.x == links.src).where("dst <> u").groupBy("u", F.col("dst").alias("x")).agg(F.min("low").alias("low2"), F.max("high").alias("high2"))
        both = cut(state.join(step, ["u", "x"], "full_outer"))
        better = F.col("low").isNull() | (F.col("low2") < F.col("low")) | (F.col("high2") > F.col("high"))
        merged = both.select("u", "x", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high"), F.coalesce(F.col("low2").isNotNull() & better, F.lit(False)).alias("new"))
        state, frontier = merged.drop("new"), merged.where("new").drop("new")
        if not frontier.limit(1).count():
            break
    hit = state.where("low <> x or high <> x").select(F.col("u").alias("src"), F.col("x").alias("dst"))
    return own.join(hit, ["src", "dst"], "left_semi")


def essential_edges(edges: DataFrame) -> DataFrame:
    """Edges without redundant_edges()."""
    return edges.join(redundant_edges(edges), ["src", "dst"], "left_anti")


def ranks_around(edges: DataFrame, seeds: DataFrame, rounds: int = 25, restart: float = 0.25) -> DataFrame:
    """(id, rank): PageRank that restarts at the seeds, on undirected edges; only nodes near enough to have rank."""
    links = cut(both_ways(edges.select("src", "dst").where("src <> dst")).distinct())
    degree = links.groupBy("src").agg(F.count("*").alias("deg"))
    links = cut(links.join(degree, "src"))
    start = cut(seeds.select("id").distinct())
    n = start.count()
    start = start.withColumn("base", F.lit(1.0 / max(n, 1)))
    rank = start.select("id", F.col("base").alias("rank"))
    lone = start.join(degree, start.id == degree.src, "left_anti").select("id", F.lit(True).alias("lone"))
    for _ in range(rounds):
        come = rank.join(links, rank.id == links.src).select(F.col("dst").alias("id"), (F.col("rank") / F.col("deg") * (1 - restart)).alias("rank"))
        kept = rank.join(lone, "id", "left_semi").select("id", (F.col("rank") * (1 - restart)).alias("rank"))
        back = start.select("id", (F.col("base") * restart).alias("rank"))
        rank = cut(come.unionByName(kept).unionByName(back).groupBy("id").agg(F.sum("rank").alias("rank")))
    return rank


def entrypoints(nodes: DataFrame, edges: DataFrame, reach: bool = True) -> DataFrame:
    """(id, entry, fan_in, fan_out[, reach_size, max_depth]) of functions that are entered from outside.

    entry: Test, Bench, FfiExport, Main or PublicApi, the first that holds, by
    the optional columns metadata (map of strings) and visibility, and by name.
    """
    off = F.create_map().cast("map<string,string>")
    meta = F.col("metadata") if "metadata" in nodes.columns else off
    shown = F.col("visibility") if "visibility" in nodes.columns else F.lit(None).cast("string")

    def flag(key: str):
        text = F.lower(F.trim(meta[key]))
        return F.coalesce(~text.isin("", "false", "0"), F.lit(False))

    entry = F.when(flag("test"), "Test").when(flag("bench"), "Bench").when(flag("no_mangle") | flag("extern"), "FfiExport").when(F.col("name") == "main", "Main").when(shown == "Public", "PublicApi")
    own = cut(nodes.where("kind = 'Function'").select("id", entry.alias("entry")).where("entry is not null"))
    fan = lambda end, name: edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))
    out = own.join(fan("dst", "fan_in"), "id", "left").join(fan("src", "fan_out"), "id", "left").na.fill(0, ["fan_in", "fan_out"])
    if not reach:
        return out
    trees = _trees(_links(edges), own.select(F.col("id").alias("source"), "id"), 1 << 20)
    far = trees.groupBy(F.col("source").alias("id")).agg((F.count("*") - 1).alias("reach_size"), F.max("depth").alias("max_depth"))
    return out.join(far, "id")
