"""Traversals and graph algorithms as loops of joins.

Each round joins a frontier with the edges, drops what is known by an
anti-join and is written to the shared folder; the edges are never collected.
All functions take edges(src, dst, ...) and sets as DataFrames with column id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import resident
from codeloom.plans.cut import cut, cut_by, drop
from codeloom.plans.snapshot import Snapshot


def reversed_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(reversed_edges(edges))


#: Rounds of a traversal after which what is known is written as one table.
ROUNDS_A_TABLE = 8


class _Known:
    """What a traversal has found: a table for each round, joined into one now and then."""

    def __init__(self, first: DataFrame):
        self.tables = [first]

    def all(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out

    def add(self, new: DataFrame) -> None:
        self.tables.append(new)
        if len(self.tables) > ROUNDS_A_TABLE:
            old = self.tables
            self.tables = [cut(self.all())]
            drop(*old[:-1])  # the last one is the frontier that the next round reads


def bfs(edges: DataFrame | Snapshot, seeds: DataFrame, most: int | None = None, kept: bool = False) -> DataFrame:
    """(id, depth): least number of hops from any seed, seeds at 0; `most` bounds the hops. The edges are read once, those of a snapshot where they lie; `kept` says that they are a table already."""
    if isinstance(edges, Snapshot):
        return resident.bfs(edges, seeds, most)
    links = edges if kept else cut(edges.select("src", "dst"))  # parallel edges lead to one row of a frontier
    frontier = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    known, depth = _Known(frontier), 0
    while most is None or depth < most:
        depth += 1
        new = links.join(frontier.select("id"), links.src == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(new.join(known.all(), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        known.add(frontier)
    return known.all()


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ids that at least one edge leads to from the seeds; a seed is in only if an edge reaches it. The edges are read once."""
    links = cut(edges.select("src", "dst").distinct())
    known, frontier = None, seeds.select("id").distinct()
    while True:
        new = links.join(frontier, links.src == frontier.id, "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(new if known is None else new.join(known.all(), "id", "left_anti"))
        if known is None:
            known = _Known(frontier)
        elif not frontier.limit(1).count():
            return known.all()
        else:
            known.add(frontier)


def compile_pattern(pattern: str) -> tuple[list[tuple[int, str, int]], list[set[int]], int]:
    """Transitions (state, kind, next), the states empty moves lead to from each, and the last state, of atoms K, K+, K*, any."""
    moves, empty, state = [], [], 0
    for atom in pattern.split():
        m = re.fullmatch(r"(\w+)([+*]?)", atom)
        if not m:
            raise ValueError(f"not a pattern: {atom!r}")
        moves.append((state, m[1], state + 1))
        if m[2]:
            moves.append((state + 1, m[1], state + 1))
        if m[2] == "*":
            empty.append((state, state + 1))
        state += 1
    reach = [{i} for i in range(state + 1)]
    for i in reversed(range(state + 1)):
        for a, b in empty:
            if a == i:
                reach[i] |= reach[b]
    return moves, reach, state


def reachable(edges: DataFrame | Snapshot, seeds: DataFrame, pattern: str, incoming: bool = False) -> DataFrame:
    """Ids that a path whose kinds spell the pattern leads to; a seed is in if the empty path does.

    A round joins the frontier with the automaton and what it then waits for
    with the edges by node; only edges of the pattern's kinds are kept.
    """
    moves, reach, last = compile_pattern(pattern)
    steps = [(a, k, c) for a, k, b in moves for c in sorted(reach[b])]
    if isinstance(edges, Snapshot):
        return resident.reachable(edges, seeds, steps, sorted(reach[0]), last, incoming)
    spark = edges.sparkSession
    nfa = F.broadcast(spark.createDataFrame(steps or [(-1, "", -1)], "state int, label string, next int"))  # as long as the pattern
    labels = {k for _, k, _ in steps}
    e = (reversed_edges(edges) if incoming else edges).select("src", "dst", "kind")
    e = cut((e if "any" in labels else e.where(F.col("kind").isin(*labels))).distinct())
    frontier = cut(seeds.select("id").distinct().withColumn("state", F.explode(F.array(*[F.lit(s) for s in sorted(reach[0])]))))
    known = _Known(frontier)
    while True:
        at = frontier.join(nfa, "state").select(F.col("id").alias("src"), "label", "next")
        met = e.join(at, "src").where("label = 'any' or kind = label")
        new = met.select(F.col("dst").alias("id"), F.col("next").alias("state")).distinct()
        frontier = cut(new.join(known.all(), ["id", "state"], "left_anti"))
        if not frontier.limit(1).count():
            return known.all().where(F.col("state") == last).select("id").distinct()
        known.add(frontier)


def shortest_distances(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, distance) by weight from the seeds: rounds of relaxation of what changed, until nothing does.

    A round writes improvements only; the least of a node's is its distance. A
    cycle of negative weight has no least distance and is an error.
    """
    edges = cut(edges.select("src", "dst", "weight"))
    changed = cut(seeds.select("id").distinct().withColumn("distance", F.lit(0.0)))
    known, hops, n = _Known(changed), 0, None
    while True:
        step = edges.join(changed, edges.src == changed.id).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
        have = known.all().groupBy("id").agg(F.min("distance").alias("distance"))
        better = step.join(have, "id", "left").where("distance is null or new < distance")
        changed = cut(better.select("id", F.col("new").alias("distance")))
        if not changed.limit(1).count():
            return known.all().groupBy("id").agg(F.min("distance").alias("distance"))
        known.add(changed)
        hops += 1
        if hops % ROUNDS_A_TABLE == 0:  # a path without a cycle has fewer hops than there are nodes
            n = n or edges.select("src").union(edges.select("dst")).union(seeds.select("id")).distinct().count()
            if hops >= n:
                raise ValueError("a cycle of negative weight")


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(path) of all simple paths of `most` hops at most from a source to a target, which ends a path."""
    links = edges.select("src", "dst").distinct()
    open_ = sources.select(F.array("id").alias("path"), F.col("id").alias("at"))
    ends, found = targets.select(F.col("id").alias("at")).distinct(), None
    for _ in range(most):
        grown = open_.join(links, open_["at"] == links.src).where(~F.array_contains("path", F.col("dst")))
        grown = cut(grown.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
        done = grown.join(ends, "at", "left_semi").select("path")
        found = done if found is None else found.unionByName(done)
        open_ = grown.join(ends, "at", "left_anti")
    return found


def components(edges: DataFrame | Snapshot) -> DataFrame:
    """(id, component): weakly connected components by least label and pointer jumping."""
    if isinstance(edges, Snapshot):
        return resident.components(edges)
    links = cut(both_ways(edges.select("src", "dst")).distinct())
    label = cut(links.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("component")))
    past = [label]  # tables of the round before
    while True:
        near = links.join(label, links.dst == label.id).groupBy("src").agg(F.min("component").alias("m"))
        low = cut(label.join(near, label.id == near.src).select("id", F.col("component").alias("old"), F.least("component", "m").alias("c")))
        up = low.select(F.col("id").alias("x"), F.col("c").alias("up"))
        new = cut(low.join(up, low.c == up.x).select("id", "old", F.least("c", "up").alias("component")))
        drop(low, *past)
        label, past = new.select("id", "component"), [new]
        if not new.where("component <> old").limit(1).count():
            drop(links)
            return label


def _without_starts(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids but those that only nodes which nothing leads to lead to. A node that one edge leads to follows it, so a chain of any length goes at once, by doubling."""
    into = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("only"))
    base = cut(ids.join(into, "id", "left"))
    now = cut(base.select("id", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("id")).alias("head")))
    n, rounds = now.count(), 0
    while 1 << rounds < n:
        far = now.select(F.col("id").alias("head"), F.col("head").alias("far"))
        new = cut(now.join(far, "head").select("id", F.col("far").alias("head"), (F.col("far") != F.col("head")).alias("moved")))
        drop(now)
        now, rounds = new, rounds + 1
        if not new.where("moved").limit(1).count():
            break
    starts = base.where("n is null").select(F.col("id").alias("head"))
    out = cut(now.select("id", "head").join(starts, "head", "left_anti").select("id"))
    drop(base, now)
    return out


#: Rounds in which ends are peeled off one layer at a time, before chains are looked for.
PEELED = 3


def _on_cycles(links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and ids without the nodes that nothing leads to or that lead to nothing, until there are none."""
    n, rounds = ids.count(), 0
    first = links
    while n:
        rounds += 1
        if rounds <= PEELED:
            kept = cut(links.select(F.col("src").alias("id")).distinct().join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_semi"))
        else:
            half = _without_starts(links, ids)
            inner = cut(_within(links, half))
            kept = _without_starts(reversed_edges(inner), half)
            drop(half, inner)
        left = kept.count()
        more = links if left == n else cut(_within(links, kept))
        if links is not first and more is not links:
            drop(links)
        links, ids = more, kept
        if left == n:
            break
        n = left
    return links, ids


def _within(links: DataFrame, ids: DataFrame) -> DataFrame:
    keep = ids.select(F.col("id").alias("k"))
    return links.join(keep, links.src == keep.k, "left_semi").join(keep, links.dst == keep.k, "left_semi")


def _ancestors(only: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (id, up) of the ancestors 1, 2, 4, ... steps above along only(id, up), of nodes that have one that far; and (id) of the nodes on rings, None if there are none."""
    n, levels = only.count(), [only]
    while True:
        now = levels[-1]
        new = cut(now.join(now.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up")))
        if not new.limit(1).count():
            return levels, None
        levels.append(new)
        if 1 << (len(levels) - 1) >= n:  # no path is that long, so these are on rings and what hangs on them
            return levels, cut(new.select(F.col("up").alias("id")).distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components; the component's name is its largest id.

    A node that one edge leads to can only share a cycle with the node before
    it, so it is left to its head, the first node above that no or several
    edges lead to: the components of the heads are found by colouring, then a
    node below joins its head's if an edge leads back from it or from below
    it. Nodes are lifted to heads, and marks to all above, by tables of jumps
    which hold the nodes that have so long a way only.
    """
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    into = cut(links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("up")))
    levels, ring = _ancestors(cut(into.where("n = 1").select("id", "up")))
    led = links.join(into.where("n > 1").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.col("src").alias("head"))
    for k in reversed(range(len(levels))):
        up = levels[k].select(F.col("id").alias("head"), "up")
        led = led.join(up, "head", "left").select("src", "dst", F.coalesce("up", "head").alias("head"))
        if k % 4 == 0:
            led = cut(led)
    heads = led.select(F.col("head").alias("src"), "dst").where("src <> dst").distinct()
    if ring is not None:  # only nodes of the ring lead into it
        heads = heads.unionByName(links.join(ring.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    whole = cut(_coloured(cut(heads)))
    at = lambda name, col: whole.select(F.col("id").alias(name), F.col("component").alias(col))
    back = led.join(at("head", "a"), "head", "left").join(at("dst", "b"), "dst", "left").select("src", F.coalesce("a", "head").alias("component"), F.coalesce("b", "dst").alias("b"))
    marked = cut(back.where("component = b").select(F.col("src").alias("id"), "component").distinct())
    for up in reversed(levels):
        above = marked.join(up, "id").select(F.col("up").alias("id"), "component")
        new = cut(marked.unionByName(above).distinct())
        drop(marked)
        marked = new
    # the heads of what is marked are marked as well; of two rows of a node one is its own
    held = marked.unionByName(whole).distinct()
    name = held.groupBy("component").agg(F.max("id").alias("name"))
    named = held.join(name, "component").select("id", F.col("name").alias("component"))
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    out = cut(ends.distinct().join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    drop(links, into, led, whole, marked, *levels)
    return out


def _coloured(rest: DataFrame) -> DataFrame:
    """Strong components of distinct edges without loops, by colouring.

    Each round peels off the nodes that no cycle can hold, gives every other
    node the largest id that reaches it and takes, within a colour, what
    reaches back to the node that names it.
    """
    ids = cut(rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct())
    done = ids.limit(0).select("id", F.col("id").alias("component"))
    while True:
        rest, core = _on_cycles(rest, ids)
        alone = ids.join(core, "id", "left_anti").select("id", F.col("id").alias("component"))
        done, ids = cut(done.unionByName(alone)), core
        if not ids.limit(1).count():
            return done
        colour, past = ids.select("id", F.col("id").alias("c")), []
        while True:
            come = rest.join(colour, rest.src == colour.id).groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("m"))
            new = cut(colour.join(come, "id", "left").select("id", "c", F.greatest("c", F.coalesce("m", "c")).alias("c2")))
            drop(*past)
            colour, past = new.select("id", F.col("c2").alias("c")), [new]
            if not new.where("c <> c2").limit(1).count():
                break
        a, b = colour.select(F.col("id").alias("src"), F.col("c").alias("ca")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        inner = cut(rest.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        back = bfs(inner, colour.where("id = c").select("id"))
        found = cut(back.join(colour, "id").select("id", F.col("c").alias("component")))
        more = cut(done.unionByName(found))
        drop(done)
        done, left = more, cut(ids.join(found, "id", "left_anti"))
        drop(inner, found, *past)
        ids, rest = left, cut(_within(rest, left))


def pagerank(nodes: DataFrame, edges: DataFrame | Snapshot, rounds: int = 50, damping: float = 0.85) -> DataFrame:
    """(id, rank): predecessors count once, out-degrees count parallel edges; what dangling nodes hold is dealt to all. Of a snapshot, its own nodes are ranked."""
    if isinstance(edges, Snapshot):
        return resident.pagerank(edges, rounds, damping)
    ids = cut(nodes.select("id"))
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    # dealt by src once: pairs, their degrees and the rounds need no other exchange of the edges
    pairs = edges.select("src", "dst").repartition(4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    links = cut_by(pairs.select("src", "dst", F.sum("n").over(Window.partitionBy("src")).alias("deg")), "src")
    degree = links.groupBy(F.col("src").alias("id")).agg(F.first("deg").alias("deg"))
    rank = cut(ids.join(degree, "id", "left").select("id", F.col("deg").isNull().alias("dangling"), F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(rounds):
        # what dangling nodes hold is one row, joined inside the round's plan
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        come = links.join(rank.select(F.col("id").alias("src"), "rank").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("s"))
        base = (1 - damping) / n + damping * F.col("lost") / n
        new = cut(rank.join(come, "id", "left").crossJoin(F.broadcast(lost)).select("id", "dangling", (base + damping * F.coalesce("s", F.lit(0.0))).alias("rank")))
        drop(rank)
        rank = new
    drop(links)
    return rank.select("id", "rank")


def topological_levels(edges: DataFrame) -> DataFrame:
    """(id, level): longest path from a source; nodes on or behind a cycle are missing. A round for each level; a round's tables replace those before."""
    rest = cut(edges.select("src", "dst").distinct())
    ids = cut(rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct())
    known, level = None, 0
    while True:
        free = ids.join(rest.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        own = cut(free.withColumn("level", F.lit(level)))
        if not own.limit(1).count():
            drop(ids, rest)
            return own if known is None else known.all()
        if known is None:
            known = _Known(own)
        else:
            known.add(own)
        left = cut(ids.join(own, "id", "left_anti"))
        more = cut(rest.join(own.select(F.col("id").alias("src")), "src", "left_anti"))
        drop(ids, rest)
        ids, rest, level = left, more, level + 1


def condensation(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct edges between different components of parts(id, component)."""
    a, b = parts.select(F.col("id").alias("src"), F.col("component").alias("a")), parts.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def top_by(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(k)


def first_in_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
