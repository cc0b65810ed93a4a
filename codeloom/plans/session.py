"""A session on one graph: the tools by name, a bounded history of queries, results kept by generation, passes in order, capabilities."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import context, facade, lookup, mining, paths, traverse
from codeloom.plans.cut import cut, drop
from codeloom.plans.dsl import Engine
from codeloom.plans.graph import CALL_KINDS, PropertyGraph


class Capabilities:
    """Names that are on unless turned off; turning one off turns off what needs it, and gives back their names."""

    def __init__(self, needs: dict[str, tuple[str, ...]], off: tuple[str, ...] = ()):
        self.needs = needs
        self.on = set(needs) | {x for v in needs.values() for x in v}
        for name in off:
            self.disable(name)

    def disable(self, name: str) -> list[str]:
        self.on.discard(name)
        also = sorted(x for x in self.on if name in self.needs.get(x, ()))
        return [y for x in also for y in (x, *self.disable(x))]

    def enable(self, name: str) -> None:
        if missing := [x for x in self.needs.get(name, ()) if x not in self.on]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        self.on.add(name)

    def require(self, name: str) -> None:
        if name not in self.on:
            raise PermissionError(f"{name} is turned off")


@dataclass(frozen=True)
class Pass:
    """A builder of tables: what it needs, what it gives, and how."""

    name: str
    requires: tuple[str, ...]
    provides: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def run_passes(passes: list[Pass], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with those of all passes, each run once what it needs is there; a pass that never can, or does not give what it says, is an error."""
    have, left = dict(tables), list(passes)
    while left:
        ready = [p for p in left if all(r in have for r in p.requires)]
        if not ready:
            raise ValueError("nothing provides " + ", ".join(sorted({r for p in left for r in p.requires if r not in have})))
        for p in ready:
            made = p.run(have)
            if lost := [x for x in p.provides if x not in made]:
                raise ValueError(f"{p.name} does not provide {', '.join(lost)}")
            have.update(made)
            left.remove(p)
    return have


class QueryCache:
    """Results of queries, written once and kept by query and generation; those that read a changed file go first, then the oldest."""

    def __init__(self, capacity: int = 64):
        self.capacity, self.kept = capacity, OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str, generation: int, make: Callable[[], DataFrame], reads: frozenset[str] | None = None) -> DataFrame:
        """reads are the files that the result depends on, None for all."""
        if (at := (key, generation)) in self.kept:
            self.hits += 1
            self.kept.move_to_end(at)
            return self.kept[at][0]
        self.misses += 1
        self.kept[at] = (cut(make()), reads)
        while len(self.kept) > self.capacity:
            drop(self.kept.popitem(last=False)[1][0])
        return self.kept[at][0]

    def advance(self, old: int, new: int, changed: set[str]) -> int:
        """Carry results over to a new generation unless they read a changed file; how many were dropped."""
        lost = 0
        for (key, g), (df, reads) in list(self.kept.items()):
            if g == old:
                del self.kept[key, g]
                if reads is None or reads & changed:
                    drop(df)
                    lost += 1
                else:
                    self.kept[key, new] = (df, reads)
        return lost


@dataclass
class Session:
    """The tools on a graph. docs(path, content) serve grep, overlays go to a new session."""

    graph: PropertyGraph
    docs: DataFrame | None = None
    generation: int = 0
    remembered: int = 100
    capabilities: Capabilities = field(default_factory=lambda: Capabilities({"query": (), "search": (), "context": ("search",), "explore": ("context",), "grep": (), "impact": ()}))

    def __post_init__(self):
        self.history, self.cache = deque(maxlen=self.remembered), QueryCache()

    def query(self, text: str) -> DataFrame:
        self.capabilities.require("query")
        self.history.append(text)
        return self.cache.get(text, self.generation, lambda: Engine(self.graph).query(text))

    def search(self, text: str, limit: int = 20, offset: int = 0) -> DataFrame:
        self.capabilities.require("search")
        return lookup.find(self.graph.nodes, text, limit, offset)

    def context(self, task: str, **options) -> DataFrame:
        self.capabilities.require("context")
        return context.build(self.graph, task, **options)

    def explore(self, task: str) -> DataFrame:
        self.capabilities.require("explore")
        return context.explore_files(self.graph, task)

    def suggest(self, prompt: str, limit: int = 5) -> DataFrame:
        """(id, name): symbols that a prompt names, by name."""
        named = context.names_in(prompt)
        return lookup.exact_names(self.graph.nodes, named, limit).select("id", "name").orderBy("name", "id").limit(limit)

    def grep(self, pattern: str, path_part: str = "") -> DataFrame:
        self.capabilities.require("grep")
        if self.docs is None:
            raise ValueError("the session has no texts")
        return lookup.grep_symbols(self.docs, self.graph.nodes, pattern, path_part)

    def outline(self, file: str) -> DataFrame:
        return lookup.outline(self.graph.nodes, file)

    def _ids(self, name: str) -> DataFrame:
        return self.graph.nodes.where((F.col("name") == name) | (F.col("id") == name)).select("id")

    def callers(self, name: str, depth: int = 1) -> DataFrame:
        return traverse.bfs(traverse.reversed_edges(self.graph.edges_of_kind(*CALL_KINDS)), self._ids(name), depth).where("depth > 0")

    def callees(self, name: str, depth: int = 1) -> DataFrame:
        return traverse.bfs(self.graph.edges_of_kind(*CALL_KINDS), self._ids(name), depth).where("depth > 0")

    def impact(self, name: str, depth: int = 3) -> DataFrame:
        self.capabilities.require("impact")
        return paths.impact(self.graph.edges, self._ids(name), depth)

    def node(self, name: str) -> DataFrame:
        return facade.node_context(self.graph, self._ids(name))

    def files(self) -> DataFrame:
        """(file_path, symbols)"""
        return self.graph.nodes.groupBy("file_path").agg(F.count("*").alias("symbols"))

    def status(self) -> DataFrame:
        """One row (nodes, edges, files, generation)."""
        n = self.graph.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"))
        return n.join(self.graph.edges.agg(F.count("*").alias("edges"))).select("nodes", "edges", "files", F.lit(self.generation).alias("generation"))  # one row each

    def overlay(self, nodes: DataFrame, edges: DataFrame) -> Session:
        """A session that sees a branch: its nodes replace those of the same id, edges of their sources with them."""
        kept = self.graph.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti")
        return Session(PropertyGraph(mining.overlay(self.graph.nodes, nodes, "id"), kept.unionByName(edges)), self.docs, self.generation + 1, self.remembered, self.capabilities)
