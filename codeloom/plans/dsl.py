"""The pipe query language: text to a plan of DataFrames.

    expr   := term { (union | intersect | diff | \\) term }       left to right, one level
    term   := atom { "|" op }
    atom   := fn("x") | type("x") | taint("x") | all | ( expr ) | name | entrypoints [kind=E]
            | an operator below by itself, which works on all nodes
            | path atom -> atom {limit} | paths atom -> atom {limit} | multi_path { atom, ... } -> atom [depth N]
            | dominators of atom | dominates atom | trait_impls of atom
    limit  := where intermediate kind=K | via K | depth N
    op     := callers | callees | depth N | filter kind=K | since R | taint | preconditions
            | hot N | scc | dispatch | trait_impls | affected N since R
            | reachable via "P" [incoming | outgoing] | cluster by type | communities | co_changes
            | untested | possible_types | complexity | cfg | dataflow | show fields|signature|body
    query  := explain query | expr | count expr | sum F expr | avg F expr | top_k_by F K expr | group_by F expr
            | exists expr | forall kind=K expr | edges_of expr | edges_kind K | let x = expr in query
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from codeloom.operators import communities, mining, paths, resident, structure, traverse
from codeloom.plans.graph import CALL_KINDS, EDGE_KINDS, ENTRY_KINDS, NODE_KINDS, TYPE_KINDS, PropertyGraph

_TOKEN = re.compile(r'\s*(?:(?P<str>"[^"]*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>->|→|[|()=\\{},]))')
#: Columns that a query shows; body shows all.
_SHOWN = {"fields": ("id", "kind", "name"), "signature": ("id", "kind", "name", "qualified_name", "file_path"), "body": None}
#: Operators that keep the nodes with a metadata entry, by its key.
_KEPT = {"possible_types": ("possible_input_types", "possible_return_types"), "complexity": ("complexity", "cyclomatic"), "cfg": ("cfg",), "dataflow": ("dataflow",)}
#: Operators that are queries by themselves.
_BARE = ("between", "hot", "scc", "dispatch", "communities", "affected", "co_changes", "untested", "cluster", "since", "filter")
_SETS = {"union": "union", "intersect": "intersect", "diff": "diff", "\\": "diff"}


class QueryError(ValueError):
    pass


@dataclass
class _Reader:
    tokens: list
    at: int = 0
    shown: str = "body"

    @classmethod
    def of(cls, text: str) -> _Reader:
        out, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"can't read {text[at:]!r}")
            out.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        return cls(out)

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        got, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if got == "end" or kind and got != kind or value and text != value:
            raise QueryError(f"expected {value or kind or 'more'}, found {text!r}")
        self.at += 1
        return text[1:-1] if got == "str" else text


def _kind(r: _Reader, known: tuple) -> str:
    got = r.take("name")
    if got not in known:
        raise QueryError(f"unknown kind {got!r}; known: {', '.join(known)}")
    return got


class Engine:
    """Runs queries over a graph. Results are exact; a cap applies last, in order of id."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph

    # sets of ids

    def _ids(self, df: DataFrame) -> DataFrame:
        return df.select("id").distinct()

    def _step(self, w: DataFrame, kinds: tuple, back: bool = False) -> DataFrame:
        if self.graph.snapshot:
            return resident.neighbours(self.graph.snapshot, w, kinds, back)
        e = self.graph.edges_of_kind(*kinds)
        near, far = ("dst", "src") if back else ("src", "dst")
        return e.join(w, e[near] == w.id, "left_semi").select(F.col(far).alias("id")).distinct()

    def _calls(self, w: DataFrame, back: bool = False) -> DataFrame:
        """What calls lead to from a set, or lead to it; the set is in."""
        g = self.graph
        if g.snapshot:
            return self._ids(resident.bfs(g.snapshot, w, kinds=CALL_KINDS, back=back))
        e = g.edges_of_kind(*CALL_KINDS)
        return self._ids(traverse.bfs(traverse.reversed_edges(e) if back else e, w))

    def _arrow(self, r: _Reader, scope: dict) -> DataFrame:
        if r.peek() not in ("->", "→"):
            raise QueryError(f"expected ->, found {r.peek()!r}")
        r.take()
        return self._atom(r, scope)

    def _paths(self, r: _Reader, scope: dict, every: bool) -> DataFrame:
        """Nodes on the paths between two sets that keep to the limits."""
        g = self.graph
        sources, targets = self._atom(r, scope), self._arrow(r, scope)
        kind = edge = None
        most = paths.HOPS
        while r.peek() in ("where", "via", "depth"):
            match r.take():
                case "where":
                    for word in ("intermediate", "kind", "="):
                        r.take(value=word)
                    kind = _kind(r, NODE_KINDS)
                case "via":
                    edge = _kind(r, EDGE_KINDS)
                case _:
                    most = int(r.take("num"))
        found = (paths.all_paths if every else paths.shortest_paths)(g.edges, sources, targets, most)
        if kind:
            found = paths.through_kind(found, g.nodes, kind)
        if edge:
            found = paths.via_edge(found, g.edges, edge)
        return found.select(F.explode("path").alias("id")).distinct()

    def _multi_path(self, r: _Reader, scope: dict) -> DataFrame:
        r.take(value="{")
        sources = self._atom(r, scope)
        while r.peek() == ",":
            r.take()
            if r.peek() != "}":
                sources = sources.union(self._atom(r, scope))
        r.take(value="}")
        targets, most = self._arrow(r, scope), paths.HOPS
        if r.peek() == "depth":
            r.take()
            most = int(r.take("num"))
        return paths.nearest_paths(self.graph.edges, sources, targets, most).select(F.explode("path").alias("id")).distinct()

    def _dominator_pairs(self) -> DataFrame:
        """From `main`, or else from the function that most edges lead to; ties to the smallest id."""
        g = self.graph
        fan = g.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        root = g.of_kind("Function").join(fan, "id", "left").orderBy(F.desc(F.col("name") == "main"), F.desc_nulls_last("n"), "id").limit(1).select("id")
        return structure.dominators(g.edges, root)

    def _entrypoints(self, r: _Reader) -> DataFrame:
        found = paths.entrypoints(self.graph.nodes, self.graph.edges, reach=False)
        if r.peek() == "kind":
            r.take()
            r.take(value="=")
            found = found.where(F.col("entry") == _kind(r, ENTRY_KINDS))
        return self._ids(found)

    def _atom(self, r: _Reader, scope: dict) -> DataFrame:
        word = r.take()
        if word == "(":
            out = self._expr(r, scope)
            r.take(value=")")
            return out
        if word in ("fn", "type"):
            r.take(value="(")
            text = r.take("str")
            r.take(value=")")
            return self._ids(self.graph.named(text, *(("Function",) if word == "fn" else TYPE_KINDS)))
        if word == "all":
            return self._ids(self.graph.nodes)
        if word == "taint" and r.peek() == "(":
            r.take()
            text = r.take("str")
            r.take(value=")")
            return self._calls(self._ids(self.graph.named(text, "Function")))
        match word:
            case "entrypoints":
                return self._entrypoints(r)
            case "path" | "paths":
                return self._paths(r, scope, word == "paths")
            case "multi_path":
                return self._multi_path(r, scope)
            case "dominators":
                r.take(value="of")
                pairs = self._dominator_pairs()
                return pairs.join(self._atom(r, scope), "id", "left_semi").select(F.col("dominator").alias("id")).distinct()
            case "dominates":
                return self._ids(self._dominator_pairs().join(self._atom(r, scope).select(F.col("id").alias("dominator")), "dominator", "left_semi"))
            case "trait_impls":
                r.take(value="of")
                return self._step(self._atom(r, scope), ("Implements",), back=True)
        if word in scope:
            return scope[word]
        if word in _BARE or word in _KEPT:
            r.at -= 1
            return self._op(r, self._ids(self.graph.nodes))
        raise QueryError(f"unknown selector {word!r}")

    def _op(self, r: _Reader, w: DataFrame) -> DataFrame:
        g, word = self.graph, r.take("name")
        nodes = lambda: g.nodes.join(w, "id", "left_semi")
        match word:
            case "callers":
                return self._step(w, CALL_KINDS, back=True)
            case "callees":
                return self._step(w, CALL_KINDS)
            case "depth":
                return self._ids(traverse.bfs(g.adjacency, w, int(r.take("num"))))
            case "filter":
                r.take(value="kind")
                r.take(value="=")
                kind = _kind(r, NODE_KINDS)
                return self._ids(nodes().where(F.col("kind") == kind))
            case "since":
                return self._ids(nodes().where(F.col("revision") >= int(r.take("num"))))
            case "between":
                field, low, high = r.take("name"), float(r.take("num")), float(r.take("num"))
                if g.ranges is not None:
                    return g.ranges.between(field, low, high).select("id").distinct().join(w, "id", "left_semi")
                value = F.col(field).cast("double") if field in g.nodes.columns else g.meta(field).try_cast("double")
                return self._ids(nodes().where(value.between(low, high)))
            case "taint":
                return self._calls(w)
            case "preconditions":
                return self._calls(w, back=True)
            case "hot":
                ranks = traverse.pagerank(g.nodes, g.adjacency).join(w, "id", "left_semi")
                return self._ids(traverse.top_by(ranks, "rank", int(r.take("num")), "id"))
            case "scc":
                # components of the whole graph that touch the set
                parts = traverse.strong_components(g.edges_of_kind(*CALL_KINDS))
                many = parts.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
                touched = parts.join(w, "id", "left_semi").select("component").distinct()
                return self._ids(parts.join(many, "component", "left_semi").join(touched, "component", "left_semi"))
            case "dispatch":
                inner = g.edges_of_kind("Contains").join(g.of_kind("Trait").select(F.col("id").alias("src")), "src", "left_semi").select("dst")
                return self._ids(g.edges_of_kind("Calls").join(inner, "dst", "left_semi").select(F.col("src").alias("id")).join(w, "id", "left_semi"))
            case "trait_impls":
                return self._step(w, ("Implements",), back=True)
            case "affected":
                hops = int(r.take("num"))
                r.take(value="since")
                changed = g.nodes.where(F.col("revision") >= int(r.take("num"))).select("id")
                return self._ids(traverse.bfs(traverse.both_ways(g.edges), changed, hops))  # in place of the set
            case "reachable":
                r.take(value="via")
                pattern = r.take("str")
                incoming = r.peek() == "incoming"
                if r.peek() in ("incoming", "outgoing"):
                    r.take()
                return traverse.reachable(g.adjacency, w, pattern, incoming)
            case "cluster":
                r.take(value="by")
                r.take(value="type")
                return self._ids(communities.clusters_by_type(g.nodes, g.edges).join(w, "id", "left_semi"))
            case "communities":
                return self._ids(self.communities().join(w, "id", "left_semi"))
            case "co_changes":
                return w.union(self._coupled(w)).distinct()
            case "untested":
                return self._ids(nodes().where(F.coalesce(g.meta("coverage_tested"), F.lit("")) != "true"))
            case "entrypoints":
                return self._entrypoints(r).join(w, "id", "left_semi")
            case "show":
                r.shown = r.take("name")
                if r.shown not in _SHOWN:
                    raise QueryError(f"unknown projection {r.shown!r}; known: {', '.join(_SHOWN)}")
                return w
        if word in _KEPT:
            return self._ids(nodes().where(F.coalesce(*[g.meta(k) for k in _KEPT[word]]).isNotNull()))
        raise QueryError(f"unknown operator {word!r}")

    def communities(self) -> DataFrame:
        """(id, community) of the nodes that calls touch."""
        return communities.communities(self.graph.edges_of_kind(*CALL_KINDS))

    def _coupled(self, w: DataFrame) -> DataFrame:
        """Nodes of the files that changed at least twice together with a file of w."""
        g = self.graph
        if g.history is None:
            raise QueryError("co_changes needs a graph with history")
        pairs = mining.co_change(g.history.select("commit", "item"))
        files = g.nodes.join(w, "id", "left_semi").select("file_path").distinct()
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(files, both.a == files.file_path, "left_semi").select(F.col("b").alias("file_path")).distinct()
        return self._ids(g.nodes.join(others, "file_path", "left_semi"))

    def _term(self, r: _Reader, scope: dict) -> DataFrame:
        out = self._atom(r, scope)
        while r.peek() == "|":
            r.take()
            out = self._op(r, out)
        return out

    def _expr(self, r: _Reader, scope: dict) -> DataFrame:
        out = self._term(r, scope)
        while r.peek() in _SETS:
            how, right = _SETS[r.take()], self._term(r, scope)
            out = out.union(right).distinct() if how == "union" else out.intersect(right) if how == "intersect" else out.subtract(right)
        return out

    def _aggregate(self, r: _Reader, scope: dict) -> DataFrame:
        word, g = r.peek(), self.graph
        if word not in ("count", "sum", "avg", "top_k_by", "group_by", "exists", "forall", "edges_of", "edges_kind", "let"):
            return g.nodes.join(self._expr(r, scope), "id", "left_semi")
        r.take()
        if word == "edges_kind":
            return g.edges_of_kind(_kind(r, EDGE_KINDS))
        if word == "let":
            name = r.take("name")
            r.take(value="=")
            value = self._expr(r, scope)
            r.take(value="in")
            return self._aggregate(r, scope | {name: value})
        field = r.take("name") if word in ("sum", "avg", "top_k_by", "group_by") else None
        k = int(r.take("num")) if word == "top_k_by" else 0
        if word == "forall":
            r.take(value="kind")
            r.take(value="=")
            field = _kind(r, NODE_KINDS)
        w = self._expr(r, scope)
        if word == "edges_of":
            out = g.edges.join(w, g.edges.src == w.id, "left_semi")
            return out.unionByName(g.edges.join(w, g.edges.dst == w.id, "left_semi").join(w, g.edges.src == w.id, "left_anti"))
        rows = g.nodes.join(w, "id", "left_semi")
        # a field is a column, or else an entry of the metadata
        value = None if not field or word == "forall" else F.col(field) if field in g.nodes.columns else g.meta(field)
        numeric = field in g.nodes.columns and isinstance(g.nodes.schema[field].dataType, NumericType)
        number = None if value is None else value.cast("double") if numeric else value.cast("string").try_cast("double")
        match word:
            case "count":
                return rows.agg(F.count("*").alias("count"))
            case "sum":
                return rows.agg(F.coalesce(F.sum(number), F.lit(0.0)).alias("sum"))
            case "avg":
                return rows.agg(F.coalesce(F.avg(number), F.lit(0.0)).alias("avg"))
            case "top_k_by":
                return rows.withColumn("__by", number).orderBy(F.desc_nulls_last("__by"), "id").limit(k).drop("__by")
            case "group_by":
                return rows.select(F.coalesce(value.cast("string"), F.lit("")).alias("key"), "id")  # a row a member: a group may be of any size
            case "exists":
                return rows.limit(1).agg((F.count("*") > 0).alias("exists"))
        return rows.agg(F.coalesce(F.bool_and(F.col("kind") == field), F.lit(True)).alias("forall"))

    def query(self, text: str, max_nodes: int | None = None) -> DataFrame:
        """Nodes, edges, a scalar row or groups, by the kind of query."""
        r = _Reader.of(text)
        if r.peek() == "explain":
            lines = list(enumerate(self.explain(text.split("explain", 1)[1])))
            return self.graph.nodes.sparkSession.createDataFrame(lines, "step int, text string")
        out = self._aggregate(r, {})
        if r.at < len(r.tokens):
            raise QueryError(f"left over: {r.peek()!r}")
        if _SHOWN[r.shown] and "id" in out.columns:
            out = out.select(*_SHOWN[r.shown])
        return out.orderBy("id").limit(max_nodes) if max_nodes and "id" in out.columns else out

    def stream_count(self, text: str, every: int = 1000) -> DataFrame:
        """(batch, so_far): how many nodes a query has after each `every` of them in order of id, and at the end."""
        n = self.query(text).count()
        spark = self.graph.nodes.sparkSession
        return spark.range(1, -(-n // every) + 1).select(F.col("id").alias("batch"), F.least(F.col("id") * every, F.lit(n)).alias("so_far"))

    def explain(self, text: str) -> list[str]:
        """The steps of a query in the order they are taken; nothing is run."""
        steps, depth = [[]], 0
        for kind, word in _Reader.of(text).tokens:
            depth += {"(": 1, ")": -1}.get(word, 0)
            if depth == 0 and (word == "|" or word in _SETS and kind != "str"):
                steps.append([] if word == "|" else [word])
            else:
                steps[-1].append(word)
        return [" ".join(s) for s in steps]

    def stages(self, text: str) -> list[tuple[str, DataFrame]]:
        """(step, ids) after each pipe of a query of one term, from its selector on."""
        r = _Reader.of(text)
        begin, out = 0, []
        w = self._atom(r, {})
        while True:
            out.append((" ".join(x for _, x in r.tokens[begin : r.at]), w))
            if r.peek() != "|":
                break
            r.take()
            begin, w = r.at, self._op(r, w)
        if r.at < len(r.tokens):
            raise QueryError(f"only pipes have stages, found {r.peek()!r}")
        return out

    def provenance(self, text: str) -> DataFrame:
        """(stage, step, id, sources): the nodes after each pipe, and those of the stage before that are the node itself or next to it."""
        near = traverse.both_ways(self.graph.edges.select("src", "dst")).distinct()
        last = rows = None
        for k, (step, w) in enumerate(self.stages(text)):
            own = w.select(F.lit(k).alias("stage"), F.lit(step).alias("step"), "id")
            if last is None:
                own = own.withColumn("sources", F.array().cast("array<string>"))
            else:
                from_ = last.select(F.col("id").alias("was"))
                come = near.join(from_, near.src == from_.was, "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("was")).unionByName(from_.select(F.col("was").alias("id"), "was"))
                lists = come.join(w, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("was")).alias("sources"))
                own = own.join(lists, "id", "left").select("stage", "step", "id", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
            rows, last = own if rows is None else rows.unionByName(own), w
        return rows
