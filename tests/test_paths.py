"""Paths, redundancy, ranks and communities against brute force; the query language's operators on them."""

import itertools
import random

import pytest

from codeloom.operators import communities, paths, structure
from codeloom.plans.dsl import Engine, QueryError
from codeloom.plans.graph import PropertyGraph


def sample(seed, nodes=8, edges=16):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(nodes)]
    return sorted({(rng.choice(names), rng.choice(names)) for _ in range(edges)})


def frame(spark, edges):
    return spark.createDataFrame([(a, b, "Calls", 1.0 + i % 3) for i, (a, b) in enumerate(edges)], "src string, dst string, kind string, weight double")


def some(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def every_path(edges, a, b, most):
    out, todo = set(), [(a,)]
    while todo:
        p = todo.pop()
        if p[-1] == b:
            out.add(p)
            continue
        if len(p) <= most:
            todo += [(*p, y) for x, y in edges if x == p[-1] and y not in p]
    return out


@pytest.mark.parametrize("seed", [1, 5])
def test_paths_of_each_pair(spark, seed):
    edges = sample(seed)
    sources, targets = ["n0", "n1"], ["n2", "n3", "n0"]
    want = {(a, b): every_path(edges, a, b, 5) for a in sources for b in targets}
    e, s, t = frame(spark, edges), some(spark, *sources), some(spark, *targets)
    got = paths.all_paths(e, s, t, 5).collect()
    # a path to a target may cross another, and one that leaves and ends there may not come back
    assert {(r.source, r.target, tuple(r.path)) for r in got} == {(a, b, p) for (a, b), ps in want.items() for p in ps}
    short = {(r.source, r.target): tuple(r.path) for r in paths.shortest_paths(e, s, t, 5).collect()}
    assert {k: len(p) for k, p in short.items()} == {k: min(map(len, ps)) for k, ps in want.items() if ps}
    assert all(p in want[k] for k, p in short.items())
    near = {r.target: tuple(r.path) for r in paths.nearest_paths(e, s, t, 5).collect()}
    assert {b: len(p) for b, p in near.items()} == {b: min(len(p) for a in sources for p in want[a, b]) for b in targets if any(want[a, b] for a in sources)}
    price = {(a, b): 1.0 + i % 3 for i, (a, b) in enumerate(edges)}
    cheap = paths.k_shortest(e, some(spark, "n0"), some(spark, "n2"), 3, 5).collect()
    assert [r.cost for r in cheap] == sorted(sum(price[h] for h in itertools.pairwise(p)) for p in want["n0", "n2"])[:3]


@pytest.mark.parametrize("seed", [2, 3])
def test_redundant_edges(spark, seed):
    edges = [(a, b) for a, b in sample(seed, 7, 18) if a != b]
    want = {(a, b) for a, b in edges if any(len(p) > 2 for p in every_path([x for x in edges if x != (a, b)], a, b, 9))}
    got = paths.redundant_edges(frame(spark, edges)).collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == len(want)
    assert {(r.src, r.dst) for r in paths.essential_edges(frame(spark, edges)).collect()} == set(edges) - want


def test_impact_and_ancestors(spark):
    rows = [("m", "c", "Contains"), ("c", "f", "Contains"), ("g", "f", "Calls"), ("h", "g", "Calls"), ("d", "h", "UsesType"), ("d", "k", "Contains"), ("x", "k", "Calls"), ("y", "x", "Calls")]
    e = spark.createDataFrame(rows, "src string, dst string, kind string")
    assert {r.id: r.depth for r in paths.impact(e, some(spark, "c")).collect()} == {"c": 0, "f": 0, "g": 1, "h": 2, "d": 3, "k": 3}
    assert {(r.ancestor, r.depth) for r in paths.ancestors(e, some(spark, "f")).collect()} == {("c", 1), ("m", 2)}
    loop = spark.createDataFrame([("a", "b", "Contains"), ("b", "a", "Contains")], "src string, dst string, kind string")
    assert {(r.ancestor, r.depth) for r in paths.ancestors(loop, some(spark, "a")).collect()} == {("b", 1)}


def test_ranks_around(spark):
    edges = [(a, b) for a, b in sample(4) if a != b]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rank = {"n0": 0.5, "alone": 0.5}
    for _ in range(6):
        new = {"n0": 0.125, "alone": 0.125}
        for v, r in rank.items():
            for w in near.get(v, {v}):
                new[w] = new.get(w, 0.0) + 0.75 * r / len(near.get(v, {v}))
        rank = new
    got = {r.id: r["rank"] for r in paths.ranks_around(frame(spark, edges), some(spark, "n0", "alone"), 6).collect()}
    assert got == pytest.approx(rank)


def test_communities(spark):
    names = [f"{g}{i}" for g in "abc" for i in range(4)]
    edges = [(x, y) for x, y in itertools.combinations(names, 2) if x[0] == y[0]] + [("a0", "b0"), ("b1", "c1"), ("c2", "a2")]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, weight double")
    got = communities.communities(e)
    assert {r.id: r.community for r in got.collect()} == {n: n[0] + "0" for n in names}
    mixed = spark.createDataFrame([(a, b, w) for (a, b), w in zip(sample(9, 9, 20), itertools.cycle([1.0, 2.5]), strict=False)], "src string, dst string, weight double")
    alone = mixed.selectExpr("src as id").union(mixed.selectExpr("dst")).distinct().selectExpr("id", "id as community")
    found = communities.communities(mixed)
    assert found.count() == alone.count()
    assert structure.modularity(mixed, found).first()[0] > structure.modularity(mixed, alone).first()[0]
    assert communities.communities(e.limit(0)).count() == 0


@pytest.fixture(scope="module")
def engine(spark):
    rows = [("main", "Function", {}, "Private"), ("f", "Function", {"coverage_tested": "true"}, "Public"), ("g", "Function", {"complexity": "3"}, "Private"), ("t", "Function", {"test": "1"}, "Public"), ("h", "Function", {"bench": "false"}, "Private"), ("s", "Struct", {}, "Public"), ("tr", "Trait", {}, "Public")]
    nodes = spark.createDataFrame([(i, k, i, f"m::{i}", f"{i}.py", 0, 1.0, m, v) for i, k, m, v in rows], "id string, kind string, name string, qualified_name string, file_path string, revision long, score double, metadata map<string,string>, visibility string")
    links = [("main", "f", "Calls"), ("main", "g", "Calls"), ("f", "h", "Calls"), ("g", "h", "Calls"), ("t", "g", "Calls"), ("h", "s", "UsesType"), ("s", "tr", "Implements")]
    history = spark.createDataFrame([(c, f"{x}.py") for c, xs in enumerate(["fg", "fg", "fh", "gh"]) for x in xs], "commit long, item string")
    return Engine(PropertyGraph(nodes, spark.createDataFrame([(*x, 1.0) for x in links], "src string, dst string, kind string, weight double"), history))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('path fn("main") -> type("s")', {"main", "f", "h", "s"}),
        ('paths fn("main") -> type("s")', {"main", "f", "g", "h", "s"}),
        ('paths fn("main") → type("s") where intermediate kind=Function', {"main", "f", "g", "h", "s"}),
        ('paths fn("main") -> type("tr") where intermediate kind=Function', set()),
        ('paths fn("f") -> type("tr") via Implements', {"f", "h", "s", "tr"}),
        ('paths fn("f") -> type("tr") via Returns', set()),
        ('path fn("main") -> type("s") depth 2', set()),
        ('multi_path { fn("main"), fn("g") } -> type("s")', {"g", "h", "s"}),
        ('dominators of type("s")', {"main", "h", "s"}),
        ('dominates fn("h")', {"h", "s", "tr"}),
        ('trait_impls of type("tr")', {"s"}),
        ("entrypoints", {"main", "f", "t"}),
        ("entrypoints kind=Test", {"t"}),
        ("all | entrypoints kind=PublicApi", {"f"}),
        ("all | cluster by type", {"h"}),
        ('fn("f") | co_changes', {"f", "g"}),
        ('all | untested | filter kind=Function', {"main", "g", "t", "h"}),
        ("all | complexity", {"g"}),
        ("all | communities", {"main", "f", "g", "h", "t"}),
        ('(path fn("main") -> fn("h")) diff fn("f") | callees', {"main", "f"}),
    ],
)
def test_query_language(engine, text, want):
    assert {r.id for r in engine.query(text).collect()} == want


def test_projection_explain_and_provenance(engine):
    assert engine.query('fn("f") | show fields').columns == ["id", "kind", "name"]
    assert engine.explain('fn("f") | callees union fn("g")') == ['fn ( "f" )', "callees", 'union fn ( "g" )']
    assert engine.query('explain fn("f") | callees').count() == 2
    got = {(r.stage, r.id): r.sources for r in engine.provenance('fn("main") | callees | callees').collect()}
    assert got == {(0, "main"): [], (1, "f"): ["main"], (1, "g"): ["main"], (2, "h"): ["f", "g"]}
    for text in ('path fn("f")', 'multi_path fn("f") -> fn("g")', "entrypoints kind=Other", 'fn("f") | show all', "dominators fn"):
        with pytest.raises(QueryError):
            engine.query(text)


def test_entrypoint_reach(engine):
    got = {r.id: (r.entry, r.fan_in, r.fan_out, r.reach_size, r.max_depth) for r in paths.entrypoints(engine.graph.nodes, engine.graph.edges).collect()}
    assert got == {"main": ("Main", 0, 2, 5, 4), "f": ("PublicApi", 1, 1, 3, 3), "t": ("Test", 0, 1, 4, 4)}
