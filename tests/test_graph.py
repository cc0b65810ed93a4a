"""The reference fixtures' shapes with known answers, and brute force on small random graphs."""

import itertools
import random

import pytest

from codeloom.operators import mining, traverse
from codeloom.plans.dsl import Engine, QueryError
from codeloom.plans.graph import PropertyGraph, glob_regex
from codeloom.sources import readers


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, k, i, f"m::{i}", "f", r, float(r)) for i, k, r in nodes], "id string, kind string, name string, qualified_name string, file_path string, revision long, score double")
    return PropertyGraph(n, spark.createDataFrame([(a, b, k, 1.0) for a, b, k in edges], "src string, dst string, kind string, weight double"))


def ids(df):
    return {r.id for r in df.collect()}


@pytest.fixture(scope="module")
def chain(spark):
    names = "abcdefghij"
    return Engine(graph(spark, [(c, "Function", i) for i, c in enumerate(names)], [(a, b, "Calls") for a, b in itertools.pairwise(names)]))


def test_depth_keeps_the_seed(chain):
    assert ids(chain.query('fn("a") | depth 2')) == {"a", "b", "c"}


def test_set_operators_go_left_to_right(chain):
    assert ids(chain.query('fn("a") union fn("b") diff fn("b") \\ fn("a")')) == set()


def test_callers_callees_and_aggregates(chain):
    assert ids(chain.query('fn("c") | callers')) == {"b"}
    assert ids(chain.query('fn("c") | callees | callees')) == {"e"}
    assert chain.query('count fn("a") | depth 3').first()[0] == 4
    assert chain.query('avg score fn("zz")').first()[0] == 0.0
    assert chain.query('forall kind=Struct fn("zz")').first()[0] is True
    assert [r.id for r in chain.query("top_k_by score 2 all").collect()] == ["j", "i"]


def test_reachable_needs_the_pattern(spark):
    e = Engine(graph(spark, [("m", "Module", 0), ("f0", "Function", 0), ("f1", "Function", 0), ("f2", "Function", 0), ("s", "Struct", 0)], [("m", "f0", "Contains"), ("f0", "f1", "Calls"), ("f1", "f2", "Calls"), ("f1", "s", "UsesType")]))
    assert ids(e.query('fn("f0") | reachable via "Calls+"')) == {"f1", "f2"}
    assert ids(e.query('type("s") | reachable via "UsesType" incoming')) == {"f1"}
    assert ids(e.query('fn("f0") | reachable via "Calls*"')) == {"f0", "f1", "f2"}


def test_filter_after_depth_is_not_moved(spark):
    e = Engine(graph(spark, [("a", "Function", 0), ("t", "Struct", 0)], [("a", "t", "UsesType")]))
    assert ids(e.query('fn("a") | depth 2 | filter kind=Struct')) == {"t"}


def test_errors(chain):
    for text in ("fn(", 'fn("a") |', 'fn("a") | nothing', 'fn("a") | filter kind=Nothing', 'fn("a") fn("b")'):
        with pytest.raises(QueryError):
            chain.query(text)


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    nodes = [f"n{i:02d}" for i in range(12)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(14)]
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    used = {x for e in edges for x in e}
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.id: r.component for r in traverse.strong_components(df).collect()} == {n: max(m for m in used if m in reach[n] and n in reach[m]) for n in used}
    weak = {n: {n} for n in used}
    for _ in used:
        for a, b in edges:
            weak[a] |= weak[b]
            weak[b] |= weak[a]
    assert {r.id: r.component for r in traverse.components(df).collect()} == {n: min(weak[n]) for n in used}
    seeds = df.limit(1).selectExpr("src as id")
    first = seeds.first().id
    assert ids(traverse.bfs(df, spark.createDataFrame([(first,)], "id string"))) == reach[first]


def test_strong_components_go_on_past_200_rounds(spark):
    # ids fall along the edges, so the largest id of a colour names itself alone; a cycle lies in the middle
    names = [f"n{999 - i}" for i in range(206)]
    edges = [*itertools.pairwise(names), (names[104], names[102]), (names[5], names[5])]
    want = {n: names[102] if n in names[102:105] else n for n in names}
    assert {r.id: r.component for r in traverse.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()} == want
    assert traverse.strong_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_distances_go_on_past_64_hops(spark):
    edges = [*((f"n{i}", f"n{i + 1}", 1.0) for i in range(68)), ("n0", "n68", 500.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    start = spark.createDataFrame([("n0",)], "id string")
    assert {r.id: r.distance for r in traverse.shortest_distances(df, start).collect()} == {f"n{i}": float(i) for i in range(69)}
    with pytest.raises(ValueError):
        traverse.shortest_distances(spark.createDataFrame([("n0", "n1", -1.0), ("n1", "n0", 0.5)], df.schema), start)


def test_noisy_or_and_glob(spark):
    rows = spark.createDataFrame([("a", "sink", 0.5), ("a", "sink", 0.5), ("b", "sink", 1.0)], "name string, role string, confidence double")
    assert {r.name: r.confidence for r in mining.noisy_or(rows).collect()} == pytest.approx({"a": 0.75, "b": 1.0})
    assert glob_regex("a*?") == "^a.*.$"


def test_sources(spark):
    report = spark.createDataFrame([("r", 0, "SF:a.py"), ("r", 1, "DA:1,5"), ("r", 2, "DA:x,5"), ("r", 3, "end_of_record"), ("r", 4, "SF:b.py"), ("r", 5, "DA:2,0")], "file string, no int, value string")
    assert {tuple(r) for r in readers.lcov(report).collect()} == {("a.py", 1, 5), ("b.py", 2, 0)}
    h = "a" * 40
    log = spark.createDataFrame([("l", 0, h), ("l", 1, ""), ("l", 2, "x.py"), ("l", 3, "y.py")], "file string, no int, value string")
    assert {tuple(r) for r in readers.git_log(log).collect()} == {(h, "x.py"), (h, "y.py")}
    src = "import os\nclass A(B):\n    def f(self):\n        return g()\ndef g():\n    pass\n"
    got = readers.extract_python(spark.createDataFrame([("p.py", src), ("q.py", "def (")], "path string, content string")).collect()
    assert {(r.qualified_name, r.kind) for r in got if r.tag == "node"} == {("A", "Struct"), ("A.f", "Function"), ("g", "Function")}
    assert {(r.qualified_name, r.kind, r.target) for r in got if r.tag == "edge"} == {("A", "Implements", "B"), ("A.f", "Calls", "g"), ("p.py", "Imports", "os")}
    assert [r.path for r in got if r.tag == "error"] == ["q.py"]


def test_resolution_tiers(spark):
    refs = spark.createDataFrame([(1, "f", "a/b/c.py"), (2, "only", "z.py"), (3, "F2", "z.py"), (4, "none", "z.py")], "ref_id long, name string, path string")
    syms = spark.createDataFrame([("s1", "f", "a/b/c.py"), ("s2", "f", "x.py"), ("s3", "only", "y.py"), ("s4", "f2", "y.py")], "id string, name string, path string")
    assert {r.ref_id: (r.id, r.confidence) for r in readers.resolve(refs, syms).collect()} == {1: ("s1", 0.95), 2: ("s3", 0.9), 3: ("s4", 0.5)}


def test_strong_components_leave_rings_to_their_heads(spark, monkeypatch):
    """Two rings through one node, a ring that nothing leads into, what hangs on it and a loop: no ring is left to be coloured round by round but the second."""
    seen = []
    whole = traverse._coloured
    monkeypatch.setattr(traverse, "_coloured", lambda rest: seen.extend(map(tuple, rest.collect())) or whole(rest))
    ring = lambda *names: list(zip(names, names[1:] + names[:1], strict=True))
    edges = ring("hub", "a1", "a2", "a3") + ring("hub", "b1", "b2") + [("top", "hub"), ("a2", "off"), ("off", "end"), ("end", "end")] + ring("r1", "r2", "r3") + [("r2", "t1"), ("t1", "t2"), ("t2", "hub")]
    got = {r.id: r.component for r in traverse.strong_components(spark.createDataFrame(edges * 2, "src string, dst string")).collect()}
    alone = {x: x for x in ("top", "off", "end", "t1", "t2")}
    assert got == {**{x: "hub" for x in ("hub", "a1", "a2", "a3", "b1", "b2")}, **{x: "r3" for x in ("r1", "r2", "r3")}, **alone}
    assert {a for a, _ in seen} <= {"top", "r1", "r2", "r3"}
