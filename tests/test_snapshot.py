"""Snapshots: numbering, hubs, staleness, plans that leave the edges in place, and traversals equal to those over edges."""

import random

import pytest

from codeloom.operators import resident, traverse
from codeloom.plans import snapshot as snap
from codeloom.plans.snapshot import Snapshot, StaleSnapshot


def graph(spark, n, m, seed, kinds=("Calls", "UsesType", "Contains")):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(kinds), float(rng.randint(1, 9))) for _ in range(m)]
    rows += rows[: m // 10]  # parallel edges
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n + 3)], "id string")
    return nodes, spark.createDataFrame(rows, "src string, dst string, kind string, weight double"), rows


def test_numbers_edges_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(snap, "EDGES_A_SALT", 5)  # most nodes are hubs
    nodes, edges, rows = graph(spark, 20, 300, 1)
    s = Snapshot.build(nodes, edges, 7, buckets=3)
    ids = sorted(f"n{i}" for i in range(23))
    assert {r.id: r.num for r in s.nodes.collect()} == {x: i for i, x in enumerate(ids)}
    assert sorted(map(tuple, s.edges().select("src", "dst", "kind", "weight").collect())) == sorted(rows)
    assert s.manifest["out_hubs"] > 10 and s.out.where("first").count() == len({(a, b) for a, b, *_ in rows})
    met = s.meet(s.numbers(spark.createDataFrame([("n3",), ("n4",), ("lost",)], "id string"))).count()
    assert met == sum(a in ("n3", "n4") for a, *_ in rows)
    back = s.meet(s.numbers(spark.createDataFrame([("n3",)], "id string")), back=True).count()
    assert back == sum(b == "n3" for _, b, *_ in rows)


def test_stale_snapshots_are_refused(spark, tmp_path):
    nodes, edges, _ = graph(spark, 5, 10, 2)
    s = Snapshot.build(nodes, edges, "r1", path=str(tmp_path / "s"))
    s.close()
    again = Snapshot.open(spark, s.path, "r1")
    assert again.out.count() == 11 and again.stale("r2") and not again.stale("r1")
    with pytest.raises(StaleSnapshot):
        Snapshot.open(spark, s.path, "r2")
    files = tmp_path / "t"
    edges.write.parquet(str(files))
    before = snap.revision_of(spark.read.parquet(str(files)))
    edges.write.mode("append").parquet(str(files))
    assert snap.revision_of(spark.read.parquet(str(files))) != before


def exchanged(df):
    """Leaf tables below each Exchange of a plan."""
    import re

    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    lines, out = text.splitlines(), []
    depth = [len(re.match(r"[\s:+|-]*", x)[0]) for x in lines]
    for i, x in enumerate(lines):
        if re.search(r"(?<!Broadcast)Exchange hashpartitioning", x):
            j = i + 1
            while j < len(lines) and depth[j] > depth[i]:
                out += re.findall(r"snapshot_\w+?_(?:out|into)", lines[j])
                j += 1
    return out


def test_a_round_exchanges_the_frontier_only(spark):
    nodes, edges, _ = graph(spark, 50, 200, 3)
    s = Snapshot.build(nodes, edges, 1, buckets=4)
    frontier = s.numbers(nodes.limit(3))
    for back in (False, True):
        met = s.meet(frontier, back)
        assert "Bucketed: true" in met._jdf.queryExecution().executedPlan().toString() and exchanged(met) == []


@pytest.mark.parametrize("seed", range(1, 3))
def test_bfs_of_both_kinds_of_round(spark, seed):
    nodes, edges, rows = graph(spark, 120, [130, 400, 1500][seed], seed)
    s = Snapshot.build(nodes, edges, 1, buckets=3)
    seeds = spark.createDataFrame([("n1",), ("n2",), ("strange",)], "id string")
    want = sorted(map(tuple, traverse.bfs(edges, seeds).collect()))
    rounds = []
    assert sorted(map(tuple, resident.bfs(s, seeds, rounds=rounds, pull=4).collect())) == want
    assert sorted(map(tuple, traverse.bfs(s, seeds, 2).collect())) == [x for x in want if x[1] <= 2]
    if seed == 1:
        assert {w for w, *_ in rounds} == {"push", "pull"}
    calls = edges.where("kind = 'Calls'")
    assert sorted(map(tuple, resident.bfs(s, seeds, kinds=("Calls",), back=True, pull=4).collect())) == sorted(map(tuple, traverse.bfs(traverse.reversed_edges(calls), seeds).collect()))


def test_other_traversals_agree(spark):
    nodes, edges, rows = graph(spark, 60, 120, 5)
    s = Snapshot.build(nodes, edges, 1, buckets=3)
    seeds = spark.createDataFrame([("n1",), ("n7",)], "id string")
    for pattern, incoming in (("Calls+ UsesType", False), ("Contains any Calls*", True)):
        a, b = (sorted(r.id for r in traverse.reachable(e, seeds, pattern, incoming).collect()) for e in (s, edges))
        assert a == b != []
    a, b = (sorted(map(tuple, traverse.components(e).collect())) for e in (s, edges))
    low = {}
    for i, c in b:
        low[c] = min(low.get(c, i), i)
    assert a == sorted((i, low[c]) for i, c in b)
    a, b = ({r.id: round(r["rank"], 9) for r in traverse.pagerank(nodes, e, 5).collect()} for e in (s, edges))
    assert a == b
    assert sorted(r.id for r in resident.neighbours(s, seeds, ("Calls",)).collect()) == sorted({y for x, y, k, _ in rows if x in ("n1", "n7") and k == "Calls"})


def test_an_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], "id string"), spark.createDataFrame([], "src string, dst string, kind string")
    s = Snapshot.build(nodes, edges, 1)
    assert s.manifest["nodes"] == 0 and traverse.pagerank(nodes, s, 2).count() == 0
    assert [tuple(r) for r in traverse.bfs(s, spark.createDataFrame([("x",)], "id string")).collect()] == [("x", 0)]
