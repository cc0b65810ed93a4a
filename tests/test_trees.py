"""Dominator trees and k cheapest paths against brute force on random graphs."""

import random
from collections import defaultdict

import pytest

from codeloom.operators import paths, structure, traverse


def brute_dominators(edges, root):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)

    def reach(without):
        seen, todo = set(), [root] if root != without else []
        while todo:
            x = todo.pop()
            if x not in seen and x != without:
                seen.add(x)
                todo += out[x]
        return seen

    every = reach(None)
    return sorted({(v, d) for d in every for v in every if d == v or v not in reach(d)})


@pytest.mark.parametrize("seed", range(6))
def test_dominators_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    n = [6, 12, 25, 40, 40, 15][seed]
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * [1.3, 1.2, 1.5, 1.1, 2.5, 4][seed]))]
    edges += [(i, i + 1) for i in range(0, n - 1, 2)] + [(n, n + 1), (n + 1, n), (n + 1, 3)]  # a ring that nothing leads to
    table = spark.createDataFrame(edges, "src long, dst long")
    tree = structure.dominator_tree(table, spark.createDataFrame([(0,)], "id long"))
    want = brute_dominators(edges, 0)
    assert sorted(map(tuple, structure.dominator_pairs(tree).collect())) == want
    size = defaultdict(int)
    for v, _ in want:
        size[v] += 1
    assert {r.id: r.idom for r in tree.collect()} == {v: next((d for w, d in want if w == v and size[d] == size[v] - 1 and d != v), None) for v in size}


def test_a_long_chain_has_few_rounds(spark):
    n = 10_000
    links = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    tree = structure.dominator_tree(links, spark.createDataFrame([(0,)], "id long"))
    assert tree.count() == n + 1 and tree.where("id > 0 and idom <> id - 1").count() == 0
    # a way past the second half, so that one node of the chain has two predecessors far apart
    short = links.union(spark.createDataFrame([(5_000, 10_000)], "src long, dst long"))
    tree = structure.dominator_tree(short, spark.createDataFrame([(0,)], "id long"))
    assert tree.where("id = 10000").first().idom == 5_000 and tree.where("id > 0 and id < 10000 and idom <> id - 1").count() == 0


def brute_paths(edges, sources, targets, k, most):
    light = {}
    for a, b, w in edges:
        if a != b:
            light[a, b] = min(light.get((a, b), w), w)
    found, todo = [], [([s], 0.0) for s in set(sources)]
    while todo:
        p, c = todo.pop()
        if p[-1] in targets:
            found.append((c, p))
        if len(p) <= most:
            todo += [([*p, b], c + w) for (a, b), w in light.items() if a == p[-1] and b not in p]
    return sorted(found)[:k]


@pytest.mark.parametrize("seed", range(5))
def test_k_shortest_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 8
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", float(rng.randint(0 if seed else 1, 6))) for _ in range(22)]
    sources, targets = ["n0", "n1"][: 1 + seed % 2], ["n6", "n7", "n0"][: 1 + seed % 3]
    k, most = [3, 7, 40, 1, 12][seed], [32, 32, 4, 5, 32][seed]
    table = spark.createDataFrame(edges, "src string, dst string, weight double")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id string")
    got = [(r.cost, r.path) for r in paths.k_shortest(table, ids(sources), ids(targets), k, most).collect()]
    assert got == brute_paths(edges, sources, targets, k, most)


def test_few_labels_mislead_the_first_pass(spark):
    """The best way to a node blocks the only way on, so keeping one label a node is not enough."""
    edges = [("s", "a", 1.0), ("a", "b", 1.0), ("s", "b", 5.0), ("b", "a", 1.0), ("b", "t", 9.0), ("a", "t", 1.0), ("s", "t", 50.0)]
    table = spark.createDataFrame(edges, "src string, dst string, weight double")
    one = spark.createDataFrame([("s",)], "id string"), spark.createDataFrame([("t",)], "id string")
    for k in (1, 2, 3, 9):
        assert [(r.cost, r.path) for r in paths.k_shortest(table, *one, k).collect()] == brute_paths(edges, ["s"], ["t"], k, 32)


def test_distances_write_improvements_only(spark):
    edges = spark.createDataFrame([("a", "b", 4.0), ("a", "c", 1.0), ("c", "b", 1.0), ("b", "d", 1.0)] + [(f"x{i}", f"x{i + 1}", 1.0) for i in range(12)] + [("d", "x0", -2.0)], "src string, dst string, weight double")
    seed = spark.createDataFrame([("a",)], "id string")
    got = {r.id: r.distance for r in traverse.shortest_distances(edges, seed).collect()}
    assert got == {"a": 0.0, "b": 2.0, "c": 1.0, "d": 3.0, **{f"x{i}": 1.0 + i for i in range(13)}}
    ring = spark.createDataFrame([("a", "b", 1.0), ("b", "a", -2.0)], "src string, dst string, weight double")
    with pytest.raises(ValueError, match="negative"):
        traverse.shortest_distances(ring, seed)
