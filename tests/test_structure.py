"""Graph structure against brute force on small random graphs."""

import itertools
import random

import pytest

from codeloom.operators import structure, traverse


def reached(edges, start, without=None):
    seen, todo = {start} - {without}, [start] if start != without else []
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in seen and b != without:
                seen.add(b)
                todo.append(b)
    return seen


def parts_of(nodes, links):
    left, n = set(nodes), 0
    while left:
        left -= reached(links, min(left))
        n += 1
    return n


def sample(seed, nodes=11, edges=14):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(nodes)]
    return [(rng.choice(names), rng.choice(names)) for _ in range(edges)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_nodes_and_bridges(spark, seed):
    edges = sample(seed)
    links = {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}
    nodes = {x for e in links for x in e}
    whole = parts_of(nodes, links)
    cuts = {x for x in nodes if parts_of(nodes - {x}, {e for e in links if x not in e}) > whole}
    lone = {(a, b) for a, b in links if a < b and parts_of(nodes, links - {(a, b), (b, a)}) > whole}
    forest = structure.blocks(frame(spark, edges))
    assert {r.id for r in structure.articulation_points(forest).collect()} == cuts
    assert {(r.a, r.b) for r in structure.bridges(forest).collect()} == lone


def parts_by_hand(edges):
    """The blocks as sets of edges: edges that meet in a node are in one block where the rest of the graph leads from one to the other without that node."""
    links = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    both = links | {(b, a) for a, b in links}
    of = {e: {e} for e in links}
    for e, f in itertools.combinations(sorted(links), 2):
        meet = set(e) & set(f)
        if meet and of[e] is not of[f]:
            at = meet.pop()
            if next(iter(set(f) - {at})) in reached(both, next(iter(set(e) - {at})), at):
                of[e] |= of[f]
                for x in of[f]:
                    of[x] = of[e]
    return sorted({tuple(sorted(b)) for b in of.values()})


SHAPES = {
    "dense": sample(5, 9, 24),
    "chains between cores": [*itertools.combinations("abcd", 2), ("a", "x1"), ("x1", "x2"), ("x2", "c"), ("d", "y1"), ("y1", "y2"), ("y2", "p"), *itertools.combinations("pqrs", 2), ("q", "t"), ("t", "r")],
    "rings, trees and twice the same chain": [("h", f"c{i}") for i in range(4)] + [("c0", "r1"), ("r1", "r2"), ("r2", "c0"), ("c1", "l1"), ("l1", "l2"), ("c2", "u"), ("u", "v"), ("c2", "w"), ("w", "v"), ("v", "z"), ("k1", "k2"), ("k2", "k3"), ("k3", "k1"), ("h", "h"), ("c0", "h")],
    "a strip that only loses its ends": [(f"s{i:02d}", f"s{i + k:02d}") for i in range(12) for k in (1, 2)],
    "none": [("a", "a")],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_blocks(spark, shape):
    got = structure.blocks(frame(spark, SHAPES[shape])).collect()
    found = {}
    for r in got:
        found.setdefault(r.block, []).append((r.a, r.b))
    assert sorted(tuple(sorted(b)) for b in found.values()) == parts_by_hand(SHAPES[shape])
    assert all(r.lone == (len(found[r.block]) == 1) for r in got)


def test_rings_and_trees_need_no_search(spark, monkeypatch):
    """A path of 60 nodes, a ring of 40 and a star are gone in a few rounds, none of which goes from node to node."""
    monkeypatch.setattr(structure, "bfs_tree", lambda *_, **__: pytest.fail("a search was made"))
    edges = [(f"p{i}", f"p{i + 1}") for i in range(60)] + [(f"p{i}" if i else "r", f"q{i}") for i in range(9)] + [(f"r{i or ''}", f"r{(i + 1) % 40 or ''}") for i in range(40)]
    parts = structure.blocks(frame(spark, edges))
    assert structure.bridges(parts).count() == 69
    assert parts.where("not lone").agg({"block": "count", "a": "count"}).first()[0] == 40 == parts.where("not lone").groupBy("block").count().first()[1]


def test_cut_nodes_of_rings_need_no_search(spark, monkeypatch):
    """A hub with 12 rings of three to five nodes, one of which has a tail: the hub and the tail's nodes but the last are cut nodes."""
    monkeypatch.setattr(structure, "bfs_tree", lambda *_, **__: pytest.fail("a search was made"))
    rings = [("hub", *(f"r{k}_{i}" for i in range(2 + k % 3)), "hub") for k in range(12)]
    edges = [e for r in rings for e in itertools.pairwise(r)] + [("r0_0", "t0"), ("t0", "t1"), ("t1", "t2")]
    assert {r.id for r in structure.articulation_points(structure.blocks(frame(spark, edges))).collect()} == {"hub", "r0_0", "t0", "t1"}


@pytest.mark.parametrize("seed", [4])
def test_dominators(spark, seed):
    edges = [("r", "n00"), ("r", "n01"), *sample(seed, 9, 20)]
    got = structure.dominators(frame(spark, edges), spark.createDataFrame([("r",)], "id string"))
    seen = reached(edges, "r")
    want = {(v, d) for v in seen for d in seen if v == d or v not in reached(edges, "r", d)}
    assert {tuple(r) for r in got.collect()} == want
    chain = {v: {d for x, d in want if x == v} for v in seen}
    assert {r.id: r.idom for r in structure.immediate_dominators(got).collect()} == {v: next(d for d in chain[v] if len(chain[d]) == len(chain[v]) - 1) for v in seen if v != "r"}


def test_colouring_is_first_fit(spark):
    edges = sample(6, 10, 22)
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near, key=lambda v: (-len(near[v]), v)):
        used = {want[w] for w in near[v] if w in want}
        want[v] = next(c for c in itertools.count() if c not in used)
    assert {r.id: r.colour for r in structure.colouring(frame(spark, edges)).collect()} == want


def test_cliques(spark):
    edges = sample(7, 8, 20)
    links = {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}
    nodes = sorted({x for e in links for x in e})
    every = [set(c) for k in range(2, len(nodes) + 1) for c in itertools.combinations(nodes, k) if all(p in links for p in itertools.combinations(c, 2))]
    want = {tuple(sorted(c)) for c in every if not any(c < d for d in every)}
    assert {tuple(r.clique) for r in structure.maximal_cliques(frame(spark, edges)).collect()} == want


def test_modularity_reach_and_feedback(spark):
    two = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in two], "src string, dst string, weight double")
    parts = spark.createDataFrame([(x, "abc".find(x) >= 0) for x in "abcdef"], "id string, community boolean")
    assert structure.modularity(edges, parts).first()[0] == pytest.approx(6 / 7 - 0.5)
    assert structure.modularity(edges.limit(0), parts).first()[0] == 0.0
    assert {r.id: r.reach for r in structure.reach_estimates(edges).collect()} == {x: len(reached(two, x)) for x in "abcdef"}
    strong = traverse.strong_components(edges)
    assert {(r.src, r.dst) for r in structure.feedback_edges(edges, strong).collect()} == {("c", "a"), ("f", "d")}
