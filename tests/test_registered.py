"""Registered queries on a few rows of their tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeloom import facade_queries, flow_queries, link_queries  # noqa: F401  (register their queries)
from codeloom.operators import channels, structure
from codeloom.plans.snapshot import Snapshot
from codeloom.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two regions with a nation each; two customers with two orders each, one without; two parts, three suppliers."""
    path = tmp_path_factory.mktemp("tables")
    table = lambda name, schema, rows: spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))
    table("region", "r_regionkey int, r_name string", [(0, "EAST"), (1, "WEST")])
    table("nation", "n_nationkey int, n_name string, n_regionkey int", [(0, "ONE", 0), (1, "TWO", 1)])
    table("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double", [(k, f"Customer#00000001{k}", k % 2, 6000.0 * k) for k in range(3)])
    table("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(k, f"Supplier#00000000{k}", int(k == 1), 6000.0) for k in range(3)])
    table("part", "p_partkey long, p_name string, p_brand string, p_size int", [(0, "small ring", "A", 3), (1, "large bolt", "B", 4)])
    table("orders", "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string", [(k, k % 2, datetime(1998, 1 + k, 1), 3000.0 * k, "1") for k in (1, 2, 3, 4)])
    table("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double", [(1, 0, 0, 1, 2.0), (1, 0, 0, 2, 3.0), (2, 1, 1, 1, 50.0), (4, 0, 2, 1, 1.0)])
    return str(path)


def rows(spark, tables, name):
    return sorted(map(tuple, QUERIES[name](spark, tables).collect()))


def test_groups_hold_their_members_in_one_text(spark, tables):
    assert rows(spark, tables, "dsl_group_by_file") == [("nation:0", "supplier:0,supplier:2"), ("nation:1", "supplier:1")]


def test_division_is_by_classes_of_equal_sets(spark):
    """3,000 asking sets of three kinds and 50 offering ones of two: members meet by class, never set by set."""
    asked = spark.range(3000).select(F.col("id").alias("wanted"), F.explode(F.array_compact(F.array(F.lit(1), F.when(F.col("id") % 3 > 0, 2), F.when(F.col("id") % 3 > 1, 3)))).alias("member"))
    given = spark.range(50).select(F.col("id").alias("owner"), F.explode(F.array_compact(F.array(F.lit(1), F.lit(2), F.when(F.col("id") % 2 > 0, 3)))).alias("member"))
    _, classes, members = channels._by_members(asked, "wanted")
    assert (classes.count(), members.count()) == (3, 6)
    got = channels.fulfilled(asked, given)
    want = {(o, w) for o in range(50) for w in range(3000) if o != w and (o % 2 or w % 3 < 2)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_an_owner_meets_a_group_of_asking_sets_as_one_row(spark, monkeypatch):
    """100 asking sets of one class in groups of about seven: the join is by group, and pairs come of it afterwards."""
    monkeypatch.setattr(channels, "SETS_A_GROUP", 7)
    asked, given = spark.range(100).select(F.col("id").alias("wanted"), F.lit(1).alias("member")), spark.range(90, 110).select(F.col("id").alias("owner"), F.lit(1).alias("member"))
    got = channels.fulfilled(asked, given)
    assert sorted(tuple(r) for r in got.collect()) == [(o, w) for o in range(90, 110) for w in range(100) if o != w]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sets") < plan.index("Join Inner")


@pytest.mark.parametrize(
    ("name", "n"),
    [("graph_kind_counts", 4), ("dsl_callers", 6), ("dsl_callees", 4), ("dsl_exists_in_rows", 1), ("dsl_since", 4), ("dsl_sum", 1), ("score_range", 9), ("stem_matches", 1), ("induced_edges", 1), ("routing_manifest", 3), ("bfs_depths", 8), ("pagerank_three_rounds", 16)],
)
def test_one_query_builds_no_snapshot(spark, tables, monkeypatch, name, n):
    """A query that reads the graph once must not pay for adjacency in both directions."""
    monkeypatch.setattr(Snapshot, "build", lambda *_, **__: pytest.fail("a snapshot was built"))
    assert len(rows(spark, tables, name)) == n


@pytest.mark.parametrize("length", [3, 15])
def test_dominators_are_of_what_the_root_leads_to(spark, monkeypatch, length):
    """A chain from the root, within the bounded search and past it, beside a chain that the root does not lead to."""
    own, other = [(k, k + 1) for k in range(length)], [(100 + k, 101 + k) for k in range(30)]
    seen = []
    plain = structure._spanning_tree
    monkeypatch.setattr(structure, "_spanning_tree", lambda links, root: seen.append(links.count()) or plain(links, root))
    got = structure.dominator_tree(spark.createDataFrame(own + other, "src long, dst long"), spark.createDataFrame([(0,)], "id long"))
    assert {r.id: r.idom for r in got.collect()} == {0: None} | {b: a for a, b in own}
    assert seen == [length if length < structure.NEAR else len(own + other)]
