"""Contexts, sessions, passes, caches and incremental updates on small graphs with known answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.operators import context
from codeloom.plans.graph import PropertyGraph
from codeloom.plans.session import Capabilities, Pass, QueryCache, Session, run_passes
from codeloom.streaming import watch


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("e", "Struct", "PaymentEngine", "pay::PaymentEngine", "src/pay.rs", 1, 30), ("c", "Function", "charge_card", "pay::charge_card", "src/pay.rs", 2, 9), ("l", "Function", "log_line", "log::log_line", "src/log.rs", 1, 4), ("t", "Function", "test_charge", "t::test_charge", "tests/pay.rs", 1, 4), ("p", "Trait", "Processor", "core::Processor", "src/core.rs", 1, 3), ("o", "Struct", "OtherEngine", "oth::OtherEngine", "src/oth.rs", 1, 3), ("z", "Function", "alone", "z::alone", "src/z.rs", 1, 2)]
    edges = [("e", "c", "Contains"), ("c", "l", "Calls"), ("t", "c", "Calls"), ("e", "p", "Implements"), ("o", "p", "Implements"), ("c", "e", "UsesType")]
    return PropertyGraph(
        spark.createDataFrame([(*n, 0, 0.0) for n in nodes], "id string, kind string, name string, qualified_name string, file_path string, line int, end_line int, revision long, score double"),
        spark.createDataFrame([(*e, 1.0) for e in edges], "src string, dst string, kind string, weight double"),
    )


def ids(df):
    return {r.id for r in df.collect()}


def some(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_shaping(graph, spark):
    assert context.names_in("why does PaymentEngine call charge_card() in a::b and the log") == ["PaymentEngine", "charge_card", "a::b"]
    assert [(r.id, r.src, r.dst) for r in context.expand_types(graph, some(spark, "e", "c"), 5).collect()] == [("p", "e", "p"), ("o", "o", "p")]
    assert context.expand_types(graph, some(spark, "e"), 1).count() == 1
    assert ids(context.diverse(graph.nodes, some(spark, "e"), 1)) == {"e", "c", "l", "t", "p", "o", "z"}
    assert ids(context.diverse(graph.nodes, some(spark), 1)) == {"c", "l", "t", "p", "o", "z"}
    assert ids(context.capped_tests(graph.nodes, 0)) == {"e", "c", "l", "p", "o", "z"}
    assert {(r.src, r.dst) for r in context.recovered_edges(graph, some(spark, "c", "l", "e"), ("Calls",)).collect()} == {("c", "l")}
    assert {r.id: r.boost for r in context.colocated(graph.nodes).collect()} == {"e": 1, "c": 1, "l": 0, "t": 0, "p": 0, "o": 0, "z": 0}
    assert ids(context.flow_seed(graph, some(spark, "t"), 2)) == {"c", "l", "e"}
    assert [list(r.path) for r in context.call_paths(graph, some(spark, "t", "c", "l")).where("source = 't' and target = 'l'").collect()] == [["t", "c", "l"]]


def test_contexts(graph):
    got = {r.id: r.role for r in context.build(graph, "explain charge_card", limit=1).collect()}
    assert got == {"c": "entry", "l": "related", "t": "related", "e": "related"}
    r = context.gate_measure(graph, "explain alone()", limit=1).first()
    assert (r.without_gate, r.with_gate, r.saved, r.abstained) == (0, 0, 0, True)
    files = [r.file_path for r in context.explore_files(graph, "explain charge_card", 1).orderBy("place").collect()]
    assert files[0] == "src/pay.rs" and "src/log.rs" in files and "src/z.rs" not in files


def test_session(graph, spark):
    s = Session(graph, spark.createDataFrame([("src/pay.rs", "a\nlet card\n")], "path string, content string"), remembered=2)
    for _ in range(2):
        assert ids(s.query('fn("charge_card")')) == {"c"}
    s.query("all")
    assert list(s.history) == ['fn("charge_card")', "all"] and (s.cache.hits, s.cache.misses) == (1, 2)
    assert ids(s.callers("charge_card")) == {"t"} and ids(s.callees("test_charge", 2)) == {"c", "l"}
    assert ids(s.suggest("please fix charge_card")) == {"c"} and ids(s.outline("pay.rs")) == {"e", "c", "t"}
    assert [(r.line, r.id) for r in s.grep("card").collect()] == [(2, "c")]
    assert s.status().first()[:] == (7, 6, 6, 0) and s.files().count() == 6
    branch = s.overlay(graph.nodes.where("id = 'c'").withColumn("name", F.lit("bill_card")), graph.edges.limit(0))
    assert ids(branch.callees("test_charge", 2)) == {"c"} and branch.search("bill_card").first().id == "c"
    assert s.capabilities.disable("search") == ["context", "explore"]
    with pytest.raises(PermissionError):
        s.explore("x")
    with pytest.raises(ValueError):
        s.capabilities.enable("context")


def test_capabilities_passes_and_cache(spark):
    assert Capabilities({"a": (), "b": ("a",)}, off=("a",)).on == set()
    one = spark.range(3)
    order = []
    a = Pass("a", ("base",), ("x",), lambda t: order.append("a") or {"x": t["base"].where("id > 0")})
    b = Pass("b", ("x",), ("y",), lambda t: order.append("b") or {"y": t["x"].where("id > 1")})
    assert run_passes([b, a], {"base": one})["y"].count() == 1 and order == ["a", "b"]
    with pytest.raises(ValueError, match="nothing provides x"):
        run_passes([b], {"base": one})
    with pytest.raises(ValueError, match="does not provide"):
        run_passes([Pass("c", (), ("z",), lambda t: {})], {})
    cache = QueryCache(2)
    for key, reads in [("q", frozenset({"f"})), ("r", frozenset({"g"})), ("s", None), ("r", None)]:
        cache.get(key, 1, lambda: one, reads)
    assert (cache.hits, cache.misses, [k for k, _ in cache.kept]) == (1, 3, ["s", "r"])
    assert cache.advance(1, 2, {"f"}) == 1 and list(cache.kept) == [("r", 2)]
    assert cache.get("r", 2, lambda: None).count() == 3


def at(s):
    return datetime(2024, 1, 1, 0, 0, s)


def test_changes_of_files(spark):
    e = spark.createDataFrame([("a", at(1)), ("a", at(2)), ("a", at(10)), ("b", at(3))], "path string, ts timestamp")
    assert sorted((r.path, r.first_seen.second, r.last_seen.second, r.n) for r in watch.debounced(e).collect()) == [("a", 1, 2, 2), ("a", 10, 10, 1), ("b", 3, 3, 1)]
    sync = lambda *rows: spark.createDataFrame(list(rows), "start timestamp, ended timestamp, ok boolean")
    told = lambda s: sorted((r.path, r.first_seen.second, r.indexing) for r in watch.pending(e, s).collect())
    assert told(sync()) == [("a", 1, False), ("b", 3, False)]
    assert told(sync((at(5), at(6), True))) == [("a", 10, False)]
    assert told(sync((at(5), at(6), False), (at(11), None, None))) == [("a", 1, True), ("b", 3, True)]


def test_incremental_update(spark):
    files = {"a.py": "def one():\n    return two()\n", "b.py": "def two():\n    return 1\n"}
    table = lambda f: spark.createDataFrame(list(f.items()), "path string, content string")
    empty = PropertyGraph(spark.createDataFrame([], "id string, kind string, name string, qualified_name string, file_path string"), spark.createDataFrame([], "src string, dst string, kind string, weight double"))
    g, records = watch.update_files(empty, spark.createDataFrame([], "path string, content_hash string"), table(files))
    named = lambda g: sorted((r.a, r.b, r.kind) for r in g.edges.join(g.nodes.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst").select("a", "b", "kind").collect())
    assert named(g) == [("one", "two", "Calls")]
    moved = {"a.py": files["a.py"], "c.py": "def three():\n    pass\n\ndef two():\n    return three()\n"}
    h, records = watch.update_files(g, records, table(moved))
    assert named(h) == [("one", "two", "Calls"), ("two", "three", "Calls")]
    assert sorted(r.name for r in h.nodes.collect()) == ["one", "three", "two"]


def test_results_by_content_and_tool_events(spark, tmp_path):
    make = lambda m: m.select("content_hash", F.length("content").alias("n"))
    f = lambda *c: spark.createDataFrame([(x,) for x in c], "content string")
    kept, made = watch.by_content(f("a", "bb", "a"), None, make)
    assert sorted(r.n for r in made.collect()) == [1, 2]
    every, made = watch.by_content(f("bb", "ccc"), kept, make)
    assert sorted(r.n for r in every.collect()) == [2, 3] and [r.n for r in made.collect()] == [3]
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "x.txt").write_text('ts=5 tool_kind=bash chain="git push --token abc" session=s1\ntool_kind=read path=src/a.rs\nnoise\n')
    events = watch.tool_events(spark.readStream.text(str(folder)))
    for _ in range(2):
        watch.ingest(events, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.tool_kind, r.primary_cmd, r.chain, r.path, r.redacted) for r in spark.read.parquet(str(tmp_path / "out")).fillna("").collect())
    assert got == [("bash", "git", "git push --token <REDACTED>", "", True), ("read", "", "", "src/a.rs", False)]
