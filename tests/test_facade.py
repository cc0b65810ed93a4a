"""Facade, search, stores and the language's forms that the registered queries do not cover."""

import json

import pytest

from codeloom.operators import facade, lookup
from codeloom.plans.dsl import Engine
from codeloom.plans.graph import PropertyGraph
from codeloom.sources import store


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("a", "Function", "ping", "m::ping", "src/m.rs", 1, 1.0, {"cyclomatic": "4"}), ("b", "Function", "pong", "m::pong", "src/m.rs", 2, 2.0, {"possible_input_types": "[]"}), ("c", "Function", "solo", "n::solo", "src/n.rs", 1, 3.0, {}), ("t", "Function", "test_ping", "t::test_ping", "tests/t.rs", 0, 0.0, {"cyclomatic": "2"})]
    edges = [("a", "b", "Calls", 1.0), ("b", "a", "Calls", 1.0), ("t", "a", "Calls", 1.0), ("c", "t", "Calls", 1.0)]
    return PropertyGraph(
        spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, file_path string, revision long, score double, metadata map<string,string>"),
        spark.createDataFrame(edges, "src string, dst string, kind string, weight double"),
    )


def ids(df):
    return {r.id for r in df.collect()}


def test_bare_operators_and_metadata(graph):
    run = Engine(graph).query
    assert ids(run('fn("ping") | scc')) == {"a", "b"} and ids(run("scc")) == {"a", "b"}
    assert ids(run("hot 1")) <= {"a", "b", "c", "t"} and run("hot 2").count() == 2
    assert ids(run('taint("solo")')) == {"a", "b", "c", "t"}
    assert ids(run('fn("solo") | affected 1 since 2')) == {"a", "b"}
    assert ids(run("possible_types")) == {"b"} and ids(run("complexity")) == {"a", "t"}
    assert run("sum cyclomatic all").first()[0] == 6.0 and run("avg cyclomatic all").first()[0] == 3.0
    assert [r.id for r in run("top_k_by cyclomatic 1 all").collect()] == ["a"]
    assert ids(run("dispatch")) == set() and ids(run("since 2")) == {"b"}
    assert [(r.batch, r.so_far) for r in Engine(graph).stream_count("all", 3).orderBy("batch").collect()] == [(1, 3), (2, 4)]


def test_affected_tests_stop_at_tests(graph, spark):
    e = facade.file_edges(graph)
    assert {(r.src, r.dst) for r in e.collect()} == {("tests/t.rs", "src/m.rs"), ("src/n.rs", "tests/t.rs")}
    assert [(r.id, r.depth) for r in facade.affected_tests(e, spark.createDataFrame([("src/m.rs",)], "id string")).collect()] == [("tests/t.rs", 1)]


def test_distances_and_strata_refuse_what_has_none(spark):
    with pytest.raises(ValueError, match="negative"):
        facade.all_pairs(spark.createDataFrame([("a", "b", -2.0), ("b", "a", 1.0)], "src string, dst string, weight double"))
    with pytest.raises(ValueError, match="negates"):
        facade.strata(spark.createDataFrame([("p", "q", True), ("q", "p", False)], "head string, body string, negated boolean"))


def test_search_query_parsing():
    q = lookup.parse('kind:Function path:"a b" Lang:rust foo "two words" other:x')
    assert q.filters == {"kind": ["Function"], "file_path": ["a b"], "language": ["rust"]} and q.words == ["foo", "two words", "other", "x"]


def test_search_tiers(graph):
    find = lambda text: [r.id for r in lookup.find(graph.nodes, text).collect()]
    assert find("ping") == ["a", "t"]  # the name itself before a test that holds it
    assert find("olo") == ["c"] and find("sollo") == ["c"] and find("zzzz") == []
    assert find("kind:function path:n.rs") == ["c"] and lookup.find(graph.nodes.limit(0), "x").count() == 0
    assert [r.id for r in lookup.exact_names(graph.nodes, ["PING", "pong"]).orderBy("id").collect()] == ["a", "b"]


def test_grep_names_the_innermost_declaration(spark):
    docs = spark.createDataFrame([("x.rs", "fn a() {\n  go()\n}\ngo()\n"), ("y.rs", "go")], "path string, content string")
    symbols = spark.createDataFrame([("m", "x.rs", 1, 4), ("f", "x.rs", 1, 3)], "id string, file_path string, line int, end_line int")
    got = {(r.path, r.line, r.id) for r in lookup.grep_symbols(docs, symbols, "go").collect()}
    assert got == {("x.rs", 2, "f"), ("x.rs", 4, "m"), ("y.rs", 1, None)}
    assert lookup.grep_symbols(docs, symbols, "go", "y.").count() == 1


def test_store_keeps_generations(graph, spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "store"), keep=2)
    assert s.generations() == []
    for k in range(3):
        assert s.save(graph, {"run": str(k)}) == k + 1
    assert s.generations() == [2, 3] and s.metadata().collect()[0].value == "2"
    (tmp_path / "store" / "gen-9" / "nodes").mkdir(parents=True)  # a write that was cut short
    assert s.generations() == [2, 3] and ids(s.load().nodes) == {"a", "b", "c", "t"}
    new = store.replace_file(s.load(), "src/m.rs", graph.nodes.where("id = 'a'"), graph.edges.where("dst = 'a'"))
    assert ids(new.nodes) == {"a", "c", "t"} and {(r.src, r.dst) for r in new.edges.collect()} == {("c", "t"), ("t", "a")}
    assert store.delete_edges_from(graph, graph.nodes.where("id = 'a'").select("id")).edges.count() == 3


def test_written_forms(graph, spark):
    lines = [r.line for r in store.dot(graph).collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and '  "a" -> "b" [label="Calls"];' in lines
    row = json.loads(store.envelope(graph.nodes.where("id = 'a'").select("id", "score"), "node").first().value)
    assert row == {"schema_version": 1, "type": "node", "data": {"id": "a", "score": 1.0}}
    assert json.loads(store.json_schema(graph.edges))["properties"] == {"src": {"type": "string"}, "dst": {"type": "string"}, "kind": {"type": "string"}, "weight": {"type": "number"}}
    found = spark.createDataFrame([("r1", "error", "bad", "x.rs", 3)], "rule string, level string, message string, path string, line int")
    one = json.loads(store.sarif(found).first().value)
    assert one["ruleId"] == "r1" and one["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    times = spark.createDataFrame([("a", 5), ("b", 5)], "path string, indexed_at long")
    assert [r.path for r in store.stale_files(times, spark.createDataFrame([("a", 6), ("b", 5)], "path string, modified long")).collect()] == ["a"]
