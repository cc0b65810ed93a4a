"""The term index: stems, compounds, words that meet in a file, updates by batches; and new tiers of reference resolution."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import facade, lookup, resolve
from codeloom.plans.graph import PropertyGraph
from codeloom.sources import terms
from codeloom.sources.terms import TermIndex

ROWS = [("1", "getUserName", "a.py"), ("2", "user_cache", "a.py"), ("3", "CachingHandler", "b.py"), ("4", "entries", "b.py"), ("5", "nameUser", "c.py"), ("6", "entry_handle", "c.py"), ("7", "unrelated", "d.py")]


def nodes(spark, rows):
    return spark.createDataFrame([(i, "Function", n, f"m::{n}", f) for i, n, f in rows], "id string, kind string, name string, qualified_name string, file_path string")


@pytest.mark.parametrize("words", [("caching", "cache", "caches", "cached"), ("entries", "entry"), ("running", "run", "runs", "runner"), ("handler", "handle", "handling", "handlers"), ("management", "manage", "managed"), ("class", "classes"), ("errors", "error"), ("process", "processes", "processed"), ("eviction", "evict")])
def test_stems_of_a_family_are_one(words):
    assert len({terms.stem_of(w) for w in words}) == 1


def test_stems_in_spark_are_those_of_queries(spark):
    words = ["caching", "red", "ring", "is", "s", "", "glass", "status", "boxes", "carried", "freed", "user", "stopped", "ies", "tion", "äë", "x1s"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", terms.stem(F.col("w")).alias("s")).collect()
    assert all(r.s == terms.stem_of(r.w) for r in rows)


def test_matches_phrases_and_updates(spark, tmp_path):
    index = TermIndex.build(nodes(spark, ROWS), str(tmp_path / "ix"))
    got = lambda q: {r.id: (r.hits, r.phrases, r.together) for r in index.matches(q).collect()}
    assert got("userName") == {"1": (2, 1, 2), "2": (1, 0, 2), "5": (2, 0, 2)}
    assert got("cached handlers") == {"2": (1, 0, 1), "3": (2, 0, 2), "6": (1, 0, 1)}
    assert got("entry") == {"4": (1, 0, 1), "6": (1, 0, 1)} and got("...") == {} and got("nothing") == {}
    ranked = [r.id for r in index.search("userName").orderBy(F.desc("score")).collect()]
    assert ranked[0] == "1" and set(ranked) == {"1", "2", "5"}
    before = set(spark.read.parquet(str(tmp_path / "ix" / "postings")).inputFiles())
    index.update(nodes(spark, [("1", "getOrder", "a.py"), ("8", "userCount", "e.py")]), spark.createDataFrame([("5",), ("8",), ("none",)], "id string"))
    assert got("userName") == {"2": (1, 0, 1), "8": (1, 0, 1)} and got("order") == {"1": (1, 0, 1)}
    assert before < set(spark.read.parquet(str(tmp_path / "ix" / "postings")).inputFiles())  # nothing was written again
    plan = index.postings(["user"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters:")[1][:200]
    assert {r.id for r in lookup.find(nodes(spark, ROWS), "caches", index=index).collect()} == {"2", "3"}
    empty = TermIndex.build(nodes(spark, []), str(tmp_path / "none"))
    assert empty.search("user").count() == 0 and empty.matches("user").count() == 0


def test_aliases_and_chains_are_tiers(spark):
    symbols = spark.createDataFrame([("f1", "box.ts", "File", "src/ui/box.ts", "src/ui/box.ts"), ("m1", "open", "Method", "Box::open", "src/ui/box.ts"), ("m2", "size", "Method", "Door::size", "src/ui/box.ts"), ("s1", "size", "Function", "size", "other.ts")], "id string, name string, kind string, qualified_name string, path string")
    refs = spark.createDataFrame([("r1", "@/ui/box", "src/main.ts"), ("r2", "b.open(1).size()", "src/main.ts"), ("r3", "b.none().size()", "src/main.ts")], "ref_id string, name string, path string")
    table = spark.createDataFrame([("", "@/*", "src/*", 0)], "root string, pattern string, target string, place int")
    members = spark.createDataFrame([("Box", "open", "Door", "m1"), ("Door", "size", None, "m2")], "type string, member string, returns string, id string")
    typed = spark.createDataFrame([("src/main.ts", "b", "Box")], "path string, variable string, type string")
    got = {r.ref_id: (r.id, r.how) for r in resolve.resolve(refs, symbols, typed=typed, alias_table=table, members=members).collect()}
    assert got["r1"] == ("f1", "alias") and got["r2"] == ("m2", "call-chain") and got.get("r3", ("", ""))[1] != "call-chain"


def test_context_does_not_depend_on_company(spark):
    e = [("r", "m", "Contains"), ("m", "c", "Contains"), ("c", "f", "Contains"), ("m", "g", "Contains"), ("f", "g", "Calls"), ("x", "f", "Contains")]
    n = [(i, "Function", i, i, "a") for i in "rmcfgx"]
    g = PropertyGraph(spark.createDataFrame(n, "id string, kind string, name string, qualified_name string, file_path string"), spark.createDataFrame([(*x, 1.0) for x in e], "src string, dst string, kind string, weight double"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    of = lambda df, i: sorted((r.role, r.other) for r in df.collect() if r.id == i)
    alone, many = facade.node_context(g, ids("f")), facade.node_context(g, ids("f", "g", "m"))
    assert of(alone, "f") == of(many, "f") == [("ancestor", "c"), ("ancestor", "m"), ("ancestor", "r"), ("ancestor", "x"), ("outgoing", "g")]
    assert of(many, "g") == [("ancestor", "m"), ("ancestor", "r"), ("incoming", "f")]


def test_exported_symbols_partial_structs_and_folders(spark):
    n = spark.createDataFrame([("f", "Function", "f", "d/a", True), ("g", "Function", "g", "d/a", False), ("h", "Function", "h", "b", False), ("S", "Struct", "S", "b", False), ("S.x", "Field", "x", "b", False), ("S.y", "Field", "y", "b", False)], "id string, kind string, name string, file_path string, exported boolean")
    e = spark.createDataFrame([("g", "h", "Calls"), ("g", "f", "Calls"), ("S", "S.x", "Contains"), ("S", "S.y", "Contains"), ("g", "S.x", "References"), ("g", "S.x", "References"), ("h", "S.x", "References"), ("h", "S.y", "References")], "src string, dst string, kind string")
    files = n.select("file_path")
    assert sorted((r.file_path, r.id) for r in facade.exported_symbols(n, e, files).collect()) == [("b", "S.x"), ("b", "h"), ("d/a", "f")]
    assert sorted(map(tuple, facade.partial_structs(n, e).collect())) == [("g", "S", 1, 2, 0.5), ("h", "S", 2, 2, 1.0)]
    assert sorted(map(tuple, facade.field_projection(n, e, spark.createDataFrame([("g",)], "id string")).collect())) == [("g", "S", "S.x")]
    assert sorted(map(tuple, facade.module_structure(n).collect())) == [("", "b", 1), ("d", "d/a", 1)]


def test_distances_from_sources(spark):
    import random

    from codeloom.operators.facade import all_pairs, distances_from

    rng = random.Random(3)
    e = spark.createDataFrame([(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", float(rng.randint(1, 9))) for _ in range(25)], "src string, dst string, weight double")
    every = {(r.a, r.b): r.distance for r in all_pairs(e).collect()}
    got = {(r.source, r.id): r.distance for r in distances_from(e, spark.createDataFrame([("n1",), ("n4",)], "id string")).collect()}
    assert got == {k: v for k, v in every.items() if k[0] in ("n1", "n4")}
    with pytest.raises(ValueError, match="negative"):
        distances_from(spark.createDataFrame([("a", "b", 1.0), ("b", "a", -2.0)], e.schema), spark.createDataFrame([("a",)], "id string"))


def test_a_store_is_compacted_and_cleared(spark, tmp_path):
    from codeloom.sources.store import GraphStore

    n = nodes(spark, ROWS).repartition(5)
    e = spark.createDataFrame([("1", "2", "Calls", 1.0)], "src string, dst string, kind string, weight double")
    store = GraphStore(spark, str(tmp_path / "g"))
    for _ in range(3):
        store.save(PropertyGraph(n, e), {"k": "v"})
    now = store.compact()
    assert store.generations() == [now - 1, now] and len(store.load().nodes.inputFiles()) == 1
    assert sorted(r.id for r in store.load().nodes.collect()) == [r[0] for r in ROWS] and store.metadata().first().value == "v"
    store.clear()
    assert store.generations() == []
