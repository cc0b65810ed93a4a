"""JSON columns, patterns for paths, directories with forced and excluded files, states of an index, work that is given up."""

import time

import pytest
from pyspark.sql import functions as F

from codeloom.functions import structured, text
from codeloom.operators import traverse
from codeloom.plans import cancel
from codeloom.sources import readers, store


def test_json_columns(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": ["x", "y"]}'), (2, '["p", null, 3]'), (3, "{broken"), (4, None), (5, "{}")], "id long, j string")
    got = sorted((r.id, r.key, r.value) for r in structured.json_each(rows, "j").collect())
    assert got == [(1, "a", "1"), (1, "b", '["x","y"]'), (2, "0", "p"), (2, "1", None), (2, "2", "3")]
    lists = {r.id: r.m for r in rows.select("id", structured.json_lists(F.col("j")).alias("m")).collect()}
    assert lists[1] == {"a": [], "b": ["x", "y"]} and lists[2] == lists[4] == {}
    assert [r[0] for r in rows.orderBy("id").select(structured.json_at(F.col("j"), "$.b[1]")).collect()] == ["y", None, None, None, None]


@pytest.mark.parametrize("pattern,path,hit", [("src/*.rs", "src/a.rs", True), ("src/*.rs", "src/b/a.rs", False), ("src/**/*.rs", "src/a.rs", True), ("src/**/*.rs", "src/b/c/a.rs", True), ("**", "a/b", True), ("?.{py,pyi}", "a.pyi", True), ("?.{py,pyi}", "ab.py", False), ("a.b", "axb", False), ("{}", "{}", True), ("x{a,}y", "xay", True), ("[a]", "[a]", True)])
def test_path_globs(spark, pattern, path, hit):
    import re

    assert bool(re.match(text.path_glob(pattern), path)) is hit
    if pattern.startswith("src/**"):
        assert spark.range(1).select(text.matches_glob(F.lit(path), "no", pattern)).first()[0] is hit


def test_directories_with_forced_and_excluded_files(spark, tmp_path):
    for name in ("a.py", "src/b.py", "src/c.rs", "vendor/d.py", "vendor/keep/e.py", "src/gen/f.py", "g.zig", "h.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    names = lambda **how: sorted(r.path.split(f"{tmp_path}/")[1] for r in readers.scan_directory(spark, str(tmp_path), **how).collect())
    assert names() == ["a.py", "src/b.py", "src/c.rs", "src/gen/f.py"]
    assert names(forced=("vendor/keep/**",), exclude=("**/gen/*",), endings={"zig": "zig"}) == ["a.py", "g.zig", "src/b.py", "src/c.rs", "vendor/keep/e.py"]
    assert names(include=("src/**",), forced=("vendor/d.py",), exclude=("src/gen/**",)) == ["src/b.py", "src/c.rs", "vendor/d.py"]


def test_states_of_an_index(spark):
    files = lambda *x: spark.createDataFrame([*x], "path string, content_hash string, indexed_at long")
    one = files(("a", "1", 5), ("b", "2", 7))
    state = lambda i, f, *v: tuple(store.index_state(i, f, *v).first())
    assert state(one, one, "v2", "v2") == ("fresh", 2, 0, 7, False)
    assert state(one, files(("a", "9", 0), ("b", "2", 0)), "v2", "v1") == ("stale", 2, 1, 7, True)
    assert state(files(), one)[:2] == ("none", 0)


def test_work_is_given_up(spark):
    slow = spark.range(8).repartition(8).select(F.expr("reflect('java.lang.Thread', 'sleep', 4000L)").alias("x"))
    began = time.time()
    with pytest.raises(cancel.Cancelled):
        cancel.run(spark, lambda: [slow.count() for _ in range(1)] and slow.collect(), 1.0)
    assert time.time() - began < 25
    with cancel.cancellable(spark) as handle:
        handle.check()
        assert spark.range(3).count() == 3
    assert not spark.getTags()
    with pytest.raises(cancel.Cancelled), cancel.cancellable(spark) as handle:
        handle.cancel()
        spark.range(3).count()


def test_a_chain_hangs_off_a_ring(spark):
    """Ends of chains are peeled by doubling once layers are many."""
    e = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("c060", "r0"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r1", "t00")] + [(f"t{i:02}", f"t{i + 1:02}") for i in range(40)]
    got = {r.id: r.component for r in traverse.strong_components(spark.createDataFrame(e, "src string, dst string")).collect()}
    assert len(got) == 61 + 3 + 41 and {got[f"r{i}"] for i in range(3)} == {"r2"} and all(k == v for k, v in got.items() if k[0] != "r")
    levels = {r.id: r.level for r in traverse.topological_levels(spark.createDataFrame(e[:12] + [("c000", "c005")], "src string, dst string")).collect()}
    assert levels == {f"c{i:03}": i for i in range(13)}
