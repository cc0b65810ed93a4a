"""Types and boundaries: hierarchies, types that reach functions, generics, exports, call sites of a signature."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.traverse import ROUNDS_A_TABLE
from codeloom.plans.cut import cut, cut_by, drop
from codeloom.plans.graph import CALL_KINDS, TYPE_KINDS, PropertyGraph


def trait_hierarchies(g: PropertyGraph) -> DataFrame:
    """(trait, implementor, n): a row for each direct implementor of a trait, with their number; a trait without any has one row with null and 0."""
    made = g.edges_of_kind("Implements").select(F.col("dst").alias("trait"), F.col("src").alias("implementor")).distinct()
    n = made.groupBy("trait").agg(F.count("*").alias("n"))
    traits = g.of_kind("Trait").select(F.col("id").alias("trait")).join(n, "trait", "left")
    return traits.join(made, "trait", "left").select("trait", "implementor", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass
class TypeSets:
    """Sets of types by owner, each as rows (id, t), t the number of a name.

    out: what comes out of a function; passed: what its callees get beyond that, which is the implementors of traits in it;
    own: what comes into a function with no caller or several; single: (id, caller) of the functions with one caller, into
    which comes what that caller's out and passed hold; names: (t, type).
    """

    out: DataFrame
    passed: DataFrame
    own: DataFrame
    single: DataFrame
    names: DataFrame


def _with_implementors(g: PropertyGraph, rows: DataFrame, kinds: DataFrame, numbers: DataFrame) -> tuple[Callable, DataFrame]:
    """A function that adds the implementors of traits to rows(id, t, trait), and numbers(type, t) with their names. Where no row is a trait, it adds nothing and the implementors are not read."""
    if not rows.where("trait").limit(1).count():
        return lambda df: df, numbers
    ends = g.edges_of_kind("Implements").select("src", "dst").distinct()
    ends = ends.join(g.of_kind("Trait").select(F.col("id").alias("dst"), F.col("name").alias("of")).where("of is not null").distinct(), "dst")
    made = cut(ends.join(g.nodes.select(F.col("id").alias("src"), F.col("name").alias("type")), "src").select("of", "type").distinct())
    # an implementor need not be of a type's kind; those numbers are below all others
    more = made.select("type").where("type is not null").distinct().join(numbers, "type", "left_anti")
    numbers = cut(numbers.unionByName(more.select("type", (-2 - F.monotonically_increasing_id()).alias("t"))))
    of = numbers.select(F.col("type").alias("of"), F.col("t").alias("of_t"))
    impl = made.join(of, "of").join(numbers, "type", "left").select("of_t", F.coalesce("t", F.lit(_NO_NAME)).alias("t"))
    impl = cut(impl.join(kinds.select("t", "trait").distinct(), "t", "left").select("of_t", "t", F.coalesce("trait", F.lit(False)).alias("trait")))

    def expand(df: DataFrame) -> DataFrame:
        come = df.where("trait").select("id", F.col("t").alias("of_t")).join(impl, "of_t").select("id", "t", "trait")
        return df.unionByName(come).distinct()

    return expand, numbers


#: The number of a type without a name.
_NO_NAME = -1


def type_sets(g: PropertyGraph) -> TypeSets:
    """The types that may come into functions and out of them, as sets.

    A function starts with the types it uses on both sides, a trait among them with its
    implementors; a callee's inputs take its callers' results, a caller's
    results its callees', until nothing is new. So a caller's results hold all
    that a callee starts with, and the callees of one caller alone share its
    set, which is not written for each of them.
    """
    n = 4 * int(g.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    functions = g.of_kind("Function").select("id")
    named = g.of_kind(*TYPE_KINDS).groupBy(F.col("name").alias("type")).agg(F.max(F.col("kind") == "Trait").alias("trait"))
    kinds = cut(named.select("type", F.when(F.col("type").isNull(), _NO_NAME).otherwise(F.monotonically_increasing_id()).alias("t"), (F.col("trait") & F.col("type").isNotNull()).alias("trait")))
    numbers = kinds.where("type is not null").select("type", "t")
    nodes = g.of_kind(*TYPE_KINDS).select(F.col("id").alias("dst"), F.col("name").alias("type"))
    nodes = nodes.join(kinds, nodes.type.eqNullSafe(kinds.type)).select("dst", "t", "trait")
    # dealt by function once: the test for functions, the repeats and the buckets need no other exchange
    used = g.edges_of_kind("UsesType").select("src", "dst").join(nodes, "dst").select(F.col("src").alias("id"), "t", "trait").repartition(n, "id")
    used = cut_by(used.join(functions, "id", "left_semi").distinct(), "id")
    expand, numbers = _with_implementors(g, used, kinds, numbers)
    seeds = cut_by(expand(used), "id") if used.where("trait").limit(1).count() else used

    calls = g.edges_of_kind("Calls").select("src", "dst").join(functions.withColumnRenamed("id", "src"), "src", "left_semi").repartition(n, "dst")
    calls = cut_by(calls.join(functions.withColumnRenamed("id", "dst"), "dst", "left_semi").distinct(), "dst")
    callers, called = cut(calls.select(F.col("src").alias("id")).distinct()), calls.select(F.col("dst").alias("id")).distinct()
    again = cut(callers.join(called, "id", "left_semi"))  # only what these take goes on
    own = cut(seeds.join(callers, "id", "left_semi"))  # only callers take what they may have already
    fresh, found = seeds, []
    while True:  # results go up the calls first, as inputs do not feed them
        up = calls.join(fresh, calls.dst == fresh.id).select(F.col("src").alias("id"), "t", "trait").repartition(n, "id").distinct()
        for have in (own, *found):
            if have.limit(1).count():
                up = up.join(have, ["id", "t"], "left_anti")
        new = cut_by(up, "id")
        found.append(new)
        if len(found) > ROUNDS_A_TABLE:
            old, found = found, [cut_by(_all(found), "id")]
            drop(*old[:-1])  # the last one is what the next round reads
        fresh = new.join(again, "id", "left_semi")
        if not fresh.limit(1).count():
            break
    drop(own)
    out = _all([seeds, *found])
    passed = out.limit(0).select("id", "t")
    if seeds.where("trait").limit(1).count():
        passed = cut(expand(out.join(callers, "id", "left_semi")).join(out, ["id", "t"], "left_anti").select("id", "t"))
    near = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("caller"))
    several = calls.join(near.where("n > 1").select(F.col("id").alias("dst")), "dst", "left_semi")
    come = several.join(out, several.src == out.id).select(F.col("dst").alias("id"), "t", "trait").distinct()
    alone = seeds.join(called, "id", "left_anti")
    return TypeSets(out.select("id", "t"), passed, expand(come.unionByName(alone)).select("id", "t"), near.where("n = 1").select("id", "caller"), numbers)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _flows(s: TypeSets) -> DataFrame:
    """(id, input, t): the types that come into a function and out of it; a caller's out and passed go to each callee that has no other caller."""
    given = s.single.join(s.out.unionByName(s.passed).withColumnRenamed("id", "caller"), "caller").select("id", "t")
    return s.out.withColumn("input", F.lit(False)).unionByName(given.unionByName(s.own).withColumn("input", F.lit(True)))


def possible_types(g: PropertyGraph) -> DataFrame:
    """(id, input, type): type names that may come into a function (input) or out of it, a row for each."""
    s = type_sets(g)
    return _flows(s).join(s.names, "t", "left").select("id", "input", "type")


def possible_type_counts(g: PropertyGraph) -> DataFrame:
    """(id, input, types): how many types may come into a function (input) or out of it, counted in the set that each function gets.

    A callee's types come together in the task that joins its caller's set, so
    they are counted there and one row a function is exchanged.
    """
    return _flows(type_sets(g)).groupBy("id", "input").agg(F.count("*").alias("types"))


def instantiations(g: PropertyGraph) -> DataFrame:
    """(generic, callsite, type_args): callers that say with which types they use a generic function, struct or enum, from the metadata of both."""
    own = g.of_kind("Function", "Struct", "Enum").where(g.meta("generic_params").startswith("[") & (g.meta("generic_params") != "[]")).select(F.col("id").alias("generic"), "name")
    ends = g.edges_of_kind("Calls", "UsesType").select(F.col("src").alias("callsite"), F.col("dst").alias("generic")).distinct()
    given = g.nodes.select(F.col("id").alias("callsite"), F.from_json(g.meta("callee_type_args"), "map<string,array<string>>").alias("given")).where("given is not null")
    return ends.join(own, "generic").join(given, "callsite").select("generic", "callsite", F.try_element_at("given", "name").alias("type_args")).where(F.size("type_args") > 0)


def boundaries(g: PropertyGraph) -> DataFrame:
    """(kind, id, name, method, file_path): HTTP routes, foreign exports, and exports and imports of WebAssembly that functions' metadata names."""
    m = g.meta
    entry = lambda kind, name, method=F.lit(None).cast("string"): F.when(name.isNotNull(), F.struct(F.lit(kind).alias("kind"), name.alias("name"), method.alias("method")))
    imported = F.when(m("wasm_import_module").isNotNull() & m("wasm_import_name").isNotNull(), F.concat_ws(".", m("wasm_import_module"), m("wasm_import_name")))
    found = F.array_compact(F.array(entry("http_route", m("http_route"), F.coalesce(F.upper(m("http_method")), F.lit("GET"))), entry("ffi_export", m("ffi_export")), entry("wasm_export", m("wasm_export")), entry("wasm_import", imported)))
    return g.of_kind("Function").select("id", "file_path", F.explode(found).alias("b")).select("b.kind", "id", "b.name", "b.method", "file_path")


def cascade(g: PropertyGraph, targets: DataFrame) -> DataFrame:
    """(target, file_path, caller, n): who calls each of targets(id), a row for a caller, with the number of callers in its file."""
    wanted = targets.select(F.col("id").alias("dst")).distinct()
    near = g.edges_of_kind(*CALL_KINDS).join(wanted, "dst", "left_semi").select(F.col("dst").alias("target"), F.col("src").alias("id")).distinct()
    rows = g.nodes.select("id", "file_path").join(near, "id").select("target", "file_path", F.col("id").alias("caller"))
    return rows.join(rows.groupBy("target", "file_path").agg(F.count("*").alias("n")), ["target", "file_path"]).select("target", "file_path", "caller", "n")


def arity(g: PropertyGraph, changes: DataFrame) -> DataFrame:
    """(target, id, name, compatible, reason) of each direct caller of changes(id, old, new), signatures that go from `old` to `new` parameters."""
    c = changes.select(F.col("id").alias("target"), "old", "new")
    near = g.edges_of_kind("Calls").select(F.col("dst").alias("target"), F.col("src").alias("id")).distinct().join(c, "target")
    same = F.col("old") == F.col("new")
    reason = F.when(~same, F.concat(F.lit("passes "), F.col("old").cast("string"), F.lit(" args, but new signature expects "), F.col("new").cast("string")))
    return g.nodes.select("id", "name").join(near, "id").select("target", "id", "name", same.alias("compatible"), reason.alias("reason"))


def symbol_handles(nodes: DataFrame) -> DataFrame:
    """nodes with handle: kind:qualified name, and #n from the second of one handle on, by file and id."""
    base = F.concat_ws(":", F.lower("kind"), "qualified_name")
    n = F.row_number().over(Window.partitionBy("__base").orderBy("file_path", "id"))
    return nodes.withColumn("__base", base).withColumn("__n", n).withColumn("handle", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("#", "__base", F.col("__n").cast("string")))).drop("__base", "__n")


def enriched(g: PropertyGraph, locations: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) for unresolved calls that locations(src, name, file_path, line) of another tool place inside a symbol; the symbol that starts last before the line holds it.

    Needs nodes with line and end_line.
    """
    open_calls = g.edges_of_kind("UnresolvedCall").select("src", F.col("dst").alias("name")).distinct()
    spans = g.nodes.select(F.col("id").alias("dst"), "file_path", F.col("line").alias("first"), "end_line")
    held = open_calls.join(locations, ["src", "name"]).join(spans, "file_path").where("line between first and end_line")
    return held.groupBy("src", "name").agg(F.max_by("dst", F.struct("first", "dst")).alias("dst")).select("src", "dst", F.lit("Calls").alias("kind"))
