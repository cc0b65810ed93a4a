"""Points-to, slices, taint, roles, inside of Python functions, types and resolution on small inputs with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import flow, resolve, types
from codeloom.plans.graph import PropertyGraph
from codeloom.sources import python_flow

SOURCE = '''
def handle(request, limit=3):
    body = request.body
    box = make()
    box.item = body
    out = box.item
    alias = out
    if limit > 2:
        for x in body:
            if x:
                out.append(x)
    else:
        return None
    return send(alias)


def make():
    # nothing in it
    return Box()


def send(data):
    while data and True:
        try:
            check(data)
        except ValueError:
            break
    run(data)
'''


@pytest.fixture(scope="module")
def inside(spark):
    return python_flow.inside(spark.createDataFrame([("m.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, content string")).cache()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def test_blocks_and_jumps(inside):
    assert inside.where("tag = 'error'").count() == 1
    kinds = {r.kind for r in python_flow.blocks(inside).collect()}
    assert kinds == {"Entry", "Exit", "Normal", "Branch", "Loop", "Exception"}
    assert {r.kind for r in python_flow.jumps(inside).collect()} == {"Normal", "BranchTrue", "BranchFalse", "LoopBack", "Return", "Exception", "Break"}
    # every jump joins two blocks of its function
    b = {(r.fn, r.block) for r in python_flow.blocks(inside).collect()}
    assert all((r.fn, r.src) in b and (r.fn, r.dst) in b for r in python_flow.jumps(inside).collect())


def test_summary_of_values(inside):
    own = lambda df: df.where("fn = 'm.py::handle'")
    assert rows(own(python_flow.parameters(inside)), "position", "name", "has_default") == [(0, "request", False), (1, "limit", True)]
    assert rows(own(python_flow.assignments(inside)), "target", "kind") == [("alias", "Other"), ("body", "FieldAccess"), ("box", "CallResult"), ("box.item", "Other"), ("out", "FieldAccess")]
    assert rows(own(python_flow.mutations(inside)), "target", "method") == [("out", "append")]
    assert rows(python_flow.argument_flows(inside), "callee", "param") == [("check", "data"), ("run", "data")]
    assert rows(own(python_flow.returns(inside)), "expression") == [("None",), ("send(alias)",)]


def test_measures(inside):
    got = {r.fn: r for r in python_flow.complexity(inside).collect()}
    h = got["m.py::handle"]
    assert (h.cyclomatic, h.nesting, h.cognitive) == (4, 3, 1 + 2 + 3)
    assert h.volume == pytest.approx((h.total_operators + h.total_operands) * math.log2(h.operators + h.operands))
    assert h.maintainability == pytest.approx(171 - 5.2 * math.log(h.volume) - 0.23 * h.cyclomatic - 16.2 * math.log(h.source))
    assert got["m.py::make"].comments == 1 and got["m.py::make"].source == 2


def test_predicates_and_dominance(inside, spark):
    at = SOURCE[: SOURCE.index("out.append")].count("\n") + 1
    got = python_flow.predicates_at(inside, spark.createDataFrame([("m.py::handle", at)], "fn string, line int"))
    assert rows(got, "rank", "kind", "predicate") == [(1, "if", "x"), (2, "for", "x in body"), (3, "if", "limit > 2")]
    line = lambda s: SOURCE[: SOURCE.index(s)].count("\n") + 1
    pairs = [("m.py::handle", line("box = make"), at), ("m.py::handle", at, line("return send")), ("m.py::send", line("check(data)"), line("run(data)")), ("m.py::send", 1000, line("run(data)"))]
    got = python_flow.guarded(inside, spark.createDataFrame(pairs, "fn string, guard_line int, sink_line int"))
    assert {(r.guard_line, r.sink_line): r.dominates for r in got.collect()} == {pairs[0][1:]: True, pairs[1][1:]: False, pairs[2][1:]: False, pairs[3][1:]: None}


def test_points_to_and_alias(inside, spark):
    c = python_flow.constraints(inside)
    found = flow.points_to(c).cache()
    of = lambda fn, v: {r.place for r in found.where((F.col("fn") == fn) & (F.col("var") == v)).collect()}
    assert of("m.py::handle", "body") == of("m.py::handle", "out") == of("m.py::handle", "alias") == {"m.py::handle/param:request.body"}
    pairs = spark.createDataFrame([("m.py::handle", "body", "alias"), ("m.py::handle", "body", "box"), ("m.py::handle", "no", "box")], "fn string, a string, b string")
    assert rows(flow.may_alias(found, pairs), "a", "b", "alias") == [("body", "alias", True), ("body", "box", False), ("no", "box", False)]
    passed = flow.passed_values(python_flow.calls(inside), python_flow.parameters(inside), python_flow.returns(inside))
    whole = flow.points_to(c, passed).cache()
    places = {r.place for r in whole.where("fn = 'm.py::send' and var = 'data'").collect()}
    assert places == {"m.py::send/param:data", "m.py::handle/param:request.body"}
    assert any(p.startswith("m.py::make/heap") for p in {r.place for r in whole.where("fn = 'm.py::handle' and var = 'box'").collect()})


def test_points_to_stops_at_fields_that_feed_themselves(spark):
    c = [("f", "new", "n", None, None, None, "heap:0"), ("f", "read", "n", "n", "next", None, None)]
    found = flow.points_to(spark.createDataFrame(c, "fn string, op string, dst string, base string, field string, src string, site string"))
    assert {r.place for r in found.collect()} == {"f/heap:0" + ".next" * k for k in range(flow.FIELD_DEPTH + 1)}
    nothing = spark.createDataFrame([], "fn string, op string, dst string, base string, field string, src string, site string")
    assert flow.points_to(nothing).count() == 0


def test_slices(inside):
    d = flow.dependencies(python_flow.constraints(inside))
    seeds = d.sparkSession.createDataFrame([("m.py::handle/alias",)], "id string")
    assert {"m.py::handle/out", "m.py::handle/box", "m.py::handle/body", "m.py::handle/request"} <= {r.id for r in flow.slices(d, seeds).collect()}
    assert {r.id for r in flow.slices(d, seeds, 0).collect()} == {"m.py::handle/alias"}


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_taint_keeps_clean_and_unclean_ways_apart(spark):
    e = spark.createDataFrame([("s", "a"), ("a", "t"), ("s", "g"), ("g", "t"), ("t", "u"), ("u", "s")], "src string, dst string")
    got = flow.taint_flows(e, ids(spark, "s"), ids(spark, "t", "s"), ids(spark, "g"))
    assert sorted((r.source, r.sink, r.sanitizer, tuple(r.path)) for r in got.collect() if r.sanitizer) == [("s", "t", "g", ("s", "g", "t"))]
    assert [(r.source, r.sink, tuple(r.path)) for r in got.where("sanitizer is null").collect()] == [("s", "t", ("s", "a", "t"))]
    assert flow.taint_flows(e, ids(spark), ids(spark, "t"), ids(spark)).count() == 0


def test_scan_suggestions_and_report(spark):
    f = spark.createDataFrame([("1", "read_user_input"), ("2", "execSQLQuery"), ("3", "escapeHtml"), ("4", "plain")], "id string, name string")
    e = spark.createDataFrame([("1", "4"), ("4", "2"), ("1", "3"), ("3", "2")], "src string, dst string")
    assert rows(flow.seeds_by_name(f)) == [("1", "source"), ("2", "sink"), ("3", "sanitizer"), ("3", "sink")]
    found = flow.taint_scan(f, e)
    assert [(r.source, r.sink, r.path, r.priority) for r in found.collect()] == [("1", "2", ["1", "4", "2"], pytest.approx(2.0))]
    assert [(r.source, r.sink) for r in flow.taint_suggestions(f, 1).collect()] == [("1", "2")]
    deviants = spark.createDataFrame([("d", "g", "s")], "deviant string, guard string, sink string")
    roles = spark.createDataFrame([("2", "sink", True), ("9", "sink", False)], "id string, role string, verified boolean")
    assert rows(flow.vulnerability_report(found, deviants, roles)) == [("missing_guard", "medium", "d", "g before s"), ("role", "low", "2", "verified sink"), ("taint", "high", "2", "1")]


def test_roles(spark):
    calls = spark.createDataFrame([("a", "guard", 1), ("a", "sink", 5), ("b", "sink", 2), ("b", "late", 9), ("c", "clean", 1), ("sink", "sink", 1)], "caller string, callee string, line int")
    p = spark.createDataFrame([(n, r, 0.5) for n, r in [("guard", "guard"), ("late", "guard"), ("sink", "sink"), ("clean", "sink"), ("clean", "sanitizer"), ("a", "source"), ("guard", "source")]], "id string, role string, confidence double")
    got = {(r.id, r.role): r.verified for r in flow.verified_roles(p, calls, 2).collect()}
    assert got == {("guard", "guard"): True, ("late", "guard"): False, ("sink", "sink"): True, ("clean", "sink"): False, ("clean", "sanitizer"): True, ("a", "source"): True, ("guard", "source"): False}
    commits = spark.createDataFrame([("Fix overflow", "+++ b\n+ check_len(x); check_len(y)\n- strcpy(x)\n if (a)"), ("security", "+  check_len(z)"), ("docs", "+ other()")], "message string, diff string")
    assert rows(flow.roles_of_fixes(commits)) == [("check_len", "guard", pytest.approx(0.64), 2), ("strcpy", "sink", pytest.approx(0.4), 1)]


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "v string").select(*columns).first()


def test_text_functions(spark):
    v = F.col("v")
    assert one(spark, "execSQLQuery_v2", text.name_parts(v))[0] == ["exec", "sql", "query", "v2"]
    assert one(spark, None, text.name_parts(v))[0] == []
    assert one(spark, "foo", text.flow_priority(v, v))[0] == 10.0 and one(spark, "input", text.flow_priority(v, v))[0] == 1.0
    assert [one(spark, s, text.intent(v))[0] for s in ("fix the add button", "how does it work", "add a thing", "hm", None)] == ["bug", "exploration", "feature", "unknown", "unknown"]
    assert one(spark, "Patch CVE", text.is_fix(v))[0] is True
    assert one(spark, r".\a\\b/./c/", text.normal_path(v))[0] == "a/b/c"
    assert one(spark, "a/b/c.py", text.proximity(v, F.lit("a/b/d.py")), text.proximity(v, F.lit("a/x/d.py")), text.proximity(v, F.lit("c.py")))[:] == (30, 15, 0)
    assert one(spark, "/** Says\n * hello\n */", text.clean_docstring(v))[0] == "Says\nhello"
    assert one(spark, "// one\n// two", text.clean_docstring(v))[0] == "one\ntwo"

    def fnv(b, h=2166136261):
        for x in b:
            h = (h ^ x) * 16777619 % 2**32
        return h

    for s in ("", "a", "foobar", "äß€"):
        assert one(spark, s, text.fnv1a(v))[0] == fnv(s.encode())
    got = one(spark, "ok\na‮b​\x07\U0001fffe é", text.hazards(v))[0]
    assert [(h.codepoint, h.line, h.column, h.category) for h in got] == [(0x202E, 2, 2, "bidi"), (0x200B, 2, 4, "zero_width"), (7, 2, 5, "control"), (0xE000, 2, 6, "private_use"), (0x1FFFE, 2, 7, "noncharacter")]
    assert one(spark, "a = 1  # x\n", text.semantic_hash(v))[0] == one(spark, "a =  1 /* y */", text.semantic_hash(v))[0] != one(spark, "a = 2", text.semantic_hash(v))[0]
    assert one(spark, "a*b?[c]", text.escaped_glob(v))[0] == "a[*]b[?][[]c[]]"


def graph(spark, nodes, edges):
    n = spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, file_path string, metadata map<string,string>")
    return PropertyGraph(n, spark.createDataFrame(edges, "src string, dst string, kind string"))


def test_types(spark):
    nodes = [("f", "Function", "f", "f", "a.rs", {"callee_type_args": '{"g": ["int"]}', "http_route": "/x", "http_method": "post"}), ("g", "Function", "g", "g", "b.rs", {"generic_params": '["T"]', "ffi_export": "g"}), ("h", "Function", "h", "h", "b.rs", {"wasm_import_module": "env", "wasm_import_name": "h"}), ("T", "Trait", "T", "T", "t.rs", {}), ("U", "Trait", "U", "U", "t.rs", {}), ("S", "Struct", "S", "S", "t.rs", {}), ("R", "Struct", "R", "R", "t.rs", {})]
    g = graph(spark, nodes, [("f", "g", "Calls"), ("h", "f", "Calls"), ("f", "T", "UsesType"), ("S", "T", "Implements"), ("g", "R", "UsesType")])
    assert rows(types.trait_hierarchies(g)) == [("T", "S", 1), ("U", None, 0)]
    got = {(r.id, r.input): set() for r in types.possible_types(g).collect()}
    for r in types.possible_types(g).collect():
        got[r.id, r.input].add(r.type)
    assert got == {("f", False): {"T", "S", "R"}, ("f", True): {"T", "S", "R"}, ("g", True): {"T", "S", "R"}, ("g", False): {"R"}, ("h", False): {"T", "S", "R"}}
    assert rows(types.instantiations(g)) == [("g", "f", ["int"])]
    assert sorted((r.kind, r.id, r.name, r.method) for r in types.boundaries(g).collect()) == [("ffi_export", "g", "g", None), ("http_route", "f", "/x", "POST"), ("wasm_import", "h", "env.h", None)]
    assert rows(types.cascade(g, spark.createDataFrame([("g",), ("f",)], "id string"))) == [("f", "b.rs", "h", 1), ("g", "a.rs", "f", 1)]
    changes = spark.createDataFrame([("g", 1, 2), ("f", 3, 3)], "id string, old int, new int")
    assert rows(types.arity(g, changes)) == [("f", "h", "h", True, None), ("g", "f", "f", False, "passes 1 args, but new signature expects 2")]
    twice = spark.createDataFrame([("1", "Function", "m::f", "a"), ("2", "Function", "m::f", "b")], "id string, kind string, qualified_name string, file_path string")
    assert rows(types.symbol_handles(twice), "id", "handle") == [("1", "function:m::f"), ("2", "function:m::f#2")]


def test_possible_types_agree_with_brute_force(spark):
    """Cycles, several callers, traits of traits, a trait that a function implements, types without a name; callees of one caller share its set."""
    rnd = random.Random(4)
    fs = [f"f{i}" for i in range(24)]
    kinds = {**{f: "Function" for f in fs}, **{t: "Trait" for t in ("T0", "T1", "T2")}, **{f"S{i}": "Struct" for i in range(6)}}
    name = lambda x: {"S4": None, "S5": "S3"}.get(x, x)
    calls = {(rnd.choice(fs[:12]), rnd.choice(fs)) for _ in range(22)}
    uses = {(rnd.choice(fs), rnd.choice([x for x in kinds if x not in fs])) for _ in range(26)}
    impl = {("T1", "T0"), ("S0", "T1"), ("S1", "T0"), ("f3", "T2"), ("S4", "T2")}
    edges = [(a, b, k) for k, pairs in (("Calls", calls), ("UsesType", uses), ("Implements", impl)) for a, b in sorted(pairs)]
    g = graph(spark, [(x, k, name(x), x, "a", {}) for x, k in kinds.items()], edges * 2)
    expand = lambda ts: ts | {name(s) for s, t in impl if t in ts}
    seeds = {f: expand({name(t) for x, t in uses if x == f}) for f in fs}
    out = {f: set(seeds[f]) for f in fs}
    for _ in fs:
        for a, b in calls:
            out[a] |= out[b]
    into = {f: expand(seeds[f].union(*(out[a] for a, b in calls if b == f))) for f in fs}
    want = sorted((str((f, i)), str(t)) for i, sets in ((False, out), (True, into)) for f in fs for t in sets[f])
    assert sorted((str((r.id, r.input)), str(r.type)) for r in types.possible_types(g).collect()) == want
    star = graph(spark, [("c", "Function", "c", "c", "a", {})] + [(f"{k[0]}{i}", k, f"{k[0]}{i}", "q", "a", {}) for i in range(30) for k in ("Function", "Struct")], [("c", f"F{i}", "Calls") for i in range(30)] + [(f"F{i}", f"S{i}", "UsesType") for i in range(30)])
    s = types.type_sets(star)
    assert s.out.count() == 60 and s.own.count() == s.passed.count() == 0
    assert sorted((r.id, r.input, r.types) for r in types.possible_type_counts(star).collect()) == sorted([("c", False, 30)] + [(f"F{i}", x, n) for i in range(30) for x, n in ((False, 1), (True, 30))])


def test_counts_are_of_the_sets_that_callees_get(spark, monkeypatch):
    """Types that are taken out of one callee's set only, on their way from the caller, are missing from its count only."""
    plain, kinds = types._flows, ("Function", "Struct")
    nodes = [(x, kinds[x[0] == "S"], x, "q", "a", {}) for x in ("c", "f", "g", "S0", "S1", "S2")]
    star = graph(spark, nodes, [("c", "f", "Calls"), ("c", "g", "Calls"), ("f", "S0", "UsesType"), ("g", "S1", "UsesType"), ("c", "S2", "UsesType")])
    count = lambda: {(r.id, r.input): r.types for r in types.possible_type_counts(star).collect()}
    want = {("c", False): 3, ("c", True): 1, ("f", False): 1, ("g", False): 1, ("f", True): 3, ("g", True): 3}
    assert count() == want
    some = lambda s: plain(s).join(s.names, "t").where("not (id = 'f' and input and type <> 'S0')").select("id", "input", "t")
    monkeypatch.setattr(types, "_flows", some)
    assert count() == {**want, ("f", True): 1}


def test_enriched_calls(spark):
    n = spark.createDataFrame([("a", "m.py", 1, 20), ("b", "m.py", 5, 9)], "id string, file_path string, line int, end_line int")
    g = PropertyGraph(n, spark.createDataFrame([("x", "foo", "UnresolvedCall"), ("x", "bar", "UnresolvedCall")], "src string, dst string, kind string"))
    at = spark.createDataFrame([("x", "foo", "m.py", 6), ("x", "bar", "other.py", 6)], "src string, name string, file_path string, line int")
    assert rows(types.enriched(g, at)) == [("x", "b", "Calls")]


SYMBOLS = [
    ("1", "helper", "Function", "util::helper", "src/util/a.py", "python", 3),
    ("2", "helper", "Function", "other::helper", "lib/b.py", "python", 3),
    ("3", "helper", "Function", "js::helper", "src/util/c.js", "javascript", 3),
    ("4", "Engine", "Class", "core::Engine", "src/core/engine.py", "python", 1),
    ("5", "start", "Method", "core::Engine::start", "src/core/engine.py", "python", 2),
    ("6", "start", "Method", "Car::start", "src/car.py", "python", 2),
    ("7", "Lone", "Function", "x::Lone", "x.py", "python", 1),
    ("8", "menu.liquid", "File", "src/snippets/menu.liquid", "src/snippets/menu.liquid", "liquid", 1),
    ("9", "foreign", "Function", "foreign", "y.js", "javascript", 1),
    ("10", "stop", "Method", "Motor::stop", "m.py", "python", 1),
]


def test_resolution_tiers(spark):
    s = spark.createDataFrame(SYMBOLS, "id string, name string, kind string, qualified_name string, path string, language string, line int")
    asked = [("same", "helper", "src/util/a.py"), ("near", "helper", "src/util/z.py"), ("far", "helper", "q.py"), ("only", "Lone", "q.py"), ("cross", "foreign", "q.py"), ("file", "snippets/menu.liquid", "q.py"), ("qual", "util::helper", "q.py"), ("end", "Engine::start", "q.py"), ("class", "Engine.start", "q.py"), ("var", "engine.start", "q.py"), ("words", "carPart.start", "q.py"), ("lonely", "m.stop", "q.py"), ("low", "LONE", "q.py"), ("none", "nothing", "q.py"), ("imp", "h2", "src/core/x.py")]
    r = spark.createDataFrame([(a, b, c, "Calls", "python", 1) for a, b, c in asked], "ref_id string, name string, path string, kind string, language string, line int")
    i = spark.createDataFrame([("src/core/x.py", "h2", "../util/a", "helper")], "path string, local string, source string, original string")
    got = {x.ref_id: (x.id, round(x.confidence, 2), x.how) for x in resolve.resolve(r, s, i).collect()}
    assert got == {
        "same": ("1", 0.7, "exact-match"), "near": ("1", 0.7, "exact-match"), "far": ("1", 0.4, "exact-match"), "only": ("7", 0.9, "exact-match"), "cross": ("9", 0.5, "exact-match"),
        "file": ("8", 0.85, "file-path"), "qual": ("1", 0.95, "qualified-name"), "end": ("5", 0.85, "qualified-name"), "class": ("5", 0.85, "instance-method"), "var": ("5", 0.8, "instance-method"),
        "words": ("6", 0.65, "instance-method"), "lonely": ("10", 0.7, "instance-method"), "low": ("7", 0.5, "fuzzy"), "imp": ("1", 0.9, "import"),
    }
    assert {x.ref_id for x in resolve.prefilter(r, s, i, ("helper",)).collect()} == set(got) - {"same", "near", "far"}


def test_exact_names_meet_the_best_of_all_candidates(spark):
    """Against every pair of a reference and a symbol."""
    import random

    rnd = random.Random(5)
    path = lambda: "/".join([*(rnd.choice("ab") for _ in range(rnd.randint(0, 4))), rnd.choice("xyz") + ".py"])
    syms = [(f"s{k:02}", rnd.choice("mn"), rnd.choice(["Function", "Class"]), "q", path(), rnd.choice(["python", "go"]), k) for k in range(40)]
    refs = [(f"r{k}", rnd.choice("mn"), path(), rnd.choice(["Calls", "Instantiates", "Imports"]), rnd.choice(["python", "go", "c"]), k) for k in range(40)]

    def shared(a, b):
        n = 0
        for x, y in zip(a.split("/")[:-1], b.split("/")[:-1]):
            if x != y:
                break
            n += 1
        return min(15 * n, 80)

    def score(r, s):
        fit = 25 if (r[3] == "Calls" and s[2] == "Function") or (r[3] == "Instantiates" and s[2] == "Class") else 0
        near = shared(r[2], s[4]) + (50 if r[4] == s[5] else -80) + fit
        return near + (100 + (max(20 - abs(s[6] - r[5]) / 10, 0) if s[6] else 0) if r[2] == s[4] else 0)

    want = {}
    for r in refs:
        best = min(((-score(r, s), s[0], s) for s in syms if s[1] == r[1]), default=None)
        if best and -best[0] > -1:
            want[r[0]] = -best[0]
    s = spark.createDataFrame(syms, "id string, name string, kind string, qualified_name string, path string, language string, line int")
    r = spark.createDataFrame(refs, "ref_id string, name string, path string, kind string, language string, line int")
    found = {x.ref_id: x.id for x in resolve.by_exact(*resolve._shaped(r, s)).collect()}
    by_id, by_ref = {x[0]: x for x in syms}, {x[0]: x for x in refs}
    assert set(found) == set(want)
    assert {k: score(by_ref[k], by_id[v]) for k, v in found.items()} == want


def test_edges_and_reopened_references(spark):
    nodes = spark.createDataFrame([("c", "Class", "C", "a"), ("i", "Interface", "I", "b"), ("j", "Interface", "J", "b"), ("f", "Function", "f", "a")], "id string, kind string, name string, file_path string")
    found = spark.createDataFrame([("1", "i", 0.9, "exact-match"), ("2", "c", 0.5, "fuzzy"), ("3", "i", 0.9, "exact-match")], "ref_id string, id string, confidence double, how string")
    refs = spark.createDataFrame([("1", "c", "Extends", 1), ("2", "f", "Calls", 2), ("3", "j", "Extends", 3)], "ref_id string, from_id string, kind string, line int")
    e = resolve.edges_of(found, refs, nodes)
    assert rows(e, "src", "dst", "kind") == [("c", "i", "Implements"), ("f", "c", "Instantiates"), ("j", "i", "Extends")]
    gone = spark.createDataFrame([("b",)], "file_path string")
    assert rows(resolve.reopened(e, nodes, gone)) == [("c", "I", "Implements")]
