"""Routes, event logs, aliases, call chains, running sums, budgets and ranges of values against plain Python."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.operators import aliases, budget, chains, eventlog, mining, routes
from codeloom.plans.dsl import Engine
from codeloom.plans.graph import PropertyGraph
from codeloom.plans.prefix import running
from codeloom.plans.snapshot import dense
from codeloom.sources.ranges import RangeIndex

# --- routes ---


def fits(route, target):
    cut = lambda p: p.split("?")[0].split("#")[0].strip("/").split("/")
    p, c = cut(route), cut(target)
    hole = lambda x: x.startswith(":") or x[:1] + x[-1:] in ("{}", "<>")
    return len(p) == len(c) and all(b != "" if hole(a) else a == b for a, b in zip(p, c, strict=True))


@pytest.mark.parametrize("route,target,same", [("/users/:id", "/users/42", True), ("/users/{id}", "/users/abc", True), ("/users/<id>", "/users/xyz", True), ("/a/:x/b/:y", "/a/1/b/2", True), ("/api/items", "/api/items?page=2", True), ("users/:id", "/users/9", True), ("/users/:id", "/users", False), ("/users/:id", "/users/42/extra", False), ("/users/:id", "/orders/42", False), ("/users/:id", "/users/", False)])
def test_single_routes(route, target, same):
    assert fits(route, target) is same


def test_routes_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["api", "users", "items", "v1", ""])
    table = [(i, rng.choice(["get", "POST", None]), "/" + "/".join(rng.choice([word(), ":id", "{k}", "<n>"]) for _ in range(rng.randint(1, 4)))) for i in range(120)] + [(500, "GET", "/users/:id"), (501, None, None), (502, "GET", "/")]
    calls = [(i, rng.choice(["Get", "post", None]), "/" + "/".join(word() for _ in range(rng.randint(1, 4))) + rng.choice(["", "?q=1/2", "#x", "/"])) for i in range(150)] + [(900, "GET", None)]
    r, c = spark.createDataFrame(table, "route_id long, method string, path string"), spark.createDataFrame(calls, "call_id long, method string, target string")
    up = lambda m: (m or "GET").upper()
    want = sorted((i, j) for i, m, t in calls for j, n, p in table if t is not None and p is not None and up(m) == up(n) and fits(p, t))
    got = routes.matches(r, c, best=False).collect()
    assert sorted((x.call_id, x.route_id) for x in got) == want and len(want) > 100
    most = defaultdict(int)
    for x in got:
        most[x.call_id] = max(most[x.call_id], x.literals)
    best = routes.matches(r, c).collect()
    assert {x.call_id for x in best} == set(most) and all(x.literals == most[x.call_id] for x in best)
    own = routes.client_edges(spark.createDataFrame([(1, "GET", "/a/:x")], r.schema), spark.createDataFrame([(1, "GET", "/a/b"), (2, "GET", "/a/b")], c.schema))
    assert [tuple(x) for x in own.collect()] == [(2, 1, "ExternalCall", "GET /a/:x")]


# --- event log ---


def interpret(events, upto):
    """Undo chains first, newest to oldest, then a fold of what is left."""
    live = [e for e in events if e[0] <= upto]
    dead = set()
    for e in sorted(live, reverse=True):
        if e[1] == "undo" and e[0] not in dead and e[4] is not None and e[4] < e[0]:
            dead.add(e[4])
    nodes, edges, plain = {}, {}, {}
    for e in sorted(live):
        if e[0] in dead or e[1] == "undo":
            continue
        plain.pop(e[2], None)
        if e[1] == "set":
            plain[e[2]] = e[3]
        kind, name = e[2].split(":", 1)
        if kind == "node":
            if e[1] == "set":
                nodes[name] = e[3]
            else:
                nodes.pop(name, None)
                edges = {k: v for k, v in edges.items() if name not in k[:2]}
        elif e[1] == "set":
            edges[tuple(json.loads(name))] = e[3]
        else:
            edges.pop(tuple(json.loads(name)), None)
    return plain, nodes, {k: v for k, v in edges.items() if k[0] in nodes and k[1] in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_an_interpreter(spark, seed):
    rng = random.Random(seed)
    events = []
    for i in range(1, 90):
        if events and rng.random() < 0.35:
            undone = rng.choice(events[-6:])[0]
            events.append((i, "undo", "", None, rng.choice([undone, undone, None, i, i + 1]), rng.choice([None, i - 1])))
        elif rng.random() < 0.5:
            events.append((i, rng.choice(["set", "set", "remove"]), f"node:n{rng.randrange(5)}", f"v{i}", None, rng.choice([None, i - 1])))
        else:
            events.append((i, rng.choice(["set", "set", "remove"]), "edge:" + json.dumps([f"n{rng.randrange(5)}", f"n{rng.randrange(5)}", "Calls"]), f"v{i}", None, None))
    table = spark.createDataFrame(events, eventlog.SCHEMA)
    for upto in (0, 20, 55, 89):
        plain, nodes, edges = interpret(events, upto)
        assert {r.key: r.value for r in eventlog.state(table, upto).collect()} == plain
        n, e = eventlog.replay_graph(table, upto)
        assert {r.id: r.value for r in n.collect()} == nodes
        # an edge event before its ends are there counts once they are, unless a node was removed after it
        assert {(r.src, r.dst, r.kind): r.value for r in e.collect()} == edges
    parent = {e[0]: e[5] for e in events}
    for r in eventlog.causes(table).collect():
        at, steps = r.event_id, 0
        while parent.get(at) in parent:
            at, steps = parent[at], steps + 1
        assert (r.root, r.steps) == (at, steps)
    last = max(parent)
    chain = [last]
    while parent.get(chain[-1]) in parent:
        chain.append(parent[chain[-1]])
    assert [r.event_id for r in eventlog.trace(table, last).orderBy("step").collect()] == chain


def test_appending_and_undoing(spark, tmp_path):
    log = eventlog.EventLog(spark, str(tmp_path / "log"))
    assert eventlog.state(log.events()).count() == 0 and log.last() == 0
    new = lambda rows: log.append(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "order long, kind string, key string, value string"))
    assert [r.event_id for r in new([("set", "a", "1"), ("set", "b", "2"), ("remove", "a", None)]).orderBy("event_id").collect()] == [1, 2, 3]
    now = lambda: {r.key: r.value for r in eventlog.state(log.events()).collect()}
    assert now() == {"b": "2"}
    log.undo()
    assert now() == {"a": "1", "b": "2"} and log.last() == 4
    log.undo(2)
    assert now() == {} and log.last() == 6 and not log.due() and log.due(6)
    log.append(spark.createDataFrame([(0, "undo", "", None, 5)], "order long, kind string, key string, value string, undoes long"))  # redo
    assert now() == {"b": "2"} and eventlog.state(log.events(), 2).count() == 2
    with pytest.raises(ValueError, match="kind"):
        new([("other", "a", "1")])


# --- aliases ---


def brute_alias(name, rules):
    best = None
    for pattern, targets in rules.items():
        head, star, tail = pattern.partition("*")
        if star and name.startswith(head) and name.endswith(tail) and len(name) >= len(head) + len(tail):
            key, inner = (False, len(head), len(tail)), name[len(head) : len(name) - len(tail)]
        elif not star and name == pattern:
            key, inner = (True, len(head), 0), ""
        else:
            continue
        if best is None or key > best[0]:
            best = key, [t.replace("*", inner) for t in targets]
    return best[1] if best else []


def test_aliases_equal_brute_force(spark):
    rules = {"": {"@/*": ["src/*", "lib/*"], "@/ui/*": ["src/ui/*"], "@/ui/*.svg": ["img/*"], "*": ["any/*"], "@/ui": ["src/ui/index"], "~": ["home"], "a/b*c": ["x/*"]}, "web": {"@/*": ["app/*"], "#*": ["h/*", "k/*"]}, "web/deep": {"@/x*": ["y/*"]}}
    rng = random.Random(9)
    names = ["@/ui", "@/ui/", "@/ui/Box", "@/ui/a/b.svg", "@/x", "~", "~x", "a/bc", "a/bzc", "a/b", "", "@", "#", "#é/ü", "plain", "@/ui/.svg"]
    refs = [(i, rng.choice(["main.ts", "web/a.ts", "web/deep/er/b.ts", "webby/c.ts"]), rng.choice(names)) for i in range(150)]
    table = spark.createDataFrame([(root, p, t, i) for root, m in rules.items() for p, ts in m.items() for i, t in enumerate(ts)], "root string, pattern string, target string, place int")
    got = defaultdict(list)
    for r in aliases.rewrite(spark.createDataFrame(refs, "ref_id long, path string, name string"), table).orderBy("ref_id", "place").collect():
        got[r.ref_id].append(r.target)
    for i, path, name in refs:
        root = "web/deep" if path.startswith("web/deep/") else "web" if path.startswith("web/") else ""
        want = [t if not root else f"{root}/{t}" for t in brute_alias(name, rules[root])]
        assert [t.rstrip("/") for t in got[i]] == [t.rstrip("/") for t in want], (path, name)


def test_alias_targets_are_tried_in_order(spark):
    files = spark.createDataFrame([(1, "lib/a.ts"), (2, "src/b/index.ts"), (3, "src/c.tsx"), (4, "src/c.js"), (5, "packages/core/src/util.ts"), (6, "packages/core/index.ts")], "id long, path string")
    table = spark.createDataFrame([("", "@/*", "src/*", 0), ("", "@/*", "lib/*", 1)], "root string, pattern string, target string, place int")
    table = table.unionByName(aliases.workspace_aliases(spark.createDataFrame([("@org/core", "packages/core")], "name string, folder string")))
    refs = spark.createDataFrame([(i, "x.ts", n) for i, n in enumerate(["@/a", "@/b", "@/c", "@/none", "@org/core", "@org/core/src/util"])], "ref_id long, path string, name string")
    assert {r.ref_id: r.id for r in aliases.by_alias(refs, files, table).collect()} == {0: 1, 1: 2, 2: 3, 4: 6, 5: 5}


# --- chains ---


def test_chains_equal_a_walk(spark):
    rng = random.Random(2)
    types, names = [f"T{i}" for i in range(8)], list("abcd")
    members = [(t, m, rng.choice([*types, None]), f"{t}.{m}") for t in types for m in names if rng.random() < 0.4]
    supers = [(f"T{i}", f"T{j}", k) for i in range(8) for k, j in enumerate(rng.sample(range(8), 2)) if rng.random() < 0.7]  # rings too
    asked = [(i, rng.choice([*types, "none", None]), [rng.choice(names) for _ in range(rng.randint(0, 5))]) for i in range(200)] + [(500, "T1", None)]
    own, up = {(t, m): (i, r) for t, m, r, i in members}, defaultdict(list)
    for t, s, p in sorted(supers, key=lambda x: x[2]):
        up[t].append((p, s))

    def find(t, m):
        level, seen = [((), t)], {t}
        while level:
            hit = [(way, x) for way, x in level if (x, m) in own]
            if hit:
                return own[min(hit)[1], m]
            nxt = {}
            for way, x in level:
                for p, s in up[x]:
                    nxt[s] = min(nxt.get(s, (*way, p)), (*way, p))
            level = [(w, x) for x, w in nxt.items() if x not in seen]
            seen |= set(nxt)
        return None

    def walk(t, links):
        found, last = 0, None
        for m in links or []:
            hit = find(t, m) if t is not None else None
            if hit is None:
                return None, found, t
            (last, t), found = hit, found + 1
        return (last if links else None), found, t

    got = chains.resolve_chains(spark.createDataFrame(asked, "ref_id long, receiver string, links array<string>"), spark.createDataFrame(members, "type string, member string, returns string, id string"), spark.createDataFrame(supers, "type string, super string, place int"))
    assert {r.ref_id: (r.id, r.found, r.type) for r in got.collect()} == {i: walk(t, links) for i, t, links in asked}


def test_chains_are_read_from_text(spark):
    receiver, links = chains.links_of(F.col("t"))
    rows = spark.createDataFrame([("a.b(1, f(2)).c().d()",), ("x",), ("Foo::make()->go()",), ("a?.b().c",)], "t string")
    assert [(r[0], r[1]) for r in rows.select(receiver, links).collect()] == [("a", ["b", "c", "d"]), ("x", []), ("Foo", ["make", "go"]), ("a", ["b", "c"])]


# --- running sums, ranges merged, budgets ---


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), i, rng.randint(-3, 9)) for i in range(500)]
    table = spark.createDataFrame(rows, "g string, at long, v int").repartition(7)
    sums, want = defaultdict(int), {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        sums[g] += v
        want[i] = sums[g]
    assert {r.at: r.s for r in running(table, {"s": F.col("v")}, [F.col("at")], ["g"]).collect()} == want
    assert running(table.limit(0), {"s": F.col("v")}, [F.col("at")]).count() == 0
    assert [r.num for r in dense(table.select("at"), "at").orderBy("at").collect()] == list(range(500))


def test_merged_ranges_equal_a_sweep(spark):
    rng = random.Random(8)
    rows = [(f"f{rng.randrange(3)}", s := rng.randrange(200), s + rng.randrange(6)) for _ in range(90)] * 2
    want = []
    for f in sorted({r[0] for r in rows}):
        now = None
        for _, s, e in sorted(r for r in rows if r[0] == f):
            if now and s <= now[2] + 2:
                now = [f, now[1], max(now[2], e), now[3] + 1]
            else:
                want += [tuple(now)] if now else []
                now = [f, s, e, 1]
        want.append(tuple(now))
    assert sorted(tuple(r) for r in mining.merge_ranges(spark.createDataFrame(rows, "file string, start long, end long"), 2).select("file", "start", "end", "n").collect()) == sorted(want)


def test_a_budget_is_filled(spark):
    rng = random.Random(3)
    rows = [(f"f{rng.randrange(12)}", i, rng.randrange(3), rng.random(), "\n".join("w" * rng.randrange(1, 60) for _ in range(rng.randrange(1, 30)))) for i in range(200)] + [("f1", 900, None, None, None), ("f1", 901, 0, 1.0, "")]
    table = spark.createDataFrame(rows, "file string, block long, tier int, score double, text string")
    text = {r[1]: r[4] or "" for r in rows}
    for size in (300, 5_000, 1 << 40):
        got = budget.select_blocks(table, size, 5).collect()
        used = sum(r.tokens for r in got) + 5 * len({r.file for r in got})
        assert used <= size and (size > 1 << 30 or used >= 0.9 * size)
        cut = [r for r in got if not r.whole]
        assert len(cut) <= 1 and all(text[r.block].startswith(r.text) and (r.text == text[r.block]) == r.whole for r in got)
        if size > 1 << 30:
            assert len(got) == len(rows)
        files = {}
        for f, _, tier, score, _ in rows:
            a, b = files.get(f, (1 << 30, 0.0))
            files[f] = min(a, 1 << 30 if tier is None else tier), max(b, score or 0.0)
        order = sorted(files, key=lambda f: (files[f][0], -files[f][1], f))
        chosen = {r.file for r in got}
        assert chosen == set(order[: len(chosen)])


# --- ranges of values ---


def test_a_range_reads_few_files(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"n{i}", float(rng.randrange(1000)), {"lines": str(rng.randrange(50)), "note": "x", "share": "nan", "name": "5" if i % 2 else "b"}, i) for i in range(2000)]
    nodes = spark.createDataFrame(rows, "id string, score double, metadata map<string,string>, size int")
    index = RangeIndex.build(nodes, path=str(tmp_path / "ix"), files=12)
    assert {r.field for r in index.files().select("field").distinct().collect()} == {"score", "lines", "name", "size"}
    for field, lo, hi in (("score", 100, 130), ("score", None, 5), ("lines", 49, None), ("size", 77, 77), ("score", 10, 3), ("none", 0, 1)):
        value = lambda r: {"score": r[1], "lines": float(r[2]["lines"]), "size": float(r[3])}.get(field)  # noqa: B023, E731
        want = sorted(r[0] for r in rows if value(r) is not None and (lo is None or value(r) >= lo) and (hi is None or value(r) <= hi))
        got = index.between(field, lo, hi)
        assert sorted(r.id for r in got.collect()) == want
    every = len(spark.read.parquet(str(tmp_path / "ix" / "values")).inputFiles())
    assert len(index.between("score", 100, 130).inputFiles()) * 3 < every
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,100.0)" in index.between("score", 100, 130)._jdf.queryExecution().executedPlan().toString()
    assert RangeIndex.build(nodes.limit(0), path=str(tmp_path / "none")).between("score", 0, 9).count() == 0
    g = PropertyGraph(nodes.withColumn("kind", F.lit("Function")).withColumn("name", F.col("id")), spark.createDataFrame([], "src string, dst string, kind string, weight double"))
    for graph in (g, PropertyGraph(g.nodes, g.edges, ranges=index)):
        assert Engine(graph).query('fn("n1") | between score 100 130.5').count() == sum("n1" in r[0] and 100 <= r[1] <= 130.5 for r in rows)
        assert Engine(graph).query("count between lines 3 4").first()[0] == sum(3 <= float(r[2]["lines"]) <= 4 for r in rows)
