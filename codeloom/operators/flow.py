"""Flow between values and functions: points-to sets, slices, taint with sanitizers, seeds and roles from names.

Constraints of a program are rows of constraints(fn, op, dst, base, field, src, site); op is

    new    dst points to the place `site` (a call's or a literal's; a parameter's own place)
    copy   dst = src
    read   dst = base.field
    write  base.field = src
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import traverse
from codeloom.operators.traverse import _Known
from codeloom.plans.cut import cut, drop
from codeloom.sources.languages import _NOT_CALLED

#: Fields that a place may be nested in, which bounds stores that feed themselves.
FIELD_DEPTH = 8


def _variable(name: str) -> Column:
    return F.concat_ws("/", "fn", name)


def _whole(df: DataFrame) -> DataFrame:
    return cut(df.distinct())


def points_to(constraints: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """(fn, var, place) of all that the constraints make a variable point to, in any order of statements.

    passed(src_fn, src, dst_fn, dst) are copies between functions: arguments
    to parameters, results to where a call's result goes; their rounds are not
    bounded. A read of a field that nothing is written to gives the field's
    own place `site.field`, up to FIELD_DEPTH fields deep. Places are named
    fn/site. Each round joins only what is new with the copies, and what is
    known with new copies; null or missing names take no part.
    """
    c = cut(constraints.withColumn("fn", F.coalesce("fn", F.lit(""))))
    copies = c.where("op = 'copy'").select(_variable("src").alias("src"), _variable("dst").alias("dst"))
    if passed is not None:
        copies = copies.unionByName(passed.select(F.concat_ws("/", "src_fn", "src").alias("src"), F.concat_ws("/", "dst_fn", "dst").alias("dst")))
    links = _whole(copies.where("src is not null and dst is not null"))
    reads = cut(c.where("op = 'read'").select(_variable("base").alias("base"), "field", _variable("dst").alias("v")).distinct())
    writes = cut(c.where("op = 'write'").select(_variable("base").alias("base"), "field", _variable("src").alias("v")).distinct())
    known = _whole(c.where("op = 'new'").select(_variable("dst").alias("v"), _variable("site").alias("place"), F.lit(0).alias("depth")))
    fresh, fresh_links = known, links
    cell = lambda df: F.concat(df.place, F.lit("."), F.col("field"))
    while True:
        moved = fresh.join(links, fresh.v == links.src).select(F.col("dst").alias("v"), "place", "depth")
        late = known.join(fresh_links, known.v == fresh_links.src).select(F.col("dst").alias("v"), "place", "depth")
        near = fresh.where(F.col("depth") < FIELD_DEPTH).withColumnRenamed("v", "base")
        into = near.join(writes, "base").select(F.col("v").alias("src"), F.concat(F.lit("*"), cell(near)).alias("dst"))
        out = near.join(reads, "base").select(F.concat(F.lit("*"), cell(near)).alias("src"), F.col("v").alias("dst"))
        facts = cut(moved.unionByName(late).distinct().join(known, ["v", "place"], "left_anti"))
        more = cut(into.unionByName(out).distinct().join(links, ["src", "dst"], "left_anti"))
        if not facts.limit(1).count() and not more.limit(1).count():
            # reads of fields that are empty now give the fields' own places, those first that nothing is written to
            at = known.where(F.col("depth") < FIELD_DEPTH).withColumnRenamed("v", "base")
            own = at.join(reads, "base").select("v", cell(at).alias("place"), (F.col("depth") + 1).alias("depth"), F.concat(F.lit("*"), cell(at)).alias("held")).distinct()
            own = own.join(known.select(F.col("v").alias("held")).distinct(), "held", "left_anti").join(known, ["v", "place"], "left_anti")
            own = cut(own.join(links.select(F.col("dst").alias("held"), F.lit(True).alias("filled")).distinct(), "held", "left"))
            facts = cut(own.where("filled is null").select("v", "place", "depth").distinct())
            if not facts.limit(1).count():
                facts = cut(own.select("v", "place", "depth").distinct())
            if not facts.limit(1).count():
                break
        old = known, links
        known, fresh = cut(known.unionByName(facts)), facts
        links, fresh_links = (cut(links.unionByName(more)), more) if more.limit(1).count() else (links, more)
        drop(old[0], *([old[1]] if old[1] is not links else []))
    plain = known.where(~F.col("v").startswith("*"))
    at = F.instr("v", "/")  # function ids hold none
    return plain.select(F.substr("v", F.lit(1), at - 1).alias("fn"), F.substr("v", at + 1).alias("var"), "place").distinct()


def passed_values(calls: DataFrame, parameters: DataFrame, returns: DataFrame) -> DataFrame:
    """Copies between functions for points_to(): calls(fn, callee, position, argument, result), parameters(fn, position, name), returns(fn, value)."""
    p = parameters.select(F.col("fn").alias("callee"), "position", "name")
    there = calls.where("argument is not null").join(p, ["callee", "position"]).select(F.col("fn").alias("src_fn"), F.col("argument").alias("src"), F.col("callee").alias("dst_fn"), F.col("name").alias("dst"))
    back = calls.where("result is not null").select("fn", "callee", "result").distinct().join(returns.select(F.col("fn").alias("callee"), "value"), "callee")
    return there.unionByName(back.select(F.col("callee").alias("src_fn"), F.col("value").alias("src"), F.col("fn").alias("dst_fn"), F.col("result").alias("dst"))).distinct()


def may_alias(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(fn, a, b) with alias: whether both may point to one place; false for a variable that points nowhere."""
    x = found.select("fn", F.col("var").alias("a"), "place")
    y = found.select("fn", F.col("var").alias("b"), "place")
    both = pairs.select("fn", "a", "b").distinct().join(x, ["fn", "a"]).join(y, ["fn", "b", "place"]).select("fn", "a", "b").distinct().withColumn("alias", F.lit(True))
    return pairs.join(both, ["fn", "a", "b"], "left").withColumn("alias", F.coalesce("alias", F.lit(False)))


def dependencies(constraints: DataFrame) -> DataFrame:
    """(src, dst): dst's value is made of src's, variables as fn/name; the base of a field counts for the field."""
    at = lambda frm, to, op: constraints.where(F.col("op") == op).select(_variable(frm).alias("src"), _variable(to).alias("dst"))
    rows = [at("src", "dst", "copy"), at("base", "dst", "read"), at("src", "base", "write"), at("site", "dst", "new")]
    return reduce(DataFrame.unionByName, rows).where("src <> dst").distinct()


def slices(depends: DataFrame, seeds: DataFrame, most: int | None = None, back: bool = True) -> DataFrame:
    """(id, depth): what the seeds are made of, or with back=False what is made of them; depends(src, dst) may be any oracle, calls among them."""
    return traverse.bfs(traverse.reversed_edges(depends) if back else depends, seeds, most)


def taint_flows(depends: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """(source, sink, sanitizer, path): a shortest path from each source to each sink, once with and once without a sanitizer on it.

    States are (source, node, whether a sanitizer was passed), so a path that
    is clean does not hide one that is not. sanitizer is the first on the
    path, null where there is none; of paths of one length the least counts.
    A source is not its own sink.
    """
    links = cut(depends.select("src", "dst").distinct())
    guard = cut(sanitizers.select(F.col("id").alias("dst")).distinct().withColumn("guards", F.lit(True)))
    seed = sources.select(F.col("id").alias("source")).distinct().join(guard.withColumnRenamed("dst", "source"), "source", "left")
    passed = F.coalesce("guards", F.lit(False))
    frontier = cut(seed.select("source", F.col("source").alias("node"), passed.alias("clean"), F.when(passed, F.col("source")).alias("sanitizer"), F.array("source").alias("path")))
    known = _Known(cut(frontier.select("source", "node", "clean")))
    ends, flows = cut(sinks.select(F.col("id").alias("node")).distinct()), []
    while True:
        step = frontier.join(links, frontier.node == links.src).join(guard, "dst", "left")
        now = F.col("clean") | passed
        new = step.select("source", F.col("dst").alias("node"), now.alias("clean"), F.coalesce("sanitizer", F.when(passed, F.col("dst"))).alias("sanitizer"), F.concat("path", F.array("dst")).alias("path"))
        least = new.groupBy("source", "node", "clean").agg(F.min(F.struct("path", "sanitizer")).alias("best"))
        last, frontier = frontier, cut(least.join(known.all(), ["source", "node", "clean"], "left_anti").select("source", "node", "clean", "best.sanitizer", "best.path"))
        drop(last)
        if not frontier.limit(1).count():
            break
        known.add(cut(frontier.select("source", "node", "clean")))
        flows.append(cut(frontier.join(ends, "node", "left_semi").where("node <> source").select("source", F.col("node").alias("sink"), "sanitizer", "path")))
    if not flows:
        return frontier.select("source", F.col("node").alias("sink"), "sanitizer", "path")
    return reduce(DataFrame.unionByName, flows)


def seeds_by_name(functions: DataFrame) -> DataFrame:
    """(id, role) of functions(id, name): source and sink by the words of the name, a sink only with a word that marks real danger; sanitizer by its words."""
    c = text.name_class(F.col("name"))
    roles = F.array_compact(F.array(F.when(c["source"] > c["sink"], "source"), F.when((c["sink"] > c["source"]) & text.holds_any(F.col("name"), text.STRONG_SINKS), "sink"), F.when(text.holds_any(F.col("name"), text.SANITIZERS), "sanitizer")))
    return functions.select("id", F.explode(roles).alias("role"))


def taint_scan(functions: DataFrame, depends: DataFrame, guards: DataFrame | None = None) -> DataFrame:
    """Flows without a sanitizer between sources and sinks found by name, most worth a look first; guards(id) are sanitizers too."""
    seeds = cut(seeds_by_name(functions))
    of = lambda role: seeds.where(F.col("role") == role).select("id")
    clean = of("sanitizer") if guards is None else of("sanitizer").unionByName(guards.select("id"))
    found = taint_flows(depends, of("source"), of("sink"), clean).where("sanitizer is null")
    name = lambda end: functions.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    return found.join(name("source"), "source").join(name("sink"), "sink").withColumn("priority", text.flow_priority(F.col("source_name"), F.col("sink_name"))).orderBy(F.desc("priority"), "source", "sink")


def taint_suggestions(functions: DataFrame, top: int, pool: int = 25) -> DataFrame:
    """(source, sink, priority): pairs of the `pool` most source-like and most sink-like functions, the `top` first."""
    c = functions.select("id", "name", text.name_class(F.col("name")).alias("c"))
    ranked = lambda own, other: c.where(f"c.{own} > c.{other}").orderBy(F.desc(f"c.{own}"), "name", "id").limit(pool)
    a = ranked("source", "sink").select(F.col("id").alias("source"), F.col("name").alias("x"))
    b = ranked("sink", "source").select(F.col("id").alias("sink"), F.col("name").alias("y"))
    pairs = a.join(F.broadcast(b), F.col("source") != F.col("sink"))  # at most pool rows a side
    return pairs.select("source", "sink", text.flow_priority(F.col("x"), F.col("y")).alias("priority")).orderBy(F.desc("priority"), "source", "sink").limit(top)


def verified_roles(proposals: DataFrame, calls: DataFrame, least_callers: int = 1) -> DataFrame:
    """proposals(id, role, confidence) with verified: what the calls(caller, callee, line) say of them.

    A sink needs `least_callers` other callers; a guard is called before a
    verified sink in one of the sink's other callers; a sanitizer is called
    by another; a source calls something.
    """
    calls = cut(calls.select("caller", "callee", "line"))
    others = calls.where("caller <> callee")
    callers = others.groupBy(F.col("callee").alias("id")).agg(F.countDistinct("caller").alias("callers"))
    callees = calls.select(F.col("caller").alias("id")).distinct().withColumn("calls_some", F.lit(True))
    sinks = proposals.where("role = 'sink'").select("id").distinct().join(callers.where(F.col("callers") >= least_callers), "id", "left_semi")
    at = others.join(sinks.withColumnRenamed("id", "callee"), "callee", "left_semi").groupBy("caller").agg(F.max("line").alias("sink_line"))
    first = calls.groupBy("caller", F.col("callee").alias("id")).agg(F.min("line").alias("line"))
    asked = proposals.where("role = 'guard'").select("id").distinct()
    before = first.join(asked, "id", "left_semi").join(at, "caller").where("line < sink_line").select("id").distinct().withColumn("guards", F.lit(True))
    known = proposals.join(callers, "id", "left").join(callees, "id", "left").join(before, "id", "left")
    n = F.coalesce("callers", F.lit(0))
    told = F.when(F.col("role") == "sink", n >= least_callers).when(F.col("role") == "guard", F.coalesce("guards", F.lit(False))).when(F.col("role") == "sanitizer", n >= 1).when(F.col("role") == "source", F.coalesce("calls_some", F.lit(False))).otherwise(False)
    return known.withColumn("verified", told).drop("callers", "calls_some", "guards")


def roles_of_fixes(commits: DataFrame) -> DataFrame:
    """(name, role, confidence, support): calls that fixes add are guards, calls that they remove are sinks; 1 - 0.6^support.

    commits(message, diff); a commit counts once for a name and role.
    """
    fixes = commits.where(text.is_fix(F.col("message"))).withColumn("__no", F.monotonically_increasing_id())
    lines = fixes.select("__no", F.explode(F.split("diff", "\n")).alias("line")).where(F.col("line").rlike(r"^[+-]") & ~F.col("line").rlike(r"^(\+\+\+|---)"))
    names = lines.select("__no", F.when(F.col("line").startswith("+"), "guard").otherwise("sink").alias("role"), F.explode(F.regexp_extract_all(F.expr("substring(line, 2)"), F.lit(r"([A-Za-z_]\w*)\("), 1)).alias("name"))
    names = names.where(~F.lower("name").isin(*sorted(_NOT_CALLED)))
    return names.distinct().groupBy("name", "role").agg(F.count("*").alias("support")).select("name", "role", (1 - F.pow(F.lit(0.6), F.col("support"))).alias("confidence"), "support")


#: Severity of a finding by what found it, highest first.
SEVERITIES = {"taint": "high", "missing_guard": "medium", "role": "low"}


def vulnerability_report(flows: DataFrame, deviants: DataFrame, roles: DataFrame) -> DataFrame:
    """(finder, severity, subject, about) of flows(source, sink), deviants(deviant, guard, sink) and the verified sinks of roles(id, role, verified)."""
    a = flows.select(F.lit("taint").alias("finder"), F.col("sink").alias("subject"), F.col("source").alias("about"))
    b = deviants.select(F.lit("missing_guard").alias("finder"), F.col("deviant").alias("subject"), F.concat_ws(" before ", "guard", "sink").alias("about"))
    c = roles.where("verified and role = 'sink'").select(F.lit("role").alias("finder"), F.col("id").alias("subject"), F.lit("verified sink").alias("about"))
    rank = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    return a.unionByName(b).unionByName(c).distinct().select("finder", rank[F.col("finder")].alias("severity"), "subject", "about")
