"""History, coverage, change and role mining; each operator is one plan of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.prefix import running


def co_change(changes: DataFrame, least: int = 2, most_per_commit: int = 200) -> DataFrame:
    """(a, b, together, total_a, total_b, confidence) of changes(commit, item), a < b.

    confidence is together / the larger total. Commits with more than
    `most_per_commit` items count in totals but give no pairs: that limit is
    the operator's own and bounds the pairs of a commit.
    """
    c = changes.select("commit", "item").distinct()
    totals = c.groupBy("item").agg(F.count("*").alias("total"))
    small = c.join(c.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n").between(2, most_per_commit)).select("commit"), "commit", "left_semi")
    x, y = small.select("commit", F.col("item").alias("a")), small.select("commit", F.col("item").alias("b"))
    pairs = x.join(y, "commit").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    ta, tb = totals.select(F.col("item").alias("a"), F.col("total").alias("total_a")), totals.select(F.col("item").alias("b"), F.col("total").alias("total_b"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "together", "total_a", "total_b", (F.col("together") / F.greatest("total_a", "total_b")).alias("confidence"))


def co_access(events: DataFrame, hottest: int = 300, least: int = 2) -> DataFrame:
    """(a, b, sessions) of events(session, path), among the hottest paths; a < b."""
    hot = events.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(hottest).select("path")
    e = events.select("session", "path").distinct().join(F.broadcast(hot), "path", "left_semi")  # `hottest` rows
    x, y = e.select("session", F.col("path").alias("a")), e.select("session", F.col("path").alias("b"))
    return x.join(y, "session").where("a < b").groupBy("a", "b").agg(F.count("*").alias("sessions")).where(F.col("sessions") >= least)


def interval_hits(spans: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """(id, hits, tested) of spans(id, file, start, end) and hits(file, at, n): the hits inside each span.

    Spans are copied to the buckets of `width` they touch, so that the join is
    an equality on (file, bucket) and the range only filters.
    """
    s = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    h = hits.withColumn("bucket", F.floor(F.col("at") / width))
    got = s.join(h, ["file", "bucket"]).where(F.col("at").between(F.col("start"), F.col("end"))).groupBy("id").agg(F.sum("n").alias("hits"))
    return spans.select("id").join(got, "id", "left").select("id", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) > 0).alias("tested"))


def enclosing(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """(point, id): the narrowest span(id, file, start, end) around each point(point, file, at); ties to the smaller id."""
    s = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    p = points.withColumn("bucket", F.floor(F.col("at") / width))
    size = F.struct((F.col("end") - F.col("start")).alias("size"), "id")
    return p.join(s, ["file", "bucket"]).where(F.col("at").between(F.col("start"), F.col("end"))).groupBy("point").agg(F.min(size).alias("m")).select("point", "m.id")


def merge_ranges(ranges: DataFrame, gap: int) -> DataFrame:
    """(file, start, end, n): ranges(file, start, end) of a file joined where they lie within `gap`; a range with a null bound, or that ends before it starts, joins none and is left out.

    Each range adds 1 where it starts and takes 1 away where its reach ends;
    islands begin where the running sum comes up from 0. The sums run over
    ranges of the sort order, so a file with most of the rows is no task.
    """
    r = ranges.where("start <= end").select("file", "start", "end")
    opens = r.select("file", F.col("start").alias("at"), F.lit(0).alias("closing"), F.lit(1).alias("step"), "start", "end")
    closes = r.select("file", (F.col("end") + gap).alias("at"), F.lit(1).alias("closing"), F.lit(-1).alias("step"), F.lit(None).cast(r.schema["start"].dataType).alias("start"), F.lit(None).cast(r.schema["end"].dataType).alias("end"))
    # where the sum is back at 0 an island has ended, so the zeros before a row number its island
    depth = running(opens.unionByName(closes), {"open": F.col("step")}, [F.col("at"), F.col("closing")], ["file"])
    marked = running(depth, {"ended": F.when(F.col("open") == 0, 1).otherwise(0)}, [F.col("at"), F.col("closing"), -F.col("open")], ["file"])
    inner = marked.where("closing = 0")
    return inner.groupBy("file", "ended").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("ended")


def budget_prefix(rows: DataFrame, group: str, size: str, cap: int, *order) -> DataFrame:
    """Rows of each group, in order, while their sizes sum to `cap` at most; groups of any size, sizes in whole numbers."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    return running(rows, {"__sum": F.col(size)}, keys, [group]).where(F.col("__sum") <= cap).drop("__sum")


def diff(base: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, reasons): added, removed or changed rows; reasons are the columns that differ."""
    a, b = base.alias("a"), current.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(F.size(differ) > 0, "changed")
    out = both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"), F.when(change == "changed", F.array_join(differ, ",")).otherwise("").alias("reasons"))
    return out.where("change is not null")


def overlay(base: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Base rows but for the changed keys, and the changed rows."""
    return base.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def keep_latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """One row a key, first by order: the upsert of a batch of versions."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def noisy_or(evidence: DataFrame) -> DataFrame:
    """(name, role, confidence): 1 - product of (1 - confidence) of evidence(name, role, confidence)."""
    sure = F.max((F.col("confidence") >= 1).cast("int")) == 1
    rest = F.sum(F.when(F.col("confidence") < 1, F.log1p(-F.col("confidence"))))
    return evidence.groupBy("name", "role").agg(F.when(sure, 1.0).otherwise(1 - F.exp(F.coalesce(rest, F.lit(0.0)))).alias("confidence"))


def missing_guards(calls: DataFrame, least_callers: int = 4, least_support: int = 3, least_share: float = 0.75) -> DataFrame:
    """(sink, guard, support, callers, deviant) of calls(caller, callee, line).

    A guard is called before the sink by most callers of the sink; deviants
    are the callers that do not. The first line of each (caller, callee)
    counts; share is at least `least_share` and below 1.
    """
    first = calls.groupBy("caller", "callee").agg(F.min("line").alias("line"))
    sinks = first.select("caller", F.col("callee").alias("sink"), F.col("line").alias("sink_line"))
    total = sinks.groupBy("sink").agg(F.count("*").alias("callers")).where(F.col("callers") >= least_callers)
    guards = first.select("caller", F.col("callee").alias("guard"), F.col("line").alias("guard_line"))
    held = sinks.join(total, "sink").join(guards, "caller").where((F.col("guard") != F.col("sink")) & (F.col("guard_line") < F.col("sink_line")))
    rules = held.groupBy("sink", "guard", "callers").agg(F.count("*").alias("support"))
    share = F.col("support") / F.col("callers")
    rules = rules.where((F.col("support") >= least_support) & (share >= least_share) & (share < 1))
    return rules.join(sinks.select("sink", "caller"), "sink").join(held.select("sink", "guard", "caller"), ["sink", "guard", "caller"], "left_anti").select("sink", "guard", "support", "callers", F.col("caller").alias("deviant"))
