"""An append-only log of changes: undo by compensating events, the state at any event, graphs replayed, causes traced.

events: event_id (ascending), kind, key, value, undoes (the event that an undo
takes back), parent (the event that caused this one); kinds are `set` and
`remove` of a key, and `undo`. Nothing is ever deleted from the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.cut import cut, drop
from codeloom.plans.snapshot import dense

SCHEMA = "event_id long, kind string, key string, value string, undoes long, parent long"
KINDS = ("set", "remove", "undo")


class EventLog:
    """A log kept as Parquet files in a folder; each append adds files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def last(self) -> int:
        return self.events().agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]

    def append(self, changes: DataFrame, order: str = "order") -> DataFrame:
        """changes(order, kind, key, value[, undoes, parent]) get the next ids by order, which holds no value twice; the events come back."""
        unknown = changes.where(~F.col("kind").isin(*KINDS)).limit(1).collect()
        if unknown:
            raise ValueError(f"unknown kind of event {unknown[0].kind!r}")
        empty = lambda c: F.col(c) if c in changes.columns else F.lit(None)
        numbered = changes.join(dense(changes, order), order)
        new = cut(numbered.select((F.col("num") + self.last() + 1).alias("event_id"), "kind", "key", "value", empty("undoes").cast("long").alias("undoes"), empty("parent").cast("long").alias("parent")))
        new.write.mode("append").parquet(self.path)
        return new

    def undo(self, count: int = 1) -> DataFrame:
        """Take back the last `count` changes in effect, latest first, by events of their own."""
        live = effective(self.events()).where("kind <> 'undo'").orderBy(F.desc("event_id")).limit(count)
        rows = live.select(F.lit("undo").alias("kind"), "key", F.lit(None).cast("string").alias("value"), F.col("event_id").alias("undoes"), (-F.col("event_id")).alias("order"))
        return self.append(rows)

    def due(self, every: int = 100) -> bool:
        """Whether the log is long enough that a state should be kept beside it."""
        return self.events().count() >= every


def effective(events: DataFrame, upto: int | None = None) -> DataFrame:
    """The events up to one, itself included, that no undo in effect takes back; an undo that is undone has no effect.

    An undo stands for nothing but later ones of itself, so what is settled
    grows from the undos that nothing undoes: a round for each link of the
    longest chain, over the undone events alone. An undo of a later event, or
    of itself, or of none, has no effect on others.
    """
    e = cut(events if upto is None else events.where(F.col("event_id") <= upto))
    links = cut(e.where("kind = 'undo' and undoes < event_id").select(F.col("event_id").alias("by"), F.col("undoes").alias("id")))
    hit = links.select("id").distinct()
    # settled: (by, alive) of undos whose own fate is known
    settled = cut(links.select("by").distinct().join(hit.withColumnRenamed("id", "by"), "by", "left_anti").withColumn("alive", F.lit(True)))
    dead, open_ = None, links
    while open_.limit(1).count():
        known = open_.join(settled, "by", "left").groupBy("id").agg(F.bool_or(F.coalesce("alive", F.lit(False))).alias("hit"), F.bool_and(F.col("alive").isNotNull()).alias("whole"))
        # one undo in effect is enough; else all that undo it must be settled
        fate = cut(known.where("hit or whole").select("id", "hit"))
        if not fate.limit(1).count():
            break
        gone = fate.where("hit").select(F.col("id").alias("event_id"))
        dead = gone if dead is None else dead.unionByName(gone)
        new = cut(settled.unionByName(fate.select(F.col("id").alias("by"), (~F.col("hit")).alias("alive"))))
        rest = cut(open_.join(fate, "id", "left_anti"))
        drop(settled)
        settled, open_ = new, rest
    return e if dead is None else e.join(dead.distinct(), "event_id", "left_anti").select(events.columns)


def state(events: DataFrame, upto: int | None = None) -> DataFrame:
    """(key, value, event_id) after an event: the last set of each key that was not removed later, among events in effect."""
    live = effective(events, upto).where("kind in ('set', 'remove')")
    last = live.groupBy("key").agg(F.max(F.struct("event_id", "kind", "value")).alias("l"))
    return last.where("l.kind = 'set'").select("key", "l.value", "l.event_id")


def replay_graph(events: DataFrame, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, value), edges(src, dst, kind, value)) after an event.

    Keys are node:<id> and edge:<json array of src, dst, kind>. Removing a
    node removes its edges; a node that comes back does not bring them back,
    and an edge counts only while both its ends are there.
    """
    live = effective(events, upto).where("kind in ('set', 'remove')")
    own = cut(live.groupBy("key").agg(F.max(F.struct("event_id", "kind", "value")).alias("l")))
    nodes = own.where("key like 'node:%' and l.kind = 'set'").select(F.expr("substring(key, 6)").alias("id"), "l.value")
    removed = live.where("kind = 'remove' and key like 'node:%'").groupBy(F.expr("substring(key, 6)").alias("id")).agg(F.max("event_id").alias("gone"))
    ends = F.from_json(F.expr("substring(key, 6)"), "array<string>")
    edges = own.where("key like 'edge:%' and l.kind = 'set'").select(ends.alias("e"), "l.value", "l.event_id").select(*[F.col("e")[i].alias(n) for i, n in enumerate(("src", "dst", "kind"))], "value", "event_id")
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi").join(removed.select(F.col("id").alias(end), "gone"), end, "left").where("gone is null or gone < event_id").drop("gone")
    return nodes, edges.select("src", "dst", "kind", "value")


def causes(events: DataFrame) -> DataFrame:
    """(event_id, root, steps): the first cause of each event and how many links lead to it; links are doubled each round. A parent that is not in the log ends the chain, a ring of causes has none."""
    ids = events.select(F.col("event_id").alias("parent"))
    up = events.select("event_id", "parent").join(ids.distinct(), "parent", "left_semi").select("event_id", F.col("parent").alias("at"))
    now = cut(events.select("event_id").join(up, "event_id", "left").select("event_id", F.coalesce("at", "event_id").alias("at"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    heads = cut(now.where("at = event_id and steps = 0").select(F.col("event_id").alias("at")))
    n, rounds = now.count(), 0
    while 1 << rounds < max(n, 1):
        far = now.select(F.col("event_id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"))
        new = cut(now.join(far, "at").select("event_id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")))
        more = new.where("moved").limit(1).count()
        drop(now)
        now, rounds = new.drop("moved"), rounds + 1
        if not more:
            break
    return now.join(heads, "at", "left_semi").select("event_id", F.col("at").alias("root"), "steps")


def trace(events: DataFrame, event_id: int) -> DataFrame:
    """(step, event_id, kind, key): an event, what caused it, and so on; a ring ends where it closes."""
    links = cut(events.select("event_id", "parent", "kind", "key"))
    now = cut(links.where(F.col("event_id") == event_id).withColumn("step", F.lit(0)))
    out = now
    while now.limit(1).count():
        step = links.join(now.select(F.col("parent").alias("event_id"), (F.col("step") + 1).alias("step")), "event_id")
        now = cut(step.join(out.select("event_id"), "event_id", "left_anti").select("event_id", "parent", "kind", "key", "step"))
        out = out.unionByName(now)
    return out.select("step", "event_id", "kind", "key")
