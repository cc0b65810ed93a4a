"""Traversals over a snapshot: each round joins a frontier of node numbers with the buckets of edges where they lie.

What is exchanged in a round is the frontier and what it leads to; the edges
are read in place. Results carry ids again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.plans.cut import cut, drop
from codeloom.plans.snapshot import Snapshot, bitmaps, chunk_of, has, union_of

#: A round pulls once the edges that leave the frontier are more than those not yet met over PULL, and pushes again once the frontier is fewer than all nodes over PUSH.
PULL, PUSH = 14, 24
#: Bytes of bitmaps up to which they are broadcast; larger ones are joined by chunk.
BROADCAST_BYTES = 64 << 20
ROUNDS_A_TABLE = 8


def _maps(snapshot: Snapshot, maps: DataFrame) -> DataFrame:
    """Bitmaps of node numbers, broadcast where all of them, a bit a node, are small enough."""
    return F.broadcast(maps) if snapshot.manifest["nodes"] / 8 <= BROADCAST_BYTES else maps


def _with_bit(snapshot: Snapshot, rows: DataFrame, column: str, maps: DataFrame, name: str) -> DataFrame:
    """rows with a flag: whether the column's number is in the bitmaps."""
    side = _maps(snapshot, maps.select(F.col("chunk").alias(f"{name}_chunk"), F.col("bits").alias(f"{name}_bits")))
    got = rows.withColumn("_c", chunk_of(F.col(column))).join(side, F.col("_c") == F.col(f"{name}_chunk"), "left")
    return got.withColumn(name, has(F.col(f"{name}_bits"), F.col(column))).drop("_c", f"{name}_chunk", f"{name}_bits")


def _push(snapshot: Snapshot, frontier: DataFrame, seen: DataFrame, kinds: tuple, back: bool) -> DataFrame:
    """What the frontier's edges lead to and is not seen."""
    met = snapshot.meet(frontier.select("num"), back)
    met = (met.where(F.col("kind").isin(*kinds)) if kinds else met).select(F.col("far").alias("num")).distinct()
    return _with_bit(snapshot, met, "num", seen, "old").where("not old").select("num")


def _pull(snapshot: Snapshot, frontier: DataFrame, seen: DataFrame, kinds: tuple, back: bool) -> DataFrame:
    """What is not seen and has an edge from the frontier: edges are tried in the buckets of their far end, so one hit each is found in place."""
    table, near, far = (snapshot.out, "src", "dst") if back else (snapshot.into, "dst", "src")
    e = (table.where(F.col("kind").isin(*kinds)) if kinds else table).select(F.col(near).alias("num"), "salt", F.col(far).alias("from"))
    open_ = _with_bit(snapshot, e, "num", seen, "old").where("not old")
    hit = _with_bit(snapshot, open_, "from", bitmaps(frontier), "lit").where("lit")
    return hit.select("num", "salt").distinct().select("num").distinct()


def bfs(snapshot: Snapshot, seeds: DataFrame, most: int | None = None, kinds: tuple = (), back: bool = False, rounds: list | None = None, pull: float = PULL, push: float = PUSH) -> DataFrame:
    """(id, depth): least number of hops from any seed; seeds that the snapshot does not know are at 0 too.

    What is seen is a bitmap, a bit a node. A round pushes along the
    frontier's edges or, where these are many, pulls: nodes not seen look for
    an edge from the frontier, kept as a bitmap. `rounds` takes the kind of
    each round, its hop and the size of its frontier.
    """
    degrees = snapshot.nodes
    frontier = cut(snapshot.numbers(seeds))
    known = [frontier.withColumn("depth", F.lit(0))]
    old = [frontier]
    seen = cut(bitmaps(frontier))
    way, depth, left = "push", 0, snapshot.manifest["edges"]
    while most is None or depth < most:
        leaving, size = degrees.join(frontier, "num", "left_semi").agg(F.coalesce(F.sum("deg"), F.lit(0)), F.count("*")).first()
        if not size:
            break
        left -= leaving
        if way == "push" and leaving * pull > max(left, 1):
            way = "pull"
        elif way == "pull" and size * push < snapshot.manifest["nodes"]:
            way = "push"
        depth += 1
        if rounds is not None:
            rounds.append((way, depth, size))
        frontier = cut((_pull if way == "pull" else _push)(snapshot, frontier, seen, kinds, back))
        more = cut(union_of(seen, bitmaps(frontier)))
        drop(seen)
        seen = more
        known.append(frontier.withColumn("depth", F.lit(depth)))
        old.append(frontier)
        if len(known) > ROUNDS_A_TABLE:
            whole = cut(_all(known))
            drop(*old[:-1])
            known, old = [whole], [whole, frontier]
    found = snapshot.named(_all(known))
    strange = seeds.select("id").distinct().join(snapshot.nodes, "id", "left_anti").select("id", F.lit(0).alias("depth"))
    return cut(found.unionByName(strange))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def neighbours(snapshot: Snapshot, seeds: DataFrame, kinds: tuple = (), back: bool = False) -> DataFrame:
    """(id) one hop on, along edges of the kinds."""
    met = snapshot.meet(snapshot.numbers(seeds), back)
    met = met.where(F.col("kind").isin(*kinds)) if kinds else met
    return snapshot.named(met.select(F.col("far").alias("num")).distinct())


def reachable(snapshot: Snapshot, seeds: DataFrame, steps: list[tuple[int, str, int]], starts: list[int], last: int, incoming: bool = False) -> DataFrame:
    """(id) that a path leads to whose kinds take an automaton from one of its starts to its last state; steps: (state, kind or any, next)."""
    nfa = F.broadcast(snapshot.spark.createDataFrame(steps or [(-1, "", -1)], "state int, label string, next int"))  # as long as the pattern
    frontier = cut(snapshot.numbers(seeds).withColumn("state", F.explode(F.array(*[F.lit(s) for s in starts]))))
    known, old = [frontier], []
    while True:
        met = snapshot.meet(frontier.join(nfa, "state").select("num", "label", "next"), incoming)
        new = met.where("label = 'any' or kind = label").select(F.col("far").alias("num"), F.col("next").alias("state")).distinct()
        frontier = cut(new.join(_all(known), ["num", "state"], "left_anti"))
        if not frontier.limit(1).count():
            break
        known.append(frontier)
        if len(known) > ROUNDS_A_TABLE:
            whole = cut(_all(known))
            drop(*known[:-1], *old)
            known, old = [whole], [frontier]
    found = snapshot.named(_all(known).where(F.col("state") == last).select("num").distinct())
    if last in starts:  # the empty path leads a seed to itself, also one that the snapshot does not know
        found = found.unionByName(seeds.select("id").distinct().join(snapshot.nodes, "id", "left_anti").select("id"))
    return found


def pagerank(snapshot: Snapshot, rounds: int = 50, damping: float = 0.85) -> DataFrame:
    """(id, rank) over all nodes of the snapshot; as traverse.pagerank. A round exchanges ranks and what they send, once each."""
    n = snapshot.manifest["nodes"]
    if not n:
        return snapshot.nodes.select("id", F.lit(0.0).alias("rank"))
    rank = cut(snapshot.nodes.select("num", (F.col("deg") == 0).alias("dangling"), F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        sent = snapshot.meet(rank.select("num", "rank")).where("first").select(F.col("far").alias("num"), (F.col("rank") / F.col("deg")).alias("rank"), F.lit(False).alias("dangling"))
        own = rank.select("num", F.lit(0.0).alias("rank"), "dangling")
        sums = sent.unionByName(own).groupBy("num").agg(F.sum("rank").alias("s"), F.bool_or("dangling").alias("dangling"))
        new = cut(sums.crossJoin(F.broadcast(lost)).select("num", "dangling", ((1 - damping) / n + damping * (F.col("lost") / n + F.col("s"))).alias("rank")))  # lost is one row
        drop(rank)
        rank = new
    return snapshot.named(rank.select("num", "rank"))


def components(snapshot: Snapshot) -> DataFrame:
    """(id, component): weakly connected components, each named by its smallest id, of the nodes that have an edge."""
    ends = snapshot.out.select(F.col("src").alias("num")).union(snapshot.out.select("dst")).distinct()
    label = cut(ends.withColumn("c", F.col("num")))
    while True:
        sent = [snapshot.meet(label, back).select(F.col("far").alias("num"), "c") for back in (False, True)]
        low = cut(_all([label, *sent]).groupBy("num").agg(F.min("c").alias("c")))
        up = low.select(F.col("num").alias("x"), F.col("c").alias("up"))
        was = label.select("num", F.col("c").alias("old"))
        new = cut(low.join(up, F.col("c") == F.col("x")).select("num", F.least("c", "up").alias("c")).join(was, "num"))
        drop(low, label)
        label = cut(new.select("num", "c"))
        same = not new.where("c <> old").limit(1).count()
        drop(new)
        if same:
            break
    first = snapshot.nodes.select(F.col("num").alias("c"), F.col("id").alias("component"))
    return snapshot.named(label.join(first, "c").select("num", "component"))
