"""Communities by rounds of moves that raise modularity, and clusters of functions by the type they use most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.traverse import first_in_group
from codeloom.plans.cut import cut


def _moves(links: DataFrame, state: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, c, to, gain): each node's best move to a neighbour's community, where modularity rises by it alone."""
    tot = state.groupBy("c").agg(F.sum("k").alias("tot"))
    near = state.select(F.col("id").alias("dst"), F.col("c").alias("to"))
    into = links.join(near, "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w"))
    here = state.join(tot, "c").select("id", "c", "k", (F.col("tot") - F.col("k")).alias("rest"))
    stay = here.join(into.select("id", F.col("to").alias("c"), F.col("w").alias("own")), ["id", "c"], "left")
    stay = stay.select("id", "c", "k", (F.coalesce("own", F.lit(0.0)) - resolution * F.col("k") * F.col("rest") / total).alias("base"))
    go = into.join(stay, "id").where("to <> c").join(tot.select(F.col("c").alias("to"), "tot"), "to")
    gain = F.round(F.col("w") - resolution * F.col("k") * F.col("tot") / total - F.col("base"), 9)
    best = go.select("id", "c", "to", gain.alias("gain")).where("gain > 0")
    return first_in_group(best, ["id"], [F.desc("gain"), F.col("to")])


def _apart(moves: DataFrame) -> DataFrame:
    """Of the moves, some that touch different communities, so that their gains add up exactly; at least the best one."""
    order = F.struct((-F.col("gain")).alias("less"), "id")
    ends = moves.select("c", "id", "gain").unionByName(moves.select(F.col("to").alias("c"), "id", "gain"))
    first = ends.groupBy("c").agg(F.min(order).getField("id").alias("first"))
    a, b = first.select("c", F.col("first").alias("fa")), first.select(F.col("c").alias("to"), F.col("first").alias("fb"))
    return moves.join(a, "c").join(b, "to").where("fa = id and fb = id").select("id", "to")


def _score(links: DataFrame, state: DataFrame, loops: float, total: float, resolution: float) -> float:
    a, b = state.select(F.col("id").alias("src"), F.col("c").alias("a")), state.select(F.col("id").alias("dst"), F.col("c").alias("b"))
    inside = links.join(a, "src").join(b, "dst").where("a = b").agg(F.sum("w")).first()[0] or 0.0
    square = state.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return (inside + loops) / total - resolution * square / (total * total)


def communities(edges: DataFrame, resolution: float = 1.0, passes: int = 10, levels: int = 10) -> DataFrame:
    """(id, community) of edges(src, dst, weight), direction not counting; a community's name is its smallest id.

    As in the method of Louvain, nodes move to the neighbouring community that
    raises modularity most, then communities become nodes of the next level.
    A pass moves all nodes toward smaller names at once and is kept where
    modularity rose; else only moves between different pairs of communities
    are made, whose gains add up exactly. So modularity never falls.
    """
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("w"))
    links = cut(e.where("src <> dst").unionByName(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    # the weight of both ends of each node's edges, loops included
    weight = cut(links.select("src", "w").unionByName(e.where("src = dst").select("src", (F.col("w") * 2).alias("w"))).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    total = weight.agg(F.sum("k")).first()[0] or 0.0
    loops = total - (links.agg(F.sum("w")).first()[0] or 0.0)
    member = cut(weight.select("id", F.col("id").alias("community")))
    if not total:
        return member
    for _ in range(levels):
        state = cut(weight.select("id", "k", F.col("id").alias("c")))
        score, moved = _score(links, state, loops, total, resolution), False
        for _ in range(passes):
            moves = cut(_moves(links, state, total, resolution))
            if not moves.limit(1).count():
                break
            for chosen in (moves.where("to < c").select("id", "to"), _apart(moves)):
                new = cut(state.join(chosen, "id", "left").select("id", "k", F.coalesce("to", "c").alias("c")))
                now = _score(links, new, loops, total, resolution)
                if now > score + 1e-12:
                    state, score, moved = new, now, True
                    break
            else:
                break
        if not moved:
            break
        named = cut(state.join(state.groupBy("c").agg(F.min("id").alias("name")), "c").select("id", "name"))
        member = cut(member.join(named.withColumnRenamed("id", "community"), "community").select("id", F.col("name").alias("community")))
        a, b = named.select(F.col("id").alias("src"), F.col("name").alias("a")), named.select(F.col("id").alias("dst"), F.col("name").alias("b"))
        folded = links.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        folded = cut(folded)
        links = folded.where("src <> dst")
        loops += folded.where("src = dst").agg(F.sum("w")).first()[0] or 0.0
        weight = cut(weight.join(named, "id").groupBy(F.col("name").alias("id")).agg(F.sum("k").alias("k")))
    names = member.groupBy("community").agg(F.min("id").alias("name"))
    return member.join(names, "community").select("id", F.col("name").alias("community"))


def clusters_by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type): each function's most used type, ties to the smaller id; functions that use none are missing."""
    own = nodes.where("kind = 'Function'").select(F.col("id").alias("src"))
    uses = edges.where("kind = 'UsesType'").join(own, "src", "left_semi").groupBy(F.col("src").alias("id"), F.col("dst").alias("type")).agg(F.count("*").alias("n"))
    return first_in_group(uses, ["id"], [F.desc("n"), F.col("type")]).select("id", "type")
