"""Chains of calls, a.b().c().d(): the type that one link returns is the receiver of the next.

members: type, member, returns (a type or null), id; supertypes: type, super,
place (order of the supertypes of a type). References carry the type of their
first receiver and the members called, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.plans.cut import cut, drop


def links_of(text: Column) -> tuple[Column, Column]:
    """The receiver of a chain written out and the members called on it: calls' arguments, :: and ?. count as . does."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\((?:[^()]|\([^()]*\))*\)", ""), r"\?\.|::|->", ".")
    parts = F.split(F.regexp_replace(bare, r"\s+", ""), r"\.")
    return parts[0], F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def lookup(wanted: DataFrame, members: DataFrame, supertypes: DataFrame | None = None) -> DataFrame:
    """(type, member, id, returns) of wanted(type, member): a type's own member, else that of its nearest supertype, of several equally near the first in order.

    Types without the member ask their supertypes, all in one round; a type is
    asked once for each that began, so a ring of supertypes ends.
    """
    own = cut(members.groupBy("type", "member").agg(F.min_by(F.struct("id", "returns"), "id").alias("m")).select(F.col("type").alias("at"), "member", "m.id", "m.returns"))
    open_ = cut(wanted.select("type", "member").distinct().withColumn("at", F.col("type")).withColumn("way", F.array().cast("array<int>")))
    done, asked = None, open_.select("type", "member", "at")
    while True:
        met = open_.join(own, ["at", "member"])
        hit = cut(met.groupBy("type", "member").agg(F.min_by(F.struct("id", "returns"), F.struct("way", "at")).alias("m")).select("type", "member", "m.id", "m.returns"))
        done = hit if done is None else done.unionByName(hit)
        if supertypes is None:
            return done
        rest = open_.join(hit, ["type", "member"], "left_anti").join(supertypes.select(F.col("type").alias("at"), "super", F.col("place").cast("int").alias("place")), "at")
        up = rest.groupBy("type", "member", F.col("super").alias("at")).agg(F.min(F.concat("way", F.array("place"))).alias("way"))
        open_ = cut(up.join(asked, ["type", "member", "at"], "left_anti"))
        if not open_.limit(1).count():
            return done
        asked = cut(asked.unionByName(open_.select("type", "member", "at")))


def resolve_chains(chains: DataFrame, members: DataFrame, supertypes: DataFrame | None = None) -> DataFrame:
    """(ref_id, id, found, type) of chains(ref_id, receiver, links): the last link's member if every link was found, else null; how many were found; the type that the last found one returns (the receiver's at first).

    A round settles one link of every chain: the distinct (type, member) pairs
    are looked up once, whatever the chains that ask, and pairs known from
    earlier rounds are not looked up again. A link that is not found, or
    returns no known type before the end, ends its chain. A chain without
    links, or with a null receiver, has found none.
    """
    open_ = cut(chains.select("ref_id", F.col("receiver").alias("type"), F.coalesce("links", F.array().cast("array<string>")).alias("links"), F.lit(0).alias("found"), F.lit(None).cast(members.schema["id"].dataType).alias("id")))
    done, memo = None, None
    while True:
        more = (F.col("found") < F.size("links")) & F.col("type").isNotNull()
        own = open_.where(~F.coalesce(more, F.lit(False))).select("ref_id", F.when((F.size("links") > 0) & (F.col("found") == F.size("links")), F.col("id")).alias("id"), "found", "type")
        done = own if done is None else done.unionByName(own)
        going = open_.where(more).withColumn("member", F.element_at("links", F.col("found") + 1))
        pairs = going.select("type", "member").distinct()
        new = pairs if memo is None else pairs.join(memo, ["type", "member"], "left_anti")
        new = cut(new)
        if new.limit(1).count():
            got = cut(new.join(lookup(new, members, supertypes), ["type", "member"], "left"))
            grown = got if memo is None else cut(memo.unionByName(got))
            memo = grown
        elif memo is None:
            return done
        drop(new)
        step = going.join(memo.select("type", "member", F.col("id").alias("hit"), F.col("returns")), ["type", "member"])
        stuck = step.where("hit is null").select("ref_id", F.lit(None).cast(members.schema["id"].dataType).alias("id"), "found", "type")
        done = done.unionByName(stuck)
        open_ = cut(step.where("hit is not null").select("ref_id", F.col("returns").alias("type"), "links", (F.col("found") + 1).alias("found"), F.col("hit").alias("id")))
        if not open_.limit(1).count():
            return done
