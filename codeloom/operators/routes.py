"""Calls of HTTP clients joined with the routes of servers by the structure of their paths.

A pattern's segments are literals or placeholders. A pattern meets a call by
equality on (method, number of segments, place, literal) at one of its
literals, the one that fewest calls have at that place; the other segments
are compared after that. Patterns of placeholders only are one a method and
number of segments, so they meet by these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.plans.cut import cut


def segments(path: Column) -> Column:
    """The parts of a path between slashes, without query, fragment and the slashes at its ends; a part inside may be empty."""
    bare = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"^/+|/+$", "")
    return F.split(bare, "/")


def is_placeholder(part: Column) -> Column:
    """:name, {name} or <name>."""
    return part.rlike(r"^:|^\{.*\}$|^<.*>$")


def _method(c: str) -> Column:
    return F.upper(F.coalesce(c, F.lit("GET")))


def pattern_of(path: Column) -> Column:
    """The segments of a route with null for each placeholder, so that routes that differ in names of placeholders have one pattern."""
    return F.transform(segments(path), lambda p: F.when(is_placeholder(p), F.lit(None)).otherwise(p))


def matches(routes: DataFrame, calls: DataFrame, best: bool = True) -> DataFrame:
    """(call_id, route_id, method, route, literals) of routes(route_id, method, path) and calls(call_id, method, target).

    A call matches a route of its method (GET where null, case does not count)
    and number of segments if literals are equal and no placeholder stands for
    an empty segment. With `best` a call keeps the routes of its most literal
    pattern: most literals, then literals earliest, then least in order. Null
    paths match nothing.
    """
    r = routes.where("path is not null").select("route_id", _method("method").alias("method"), F.col("path").alias("route"), pattern_of(F.col("path")).alias("pattern"))
    r = cut(r.withColumn("key", F.to_json("pattern")))
    c = cut(calls.where("target is not null").select("call_id", _method("method").alias("method"), segments(F.col("target")).alias("parts")).withColumn("n", F.size("parts")))
    patterns = cut(r.select("method", "pattern", "key").distinct().withColumn("n", F.size("pattern")))
    spelled = patterns.select("*", F.posexplode("pattern").alias("place", "literal")).where("literal is not null")
    at = lambda df: df.select("*", F.posexplode("parts").alias("place", "literal"))
    # calls that repeat a target are looked up once
    targets = cut(c.select("method", "n", "parts").distinct())
    heard = at(targets).groupBy("method", "n", "place", "literal").agg(F.count("*").alias("calls"))
    places = ["method", "n", "place", "literal"]
    rated = spelled.join(heard, places, "left").groupBy("method", "key").agg(F.min_by(F.struct("place", "literal"), F.struct(F.coalesce("calls", F.lit(0)), "place")).alias("rare"))
    keyed = patterns.join(rated, ["method", "key"], "left").select("method", "n", "pattern", "key", F.col("rare.place").alias("place"), F.col("rare.literal").alias("literal"))
    met = at(targets).join(keyed.where("place is not null"), places).select("method", "n", "parts", "pattern", "key")
    bare = targets.join(keyed.where("place is null").select("method", "n", "pattern", "key"), ["method", "n"])
    fits = F.forall(F.arrays_zip("parts", "pattern"), lambda z: F.when(z.pattern.isNull(), z.parts != "").otherwise(z.parts == z.pattern))
    found = met.unionByName(bare).where(fits)
    literal = F.transform("pattern", lambda p: p.isNotNull().cast("int"))
    found = found.withColumn("literals", F.size(F.filter("pattern", lambda p: p.isNotNull())))
    if best:
        first = F.min_by(F.struct("key", "literals"), F.struct(-F.col("literals"), F.transform(literal, lambda b: -b), "key"))
        found = found.groupBy("method", "parts").agg(first.alias("b")).select("method", "parts", "b.key", "b.literals")
    out = c.join(found.select("method", "parts", "key", "literals"), ["method", "parts"]).join(r.select("method", "key", "route_id", "route"), ["method", "key"])
    return out.select("call_id", "route_id", "method", "route", "literals")


def client_edges(routes: DataFrame, calls: DataFrame, best: bool = False) -> DataFrame:
    """(src, dst, kind, label): ExternalCall edges from callers to handlers, none from a node to itself; label is METHOD path."""
    found = matches(routes, calls, best).where("call_id <> route_id")
    return found.select(F.col("call_id").alias("src"), F.col("route_id").alias("dst"), F.lit("ExternalCall").alias("kind"), F.concat_ws(" ", "method", "route").alias("label"))
