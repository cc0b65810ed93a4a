"""Imports through path aliases and workspace packages: the longest alias that a name begins with, its targets in order.

aliases: root (a folder, '' for the top), pattern, target, place (order of the
targets of a pattern). A pattern is a name, or holds one *: what stands before
and after it must begin and end the name, and what is between fills the * of
the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import dirname, normal_path
from codeloom.plans.cut import cut

#: Endings tried for a path that is no file itself, in order.
ENDINGS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def _parts(pattern: str) -> list[Column]:
    """Before and after the *, and whether there is one."""
    star = F.col(pattern).contains("*")
    before = F.when(star, F.substring_index(pattern, "*", 1)).otherwise(F.col(pattern))
    after = F.when(star, F.substring_index(pattern, "*", -1)).otherwise("")
    return [before.alias("before"), after.alias("after"), star.alias("star")]


def workspace_aliases(packages: DataFrame) -> DataFrame:
    """Aliases of packages(name, folder[, entry]): the name is the entry, index where none is given; name/* are files below the folder."""
    entry = F.col("entry") if "entry" in packages.columns else F.lit(None).cast("string")
    whole = packages.select(F.lit("").alias("root"), F.col("name").alias("pattern"), F.concat_ws("/", "folder", F.coalesce(entry, F.lit("index"))).alias("target"), F.lit(0).alias("place"))
    below = packages.select(F.lit("").alias("root"), F.concat("name", F.lit("/*")).alias("pattern"), F.concat("folder", F.lit("/*")).alias("target"), F.lit(0).alias("place"))
    return whole.unionByName(below)


def homes(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the nearest of roots(root) that holds each of files(path); paths without one are left out."""
    folders = F.split(dirname(F.col("path")), "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda k: F.struct(k.alias("depth"), F.when(k > 0, F.array_join(F.slice(folders, 1, k), "/")).otherwise("").alias("root")))
    above = files.select("path").distinct().select("path", F.explode(ups).alias("u")).select("path", "u.depth", "u.root").distinct()
    return above.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", "depth").alias("root"))


def rewrite(references: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ref_id, place, target, pattern): the paths that references(ref_id, path, name) stand for, by the aliases of the nearest root.

    A name without * wins, then what has the longest text before the *, then
    the longest after it. Names are cut at the lengths that aliases have, so a
    name meets an alias by equality of root and beginning.
    """
    a = cut(aliases.select("root", "pattern", "target", "place", *_parts("pattern")))
    lengths = sorted(r.n for r in a.select(F.length("before").alias("n")).distinct().collect())  # bounded by the longest alias
    at = references.join(homes(references, a), "path").select("ref_id", "root", "name")
    if not lengths:
        return at.select("ref_id", F.lit(0).alias("place"), F.col("name").alias("target"), F.col("name").alias("pattern")).limit(0)
    heads = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("name"))
    probed = at.select("*", F.explode(heads).alias("n")).withColumn("before", F.expr("substring(name, 1, n)"))
    rules = a.select("root", "before", "after", "star", "pattern").distinct()
    fits = F.when(F.col("star"), F.col("name").endswith(F.col("after")) & (F.length("name") >= F.length("before") + F.length("after"))).otherwise(F.col("name") == F.col("before"))
    met = probed.join(rules, ["root", "before"]).where(fits)
    best = met.groupBy("ref_id").agg(F.max(F.struct(~F.col("star"), F.length("before"), F.length("after"), "pattern", "root", "name", "before", "after")).alias("b")).select("ref_id", "b.pattern", "b.root", "b.name", "b.before", "b.after")
    filled = F.expr("substring(name, length(before) + 1, length(name) - length(before) - length(after))")
    out = best.join(a.select("root", "pattern", "target", "place"), ["root", "pattern"])
    star = F.instr("target", "*")
    path = F.when(star > 0, F.concat(F.substring_index("target", "*", 1), filled, F.expr("substring(target, instr(target, '*') + 1)"))).otherwise(F.col("target"))
    home = F.when(F.col("root") == "", path).otherwise(F.concat_ws("/", "root", path))
    return out.select("ref_id", "place", normal_path(home).alias("target"), "pattern")


def by_alias(references: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ref_id, id, target): the first file of files(id, path) among the targets of a reference, each with its endings in order."""
    tried = rewrite(references, aliases).select("ref_id", "place", F.posexplode(F.transform(F.array(*[F.lit(e) for e in ENDINGS]), lambda e: F.concat("target", e))).alias("ending", "path"))
    found = tried.join(files.select("id", "path"), "path")
    first = Window.partitionBy("ref_id").orderBy("place", "ending", "id")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("ref_id", "id", F.col("path").alias("target"))
