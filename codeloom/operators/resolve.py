"""References resolved to symbols in tiers: imports, file paths, qualified names, methods, exact names, fuzzy names; edges from what was found.

references: ref_id, name, path, and where known kind, language, line
symbols: id, name, kind, qualified_name, path, and where known language, exported, line
imports: path, local, source, original; source is the imported module as written, original the name in it
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import dirname, name_parts, normal_path, proximity
from codeloom.operators import aliases, chains
from codeloom.plans.cut import cut

#: Directories of a path that count; proximity is capped at 80, 15 each.
DEPTH = 6
CLASSES = ("Class", "Struct", "Interface", "Trait")
CALLABLES = ("Function", "Method", "Class")
_OUT = ("ref_id", "id", "confidence", "how")


def _filled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns({k: v for k, v in columns.items() if k not in df.columns})


def _shaped(references: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None)
    r = _filled(references, {"kind": F.lit("Calls"), "language": none.cast("string"), "line": none.cast("int")})
    s = _filled(symbols, {"language": none.cast("string"), "exported": F.lit(False), "line": none.cast("int")})
    s = s.select("id", F.col("name").alias("s_name"), F.col("kind").alias("s_kind"), F.coalesce("qualified_name", "name").alias("qualified"), F.col("path").alias("s_path"), F.col("language").alias("s_language"), F.coalesce("exported", F.lit(False)).alias("exported"), F.col("line").alias("s_line"))
    return r.select("ref_id", "name", "path", "kind", "language", "line"), s


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def by_import(references: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """0.9: the name is a local name of an import of its file, and a file that the source names holds the original.

    A source that starts with a dot is taken from the importing file's folder; dots of a module are slashes. Only the first part of a dotted name is imported.
    """
    source = F.when(F.col("source").startswith("./") | F.col("source").startswith("../"), F.concat_ws("/", dirname(F.col("path")), "source")).otherwise(F.regexp_replace("source", r"(?<=\w)\.(?=\w)", "/"))
    step = lambda c: F.regexp_replace(c, r"(?:^|(?<=/))[^/.][^/]*/\.\./", "")
    module = F.regexp_replace(step(step(normal_path(F.regexp_replace(source, "/\\./", "/")))), r"\.\w+$", "")
    i = imports.select("path", F.col("local").alias("name"), module.alias("module"), F.coalesce("original", "local").alias("s_name")).distinct()
    stem = F.regexp_replace(F.regexp_replace("s_path", r"\.\w+$", ""), r"/(?:index|__init__|mod)$", "")
    parts = F.split(stem, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    homes = symbols.select("id", "s_name", "s_path", F.explode(ends).alias("module"))
    found = references.join(i, ["path", "name"]).join(homes, ["module", "s_name"])
    return found.groupBy("ref_id").agg(F.min_by("id", F.struct(F.length("s_path"), "id")).alias("id")).select("ref_id", "id", F.lit(0.9).alias("confidence"), F.lit("import").alias("how"))


def by_path(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names with a slash are files: the whole path 0.95, its end 0.85, the only file of that name 0.7."""
    files = symbols.where("s_kind = 'File'")
    r = references.where("name like '%/%'").withColumn("s_name", F.element_at(F.split("name", "/"), -1)).where("s_name <> ''")
    one = files.groupBy("s_name").agg(F.count("*").alias("n"))
    found = r.join(files, "s_name").join(one, "s_name")
    whole = (F.col("qualified") == F.col("name")) | (F.col("s_path") == F.col("name"))
    end = F.endswith("qualified", "name") | F.endswith("s_path", "name")
    c = F.when(whole, 0.95).when(end, 0.85).when(F.col("n") == 1, 0.7)
    return found.withColumn("c", c).where("c is not null").groupBy("ref_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "id")).alias("b")).select("ref_id", "b.id", (-F.col("b.c")).alias("confidence"), F.lit("file-path").alias("how"))


def by_qualified(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names with :: or a dot: the only symbol of that qualified name 0.95, one whose qualified name ends so 0.85."""
    r = references.where(F.col("name").contains("::") | F.col("name").contains("."))
    one = symbols.groupBy("qualified").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
    whole = r.join(one, r.name == one.qualified).select("ref_id", "id", F.lit(0.95).alias("confidence"))
    rest = r.join(whole.select("ref_id"), "ref_id", "left_anti").withColumn("s_name", F.element_at(F.split("name", "[:.]"), -1)).where("s_name <> ''")
    ends = rest.join(symbols, "s_name").where(F.endswith("qualified", "name")).groupBy("ref_id").agg(F.min("id").alias("id")).select("ref_id", "id", F.lit(0.85).alias("confidence"))
    return whole.unionByName(ends).withColumn("how", F.lit("qualified-name"))


def by_method(references: DataFrame, symbols: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """receiver.method or Class::method.

    A receiver whose type typed(path, variable, type) tells 0.9; one that is a
    class's name 0.85, or is one with a capital 0.8: a method of that name in
    the class's file whose qualified name holds the class's. Else the only
    method of that name in the language 0.7, or the one whose class shares
    most words with the receiver 0.65.
    """
    m = r"^([0-9A-Za-z_.]+?)(?:\.|::)([0-9A-Za-z_]+)$"
    r = references.where(F.col("name").rlike(m)).withColumns({"receiver": F.regexp_extract("name", m, 1), "method": F.regexp_extract("name", m, 2)})
    methods = symbols.where("s_kind in ('Method', 'Function')").select("id", F.col("s_name").alias("method"), "qualified", "s_path", "s_language").where(F.col("qualified") != F.col("method"))
    classes = symbols.where(F.col("s_kind").isin(*CLASSES)).select(F.col("s_name").alias("class"), F.col("s_path").alias("c_path"), F.col("s_language").alias("c_language")).distinct()
    own = classes.join(methods, (classes.c_path == methods.s_path) & F.contains("qualified", "class")).groupBy("class", "c_path", "c_language", "method").agg(F.min("id").alias("id"))
    capital = F.concat(F.upper(F.substring("receiver", 1, 1)), F.expr("substring(receiver, 2)"))
    asked = r.select("ref_id", "path", "language", "method", F.col("receiver").alias("class"), F.lit(0.85).alias("confidence"))
    asked = asked.unionByName(r.where(capital != F.col("receiver")).select("ref_id", "path", "language", "method", capital.alias("class"), F.lit(0.8).alias("confidence")))
    if typed is not None:
        known = r.join(typed.withColumnRenamed("variable", "receiver"), ["path", "receiver"])
        asked = asked.unionByName(known.select("ref_id", "path", "language", "method", F.col("type").alias("class"), F.lit(0.9).alias("confidence")))
    hit = asked.join(own, ["class", "method"]).where(_same("language", "c_language"))
    hit = hit.groupBy("ref_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("c_path") != F.col("path"), "id")).alias("b")).select("ref_id", "b.id", (-F.col("b.c")).alias("confidence"))
    rest = r.join(hit.select("ref_id"), "ref_id", "left_anti")
    # names of methods with the words of their classes: one row for a word, so that a receiver meets only methods that share one
    lone = methods.groupBy("method", "s_language").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    only = rest.join(lone.where("n = 1"), "method").where(_same("language", "s_language")).select("ref_id", "id", F.lit(0.7).alias("confidence"))
    words = methods.select("id", "method", "s_language", F.explode(F.array_distinct(name_parts(F.col("qualified")))).alias("word")).where(F.length("word") > 1)
    spoken = rest.join(only.select("ref_id"), "ref_id", "left_anti").select("ref_id", "method", "language", F.explode(F.array_distinct(name_parts(F.col("receiver")))).alias("word")).where(F.length("word") > 1)
    shared = spoken.join(words, ["method", "word"]).where(_same("language", "s_language")).groupBy("ref_id", "id").agg(F.count("*").alias("k"))
    most = shared.groupBy("ref_id").agg(F.min(F.struct(-F.col("k"), "id")).alias("b")).select("ref_id", "b.id", F.lit(0.65).alias("confidence"))
    return hit.unionByName(only).unionByName(most).withColumn("how", F.lit("instance-method"))


def _dirs(path: str) -> Column:
    """The folders that hold a path, from none to DEPTH deep, with how deep they are."""
    d = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(0), F.least(F.size(d) - 1, F.lit(DEPTH))), lambda k: F.struct(k.alias("depth"), F.when(k > 0, F.array_join(F.slice(d, 1, k), "/")).otherwise("").alias("folder")))


#: Kinds of references that prefer some kinds of symbols; the last stands for all others.
_KINDS = ("Calls", "Instantiates", "Decorates", "")


def _fits(kind: str) -> Column:
    """What a symbol's kind is worth to a reference of a kind."""
    k = F.col("s_kind")
    if kind == "Calls":
        return F.when(k.isin("Function", "Method"), 25).otherwise(0)
    if kind == "Instantiates":
        return F.when(k.isin("Class", "Struct", "Interface"), 25).otherwise(0)
    if kind == "Decorates":
        return F.when(k.isin("Function", "Method"), 25).when(k.isin("Class", "Interface"), 15).otherwise(0)
    return F.lit(0)


def by_exact(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of that name: the only one 0.9, 0.5 in another language; of several the best, 0.7 with two shared folders, else 0.4.

    The best is in the same file, nearest by line; else of the same language,
    by shared folders (15 each, at most 80), kind (25) and export (10); of
    other languages only what scores over 79 of these. Ties go to the least id.
    A name's symbols are reduced to the best for each folder before they meet
    references, so a common name costs no product of the two.
    """
    r = references.withColumn("ask", F.when(F.col("kind").isin("Calls", "Instantiates", "Decorates"), F.col("kind")).otherwise(""))
    counts = symbols.groupBy("s_name").agg(F.count("*").alias("n"), F.min("id").alias("only"), F.min("s_language").alias("l"))
    r = r.join(counts, r.name == counts.s_name).drop("s_name")
    one = r.where("n = 1").select("ref_id", F.col("only").alias("id"), F.when(_same("language", "l"), 0.9).otherwise(0.5).alias("confidence"))
    many = r.where("n > 1").drop("n", "only", "l")
    static = lambda k: _fits(k) + F.when(F.col("exported"), 10).otherwise(0)
    each = symbols.withColumn("at", F.explode(F.array(*[F.struct(F.lit(k).alias("ask"), static(k).cast("double").alias("worth")) for k in _KINDS]))).select("*", "at.ask", "at.worth").drop("at")
    close = F.when(F.coalesce("s_line", F.lit(0)) != 0, F.greatest(20 - F.abs(F.col("s_line") - F.coalesce("line", F.lit(0))) / 10, F.lit(0.0))).otherwise(0.0)
    score = lambda near, worth: near + worth + F.when(_same("language", "s_language"), 50).otherwise(-80)
    here = many.join(each.withColumnsRenamed({"s_name": "name", "s_path": "path"}), ["name", "path", "ask"])
    here = here.select("ref_id", "id", score(proximity(F.col("path"), F.col("path")) + 100, F.col("worth") + close).alias("score"), proximity(F.col("path"), F.col("path")).alias("near"))
    folders = each.select("*", F.explode(_dirs("s_path")).alias("d"))
    best = folders.groupBy(F.col("s_name").alias("name"), "s_language", "ask", "d.folder").agg(F.min(F.struct((-F.col("worth")).alias("w"), "id")).alias("b"))
    sites = many.select("name", "path", F.coalesce("language", F.lit("")).alias("l"), "language", "ask").distinct()
    probed = sites.select("*", F.explode(_dirs("path")).alias("d")).select("*", "d.folder", F.least(F.col("d.depth") * 15, F.lit(80)).alias("near")).drop("d")
    met = probed.join(best, ["name", "ask", "folder"]).select("name", "path", "l", "ask", "b.id", score(F.col("near"), -F.col("b.w")).alias("score"), "near")
    won = met.groupBy("name", "path", "l", "ask").agg(F.min(F.struct(-F.col("score"), "id", "near", "score")).alias("w"))
    far = many.withColumn("l", F.coalesce("language", F.lit(""))).join(won, ["name", "path", "l", "ask"]).select("ref_id", "w.id", "w.score", "w.near")
    first = here.unionByName(far).where("score > -1").groupBy("ref_id").agg(F.min(F.struct(-F.col("score"), "id", "near")).alias("b"))
    several = first.select("ref_id", "b.id", F.when(F.col("b.near") >= 30, 0.7).otherwise(0.4).alias("confidence"))
    return one.unionByName(several).withColumn("how", F.lit("exact-match"))


def by_fuzzy(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """The only callable whose name is the same in lower case: 0.5 of the reference's language, else 0.3 if no other language has one."""
    low = symbols.where(F.col("s_kind").isin(*CALLABLES)).select("id", F.lower("s_name").alias("low"), "s_language")
    own = low.groupBy("low", "s_language").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    every = low.groupBy("low").agg(F.count("*").alias("all"), F.min("id").alias("any"))
    r = references.withColumn("low", F.lower("name"))
    met = r.join(own, (r.low == own.low) & r.language.eqNullSafe(own.s_language), "left").drop(own.low).join(every, "low")
    c = F.when(F.col("n") == 1, 0.5).when(F.col("n").isNull() & (F.col("all") == 1), 0.3)
    return met.withColumn("confidence", c).where("confidence is not null").select("ref_id", F.coalesce("id", "any").alias("id"), "confidence", F.lit("fuzzy").alias("how"))


def by_alias(references: DataFrame, symbols: DataFrame, table: DataFrame) -> DataFrame:
    """0.9: the name stands for a file by the longest of the aliases of the nearest folder that has any; see aliases.by_alias."""
    files = symbols.where("s_kind = 'File'").select("id", F.col("s_path").alias("path"))
    return aliases.by_alias(references.select("ref_id", "path", "name"), files, table).select("ref_id", "id", F.lit(0.9).alias("confidence"), F.lit("alias").alias("how"))


def by_chain(references: DataFrame, members: DataFrame, typed: DataFrame, supertypes: DataFrame | None = None) -> DataFrame:
    """0.85: a chain of calls whose first receiver typed(path, variable, type) tells, each link on what the one before returns; see chains.resolve_chains."""
    receiver, links = chains.links_of(F.col("name"))
    asked = references.where(F.col("name").rlike(r"\)\s*(?:\?\.|\.|::|->)")).select("ref_id", "path", receiver.alias("variable"), links.alias("links"))
    known = asked.join(typed, ["path", "variable"]).groupBy("ref_id").agg(F.min(F.struct("type", "links")).alias("t")).select("ref_id", F.col("t.type").alias("receiver"), "t.links")
    return chains.resolve_chains(known, members, supertypes).where("id is not null").select("ref_id", "id", F.lit(0.85).alias("confidence"), F.lit("call-chain").alias("how"))


def resolve(references: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, typed: DataFrame | None = None, alias_table: DataFrame | None = None, members: DataFrame | None = None, supertypes: DataFrame | None = None) -> DataFrame:
    """(ref_id, id, confidence, how): the first tier that finds a symbol decides; what none finds is left out.

    Aliases come before file paths, chains of calls (with members and typed)
    before qualified names.

    Built-in and external names are best taken out first by prefilter().
    """
    r, s = _shaped(references, symbols)
    r, s = cut(r), cut(s)
    tiers = [lambda x: by_import(x, s, imports)] if imports is not None else []
    tiers += [lambda x: by_alias(x, s, alias_table)] if alias_table is not None else []
    tiers += [lambda x: by_path(x, s)]
    tiers += [lambda x: by_chain(x, members, typed, supertypes)] if members is not None and typed is not None else []
    tiers += [lambda x: by_qualified(x, s), lambda x: by_method(x, s, typed), lambda x: by_exact(x, s), lambda x: by_fuzzy(x, s)]
    done, rest = None, r
    for tier in tiers:
        found = cut(tier(rest).select(*_OUT))
        done = found if done is None else done.unionByName(found)
        rest = rest.join(found.select("ref_id"), "ref_id", "left_anti")
    return done


def prefilter(references: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, external: tuple[str, ...] = ()) -> DataFrame:
    """References worth resolving: not external names, and with a symbol of the last part of the name, in any case, or an import of it."""
    last = F.lower(F.when(F.col("name").contains("/"), F.element_at(F.split("name", "/"), -1)).otherwise(F.element_at(F.split("name", r"[:.]+"), -1)))
    known = symbols.select(F.lower("name").alias("__low"))
    if imports is not None:
        known = known.union(imports.select(F.lower("local")))
    return references.where(~F.col("name").isin(*external) if external else F.lit(True)).withColumn("__low", last).join(known.distinct(), "__low", "left_semi").drop("__low")


def edges_of(resolved: DataFrame, references: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, kind, line, metadata) of resolved and references(ref_id, from_id, kind, line): extends to an interface from what is none implements, a call of a class or struct instantiates."""
    k = nodes.select("id", F.col("kind").alias("k"))
    e = resolved.join(references.select("ref_id", F.col("from_id").alias("src"), "kind", "line"), "ref_id").withColumnRenamed("id", "dst")
    e = e.join(k.toDF("dst", "to_kind"), "dst", "left").join(k.toDF("src", "from_kind"), "src", "left")
    face = lambda c: F.coalesce(F.col(c).isin("Interface", "Protocol"), F.lit(False))
    kind = F.when((F.col("kind") == "Extends") & face("to_kind") & F.col("from_kind").isNotNull() & ~face("from_kind"), "Implements").when((F.col("kind") == "Calls") & F.col("to_kind").isin("Class", "Struct"), "Instantiates").otherwise(F.col("kind"))
    return e.select("src", "dst", kind.alias("kind"), "line", F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("resolvedBy"), F.col("how")).alias("metadata"))


def reopened(edges: DataFrame, nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """(from_id, name, kind): edges from files that stay to symbols of removed(file_path), as references again; Contains is dropped, an instantiation is a call again."""
    gone = nodes.join(removed, "file_path", "left_semi").select(F.col("id").alias("dst"), "name")
    stays = nodes.join(removed, "file_path", "left_anti").select(F.col("id").alias("src"))
    e = edges.where("kind <> 'Contains'").join(gone, "dst").join(stays, "src", "left_semi")
    return e.select(F.col("src").alias("from_id"), "name", F.when(F.col("kind") == "Instantiates", "Calls").otherwise(F.col("kind")).alias("kind")).distinct()
