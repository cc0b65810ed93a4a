"""The property graph: nodes and edges as DataFrames, and the view of the driver's tables as one.

nodes: id, kind, name, qualified_name, file_path, revision, score; optional: metadata (map of strings), visibility
edges: src, dst, kind, weight
history, where known: commit, item (a file path)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.cut import cut
from codeloom.plans.snapshot import Snapshot, revision_of
from codeloom.sources.ranges import RangeIndex

NODE_KINDS = ("Function", "Struct", "Enum", "Module", "Trait", "EnumVariant", "Field", "TypeAlias", "Constant", "Interface")
TYPE_KINDS = ("Struct", "Enum", "Trait")
CALL_KINDS = ("Calls", "UnresolvedCall")
EDGE_KINDS = ("Calls", "UnresolvedCall", "ExternalCall", "Contains", "Implements", "Extends", "UsesType", "References", "Returns", "TypeOf", "Imports")

ENTRY_KINDS = ("Main", "PublicApi", "Test", "Bench", "FfiExport")


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    history: DataFrame | None = None
    snapshot: Snapshot | None = None
    ranges: RangeIndex | None = None

    @property
    def adjacency(self) -> DataFrame | Snapshot:
        """The snapshot where there is one, else the edges: what a traversal over all edges takes."""
        return self.snapshot or self.edges

    def meta(self, key: str) -> Column:
        """A node's metadata entry, null where there is none."""
        return F.col("metadata")[key] if "metadata" in self.nodes.columns else F.lit(None).cast("string")

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*kinds))

    def edges_of_kind(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("kind").isin(*kinds))

    def named(self, text: str, *kinds: str) -> DataFrame:
        """Nodes of the kinds whose name holds the text, whatever its case."""
        return self.of_kind(*kinds).where(F.lower("name").contains(text.lower()))

    def glob(self, pattern: str) -> DataFrame:
        """Nodes whose qualified name matches a pattern of * and ?."""
        return self.nodes.where(F.col("qualified_name").rlike(glob_regex(pattern)))

    def induced(self, ids: DataFrame) -> DataFrame:
        """Edges with both ends in ids(id)."""
        e = self.edges.join(ids, self.edges.src == ids.id, "left_semi")
        return e.join(ids, e.dst == ids.id, "left_semi")

    def filtered(self, keep: Column) -> PropertyGraph:
        nodes = self.nodes.where(keep)
        return PropertyGraph(nodes, PropertyGraph(nodes, self.edges).induced(nodes.select("id")))

    def dead(self, *kinds: str) -> DataFrame:
        """Nodes of the kinds that no edge but Contains reaches."""
        used = self.edges.where("kind <> 'Contains'").select("dst").distinct()
        own = self.of_kind(*kinds)
        return own.join(used, own.id == used.dst, "left_anti")

    def invalid_edges(self) -> DataFrame:
        """Edges with an end that is no node."""
        ids = self.nodes.select("id")
        known = self.edges.join(ids, self.edges.src == ids.id, "left_semi").join(ids.withColumnRenamed("id", "id2"), F.col("dst") == F.col("id2"), "left_semi")
        return self.edges.exceptAll(known)

    def kind_counts(self) -> DataFrame:
        return self.nodes.groupBy("kind").agg(F.count("*").alias("n"))

    def metrics(self) -> DataFrame:
        """In- and out-degree, calls made and received, children of each node; one pass over both edge ends."""
        flag = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
        ends = self.edges.select(F.col("src").alias("id"), "kind", F.lit(True).alias("out")).unionByName(self.edges.select(F.col("dst").alias("id"), "kind", F.lit(False).alias("out")))
        got = ends.groupBy("id").agg(
            flag(~F.col("out")).alias("in_degree"),
            flag(F.col("out")).alias("out_degree"),
            flag(F.col("out") & F.col("kind").isin(*CALL_KINDS)).alias("calls"),
            flag(~F.col("out") & F.col("kind").isin(*CALL_KINDS)).alias("callers"),
            flag(F.col("out") & (F.col("kind") == "Contains")).alias("children"),
        )
        names = ["in_degree", "out_degree", "calls", "callers", "children"]
        return self.nodes.select("id").join(got, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def glob_regex(pattern: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != "_" else c) for c in pattern) + "$"


def from_tables(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """regions and nations are modules, customers and orders functions, parts structs, suppliers traits."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    zero = F.lit(0)

    def nodes(table: str, col: str, kind: str, name: Column, path: Column, revision: Column = zero, score: Column = zero) -> DataFrame:
        ident = key(table, col)
        return t(table if table != "order" else "orders").select(ident.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.concat_ws("::", F.lit(table), name).alias("qualified_name"), path.alias("file_path"), revision.cast("long").alias("revision"), score.cast("double").alias("score"))

    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    n = nodes("region", "r_regionkey", "Module", F.col("r_name"), F.lit("world"))
    n = n.unionByName(nodes("nation", "n_nationkey", "Module", F.col("n_name"), key("region", "n_regionkey")))
    n = n.unionByName(nodes("customer", "c_custkey", "Function", F.col("c_name"), key("nation", "c_nationkey"), score=F.col("c_acctbal")))
    n = n.unionByName(nodes("supplier", "s_suppkey", "Trait", F.col("s_name"), key("nation", "s_nationkey"), score=F.col("s_acctbal")))
    n = n.unionByName(nodes("part", "p_partkey", "Struct", F.col("p_name"), F.col("p_brand"), score=F.col("p_size")))
    n = n.unionByName(nodes("order", "o_orderkey", "Function", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), key("customer", "o_custkey"), month, F.col("o_totalprice")))

    def edges(df: DataFrame, src: Column, dst: Column, kind: str, weight: Column) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), weight.cast("double").alias("weight"))

    one, li = F.lit(1.0), t("lineitem")
    uses = li.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    impl = li.select("l_partkey", "l_suppkey").distinct()
    e = edges(t("nation"), key("region", "n_regionkey"), key("nation", "n_nationkey"), "Contains", one)
    e = e.unionByName(edges(t("customer"), key("nation", "c_nationkey"), key("customer", "c_custkey"), "Contains", one))
    e = e.unionByName(edges(t("supplier"), key("nation", "s_nationkey"), key("supplier", "s_suppkey"), "Contains", one))
    e = e.unionByName(edges(t("orders"), key("customer", "o_custkey"), key("order", "o_orderkey"), "Calls", one))
    e = e.unionByName(edges(uses, key("order", "l_orderkey"), key("part", "l_partkey"), "UsesType", F.col("q")))
    e = e.unionByName(edges(impl, key("part", "l_partkey"), key("supplier", "l_suppkey"), "Implements", one))
    return PropertyGraph(n, e)


_RESIDENT: dict[tuple[str, str], PropertyGraph] = {}


def resident(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """from_tables with its nodes, edges and snapshot kept in the shared folder for the application; built again once a file of the tables changes."""
    g = from_tables(spark, sf_dir)
    revision = revision_of(g.nodes.select("id").union(g.edges.select("src")))
    key = (spark.sparkContext.applicationId, sf_dir)
    kept = _RESIDENT.get(key)
    if kept is None or kept.snapshot.stale(revision):
        nodes, edges = cut(g.nodes), cut(g.edges)
        kept = _RESIDENT[key] = PropertyGraph(nodes, edges, None, Snapshot.build(nodes, edges, revision))
    return kept
