"""A graph kept as generations of Parquet, and what is written from a graph: DOT, JSON and SARIF."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.graph import PropertyGraph


class GraphStore:
    """Generations gen-N of a folder; the last one whose marker is written is current, so a write that is cut short changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        self.spark, self.folder, self.keep = spark, folder, keep
        jvm = spark.sparkContext._jvm
        self._new = jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        if not self._fs.exists(self._new(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._new(self.folder))]
        found = [int(n[4:]) for n in names if n.startswith("gen-") and n[4:].isdigit()]
        return sorted(g for g in found if self._fs.exists(self._new(f"{self.folder}/gen-{g}/meta/_SUCCESS")))

    def save(self, graph: PropertyGraph, metadata: dict[str, str] | None = None) -> int:
        """Write a new generation; its marker comes last, older ones than the last `keep` go."""
        have = self.generations()
        now = (have[-1] if have else 0) + 1
        at = f"{self.folder}/gen-{now}"
        graph.nodes.write.mode("overwrite").parquet(f"{at}/nodes")
        graph.edges.write.mode("overwrite").parquet(f"{at}/edges")
        rows = sorted((metadata or {}).items())
        self.spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{at}/meta")
        for old in (have + [now])[: -self.keep]:
            self._fs.delete(self._new(f"{self.folder}/gen-{old}"), True)
        return now

    def load(self, generation: int | None = None) -> PropertyGraph:
        at = f"{self.folder}/gen-{generation or self.generations()[-1]}"
        return PropertyGraph(self.spark.read.parquet(f"{at}/nodes"), self.spark.read.parquet(f"{at}/edges"))

    def compact(self, files: int = 1) -> int:
        """The current generation again in `files` sorted files a table, with its metadata, as a new generation; older ones but the last go."""
        g, meta = self.load(), {r.key: r.value for r in self.metadata().collect()}
        nodes = g.nodes.repartitionByRange(files, "id").sortWithinPartitions("id")
        edges = g.edges.repartitionByRange(files, "src", "dst").sortWithinPartitions("src", "dst")
        now = self.save(PropertyGraph(nodes, edges), meta)
        for old in self.generations()[:-2]:
            self._fs.delete(self._new(f"{self.folder}/gen-{old}"), True)
        return now

    def clear(self) -> None:
        """Without any generation."""
        self._fs.delete(self._new(self.folder), True)

    def metadata(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/gen-{self.generations()[-1]}/meta")


def upsert(graph: PropertyGraph, nodes: DataFrame, edges: DataFrame | None = None) -> PropertyGraph:
    """Nodes of the same id are replaced, new ones added; edges are added once each where both ends are nodes."""
    kept = graph.nodes.join(nodes.select("id"), "id", "left_anti").unionByName(nodes, allowMissingColumns=True)
    more = graph.edges if edges is None else graph.edges.unionByName(edges).dropDuplicates(["src", "dst", "kind"])
    return PropertyGraph(kept, PropertyGraph(kept, more).induced(kept.select("id")), graph.history)


def delete_files(graph: PropertyGraph, files: DataFrame) -> PropertyGraph:
    """Without the nodes of files(file_path) and every edge at them."""
    kept = graph.nodes.join(files, "file_path", "left_anti")
    return PropertyGraph(kept, PropertyGraph(kept, graph.edges).induced(kept.select("id")), graph.history)


def delete_edges_from(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    return PropertyGraph(graph.nodes, graph.edges.join(ids, graph.edges.src == ids.id, "left_anti"), graph.history)


def replace_file(graph: PropertyGraph, path: str, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """A file's declarations and edges in place of those it had."""
    files = nodes.sparkSession.createDataFrame([(path,)], "file_path string")
    return upsert(delete_files(graph, files), nodes, edges)


def changed_files(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed between indexed(path, content_hash) and found(path, content_hash)."""
    a, b = indexed.select("path", F.col("content_hash").alias("old")), found.select("path", F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", change.alias("change"))


def stale_files(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """Paths whose file is newer, by found(path, modified), than it was when indexed(path, indexed_at)."""
    return indexed.join(found, "path").where("modified > indexed_at").select("path")


def index_state(indexed: DataFrame, found: DataFrame, version: str | None = None, built_by: str | None = None) -> DataFrame:
    """One row (state, files, changed, last_indexed, rebuild) of indexed(path, content_hash, indexed_at) and found(path, content_hash): none without an index, stale where a file changed, else fresh; rebuild where another version built it."""
    changes = changed_files(indexed, found).agg(F.count("*").alias("changed"))
    own = indexed.agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed"))
    state = F.when(F.col("files") == 0, "none").when(F.col("changed") > 0, "stale").otherwise("fresh")
    return own.crossJoin(F.broadcast(changes)).select(state.alias("state"), "files", "changed", "last_indexed", F.lit(version != built_by).alias("rebuild"))  # one row each


def dot(graph: PropertyGraph) -> DataFrame:
    """(line): the graph in DOT, a line for each node and edge, in order of kind of line and then of id."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\\\])', r"\\$1"), F.lit('"'))
    head = graph.nodes.sparkSession.createDataFrame([(0, "digraph {"), (3, "}")], "part int, line string")
    n = graph.nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [label="), quoted(F.col("name")), F.lit("];")).alias("line"))
    e = graph.edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(" [label="), quoted(F.col("kind")), F.lit("];")).alias("line"))
    return head.unionByName(n).unionByName(e).orderBy("part", "line").select("line")


def envelope(rows: DataFrame, what: str, version: int = 1) -> DataFrame:
    """(value): each row as a JSON object in an envelope of what it is."""
    body = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.select(F.to_json(F.struct(F.lit(version).alias("schema_version"), F.lit(what).alias("type"), body.alias("data"))).alias("value"))


def json_schema(rows: DataFrame) -> str:
    """A JSON Schema of the rows."""
    kinds = {"string": "string", "boolean": "boolean", "double": "number", "float": "number"}
    kind = lambda t: {"type": "array"} if t.startswith("array") else {"type": "object"} if t.startswith(("struct", "map")) else {"type": kinds.get(t, "integer")}
    return json.dumps({"type": "object", "properties": {f.name: kind(f.dataType.simpleString()) for f in rows.schema}, "required": [f.name for f in rows.schema if not f.nullable]}, sort_keys=True)


def sarif(findings: DataFrame) -> DataFrame:
    """(value): one SARIF result for each of findings(rule, level, message, path, line)."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))
