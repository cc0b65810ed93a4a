"""Changes of files as they come: quiet periods, what is still pending, incremental extraction, results kept by content, tool events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scalars import redact
from codeloom.operators import resolve
from codeloom.plans.graph import PropertyGraph
from codeloom.sources import languages, store


def debounced(events: DataFrame, quiet: str = "2 seconds", late: str | None = None) -> DataFrame:
    """(path, first_seen, last_seen, n) of events(path, ts): one row for changes of a path with less than `quiet` between; batch or stream, which needs a watermark."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("path", F.session_window("ts", quiet)).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n")).select("path", "first_seen", "last_seen", "n")


def pending(events: DataFrame, syncs: DataFrame) -> DataFrame:
    """(path, first_seen, last_seen, indexing) of paths that no sync has taken in.

    syncs(start, ended, ok); ended is null for the one that runs. A sync that
    ended well takes in changes up to its start; later ones, and those of a
    sync that failed, stay. indexing: the running sync saw the last change.
    """
    done = syncs.agg(F.max(F.when(F.col("ok") & F.col("ended").isNotNull(), F.col("start"))).alias("done"), F.max(F.when(F.col("ended").isNull(), F.col("start"))).alias("running"))
    left = events.join(F.broadcast(done)).where("done is null or ts > done")  # one row
    seen = left.groupBy("path").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.first("running").alias("running"))
    return seen.select("path", "first_seen", "last_seen", F.coalesce(F.col("last_seen") <= F.col("running"), F.lit(False)).alias("indexing"))


def update_files(graph: PropertyGraph, indexed: DataFrame, found: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """The graph after files changed, and the files' new records (path, content_hash).

    found(path, content) are all files now, indexed(path, content_hash) those of the graph. Only changed and
    new files are read; symbols of changed and removed files go with their
    edges, edges from elsewhere to them are resolved again by name.
    """
    now = found.select("path", "content", F.sha2("content", 256).alias("content_hash"))
    changes = store.changed_files(indexed, now.select("path", "content_hash"))
    fresh = now.join(changes.where("change <> 'removed'"), "path", "left_semi")
    gone = changes.where("change <> 'added'").select(F.col("path").alias("file_path"))
    got = languages.extract(fresh)
    new = languages.symbols(got)
    kept = store.delete_files(graph, gone)
    columns = kept.nodes.columns
    add = new.select(*[c if c in new.columns else F.lit(None).cast(kept.nodes.schema[c].dataType).alias(c) for c in columns])
    nodes = kept.nodes.unionByName(add)
    symbols = nodes.select("id", "name", "kind", "qualified_name", F.col("file_path").alias("path"))
    own = languages.references(got)
    holder = new.select(F.col("qualified_name").alias("owner"), F.col("file_path").alias("path"), F.col("id").alias("from_id"))
    refs = own.join(holder, ["owner", "path"]).groupBy("ref_id").agg(F.min(F.struct("from_id", "name", "path", "kind")).alias("r")).select("ref_id", "r.*")
    again = resolve.reopened(graph.edges, graph.nodes, gone).join(nodes.select(F.col("id").alias("from_id"), F.col("file_path").alias("path")), "from_id")
    refs = refs.unionByName(again.select(F.sha2(F.concat_ws("|", "from_id", "name", "kind"), 256).alias("ref_id"), "from_id", "name", "path", "kind"))
    found_ids = resolve.resolve(refs.select("ref_id", "name", "path", "kind"), symbols)
    linked = resolve.edges_of(found_ids, refs.withColumn("line", F.lit(None).cast("int")), nodes).select("src", "dst", "kind", F.lit(1.0).alias("weight"))
    above = got.where("tag = 'edge' and kind = 'Contains'").select("path", F.col("owner").alias("up"), F.col("target").alias("down"))
    at = lambda name, out: new.groupBy(F.col("qualified_name").alias(name), F.col("file_path").alias("path")).agg(F.min("id").alias(out))
    inside = above.join(at("up", "src"), ["up", "path"]).join(at("down", "dst"), ["down", "path"]).select("src", "dst", F.lit("Contains").alias("kind"), F.lit(1.0).alias("weight"))
    edges = kept.edges.select("src", "dst", "kind", "weight").unionByName(linked).unionByName(inside).distinct()
    return PropertyGraph(nodes, edges), now.select("path", "content_hash")


def by_content(files: DataFrame, kept: DataFrame | None, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all results, those made now): make(files) runs only on contents that kept(content_hash, ...) does not hold, each once; results carry content_hash."""
    wanted = files.select("content", F.sha2("content", 256).alias("content_hash")).dropDuplicates(["content_hash"])
    missing = wanted if kept is None else wanted.join(kept.select("content_hash").distinct(), "content_hash", "left_anti")
    made = make(missing)
    return (made if kept is None else kept.join(wanted.select("content_hash"), "content_hash", "left_semi").unionByName(made)), made


def tool_events(lines: DataFrame) -> DataFrame:
    """(tool_kind, primary_cmd, chain, path, session, redacted, ts) of logged lines(value) of key=value fields; secrets are blotted out before anything is kept."""
    def of(key: str):
        m = F.regexp_extract("value", rf'(?:^|\s){key}=(?:"([^"]*)"|(\S+))', 1)
        n = F.regexp_extract("value", rf'(?:^|\s){key}=(?:"([^"]*)"|(\S+))', 2)
        return F.nullif(F.when(m != "", m).otherwise(n), F.lit(""))

    safe = lines.select("value", redact(F.col("value")).alias("clean")).select(F.col("clean").alias("value"), (F.col("value") != F.col("clean")).alias("redacted"))
    chain = of("chain")
    return safe.where(of("tool_kind").isNotNull()).select(of("tool_kind").alias("tool_kind"), F.coalesce(of("primary_cmd"), F.regexp_extract(chain, r"^(\S+)", 1)).alias("primary_cmd"), chain.alias("chain"), of("path").alias("path"), of("session").alias("session"), "redacted", of("ts").cast("long").alias("ts"))


def ingest(events: DataFrame, folder: str, checkpoint: str):
    """Append a stream of events to a table of Parquet files; what is there now is taken in, then it ends. A batch that is run again is written once."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
