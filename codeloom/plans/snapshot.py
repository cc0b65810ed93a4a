"""A graph's adjacency kept in place: numbered nodes, edges dealt to buckets by their end, in both directions, and a manifest with the revision.

A round of a traversal joins its frontier with the buckets where they lie:
only the frontier is exchanged. Nodes are numbered densely in order of id, so
sets of nodes can be bitmaps too. A node whose edges would fill a bucket is
dealt to several salts, and a frontier meets all of them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.plans.cut import cut, drop, shared

#: Edges of a bucket, about, and of one salt of a node.
EDGES_A_BUCKET, EDGES_A_SALT = 1 << 21, 1 << 18
_TABLES = {"out": "src long, salt int, dst long, kind string, weight double, first boolean, deg long", "into": "dst long, salt int, src long, kind string, first boolean", "nodes": "id string, num long, deg long"}
_KEYS = {"out": "src", "into": "dst"}


class StaleSnapshot(RuntimeError):
    """The graph has another revision than the snapshot."""


def dense(ids: DataFrame, column: str = "id") -> DataFrame:
    """(column, num): numbers from 0 without a gap, in order of the column, which holds no value twice.

    Ranges are counted, one row a range, and a row's number is its place in
    its range after all that come before.
    """
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(ids.select(column).repartitionByRange(n, column).sortWithinPartitions(column).select(column, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    return rows.join(F.broadcast(starts), "__part").select(column, (F.col("__from") + F.col("__at")).cast("long").alias("num"))  # starts: a row a range


def revision_of(df: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that a plan reads: another one once a file changes."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    path: str
    manifest: dict

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, revision: str | int, path: str | None = None, buckets: int | None = None) -> Snapshot:
        """Written whole before its manifest is, so a snapshot that broke off cannot be opened.

        nodes(id), edges(src, dst, kind[, weight]); ends that are no node of
        nodes are numbered too, edges with a null end are left out. Parallel
        edges stay; `first` marks one of each (src, dst), deg counts all that
        leave src.
        """
        spark = edges.sparkSession
        path = path or f"{shared(spark)}/snapshot-{uuid.uuid4().hex}"
        weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        e = cut(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "kind", weight.alias("weight")).where("src is not null and dst is not null"))
        ids = nodes.select(F.col("id").cast("string").alias("id")).union(e.select("src")).union(e.select("dst")).where("id is not null").distinct()
        numbered = cut(dense(ids))
        end = lambda name: numbered.select(F.col("id").alias(name), F.col("num").alias(f"{name}_num"))
        pairs = cut(e.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_num").alias("src"), F.col("dst_num").alias("dst"), "kind", "weight"))
        n_edges = pairs.count()
        buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_edges // EDGES_A_BUCKET))
        one = Window.partitionBy("src", "dst").orderBy("kind", "weight")
        pairs = pairs.withColumn("first", F.row_number().over(one) == 1)
        counts = {key: cut(pairs.groupBy(key).agg(F.count("*").alias("n"))) for key in ("src", "dst")}
        hubs = {}
        for name, key, far in (("out", "src", "dst"), ("into", "dst", "src")):
            n = counts[key].select(F.col(key), F.col("n").alias("deg"), F.ceil(F.col("n") / EDGES_A_SALT).cast("int").alias("salts"))
            salted = pairs.join(n, key).withColumn("salt", F.pmod(F.xxhash64(far), F.col("salts")).cast("int"))
            columns = [c.split()[0] for c in _TABLES[name].split(", ")]
            many = n.where("salts > 1").select(F.col(key).alias("num"), "salts")
            many.write.parquet(f"{path}/{name}_hubs")
            hubs[name] = spark.read.parquet(f"{path}/{name}_hubs").count()
            _write_buckets(salted.select(*columns), buckets, _dealt_by(key, hubs[name]), f"{path}/{name}")
        degree = counts["src"].select(F.col("src").alias("num"), F.col("n").alias("deg"))
        numbered.join(degree, "num", "left").select("id", "num", F.coalesce("deg", F.lit(0)).cast("long").alias("deg")).write.parquet(f"{path}/nodes")
        manifest = {"revision": str(revision), "buckets": buckets, "edges": n_edges, "nodes": numbered.count(), "out_hubs": hubs["out"], "into_hubs": hubs["into"]}
        drop(e, numbered, *counts.values())
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, revision: str | int | None = None) -> Snapshot:
        """The snapshot at a path; where a revision is given, only if it is that of the snapshot."""
        manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
        out = cls(spark, path, manifest)
        if revision is not None:
            out.require(revision)
        for name, key in _KEYS.items():
            spark.sql(f"create table if not exists {out._name(name)} ({_TABLES[name]}) using parquet clustered by ({', '.join(_dealt_by(key, manifest[f'{name}_hubs']))}) sorted by ({key}) into {manifest['buckets']} buckets location '{path}/{name}'")
        return out

    def _name(self, table: str) -> str:
        return f"snapshot_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{table}"

    def stale(self, revision: str | int) -> bool:
        return str(revision) != self.manifest["revision"]

    def require(self, revision: str | int) -> Snapshot:
        if self.stale(revision):
            raise StaleSnapshot(f"the snapshot is of revision {self.manifest['revision']}, the graph of {revision}")
        return self

    def close(self) -> None:
        """Forget the tables of this session; the files stay."""
        for name in _KEYS:
            self.spark.sql(f"drop table if exists {self._name(name)}")

    @property
    def nodes(self) -> DataFrame:
        """(id, num, deg)"""
        return self.spark.read.schema(_TABLES["nodes"]).parquet(f"{self.path}/nodes")

    @property
    def out(self) -> DataFrame:
        """(src, salt, dst, kind, weight, first, deg), dealt by src, and salt where there are hubs."""
        return self.spark.table(self._name("out"))

    @property
    def into(self) -> DataFrame:
        """(dst, salt, src, kind, first), dealt by dst, and salt where there are hubs."""
        return self.spark.table(self._name("into"))

    def edges(self) -> DataFrame:
        """(src, dst, kind, weight) by ids again."""
        end = lambda name: self.nodes.select(F.col("id").alias(f"{name}_id"), F.col("num").alias(name))
        e = self.out.select("src", "dst", "kind", "weight").join(end("src"), "src").join(end("dst"), "dst")
        return e.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind", "weight")

    def numbers(self, ids: DataFrame) -> DataFrame:
        """(num) of ids(id); ids that the snapshot does not know are left out."""
        return self.nodes.join(ids.select("id").distinct(), "id", "left_semi").select("num")

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows with a column num, which becomes id."""
        rest = [c for c in rows.columns if c != "num"]
        return rows.join(self.nodes.select("id", "num"), "num").select("id", *rest)

    def _salted(self, rows: DataFrame, table: str) -> DataFrame:
        """rows(num, ...) with each salt of their edges, where there are hubs."""
        if not self.manifest[f"{table}_hubs"]:
            return rows
        hubs = self.spark.read.schema("num long, salts int").parquet(f"{self.path}/{table}_hubs")
        return rows.join(hubs, "num", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    def meet(self, rows: DataFrame, back: bool = False) -> DataFrame:
        """rows(num, ...) with the edges that leave num (or, back, lead to it): far, kind and, onward, weight, first, deg.

        The buckets stay where they are: rows are dealt to them by the key and
        salt, and a task looks its edges up in its share of rows.
        """
        table, near, far = ("into", "dst", "src") if back else ("out", "src", "dst")
        e = (self.into if back else self.out).withColumnRenamed(near, "num").withColumnRenamed(far, "far")
        keys = _dealt_by("num", self.manifest[f"{table}_hubs"])
        return e.join(self._salted(rows, table).hint("shuffle_hash"), keys).drop("salt")

    def links(self) -> DataFrame:
        """(src, dst, deg): each pair once."""
        return self.out.where("first").select("src", "dst", "deg")


def _dealt_by(key: str, hubs: int) -> list[str]:
    """What edges are dealt by: their end, and with hubs the salt. A salt that is always 0 would go from a join's keys, and the buckets' order with it."""
    return [key, "salt"] if hubs else [key]


def _write_buckets(df: DataFrame, buckets: int, keys: list[str], path: str) -> None:
    """One sorted file a bucket; the table that writes it is forgotten, `open` knows the files again."""
    name = f"writing_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(keys[0]).option("path", path).format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"drop table {name}")


# --- sets of numbers as bitmaps ---

#: Bits of a bitmap row: those of the functions bitmap_construct_agg and bitmap_bucket_number.
BITS = 32768


def bitmaps(rows: DataFrame) -> DataFrame:
    """(chunk, bits) of rows(num): a row for each BITS numbers of which one is there."""
    return rows.select((F.col("num") + 1).alias("n")).groupBy(F.bitmap_bucket_number("n").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def union_of(*maps: DataFrame) -> DataFrame:
    every = maps[0]
    for m in maps[1:]:
        every = every.unionByName(m)
    return every.groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("bits"))


def chunk_of(num: Column) -> Column:
    return F.bitmap_bucket_number(num + 1)


def has(bits: Column, num: Column) -> Column:
    """Whether a number is in the bitmap of its chunk; a missing bitmap has none."""
    at = F.bitmap_bit_position(num + 1)
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8).cast("int") + 1))
    return F.coalesce(bit != 0, F.lit(False))


__all__ = ["Snapshot", "StaleSnapshot", "bitmaps", "chunk_of", "dense", "has", "revision_of", "union_of"]
