"""A persisted inverted index of the words of names: stems with their positions, updated by batches.

Rows of a batch carry its number; a symbol's rows count only while the symbols
table names the same number for it, so an update appends what is new and
leaves all else where it lies. A look-up reads the folders of its stems'
buckets alone.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.scalars import words_of
from codeloom.plans.cut import cut, shared

#: Folders into which stems are dealt.
BUCKETS = 64
K1, B = 1.2, 0.75
#: What a name's and a qualified name's words weigh, what words in a row add, and each further word met in the same file, as a share.
WEIGHTS, PHRASE, TOGETHER = {"name": 10.0, "qualified_name": 5.0}, 8.0, 0.25
#: Suffixes taken off, in turn; each with the fewest letters that must stay before it.
_RULES = ((r"^(.{3,})ies$", "$1y"), (r"^(.+(?:ss|x|z|ch|sh))es$", "$1"), (r"^(.{2,}[^su])s$", "$1"), (r"^(.{3,})ment$", "$1"), (r"^(.{3,}[ts])ion$", "$1"), (r"^(.{3,})ing$", "$1"), (r"^(.{2,}[^e])ed$", "$1"), (r"^(.{3,})ers?$", "$1"), (r"^(.{2,}([^aeiouls]))\2$", "$1"), (r"^(.{3,})e$", "$1"))


def stem(term: Column) -> Column:
    """The stem of a lower-case word: caching and cache give cach, entries gives entry, running gives run."""
    for pattern, to in _RULES:
        term = F.regexp_replace(term, pattern, to)
    return term


def stem_of(word: str) -> str:
    """As stem, of one word of a query."""
    for pattern, to in _RULES:
        word = re.sub(pattern, to.replace("$", "\\"), word)
    return word


def query_words(text: str) -> list[list[str]]:
    """The stems of each part of a query between spaces; a compound such as getUserName or user_name is one part of several."""
    parts = []
    for part in text.split():
        low = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", part)).lower()
        words = [stem_of(w) for w in re.split("[^a-z0-9]+", low) if w]
        if words:
            parts.append(words)
    return parts


class TermIndex:
    """Tables: postings(stem, term, id, field, position, length, batch, bucket), symbols(id, kind, name, file_path, batch, gone)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, nodes: DataFrame, path: str | None = None) -> TermIndex:
        out = cls(nodes.sparkSession, path or f"{shared(nodes.sparkSession)}/terms-{uuid.uuid4().hex}")
        out._append(nodes, None, 0)
        return out

    def _append(self, nodes: DataFrame, removed: DataFrame | None, batch: int) -> None:
        rows = nodes.select("id", "kind", "name", F.coalesce("qualified_name", "name").alias("qualified_name"), "file_path")
        each = [rows.select("id", F.lit(f).alias("field"), words_of(F.col(f)).alias("words")) for f in WEIGHTS]
        words = each[0].unionByName(each[1]).withColumn("length", F.size("words"))
        spelled = words.select("id", "field", "length", F.posexplode("words").alias("position", "term"))
        posted = spelled.withColumn("stem", stem(F.col("term"))).withColumn("batch", F.lit(batch)).withColumn("bucket", F.pmod(F.xxhash64("stem"), F.lit(BUCKETS)).cast("int"))
        # a common stem fills several files of its bucket, by symbol
        dealt = posted.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "stem", "id").sortWithinPartitions("bucket", "stem", "id")
        dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        symbols = rows.select("id", "kind", "name", "file_path", F.lit(batch).alias("batch"), F.lit(False).alias("gone"))
        if removed is not None:
            none = [F.lit(None).cast("string").alias(c) for c in ("kind", "name", "file_path")]
            symbols = symbols.unionByName(removed.select("id", *none, F.lit(batch).alias("batch"), F.lit(True).alias("gone")).join(rows.select("id"), "id", "left_anti"))
        symbols.write.mode("append").parquet(f"{self.path}/symbols")

    def _posted(self) -> DataFrame:
        kind = self.spark.read.parquet(f"{self.path}/symbols").schema["id"].dataType.simpleString()
        return self.spark.read.schema(f"id {kind}, field string, length int, position int, term string, stem string, batch int, bucket int").parquet(f"{self.path}/postings")

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """New and changed nodes, and ids(id) that are gone, as a batch of their own; a symbol in both is there."""
        batch = self.spark.read.parquet(f"{self.path}/symbols").agg(F.max("batch")).first()[0]
        self._append(cut(changed), removed, (batch or 0) + 1)

    def symbols(self) -> DataFrame:
        """(id, kind, name, file_path, batch) as of the last batch."""
        latest = self.spark.read.parquet(f"{self.path}/symbols").groupBy("id").agg(F.max_by(F.struct("kind", "name", "file_path", "gone", "batch"), "batch").alias("s"))
        return latest.where("not s.gone").select("id", "s.kind", "s.name", "s.file_path", "s.batch")

    def postings(self, stems: list[str]) -> DataFrame:
        """(id, stem, field, position, length, file_path) of the stems in symbols as they are now."""
        buckets = [r.b for r in self.spark.createDataFrame([(s,) for s in stems], "s string").select(F.pmod(F.xxhash64("s"), F.lit(BUCKETS)).cast("int").alias("b")).collect()]
        rows = self._posted().where(F.col("bucket").isin(*buckets) & F.col("stem").isin(*stems))
        return rows.join(self.symbols().select("id", "batch", "file_path"), ["id", "batch"]).select("id", "stem", "field", "position", "length", "file_path")

    def matches(self, text: str) -> DataFrame:
        """(id, hits, phrases, together): how many of the query's stems a symbol holds, how many of its compounds word after word in one field, and how many stems meet in its file."""
        parts = query_words(text)
        stems = sorted({w for p in parts for w in p})
        if not stems:
            return self.symbols().select("id", F.lit(0).alias("hits"), F.lit(0).alias("phrases"), F.lit(0).alias("together")).limit(0)
        rows = cut(self.postings(stems))
        hits = rows.groupBy("id", "file_path").agg(F.countDistinct("stem").cast("int").alias("hits"))
        together = rows.groupBy("file_path").agg(F.countDistinct("stem").cast("int").alias("together"))
        out = hits.join(together, "file_path")
        found = None
        for k, words in enumerate({tuple(p) for p in parts if len(p) > 1}):
            # a phrase begins where each of its words stands as far on as in the query
            at = F.array(*[F.struct(F.lit(w).alias("stem"), F.lit(i).alias("after")) for i, w in enumerate(words)])
            begins = rows.withColumn("w", F.explode(at)).where("w.stem = stem").select("id", "field", (F.col("position") - F.col("w.after")).alias("at"), "w.after").distinct()
            own = begins.groupBy("id", "field", "at").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("id", F.lit(k).alias("phrase")).distinct()
            found = own if found is None else found.unionByName(own)
        if found is None:
            return out.select("id", "hits", F.lit(0).alias("phrases"), "together")
        phrases = found.groupBy("id").agg(F.count("*").cast("int").alias("phrases"))
        return out.join(phrases, "id", "left").select("id", "hits", F.coalesce("phrases", F.lit(0)).alias("phrases"), "together")

    def search(self, text: str) -> DataFrame:
        """(id, score): BM25 of the stems over both fields, more for compounds word after word, raised for each further stem that meets in the file."""
        stems = sorted({w for p in query_words(text) for w in p})
        found = self.matches(text)
        if not stems:
            return found.select("id", F.lit(0.0).alias("score"))
        n = self.symbols().count()
        rows = self.postings(stems).groupBy("id", "stem", "field", "length").agg(F.count("*").alias("tf"))
        lengths = self._posted().where("position = 0").join(self.symbols().select("id", "batch"), ["id", "batch"], "left_semi")
        mean = {r.field: r.words / max(n, 1) for r in lengths.groupBy("field").agg(F.sum("length").alias("words")).collect()}  # two fields
        df = rows.groupBy("field", "stem").agg(F.count("*").alias("df"))
        typical = F.coalesce(*[F.when(F.col("field") == f, F.lit(max(m, 1e-9))) for f, m in mean.items()], F.lit(1.0))
        weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in WEIGHTS.items()])
        idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / typical))
        scored = rows.join(F.broadcast(df), ["field", "stem"]).groupBy("id").agg(F.sum(part).alias("own"))  # a row a stem and field
        raised = (F.col("own") + PHRASE * F.col("phrases")) * (1 + TOGETHER * (F.col("together") - 1))
        return scored.join(found, "id").select("id", raised.alias("score"))
