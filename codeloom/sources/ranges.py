"""An index of numeric metadata by value: (field, value, id), a folder a field, files by ranges of values, rows sorted in them.

A look-up of lo..hi reads the field's folder alone, of it the files whose
range meets lo..hi, which the index's own table tells, and of these the row
groups that Parquet's statistics leave.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, NumericType

from codeloom.plans.cut import shared

#: Values of a file, about.
VALUES_A_FILE = 1 << 22


def unpivot(nodes: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, value, id): a row for each numeric column of nodes(id, ...) and each entry of its metadata that is a number; nulls, NaN and other texts are left out."""
    columns = [f.name for f in nodes.schema if isinstance(f.dataType, NumericType) and f.name != "id"]
    entries = [F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])] if columns else []
    if any(f.name == "metadata" and isinstance(f.dataType, MapType) for f in nodes.schema):
        entries.append(F.transform_values(F.map_filter("metadata", lambda k, v: ~k.isin(*columns) if columns else F.lit(True)), lambda _, v: v.try_cast("double")))
    if not entries:
        return nodes.select(F.lit("").alias("field"), F.lit(0.0).alias("value"), "id").limit(0)
    rows = nodes.select("id", F.explode(F.map_concat(*entries)).alias("field", "value"))
    rows = rows.where("value is not null and not isnan(value)")
    return (rows.where(F.col("field").isin(*fields)) if fields else rows).select("field", "value", "id")


class RangeIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, nodes: DataFrame, fields: list[str] | None = None, path: str | None = None, files: int | None = None) -> RangeIndex:
        """Written with its table of files last, so an index that broke off cannot be read. A field with more rows than a file holds has several files, one whose value repeats too."""
        spark = nodes.sparkSession
        path = path or f"{shared(spark)}/ranges-{uuid.uuid4().hex}"
        rows = unpivot(nodes, fields)
        n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // VALUES_A_FILE))
        kind = rows.schema["id"].dataType.simpleString()
        rows.repartitionByRange(n, "field", "value", "id").sortWithinPartitions("field", "value", "id").write.partitionBy("field").parquet(f"{path}/values")
        spark.createDataFrame([(kind,)], "value string").coalesce(1).write.text(f"{path}/kind")
        known = spark.read.schema(f"value double, id {kind}, field string").parquet(f"{path}/values")
        name = F.regexp_extract(F.input_file_name(), r"/values/(.*)$", 1)
        known.groupBy("field", name.alias("file")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")).write.parquet(f"{path}/files")
        return cls(spark, path)

    def files(self) -> DataFrame:
        """(field, file, low, high, n)"""
        return self.spark.read.parquet(f"{self.path}/files")

    def between(self, field: str, low: float | None = None, high: float | None = None) -> DataFrame:
        """(id, value) of the nodes whose field is from low to high, both included; an end that is not given is open."""
        meets = F.col("field") == field
        inside = F.lit(True)
        if low is not None:
            meets, inside = meets & (F.col("high") >= low), inside & (F.col("value") >= float(low))
        if high is not None:
            meets, inside = meets & (F.col("low") <= high), inside & (F.col("value") <= float(high))
        found = [f"{self.path}/values/{r.file}" for r in self.files().where(meets).select("file").collect()]  # names of files
        kind = self.spark.read.text(f"{self.path}/kind").first().value
        if not found:
            return self.spark.createDataFrame([], f"id {kind}, value double")
        return self.spark.read.schema(f"value double, id {kind}").parquet(*found).where(inside).select("id", "value")
