"""Operator 11, contiguous shards of equal bytes.

Documents are put in one global order and dealt to range partitions. Each
partition's bytes and rows are totalled; running sums of the totals, one row a
partition, say where a partition begins in the whole; the sums inside it do
the rest. The line of all bytes is cut at equal targets, and a document goes
where its middle lies, so shards are contiguous in the order and a shard's
bytes differ from the target by less than the size of a document at each end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import fixed, partitions, stash

#: Bytes that a document takes beside its text.
OVERHEAD = 16
#: Shards up to which their first places, one row each, are broadcast.
MOST_BROADCAST = 100_000


def text_size(text: str, overhead: int = OVERHEAD) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def ordered(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, size, text_crc32 and the columns to carry, in range partitions (`part`) of the global order, with `at`, which ascends in it.

    The order is by doc_id, null ids last, then by the text's CRC and hash, so
    that it depends on the rows alone. Rows alike in all of these are one and
    the same; the number of the row as it was read parts them, so that a range
    may end anywhere in a group of any size.
    """
    text = F.coalesce("text", F.lit(""))
    keys = [F.col("doc_id").isNull().alias("lost"), F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("row")]
    kept = [F.struct(*(F.col(c) for c in carry)).alias("carried")] if carry else []
    rows = fixed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_size("text").alias("size"), F.crc32(text).alias("text_crc32"), *keys, *kept)
    order = ("lost", "doc_id", "text_crc32", "mark", "row")
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    kept = ["carried"] if carry else []
    # ranges come from a sample, so what they gave is written before it is read twice
    return stash(dealt.select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), *kept))


def assign(docs: DataFrame, shards: int = 40, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: a shard more would move the cuts), and `carried`, a struct of columns, if any are named.

    Size is the text's UTF-8 bytes plus OVERHEAD, so no document is without
    weight; a null text has no bytes and the CRC of an empty one. shard is
    floor(shards * middle / all bytes), slot counts a shard's documents from 0
    without a gap. Repeated rows and ids are kept, each in its own slot;
    columns that are not named are not read, and names may clash with those
    returned. A document larger than a target may leave shards beside it
    empty; an empty table gives no rows. All numbers are exact up to 2**62
    bytes times shards. The totals in one window have one row a partition.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    rows = ordered(docs, *carry)
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), zero).alias("from"), F.coalesce(F.sum("n").over(before), zero).alias("first"), F.sum("bytes").over(every).alias("all"))
    inside = Window.partitionBy("part").orderBy("at")
    own = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.row_number().over(inside) - 1)
    placed = own.join(starts, "part").withColumn("place", F.col("first") + F.col("n"))
    # twice the middle over twice all bytes, in whole numbers
    placed = placed.withColumn("shard", F.expr(f"cast(least({shards - 1}, ({shards}L * (2 * (`from` + upto) - size)) div (2 * `all`)) as int)"))
    heads = placed.groupBy("shard").agg(F.min("place").alias("head"))
    heads = F.broadcast(heads) if shards <= MOST_BROADCAST else heads
    out = placed.join(heads, "shard")
    kept = ["carried"] if carry else []
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("head")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *kept)


def write(docs: DataFrame, path: str, shards: int = 40) -> None:
    """The documents with their columns as Parquet under path/shard=N, a shard in one or more files whose names ascend with its slots.

    Ranges of (shard, slot) are written, so no task holds a shard. A column
    named shard is written as it is inside the struct `document`.
    """
    rows = assign(docs, shards, carry=tuple(docs.columns)).select("shard", "slot", F.col("carried").alias("document"))
    rows.repartitionByRange(max(shards, partitions(docs.sparkSession)), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
