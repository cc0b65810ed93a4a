"""Operator 1, mixing sources to target weights, in DataFrame functions only.

Each source's documents in a row are one stream of words, packed into blocks
of a fixed length. A source's target is its weighted share, capped at a
multiple of its size. The mix is a list of slots: a source gets as many as its
target holds blocks, and all slots are dealt to output shards of equal size by
a pseudorandom permutation, so that the source counts of a shard are drawn as
a multinomial would be, given that all shards together meet the targets. A
source's i-th slot takes, on pass i // blocks, the block that the source's own
permutation has at i % blocks; slots and blocks are joined by that index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import fixed, stash

#: A word is a run of other characters than these white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS, SHARD_SLOTS = 64, 4096
#: Rounds of the permutations; any number gives a bijection.
ROUNDS = 16
SEED = 20240229


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x among n under a pseudorandom permutation of 0..n-1 chosen by key: a swap-or-not shuffle.

    Each round pairs x with (k - x) mod n and swaps by a bit that depends on
    the pair, so every round, and all of them, is a bijection.
    """
    n = F.greatest(n, F.lit(1)).cast("long")

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), n) - at, n)
        return F.when(F.xxhash64(F.greatest(at, other), r, *key, F.lit("side")).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: the words of the whole text (null: 0)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """df with the row's number from 0 in an order: rows are sorted by ranges, and only the ranges' counts meet in one task."""
    at = F.monotonically_increasing_id()
    d = stash(df.orderBy(order).withColumn("__at", at))
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return d.withColumn("__part", part).join(counts, "__part").withColumn(name, (F.col("__base") + inside).cast("long")).drop("__at", "__part", "__n", "__base")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Per source: source, no, source_size, target.

    Sources by code point, null last, take the weights in turn. The total of
    all sizes is shared by weight; a share above `most` times the source's
    size stops there and what is over is shared again by weight, until none is
    above. One row a source; each round is one aggregate over them.
    """
    own = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), F.asc_nulls_last("source"), "no")
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("no", F.lit(len(weights))) + 1).cast("int"))
    per = stash(own.withColumn("weight", share))
    cap = F.col("source_size").cast("double") * most
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    unit = 0.0  # words a unit of weight gets
    while True:
        # a capped source stays capped: the unit only grows
        full = F.col("weight") * unit >= cap if unit else F.lit(False)
        r = per.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        new = (total - r.capped) / r.open if r.open else unit
        if not r.open or new <= unit:
            break
        unit = new
    return per.select("source", "no", "source_size", F.least(F.col("weight") * F.lit(unit), cap).alias("target"))


@dataclass
class Mix:
    """placed: doc_id, source, size, key, no, source_size, target, start (words of its source before it), one row a document;
    slots: shard, slot, source no, pass, block: the mix itself, one row a block taken;
    covered: key, pass, lo, hi, shard: words of a document that a slot takes, and the slot's shard."""

    placed: DataFrame
    slots: DataFrame
    covered: DataFrame


def _placed(sized: DataFrame, per: DataFrame, bucket_rows: int) -> DataFrame:
    """Each document's start in its source's stream.

    The running sum has two levels: documents are dealt by hash into buckets
    of about `bucket_rows`, sums of buckets run first and then documents
    within theirs, so a source that holds a third of all rows is no one task.
    """
    buckets = max(1, -(-sized.count() // bucket_rows))
    d = sized.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    whole = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    whole = whole.join(F.broadcast(per) if per.count() <= 10_000 else per, whole.source.eqNullSafe(per.source)).drop(per.source)
    inside = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    a, b = d.alias("a"), whole.alias("b")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket")))
    return joined.select("a.doc_id", "a.source", "a.size", "a.key", "b.no", "b.source_size", "b.target", (F.col("b.base") + F.col("a.inside")).alias("start"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, bucket_rows: int = 2000) -> Mix:
    """The mix of all documents (doc_id, text, source; other columns are not read).

    Null texts have no words; a null source is a source; repeated ids and
    rows are documents of their own (a document's key is a hash of its id and
    row number among its likes). An empty table gives an empty mix. A source
    takes whole passes over its words and then round(rest / block) blocks of
    a last, partial one, so it misses its target by a block at most, and no
    document is taken more than `most` times.
    """
    raw = sizes(docs).withColumn("like", F.monotonically_increasing_id())
    keyed = stash(raw)
    # equal ids are told apart by their order in the input; distinct ids alone give the key otherwise
    again = keyed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    marks = keyed.join(again, keyed.doc_id.eqNullSafe(again.doc_id), "left_semi").select("like", F.lit(1).alias("twice"))
    keyed = keyed.join(marks, "like", "left")
    sized = stash(keyed.select("doc_id", "source", "size", F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("twice") == 1, F.col("like"))).alias("key")))
    per = stash(targets(sized, weights, most))
    placed = stash(_placed(sized, per, bucket_rows))

    blocks = F.ceil(F.col("source_size") / block).cast("long")
    passes = F.floor(F.col("target") / F.col("source_size") + 1e-12).cast("long")
    rest = F.least(F.round((F.col("target") - passes * F.col("source_size")) / block).cast("long"), blocks)
    quota = per.where("source_size > 0").withColumn("blocks", blocks).withColumn("taken", passes * blocks + F.greatest(rest, F.lit(0)))
    # sums run over groups of sources, then within them
    quota = quota.select("no", "blocks", "taken", F.floor(F.col("no") / 4096).alias("part"))
    before = quota.groupBy("part").agg(F.sum("taken").alias("all")).withColumn("base", F.sum("all").over(Window.orderBy("part")) - F.col("all")).drop("all")
    last = F.col("base") + F.sum("taken").over(Window.partitionBy("part").orderBy("no"))
    quota = stash(quota.join(before, "part").withColumn("last", last).withColumn("first", F.col("last") - F.col("taken")).select("no", "blocks", "taken", "first", "last"))
    found = quota.agg(F.max("last").alias("last"), F.count("*").alias("n")).first()
    total = found.last or 0
    spark = docs.sparkSession
    # slots find their source through a grid of the slot numbers: an equality join with a few sources a cell
    cell = max(1, -(-total // max(4096, found.n)))
    grid = quota.where("taken > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("last") - 1) / cell))))
    g = spark.range(total).withColumnRenamed("id", "g").withColumn("cell", F.floor(F.col("g") / cell))
    found = g.join(grid, "cell").where((F.col("g") >= F.col("first")) & (F.col("g") < F.col("last")))
    i, n = F.col("g") - F.col("first"), F.col("blocks")
    turn = F.floor(i / n).cast("long")
    at = permuted(F.col("g"), F.lit(total), F.lit(seed))
    slots = found.select(
        F.floor(at / shard_slots).cast("long").alias("shard"),
        F.pmod(at, F.lit(shard_slots)).cast("int").alias("slot"),
        "no",
        turn.alias("pass"),
        permuted(F.pmod(i, n), n, F.lit(seed), F.col("no"), turn).alias("block"),
    )
    spans = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    covered = spans.select("key", "no", "block", lo.alias("lo"), hi.alias("hi")).join(slots.select("no", "pass", "block", "shard"), ["no", "block"]).select("key", "pass", "lo", "hi", "shard")
    return Mix(placed, slots, covered)


def taken(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (its words in the mix, repeats counted), shards (the output shards that hold some of them, in order)."""
    m = mix(docs, **how)
    got = m.covered.groupBy("key").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    out = m.placed.join(got, "key", "left")
    none = F.array().cast("array<long>")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def shard_counts(docs: DataFrame, **how) -> DataFrame:
    """The draw: shard, source, and how many of the shard's slots (blocks) come from that source."""
    m = mix(docs, **how)
    names = m.placed.select("no", "source").distinct()
    return m.slots.groupBy("shard", "no").agg(F.count("*").alias("slots")).join(names, "no").select("shard", "source", "slots")


def mixed_documents(docs: DataFrame, shards: bool = False, **how) -> DataFrame:
    """The mix as documents with the input's columns: each pass over a document gives a row of what it takes.

    A row that takes all words keeps the text as it is; one that takes some
    has those words, in order, joined by blanks. Documents without words are
    in no block and go. n_chars, where there is such a column, is counted
    anew. With `shards` a pass gives a row for each output shard that holds
    some of its blocks, and the shard's number is a last column `shard`.
    docs is written first where it is no plain scan of files, since its rows
    are numbered twice.
    """
    docs = fixed(docs)
    m = mix(docs, **how)
    # the input's columns stay in a struct, so none of their names can clash with ours
    marked = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs["doc_id"], F.monotonically_increasing_id().alias("like"))
    twice = marked.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    seed = F.lit(how.get("seed", SEED))
    again = marked.select("doc_id", "like").join(twice, marked.doc_id.eqNullSafe(twice.doc_id), "left_semi").select(F.col("like"), F.lit(1).alias("twice"))
    whole = marked.join(again, "like", "left").withColumn("key", F.xxhash64(seed, "doc_id", F.when(F.col("twice") == 1, F.col("like")))).select("doc", "key")
    shard = F.col("shard") if shards else F.lit(None).cast("long")
    runs = m.covered.groupBy("key", "pass", shard.alias("shard")).agg(F.sum(F.col("hi") - F.col("lo")).alias("words"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    some = F.when(F.col("words") < F.col("size"), F.col("runs")).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    per_doc = runs.join(m.placed.select("key", "size"), "key").groupBy("key").agg(F.collect_list(F.struct(some.alias("runs"), "shard")).alias("passes"))
    out = whole.join(per_doc, "key").select("doc", F.explode("passes").alias("p")).select("doc", "p.runs", "p.shard")
    words = F.regexp_extract_all("doc.text", F.lit(f"({WORD})"))
    part = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), " ")
    out = out.select("doc", "shard", F.when(F.size("runs") == 0, F.col("doc.text")).otherwise(part).alias("text"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[own.get(c, F.col("doc")[c]).alias(c) for c in docs.columns], *(["shard"] if shards else []))
