"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once in a Python worker, and rows with whole texts that Spark sends to it at once.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 500
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the checkpoint folder of the session.

    A folder of our own is made only where the session names none and runs on
    this machine alone (tests, notebooks); on a cluster that is an error,
    since executors would write to disks that the others do not see.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found:
            if not (sc.master or "").startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="codeloom-ckpt-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def stash(df: DataFrame, compression: str = "zstd", batch_rows: int | None = None, broadcast: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read again; what is a stash already stays.

    Survives lost executors, since nothing depends on executor-local blocks.
    The folder goes when the JVM ends, or by `discard`. batch_rows bounds the
    rows sent to Python workers at once while it is written, broadcast the
    bytes of a table that a join may take through the driver (Spark knows a
    stash by its compressed files, which are many times smaller than what the
    driver builds of them); the session's own values are put back.
    """
    if getattr(df, "_stashed_at", None):
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (_ARROW_ROWS, _BROADCAST)}
    try:
        if batch_rows:
            spark.conf.set(_ARROW_ROWS, str(batch_rows))
        if broadcast is not None:
            own = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
            spark.conf.set(_BROADCAST, str(min(own, broadcast)))
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    fs, hadoop = _path(spark, path)
    fs.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete stashes that no later plan reads: rounds of a loop that newer ones replace."""
    for df in stashed:
        path = getattr(df, "_stashed_at", None)
        if path:
            fs, hadoop = _path(df.sparkSession, path)
            fs.delete(hadoop, True)


def fixed(docs: DataFrame) -> DataFrame:
    """docs where it is a plain scan of files, else a stash of it: its rows keep their partitions and order each time it is read, as row numbers need."""
    plan = docs._jdf.queryExecution().analyzed()
    kinds = {"Project", "SubqueryAlias", "LogicalRelation"}
    names = plan.toString().splitlines()
    tops = [x.lstrip(" :+-").split(" ", 1)[0].split("[", 1)[0] for x in names if x.strip()]
    tops = ["LogicalRelation" if t == "Relation" else t for t in tops]
    return docs if "LogicalRelation" in tops and set(tops) <= kinds and "monotonically" not in plan.toString() else stash(docs)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bytes(batches: Batches, column: int = 0, most: int = BATCH_BYTES) -> Batches:
    """The batches cut so that the texts of a column have about `most` bytes together, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield b.slice(lo, hi - lo)


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freeing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, after which the worker, which Spark keeps for later tasks, gives what it took back to the system."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, the shorter ones padded with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    heads = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(heads, sizes)] = values
    return out


def met(batches: Batches, build: Callable[[list[pa.RecordBatch]], object], meet: Callable[..., pa.RecordBatch], most: int) -> Batches:
    """meet(block, queries) for each block and `most` queries at a time; rows come by block (rb), a block's own rows (kind 0), of which it is built, before the queries (kind 1)."""
    held: list[pa.RecordBatch] = []
    now, block = None, None
    for batch in batches:
        place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("rb", "kind")])
        cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            rb, kind = (int(v) for v in place[:, lo])
            if rb != now:
                now, held, block = rb, [], None
            if kind == 0:
                held.append(batch.slice(lo, hi - lo))
                continue
            if block is None:
                if not held:
                    continue  # a block without rows
                block, held = build(held), []
            for at in range(lo, hi, most):
                yield meet(block, batch.slice(at, min(most, hi - at)))
