"""Lineage cuts for iterative plans: Parquet in the session's shared checkpoint folder, which outlives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(df: DataFrame, path: str):
    sc = df.sparkSession.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(sc._jsc.hadoopConfiguration()), hadoop


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Without a checkpoint folder only a session on this machine alone gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codeloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = f"{shared(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, hadoop = _path(df, path)
    fs.deleteOnExit(hadoop)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """As cut, in buckets of a key, sorted in them: a join by the key reads them where they lie and exchanges the other side only."""
    spark = df.sparkSession
    name, path = f"cut_{uuid.uuid4().hex}", f"{shared(spark)}/cut-{uuid.uuid4().hex}"
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    fs, hadoop = _path(df, path)
    fs.deleteOnExit(hadoop)
    out = spark.table(name)
    out._cut_at, out._table = path, name
    return out


def drop(*cuts: DataFrame) -> None:
    """Delete cuts that no later plan reads."""
    for df in cuts:
        path = getattr(df, "_cut_at", None)
        if getattr(df, "_table", None):
            df.sparkSession.sql(f"drop table if exists {df._table}")
        if path:
            fs, hadoop = _path(df, path)
            fs.delete(hadoop, True)
