"""The stateful stream of pending paths against the batch form, whatever the order in which rows come."""

import datetime as dt
import random
import time

from codeloom.streaming import pending, watch

CHANGE, SYNC = "path string, ts timestamp", "start timestamp, ended timestamp, ok boolean"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_the_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(5)
    changes = [(f"p{rng.randrange(25)}", at(rng.randrange(1000))) for _ in range(160)]
    syncs = [(at(200), at(220), True), (at(500), at(530), True), (at(700), at(720), False), (at(900), None, None)]
    # a sync is told when it starts and when it ends; all of it comes in any order, some twice
    rows = [("c", *c) for c in changes + changes[:40]] + [("s", *s) for s in syncs] + [("s", s, None, None) for s, e, _ in syncs if e]
    rng.shuffle(rows)
    for k in range(4):
        part = rows[k::4]
        spark.createDataFrame([r[1:] for r in part if r[0] == "c"], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        spark.createDataFrame([r[1:] for r in part if r[0] == "s"], SYNC).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    told = pending.pending_stream(read(CHANGE, "c"), read(SYNC, "s"), quiet_ms=1, buckets=3)

    show = lambda df: sorted(tuple(r) for r in df.select("path", "first_seen", "last_seen", "indexing").collect())
    out = lambda: spark.read.schema(told.schema).parquet(str(tmp_path / "out"))

    def keep(df, _):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "out"))

    def run(done):
        """Batches with timers go on for ever, so the stream is stopped once it is where it should be, or after two minutes."""
        q = told.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="100 milliseconds").start()
        end = time.time() + 120
        try:
            while time.time() < end and not q.exception():
                time.sleep(1)
                if (tmp_path / "out").exists() and done():
                    return True
        finally:
            q.stop()
        return False

    batch = watch.pending(spark.createDataFrame(changes, CHANGE), spark.createDataFrame(syncs, SYNC))
    assert show(batch) and run(lambda: show(pending.latest(out())) == show(batch))
    # more comes after a restart: the sync ends, one path changes again; quiet paths are told by their timers
    spark.createDataFrame([("p1", at(2000)), ("new", at(10))], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    spark.createDataFrame([(at(900), at(950), True)], SYNC).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    changes += [("p1", at(2000)), ("new", at(10))]
    syncs[-1] = (at(900), at(950), True)
    batch = watch.pending(spark.createDataFrame(changes, CHANGE), spark.createDataFrame(syncs, SYNC))
    assert "new" not in [r[0] for r in show(batch)]
    assert run(lambda: show(pending.latest(out())) == show(batch) and out().where("state = 'ready' and path = 'p1'").count() > 0)
