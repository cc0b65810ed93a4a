"""Pending paths as a stateful stream: changes and syncs in any order, nothing dropped for being late, a path told once it has been quiet.

Paths are dealt to buckets, the keys of the state, and every bucket hears of
every sync. A bucket keeps the times of each path's changes that no sync has
taken in, and one timer, for the path that is due next.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "bucket int, seq long, path string, first_seen long, last_seen long, indexing boolean, state string"


class _Pending(StatefulProcessor):
    """Rows told: `pending` when what is known of a path changes, `taken` when a sync has all of it, `ready` when it has been quiet."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "times array<long>, due long")
        self.clock = handle.getValueState("clock", "done long, open array<long>, ended array<long>, seq long")

    def _row(self, key: tuple, seq: int, path: str, times: list[int], running: int, state: str) -> tuple:
        first, last = (times[0], times[-1]) if times else (None, None)
        return (int(key[0]), seq, path, first, last, bool(times) and last <= running, state)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        kinds = {"bucket": "int32", "seq": "int64", "first_seen": "Int64", "last_seen": "Int64", "indexing": "bool"}
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")]).astype(kinds)

    def _timer(self) -> None:
        """One timer, at the time of the path that is due next."""
        due = [v[1] for _, v in self.paths.iterator() if v[1] > 0]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due:
            self.handle.registerTimer(min(due))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, open_, ended, seq = self.clock.get() if self.clock.exists() else (-(1 << 62), [], [], 0)
        open_, ended = set(open_), set(ended)
        before = max(open_ - ended, default=-(1 << 62)), done
        now = timerValues.getCurrentProcessingTimeInMs()
        touched: dict[str, set[int]] = {}
        for f in rows:
            for path, at, start, over, ok in zip(*(f[c].tolist() for c in ("path", "at", "start", "over", "ok")), strict=True):
                if start and start != "":
                    (ended if over == "1" else open_).add(int(start))
                    if over == "1" and ok == "1":
                        done = max(done, int(start))
                else:
                    touched.setdefault(path, set()).add(int(at))
        open_, ended = {s for s in open_ if s > done}, {s for s in ended if s > done}
        running = max(open_ - ended, default=-(1 << 62))
        out = []
        if (running, done) != before:  # a sync concerns all paths of the bucket
            known = [(k[0], v) for k, v in self.paths.iterator()]
        else:
            known = [(p, self.paths.getValue((p,))) for p in touched if self.paths.containsKey((p,))]
        held = {p: (list(v[0]), v[1]) for p, v in known}
        for path in sorted({*held, *touched}):
            times, due = held.get(path, ([], 0))
            new = sorted({*times, *touched.get(path, ())} - {t for t in {*times, *touched.get(path, ())} if t <= done})
            if not new:
                if path in held:
                    self.paths.removeKey((path,))
                    seq += 1
                    out.append(self._row(key, seq, path, [], running, "taken"))
                continue
            if path in touched:
                due = now + self.quiet_ms
            self.paths.updateValue((path,), (new, due))
            seq += 1
            out.append(self._row(key, seq, path, new, running, "pending"))
        self.clock.update((done, sorted(open_), sorted(ended), seq))
        self._timer()
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, open_, ended, seq = self.clock.get()
        now = max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        running, out = max(set(open_) - set(ended), default=-(1 << 62)), []
        for path, (times, due) in sorted((k[0], (list(v[0]), v[1])) for k, v in self.paths.iterator() if 0 < v[1] <= now):
            self.paths.updateValue((path,), (times, 0))
            seq += 1
            out.append(self._row(key, seq, path, times, running, "ready"))
        self.clock.update((done, open_, ended, seq))
        self._timer()
        yield self._frame(out)

    def close(self) -> None:
        pass


def pending_stream(changes: DataFrame, syncs: DataFrame, quiet_ms: int = 2000, buckets: int = 64) -> DataFrame:
    """(bucket, seq, path, first_seen, last_seen, indexing, state) of the streams changes(path, ts) and syncs(start, ended, ok).

    The last row of a path by seq, where its state is not `taken`, is what
    watch.pending gives of all that has come: changes after the start of the
    last sync that ended well. A sync comes when it starts (ended null) and
    when it has ended; rows may come late, twice and in any order. `ready`
    says that a path had no change for quiet_ms of the clock. Needs the
    RocksDB state store, which is set for the session.
    """
    spark = changes.sparkSession
    spark.conf.set(_PROVIDER, _ROCKS)
    no = F.lit("")
    text = lambda c: F.coalesce(F.unix_micros(c).cast("string"), no)  # noqa: E731  numbers as text: a null beside them would make floats of them
    flag = lambda c: F.when(c, "1").otherwise("0")
    a = changes.select(F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket"), "path", text("ts").alias("at"), no.alias("start"), no.alias("over"), no.alias("ok"))
    b = syncs.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), no.alias("path"), no.alias("at"), text("start").alias("start"), flag(F.col("ended").isNotNull()).alias("over"), flag(F.coalesce("ok", F.lit(False))).alias("ok"))
    told = a.where("at <> '' and path is not null").unionByName(b.where("start <> ''")).groupBy("bucket").transformWithStateInPandas(_Pending(quiet_ms), _OUT, "Update", "ProcessingTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen")})


def latest(told: DataFrame) -> DataFrame:
    """(path, first_seen, last_seen, indexing) of rows that pending_stream told, as they were kept in a table."""
    last = told.groupBy("path").agg(F.max_by(F.struct("first_seen", "last_seen", "indexing", "state"), "seq").alias("l"))
    return last.where("l.state <> 'taken'").select("path", "l.first_seen", "l.last_seen", "l.indexing")
