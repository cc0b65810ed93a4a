"""Operator 12, hard negatives by an orthogonal rotation and bounds.

The quantised vectors are rotated onto the eigenvectors of their second
moments, so that the leading components hold most of every inner product. For
an anchor and a row the products of the leading components are summed, stage
by stage; what is left lies within the product of the norms of the two
remainders, by Cauchy and Schwarz, and some slack for rounding. A pair that
this rules out goes early; one that stays to the end is scored with whole
numbers, so the results are exact whatever the rotation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Batches, freeing, matrix, met, partitions, stash
from codeloom.llm.topk import quantise

#: Numbers (rows times components) of a block of rows, of which a task holds one; anchors met at once; pairs verified at once.
BLOCK_NUMBERS, ANCHORS, PAIRS = 1 << 20, 256, 1 << 14
#: Rows met at once: few at first, so that the first scores make bounds, then more.
FIRST_TILE, LAST_TILE = 64, 2048
#: A table is dealt to all tasks only while blocks have this many rows.
FEW_ROWS = 1024


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, exact; an error where one does not fit 64 bits."""
    if not a.size:
        return np.zeros(len(a), dtype=np.int64)
    top = a.shape[1] * max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max())))
    if top < 1 << 63:
        return np.einsum("ij,ij->i", a, b)
    out = (a.astype(object) * b.astype(object)).sum(axis=1)
    for x in out:
        if not -(1 << 63) <= x < 1 << 63:
            raise OverflowError(f"the score {x} does not fit 64 bits")
    return out.astype(np.int64)


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors, as columns, of the second moments of all vectors, those with most weight first; width * width sums come to the driver."""

    def moments(batches: Batches) -> Batches:
        total = np.zeros((width, width))
        for b in batches:
            x = matrix(b.column(0), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

    if not width:
        return np.zeros((0, 0))
    sums = rows.select("v").mapInArrow(freeing(moments), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    whole = np.zeros(width * width)
    for r in sums.toLocalIterator():
        whole[r.cell] = r.value
    return np.linalg.eigh(whole.reshape(width, width) / max(1.0, np.abs(whole).max()))[1][:, ::-1].copy()


class Vectors:
    """Vectors in whole numbers, rotated, with the norms of what each stage leaves."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        self.x, self.y = x, x.astype(np.float64) @ turn
        d = x.shape[1]
        self.stages = sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2), d}) if d else [0]
        square = np.concatenate((np.cumsum(self.y[:, ::-1] ** 2, axis=1)[:, ::-1], np.zeros((len(x), 1))), axis=1)
        self.norm = np.sqrt(square[:, 0])
        self.left = {s: np.sqrt(square[:, s]) for s in self.stages}


def bounded(a: Vectors, rows: Vectors, i: np.ndarray, j: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of anchors i and rows j those that keep(anchors, least score, greatest score) lets stay at every stage, with their exact scores."""
    d = a.x.shape[1]
    slack = lambda p, q: 8.0 * (d + 1) ** 2 * np.finfo(np.float64).eps * a.norm[p] * rows.norm[q]
    s = a.stages[0]
    part = a.y[i, :s] @ rows.y[j, :s].T
    spread = np.outer(a.left[s][i], rows.left[s][j]) + slack(i[:, None], j[None])
    at = np.nonzero(keep(i[:, None], part - spread, part + spread))
    p, q, part = i[at[0]], j[at[1]], part[at]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(p), PAIRS):
        pp, qq, sums, s = p[lo : lo + PAIRS], q[lo : lo + PAIRS], part[lo : lo + PAIRS], a.stages[0]
        for t in a.stages[1:]:
            sums = sums + np.einsum("ij,ij->i", a.y[pp, s:t], rows.y[qq, s:t])
            spread = a.left[t][pp] * rows.left[t][qq] + slack(pp, qq)
            stay = keep(pp, sums - spread, sums + spread)
            pp, qq, sums, s = pp[stay], qq[stay], sums[stay], t
        out.append((pp, qq, products(a.x[pp], rows.x[qq])))
    if not out:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


class Best:
    """The k best (score, then smaller id) of each of some groups, as rows come."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.bound = np.full(groups, -np.inf)
        self.held = (np.empty(0, dtype=np.int64),) * 3  # group, score, row

    def add(self, group: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        g, s, r = (np.concatenate(x) for x in zip(self.held, (group, score, row), strict=True))
        o = np.lexsort((r, ids[r], ~s, g))
        g, s, r = g[o], s[o], r[o]
        first = np.searchsorted(g, g, side="left")
        place = np.arange(len(g)) - first
        full = place == self.k - 1
        self.bound[g[full]] = s[full]
        top = place < self.k
        self.held = g[top], s[top], r[top]


def _tiles(n: int) -> Iterator[tuple[int, int]]:
    lo, size = 0, FIRST_TILE
    while lo < n:
        yield lo, min(n, lo + size)
        lo, size = lo + size, min(LAST_TILE, 2 * size)


class Block:
    """A block of rows, the longest vectors of each label first."""

    def __init__(self, parts: list[pa.RecordBatch], turn: np.ndarray):
        get = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]).astype(np.int64)
        row, ids, label = get("row"), get("vec_id"), get("label")
        x = np.concatenate([matrix(b.column("v"), len(turn)) for b in parts])
        o = np.lexsort((ids, -(x.astype(np.float64) ** 2).sum(axis=1), label))
        self.row, self.ids, self.label = row[o], ids[o], label[o]
        self.vectors = Vectors(x[o], turn)
        self.by_norm = np.argsort(-self.vectors.norm, kind="stable")

    def alike(self, anchors: pa.RecordBatch, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best rows of each anchor's label but itself: anchor, score, row."""
        a, label, own = Vectors(matrix(anchors.column("v"), len(turn)), turn), anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
        best = Best(len(label), k)
        for one in np.unique(label):
            i = np.flatnonzero(label == one)
            lo, hi = np.searchsorted(self.label, [one, one + 1])
            for x, y in _tiles(int(hi - lo)):
                p, q, score = bounded(a, self.vectors, i, np.arange(lo + x, lo + y), lambda p, low, high: high >= best.bound[p])
                other = self.row[q] != own[p]
                best.add(p[other], score[other], q[other], self.ids)
        return best.held

    def unlike(self, anchors: pa.RecordBatch, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The k best rows of other labels for each anchor and each of its ranges of scores: anchor * width + range, score, row; and width."""
        a, label = Vectors(matrix(anchors.column("v"), len(turn)), turn), anchors.column("label").to_numpy()
        low, high = (anchors.column(c) for c in ("low", "high"))
        width = max([1, *map(len, low.to_pylist())])
        least = np.full((len(label), width), 1, dtype=np.int64)
        most = np.zeros((len(label), width), dtype=np.int64)  # an empty range where an anchor has fewer
        for i, (lo, hi) in enumerate(zip(low.to_pylist(), high.to_pylist(), strict=True)):
            least[i, : len(lo)], most[i, : len(hi)] = lo, hi
        best = Best(len(label) * width, k)
        empty = least > most

        def keep(p: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
            floor = np.where(empty, np.inf, np.maximum(least, best.bound.reshape(-1, width)))
            stay = (highest >= floor.min(axis=1)[p]) & (lowest <= most.max(axis=1)[p])
            at = np.nonzero(stay)
            anchor = np.broadcast_to(p, stay.shape)[at]
            fits = ((highest[at][:, None] >= floor[anchor]) & (lowest[at][:, None] <= most[anchor])).any(axis=1)
            stay[at] = fits
            return stay

        every = np.arange(len(label))
        for x, y in _tiles(len(self.row)):
            p, q, score = bounded(a, self.vectors, every, self.by_norm[x:y], keep)
            other = self.label[q] != label[p]
            p, q, score = p[other], q[other], score[other]
            at, r = np.nonzero((score[:, None] >= least[p]) & (score[:, None] <= most[p]))
            best.add(p[at] * width + r, score[at], q[at], self.ids)
        return *best.held, width


def _out(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)


def negatives(embeddings: DataFrame, every: int = 100, scale: int = 256, positives: int = 5, k: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and each of its positives the k hardest negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`; scores are
    inner products of floor(scale * component). An anchor's positives are the
    best rows of its label but itself, its negatives for one the best rows of
    other labels whose score is from low to high per cent of the positive's
    (so none, if that is below 0); ties go to the smaller vec_id; fewer rows
    if there are fewer. Rows without an id or label, and vectors null or with
    null or non-finite components take no part; a shorter vector counts as
    padded with zeros, an empty one has only scores of 0. Rows that repeat an
    id are rows, and anchors, of their own. A component of topk.BOUND / scale
    or more, or a verified score beyond 64 bits, is an error. Other columns
    are not read; an empty table gives no rows.

    Rows are dealt to blocks of about BLOCK_NUMBERS numbers, by a hash of the
    row, so that no label or copy fills one; a task holds a block and streams
    all anchors past it, of which only the best few a block come out. The
    rotation, width * width numbers, goes to each task.
    """
    spark = embeddings.sparkSession
    sound = quantise(embeddings.where(F.col("label").isNotNull()).select("vec_id", "embedding", F.col("label").cast("long").alias("label")), scale, "label")
    rows = stash(sound.withColumn("row", F.monotonically_increasing_id()))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 0
    turn = rotation(rows, width)
    blocks = max(1, -(-n * max(width, 1) // BLOCK_NUMBERS), min(partitions(spark), n // FEW_ROWS))
    nothing = F.array().cast("array<long>")
    columns = ["row", "vec_id", "label", "v", "low", "high"]
    index = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("rb"), F.lit(0).alias("kind"), "row", "vec_id", "label", "v", nothing.alias("low"), nothing.alias("high"))

    def past_blocks(anchors: DataFrame, run, kinds: str) -> DataFrame:
        sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"), F.lit(1).alias("kind"), *columns)
        dealt = index.unionByName(sent).repartition(blocks, "rb").sortWithinPartitions("rb", "kind")
        return dealt.mapInArrow(freeing(run), kinds)

    def alike(batches: Batches) -> Batches:
        def meet(block: Block, anchors: pa.RecordBatch) -> pa.RecordBatch:
            a, score, r = block.alike(anchors, turn, positives)
            return _out(["row", "positive_id", "score"], [anchors.column("row").to_numpy()[a], block.ids[r], score])

        return met(batches, lambda parts: Block(parts, turn), meet, ANCHORS)

    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("low", nothing).withColumn("high", nothing)
    near = past_blocks(anchors, alike, "row long, positive_id long, score long")
    first = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id")
    own = stash(near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives))

    def share(per: int, up: bool) -> Column:
        """Per cent of the positive's score, to the next whole number up or down; a decimal holds what 64 bits do not."""
        exact = F.col("score").cast("decimal(20,0)") * F.lit(per).cast("decimal(10,0)") / F.lit(100).cast("decimal(10,0)")
        return (F.ceil(exact) if up else F.floor(exact)).cast("long")

    wants = own.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", share(low, True).alias("low"), share(high, False).alias("high")))).alias("w"))
    asking = rows.join(wants, "row").withColumn("low", F.col("w.low")).withColumn("high", F.col("w.high"))

    def unlike(batches: Batches) -> Batches:
        def meet(block: Block, anchors: pa.RecordBatch) -> pa.RecordBatch:
            g, score, r, wide = block.unlike(anchors, turn, k)
            a, place = np.divmod(g, max(wide, 1))
            return _out(["row", "place", "negative_id", "negative_score"], [anchors.column("row").to_numpy()[a], place + 1, block.ids[r], score])

        return met(batches, lambda parts: Block(parts, turn), meet, ANCHORS)

    far = past_blocks(asking, unlike, "row long, place long, negative_id long, negative_score long")
    best = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    kept = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = rows.select("row", F.col("vec_id").alias("anchor_id"))
    out = kept.join(own.withColumnRenamed("score", "positive_score").withColumn("place", F.col("place").cast("long")), ["row", "place"]).join(names, "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


__all__ = ["negatives", "rotation"]
