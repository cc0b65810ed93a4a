"""Operator 4, exact top-k by a bit-sliced index.

Rows are dealt into blocks. In a block every attribute is a stack of bitmaps,
one for each bit of the quantised value; a block is built once, by the task
past which all queries stream. For a query the attribute slices, shifted by the signed digits of its
weights, are added with carry-save adders made of AND, OR and XOR; the sum is
again a stack of slices. The top rows are selected from the most significant
slice downward; rows that tie at the boundary are taken by smallest id. Scores
are read from the sum's slices. The blocks' tops are merged by a window per
query row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Batches, freeing, matrix, met, partitions, stash

#: A table is dealt to all tasks only while blocks have this many rows.
FEW_ROWS = 1 << 14
#: Rows of a block and queries met at once: a task holds one block of each.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 16, 512
#: Quantised components are below this in magnitude, so that the range of an attribute fits 64 bits.
BOUND = 1 << 62


class BitSlices:
    """Slices of a block: bits[d, j] is the bitmap of bit j of attribute d, shifted by low[d] to be at least 0."""

    def __init__(self, n: int, low: np.ndarray, bits: np.ndarray):
        self.n, self.low, self.bits, self.width = n, low, bits, bits.shape[1]
        self.valid = np.packbits(np.arange(max(1, -(-n // 64)) * 64) < n, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, x: np.ndarray) -> BitSlices:
        n = len(x)
        low = x.min(axis=0) if n else np.zeros(x.shape[1], dtype=np.int64)
        y = x - low
        width = max(1, int(y.max()).bit_length()) if y.size else 1
        padded = np.zeros((max(1, -(-n // 64)) * 64, x.shape[1]), dtype=np.int64)
        padded[:n] = y
        bits = [np.packbits(((padded >> j) & 1).astype(np.uint8), axis=0, bitorder="little").T for j in range(width)]
        return cls(n, low, np.stack(bits, axis=1).copy().view(np.uint64))

    def weighted(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the sum of q_d * y_d, with y_d complemented where a digit of q_d is negative, and what to add to it for the score.

        q_d is written in signed digits of which no two neighbours are set
        (3q and q differ in them), a third of all on average. Slice p holds
        the bitmaps of weight 2**p; three of a kind become one of the same and
        one of the next weight until one of each is left.
        """
        held: dict[int, list[np.ndarray]] = {}
        size = np.abs(q).astype(np.uint64)
        three = size * np.uint64(3)
        plus, minus = (three & ~size) >> np.uint64(1), (~three & size) >> np.uint64(1)
        plus, minus = np.where(q < 0, minus, plus), np.where(q < 0, plus, minus)
        rest = sum(int(a) * int(b) for a, b in zip(q, self.low, strict=True)) - ((1 << self.width) - 1) * sum(map(int, minus))
        for b in range(int((plus | minus).max()).bit_length() if len(q) else 0):
            one = np.uint64(1) << np.uint64(b)
            p, m = self.bits[plus & one != 0], self.bits[minus & one != 0]
            for j in range(self.width):
                held.setdefault(b + j, []).extend((p[:, j], ~m[:, j]))
        out, p = [], 0
        while p <= max(held, default=-1):
            m = np.concatenate(held.get(p, [self.valid[None][:0]]))
            while len(m) > 2:
                k = len(m) // 3
                a, b, c = m[:k], m[k : 2 * k], m[2 * k : 3 * k]
                ab = a ^ b
                carry = (a & b) | (c & ab)
                m = np.concatenate((ab ^ c, m[3 * k :]))
                held.setdefault(p + 1, []).append(carry)
            if len(m) == 2:
                held.setdefault(p + 1, []).append((m[0] & m[1])[None])
                m = (m[0] ^ m[1])[None]
            out.append(m[0] if len(m) else np.zeros_like(self.valid))
            p += 1
        return out, rest

    @staticmethod
    def values(slices: list[np.ndarray], rest: int, rows: np.ndarray) -> list[int]:
        """The scores of some rows; an error if one does not fit 64 bits."""
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        at = [((s[word] >> bit) & np.uint64(1)).tolist() for s in slices]
        out = [rest + sum(b << p for p, b in enumerate(one)) for one in zip(*at, strict=True)] if at else [rest] * len(rows)
        for v in out:
            if not -(1 << 63) <= v < 1 << 63:
                raise OverflowError(f"the score {v} does not fit 64 bits")
        return out

    def top(self, slices: list[np.ndarray], k: int, allowed: np.ndarray) -> np.ndarray:
        """Rows of the k highest sums; ties at the boundary by row number."""
        sure, maybe, found = np.zeros_like(allowed), allowed, 0
        for s in reversed(slices):
            high = maybe & s
            n = int(np.bitwise_count(high).sum())
            if found + n <= k:
                sure, found, maybe = sure | high, found + n, maybe & ~s
            else:
                maybe = high
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        edge = np.flatnonzero(np.unpackbits(maybe.view(np.uint8), bitorder="little"))[: k - found]
        return np.concatenate((rows, edge))


class _Block:
    """A block of the index; its rows are in order of id and row number, so that ties go to the smaller id."""

    def __init__(self, parts: list[pa.RecordBatch], width: int):
        ids, rows = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]).astype(np.int64) for c in ("vec_id", "row"))
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        self.index = BitSlices.of(np.concatenate([matrix(b.column("v"), width) for b in parts])[order])
        self.place = {r: i for i, r in enumerate(self.rows.tolist())}

    def top(self, queries: pa.RecordBatch, width: int, k: int) -> pa.RecordBatch:
        found: list[list[int]] = [[], [], [], []]
        index = self.index
        for q, row, own in zip(matrix(queries.column("v"), width), queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), strict=True):
            allowed = index.valid.copy()
            if (at := self.place.get(row)) is not None:
                allowed[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
            slices, rest = index.weighted(q)
            got = index.top(slices, k, allowed)
            for col, values in zip(found, ([row] * len(got), [own] * len(got), self.ids[got].tolist(), index.values(slices, rest, got)), strict=True):
                col.extend(values)
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in found], names=["row", "query_id", "vec_id", "score"])


def quantise(embeddings: DataFrame, scale: int, *carry: str) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x), and the columns to carry; vectors null, or with null or non-finite components, or without id, are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c * scale) < float(BOUND), F.floor(c * scale).cast("long")).otherwise(F.raise_error(F.concat(F.lit("too large a component: "), c.cast("string"))).cast("long"))
    return embeddings.where(F.coalesce(sound, F.lit(False))).select("vec_id", *carry, F.transform(x, whole).alias("v"))


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k highest inner products of each query row (vec_id divisible by `every`) with every row but itself.

    query_id, rank (from 1), vec_id, score; ties to the smaller vec_id, fewer
    rows if there are fewer. Null vectors and vectors with null, NaN or
    infinite components take no part; a shorter vector counts as padded with
    zeros, so an empty one scores 0 with all. A component of BOUND / scale or
    more, or a score of a block's top that does not fit 64 bits, is an error.
    Rows that repeat a vec_id are candidates, and queries, of their own: each
    such query row has its own ranks. Other columns are not read. An empty
    table gives no rows. Each row is in one block of the index, which one task
    builds and keeps while all queries stream past it, block_queries at a
    time; only k rows a query and block come out.
    """
    rows = stash(quantise(embeddings, scale).withColumn("row", F.monotonically_increasing_id()))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 0
    blocks = max(1, -(-n // block_rows), min(partitions(embeddings.sparkSession), n // FEW_ROWS))
    index = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("rb"), F.lit(0).alias("kind"), "row", "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"), F.lit(1).alias("kind"), "row", "vec_id", "v")

    def run(batches: Batches) -> Batches:
        return met(batches, lambda parts: _Block(parts, width), lambda block, some: block.top(some, width, k), block_queries)

    dealt = index.unionByName(queries).repartition(blocks, "rb").sortWithinPartitions("rb", "kind")
    near = dealt.mapInArrow(freeing(run), "row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


__all__ = ["BitSlices", "quantise", "top_k"]
