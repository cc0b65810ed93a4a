"""Operator 8, n-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row for each distinct shingle set and a column for each
shingle; its product with its transpose holds all overlaps. Only columns that
can matter are multiplied: a set's shingles are ordered from rare to common
(by corpus counts of the common ones, then by hash), and two sets whose
overlap reaches the bound that their sizes give share one of the first
n - ceil(t * n) + 1 of each. Columns are dealt into blocks by hash; a block
multiplies its columns and keeps pairs whose sizes allow the threshold.

A long column is not squared. It first links all its rows to one pivot; after
those pairs are counted exactly and joined into components, only pairs of
different components are left in it. Its rows are then dealt into parts, and
every two parts meet in a tile. A tile first discards pairs whose parity
signatures, of two bits or more a shingle, show too small an overlap; the rows that have a pair left
get their whole sets, and the tile multiplies those, row by row, and gives
back a spanning forest of the links it found. So a group of n near copies
costs about n rows for each column, never n * n, and no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BATCH_ROWS, by_bytes, discard, fixed, freeing, partitions
from codeloom.llm.common import stash as any_stash
from codeloom.llm.hashing import scramble
from codeloom.llm.shingles import shingle_sets

#: Threshold as a fraction: a link needs HUNDRED * overlap >= LEAST * union.
LEAST, HUNDRED = 75, 100
#: Columns up to this length are squared at once.
SHORT = 8
#: The most common shingles that the order knows; from LOCAL in a task's batch on, a shingle is counted. Neither changes results, only cost.
COMMON, LOCAL, COUNT_BATCH = 1 << 16, 4, 4 << 20
#: Rows of a column that one task of the first pass holds; rows and shingles of a part of a column in the second; prefix rows of a task.
PART, TILE, TILE_SHINGLES, BLOCK = 8192, 4096, 1 << 19, 1 << 20
#: Rows of a tile multiplied at a time by signature.
STRIP = 32
#: Members of a pivot counted by one task, and 64-bit words of the smallest signature.
MEMBERS, WORDS = 512, 8
#: Words of signatures compared at a time.
COMPARED = 1 << 21
#: Bits of the filter that picks the texts whose sets are needed.
FILTER_BITS = 1 << 24
#: Bits of a piece of that filter, which one task makes.
PIECE = 1 << 18
#: Columns of a set by which the first one that a pair shares is found.
FIRSTS = 8
#: Salts of a column's key where its rows look up whether it is still open.
SALTS = 16
#: Bytes of a stash, and rows that go, up to which a join may take them through the driver.
BROADCAST, BROADCAST_ROWS = 1 << 18, 1 << 20

stash = partial(any_stash, broadcast=BROADCAST)


def _key(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    return int((scramble(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64))


def _signature(s: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles by their low bits: a power of two of bits, two a shingle at least, so that two signatures differ in no more bits than their sets in shingles."""
    words = WORDS
    while 32 * words < len(s):
        words *= 2
    bits = (np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def _folded(sig: np.ndarray) -> np.ndarray:
    """Signatures (rows) of half the width: the halves' parities together."""
    half = sig.shape[-1] // 2
    return sig[..., :half] ^ sig[..., half:]


def _raws(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def describe(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document (row, doc_id, n, s, sig) and rows of counts (h, c) of shingles that repeat within a batch; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counts() -> pa.RecordBatch:
            k, c = np.unique(np.concatenate(held), return_counts=True)
            k, c = k[c >= LOCAL], c[c >= LOCAL]
            if len(k) > COMMON:
                top = np.argpartition(-c, COMMON)[:COMMON]
                k, c = k[top], c[top]
            none = lambda kind: pa.nulls(len(k), kind)
            return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.list_(pa.int64())), _i64(k), _i64(c)], names=names)

        names = ["row", "doc_id", "n", "s", "sig", "h", "c"]
        for b in by_bytes(batches, 2):
            sets = shingle_sets(_raws(b.column(2)), words)
            m = len(sets)
            sigs = pa.array([_signature(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _i64(np.array([len(x) for x in sets])), pa.array([_key(x) for x in sets], pa.int64()), sigs, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
            held += sets
            size += sum(map(len, sets))
            if size >= COUNT_BATCH:
                yield counts()
                held, size = [], 0
        if size:
            yield counts()

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(freeing(run), "row long, doc_id long, n long, s long, sig array<long>, h long, c long")


def _prefixes(docs: DataFrame, words: int, common: np.ndarray, counts: np.ndarray, total: int) -> DataFrame:
    """(h, part, s, n): for each set the shingles that its links must share one of; columns known to be long are dealt to several parts.

    Shuffled columns are known by as many bits of h as tell nearly all of
    `total` apart: two that fall together only give more pairs to check.
    """
    bits = -(-(max(total, 1).bit_length() + 10) // 8) * 8
    mask = np.uint64((1 << min(bits, 63)) - 1)
    parts = np.where(counts > PART, -(-counts // PART), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in by_bytes(batches):
            sets = []
            for x in shingle_sets(_raws(b.column(0)), words):
                if len(x) and (k := _key(x)) not in done:
                    done.add(k)
                    sets.append((k, x))
            if not sets:
                continue
            n = np.array([len(x) for _, x in sets])
            h, owner = np.concatenate([x for _, x in sets]), np.repeat(np.arange(len(sets)), n)
            place = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
            known = common[place] == h if len(common) else np.zeros(len(h), dtype=bool)
            often = np.where(known, counts[place], 0) if len(common) else np.zeros(len(h), dtype=np.int64)
            order = np.lexsort((h, often, owner))
            at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            taken = order[at < np.repeat(n - -(-n * LEAST // HUNDRED) + 1, n)]
            s = np.array([k for k, _ in sets], dtype=np.int64)[owner[taken]]
            many = np.where(known, parts[place], 0)[taken] if len(common) else np.zeros(len(taken), dtype=np.int64)
            part = np.where(many > 0, 1 + s.view(np.uint64) % np.maximum(many, 1).astype(np.uint64), 0).astype(np.int32)  # 0: not dealt
            yield pa.RecordBatch.from_arrays([_i64(h[taken] & mask), pa.array(part), pa.array(s), pa.array(n[owner[taken]].astype(np.int32))], names=["h", "part", "s", "n"])

    return docs.select("text").mapInArrow(freeing(run), "h long, part int, s long, n int")


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes a and b allow the threshold."""
    return HUNDRED * np.minimum(a, b) >= LEAST * np.maximum(a, b)


def _first_pass(postings: DataFrame, blocks: int) -> DataFrame:
    """(a, na, b, nb, h) from the columns of a block: pairs that share a short column or link a long one to its pivot, with h null; and rows of long columns (a, na), with b null and h set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        h, part, s, n = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(4))
        order = np.lexsort((s, part, h))
        h, part, s, n = h[order], part[order], s[order], n[order].astype(np.int64)
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (s[1:] != s[:-1])
        h, part, s, n = h[new], part[new], s[new], n[new]
        start = np.ones(len(h), dtype=bool)
        start[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, len(h)))
        group = np.cumsum(start) - 1
        left, right = [], []
        long = (size[group] > SHORT) | (part > 0)
        for k in range(1, SHORT):  # short columns: every pair, by distance
            i = np.flatnonzero(group[k:] == group[:-k])
            i = i[~long[i]]
            left.append(i)
            right.append(i + k)
        i = np.flatnonzero(long & ~start)  # long ones: the first row is the pivot
        left.append(begin[group[i]])
        right.append(i)
        a, b = np.concatenate(left), np.concatenate(right)
        fit = _within(n[a], n[b])
        a, b = a[fit], b[fit]
        order = np.lexsort((s[b], s[a]))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (s[a[1:]] != s[a[:-1]]) | (s[b[1:]] != s[b[:-1]])
        a, b = a[new], b[new]
        names = ["a", "na", "b", "nb", "h"]
        yield pa.RecordBatch.from_arrays([_i64(s[a]), _i64(n[a]), _i64(s[b]), _i64(n[b]), pa.nulls(len(a), pa.int64())], names=names)
        j = np.flatnonzero(long)
        none = pa.nulls(len(j), pa.int64())
        yield pa.RecordBatch.from_arrays([_i64(s[j]), _i64(n[j]), none, none, _i64(h[j])], names=names)

    dealt = postings.repartition(blocks, "h", "part")
    return dealt.mapInArrow(freeing(run), "a long, na long, b long, nb long, h long")


def _open_columns(columns: DataFrame, info: DataFrame) -> DataFrame:
    """The rows of columns that hold several components, with dealt, the parts that the column is cut into.

    Open columns grow with the input, and Spark sees their file but not the
    salts, so the join says that they are no table for the driver.
    """
    c = columns.join(info.select("s", "c"), "s")
    # columns that are one component by now are done
    size = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    alive = stash(c.groupBy("h").agg(size.alias("k"), F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("h", "k"))
    salted = alive.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("k", "dealt")
    return columns.withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["h", "salt"]).drop("salt")


def _tile_rows(columns: DataFrame, info: DataFrame) -> DataFrame:
    """(h, lo, hi, mine, s, c): rows of the tiles of open columns that have a pair of different components whose sizes and signatures allow the threshold.

    A column is cut into parts of about TILE rows and every two parts meet in
    a task of their own, so no task holds a column. A pair counts in the first
    column that it shares: it is known where both rows have one of their FIRSTS
    smallest columns in common, else the pair counts in each.
    """
    c = _open_columns(columns, info).join(info, "s")
    c = c.withColumn("p", F.pmod(F.xxhash64("s", "h"), F.col("dealt")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)))
    tile = c.select("h", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), F.col("p").alias("mine"), "s", "n", "c", "sig", "firsts")

    def needed(h: int, lo, hi, mine, n, c, sig, firsts) -> np.ndarray:
        out = np.zeros(len(n), dtype=bool)
        width = np.array([len(x) for x in sig])
        for w in np.unique(width).tolist():
            # sizes that allow the threshold have the same width or one twice or half as large
            wide = width == 2 * w
            here = np.flatnonzero(wide | (width == w))
            table = np.stack([_folded(sig[r]) if wide[r] else sig[r] for r in here])
            place = np.zeros(len(n), dtype=np.int64)
            place[here] = np.arange(len(here))
            left, right = here[mine[here] == lo], here[mine[here] == hi]
            for at in range(0, len(left), STRIP):
                i = left[at : at + STRIP]
                a, b = i[:, None], right[None]
                ok = (c[a] != c[b]) & _within(n[a], n[b]) & ~(wide[a] & wide[b])
                if lo == hi:
                    ok &= a < b
                xs, ys = np.nonzero(ok)
                step = max(1, COMPARED // w)
                for z in range(0, len(xs), step):
                    x, y = i[xs[z : z + step]], right[ys[z : z + step]]
                    good = ~(out[x] & out[y])  # rows that are known to be needed stay so
                    x, y = x[good], y[good]
                    good = _alike(table[place[x]], table[place[y]], n[x], n[y])
                    x, y = x[good], y[good]
                    same = firsts[x][:, :, None] == firsts[y][:, None, :]
                    known = np.where(same.any(axis=2), firsts[x], np.iinfo(np.int64).max).min(axis=1)
                    counts = (known == h) | ~same.any(axis=(1, 2))
                    out[x[counts]] = True
                    out[y[counts]] = True
        return np.flatnonzero(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, 3):
            t = pa.Table.from_batches(held)
            col = lambda name: t.column(name).to_numpy()  # noqa: E731, B023
            sig = [np.asarray(x).view(np.uint64) for x in t.column("sig").to_pandas()]  # bits of signed numbers would be counted by magnitude
            firsts = np.array(t.column("firsts").combine_chunks().flatten().to_numpy()).reshape(-1, FIRSTS)
            take = needed(col("h")[0], col("lo")[0], col("hi")[0], col("mine"), col("n").astype(np.int64), col("c"), sig, firsts)
            if len(take):
                yield from t.select(["h", "lo", "hi", "mine", "s", "c"]).take(pa.array(take)).combine_chunks().to_batches()

    dealt = tile.repartition(partitions(columns.sparkSession), "h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    return dealt.mapInArrow(freeing(run), "h long, lo int, hi int, mine int, s long, c long")


def _alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether signatures and sizes allow the threshold: sets differ in as many shingles as their signatures in bits, at least."""
    far = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    most = (n + m - far) // 2
    return HUNDRED * most >= LEAST * (n + m - most)


def spanning_links(keys: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between the left and the right rows that span all that hold between rows of different components; at most one fewer than rows.

    left and right are the same rows, or disjoint. The sets are a sparse
    incidence matrix; a row's overlaps with all rows are one product with it.
    Rows that a link has joined are one component from then on.
    """
    n = np.array([len(x) for x in sets], dtype=np.int64)
    comp = np.unique(comp, return_inverse=True)[1]
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1  # a shingle of one row adds to no overlap
    owner, col = np.repeat(np.arange(len(sets)), n)[shared], col[shared]
    row_at = np.searchsorted(owner, np.arange(len(sets) + 1))
    order = np.argsort(col, kind="stable")
    by_col, col_at = owner[order], np.searchsorted(col[order], np.arange(len(count) + 1))
    within_tile = len(left) == len(right) and bool((left == right).all())
    links = []
    for i in left:
        j = right[right > i] if within_tile else right
        j = j[(comp[j] != comp[i]) & _within(n[i], n[j])]
        if not len(j):
            continue
        own = col[row_at[i] : row_at[i + 1]]
        size = col_at[own + 1] - col_at[own]
        at = np.repeat(col_at[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = np.bincount(by_col[at], minlength=len(sets))[j]
        j = j[HUNDRED * both >= LEAST * (n[i] + n[j] - both)]
        other, first = np.unique(comp[j], return_index=True)
        links += [(keys[i], keys[k]) for k in j[first]]
        comp[np.isin(comp, other)] = comp[i]
    return links


def _tile_links(rows: DataFrame, docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """The links (a, b) that span those of the tiles' rows; each row's whole set is sent to its tile once."""
    need = rows.select("s").distinct().join(sets, "s").select("s", F.col("first.row").alias("row"))
    full = rows.join(_sets_of(need, docs, words), "s").select("h", "lo", "hi", "mine", "s", "c", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, 3):
            t = pa.Table.from_batches(held)
            own = [np.frombuffer(x, dtype=np.uint64) for x in t.column("set").to_pylist()]
            mine, lo, hi = (t.column(k).to_numpy() for k in ("mine", "lo", "hi"))
            got = spanning_links(t.column("s").to_numpy(), own, t.column("c").to_numpy(), np.flatnonzero(mine == lo[0]), np.flatnonzero(mine == hi[0]))
            if got:
                a, b = np.array(got).T
                yield pa.RecordBatch.from_arrays([_i64(a), _i64(b)], names=["a", "b"])

    dealt = full.repartition(partitions(docs.sparkSession), "h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    return dealt.mapInArrow(freeing(run), "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches regrouped by their first columns, in which they are sorted."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = tuple(k[lo])
            if held and own != now:
                yield held
                held = []
            now = own
            held.append(b.slice(lo, hi - lo))
    if held:
        yield held


def _bitmap(need: DataFrame) -> np.ndarray:
    """64-bit words in which the bits of the numbers at, under FILTER_BITS, are set; the driver gets a value for each piece, not for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            piece, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(piece).tolist():
                held.setdefault(p, np.zeros(PIECE, dtype=np.uint8))[at[piece == p] % PIECE] = 1
        bits = pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), bits], names=["piece", "bits"])

    dealt = need.select(F.floor(F.col("at") / PIECE).cast("int").alias("piece"), "at").repartition(min(partitions(need.sparkSession), FILTER_BITS // PIECE), "piece")
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for r in dealt.mapInArrow(run, "piece int, bits binary").collect():
        out[r.piece * PIECE // 64 : (r.piece + 1) * PIECE // 64] = np.frombuffer(r.bits, dtype=np.uint64)
    return out


def _sets_of(need: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(s, set) of each row of need (s, row), which hold one document of each set.

    Up to a quarter of FILTER_BITS of them, a bitmap of their rows, of bounded
    size, picks the texts that are read into sets, and a join the right ones
    of those; more are joined to the texts first.
    """
    need = stash(need)
    own = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    few = need.count() <= FILTER_BITS // 4
    at = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    if few:
        wanted = _bitmap(need.select(at.alias("at")))
    else:
        own = own.join(need.select("row"), "row", "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 2):
            if few:
                p = b.column(0).to_numpy()
                b = b.filter(pa.array((wanted[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1))  # noqa: PLW2901
            sets = shingle_sets(_raws(b.column(2)), words)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["at", "s", "set"])

    built = own.select(at.alias("place"), "row", "text").mapInArrow(freeing(build), "at long, s long, set binary")
    return built.join(need, "s").where("at = row").select("s", "set")


def _close(sig: str, other: str, n: str, m: str) -> Column:
    """Whether signatures, the wider one folded to the other's width, and sizes allow the threshold."""
    least = F.least(F.size(sig), F.size(other))
    fold = lambda x: F.when(F.size(x) == least, F.col(x)).otherwise(F.transform(F.sequence(F.lit(1), least), lambda i: F.element_at(x, i).bitwiseXOR(F.element_at(x, i + least))))
    far = F.aggregate(F.zip_with(fold(sig), fold(other), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = F.floor((F.col(n) + F.col(m) - far) / 2)
    return HUNDRED * most >= LEAST * (F.col(n) + F.col(m) - most)


def _count(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted exactly from the whole sets.

    A set is sent once for each pair to its pivot's tasks, a pivot's set once
    to each task that counts its members.
    """
    spark = docs.sparkSession
    one = sets.select(F.col("s").alias("a"), F.col("sig").alias("sa"))
    two = sets.select(F.col("s").alias("b"), F.col("sig").alias("sb"))
    near = pairs.join(one, "a").join(two, "b").where(_close("sa", "sb", "na", "nb")).select("a", "b")
    near = stash(near)
    need = near.select(F.col("a").alias("s")).unionByName(near.select(F.col("b").alias("s"))).distinct()
    built = _sets_of(need.join(sets, "s").select("s", F.col("first.row").alias("row")), docs, words)
    k = near.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("k"))
    members = near.join(k, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("s"))
    pivots = k.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("s"))
    joined = members.unionByName(pivots).join(built, "s")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot = None, None
        for b in batches:
            out_a, out_b = [], []
            for a, part, role, s, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(raw, dtype=np.uint64)
                if role == 0:
                    now, pivot = (a, part), x
                    continue
                if now != (a, part):
                    raise ValueError("a pivot's set is missing")
                at = np.minimum(np.searchsorted(pivot, x), len(pivot) - 1)
                both = int((pivot[at] == x).sum())
                if HUNDRED * both >= LEAST * (len(x) + len(pivot) - both):
                    out_a.append(a)
                    out_b.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    dealt = joined.select("a", "part", "role", "s", "set").repartition(partitions(spark), "a", "part").sortWithinPartitions("a", "part", "role")
    return stash(dealt.mapInArrow(freeing(overlap), "a long, b long"), batch_rows=BATCH_ROWS)


def components(links: DataFrame) -> DataFrame:
    """(v, c): for each end of a link the smallest end that links reach from it.

    Rounds of taking the least label among neighbours and then the label's own
    label, each written to the shared folder, until nothing changes: about the
    logarithm of the longest path.
    """
    both = stash(links.select(F.col("a").alias("u"), F.col("b").alias("w")).union(links.select("b", "a")).distinct())
    label = stash(both.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("c")))
    while True:
        near = both.join(label, both.w == label.v).groupBy("u").agg(F.min("c").alias("m"))
        low = label.join(near, label.v == near.u, "left").select("v", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old"))
        low = stash(low)
        top = low.select(F.col("v").alias("x"), F.col("c").alias("up"))
        new = stash(low.join(top, low.c == top.x, "left").select("v", F.least("c", F.coalesce("up", "c")).alias("c"), "old"))
        done = not new.where("c <> old").limit(1).count()
        discard(label, low)
        label = new.select("v", "c")
        label._stashed_at = new._stashed_at
        if done:
            discard(both)
            return label


def classes(docs: DataFrame, words: int = 5) -> DataFrame:
    """Every document's row, doc_id, n_shingles, and its class as component_id and keeper.

    docs: doc_id, text; other columns are not read. Null and empty texts, and
    those without words, have no shingles and are a class each; a text with
    fewer words than a shingle has one shingle of all its words. Texts of
    equal sets are one matrix row. component_id is the smallest doc_id of the
    class (null where no row of it has one; a class without shingles has its
    own), keeper marks one row of each class, that of the smallest doc_id and
    row. Repeated ids are rows of their own. An empty table gives no rows.
    """
    docs = fixed(docs)
    base = stash(describe(docs, words), batch_rows=BATCH_ROWS)
    meta = base.where("row is not null").select("row", "doc_id", "n", "s")
    sets = stash(base.where("n > 0").groupBy("s").agg(F.first("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.first("sig").alias("sig")))
    # written first: collected, the driver would get up to COMMON rows of each task and choose among them itself
    top = stash(base.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(COMMON)).toPandas()
    common = top.h.to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(common)
    total = meta.agg(F.sum("n")).first()[0] or 0
    blocks = max(partitions(docs.sparkSession), -(-total * (HUNDRED - LEAST) // (HUNDRED * BLOCK)))
    first = stash(_first_pass(_prefixes(docs, words, common[order], top.c.to_numpy().astype(np.int64)[order], total), blocks), batch_rows=2000)
    pairs = first.where("h is null").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
    columns = stash(first.where("h is not null").select("h", F.col("a").alias("s"), F.col("na").alias("n")).distinct())
    some = F.slice(F.sort_array(F.collect_list("h")), 1, FIRSTS)
    # as many for each set: its own key, which is no column, fills the rest
    long = stash(columns.groupBy("s").agg(some.alias("f")).select("s", F.concat("f", F.array_repeat("s", FIRSTS - F.size("f"))).alias("firsts")))
    links = _count(pairs, docs, sets, words)
    label = components(links)
    info = long.join(sets.select("s", "sig"), "s").join(label, F.col("s") == label.v, "left")
    info = stash(info.select("s", "sig", "firsts", F.coalesce("c", "s").alias("c")))
    discard(first)
    rest = stash(_tile_rows(columns, info), batch_rows=4000)
    if rest.limit(1).count():
        more = stash(_tile_links(rest, docs, sets, words), batch_rows=BATCH_ROWS)
        up = lambda name: F.coalesce(name, F.col(name[0]))
        la, lb = label.select(F.col("v").alias("a"), F.col("c").alias("a_c")), label.select(F.col("v").alias("b"), F.col("c").alias("b_c"))
        over = components(more.join(la, "a", "left").join(lb, "b", "left").select(up("a_c").alias("a"), up("b_c").alias("b")).where("a <> b"))
        of = over.select(F.col("v").alias("c"), F.col("c").alias("c2"))
        joined = label.join(of, "c", "left").select("v", F.coalesce("c2", "c").alias("c"))
        alone = over.join(label.select("v"), "v", "left_anti").select("v", "c")
        label = stash(joined.unionByName(alone))
    discard(columns, long, rest)
    of_set = sets.join(label, sets.s == label.v, "left").select("s", "first", F.coalesce("c", "s").alias("c"))
    named = of_set.groupBy("c").agg(F.min("first").alias("first"))
    set_class = stash(of_set.select("s", "c").join(named, "c").select("s", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("kept")))
    full = meta.where("n > 0").join(set_class.hint("merge"), "s").select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("kept")).alias("keeper"))
    empty = meta.where("n = 0").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper"))
    return full.unionByName(empty)


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """One document of each class stays, with all its columns, whatever their names; docs that are no plain scan of files are written first, so that rows keep their numbers."""
    docs = fixed(docs)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    gone = stash(classes(docs, words).where("not keeper").select("row"))
    if gone.count() > BROADCAST_ROWS:
        gone = gone.hint("merge")
    kept = docs.toDF(*plain).withColumn("row", F.monotonically_increasing_id()).join(gone, "row", "left_anti")
    return kept.select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)])
