"""Operator 13, runs of repeated word groups by the runs theorem.

A text is a string of words. The longest Lyndon word from a position ends
before the next position whose suffix is smaller; under the reversed order of
words, before the next one whose suffix is larger. Every run holds a Lyndon
root that is such a longest word under one of the two orders, so the 2 n of
them are all that need be looked at. A root of p words is extended to the
right by the longest common prefix of its suffix and the one p words on, and
to the left by the same in the reversed text; both come from an LCP array with
a sparse table for range minima. Many texts are handled as one array, whose
words are told apart by text, so no repeat crosses texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BATCH_ROWS, Batches, by_bytes, fixed, freeing, stash

#: A run has at least LEAST words and at least TIMES its period.
LEAST, TIMES = 6, 4
#: Rounds of pointer jumping before a stack, which is linear, takes over.
JUMPS = 48
WORD = r"[^\x20\x09-\x0D]+"


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The rank of each suffix, by prefix doubling; only suffixes still tied are sorted again. All suffixes must differ within the array, as by an end mark of each text."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, dtype=np.int64)

    def spread(positions: np.ndarray, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Positions in order of their keys get the place of their group's first one; what is still tied comes back."""
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[positions] = np.maximum.accumulate(np.where(new, first, 0))
        lone = new & np.concatenate((new[1:], [True]))
        return positions[~lone]

    if not n:
        return rank
    tied, h = spread(order, symbols[order], np.arange(n)), 1
    while len(tied):
        keys = rank[tied] * n + rank[tied + h]
        o = np.argsort(keys, kind="stable")
        tied, keys = tied[o], keys[o]
        group = rank[tied]
        starts = np.concatenate(([True], group[1:] != group[:-1]))
        at = np.arange(len(tied))
        first = group + at - np.maximum.accumulate(np.where(starts, at, 0))
        tied, h = spread(tied, keys, first), 2 * h
    return rank


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, the length if there is none."""
    n = len(values)
    out = np.arange(1, n + 1)
    v = np.append(values, np.iinfo(np.int64).min)
    active = np.arange(n)
    for _ in range(JUMPS):  # what lies before out[i] is not smaller, so what out[i] skips may be skipped too
        active = active[v[out[active]] > v[active]]
        if not len(active):
            return out
        out[active] = out[out[active]]
    stack: list[int] = [n]
    values = v.tolist()
    for i in range(n - 1, -1, -1):
        while values[stack[-1]] > values[i]:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return out


class Common:
    """Longest common prefixes of any two suffixes of an array: LCP of neighbours in suffix order, and its range minima."""

    def __init__(self, symbols: np.ndarray, rank: np.ndarray):
        n = len(symbols)
        self.rank = rank
        after = np.empty(n, dtype=np.int64)
        after[rank] = np.arange(n)
        before = np.concatenate(([-1], after[:-1]))[rank].tolist()  # of each suffix the one before it in order
        s, ranks, lcp, h = symbols.tolist(), rank.tolist(), [0] * n, 0
        for i, j in enumerate(before):
            if j < 0:
                h = 0
                continue
            m = n - max(i, j)
            while h < m and s[i + h] == s[j + h]:
                h += 1
            lcp[ranks[i]] = h
            h = h - 1 if h else 0
        self.table = [np.array(lcp, dtype=np.int32)]
        while 2 * (1 << len(self.table) - 1) <= n:
            t, k = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(t[:-k], t[k:]))

    def prefixes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of different places i and j."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # the minimum of lcp[lo:hi]
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(level):
            x = np.flatnonzero(level == k)
            t = self.table[k]
            out[x] = np.minimum(t[lo[x]], t[hi[x] - (1 << int(k))])
        return out


def _take(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of pieces, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    heads = np.cumsum(sizes) - sizes
    return np.repeat(starts - heads, sizes) + np.arange(total)


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs with at least `least` words and `times` (2 or more) periods, in order of text, start and period.

    words: the numbers (from 0) of the words of all texts, one after another; sizes: how many each text has.
    """
    if times < 2:
        raise ValueError("a run has two periods or more")
    none = (np.empty(0, dtype=np.int64),) * 4
    n, texts = len(words), len(sizes)
    if n < least:
        return none
    # every text with an end mark, its least symbol; symbols of a text are above those of the texts before it
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    text = np.repeat(np.arange(texts), sizes + 1)
    plain = np.zeros(n + texts, dtype=np.int64)
    inner = np.ones(n + texts, dtype=bool)
    inner[ends] = False
    plain[inner] = words + 1
    symbols = text * (int(words.max()) + 2) + plain
    rank = suffix_ranks(symbols)
    here = np.flatnonzero(inner)
    close = ends[text[here]]
    roots = []
    for values in (rank, -rank):
        stop = next_smaller(values)[here]
        p = stop - here
        # a run's first root has times - 1 periods behind it, but for a word, so it agrees with the next one in its first words
        near = here + p * (times - 1) < close
        i, p = here[near], p[near]
        for k in range(times - 1):
            same = symbols[i + k] == symbols[i + p + k]
            i, p = i[same], p[same]
        roots.append(np.stack((i, p)))
    i, p = np.concatenate(roots, axis=1)
    if not len(i):
        return none
    # a common prefix is needed of texts with such roots only
    chosen = np.unique(text[i])
    place = np.full(n + texts, -1)
    parts = _take(starts[chosen], sizes[chosen] + 1)
    place[parts] = np.arange(len(parts))
    forward = symbols[parts]
    order = np.empty(len(parts), dtype=np.int64)
    order[np.argsort(rank[parts])] = np.arange(len(parts))
    right = Common(forward, order).prefixes(place[i], place[i + p])
    # from the first root of a run on, at least times - 2 periods follow beside the root itself, and one word more
    enough = (right >= (times - 2) * p + 1) & (right + 2 * p > least)
    i, p, right = i[enough], p[enough], right[enough]
    if not len(i):
        return none
    # texts reversed, each with its end mark behind it; the words are the same
    chosen = np.unique(text[i])
    back = _take(starts[chosen], sizes[chosen] + 1)
    m = sizes[chosen] + 1
    heads = np.cumsum(m) - m
    local = np.arange(int(m.sum())) - np.repeat(heads, m)
    which = np.repeat(np.arange(len(chosen)), m)
    turned = np.where(local < sizes[chosen][which], heads[which] + sizes[chosen][which] - 1 - local, heads[which] + local)
    mirrored = symbols[back][turned]
    common = Common(mirrored, suffix_ranks(mirrored))
    index = np.searchsorted(chosen, text[i])
    flip = heads[index] + sizes[chosen][index] - (i - starts[chosen][index])  # where the text before i begins, read backwards
    left = common.prefixes(flip - p, flip)
    start, length = i - left - starts[text[i]], left + p + right
    good = (length >= least) & (length >= times * p)
    found = np.unique(np.stack((text[i], start, p, length))[:, good], axis=1)
    return found[0], found[1], found[3], found[2]


def _pieces(batches: Batches, least: int, times: int) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in by_bytes(batches, 1):
        texts = [(x or b"").split() for x in b.column(1).cast(pa.binary()).to_pylist()]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        numbers: dict[bytes, int] = {}
        flat = [numbers.setdefault(w, len(numbers)) for t in texts for w in t]
        of, start, length, period = find_runs(np.array(flat, dtype=np.int64), sizes, least, times)
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        structs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(kinds.value_type))
        collapsed = []
        for i, t in enumerate(texts):
            lo, hi = cuts[i], cuts[i + 1]
            if hi > lo:
                edge = np.zeros(len(t) + 1, dtype=np.int64)
                np.add.at(edge, start[lo:hi] + period[lo:hi], 1)
                np.add.at(edge, start[lo:hi] + length[lo:hi], -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                t = [t[k] for k in kept]
            collapsed.append(b" ".join(t))
        words = pa.array(collapsed, type=pa.binary()).view(pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), structs), words], names=["key", "n_words", "runs", "collapsed"])


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then period) and collapsed: each run's first period stays, words joined by one space.

    Words are what WORD matches in the whole text, a null one has none; a run
    is a longest stretch with a smallest period of p words, at least `least`
    words and `times` p. A word goes if any run holds it behind its first p
    words. One row out for each row in, whatever its id; other columns are
    not read; an empty table gives no rows. A text is handled in one task,
    about BATCH_BYTES of texts at a time, in memory of a few hundred bytes a
    word; a longer text is a batch of its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text")
    found = rows.mapInArrow(freeing(lambda batches: _pieces(batches, least, times)), "key long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("key", "doc_id")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, in which of every tenth document, by the CRC of its id, a tail of words repeats a part of it; a null id is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = docs.select("doc_id", "text", h.alias("h"))
    hit = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    some = some.withColumn("w", F.when(hit, words)).withColumn("n", F.size("w").cast("long"))
    some = some.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    some = some.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("concat_ws(' ', transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])))")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The result of `runs` as numbers and digests: n_runs, the run with most periods (ties: smallest start, then period), runs_sha256, collapsed_sha256."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    better = F.expr("aggregate(runs, runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")  # runs are in order, so the first of equals stays
    best = F.when(F.size("runs") > 0, better)
    out = found.withColumn("best", best)
    one: list[Column] = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *one, milli, F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def repeats(docs: DataFrame) -> DataFrame:
    """`digests` of the planted documents, written to the shared folder: a row of about 200 bytes a document."""
    return stash(digests(runs(planted(fixed(docs)))), batch_rows=BATCH_ROWS)


__all__ = ["digests", "find_runs", "planted", "repeats", "runs", "suffix_ranks"]
