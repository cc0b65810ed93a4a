"""Operator 5, Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases (LZ78: each phrase is
the shortest string not met as a phrase before; the last may repeat one). The
set of phrases is hashed, and the `SIZE` smallest hashes are the fingerprint.
Two fingerprints' likeness estimates the phrase sets' Jaccard similarity: of
the `SIZE` smallest hashes of both together, the share that both have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Batches, fixed, freeing, partitions, stash
from codeloom.llm.hashing import numbers, run_hashes

#: Hashes of a fingerprint, and hex digits of each.
SIZE, DIGITS = 128, 8
#: Bytes hashed at a time.
CHUNK = 1 << 20
#: Bytes of text of a range of documents, about, and rows that are hashed together.
RANGE_BYTES, ROWS = 32 << 20, 200
_VALUES = numbers(256)


class Parse:
    """The phrases of a text, and of the text with another second half.

    The dictionary is one table from (phrase, next byte) to phrase, in the
    order of the phrases; a phrase is known by where it ended, so the values
    are the ends. What a second half added is taken back, last first, before
    another is parsed, so the shared first half is parsed once.
    """

    def __init__(self, head: bytes, tail: bytes):
        self.table: dict[int, int] = {}
        self.head = head
        self.node = self._read(head, 0, 0)
        self.kept = len(self.table)
        self.ends = self.follow(tail)

    def _read(self, raw: bytes, node: int, at: int) -> int:
        """Parse bytes from a phrase and a place on; the phrase that is left open at the end. Places are in the upper bits, a byte's room below."""
        table, at = self.table, at << 8
        known = table.get
        for b in raw:
            at += 256
            if not (node := known(key := node | b, 0)):
                table[key] = at
        return node

    def follow(self, tail: bytes) -> np.ndarray:
        """Where each phrase ends, with this second half."""
        table = self.table
        for _ in range(len(table) - self.kept):
            table.popitem()
        left = self._read(tail, self.node, len(self.head))
        ends = np.fromiter(table.values(), dtype=np.int64, count=len(table)) >> 8
        return np.append(ends, len(self.head) + len(tail)) if left else ends


def phrase_ends(raw: bytes) -> np.ndarray:
    """Where each phrase of a text ends."""
    return Parse(raw, b"").ends


def hashes(jobs: list[tuple[bytes, np.ndarray]]) -> Iterator[np.ndarray]:
    """For each (bytes, phrase ends) the 64-bit hashes of the phrases; CHUNK bytes are hashed at a time."""
    raw, ends, sizes = [], [], []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        e = np.concatenate([*ends, np.empty(0, np.int64)]).astype(np.int64)
        st = np.concatenate(([0], e[:-1])) if len(e) else e
        h = run_hashes(_VALUES[data], st, e)
        yield from np.split(h, np.cumsum(sizes)[:-1])

    for data, cuts in jobs:
        if len(data) > CHUNK:  # by itself, in parts that end where phrases end
            if raw:
                yield from flush()
                raw, ends, sizes, held = [], [], [], 0
            parts, i = [], 0
            while i < len(cuts):
                lo = int(cuts[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(cuts, lo + CHUNK, side="right")))
                parts += hashes([(data[lo : int(cuts[j - 1])], cuts[i:j] - lo)]) if cuts[j - 1] - lo <= CHUNK else [np.array([_long(data[lo : int(cuts[j - 1])])], dtype=np.uint64)]
                i = j
            yield np.concatenate(parts)
            continue
        raw.append(data)
        ends.append(cuts + held)
        sizes.append(len(cuts))
        held += len(data)
        if held >= CHUNK:
            yield from flush()
            raw, ends, sizes, held = [], [], [], 0
    if raw:
        yield from flush()


def _long(phrase: bytes) -> int:
    """A phrase over CHUNK bytes: only a text of one repeated pattern has such."""
    return int.from_bytes(hashlib.blake2b(phrase, digest_size=8).digest())


def smallest(h: np.ndarray) -> str:
    """Hex of the SIZE smallest distinct hashes, fewer for a short text; empty for an empty one."""
    return np.unique((h >> np.uint64(64 - 4 * DIGITS)).astype(np.uint32))[:SIZE].astype(">u4").tobytes().hex()


def to_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def fingerprint(text: str) -> str:
    raw = to_bytes(text)
    return smallest(next(hashes([(raw, phrase_ends(raw))])))


def likeness(a: str, b: str) -> float:
    """0 to 1; equal fingerprints, empty ones too, are alike by 1."""
    if a == b:
        return 1.0
    both = np.sort(np.frombuffer(bytes.fromhex(a + b), dtype=">u4").astype(np.uint32))
    twice = both[1:] == both[:-1]
    place = np.cumsum(np.concatenate(([True], ~twice)))  # among the distinct ones, from 1
    return int((twice & (place[1:] <= SIZE)).sum()) / min(int(place[-1]), SIZE)


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the following text's first as many."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def dealt(docs: DataFrame) -> DataFrame:
    """part, doc_id, text: documents by descending doc_id (null ids last, rows of one id by a hash of their text) in sorted ranges.

    Bounds are sampled by Spark. The number of a row as it was read parts rows
    that are alike in all else, so that a range may end in a group of any size.
    """
    docs = fixed(docs)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("lost"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("u"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    order = ["lost", F.desc("doc_id"), "u", "row"]
    n = max(partitions(docs.sparkSession), -(-size // RANGE_BYTES))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")


_DIGEST = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_EDGE = [("part", pa.int32()), ("first_text", pa.string()), ("last_id", pa.int64()), ("last_text", pa.string())]
_ROW = pa.schema(_DIGEST + _EDGE)
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string"}


def _schema(fields: list) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in fields)


class _Chain:
    """Digests of documents that follow each other; a document's row comes once the next one is there."""

    def __init__(self) -> None:
        self.held: tuple | None = None  # id, text, parse, fingerprint

    def follow(self, ids: list, texts: list) -> list[tuple]:
        jobs: list[tuple[bytes, np.ndarray]] = []
        rows, again = [], None
        before = self.held
        for i, t in zip(ids, texts, strict=True):
            if before and before[1] == t:  # its parse and fingerprint hold
                now = (i, t, *before[2:])
            else:
                k = len(t) // 2
                head, tail = to_bytes(t[: len(t) - k]), to_bytes(t[len(t) - k :])
                parse = Parse(head, tail)
                jobs.append((head + tail, parse.ends))
                now = (i, t, parse, len(jobs) - 1)
            if before:
                new = edit(before[1], t)
                if new == before[1]:
                    edited = None
                elif again and again[0] is before[2] and again[1] == new:
                    edited = again[2]
                else:
                    raw = to_bytes(new)
                    jobs.append((raw, before[2].follow(raw[len(before[2].head) :])))
                    edited = len(jobs) - 1
                    again = before[2], new, edited
                rows.append((before, edited, now[3], hashlib.sha256(to_bytes(new)).hexdigest()))
            before = now
        marks = [smallest(h) for h in hashes(jobs)]
        named = lambda x: x if isinstance(x, str) else marks[x]
        out = []
        for (i, t, _, own), edited, following, sha in rows:
            own = named(own)
            mark = own if edited is None else marks[edited]
            out.append((i, len(t), sha, own, mark, likeness(own, mark), likeness(own, named(following))))
        self.held = before and (*before[:3], named(before[3]))
        return out


def _ranges(batches: Batches) -> Batches:
    """Digests of all documents of a range but its last, and a row of what neighbouring ranges need: its first text, its last id and text."""
    chain, first, part = _Chain(), None, None
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            some = b.slice(lo, ROWS)
            ids, texts = some.column(1).to_pylist(), some.column(2).to_pylist()
            if first is None:
                first, part = texts[0], some.column(0)[0].as_py()
            out = chain.follow(ids, texts)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r, strict=False)) for r in out], schema=_ROW)
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "first_text": first, "last_id": chain.held[0], "last_text": chain.held[1]}], schema=_ROW)


def _pairs(batches: Batches) -> Batches:
    """Digests of documents, each beside the text of the next one."""
    for b in batches:
        rows = [_row_of(i, t, following) for i, t, following in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r, strict=False)) for r in rows], schema=pa.schema(_DIGEST))


def _row_of(i: int | None, text: str, following: str) -> tuple:
    return _Chain().follow([i, None], [text, following])[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text takes its second half from the
    next document by descending doc_id (null ids last, rows of one id by a
    hash of their text); after the last comes the first. Null texts are empty;
    other columns are not read; one row out per row in; a lone document
    follows itself; an empty table gives no rows. A task streams its range
    and holds ROWS texts; of equal texts in a row one is parsed. A range's
    last document meets the first of the next range in a join of one row a
    range; nothing that grows with the input comes to the driver.
    """
    found = stash(dealt(docs).mapInArrow(freeing(_ranges), _schema(_DIGEST + _EDGE)), batch_rows=ROWS)
    columns = [n for n, _ in _DIGEST]
    inner = found.where("part is null").select(columns)
    edges = found.where("part is not null").select([n for n, _ in _EDGE])
    parts = edges.select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))  # numbers of ranges only
    turns = parts.select("part", following.alias("next"))
    heads = edges.select(F.col("part").alias("next"), "first_text")
    pairs = edges.select("part", "last_id", "last_text").join(turns.hint("merge"), "part").join(heads.hint("merge"), "next").select("last_id", "last_text", "first_text")
    return inner.unionByName(stash(pairs.mapInArrow(freeing(_pairs), _schema(_DIGEST)), batch_rows=ROWS))
