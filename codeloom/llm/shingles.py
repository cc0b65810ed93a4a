"""Word shingles of whole texts as 64-bit hashes, with array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from codeloom.llm.hashing import numbers, run_hashes, scramble

#: Bytes of text handled at a time.
CHUNK = 1 << 20
_VALUES = numbers(256)
_PLACES = numbers(299)[256:]
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _parts(raws: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in parts of about CHUNK bytes; a longer text is cut at a blank."""
    at, parts, held = [], [], 0
    for i, raw in enumerate(raws):
        lo = 0
        while True:
            hi = min(len(raw), lo + CHUNK)
            while hi < len(raw) and not _BLANK[raw[hi]]:
                hi += 1
            at.append(i)
            parts.append(raw[lo:hi])
            held += hi - lo
            lo = hi
            if held >= CHUNK:
                yield at, parts
                at, parts, held = [], [], 0
            if lo >= len(raw):
                break
    if at:
        yield at, parts


def word_hashes(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, word hash) of every word `[^\\x20\\x09-\\x0D]+` in order, A-Z lower-cased, in batches."""
    for at, parts in _parts(raws):
        data = np.frombuffer(b" ".join(parts).translate(LOWER) + b" ", dtype=np.uint8)
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[1:] = ~_BLANK[data]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        doc = np.asarray(at, dtype=np.int64)[np.searchsorted(begin, start, side="right") - 1]
        yield doc, run_hashes(_VALUES[data], start, end)


def shingle_sets(raws: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Each text's set of distinct shingles, sorted; of a text with fewer words, its whole sequence as one; without words, empty."""
    if not raws:
        return []
    got = list(word_hashes(raws))
    doc, w = np.concatenate([d for d, _ in got]), np.concatenate([h for _, h in got])
    n = np.bincount(doc, minlength=len(raws))
    out: list = [np.empty(0, dtype=np.uint64)] * len(raws)
    if len(w) >= words:
        m = len(w) - words + 1
        s = np.zeros(m, dtype=np.uint64)
        for k in range(words):
            s += w[k : k + m] * _PLACES[k]
        whole = doc[:m] == doc[words - 1 :]
        owner, s = doc[:m][whole], scramble(s[whole])
        cuts = np.searchsorted(owner, np.arange(len(raws) + 1))
        for i in np.flatnonzero(n >= words):
            out[i] = np.unique(s[cuts[i] : cuts[i + 1]])
    first = np.concatenate(([0], np.cumsum(n)))
    for i in np.flatnonzero((n > 0) & (n < words)):
        own = w[first[i] : first[i + 1]]
        out[i] = scramble((own * _PLACES[8 : 8 + len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
    return out
