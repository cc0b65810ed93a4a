"""Operator 7, token counts, and the encoder that packing shares.

Encoding is cached by pre-token. The vocabulary's tokenizer cuts a text into
pre-tokens that never hold white space and never interact, so a text's ids are
its pre-tokens' ids in a row. A batch of texts is cut with array operations,
its distinct pre-tokens (by a 64-bit hash) are looked up in a bounded table of
a worker's own, and those not met before are encoded together by the library.
Texts with an unsafe character (where the normaliser could do more than
lower-casing) or with a special token's string go to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BATCH_ROWS, by_bytes, freeing, stash
from codeloom.llm.hashing import numbers, run_hashes

#: Bytes of text that one batch holds, and that a long text is cut to.
BATCH_BYTES, PIECE_CHARS = 1 << 20, 1 << 16
#: Pre-tokens kept by a worker; beyond it the table starts anew.
CACHE_WORDS = 300_000
#: The one rule that CachedEncoder cuts by; fixed values of the tokenizer file's format. Any other file is the library's alone.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
KNOWN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Kinds of characters: white space, letters, numbers, others; the rest only the library handles.
BLANK, LETTER, NUMBER, OTHER, UNSAFE = 0, 1, 2, 3, 9
#: Characters from here on are unsafe.
SAFE_END = 0x250


def _kinds() -> np.ndarray:
    """Kind of each character below SAFE_END after lower-casing; safe ones are those on which the normaliser only lower-cases."""
    kinds = np.full(SAFE_END + 1, UNSAFE, dtype=np.uint8)
    for i in range(SAFE_END):
        c = chr(i)
        kind = unicodedata.category(c)
        if c in "\t\n\v\f\r ":
            kinds[i] = BLANK
        elif kind[0] in "CZ" or unicodedata.normalize("NFC", c) != c or len(c.lower()) != 1 or ord(c.lower()) >= SAFE_END:
            continue
        else:
            kinds[i] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    return kinds


KINDS = _kinds()
_VALUES = numbers(SAFE_END + 1)


def cut_words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of safe, lower-cased code points: starts, ends, 64-bit hashes.

    A pre-token is a run of letters, one number, a run of others, or a quote
    with s, t, re, ve, m, ll or d where the quote is a run of its own.
    """
    n = len(cp)
    kind = np.zeros(n + 4, dtype=np.uint8)
    kind[1 : n + 1] = KINDS[cp]
    own, before = kind[1:], kind[:-1]  # own[n:] are blanks
    start = (own != BLANK) & ((own != before) | (own == NUMBER))
    for i in np.flatnonzero((cp == 39) & (before[:n] != OTHER) & (own[1 : n + 1] == LETTER)).tolist():
        tail = cp[i + 1 : i + 3].tolist()
        size = 2 if chr(tail[0]) in "stmd" else 3 if tail in ([114, 101], [118, 101], [108, 108]) else 0
        if size:
            start[i + 1] = False
            start[i + size] = own[i + size] == LETTER
    end = np.flatnonzero((own[:n] != BLANK) & ((own[1 : n + 1] == BLANK) | start[1 : n + 1])) + 1
    start = np.flatnonzero(start[:n])
    return start, end, run_hashes(_VALUES[cp], start, end)


def has_known_rule(path: str) -> bool:
    """Whether a tokenizer file normalises and cuts as CachedEncoder does and changes nothing else on the way."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    bytes_rule = {k: v for k, v in pre[-1].items() if k != "trim_offsets"}
    plain = not any(d.get(k) for k in ("truncation", "padding")) and not any(a[k] for a in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return plain and d.get("normalizer") == KNOWN_NORMALIZER and pre[:-1] == [KNOWN_SPLIT] and bytes_rule == KNOWN_BYTES and d["model"].get("end_of_word_suffix") == "</w>"


class LibraryEncoder:
    """Ids of whole texts by the file's own library: tokenizers for .json, sentencepiece for .model."""

    piece_chars: int | None = None  # nothing is known of where a text may be cut

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: model.encode(texts, num_threads=1)
        else:
            import tokenizers

            t = tokenizers.Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self._ids = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(x, dtype="<u4") for x in self._ids(pieces)]


class CachedEncoder:
    """Ids of texts as the library gives them, for files that have the known rule."""

    piece_chars: int | None = PIECE_CHARS

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import tokenizers
        from tokenizers import pre_tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # one pre-token per blank: no pattern matching for text that is cut already
        self.words = tokenizers.Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.array([(self.whole.id_to_token(i) or "").endswith("</w>") for i in range(self.whole.get_vocab_size())])
        self.cache_words = cache_words
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)  # sorted hashes
        self.at = np.empty(0, dtype=np.int64)  # where a word's ids begin in flat
        self.size = np.empty(0, dtype=np.int32)
        self.flat = np.empty(0, dtype="<u4")

    def is_safe(self, text: str) -> bool:
        return not any(s in text for s in self.specials)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        ids, sizes = [], []
        for k in range(0, len(words), 64):
            part = words[k : k + 64]
            got = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            size = np.diff(np.flatnonzero(self.ends[got]) + 1, prepend=0)
            if len(size) != len(part):  # a vocabulary that does not mark word ends so
                each = [self.whole.encode(w, add_special_tokens=False).ids for w in part]
                got, size = np.array(sum(each, []), dtype="<u4"), np.array([len(x) for x in each])
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key in the cache, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, self.keys[place] == keys

    def learn(self, text: str, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """keys: sorted and distinct; their words are text[start:end]."""
        if len(self.keys) + len(keys) > self.cache_words:
            self.forget()
        _, known = self.find(keys)
        new = np.flatnonzero(~known)
        if not len(new):
            return
        ids, size = self.word_ids([text[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, ids))
        where = np.searchsorted(self.keys, keys[new])
        self.keys, self.at, self.size = np.insert(self.keys, where, keys[new]), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        rest = [i for i, p in enumerate(pieces) if not self.is_safe(p)]
        take = sorted({*range(len(pieces))} - {*rest})
        lower = [pieces[i].lower() for i in take]
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in lower]
        good = [len(r) == len(pieces[i]) and (not len(r) or (r.max() < SAFE_END and KINDS[r].max() != UNSAFE)) for i, r in zip(take, raw, strict=True)]
        rest += [i for i, g in zip(take, good, strict=True) if not g]
        lower, raw, take = ([x for x, g in zip(xs, good, strict=True) if g] for xs in (lower, raw, take))
        if take:
            blank = np.array([32], dtype=np.uint32)
            cp = np.concatenate([x for r in raw for x in (r, blank)])
            begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
            start, end, h = cut_words(cp)
            keys, first, back = np.unique(h, return_index=True, return_inverse=True)
            text = " ".join(lower)
            self.learn(text, keys, start[first], end[first])
            place, known = self.find(keys)
            at, size = self.at[place][back], self.size[place][back].astype(np.int64)
            stop = np.cumsum(size)
            ids = self.flat[np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
            cuts = np.concatenate(([0], stop))[np.searchsorted(start, begin)]
            for k, i in enumerate(take):
                out[i] = ids[cuts[k] : cuts[k + 1]]
        if rest:
            for i, e in zip(rest, self.whole.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, dtype="<u4")
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder | LibraryEncoder:
    """One per worker process."""
    return CachedEncoder(path) if path.endswith(".json") and has_known_rule(path) else LibraryEncoder(path)


_BLANK = re.compile(r"[\t\n\v\f\r ]")


def split_safely(text: str, most: int | None = PIECE_CHARS) -> Iterator[str]:
    """Pieces of about `most` characters, cut before ASCII white space only.

    No pre-token holds white space and nothing composes with it, so the pieces'
    ids in a row are the text's. Without white space, or if `most` is None, a
    text stays whole.
    """
    at = 0
    while most and len(text) - at > most:
        found = _BLANK.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def byte_batches(texts: Iterable[str], most: int = BATCH_BYTES, piece: int | None = PIECE_CHARS) -> Iterator[list[tuple[int, str]]]:
    """(text number, piece) in batches of about `most` characters, so that each call gets like work."""
    batch, held = [], 0
    for i, t in enumerate(texts):
        for part in split_safely(t, piece):
            batch.append((i, part))
            held += len(part)
            if held >= most:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def encode_texts(enc: CachedEncoder | LibraryEncoder, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, ids) piece by piece, in order."""
    for batch in byte_batches(texts, piece=enc.piece_chars):
        for (i, _), ids in zip(batch, enc.encode([p for _, p in batch]), strict=True):
            yield i, ids


def token_counts(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text: key, n_bytes, n_tokens, over_limit (more than `limit`).

    Null texts are empty (0 bytes, 0 tokens); keys may be null or repeat, one
    row out per row in; other columns of `docs` are not read. An empty table
    gives no rows. Map-only: no shuffle, one Arrow pass, lengths come back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in by_bytes(batches, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = np.zeros(len(texts), dtype=np.int64)
            for i, ids in encode_texts(enc, texts):
                n[i] += len(ids)
            sizes = np.fromiter((len(t.encode()) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=["k", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(freeing(count), f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return stash(out.withColumnRenamed("k", key), batch_rows=BATCH_ROWS)
