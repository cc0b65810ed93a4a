"""Operator 2, toxicity by a classifier chain.

The chain predicts the labels' categories one after another: each is a
logistic model over hashed word features and the probabilities of the
categories before it. The later models are fitted on out-of-fold
probabilities, so that they see earlier ones as unreliable as they will be on
new documents. Each model's penalty, and the probability from which the last
category rejects, are chosen on out-of-fold predictions too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BATCH_ROWS, by_bytes, freeing, stash
from codeloom.llm.hashing import numbers, run_hasher

#: Categories in the chain's order: those of them that the labels have; the last rejects.
CATEGORIES = ("quality", "toxic")
#: Labelled rows that are used at most, chosen by a hash of the id; features kept for each category; feature space; folds.
MAX_LABELLED, FEATURES, SPACE, FOLDS = 6_000, 256, 1 << 20, 4
#: Penalties to choose from, as a share of the loss.
PENALTIES = (3e-5, 3e-4, 3e-3)
#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)
#: Bytes of text handled at a time.
CHUNK = 1 << 20

_VALUES = numbers(256)
#: Bytes of words: ASCII letters and digits, and all of other characters.
_IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts, lower-cased, in parts of about CHUNK bytes; a longer text is cut between words."""
    at, parts, held = [], [], 0
    for i, t in enumerate(texts):
        raw = t.lower().encode("utf-8", "surrogatepass")
        lo = 0
        while lo < len(raw) or not lo:
            hi = min(len(raw), lo + CHUNK)
            while hi < len(raw) and _IN_WORD[raw[hi]]:
                hi += 1
            at.append(i)
            parts.append(raw[lo:hi])
            held += hi - lo
            if held >= CHUNK:
                yield at, parts
                at, parts, held = [], [], 0
            lo = max(hi, 1)
    if at:
        yield at, parts


def features(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each distinct feature of each text, sorted; only those with keep[feature], if given.

    A feature is a word or a word's beginning, hashed into SPACE; how often it
    comes does not count, so length alone does not move a score.
    """
    found = [np.empty(0, dtype=np.int64)]
    for at, parts in _pieces(texts):
        data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[1:] = _IN_WORD[data]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashed = run_hasher(_VALUES[data])
        begin = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        doc = np.asarray(at, dtype=np.int64)[np.searchsorted(begin, start, side="right") - 1]
        for kind, size in enumerate((0, *PREFIXES)):
            long = slice(None) if not size else end - start > size
            s, d = start[long], doc[long]
            e = end[long] if not size else s + size
            f = (hashed(s, e, 1 + kind) % np.uint64(SPACE)).astype(np.int64)
            if keep is not None:
                wanted = keep[f]
                f, d = f[wanted], d[wanted]
            found.append(np.unique(d * SPACE + f))
    both = np.unique(np.concatenate(found))
    return both // SPACE, both % SPACE


# --- models --------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 3e-4, rounds: int = 12) -> np.ndarray:
    """Weights, the intercept last: L2-regularised logistic loss by Newton's method. Rows of one kind only give that kind for certain."""
    w = np.zeros(x.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        w[-1] = 30.0 if len(y) and y[0] > 0 else -30.0
        return w
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    penalty = np.full(x.shape[1], l2 * len(x))
    penalty[-1] = 1e-9
    loss = lambda v: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v)).sum() + (penalty * v * v).sum() / 2
    now = loss(w)
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None].astype(x.dtype)).T @ x
        step = np.linalg.solve(curve + np.diag(penalty), x.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-3 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-3:
            break
        w, gain, now = w - size * step, now - new, new
        if gain < 1e-6 * now:
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability above which to reject so that the harmonic mean of precision and recall is highest; in the middle of the gap where it lies."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f[:-1][p[:-1] == p[1:]] = -1  # equal probabilities go together
    k = int(np.argmax(f))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


@dataclass
class Chain:
    """names: categories in order; kept: the features; weights[i]: over the features, then i earlier probabilities, then the intercept; threshold: of the last."""

    names: list[str]
    kept: np.ndarray
    weights: list[np.ndarray]
    threshold: float = 0.5

    @classmethod
    def fit(cls, names: list[str], kept: np.ndarray, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
        """y: a column for each category, -1 where not known. Earlier probabilities come from the folds that a row is not in."""
        weights, earlier, threshold = [], x[:, :0], 0.5
        for k in range(len(names)):
            inputs, own = np.hstack([x, earlier]), y[:, k]
            known = own >= 0
            best = None
            for l2 in PENALTIES:
                out = np.zeros(len(x))
                for f in np.unique(fold):
                    fit = known & (fold != f)
                    out[fold == f] = predict(fit_logistic(inputs[fit], own[fit], l2), inputs[fold == f])
                loss = -np.log(np.clip(np.where(own > 0, out, 1 - out), 1e-9, 1))[known].mean() if known.any() else 0.0
                if best is None or loss < best[0]:
                    best = loss, l2, out
            weights.append(fit_logistic(inputs[known], own[known], best[1]))
            earlier = np.hstack([earlier, best[2][:, None].astype(x.dtype)])
            if (own > 0).any():
                threshold = _best_threshold(best[2][known], own[known])
        return cls(names, kept, weights, threshold)

    def apply(self, texts: list[str]) -> np.ndarray:
        """Probability of each category for each text."""
        keep = np.zeros(SPACE, dtype=bool)
        keep[self.kept] = True
        doc, f = features(texts, keep)
        place = np.searchsorted(self.kept, f)
        out = np.zeros((len(texts), 0))
        for w in self.weights:
            z = np.bincount(doc, weights=w[: len(self.kept)][place], minlength=len(texts)) + out @ w[len(self.kept) : -1] + w[-1]
            out = np.hstack([out, _sigmoid(z)[:, None]])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, max_labelled: int = MAX_LABELLED) -> Chain:
    """Fit the chain on labelled documents.

    At most `max_labelled` labelled ids, those with the smallest hash, and as
    many rows are used; all corpus text stays on the executors. For each
    category the FEATURES with the largest association (of either sign) are
    kept, from counts summed over the executors. Rows without text teach
    nothing, nor does a category that is null or contradicting for an id.
    Where the last category has not both kinds of rows the chain gives
    probability 0 and rejects nothing. Ties go by id and feature number.
    """
    names = [c for c in categories if c in labels.columns]
    value = [F.when(F.min(c) == F.max(c), F.min(c)).cast("int").alias(f"y{k}") for k, c in enumerate(names)]
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(*value)
    ys = F.array(*[F.coalesce(f"y{k}", F.lit(-1)) for k in range(len(names))])
    chosen = one.where(F.col(f"y{len(names) - 1}").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", ys.alias("y"))
    chosen = F.broadcast(stash(chosen))  # bounded by max_labelled
    sample = stash(docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 2, SPACE), dtype=np.int64)
        rows = np.zeros((len(names), 2), dtype=np.int64)
        for b in by_bytes(batches):
            y = np.array(b.column(1).to_pylist(), dtype=np.int64)
            doc, f = features(b.column(0).to_pylist())
            for k in range(len(names)):
                for v in (0, 1):
                    rows[k, v] += (y[:, k] == v).sum()
                    total[k, v] += np.bincount(f[y[doc, k] == v], minlength=SPACE)
        for k in range(len(names)):
            at = np.flatnonzero(total[k].sum(axis=0))
            a, b = (np.append(total[k, v][at], rows[k, v]) for v in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, k)), pa.array(np.append(at, -1)), pa.array(a), pa.array(b)], names=["k", "f", "a", "b"])

    counts = stash(sample.select("text", "y").mapInArrow(freeing(count), "k long, f long, a long, b long").groupBy("k", "f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), batch_rows=BATCH_ROWS)
    sizes = {r.k: (r.a, r.b) for r in counts.where("f = -1").collect()}
    if not all(sizes.get(len(names) - 1, (0, 0))):
        return Chain(names, np.empty(0, dtype=np.int64), [np.append(np.zeros(k), -30.0) for k in range(len(names))])
    best: set[int] = set()
    for k, (n_a, n_b) in sizes.items():
        rate_a, rate_b = (F.col("a") + 0.5) / (n_a + 1.0), (F.col("b") + 0.5) / (n_b + 1.0)
        pooled = (F.col("a") + F.col("b") + 1.0) / (n_a + n_b + 2.0)
        z = F.abs(rate_b - rate_a) / F.sqrt(pooled * (1 - pooled) * (1 / (n_a + 1) + 1 / (n_b + 1)))
        best |= {r.f for r in counts.where(F.col("k") == k).where("f >= 0 and a + b >= 5").orderBy(z.desc(), "f").limit(FEATURES).collect()}
    kept = np.array(sorted(best), dtype=np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(SPACE, dtype=bool)
        keep[kept] = True
        for b in by_bytes(batches, 1):
            texts = b.column(1).to_pylist()
            doc, f = features(texts, keep)
            cols = np.searchsorted(kept, f)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            each = [cols[cuts[i] : cuts[i + 1]].astype(np.int32) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(each, pa.list_(pa.int32())), b.column(2)], names=["doc_id", "cols", "y"])

    # an id's rows may repeat: the limit bounds what comes to the driver
    found = stash(sample.select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(freeing(rows), "doc_id long, cols array<int>, y array<int>"), batch_rows=BATCH_ROWS)
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "cols").limit(max_labelled).collect()
    x = np.zeros((len(got), len(kept)), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, r.cols] = 1
    y = np.array([r.y for r in got], dtype=np.float32)
    fold = (np.array([r.doc_id for r in got], dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(FOLDS)
    return Chain.fit(names, kept, x, y, fold.astype(np.int64))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def score(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """All columns of docs, then p_<category> for each category and last rejected: the last category's probability is above the threshold, the chain's own by default.

    Null and empty texts have no features; a long text is read whole, in
    parts. A new column whose name docs has already gets underscores after it.
    One row out per row in, repeated ones too; an empty table gives no rows.
    Map-only.
    """
    limit = chain.threshold if threshold is None else threshold
    names: list[str] = []
    for n in [*(f"p_{c}" for c in chain.names), "rejected"]:
        names.append(_free(n, [*docs.columns, *names]))

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, at):
            p = chain.apply([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] > limit)], names=[*b.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(freeing(run), f"{fields}, {', '.join(f'`{n}` double' for n in names[:-1])}, `{names[-1]}` boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the chain, trained on the labels, does not reject, with their columns, whatever their names."""
    chain = train(docs, labels, **how)
    marked = score(docs, chain)
    return stash(marked.where(~F.col(f"`{marked.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns]), batch_rows=BATCH_ROWS)


__all__ = ["Chain", "features", "keep_clean", "score", "train"]
