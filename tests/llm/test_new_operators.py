"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from codeloom.llm import chat, hardneg, lzprint, periodic, queries, sharding, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 11: sharding ---


def brute_shards(rows, n):
    """(doc_id, size, crc, shard, slot) as a multiset, in the global order."""
    sized = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows]
    sized.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    total, start, out, slots = sum(s for _, s, _ in sized), 0, [], defaultdict(int)
    for i, s, c in sized:
        shard = min(n - 1, n * (2 * start + s) // (2 * total))
        out.append((i, s, c, shard, slots[shard]))
        slots[shard] += 1
        start += s
    return out


def shard_rows(df):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()), key=repr)


def test_shards_equal_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "é" * rng.randint(0, 80)) for i in range(300)]
    rows += [(None, "lost"), (None, None), (5, "again"), (5, "again"), (7, None), (8, ""), *[(1000, "copy") for _ in range(200)]]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in rows], "doc_id long, text string, size int, shard string, slot int")
    got = shard_rows(sharding.assign(table, 7))
    assert got == sorted(brute_shards(rows, 7), key=repr)
    assert got == shard_rows(sharding.assign(table.repartition(9), 7))  # the order depends on the rows alone
    sizes = defaultdict(int)
    for _, s, _, shard, _ in got:
        sizes[shard] += s
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(s for _, s, *_ in got)
    sharding.write(table, str(tmp_path / "out"), 7)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.select("document.*").columns == table.columns
    assert sorted(((r.document.doc_id, r.shard, r.slot) for r in back.collect()), key=repr) == sorted(((i, s, k) for i, _, _, s, k in got), key=repr)


def test_shards_of_few_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(empty).count() == 0
    rows = [(1, "x" * 5_000_000), (2, "a"), (3, "b")]
    one = spark.createDataFrame(rows, "doc_id long, text string")
    assert shard_rows(sharding.assign(one, 40)) == sorted(brute_shards(rows, 40), key=repr)
    assert {r.law for r in sharding.assign(one).collect()} == {"bytes"}
    with pytest.raises(ValueError):
        sharding.assign(one, 0)


def test_shards_take_no_python(spark):
    table = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = sharding.assign(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan


# --- 12: hard negatives ---


def brute_negatives(rows, every, scale, positives, k, low, high):
    sound = [(i, lab, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (i, lab, v) in enumerate(sound):
        if i % every:
            continue
        scored = sorted(((-dot(v, w), j, other) for m, (j, other, w) in enumerate(sound) if m != n))
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            fit = [(x, y) for x, y, other in scored if other != lab and low * -s <= 100 * -x <= high * -s][:k]
            out += [(i, j, r + 1, y, -s, -x) for r, (x, y) in enumerate(fit)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, row string, v int"


def mined(spark, rows, **how):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hardneg.negatives(table, **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_NUMBERS", 400)  # many blocks
    monkeypatch.setattr(hardneg, "PAIRS", 50)
    monkeypatch.setattr(hardneg, "ANCHORS", 4)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 9))
    rows = [(int(i), (centres[i % 4] + rng.normal(size=9) * 0.4).tolist(), int(i % 4)) for i in range(200)]
    rows += [(300 + i, rows[0][1], i % 2) for i in range(20)]  # ties
    rows += [(20, rows[3][1], 3), (20, rows[3][1], 3), (None, rows[1][1], 1), (401, None, 1), (402, [1.0, None], 1), (403, [float("nan")] * 9, 1), (404, [float("inf")] * 9, 1), (405, rows[1][1], None)]
    rows += [(500, [], 1), (501, [0.5], 2), (520, [0.0] * 9, 2), (540, [-x for x in rows[0][1]], 0), (560, [1.0, 2.0], 9)]
    how = {"every": 20, "scale": 64, "positives": 3, "k": 4, "low": 80, "high": 100}
    assert mined(spark, rows, **how) == brute_negatives(rows, **how) != []


def test_negatives_of_large_numbers_and_none(spark):
    how = {"every": 2, "scale": 256, "positives": 5, "k": 5, "low": 80, "high": 100}
    rows = [(2, [3e6, 1e6], 0), (3, [3e6, 1.0], 0), (4, [2.9e6, 0.0], 1), (5, [2.5e6, 7.0], 1)]
    assert mined(spark, rows, **how) == brute_negatives(rows, **how) != []
    assert mined(spark, [], **how) == [] == mined(spark, [(2, None, 1)], **how) == mined(spark, [(2, [], 1)], **how)
    blank = [(2, [], 1), (3, [], 1), (5, [], 2)]
    assert mined(spark, blank, **how) == brute_negatives(blank, **how) == [(2, 3, 1, 5, 0, 0)]
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(2, [1e8] * 2, 0), (4, [1e8] * 2, 0)], **how)


def test_rotation_is_orthogonal_and_bounds_discard(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 16)) * np.array([40] + [1] * 15)
    table = spark.createDataFrame([(i, [int(c * 100) for c in r]) for i, r in enumerate(x)], "vec_id long, v array<long>")
    turn = hardneg.rotation(table, 16)
    assert np.allclose(turn.T @ turn, np.eye(16))
    a = hardneg.Vectors((x[:5] * 100).astype(np.int64), turn)
    rows = hardneg.Vectors((x * 100).astype(np.int64), turn)
    want = a.x @ rows.x.T
    bound = np.sort(want, axis=1)[:, -3]
    p, q, score = hardneg.bounded(a, rows, np.arange(5), np.arange(500), lambda p, low, high: high >= bound[p])
    assert (score == want[p, q]).all() and len(p) < 5 * 500 / 2
    assert {(int(i), int(j)) for i, j in zip(p, q, strict=True)} >= {(int(i), int(j)) for i, j in zip(*np.nonzero(want >= bound[:, None]), strict=True)}


# --- 13: runs ---


def brute_runs(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            seg = w[s : i + q]
            if len(seg) >= max(least, times * q) and not any(seg[d:] == seg[:-d] for d in range(1, q)):
                out.append((s, len(seg), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(250):
        words = [rng.choice("ab") * rng.randint(1, 2) if rng.random() < 0.5 else rng.choice(["x", "é", "日本", "z."]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            words += [rng.choice("abc") for _ in range(rng.randint(1, 4))] * rng.randint(2, 9)
        rows.append((i, rng.choice([" ", "\t", "\n ", "\x0b", "\x0c\r"]).join(words)))
    rows += [(None, "a b a b a b a b"), (9001, None), (9002, ""), (9003, " \n\t "), (9004, "a\xa0a\xa0a b"), (5, "one two"), (5, "one two"), (9005, "k " * 6), (9006, "k " * 5)]
    rows += [(9007, " ".join(f"w{i}" for i in range(3000)) + " p q r" * 900), (9008, "copy copy copy copy copy copy")] + [(9009, "copy copy copy copy copy copy")] * 30
    table = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, runs string, h int, key long").repartition(5)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in periodic.repeats(table).collect()), key=repr)
    assert got == sorted((brute_row(*r) for r in rows), key=repr)
    assert sum(r[1] for r in got) > 100
    plain = {r.doc_id: r for r in periodic.runs(table).where("doc_id in (9005, 9001, 9007)").collect()}
    assert plain[9005].collapsed == "k" and plain[9001].runs == [] and plain[9007].collapsed.endswith("w2999 p q r")
    assert periodic.repeats(table.limit(0)).count() == 0


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (4, 3)])
def test_all_runs_of_small_alphabets(least, times):
    rng = random.Random(times)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            k = rng.randint(0, 2)
            t = [rng.randint(0, k) for _ in range(rng.randint(0, 14))]
            for _ in range(rng.randint(0, 3)):
                t += ([rng.randint(0, k) for _ in range(rng.randint(1, 4))] * 8)[: rng.randint(4, 30)]
            texts.append(t)
        of, start, length, period = periodic.find_runs(np.array([x for t in texts for x in t], dtype=np.int64), np.array([len(t) for t in texts]), least, times)
        for d, t in enumerate(texts):
            assert [(int(a), int(b), int(c)) for o, a, b, c in zip(of, start, length, period, strict=True) if o == d] == brute_runs(t, least, times)


def test_next_smaller_by_its_stack():
    rng = np.random.default_rng(1)
    for values in (rng.permutation(300), np.concatenate(([0], np.arange(300, 0, -1)))):  # the latter takes more rounds than are jumped
        want = [next((j for j in range(i + 1, len(values)) if values[j] < values[i]), len(values)) for i in range(len(values))]
        assert periodic.next_smaller(values.astype(np.int64)).tolist() == want


def test_new_queries_are_registered(spark):
    assert {"op11_sharding", "op12_hard_negatives", "op13_periodic_runs"} <= set(queries.QUERIES)


# --- large ids beside a null, empty vectors ---

BIG = 1 << 60


def test_conversations_of_large_ids_beside_a_null(spark):
    rows = [(BIG + i, 0, "assistant", f"t{i}") for i in range(12)] + [(None, 0, "user", "lost"), (None, 1, "assistant", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.conversations(table).collect()}
    assert got == {**{BIG + i: (1, len(f"t{i}")) for i in range(12)}, None: (2, 1)}


def test_a_conversation_longer_than_a_batch(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"[{i}]") for i in range(25_000)] + [(2, 0, "user", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.conversations(table).collect()}
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:-1])
    assert got[1].n_turns == 25_000 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[2].n_turns == 1


def test_fingerprints_of_large_ids_beside_a_null(spark):
    rows = [(BIG + i, f"text {i} of some words " * (i + 1)) for i in range(9)] + [(None, "lost text"), (None, None), (BIG + 4, "again"), (-BIG, "first")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = sorted(rows[:9] + rows[11:], key=lambda r: -r[0])
    got = {(r.doc_id, r.fingerprint): r for r in lzprint.fingerprints(table.repartition(3)).collect()}
    assert sorted((i, f) for i, f in got if i is not None) == sorted((i, lzprint.fingerprint(t)) for i, t in ordered)
    known = [(i, t) for i, t in ordered if i != BIG + 4]
    for (i, t), (j, following) in zip(known, known[1:], strict=False):
        if ordered[ordered.index((i, t)) + 1] == (j, following):
            r = got[i, lzprint.fingerprint(t)]
            assert r.edited_sha256 == hashlib.sha256(lzprint.edit(t, following).encode()).hexdigest()
            assert r.near_next == lzprint.likeness(lzprint.fingerprint(t), lzprint.fingerprint(following))


def test_top_k_of_empty_vectors(spark):
    rows = [(20, []), (40, [])]
    table = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(table(rows)).orderBy("query_id").collect()] == [(20, 1, 40, 0), (40, 1, 20, 0)]
    rows += [(60, [1.0, -2.0]), (61, [0.5])]
    want = {(20, 0), (40, 0), (61, 32)}
    assert {(r.vec_id, r.score) for r in topk.top_k(table(rows), block_rows=1).where("query_id = 60").collect()} == {(i, 64 * s) for i, s in want}


# --- 2: the chain against plain Python ---


def _plain_features(text):
    out = set()
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode()):
        out |= {(0, w), *((k, w[:k]) for k in (4, 5, 6) if len(w) > k)}
    return out


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def _solve(m, v):
    m = [[*r, c] for r, c in zip(m, v, strict=True)]
    n = len(m)
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(n):
            if r != i and m[r][i]:
                f = m[r][i] / m[i][i]
                m[r] = [a - f * b for a, b in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def _sigmoid(z):
    return 1 / (1 + np.exp(-min(30, max(-30, z))))


def _plain_fit(x, y, l2):
    d = len(x[0])
    if not y or min(y) == max(y):
        return [0.0] * d + [30.0 if y and y[0] else -30.0]
    x = [[*r, 1.0] for r in x]
    penalty = [l2 * len(x)] * d + [1e-9]
    w = [0.0] * (d + 1)
    loss = lambda v: sum(np.logaddexp(0, (-1 if t else 1) * _dot(r, v)) for r, t in zip(x, y, strict=True)) + sum(p * a * a for p, a in zip(penalty, v, strict=True)) / 2
    for _ in range(30):
        p = [_sigmoid(_dot(r, w)) for r in x]
        curve = [[sum(max(q * (1 - q), 1e-6) * r[i] * r[j] for q, r in zip(p, x, strict=True)) + (penalty[i] if i == j else 0) for j in range(d + 1)] for i in range(d + 1)]
        slope = [sum((q - t) * r[i] for q, t, r in zip(p, y, x, strict=True)) + penalty[i] * w[i] for i in range(d + 1)]
        step, size = _solve(curve, slope), 1.0
        while size > 1e-3 and loss([a - size * b for a, b in zip(w, step, strict=True)]) > loss(w):
            size /= 2
        if size <= 1e-3:
            break
        w = [a - size * b for a, b in zip(w, step, strict=True)]
    return w


def _plain_chain(rows, labels):
    """(p_quality, p_toxic, threshold) by loops over dense rows, with the operator's folds and penalties."""
    known = [(i, t, labels[i]) for i, t in rows if i in labels and t is not None]
    counts = [defaultdict(lambda: [0, 0]) for _ in range(2)]
    for _, t, y in known:
        for f in _plain_features(t):
            for k in range(2):
                counts[k][f][y[k]] += 1
    kept = sorted({f for c in counts for f, (a, b) in c.items() if a + b >= 5})
    vector = lambda t: [float(f in held) for held in [_plain_features(t)] for f in kept]
    x, fold = [vector(t) for _, t, _ in known], [((i * 0x9E3779B97F4A7C15) % (1 << 64) >> 33) % 4 for i, _, _ in known]
    every, weights, threshold = [vector(t) for _, t in rows], [], 0.5
    outs = []
    for k in range(2):
        y, best = [r[2][k] for r in known], None
        for l2 in (3e-5, 3e-4, 3e-3):
            out = [0.0] * len(x)
            for f in set(fold):
                w = _plain_fit([r for r, g in zip(x, fold, strict=True) if g != f], [t for t, g in zip(y, fold, strict=True) if g != f], l2)
                for n, g in enumerate(fold):
                    if g == f:
                        out[n] = _sigmoid(_dot([*x[n], 1.0], w))
            loss = -sum(np.log(max(1e-9, p if t else 1 - p)) for p, t in zip(out, y, strict=True)) / len(y)
            if best is None or loss < best[0]:
                best = loss, l2, out
        w = _plain_fit(x, y, best[1])
        outs.append([_sigmoid(_dot([*r, 1.0], w)) for r in every])
        x = [[*r, p] for r, p in zip(x, best[2], strict=True)]
        every = [[*r, p] for r, p in zip(every, outs[-1], strict=True)]
        ranked = sorted(zip(best[2], y, strict=True), reverse=True)
        score = lambda n: 2 * sum(t for _, t in ranked[:n]) / (n + sum(t for _, t in ranked))  # noqa: B023, E731
        top = max(range(1, len(ranked) + 1), key=lambda n: (score(n) if n == len(ranked) or ranked[n - 1][0] > ranked[n][0] else -1, -n))  # noqa: B023
        threshold = (ranked[top - 1][0] + (ranked[top][0] if top < len(ranked) else 0.0)) / 2
        weights.append(w)
    return outs, threshold


def test_the_chain_equals_a_plain_one(spark):
    rng = random.Random(6)
    rows, labels = [], {}
    for i in range(90):
        bad, poor = rng.random() < 0.4, rng.random() < 0.5
        words = [rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randint(1, 6))] + ["vile"] * (bad and rng.random() < 0.9) + ["spamming"] * (poor and rng.random() < 0.8)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i < 70:
            labels[i] = (int(not poor), int(bad))
    rows += [(200, ""), (201, "VILE é spamming"), (201, "VILE é spamming"), (202, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.train(d, spark.createDataFrame([(i, *y) for i, y in labels.items()], "doc_id long, quality int, toxic int"))
    (quality, toxic), threshold = _plain_chain(rows, labels)
    got = sorted((r.doc_id, r.p_quality, r.p_toxic, r.rejected) for r in toxicity.score(d, chain).collect())
    want = sorted((i, q, t) for (i, _), q, t in zip(rows, quality, toxic, strict=True))
    for (i, q, t, rejected), (j, q2, t2) in zip(got, want, strict=True):
        assert i == j and abs(q - q2) < 0.01 and abs(t - t2) < 0.01, (i, q, q2, t, t2)
        assert rejected == (t2 > threshold) or abs(t2 - threshold) < 0.02
    assert abs(chain.threshold - threshold) < 0.02 and sum(r[3] for r in got) > 20
