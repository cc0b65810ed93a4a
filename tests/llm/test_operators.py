"""Nulls, empty and long texts, ties, repeats and empty tables, against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from codeloom.llm import chat, jaccard, lzprint, mixing, packing, template, tokens, topk, toxicity, urlfilter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", None if i % 3 == 0 else f"s{i % 2}", 1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(30)]
    near = [" ".join(w if rng.random() > 0.02 else "new" for w in t.split()) for t in base for _ in range(3)]
    return [*base, *near, *base[:5], None, "", "  \t\n", "one two", "One TWO", "a b c d", "word " * 3000, "x" * 5000]


def test_tokens_equal_the_librarys(spark, texts):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(tokens.default_path())
    extra = ["it's we'll 'S ''s a<|endoftext|>b", "Σίσυφος İ é ½ x²", "don't stop", "A" * 200_000, "日本語 text"]
    all_ = [*texts, *extra]
    got = {r.doc_id: r for r in tokens.token_counts(docs(spark, all_), tokens.default_path()).collect()}
    for i, x in enumerate(all_):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].n_bytes) == (len(want), len((x or "").encode()))
    pieces = defaultdict(list)
    for r in packing.pack(docs(spark, all_), tokens.default_path()).collect():
        pieces[r.doc_id].append(r)
    for i, x in enumerate(all_):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
        rows = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in rows] == list(np.cumsum([0, *(r.length for r in rows)])[:-1]) and sum(r.length for r in rows) == len(ids)
        assert all(r.length & (r.length - 1) == 0 and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)
    assert len({r.sequence_id for rows in pieces.values() for r in rows}) == sum(map(len, pieces.values()))


def test_safe_split():
    text = "ab cd\nef " * 50
    parts = list(tokens.split_safely(text, 7))
    assert "".join(parts) == text and len(parts) > 10


def brute_classes(texts):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    s = [shingles(t) for t in texts]
    up = list(range(len(s)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i)) for i in range(len(s))}


@pytest.mark.parametrize("short", [8, 1])
def test_jaccard_classes(spark, texts, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT", short)  # 1: every column is a long one
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_jaccard_keeps_one_of_each(spark, texts, tmp_path):
    docs(spark, texts).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute_classes(texts).values()})
    assert jaccard.classes(d.limit(0)).count() == 0


def test_mix_meets_targets(spark, texts):
    d = docs(spark, texts)
    rows = mixing.taken(d, block=4).collect()
    size = defaultdict(int)
    source = {r.doc_id: r.source for r in d.collect()}
    for r in rows:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 3 * r.size
        size[source[r.doc_id]] += r.size
    total, order = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 4 for s in order)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken(d, block=4).collect()))
    mixed = mixing.mixed_documents(d, block=4)
    assert mixed.columns == d.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {r.doc_id: r.taken for r in rows if r.taken} == dict(words)
    assert mixing.taken(d.limit(0)).count() == 0


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    got = spark.range(257).select(mixing.permuted(F.col("id"), F.lit(257), F.lit(9)).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(257)) and [r.p for r in got] != list(range(257))


def test_warc_round_trip(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "z" * 300_000, "<p>é</p>", *[f"<html>{i} common body text</html>" * 3 for i in range(40)]]
    rows = [(9 - i if i < 6 else i + 10, f"http://h/{i}\r\n", h, 1) for i, h in enumerate(html)]
    got = {r.page_id: r for r in warc.roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string, archive int")).collect()}
    assert len(got) == len(rows)
    for page, _, h, _ in rows:
        raw = (h or "").encode()
        first = min(p for p, _, x, _ in rows if (x or "") == (h or ""))
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if page == first else ("revisit", first))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.roundtrip(none).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 6)) / 4
    x[40:60] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [float("nan")] * 6), (92, [None] * 6), (93, [0.1])]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7, every=20, block_rows=16, block_queries=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = np.zeros((94, 6), dtype=int)
    q[:90] = np.floor(64 * x)
    q[93, 0] = 6
    valid = [*range(90), 93]
    want = {i: sorted(((j, int(q[i] @ q[j])) for j in valid if j != i), key=lambda t: (-t[1], t[0]))[:7] for i in (0, 20, 40, 60, 80)}
    assert dict(got) == want


def test_top_k_of_large_components(spark):
    rows = [(0, [1.0, 2.0**-6]), (1, [2e6, 0.5]), (2, [3e6, -0.5]), (3, [-2e6, 0.0]), (4, [3e6, 2.0**-6]), (5, [2e6, 1.0]), (20, [2.5e6, -1.0])]
    q = {i: [int(np.floor(64 * c)) for c in v] for i, v in rows}
    want = {i: sorted(((j, sum(a * b for a, b in zip(q[i], q[j], strict=True))) for j in q if j != i), key=lambda t: (-t[1], t[0]))[:4] for i in (0, 20)}
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, every=20, block_rows=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == want
    for big in (1e10, 1e300):  # a score, and a component, beyond 64 bits
        with pytest.raises(Exception, match="64 bits|too large"):
            topk.top_k(spark.createDataFrame([(0, [big]), (1, [big])], "vec_id long, embedding array<double>")).collect()


def test_fingerprints(spark, texts):
    ids = list(range(len(texts)))
    ids[-1] = None
    got = {r.doc_id: r for r in lzprint.fingerprints(docs(spark, texts, ids)).collect()}
    order = [*sorted((i for i in ids if i is not None), reverse=True), None]
    text = {i: t or "" for i, t in zip(ids, texts, strict=True)}
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        new = lzprint.edit(text[i], text[j])
        r = got[i]
        a, b = lzprint.fingerprint(text[i]), lzprint.fingerprint(new)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text[i]), hashlib.sha256(new.encode()).hexdigest(), a, b)
        assert (r.near_edited, r.near_next) == (lzprint.likeness(a, b), lzprint.likeness(a, lzprint.fingerprint(text[j])))
    assert lzprint.fingerprints(docs(spark, texts).limit(0)).count() == 0


def lempel_ziv(raw):
    known, at, ends = set(), 0, []
    for e in range(1, len(raw) + 1):
        if raw[at:e] not in known:
            known.add(raw[at:e])
            ends.append(e)
            at = e
    return ends + ([len(raw)] if at < len(raw) else [])


def test_phrases_are_lempel_ziv():
    for raw in (b"", b"a", b"aaaaaaa", b"abababab", "héé hé".encode() * 9):
        assert list(lzprint.phrase_ends(raw)) == lempel_ziv(raw)


def test_likeness_is_of_the_smallest_hashes_of_both():
    rng = random.Random(4)
    for n, m in ((128, 128), (128, 3), (0, 5), (40, 60)):
        x, y = (sorted(rng.sample(range(300), k)) for k in (n, m))
        both = sorted({*x, *y})[: lzprint.SIZE]
        a, b = ("".join(f"{v:08x}" for v in z) for z in (x, y))
        assert lzprint.likeness(a, b) == sum(v in x and v in y for v in both) / len(both) and lzprint.likeness(a, a) == 1.0


def test_chat(spark):
    rows = [(1, 1, "assistant", "a\\[END]\n[TURN]é"), (1, 0, "user", "</s>[INST]"), (1, 2, None, None), (2, 0, "assistant", None), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in chat.with_probe(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, None, -1}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n</s>[INST]\nassistant\na\\[END]\n[TURN]é\n\n\n") and got[1].loss_sha256 == sha("a\\[END]\n[TURN]é")
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[1].formatted_chars == len(got[1].formatted)


def test_templates():
    t = template.Template("{% set x = 2 * 3 %}{% if 1 == 1 and not false %}{{ 'a' ~ 1 + 1 }}{% else %}no{% endif %}{% for m in ms -%} {{ loop.index }}{{ m['k'] | upper }}{% if not loop.last %},{% endif %}{% endfor %}{{ x }}{# gone #}")
    assert t.render({"ms": [{"k": "p"}, {"k": "q"}]})[0] == "a21P,2Q6"
    assert template.Template("{% if true %}a{% endif %}{{ 'b' | upper }}c").tree == (template.Text("aBc"),)
    for bad in ("{% if x %}", "{{ x.__class__() }}", "{% nothing %}", "{{ x | gone }}", "{{ 1 + }}"):
        with pytest.raises(template.TemplateError):
            template.Template(bad)
    assert template.Template("{{ x.__class__ }}").render({"x": "s"})[0] == ""


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w, bad = rng.choices(words, k=40), i % 6 == 0
        if bad:
            w[rng.randrange(40)] = rng.choice(["idiot", "scum", "loweiab"])
        rows.append((i, " ".join(w)))
        if i < 600:
            labels.append((i, int(bad)))
    d = spark.createDataFrame([*rows, (None, None), (901, "")], "doc_id long, text string")
    chain = toxicity.train(d, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r.rejected for r in toxicity.score(d, chain).collect()}
    held = range(600, 900)
    assert sum(got[i] for i in held if i % 6 == 0) >= 45 and sum(got[i] for i in held if i % 6) <= 5
    assert got[None] is False and got[901] is False
    empty = toxicity.train(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r.rejected for r in toxicity.score(d, empty).collect())


def test_url_filter(spark):
    caps = spark.createDataFrame([(1, "http://u:p@A.b.com:80/x", 10), (1, "http://u:p@A.b.com:80/x", 10), (2, "http://a.b.com", 20), (3, None, 10), (4, "http://b.com/", None), (5, "https://b.com./q", 30), (6, "nonsense", 10)], "page_id long, url string, fetch_day long")
    log = spark.createDataFrame([("b.com", 5, "block"), ("b.com", 15, "allow"), ("B.com", 25, "block"), ("b.com", 25, "block"), ("a.b.com", 20, "block"), (None, 1, "block"), ("c.com", None, "block")], "rule string, day long, action string")
    got = sorted((r.page_id, r.blocked, r.n_rules, r.rule, r.listed_day) for r in urlfilter.evaluate(caps, log).collect())
    assert got == [(1, True, 1, "b.com", 5), (1, True, 1, "b.com", 5), (2, True, 1, "a.b.com", 20), (3, False, 0, None, None), (4, False, 0, None, None), (5, True, 1, "b.com", 25), (6, False, 0, None, None)]
    assert urlfilter.evaluate(caps.limit(0), log).count() == 0


def test_pipeline_stages_keep_the_columns(spark, texts, tmp_path):
    import corpus_pipeline

    d = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 3:
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
    assert now.count() > 0


def test_pipeline_against_brute_force(spark, texts, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=40)) for _ in range(240)]
    toxic = {i for i in range(240) if i % 4 == 0}
    base = [f"idiot {t} scum" if i in toxic else t for i, t in enumerate(base)]
    rows = [*base, *(t + " extra" for t in base[:40]), *texts[-8:]]
    clash = ("rejected", "p_toxic", "c0", "key", "passes", "like", "twice", "runs", "row", "doc", "words")
    made = [(i, t, f"s{i % 2}", len(t or ""), *[f"{c}{i}" for c in clash]) for i, t in enumerate(rows)]
    spark.createDataFrame(made, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))

    # the chain's own verdicts, which must reject most of the planted rows; the rest by brute force
    chain = toxicity.train(d, spark.read.parquet(str(tmp_path / "labels.parquet")))
    p = chain.apply([t or "" for t in rows])[:, -1]
    clean = [i for i in range(len(rows)) if p[i] <= chain.threshold]
    assert len(toxic & set(clean)) <= 6 and 150 < len(clean) < 260
    component = brute_classes([rows[i] for i in clean])
    kept = sorted({clean[c] for _, c in component.values()})
    assert len(kept) < len(clean)

    first = corpus_pipeline.drop_toxic(spark, d, str(tmp_path))
    assert first.columns == d.columns and sorted(map(tuple, first.collect()), key=lambda r: r[0]) == [made[i] for i in clean]
    size = {i: len(WORD.findall(rows[i] or "")) for i in kept}
    left = spark.createDataFrame([made[i] for i in kept], d.schema)
    left.write.parquet(str(tmp_path / "left"))
    mixed = mixing.mixed_documents(spark.read.parquet(str(tmp_path / "left")))
    assert mixed.columns == d.columns
    out = mixed.collect()
    for r in out:
        whole = WORD.findall(rows[r.doc_id])
        assert tuple(r)[4:] == made[r.doc_id][4:] and r.source == made[r.doc_id][2] and r.n_chars == len(r.text)
        it = iter(whole)
        assert r.text == rows[r.doc_id] or all(w in it for w in WORD.findall(r.text))
    # run(): every piece of a clean, single document with words; targets are met to within a block
    t = tokens.default_path()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {i for i in kept if size[i]}
    want = defaultdict(int)
    for r in packing.pack(mixed, t, most=2048).collect():
        want[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.bucket] += 1
    for r in got:
        want[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.bucket] -= 1
    assert got and not any(want.values())
    total, by = sum(size.values()), defaultdict(int)
    source = defaultdict(int)
    for i in kept:
        source[made[i][2]] += size[i]
    for r in out:
        by[r.source] += len(WORD.findall(r.text))
    goal = {"s0": min(3 * source["s0"], total * 5 / 7), "s1": min(3 * source["s1"], total * 2 / 7)}
    assert all(abs(by[s] - goal[s]) <= 64 for s in goal)


def test_other_tokenizers_are_the_librarys(spark, texts):
    import public_tokenizers
    import sentencepiece
    import tokenizers

    assert tokens.has_known_rule(tokens.default_path()) and not tokens.has_known_rule(public_tokenizers.path("byte_bpe_50k.json"))
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    all_ = [*texts, "It's  we'll \n\n x", "a  b" * 40_000]
    for path, ids in ((public_tokenizers.path("byte_bpe_50k.json"), lambda x: t.encode(x, add_special_tokens=False).ids), (public_tokenizers.path("piece_bpe_32k.model"), s.encode)):
        got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs(spark, all_), path).collect()}
        assert got == {i: len(ids(x or "")) for i, x in enumerate(all_)}


def test_tokens_of_empty_and_repeated_rows(spark):
    d = docs(spark, ["a b c", "a b c", None], [7, None, 7])
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens.token_counts(d, tokens.default_path()).collect()) == [("7", 0), ("7", 3), ("None", 3)]
    assert tokens.token_counts(d.limit(0), tokens.default_path()).count() == packing.pack(d.limit(0), tokens.default_path()).count() == 0
    assert sorted((str(r.doc_id), r.doc_tokens) for r in packing.pack(d, tokens.default_path()).collect() if r.start == 0) == [("7", 1), ("7", 4), ("None", 4)]


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.5]), (0, [0.5, 1.0]), (3, [1.0, 1.0]), (3, [0.25, 0.0]), (1, [-1.0, 2.0]), (20, [0.0, 0.0])]
    q = [[int(np.floor(64 * c)) for c in v] for _, v in rows]
    want = []
    for i, (own, _) in enumerate(rows):
        if own % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), rows[j][0]) for j in range(len(rows)) if j != i))[:4]
            want += [(own, k + 1, v, -s) for k, (s, v) in enumerate(best)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, every=20, block_rows=2, block_queries=1).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_jaccard_tiles_and_spanning_links(spark, texts, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(500)]
    base = rng.choices(words, k=90)
    group = [" ".join(w if rng.random() > rng.choice([0.01, 0.03, 0.05]) else rng.choice(words) for w in base) for _ in range(120)]  # around the threshold
    passage = rng.choices(words, k=30)
    shared = [" ".join([*rng.choices(words, k=rng.randint(4, 40)), *passage]) for _ in range(60)]
    all_ = [*group, *shared, *texts]
    want = brute_classes(all_)
    for tile in (4096, 16):  # 16: most tiles hold two parts of a column
        monkeypatch.setattr(jaccard, "TILE", tile)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs(spark, all_)).collect()} == want
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randint(1, 30))], dtype=np.uint64)) for _ in range(60)]
    every = np.arange(60)
    for left, right in ((every, every), (every[:20], every[20:])):
        got = jaccard.spanning_links(every, sets, every.copy(), left, right)
        assert len(got) < 60
        graphs = []
        for links in (got, [(i, j) for i in left for j in right if i != j and 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))]):
            at = list(range(60))
            for _ in range(60):
                for i, j in links:
                    at[i] = at[j] = min(at[i], at[j])
            graphs.append(at)
        assert graphs[0] == graphs[1]


def test_keep_one_with_clashing_columns_and_no_files(spark, texts):
    d = docs(spark, texts).selectExpr("*", "doc_id * 7 as row", "'u' as __row", "1 as s", "2 as c0").repartition(3)
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns
    rows = {tuple(r) for r in d.collect()}
    got = kept.collect()
    assert all(tuple(r) in rows for r in got) and sorted(r.doc_id for r in got) == sorted({c for _, c in brute_classes(texts).values()})


def test_mix_draws_sources_for_shards(spark, texts):
    d = docs(spark, texts)
    slots, of = defaultdict(dict), defaultdict(int)
    for r in mixing.shard_counts(d, block=4, shard_slots=100).collect():
        slots[r.shard][r.source] = r.slots
        of[r.source] += r.slots
    total = sum(of.values())
    assert sorted(slots) == list(range(-(-total // 100))) and all(sum(s.values()) == 100 for k, s in slots.items() if k < total // 100)
    spread = [s.get(src, 0) for s in list(slots.values())[:-1] for src in of]
    assert len(set(spread)) > 2  # drawn, not dealt in turn
    for k in range(total // 100):
        for src, n in of.items():
            p = n / total
            assert abs(slots[k].get(src, 0) - 100 * p) <= 5 * (100 * p * (1 - p)) ** 0.5 + 1
    rows = {r.doc_id: r for r in mixing.taken(d, block=4, shard_slots=100).collect()}
    cut = mixing.mixed_documents(d.withColumn("shards", d.doc_id), shards=True, block=4, shard_slots=100)
    assert cut.columns == [*d.columns, "shards", "shard"]
    by, words = defaultdict(set), defaultdict(int)
    for r in cut.collect():
        by[r.doc_id].add(r.shard)
        words[r.doc_id] += len(WORD.findall(r.text))
    for i, r in rows.items():
        assert sorted(by[i]) == r.shards and words[i] == r.taken


def test_numbered_rows(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(None,), *((f"s{i}",) for i in range(50))], "s string").repartition(7)
    got = sorted((r.n, r.s) for r in mixing.numbered(d, F.asc_nulls_last("s"), "n").collect())
    assert got == list(enumerate([*sorted(f"s{i}" for i in range(50)), None]))


def test_toxicity_keeps_clashing_columns(spark):
    chain = toxicity.Chain(["toxic"], np.array([], dtype=np.int64), [np.array([0.0])], 0.4)
    d = spark.createDataFrame([(1, "a " * 400_000, 5, "x"), (1, None, 5, "x"), (None, "", 6, None)], "doc_id long, text string, Rejected long, p_toxic string")
    out = toxicity.score(d, chain)
    assert out.columns == [*d.columns, "p_toxic_", "rejected_"] and sorted(map(str, (r[:4] for r in out.collect()))) == sorted(map(str, map(tuple, d.collect())))
    assert all(r.rejected_ and r.p_toxic_ == 0.5 for r in out.collect())
    assert toxicity.score(d.limit(0), chain).count() == 0


def test_fingerprints_of_repeated_ids_and_long_texts(spark, texts, monkeypatch):
    import xxhash

    monkeypatch.setattr(lzprint, "RANGE_BYTES", 2000)
    ids = [5 if i % 3 == 0 else None if i % 3 == 1 else i for i in range(len(texts))]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in lzprint.fingerprints(docs(spark, texts, ids)).collect())
    u = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) ^ (1 << 63), t)
    order = sorted(((i, t or "") for i, t in zip(ids, texts, strict=True)), key=lambda x: (x[0] is None, -(x[0] or 0), u(x[1])))
    want = []
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        new = lzprint.edit(t, following)
        want.append((-1 if i is None else i, len(t), hashlib.sha256(new.encode()).hexdigest(), lzprint.fingerprint(t), lzprint.likeness(lzprint.fingerprint(t), lzprint.fingerprint(following))))
    assert got == sorted(want)
    rng = random.Random(2)
    long = "".join(rng.choices("ab cdé", k=50_000)).encode()
    parse = lzprint.Parse(long[:20_000], b"other")
    assert list(parse.follow(long[20_000:])) == list(lzprint.phrase_ends(long)) == lempel_ziv(long)
    mib = bytes(rng.choices(b"abcdefgh ", k=9 << 20))  # one dictionary, whatever the length
    ends = lzprint.phrase_ends(mib)
    cuts = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    phrases = [mib[a:b] for a, b in cuts]
    assert ends[-1] == len(mib) and len(set(phrases[:-1])) == len(phrases) - 1
    known = {b"", *phrases}
    assert all(p[:-1] in known for p in phrases)


def test_chat_probe_stays_apart(spark):
    rows = [(-1, 0, "assistant", "own"), (7, 0, "assistant", "x" * 300_000), (7, 0, "assistant", "x" * 300_000), (7, 0, "assistant", "a")]
    d = spark.createDataFrame([(*r, "clash", "p") for r in rows], "conv_id long, turn long, role string, text string, formatted string, probe string")
    got = sorted((r.conv_id, r.n_turns, r.loss_chars) for r in chat.with_probe(d).collect())
    assert got == [(-1, 1, 3), (-1, 2, 21), (7, 3, 600_001)]
    assert chat.conversations(d.limit(0)).count() == 0


def test_warc_repeated_and_null_ids(spark):
    rows = [(4, "u", "same"), (4, "v", "same"), (9, "u", "same"), (None, "u", "same"), (None, None, "alone"), (None, None, "alone")]
    got = sorted((str(r.page_id), r.record_type, r.refers_to or 0) for r in warc.roundtrip(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload long")).collect())
    assert got == [("4", "response", 0), ("4", "response", 0), ("9", "revisit", 4), ("None", "response", 0), ("None", "response", 0), ("None", "revisit", 4)]


def test_url_filter_of_long_hosts_and_clashing_columns(spark):
    host = ".".join(["x" * 50] * 40) + ".com"
    caps = spark.createDataFrame([(1, f"http://{host}/", 5, "a", "b")], "page_id long, url string, fetch_day long, rule string, blocked string")
    log = spark.createDataFrame([("x" * 50 + ".com", 1, "block", "q")], "rule string, day long, action string, host string")
    assert [(r.blocked, r.n_rules, r.rule) for r in urlfilter.evaluate(caps, log).collect()] == [(True, 1, "x" * 50 + ".com")]


def test_nothing_is_left_in_the_session(spark, texts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    jaccard.keep_one(docs(spark, texts[:20])).count()
    lzprint.fingerprints(docs(spark, texts[:20])).count()
    assert before == {k: spark.conf.get(k) for k in before}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_jaccard_keeps_growing_tables_off_the_driver(spark, texts, monkeypatch):
    columns, info = spark.range(3000).selectExpr("id % 300 as h", "id as s", "1L as n"), spark.range(3000).selectExpr("id as s", "if(id % 300 < 200, id, 0L) as c")
    alive = jaccard._open_columns(columns, info)  # 200 columns in 16 salts each
    assert "Broadcast" not in plan(alive) and {(r.h, r.s) for r in alive.collect()} == {(i % 300, i) for i in range(3000) if i % 300 < 200}
    at = random.Random(9).sample(range(jaccard.FILTER_BITS), 5000)
    words = jaccard._bitmap(spark.createDataFrame([(x,) for x in [*at, *at[:50], 0, jaccard.FILTER_BITS - 1]], "at long"))
    assert np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")).tolist() == sorted({*at, 0, jaccard.FILTER_BITS - 1})
    frame, key = type(spark.range(1)), "spark.sql.autoBroadcastJoinThreshold"
    writer, before, sent, most = type(spark.range(1).write), spark.conf.get(key), [], []
    monkeypatch.setattr(frame, "toPandas", lambda self, f=frame.toPandas: (sent.append(plan(self)), f(self))[1])
    monkeypatch.setattr(writer, "parquet", lambda self, *a, f=writer.parquet, **b: (most.append(spark.conf.get(key)), f(self, *a, **b))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs(spark, texts)).collect()}
    assert got == brute_classes(texts)
    assert sent and not any("TakeOrdered" in x for x in sent)  # the driver doesn't choose among every task's rows
    stashes = most[1:]  # the first is that of documents that are no files
    assert stashes and all(int(x) <= jaccard.BROADCAST for x in stashes) and spark.conf.get(key) == before


def test_keep_one_sends_few_rows_through_the_driver(spark, texts, tmp_path, monkeypatch):
    docs(spark, texts).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 10)
    kept = jaccard.keep_one(spark.read.parquet(str(tmp_path / "d")))
    assert "Broadcast" not in plan(kept)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute_classes(texts).values()})
