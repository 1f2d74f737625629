"""Near duplicates, lattice scores, pieces, toxicity and the pipeline against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import ngram_join
from quarry.llm.lattice import Lattice, score_documents
from quarry.llm.near_embeddings import band_plan, near_duplicates
from quarry.llm.pieces import CharacterMap, codec, default_model, encode_documents, encoding_digests, normalise
from quarry.llm.toxicity import _sample_texts, drop_toxic, nnpu_fit, score_toxicity, train_toxicity

SF001 = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _components(nodes, links):
    label = {n: n for n in nodes}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {n: find(n) for n in nodes}


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, base = [], rng.standard_normal((120, 16))
    for i in range(1200):
        v = base[i % 120] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(2000 + i, rows[0][1], 0) for i in range(5)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [math.nan] * 16, 0), (3003, rows[0][1], None), (3004, [1.0, None], 0), (3005, [], 0)]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [r for r in rows if r[0] < 3000]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None, :])
    np.fill_diagonal(near, False)
    found = sum(got[r[0]].n_links for r in good)
    assert all(got[r[0]].n_links <= n for r, n in zip(good, near.sum(1))) and found >= 0.97 * near.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(3000, 3006))
    assert all(got[2000 + i].component_id == 0 for i in range(5)) and len(got) == len(rows)
    assert band_plan(64, 0.93, 0.99) == (0, 1)


def _shingles(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_jaccard_brute_force(spark, documents, odd_documents, monkeypatch):
    rnd = random.Random(5)
    texts = [[f"t{rnd.randrange(400)}" for _ in range(rnd.randrange(4, 60))] for _ in range(40)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(400):
        t = list(rnd.choice(texts))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            t[rnd.randrange(len(t))] = f"m{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(t + (passage if i % 4 == 0 else [])), "en", "a"))
    for block in (512, 8):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "COMMON_DOCS", 4)
        got = {r.doc_id: r for r in ngram_join.jaccard_components(documents(rows)).collect()}
        sets = {r[0]: _shingles(r[1]) for r in rows}
        links = [(a, b) for a, b in itertools.combinations(sets, 2)
                 if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = _components(sets, links)
        assert {i: r.component_id for i, r in got.items()} == want
        assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    # groups of one set each: the matrix alone finds every link
    monkeypatch.setattr(ngram_join, "AGREE", 99)
    alone = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(documents(rows)).collect()}
    assert alone == want
    odd = [(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(odd_documents).collect()]
    assert (5, 4) in odd and (1, 1) in odd and (2, 2) in odd and (None, 8) in odd and len(odd) == 11
    assert ngram_join.keep_one_per_group(odd_documents).count() == 8
    assert ngram_join.jaccard_components(odd_documents.limit(0)).count() == 0


def test_lone_short_text(spark, documents):
    """A table, hence a slice, of one text with three words."""
    row = ngram_join.jaccard_components(documents([(9, "a b c", "en", "a")])).first()
    assert (row["doc_id"], row["n_shingles"], row["component_id"]) == (9, 1, 9)


def test_keep_one_by_id_and_text(spark, documents):
    """Rows of one id, or of none, go by their own texts: one stays per component, unrelated texts all stay."""
    def words(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))
    a, b, c, d, e = (words(x) for x in "abcde")
    docs = documents([(i, t, "en", "a") for i, t in [
        (3, a), (6, a + " tail"), (6, b), (6, b.upper()), (None, a + " end"), (None, c), (None, c + " more"), (None, c), (None, d),
        (7, e + " x"), (7, e), (7, e), (8, e), (9, None), (9, None), (9, ""), (None, None), (None, None), (10, words("f"))]])
    got = ngram_join.keep_one_per_group(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert set(kept.values()) == {1}
    assert {(3, a), (6, b.upper()), (None, d), (9, None), (9, ""), (None, None), (10, words("f"))} <= set(kept)
    assert len([k for k in kept if k[0] is None and k[1] in (c, c + " more")]) == 1
    assert len([k for k in kept if k[0] == 7]) == 1 and (8, e) not in kept
    assert len(kept) == 9


def test_lattice_brute_force():
    logs = {p: math.log(x) for p, x in {"▁": 0.1, "▁a": 0.2, "a": 0.05, "b": 0.1, "ab": 0.15, "▁ab": 0.1, "<0x63>": 0.01}.items()}

    def total(s):
        if not s:
            return 1.0
        out = sum(math.exp(logs[s[:i]]) * total(s[i:]) for i in range(1, len(s) + 1) if s[:i] in logs)
        return out + (0.01 * total(s[1:]) if s[0] == "c" else 0)
    for word in ("a", "ab", "abab", "acb", "ccc", "b"):
        assert abs(Lattice(logs).word(word) - math.log10(total("▁" + word))) < 1e-9
    assert math.isfinite(Lattice(logs).word("ab" * 5000 + "é"))


@pytest.mark.parametrize("frequent", [0, 3, 500_000])
def test_scores(spark, documents, odd_documents, frequent):
    rows = [(i, " ".join(f"W{(i * j) % 17}" for j in range(i % 9)), "en", "a") for i in range(60)]
    docs = documents(rows).union(odd_documents)
    got = score_documents(docs, frequent_words=frequent).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]

    def key(i):
        return "" if i is None else str(i)

    def tokens(t):
        return [w.lower() if w.isascii() else w for w in WORDS.findall(t)] + [None]
    train = Counter(w for i, t in texts if zlib.crc32(key(i).encode()) % 10 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = Counter((i, len(tokens(t)), sum(train[w] > 0 for w in tokens(t)),
                    round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 5)) for i, t in texts)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert score_documents(docs.limit(0)).count() == 0


def test_pieces(spark, odd_documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    got = encode_documents(odd_documents).collect()
    texts = Counter((r.doc_id, r.text or "") for r in odd_documents.collect())
    for r in got:
        text = next(t for i, t in texts if i == r.doc_id and list(library.encode(t)) == list(r.ids))
        assert r.decoded == library.decode(list(r.ids))
        raw = text.encode()
        assert [s for s in r.span_start[1:]] == [e for e in r.span_end[:-1]] and (not raw or r.span_end[-1] == len(raw))
        for j, (a, b, i) in enumerate(list(zip(r.span_start, r.span_end, r.ids))[:200]):
            piece = library.id_to_piece(i)
            if not re.fullmatch("<0x..>", piece):
                assert raw[a:b].decode().replace(" ", "▁") == (piece if j else piece[1:])
    tool = codec(default_model())
    for text in ("a ▁ b", "▁", "  x ▁▁"):
        e = tool.encode([text])[0]
        assert e.end[-1] == len(text.encode())


def test_encoding_digests(spark, odd_documents):
    """The registered digests against the library alone."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=default_model())

    def want(i, text):
        ids = library.encode(text or "")
        return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoding_digests(odd_documents).collect())
    assert got == Counter(want(r.doc_id, r.text) for r in odd_documents.collect())
    assert encoding_digests(odd_documents.limit(0)).count() == 0


def test_positive_unlabelled_risk():
    """The fitted weights against an independent risk: far below the start, and at a minimum among allowed moves."""
    rnd = np.random.default_rng(5)
    prior = 0.2

    def doc(toxic):
        marks = rnd.integers(0, 12, 3 if toxic else int(rnd.random() < 0.05))
        return np.unique(np.concatenate([rnd.integers(100, 400, 12), marks])).astype(np.uint64)
    positive = [doc(True) for _ in range(150)]
    unlabelled = [doc(rnd.random() < prior) for _ in range(400)]
    model = nnpu_fit(positive, unlabelled, prior, steps=4_000, rate=0.02)

    def risk(weights, bias):
        def losses(sets, sign):
            known = dict(zip(model.features.tolist(), weights))
            return sum(math.log1p(math.exp(-sign * (bias + sum(known.get(int(f), 0.0) for f in s)))) for s in sets) / len(sets)
        negative = losses(unlabelled, -1) - prior * losses(positive, -1)
        return prior * losses(positive, 1) + max(negative, 0.0) + 0.5e-4 * sum(w * w for w in weights)
    at = risk(model.weights, model.bias)
    assert set(model.features.tolist()) <= set(range(12)) and len(model.features) > 6
    assert at < 0.7 * risk(np.zeros(len(model.weights)), math.log(prior / (1 - prior)))
    for step in (0.3, -0.3):
        assert risk(model.weights, model.bias + step) > at - 2e-3
        for j in range(len(model.weights)):
            moved = model.weights.copy()
            moved[j] = max(moved[j] + step, 0.0)
            assert risk(moved, model.bias) > at - 2e-3


def test_character_map():
    """A hand-made trie: 'ab' -> 'X', 'a' -> 'YZ'."""
    units = [0] * 1024

    def offset(value):
        return value << 10
    root = 256
    units[0] = offset(root)
    a = root ^ ord("a")
    units[a] = offset(300 ^ a) | 256 | ord("a")
    leaf_a = a ^ (300 ^ a)
    units[leaf_a] = (1 << 31) | 0
    b = leaf_a ^ ord("b")
    units[b] = offset(700 ^ b) | 256 | ord("b")
    units[700] = (1 << 31) | 3
    import struct
    chars = CharacterMap(struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"YZ\0X\0")
    assert chars.longest(b"abc", 0) == (2, b"X") and chars.longest(b"ac", 0) == (1, b"YZ") and chars.longest(b"c", 0) is None
    text, source = normalise("ab a é".encode(), chars, True, False)
    assert text.decode() == "▁X▁YZ▁é" and list(source) == [0, 0, 0, 0, 2, 2, 2, 3, 3, 4, 4, 4, 5, 5, 7]
    text, source = normalise(b"  c  c ", CharacterMap(b""), True, True)
    assert text.decode() == "▁c▁c" and source[-1] == 7


def test_toxicity(spark, documents, odd_documents):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 8 == 0
        w = [f"n{rnd.randrange(300)}" for _ in range(30)] + ([rnd.choice(["vileness", "grotesque"])] * 2 if toxic else [])
        rnd.shuffle(w)
        rows.append((i, " ".join(w), "en", "a"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs, table = documents(rows), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = train_toxicity(docs, table)
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    assert sum((got[i] >= 0.5) == (i % 8 == 0) for i in range(900)) >= 890
    assert drop_toxic(docs, model).columns == docs.columns
    assert all(0 <= r.score < 0.5 for r in score_toxicity(odd_documents, model).collect())
    empty = train_toxicity(docs, table.limit(0))
    assert all(r.score < 0.5 for r in score_toxicity(docs, empty).collect())
    assert len(nnpu_fit([], [], 0.1).features) == 0 and score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_sample_of_repeated_ids(spark, documents):
    """An id of many rows gives one text to each side and takes no other id's place."""
    docs = documents([(7, f"copy {i}", "en", "a") for i in range(200)] + [(i, f"text {i}", "en", "a") for i in range(20, 60)])
    ids = docs.select(F.col("doc_id").alias("_id"))
    got = _sample_texts(docs, ids.where("_id in (7, 20)"), ids, "doc_id", "text", 5, 50).collect()
    assert Counter(r.positive for r in got) == {1: 2, 0: 41}
    assert sum(r.text.startswith("copy") for r in got) == 2


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF001)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 50
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        empty = stage(spark, docs.limit(0), SF001)
        assert empty.count() == 0
    assert out.where(F.col("doc_id").isNull()).count() == 0
