"""Packing, spelling variants and collocations against the tokenizer library and brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm.collocations import mine_collocations
from quarry.llm.packing import Encoder, assign, pack_documents
from quarry.llm.spelling import run_counts, spelling_variants
from quarry.llm.textkit import shingle_sets, utf8_rows, words_of

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
         public_tokenizers.PATTERN)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF001 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", range(7))
def test_shingles_of_a_lone_short_text(n):
    raw, offsets = utf8_rows(pa.array([" ".join("abcdefg"[:n])]))
    assert len(shingle_sets(words_of(raw, offsets, 0, 1))[0]) == (min(n, 1) if n < 6 else 2)


# packing

def _library(texts):
    t = Tokenizer.from_file(FILES[0])
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


@pytest.mark.parametrize("chunk", [4 << 20, 50])
def test_encoder_equals_library(monkeypatch, chunk):
    rng = random.Random(1)
    signs = [*"abcé ß  \n\n\t'sdtmll.,!?<>|0123日本  ×÷É٣", "'ll", "'re", "<|endoftext|>", " the", "don't", "\r\n", "\U0001f600"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    monkeypatch.setattr(packing, "CHUNK_BYTES", chunk)
    for files in (FILES, FILES[:1]):
        ids, bounds = Encoder(*files).encode(*utf8_rows(pa.array(texts)), 1)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == _library(texts)


def test_assignment_is_whole_and_balanced():
    rng = random.Random(2)
    for _ in range(100):
        lengths = np.array([rng.choice([1, 2, 5, 50, 700, 2047, 2048, 2049, 9000]) for _ in range(rng.randrange(1, 80))])
        pieces = assign(lengths, 2048, 1.0, 1 / 6144)
        for d, n in enumerate(lengths):
            p = pieces[pieces[:, 0] == d]
            assert p[0, 1] == 0 and (p[1:, 1] == p[:-1, 1] + p[:-1, 2]).all() and p[:, 2].sum() == n and p[:, 2].min() > 0
        _check_sequences([(s, o, n) for _, _, n, s, o in pieces.tolist()])
    # equal documents: no sequence costs more than its share and one document
    pieces = assign(np.full(512, 128), 2048, 1.0, 1.0)
    cost = np.bincount(pieces[:, 3], 128 + pieces[:, 2].astype(float) ** 2)
    assert cost.max() - cost.min() == 0


def _check_sequences(places):
    """Offsets without gaps; full, or a power of two long."""
    by = defaultdict(list)
    for s, o, n in places:
        by[s].append((o, n))
    for cells in by.values():
        end = 0
        for o, n in sorted(cells):
            assert o == end
            end += n
        assert end <= 2048 and end & (end - 1) == 0


def test_packing(spark, odd_documents):
    clash = odd_documents.withColumns({c: F.lit("x") for c in ("id", "start", "ids", "cost", "sequence_id")})
    for group in (1 << 20, 3000):
        rows = pack_documents(clash, *FILES, group_tokens=group).collect()
        _check_sequences([(r.sequence_id, r.offset, r.length) for r in rows])
        want = Counter()
        for r in odd_documents.collect():
            want[r.doc_id, tuple(_library([r.text])[0])] += 1
        got = defaultdict(list)
        for r in rows:
            assert len(r.ids) == 4 * r.length
            got[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        for (i, ids), times in want.items():
            covered = Counter()
            for start, part in got[i, len(ids)]:
                if list(ids[start:start + len(part)]) == part:
                    covered.update(range(start, start + len(part)))
            assert all(covered[k] >= times for k in range(len(ids)))
        assert sum(r.length for r in rows) == sum(len(ids) * t for (_, ids), t in want.items())
    assert pack_documents(clash.limit(0), *FILES).count() == 0


# spelling variants

def _runs(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return n


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(rows):
    n = {w: c for w, c in _runs(rows).items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if x != w and _near(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def test_spelling_variants(spark, documents, odd_documents):
    rng = random.Random(4)
    long = "l" + "ongword" * 9
    base = ["station", "abcdef", "aabbcc", "écoleé", "grünß×x", "ÉTUDES", long, "zzzzzz"]
    words = []
    for w in base:
        words += [w] * rng.choice([130, 700])
        for _ in range(12):
            p, c = rng.randrange(len(w)), rng.choice("abcdéz")
            for v in (w[:p] + w[p + 1:], w[:p] + c + w[p:], w[:p] + c + w[p + 1:]):
                words += [v] * rng.choice([4, 5, 20, 26])
                words += [v[:p] + "q" + v[p:]] * 5
    rng.shuffle(words)
    rows = [(None if i % 5 == 0 else i % 90, " ".join(words[i::400]).title() + ".", "en", "a") for i in range(400)]
    want = _variants([r[:2] for r in rows])
    assert sum(r[1] is not None for r in want) > 50 and any(r[2] != r[1] for r in want if r[1])
    docs = documents(rows)
    for kw in ({}, {"most": 3, "searches": 4, "stride": 3}):
        assert sorted(map(tuple, spelling_variants(docs, **kw).collect()), key=lambda r: r[0]) == want
    counts = {r.word: r.n for r in run_counts(odd_documents, least_length=1).collect()}
    assert counts == {w: c for w, c in _runs([r[:2] for r in odd_documents.collect()]).items() if w}
    clash = odd_documents.withColumns({c: F.lit(1) for c in ("id", "word", "n", "vector", "path")})
    assert spelling_variants(clash).count() == spelling_variants(odd_documents).count()
    assert spelling_variants(odd_documents.limit(0)).count() == 0


def test_spelling_variants_of_given_texts(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, spelling_variants(docs).collect()), key=lambda r: r[0])
    assert got == _variants([tuple(r) for r in docs.collect()])


# collocations

def _phrases(rows, limit, least=10):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = {q for p, a in candidates.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * c[q]}
        best = []
        for p in candidates.keys() - covered:
            a = c[p]
            score, _, left, r = min((10 ** 6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, r))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(best)[:limit])]
    return sorted(out)


def test_collocations(spark, documents, odd_documents):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "en", "de", None, "und", "zz"])
        words = [f"{'Wé'}{min(rng.randrange(30), rng.randrange(30))}" if lang != "zz" else f"q{i}" for _ in range(60)]
        for _ in range(4):
            words.insert(rng.randrange(50), rng.choice(["new york city", "NEW york", "al pha\tbe ta", "a.b", "x, y"]))
        rows.append((i, rng.choice([" ", "  ", "\t", "\n", " - "]).join(words), lang, "a"))
    rows += [(1, None, "en", "a"), (2, "", "xx", "a"), (3, ".,;", "yy", "a")]
    for limit, first in ((2000, None), (40, 1), (7, 3)):
        got = sorted(map(tuple, mine_collocations(documents(rows), limit=limit, first_rank=first).collect()))
        assert got == _phrases([(r[2], r[1]) for r in rows], limit)
    clash = odd_documents.withColumns({c: F.lit(1) for c in ("w1", "n", "f", "score", "floor")})
    got = sorted(map(tuple, mine_collocations(clash, limit=50).collect()))
    assert got == _phrases([(r.lang, r.text) for r in odd_documents.collect()], 50) and got
    assert mine_collocations(clash.limit(0)).count() == 0
