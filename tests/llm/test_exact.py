"""Unlike strings that polynomial hashes modulo a power of two take for one another; frequent phrases; exact numbering."""

import numpy as np
import public_tokenizers
import pytest
from lineaspark.llm import common as c
from lineaspark.llm.bpe import bpe_decode, bpe_encode
from lineaspark.llm.lz_fingerprint import lz_fingerprint
from lineaspark.llm.minhash_dedup import minhash_dedup
from lineaspark.llm.substring_dedup import substring_dedup
from lineaspark.llm.suffix_dedup import suffix_dedup

from .test_dedup import SCHEMA, brute, corpus


def thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[k] for k in bits), "".join("ba"[k] for k in bits)


X, Y = thue_morse(1024)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "g", None) for i, t in enumerate(texts)], SCHEMA)


def test_tokens_of_twins(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r.text for r in bpe_decode(bpe_encode(frame(spark, [f"{X}\n{Y}", f"{Y} {X}"]), path), path).collect()}
    assert got == {0: f"{X}\n{Y}", 1: f"{Y} {X}"}


def test_sets_of_twins(spark):
    docs = frame(spark, [X, Y, f"a {X} b c", f"a {Y} b c"])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup(docs, width=3, percent=85, rows=6, bands=32).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (2, 2), 3: (2, 3)}


@pytest.mark.parametrize("frequent", [0, 1000])
def test_passages_of_twins(spark, frequent):
    head = " ".join(f"w{k}" for k in range(34))
    got = substring_dedup(frame(spark, [f"{head} {X}", f"{head} {Y}"]), frequent=frequent).collect()
    assert [r.n_removed for r in got] == [0, 0]
    got = substring_dedup(frame(spark, [f"{head} {X}", f"{head} {X}"]), frequent=frequent).collect()
    assert [r.n_removed for r in got] == [35, 35]


@pytest.mark.parametrize("frequent", [0, 1000])
def test_bytes_of_twins(spark, frequent):
    for a, b in ((X, Y), (X + "z", Y + "z"), ("z" * 150 + X, "z" * 150 + Y)):
        texts = [t.encode() for t in (a, b)]
        want = [sum(x) for x in brute([list(t) for t in texts], 200)]
        got = {r.doc_id: r.n_removed for r in suffix_dedup(frame(spark, [a, b]), frequent=frequent).collect()}
        assert [got[0], got[1]] == want


def test_fingerprints_of_twins(spark):
    marks = [r.fingerprint for r in lz_fingerprint(frame(spark, [X, Y])).collect()]
    assert marks[0] != marks[1]


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize("frequent", [0, 3])
def test_frequent_phrases(spark, seed, frequent):
    texts = corpus(seed)
    words, raw = [(t or "").encode().split() for t in texts], [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in substring_dedup(frame(spark, texts), window=12, gram=4, frequent=frequent).collect()}
    for i, (w, gone) in enumerate(zip(words, brute(words, 12))):
        assert got[i].kept == b" ".join(x for x, g in zip(w, gone) if not g).decode()
    got = {r.doc_id: r for r in suffix_dedup(frame(spark, texts), window=40, gram=12, frequent=frequent).collect()}
    for i, (b, gone) in enumerate(zip(raw, brute([list(x) for x in raw], 40))):
        assert bytes(got[i].kept) == bytes(x for x, g in zip(b, gone) if not g)


def test_names(monkeypatch):
    r = np.random.default_rng(2)
    v = r.integers(0, 2, 4000).astype(np.uint8)
    start = r.integers(0, 3000, 2000)
    end = start + r.integers(0, 900, 2000)
    tag = r.integers(0, 2, 2000)
    want: dict = {}
    plain = [want.setdefault((v[a:b].tobytes(), t), len(want)) for a, b, t in zip(start, end, tag)]
    for weak in (False, True):
        if weak:  # hashes that say nothing: contents still decide
            monkeypatch.setattr(c, "span_hash", lambda values, a, b: np.zeros(len(a), c.U))
            monkeypatch.setattr(c, "_pair", lambda a, b: np.zeros(len(a), c.U))
        name, first = c.name_spans(v, start, end, tag)
        assert len(set(zip(name.tolist(), plain))) == len(want) == len(first) == len(set(name.tolist()))
        assert all(name[f] == k for k, f in enumerate(first.tolist()))
