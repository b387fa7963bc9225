"""Substring and suffix dedup against brute force over all windows."""

import random
from collections import Counter

import pytest
from lineaspark.llm.suffix_dedup import LoserTree, front_code, suffix_dedup
from lineaspark.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, block int, g string, payload string"


def brute(parts: list[list], window: int) -> list[list[bool]]:
    seen = Counter(tuple(p[i : i + window]) for p in parts for i in range(len(p) - window + 1))
    out = []
    for p in parts:
        gone = [False] * len(p)
        for i in range(len(p) - window + 1):
            if seen[tuple(p[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def corpus(seed: int) -> list[str | None]:
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "béta", "日本", "x", "gamma,", "\x00", "d" * 9])
    text = lambda n: "".join(word() + r.choice([" ", "  ", "\n", "  "]) for _ in range(n))
    shared = [text(r.randint(8, 40)) for _ in range(5)]
    out = [text(r.randint(0, 30)) + r.choice(shared) + text(r.randint(0, 9)) + r.choice(shared) for _ in range(40)]
    return [*out, *out[:4], None, "", " ", "a" * 300, "ab" * 200, "z " * 90, text(2000)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup(spark, seed):
    texts = corpus(seed)
    words = [(t or "").encode().split() for t in texts]
    df = spark.createDataFrame([(i, t, 1, "a", None) for i, t in enumerate(texts)], SCHEMA)
    for window, gram in ((12, 4), (5, 5)):
        got = {r.doc_id: r for r in substring_dedup(df, window=window, gram=gram).collect()}
        for i, (w, gone) in enumerate(zip(words, brute(words, window))):
            assert (got[i].n_words, got[i].n_removed) == (len(w), sum(gone))
            assert got[i].kept == b" ".join(x for x, g in zip(w, gone) if not g).decode()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup(spark, seed):
    texts = corpus(seed)
    raw = [(t or "").encode() for t in texts]
    df = spark.createDataFrame([(i, t, 1, "a", None) for i, t in enumerate(texts)], SCHEMA)
    for window, gram in ((40, 12), (9, 9)):
        got = {r.doc_id: r for r in suffix_dedup(df, window=window, gram=gram).collect()}
        for i, (b, gone) in enumerate(zip(raw, brute([list(x) for x in raw], window))):
            spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(b), sum(gone), spans)
            assert bytes(got[i].kept) == bytes(x for x, g in zip(b, gone) if not g)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_edges(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "one two three " * 30
    rows = [(None, text, None, None, None), (None, text, None, None, None), (7, text, 1, "x", "y"), (7, text, 1, "x", "y"), (8, None, 1, None, None)]
    got = op(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["7", "7", "8", "None", "None"]
    assert all(r.n_removed for r in got if r.doc_id != 8)


def test_loser_tree():
    import numpy as np

    r = random.Random(4)
    runs = []
    for _ in range(7):
        rows = sorted(bytes(r.choice(b"ab") for _ in range(6)) for _ in range(r.randint(0, 20)))
        runs.append(front_code(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 6)) + (rows,))
    out, last = [], b""
    for run, at, shared in LoserTree([x[:2] for x in runs], 6).merge():
        s = runs[run][2][at]
        if out:
            assert shared == next((i for i in range(6) if s[i] != last[i]), 6)
        out.append(s)
        last = s
    assert out == sorted(x for run in runs for x in run[2])
