"""Numbers of words, and what removal leaves, against plain versions."""

import random

import numpy as np
import pyarrow as pa
import xxhash
from lineaspark.llm import common as c
from lineaspark.llm import substring_dedup as s


def test_words_are_numbered_from_the_buffer():
    """Numbers go by first appearance and hashes by the word's bytes; no list of the words is made for them."""
    r = random.Random(5)
    word = lambda: r.choice([b"a", b"ab", b"\xc3\xa9", b"\xe2\x80\xa8", b"b" * r.randint(1, 5)])
    texts = [r.choice([b" ", b"\n", b"\t\r"]).join(word() for _ in range(r.randint(0, 20))) for _ in range(60)] + [b"", b" \n "]
    for some in (texts, [], [b""], [b"x"]):
        w, words = s._Words(some), [x for t in some for x in t.split()]
        w.raw = None
        w.number()
        place = {}
        assert w.word.tolist() == [place.setdefault(x, len(place)) for x in words]
        assert w.hash.tolist() == [xxhash.xxh64_intdigest(x) for x in words] and w.hash.dtype == c.U


def test_kept_words():
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdé") for _ in range(r.randint(0, 30))) for _ in range(50)] + ["", " \n", "\ta  b\n"]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    gone = []

    def locate(w, passages):
        gone.append(np.random.default_rng(1).random(len(w.a)) < 0.4)
        return gone[0]

    found = pa.table({"passage": pa.array([], pa.binary()), "key": pa.array([], pa.binary())})
    keep, unpack, s._locate, s.c.unpack = s._locate, c.unpack, locate, lambda table: table
    try:
        got = s._without(docs, found, 35).to_pylist()
    finally:
        s._locate, s.c.unpack = keep, unpack
    n = 0
    for row, text in zip(got, texts):
        words = (text or "").encode().split()
        off = gone[0][n : n + len(words)]
        n += len(words)
        assert row["n_words"] == len(words) and row["n_removed"] == off.sum()
        assert row["kept"] == b" ".join(x for x, o in zip(words, off) if not o).decode()
