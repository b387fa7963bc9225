"""Resampling against a plain version; the k-th key against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from lineaspark.llm.resampling import features, kth, resample

SCHEMA = "doc_id long, text string, score long, rank string"


def plain(rows, target, longest, buckets, least, percent):
    def listed(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for i in range(len(words)) for n in range(1, longest + 1) if i + n <= len(words)]

    s, t = Counter(x for r in rows for x in listed(r[1])[1]), Counter(x for y in target for x in listed(y)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, text, *_ in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        words, f = listed(text)
        w = sum(gain[x] for x in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(fit[: len(fit) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def test_resample(spark):
    r = random.Random(3)
    words = [*"abcdefgh", "Été", "É", "x1", "B-c", "naïve's", "日本"]
    rows = [(r.choice([None, *range(60)]), " ".join(r.choices(words, k=r.randint(0, 40))) or None, 1, "k") for _ in range(150)]
    rows += [rows[0]] * 30  # repeated rows, each with a rank of its own
    target = ["Été a b", None, "日本 x1 x1", ""]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    for longest, buckets, least, percent in ((1, 10_000, 20, 10), (2, 50, 3, 35), (1, 7, 0, 100)):
        got = resample(docs, aim, longest=longest, buckets=buckets, least=least, percent=percent)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, target, longest, buckets, least, percent)


def test_kth(spark):
    r = random.Random(8)
    keys = [(r.choice([0, 0, 0, r.randint(-9, 9)]), i) for i in range(700)]
    df = spark.createDataFrame(keys, "a long, b long")
    for k in (1, 2, 350, 699, 700):
        assert kth(df, ["a", "b"], k) == sorted(keys)[k - 1]
    assert kth(df, ["a", "b"], 701) is None


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert resample(empty, empty).count() == 0
    one = spark.createDataFrame([(1, "a " * 30, 0, "k"), (None, None, 0, "k")], SCHEMA)
    assert sorted((x.doc_id or 0, x.n_features, x.rank) for x in resample(one, empty, percent=100).collect()) == [(0, 0, None), (1, 30, 1)]
    assert list(features(b"A-b  C", 2)) == [b"a", b"b", b"a b", b"c", b"b c"]
    long = "word " * 1_000_000
    assert resample(spark.createDataFrame([(1, long, 0, "k")], SCHEMA), one).first().n_features == 1_000_000
