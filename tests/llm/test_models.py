"""Fingerprints, mixing, quality and vector search against plain versions and held-out accuracy."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from lineaspark.llm.lz_fingerprint import edit_probe, likeness_of, lz_fingerprint, parse
from lineaspark.llm.mixing import mix
from lineaspark.llm.quality import CHUNK, FILTERS, STEP, Network, fit_quality, score_quality
from lineaspark.llm.vector_search import CLOSE, COPIES, LIST, Centroids, _scan, balanced_centroids, nearest


def phrases(text):
    out, seen, w = [], set(), ""
    for ch in text:
        w += ch
        if w not in seen:
            seen.add(w)
            out.append(w)
            w = ""
    return out


def test_parse():
    r = random.Random(2)
    for _ in range(50):
        t = "".join(r.choice("ab") for _ in range(r.randint(0, 200)))
        ends = []
        parse(t, ends, {}, 0, len(t))
        assert [t[a:b] for a, b in zip([0, *ends], ends)] == phrases(t)


def test_edit_probe(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeiounrst") for _ in range(r.randint(1, 7)))
    rows = [(i * 7, " ".join(word() for _ in range(r.randint(0, 150)))) for i in range(60)] + [(5, None), (6, ""), (14, "tie"), (14, "tie"), (None, "no id"), (8, "é日")]
    df = spark.createDataFrame([(*x, 1, "b") for x in rows], "doc_id long, text string, guard int, bucket string")
    got = edit_probe(df).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        edited = t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(x.doc_id), x.n_chars, x.edited_sha256) for x in got) == sorted(want)
    marks = {(str(x.doc_id), x.fingerprint) for x in lz_fingerprint(df).collect()}
    assert {(str(x.doc_id), x.fingerprint) for x in got} == marks
    long = [x for x in got if x.n_chars > 300]
    assert np.mean([x.near_edited for x in long]) > np.mean([x.near_next for x in long]) + 0.1
    same = df.sparkSession.createDataFrame([x for x in got if x.n_chars], edit_probe(df.limit(0)).schema).select("near_edited", likeness_of(F.col("fingerprint"), F.col("edited_fingerprint")).alias("same"))
    assert all(x.near_edited == x.same for x in same.collect())
    assert edit_probe(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    r = random.Random(seed)
    rows = []
    for s, n in (("a", 400), ("b", 40), ("c", 25), ("d", 6), (None, 30), ("é", 50)):
        rows += [(len(rows) + i, " ".join(["w"] * int(r.lognormvariate(4, 1))), s) for i in range(n)]
    rows += [(9000, None, "a"), (9001, "", "b"), (None, "x y", "c"), (9002, "z", "e"), (9003, "", "f"), (9002, "z", "e")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, size int, cell int")
    got = mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted((x for x in sizes if x is not None), key=lambda x: [ord(ch) for ch in x]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.discard(s)
    target |= share
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - target[x.source]) < 1e-6 * max(1, target[x.source])
        assert 0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size
    for s in names:
        took = sum(x.taken for x in got if x.source == s)
        least = min([x.size for x in got if x.source == s and x.size] or [0])
        assert abs(took - target[s]) <= least, (s, took, target[s])
    assert sorted(map(str, mix(df.repartition(3)).collect())) == sorted(map(str, got))
    assert mix(df.limit(0)).count() == 0


def test_quality(spark):
    r = random.Random(3)
    clean = lambda: ". ".join(" ".join(r.choice(["the", "river", "of", "green", "stones", "was"]) for _ in range(9)) for _ in range(8))
    junk = lambda: r.choice([clean().upper().replace(" ", "!! "), clean().replace(" ", " | "), "foo " * 60])
    rows = [(i, clean() if i % 3 else junk(), 1 if i % 3 else 0) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows] + [(None, None, "s", 0.5), (900, "", "s", 0.5), (901, "a " * 40000, "s", 0.5)], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 160] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    weights = fit_quality(docs, labels)
    assert weights == fit_quality(docs.repartition(3), labels)
    got = {x.doc_id: x.score for x in score_quality(docs, weights).collect()}
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == (q == 1) for i, _, q in rows if i >= 160]) > 0.95
    none = fit_quality(docs, labels.limit(0))
    assert {x.score for x in score_quality(docs, none).collect()} == {0.5}


def plain_pool(net, text):
    """The largest response of each filter, chunk by chunk."""
    n = max(2, -(-len(text) // STEP))
    raw = text.ljust(n * STEP, b"\0")
    chunks = [raw[i * STEP : i * STEP + CHUNK] for i in range(n - 1)]
    out = np.array([np.concatenate([net.embed[b] for b in c]) @ net.conv for c in chunks])
    return np.maximum(out.max(axis=0) + net.bias, 0)


def test_pool_in_pieces():
    r = np.random.default_rng(4)
    net = Network(7)
    texts = [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 7, 8, 9, 16, 17, 63, 64, 65, 200, 1000)]
    want = np.stack([plain_pool(net, t) for t in texts])
    for size in (8, 16, 24, 64, 1 << 19):
        got, best = net.pool(texts, size)
        assert np.allclose(got, want, atol=1e-5)
        assert np.allclose(np.maximum(np.einsum("dfk,kf->df", net.embed[best].reshape(len(texts), FILTERS, -1), net.conv) + net.bias, 0), want, atol=1e-5)


def test_gradients():
    r = np.random.default_rng(5)
    net = Network(9)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    texts = [bytes(r.integers(97, 105, n).astype(np.uint8)) for n in (30, 64, 5, 90)]
    labels = np.array([1, 0, 1, 0], np.float32)

    def loss():
        z = net.logit(net.pool(texts)[0].astype(np.float64))[0]
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    g = net.gradients(texts, labels)
    for name in net.NAMES:
        w = getattr(net, name)
        for at in {tuple(int(x) for x in np.unravel_index(i, w.shape)) for i in np.argsort(-np.abs(g[name]).ravel())[:3]}:
            old = w[at]
            w[at] = old + 1e-3
            up = loss()
            w[at] = old - 1e-3
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-3 - g[name][at]) < 0.05 * abs(g[name][at]) + 1e-4, name


def test_next_of_many_ranges(spark, monkeypatch):
    """Ranges of few rows, repeated ids and no ids: likeness and edits as a plain walk finds them."""
    from lineaspark.llm import lz_fingerprint as lz

    monkeypatch.setattr(lz, "BUCKET_BYTES", 64)
    r = random.Random(5)
    rows = [(r.choice([None, 1, 1, 1, 2, 3, *range(10, 40)]), "".join(r.choice("abc ") for _ in range(r.choice([0, 3, 40, 90])))) for _ in range(150)] + [(1, "same text")] * 30
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, part int")
    got = lz.edit_probe(df).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)

    def mark(text):
        end = np.cumsum([len(p) for p in plain_phrases(text)]).astype(int).tolist()
        return lz.signature(lz._hashes(text, end, len(text)))

    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        a, b, d = mark(t), mark(edited), mark(following)
        near = lambda x, y, s, u: float(not s and not u) if not s or not u else float((x == y).mean())
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), near(a, b, t, edited), near(a, d, t, following)))
    assert sorted((str(x.doc_id), *x[1:]) for x in got) == sorted(want)


def plain_phrases(text):
    out = phrases(text)
    return out + [text[sum(map(len, out)) :]] if sum(map(len, out)) < len(text) else out


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16)).round(3)
    x[5:40] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [None] * 16), (3400, [1.0] * 3), (None, x[1].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame([(*v, 1, 2) for v in rows], "vec_id long, embedding array<double>, list int, qid int")
    got = {}
    for row in nearest(df).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    hits = total = 0
    assert sorted(got) == list(range(0, 3000, 100))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        assert [f[0] for f in sorted(found)] == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in found)
        assert sorted(found) == [(k + 1, i, s) for k, (i, s) in enumerate(sorted(((i, s) for _, i, s in found), key=lambda z: (z[1], z[0])))]
        hits += len({f[1] for f in found} & set(best))
        total += 10
    assert hits >= 0.9 * total
    few = nearest(df.where("vec_id in (4, 5, 100)")).collect()
    assert [(f.query_id, f.rank, f.vec_id) for f in sorted(few)] == [(100, 1, 4), (100, 2, 5)]
    assert nearest(df.limit(0)).count() == 0 and nearest(df.where("vec_id >= 3100")).count() == 0


def test_graph_search_and_pruning():
    """With far more lists than a query reads: centroids by the graph against all, recall against brute force."""
    r = np.random.default_rng(6)
    x = r.normal(size=(12000, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    index = Centroids(balanced_centroids(x, len(x) // LIST))
    index.learn(x)
    index = Centroids.load(index.dump())
    asked = x[r.choice(len(x), 100, False)].astype(np.float64)
    assert 3 * index.probes < len(index.points)
    ids, dist = index.search(asked, index.probes)
    exact = [np.argsort(((index.points - q) ** 2).sum(axis=1))[: index.probes] for q in asked]
    assert np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(ids.tolist(), [e.tolist() for e in exact])]) > 0.9
    held, far = index.search(x.astype(np.float64), COPIES)
    held = np.where(far <= CLOSE * far[:, :1], held, -1)
    hits = read = 0
    for q, lists, d in zip(asked, ids, dist):
        take = np.isin(held, lists[d <= index.ratio * d[0]])
        read += take.sum()
        best = np.argsort(((x - q) ** 2).sum(axis=1))[1:11]
        hits += take[best].any(axis=1).sum()
    assert hits >= 0.9 * 1000 and read < 0.05 * 100 * (held >= 0).sum()


def test_lists_of_a_group_give_one_choice():
    """Lists that are scanned together hand on k + 1 entries for a query, each once, however many lists it reads."""
    r = np.random.default_rng(4)
    vid = np.repeat(np.arange(30), 4)  # every vector under four of twelve lists
    x = r.normal(size=(30, 3))
    entries = pa.table({"group": np.zeros(120, np.int64), "part": np.zeros(120, np.int64), "list": (vid * 5 + np.tile(np.arange(4), 30)) % 12, "vid": vid, "v": pa.array(x[vid].tolist()), "ids": pa.array([[int(v)] for v in vid])})
    reads = [list(range(12)), [3, 7], [20]]
    asked = pa.table({"group": [0] * 3, "part": [0] * 3, "qid": [0, 1, 2], "q": pa.array(x[:3].tolist()), "lists": pa.array(reads, pa.list_(pa.int64()))})
    got = _scan(3, 5)(entries, asked).to_pylist()
    want = []
    for q, lists in enumerate(reads):
        held = {int(v) for v, n in zip(vid, entries["list"].to_pylist()) if n in lists}
        want += [(q, v) for _, v in sorted((float(np.sqrt(((x[v] - x[q]) ** 2).sum())), v) for v in held)[:6]]
    assert [(row["qid"], row["vid"]) for row in got] == want and all(row["ids"] == [row["vid"]] for row in got)
