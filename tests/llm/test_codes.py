"""Vector codes against plain k-means, metric trees against all distances."""

import hashlib

import numpy as np
import pytest
from lineaspark.llm.vector_codes import Balls, anchors, compress, squares


def plain(points, first, rounds):
    book = first.copy()
    for r in range(rounds + 1):
        d = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        code = d.argmin(axis=1)
        if r == rounds:
            return book, code, d.min(axis=1)
        for k in range(len(book)):
            if (code == k).any():
                book[k] = points[code == k].sum(axis=0) // (code == k).sum()


@pytest.mark.parametrize("n, dim, spread", [(1, 2, 9), (40, 3, 4), (700, 4, 60), (900, 2, 3), (500, 6, 1 << 26)])
def test_balls(n, dim, spread):
    r = np.random.default_rng(n)
    points = r.integers(-spread, spread + 1, (n, dim))
    points[n // 2 :] = points[r.integers(0, max(1, n // 50), n - n // 2)]  # many equal ones
    book = points[r.integers(0, n, min(n, 30))]  # with equal entries
    tree = Balls(points, leaf=8)
    d = ((points[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
    want = np.array([min(range(len(book)), key=lambda k: (row[k], k)) for row in d])
    code, error = tree.codes(book)
    assert (code == want).all() and (error == [row[k] for row, k in zip(d, want)]).all()
    total, count = tree.totals(book)
    assert all(count[k] == (want == k).sum() and (total[k] == points[want == k].sum(axis=0)).all() for k in range(len(book)))
    assert (squares(points, book) == d.astype(np.int64)).all()


def test_balls_are_owned_whole():
    r = np.random.default_rng(1)
    points = np.concatenate([r.integers(0, 20, (300, 3)), r.integers(5000, 5020, (300, 3))])
    tree = Balls(points)
    balls, which, rows, _ = tree.owned(np.array([[10, 10, 10], [5010, 5010, 5010]]))
    assert not len(rows) and sorted(which) == [0, 1] and tree.count[balls].sum() == 600  # two balls stand for all points
    owner = anchors(points.astype(float))
    assert owner.max() + 1 == int(np.sqrt(600)) and not {*owner[:300]} & {*owner[300:]}


def test_compress(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(90, 8)).round(3)
    v[40:60] = v[7]
    rows = [(int(i), x.tolist(), None if i % 3 else "a" if i % 2 else "", 1, "k") for i, x in zip(r.permutation(90), v)]
    bad = [(1, None, "a", 1, "k"), (2, [None] * 8, "a", 1, "k"), (3, [float("nan")] * 8, "b", 1, "k"), (4, [float("inf")] * 8, None, 1, "k"), (5, [0.5] * 3, "a", 1, "k"), (6, [], "a", 1, "k")]
    schema = "vec_id long, embedding array<double>, label string, error long, key string"
    got = compress(spark.createDataFrame([*rows, *bad], schema).repartition(3), parts=2, entries=16, rounds=3).collect()
    rows.sort()
    points = np.floor(np.array([x[1] for x in rows]) * 1024).astype(np.int64)
    found = [plain(points[:, a : a + 4], points[:16, a : a + 4], 3) for a in (0, 4)]
    error = found[0][2] + found[1][2]
    label = {y: sum(int(e) for e, x in zip(error, rows) if x[2] == y) for y in (None, "a", "")}
    digest = hashlib.sha256(",".join(str(x) for f in found for x in f[0].ravel().tolist()).encode()).hexdigest()
    want = [(x[0], f"{found[0][1][i]:02x}{found[1][1][i]:02x}", int(error[i]), label[x[2]], digest) for i, x in enumerate(rows)]
    assert sorted(map(tuple, got)) == want


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert compress(spark.createDataFrame([], schema)).count() == 0
    assert compress(spark.createDataFrame([(1, None, 2)], schema)).count() == 0
    same = spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0], 1), (7, [1.0, 2.0, 3.0, 4.0], 1), (7, [1.0, 2.0, 3.0, 4.0], None)], schema)
    assert sorted((x.vec_id or 0, x.code, x.error, x.label_error) for x in compress(same).collect()) == [(0, "00000000", 0, 0), (7, "00000000", 0, 0), (7, "00000000", 0, 0)]
    with pytest.raises(ValueError, match="divide"):
        compress(spark.createDataFrame([(1, [1.0] * 5, 2)], schema))
