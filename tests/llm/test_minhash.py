"""Near-dedup against all pairs, and components against a plain union."""

import random

import pyarrow as pa
from lineaspark.llm import families
from lineaspark.llm.components import components
from lineaspark.llm.minhash_dedup import minhash_dedup
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, n long, key string, digest string"


def sets(text, width):
    words = (text or "").encode().lower().split()
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, width, percent):
    s = {i: sets(t, width) for i, t in rows}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in s:
        for b in s:
            both = len(s[a] & s[b])
            if a < b and s[a] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


def test_minhash_dedup(spark):
    r = random.Random(6)
    text = lambda n: [r.choice("abcdefghij") + str(r.randint(0, 60)) for _ in range(n)]
    rows = []
    for _ in range(12):
        chain = text(r.choice([2, 6, 40, 120]))
        for _ in range(8):  # a chain of edits: the ends are unlike, the neighbours alike
            rows.append((" ".join(chain)))
            chain = chain.copy()
            chain[r.randrange(len(chain))] = "EDIT" + str(r.randint(0, 9))
    rows += ["", None, " \n", "x", "X", "x y", "x y z", rows[0].upper(), "é É"]
    rows = [(1000 - i * 3, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame([(i, t, 1, "k", None) for i, t in rows], SCHEMA)
    for width, percent, bands in ((3, 85, (6, 32)), (5, 80, (5, 40))):
        got = {x.doc_id: x for x in minhash_dedup(df, width=width, percent=percent, rows=bands[0], bands=bands[1]).collect()}
        want = brute(rows, width, percent)
        assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
        assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())


def test_edges(spark):
    assert minhash_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f", 1, "k", None), (4, "a b c d e f", 1, "k", None), (4, "a b c d e f", 1, "k", None), (9, "a b c d e f", 1, "k", None), (5, None, 1, "k", None)]
    got = sorted((str(x.doc_id), x.component_id, x.kept) for x in minhash_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("4", 4, True), ("4", 4, True), ("5", 5, True), ("9", 4, False), ("None", None, True)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chunks_of_short_documents(spark):
    """A family of many short, partly alike documents: no task gets more than two chunks of bounded rows."""

    def counted():
        return lambda table: pa.table({"u": pa.array([table.num_rows], pa.int64()), "v": pa.array([len(set(table["id"].to_pylist()))], pa.int64())})

    rows = spark.range(9000).select(F.col("id"), F.array(F.lit(-1), *[F.col("id") * 5 + k for k in range(5)]).alias("items"))
    near = rows.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
    found = spark.createDataFrame([], "node long, component long")
    got = families.chunk_links(rows.select("id", F.lit(6).cast("long").alias("n")), rows, near, found, 85, counted()).collect()
    assert max(r.u for r in got) <= 4000 and all(r.u == r.v for r in got)
    assert len(got) == 15  # five chunks: each alone and with each other


def test_many_chunks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(families, "CHUNK_ROWS", 3)
    r = random.Random(8)
    rows, line = [], [f"w{k}" for k in range(30)]
    for i in range(60):  # all share most of a line, few are alike enough
        words = line.copy()
        for k in r.sample(range(30), r.choice([1, 1, 2, 4])):
            words[k] = f"e{r.randint(0, 3)}"
        rows.append((i * 7 % 61, " ".join(words)))
    df = spark.createDataFrame([(i, t, 1, "k", None) for i, t in rows], SCHEMA)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup(df, width=3, percent=85, rows=2, bands=96).collect()}
    assert got == brute(rows, 3, 85)


def test_repeated_ids_link_by_text(spark):
    """A row of an id has its own text's links, whatever other texts that id has."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, "q r s t u v"), (5, long), (8, long), (10, long + " y")]
    df = spark.createDataFrame([(i, t, 1, "k", None) for i, t in rows], SCHEMA)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in minhash_dedup(df).collect()) == [(5, 2, 5), (5, 36, 5), (8, 36, 5), (10, 37, 5)]
