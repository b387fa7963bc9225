"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample by balanced bisection, so that lists hold about equally many vectors; their
number grows with the corpus up to ``SAMPLE // LIST``.  A neighbour graph over the centroids, which every task
holds, finds the centroids near a vector by best-first search.  A vector near a boundary is listed under several
centroids.  A query reads the lists whose centroid is not farther than a ratio times its nearest one, up to a number;
both are learned from queries of the sample and their neighbours in it.  Lists with close numbers are scanned together and hand on
one choice for a query, so what is handed on does not grow with the lists that a query reads.  Equal vectors are one entry with
their least ids, which is all that any query can return of them.  Lists are split by a hash where they grow long.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SAMPLE = 131_072  # vectors from which centroids are made, at most
LIST = 8  # vectors of the sample in a list, about
COPIES, CLOSE = 5, 1.5
TRIALS, REACH = 256, 0.955  # queries of the sample, and the share of their neighbours that the ratio must reach
_SPLIT = 4096
GROUPS, GROUPED = 64, 32_768  # groups of lists, and the entries of a group from which on there are more of them


class Centroids:
    """Centroids with their neighbour graph; searched for many vectors at once."""

    def __init__(self, points: np.ndarray, degree: int = 24):
        self.points = points
        n = len(points)
        self.degree = min(degree, max(1, n - 1))
        near = [_nearest(points, points[i : i + 512], self.degree + 1)[:, 1:] for i in range(0, n, 512)]
        r = np.random.default_rng(3)
        far = r.integers(0, max(1, n), (n, 4))  # a few long links keep the graph connected
        self.links = np.concatenate([np.concatenate(near).reshape(n, -1), far], axis=1) if n else np.zeros((0, 1), np.int64)
        self.entry = np.unique(np.linspace(0, max(0, n - 1), 32).astype(np.int64)) if n else np.zeros(0, np.int64)
        self.ratio, self.probes = 1.0, 1

    def learn(self, sample: np.ndarray, k: int = 10) -> None:
        """Set ratio and number of lists by which ``TRIALS`` queries reach ``REACH`` of their ``k`` neighbours in the sample."""
        asked = sample[:TRIALS]
        k = min(k, len(sample) - 1)
        if k < 1:
            return
        near = _nearest(sample, asked, k + 1)[:, 1:]
        held = _nearest(self.points, sample[near.ravel()], COPIES)
        far = _distance(self.points, sample[near.ravel()][:, None], held)
        dist = np.sqrt(np.maximum(((asked[:, None] - self.points[None]) ** 2).sum(axis=2), 0)) if len(self.points) < 64 else np.stack([np.sqrt(((self.points - q) ** 2).sum(axis=1)) for q in asked])
        least = np.maximum(dist.min(axis=1, keepdims=True), 1e-12)
        to = np.repeat(np.arange(len(asked)), k)[:, None]
        need = np.where(far <= CLOSE * far[:, :1] + 1e-12, dist[to, held], np.inf).min(axis=1)
        self.ratio = float(np.quantile(need / least[to[:, 0], 0], 0.5 + REACH / 2))
        self.probes = 1 + int(np.quantile((dist[to[:, 0]] < need[:, None]).sum(axis=1), REACH))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, links=self.links, entry=self.entry, reach=np.array([self.ratio, self.probes], np.float64))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Centroids:
        c = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as z:
            c.points, c.links, c.entry = z["points"], z["links"], z["entry"]
            c.ratio, c.probes = float(z["reach"][0]), int(z["reach"][1])
        return c

    def search(self, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``keep`` nearest centroids found for each row of ``x`` and their distances, nearest first."""
        keep = min(keep, len(self.points))
        if keep == len(self.points):  # all of them are asked for: nothing to search
            d = np.stack([((self.points - row) ** 2).sum(axis=1) for row in x]) if len(x) else np.zeros((0, keep))
            order = np.argsort(d, axis=1, kind="stable")
            return order, np.sqrt(np.take_along_axis(d, order, 1))
        width = min(max(48, keep + keep // 2), len(self.points))
        rows = np.arange(len(x))[:, None]
        ids = np.repeat(self.entry[None], len(x), 0)
        dist = ((x[:, None] - self.points[ids]) ** 2).sum(axis=2)
        done = np.zeros(ids.shape, bool)
        for _ in range(4 * width):
            open_ = np.where(done | ~np.isfinite(dist), np.inf, dist)
            best = open_.argmin(axis=1)
            live = np.isfinite(open_[rows[:, 0], best])
            if not live.any():
                break
            done[rows[:, 0], best] = True
            fresh = self.links[ids[rows[:, 0], best]]
            d = ((x[:, None] - self.points[fresh]) ** 2).sum(axis=2)
            d[~live] = np.inf
            ids, dist, done = np.concatenate([ids, fresh], 1), np.concatenate([dist, d], 1), np.concatenate([done, np.zeros(fresh.shape, bool)], 1)
            # Of equal ids the one already expanded stays; then the nearest ``width`` stay.
            order = np.lexsort((~done, ids), axis=1)
            s = np.take_along_axis(ids, order, 1)
            again = np.concatenate([np.zeros((len(x), 1), bool), s[:, 1:] == s[:, :-1]], 1)
            dist = np.where(again, np.inf, np.take_along_axis(dist, order, 1))
            done = np.take_along_axis(done, order, 1)
            top = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = (np.take_along_axis(v, top, 1) for v in (s, dist, done))
        return ids[:, :keep], np.sqrt(dist[:, :keep])


def _nearest(points: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest points of each row of ``x``, nearest first."""
    k = min(k, len(points))
    out = []
    for i in range(0, len(x), 256):
        d = (points**2).sum(axis=1) - 2 * x[i : i + 256] @ points.T
        top = np.argpartition(d, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def _distance(points: np.ndarray, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - points[ids]) ** 2).sum(axis=2))


def balanced_centroids(x: np.ndarray, n: int) -> np.ndarray:
    """About ``n`` means of equally large parts, by repeated two-means with the cut kept near the middle.

    A mean of vectors that point different ways is shorter than they are, and about equally far from everything;
    it is drawn out to their usual length.
    """
    parts, out, size = [x], [], max(1, len(x) // max(1, n))
    while parts:
        p = parts.pop()
        if len(p) <= 1.5 * size:
            if len(p):
                out.append(p.mean(axis=0))
            continue
        far = p[((p - p.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        a, b = far, p[((p - far) ** 2).sum(axis=1).argmax()]
        for _ in range(6):
            lean = ((p - a) ** 2).sum(axis=1) - ((p - b) ** 2).sum(axis=1)
            order = np.argsort(lean, kind="stable")
            cut = int(np.clip((lean < 0).sum(), len(p) * 0.35, len(p) * 0.65))
            cut = min(max(cut, 1), len(p) - 1)
            a, b = p[order[:cut]].mean(axis=0), p[order[cut:]].mean(axis=0)
        parts += [p[order[:cut]], p[order[cut:]]]
    points = np.array(out).reshape(-1, x.shape[1])
    for _ in range(3 if len(points) > 1 else 0):  # let the vectors near the cuts change sides
        own = _nearest(points, x, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        part, first = np.unique(own[order], return_index=True)
        size = np.diff(np.append(first, len(own)))[:, None]
        mean = np.add.reduceat(x[order], first, axis=0) / size
        norm = np.sqrt(np.add.reduceat((x[order] ** 2).sum(axis=1), first)[:, None] / size)
        points[part] = mean * (norm / np.maximum(np.sqrt((mean**2).sum(axis=1, keepdims=True)), 1e-12))
    return points


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _fit(dim: int, n: int):
    def run(batches):
        x = np.concatenate([np.zeros((0, dim)), *(_matrix(b.column(1), dim)[np.argsort(b.column(0).to_numpy(), kind="stable")] for b in batches)])
        x = x.astype(np.float32)
        index = Centroids(balanced_centroids(x, n))
        index.learn(x)
        yield pa.RecordBatch.from_arrays([pa.array([index.dump()], pa.binary())], names=["index"])

    return run


def _lists(index: bytes, dim: int, splits: int, groups: int):
    """Posting entries: a vector goes under its nearest centroid and under others that are about as near."""

    def run(batches):
        c = Centroids.load(index)
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            if not len(x):
                continue
            ids, dist = c.search(x, COPIES)
            row, col = np.nonzero(dist <= CLOSE * dist[:, :1] + 1e-12)
            rows, list_ = batch.take(pa.array(row)), ids[row, col].astype(np.int64)
            part = rows.column(0).to_numpy() % splits
            yield pa.RecordBatch.from_arrays([pa.array(list_ * groups // len(c.points)), pa.array(part, pa.int64()), pa.array(list_), *rows.columns], names=["group", "part", "list", "vid", "v", "ids"])

    return run


def _probes(index: bytes, dim: int, probes: int, ratio: float, splits: int, groups: int):
    """Queries with the lists that they read, one row for each group of lists and part."""

    def run(batches):
        c = Centroids.load(index)
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            if not len(x):
                continue
            ids, dist = c.search(x, probes)
            row, col = np.nonzero(dist <= ratio * dist[:, :1] + 1e-12)
            list_ = ids[row, col].astype(np.int64)
            order = np.lexsort((list_, row))
            row, list_ = row[order], list_[order]
            group = list_ * groups // len(c.points)
            first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(group) != 0)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(list_))
            again = np.repeat(np.arange(len(first)), splits)
            rows = batch.take(pa.array(row[first][again]))
            yield pa.RecordBatch.from_arrays([pa.array(group[first][again]), pa.array(np.tile(np.arange(splits), len(first))), rows.column(0), rows.column(1), lists.take(pa.array(again))], names=["group", "part", "qid", "q", "lists"])

    return run


def _scan(dim: int, k: int):
    """The ``k`` + 1 nearest entries of each query among the lists that it reads here, an entry of several lists once."""

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        names, found, scores, ids = [], [], [], []
        if entries.num_rows and asked.num_rows:
            entries = entries.take(pa.array(np.argsort(entries["list"].to_numpy(), kind="stable")))
            list_, vid, x = entries["list"].to_numpy(), entries["vid"].to_numpy(), _matrix(entries["v"], dim)
            read = asked["lists"].combine_chunks()
            wanted, ends = read.flatten().to_numpy(), read.offsets.to_numpy() - read.offsets[0].as_py()
            low, high = np.searchsorted(list_, wanted, "left"), np.searchsorted(list_, wanted, "right")
            take = []
            for n, (qid, q) in enumerate(zip(asked["qid"].to_pylist(), _matrix(asked["q"], dim))):
                rows = np.concatenate([np.arange(a, b) for a, b in zip(low[ends[n] : ends[n + 1]], high[ends[n] : ends[n + 1]])])
                _, once = np.unique(vid[rows], return_index=True)
                rows = rows[once]
                d = np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
                best = np.lexsort((vid[rows], d))[: k + 1]
                names += [qid] * len(best)
                take += rows[best].tolist()
                scores += d[best].tolist()
            rows = entries.take(pa.array(take, pa.int64()))
            found, ids = rows["vid"].to_pylist(), rows["ids"].to_pylist()
        return pa.table({"qid": pa.array(names, pa.int64()), "vid": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v) rows that take part, and their number of dimensions, the most frequent one (the least of those tied)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda e: e != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most.d if most else 0
    return rows.where(F.size("v") == dim), dim


def _top(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, ratio: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Distances are Euclidean in double precision, ties go to the smaller id, a row is no neighbour of its own id.
    Rows with a null id, a null, zero or non-finite vector, or another length than most take no part.  Repeated
    rows count once; an id with several vectors is a candidate with each.  All candidates come back where there
    are fewer than ``k``: a query whose lists hold too few is searched in all lists.  The centroids are fitted
    on at most ``SAMPLE`` vectors (those with the lowest hash); every row is indexed.  ``ratio`` stands in for the
    learned one.  No usable row gives an empty result; other columns are not read.
    """
    rows, dim = usable(vectors, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema)
    # Of equal vectors the k + 1 least ids; first within slices of the ids, so a frequent vector is no single task's.
    slices = rows.distinct().withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = slices.withColumn("rank", F.row_number().over(Window.partitionBy("v", "slice").orderBy("id"))).where(F.col("rank") <= k + 1)
    entries = settle(some.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("vid"), "v", F.slice("ids", 1, k + 1).alias("ids")))
    n = entries.count()
    sample = entries.select(F.xxhash64("v").alias("k"), "v").orderBy("k").limit(SAMPLE)
    index = bytes(sample.coalesce(1).mapInArrow(_fit(dim, max(1, min(n, SAMPLE) // LIST)), "index binary").first()["index"])
    fitted = Centroids.load(index)
    lists = len(fitted.points)
    splits = max(1, n * 2 // (max(1, lists) * _SPLIT))
    groups = min(lists, max(GROUPS, n * COPIES // (splits * GROUPED)))
    posted = entries.mapInArrow(_lists(index, dim, splits, groups), "group long, part long, list long, vid long, v array<double>, ids array<long>")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.col("v").alias("qv")).distinct()
    heads = entries.select(F.col("vid").alias("qid"), F.col("v").alias("q"))
    asked = settle(asked.join(heads, F.col("qv") == F.col("q")).select("query_id", "qid"))
    queries = heads.join(asked.select("qid").distinct(), "qid", "left_semi").select("qid", "q")

    def run(queries: DataFrame, probes: int, ratio: float) -> DataFrame:
        probed = queries.mapInArrow(_probes(index, dim, probes, ratio, splits, groups), "group long, part long, qid long, q array<double>, lists array<long>")
        found = posted.groupBy("group", "part").cogroup(probed.groupBy("group", "part")).applyInArrow(_scan(dim, k), "qid long, vid long, score double, ids array<long>")
        near = _top(found.dropDuplicates(["qid", "vid"]), "qid", [F.col("score"), F.col("vid")], k + 1).select("qid", "score", F.explode("ids").alias("vec_id"))
        near = _top(near.groupBy("qid", "vec_id").agg(F.min("score").alias("score")), "qid", [F.col("score"), F.col("vec_id")], k + 1).drop("rank")
        out = asked.join(near, "qid").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return _top(out, "query_id", [F.col("score"), F.col("vec_id")], k)

    best = settle(run(queries, fitted.probes if ratio is None else lists, fitted.ratio if ratio is None else ratio))
    short = asked.select("query_id").distinct().join(best.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < k).select("query_id")
    if n > 1 and lists > 1 and short.limit(1).count():
        again = run(queries.join(asked.join(short, "query_id").select("qid").distinct(), "qid", "left_semi"), lists, float("inf")).join(short, "query_id", "left_semi")
        best = best.join(short, "query_id", "left_anti").unionByName(again)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_vector_search(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
