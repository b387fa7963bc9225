"""Compression of vectors to codes of parts: exact integer k-means over anchors-hierarchy metric trees.

A task grows trees over chunks of its vectors, one for each part: anchors take points from each other until there are
about as many as the square root of the points, are merged in pairs from the middle up to the root, and are
split in the same way down to the leaves.  Every ball keeps its centre, radius, sum and count.  In each round a ball
gets the entries that its parent could not rule out, and rules out those that are farther from all of its points than
another one; when a single entry is left, the ball's sum and count go to it whole.  Leaves compare their points with
the entries left.  Trees are a table in the shared folder, grown once and read in every round; the driver sees sums
by part, entry and position only, whose number the parameters fix.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, with_group

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CELLS = 1 << 18  # components of the vectors of a chunk, about
LEAF = 32
WHOLE = 1 << 28  # from this size of a component on, distances may not fit a long


def anchors(points: np.ndarray) -> np.ndarray:
    """For each point the number of its anchor; about as many anchors as the square root of the points.

    A new anchor stands on the point farthest from its own one, and takes the points that are nearer to it.  Of an
    anchor's points, only those farther away than half of the way to the new anchor can be.
    """
    want = max(2, int(np.sqrt(len(points))))
    owner = np.zeros(len(points), np.int64)
    at = [0]
    far = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(at) < want:
        new = int(far.argmax())
        if far[new] == 0:
            break
        half = np.sqrt(((points[at] - points[new]) ** 2).sum(axis=1)) / 2
        some = np.flatnonzero(far > half[owner])
        d = np.sqrt(((points[some] - points[new]) ** 2).sum(axis=1))
        taken = some[d < far[some]]
        owner[taken], far[taken] = len(at), d[d < far[some]]
        at.append(new)
    return np.unique(owner, return_inverse=True)[1]


def _merged(count: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls in the order of merging, the new ones numbered on; the smallest ball around two goes first."""
    n = len(count)
    count, centre, radius = list(count), list(centre), list(radius)
    near = np.full((2 * n, 2 * n), np.inf)

    def put(i: int, live: list[int]) -> None:
        if live:
            c, r = np.array([centre[j] for j in live]), np.array([radius[j] for j in live])
            d = (np.sqrt(((c - centre[i]) ** 2).sum(axis=1)) + r + radius[i]) / 2
            near[i, live] = near[live, i] = np.maximum(d, np.maximum(r, radius[i]))

    live, out = [], []
    for i in range(n):
        put(i, live)
        live.append(i)
    while len(live) > 1:
        a, b = divmod(int(near.argmin()), 2 * n)
        near[[a, b]] = near[:, [a, b]] = np.inf
        live = [x for x in live if x not in (a, b)]
        total = count[a] + count[b]
        c = (count[a] * centre[a] + count[b] * centre[b]) / total
        radius.append(max(np.linalg.norm(c - centre[a]) + radius[a], np.linalg.norm(c - centre[b]) + radius[b]))
        count.append(total)
        centre.append(c)
        put(len(count) - 1, live)
        live.append(len(count) - 1)
        out.append((a, b))
    return out


class Balls:
    """The metric tree of integer points; ``order`` puts the points of every ball side by side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        real = points.astype(np.float64)
        below: list[tuple[int, int]] = []
        held: list[np.ndarray] = []

        def node(pair: tuple[int, int], rows: np.ndarray) -> int:
            below.append(pair)
            held.append(rows)
            return len(below) - 1

        def grow(rows: np.ndarray) -> int:
            owner = anchors(real[rows]) if len(rows) > leaf else np.zeros(len(rows), np.int64)
            if not owner.any():
                return node((-1, -1), rows)
            groups = [rows[owner == k] for k in range(int(owner.max()) + 1)]
            centre = np.array([real[g].mean(axis=0) for g in groups])
            radius = np.array([np.sqrt(((real[g] - m) ** 2).sum(axis=1).max()) for g, m in zip(groups, centre)])
            ids = [grow(g) for g in groups]
            for a, b in _merged(np.array([len(g) for g in groups]), centre, radius):
                ids.append(node((ids[a], ids[b]), np.zeros(0, np.int64)))
            return ids[-1]

        root = grow(np.arange(len(points)))
        self.root, self.below = root, np.array(below, np.int64).reshape(-1, 2)
        n = len(below)
        self.start, self.end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order, stack = [], [(root, False)]
        place = 0
        while stack:
            i, left = stack.pop()
            if left:
                self.end[i] = place
                continue
            self.start[i] = place
            stack.append((i, True))
            if below[i][0] < 0:
                order.append(held[i])
                place += len(held[i])
            else:
                stack += [(below[i][1], False), (below[i][0], False)]
        self.order = np.concatenate(order)
        self.points = points[self.order]
        run = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])
        self.sum, self.count = run[self.end] - run[self.start], self.end - self.start
        self.centre = self.sum / self.count[:, None]
        self.radius = np.array([np.sqrt(((self.points[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(self.start, self.end, self.centre)])

    FIELDS = ("root", "below", "start", "end", "order", "points", "sum", "count", "centre", "radius")

    def dump(self, part: int) -> dict:
        return {f"{k}{part}": getattr(self, k) for k in self.FIELDS}

    @classmethod
    def load(cls, z, part: int) -> Balls:
        out = cls.__new__(cls)
        for k in cls.FIELDS:
            setattr(out, k, z[f"{k}{part}"])
        return out

    def owned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls that an entry of ``book`` owns whole and that entry; points of the other leaves and their entries.

        An entry is ruled out only where another is nearer to every point by more than rounding can hide, so
        points meet their nearest entry, the lower one of those tied.  Of equal entries only the first can win.
        """
        first = np.zeros(len(book), bool)
        first[np.unique(book, axis=0, return_index=True)[1]] = True
        real = book.astype(np.float64)
        slack = 1e-5 * (1 + np.sqrt(max((real**2).sum(axis=1).max(), (self.centre**2).sum(axis=1).max())))
        balls, which, rows, entries = [], [], [], []
        at, left = np.array([int(self.root)]), first[None]
        while len(at):
            d = np.sqrt(np.maximum((self.centre[at] ** 2).sum(axis=1)[:, None] - 2 * self.centre[at] @ real.T + (real**2).sum(axis=1), 0))
            d[~left] = np.inf
            left = left & (d <= (d.min(axis=1) + 2 * self.radius[at] + slack)[:, None])
            whole = left.sum(axis=1) == 1
            balls.append(at[whole])
            which.append(left[whole].argmax(axis=1))
            leaf = ~whole & (self.below[at, 0] < 0)
            if leaf.any():
                n = self.count[at[leaf]]
                own = np.repeat(self.start[at[leaf]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                d = squares(self.points[own], book)
                rows.append(own)
                entries.append(np.where(np.repeat(left[leaf], n, axis=0), d, d.max() + 1).argmin(axis=1))
            more = ~whole & ~leaf
            at, left = self.below[at[more]].ravel(), np.repeat(left[more], 2, axis=0)
        none = [np.zeros(0, np.int64)]
        return tuple(np.concatenate(x or none) for x in (balls, which, rows, entries))

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points of each entry."""
        balls, which, rows, entries = self.owned(book)
        total, n = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        np.add.at(total, which, self.sum[balls])
        np.add.at(n, which, self.count[balls])
        np.add.at(total, entries, self.points[rows])
        np.add.at(n, entries, 1)
        return total, n

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point, in the order it came, its entry and the squared distance to it."""
        balls, which, rows, entries = self.owned(book)
        code = np.empty(len(self.order), np.int64)
        n = self.count[balls]
        code[np.repeat(self.start[balls] - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.repeat(which, n)
        code[rows] = entries
        error = ((self.points - book[code]) ** 2).sum(axis=1)
        back = np.argsort(self.order)
        return code[back], error[back]


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, in doubles as long as these hold every term."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64
    p, b = points.astype(kind), book.astype(kind)
    return (p**2).sum(axis=1)[:, None] - 2 * p @ b.T + (b**2).sum(axis=1)


def _trees(dim: int, parts: int, scale: int):
    rows = max(64, CELLS // dim)
    width = dim // parts

    def chunk(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        v = np.floor(table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim) * scale)
        if np.abs(v).max() >= WHOLE:
            raise ValueError(f"components times {scale} must be below {WHOLE} in size")
        out: dict = {}
        for k in range(parts):
            out |= Balls(v[:, k * width : (k + 1) * width].astype(np.int64)).dump(k)
        to = io.BytesIO()
        np.savez(to, **out)
        lists = [pa.ListArray.from_arrays(np.array([0, table.num_rows], np.int32), table[x].combine_chunks()) for x in ("id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([to.getvalue()], pa.binary())], names=["ids", "labels", "trees"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == rows:
                    yield chunk(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield chunk(pa.Table.from_batches(held))

    return run


def _totals(books: np.ndarray):
    def run(batches) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        all_ = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for raw in batch.column(0):
                with np.load(io.BytesIO(raw.as_py())) as z:
                    for k in range(parts):
                        total, n = Balls.load(z, k).totals(books[k])
                        all_[k, :, :width] += total
                        all_[k, :, width] += n
        used = all_[:, :, width] > 0
        part, entry = np.nonzero(used)
        some = all_[used]
        where = np.tile(np.arange(width + 1, dtype=np.int32), len(part))
        columns = [np.repeat(part, width + 1).astype(np.int32), np.repeat(entry, width + 1).astype(np.int32), where, some.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["part", "entry", "place", "total"])

    return run


def _codes(books: np.ndarray):
    def run(batches) -> Iterator[pa.RecordBatch]:
        digits = max(2, len(f"{books.shape[1] - 1:x}"))
        for batch in batches:
            for i in range(batch.num_rows):
                with np.load(io.BytesIO(batch.column(2)[i].as_py())) as z:
                    found = [Balls.load(z, k).codes(books[k]) for k in range(len(books))]
                code = ["".join(f"{x:0{digits}x}" for x in row) for row in np.stack([x[0] for x in found], axis=1).tolist()]
                error = np.sum([x[1] for x in found], axis=0)
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for every usable row of ``vectors``.

    Components become ``floor(scale * x)``.  Each part's codebook starts as the parts of the ``entries`` rows with the
    smallest ids (fewer, if there are fewer; null ids last, equal ids by their vectors); each round assigns all
    parts and replaces every used entry by the floor of its mean.  Null vectors, those with null or non-finite
    components, and those of another length than most (the least of tied lengths) take no part.  A length that
    ``parts`` does not divide is an error, and so are components too large for exact distances.  Repeated rows count as often
    as they stand and come back as often; equal labels share ``label_error``, nulls together.  No usable row
    gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size("v") > 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not most:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dim = most.d
    if dim % parts:
        raise ValueError(f"{parts} parts do not divide {dim} components")
    rows = rows.where(F.size("v") == dim)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.floor(np.array([x.v for x in first]) * scale)
    if np.abs(books).max() >= WHOLE:
        raise ValueError(f"components times {scale} must be below {WHOLE} in size")
    books = np.ascontiguousarray(books.astype(np.int64).reshape(len(first), parts, -1).swapaxes(0, 1))
    trees = settle(rows.mapInArrow(_trees(dim, parts, scale), "ids array<long>, labels array<string>, trees binary"))
    for _ in range(rounds):
        sums = trees.select("trees").mapInArrow(_totals(books), "part int, entry int, place int, total long")
        found = np.array(sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect(), np.int64)
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        total[found[:, 0], found[:, 1], found[:, 2]] = found[:, 3]
        n = total[:, :, -1:]
        books = np.where(n > 0, total[:, :, :-1] // np.maximum(n, 1), books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = settle(trees.mapInArrow(_codes(books), "id long, label string, code string, error long"))
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    out = with_group(coded.withColumn("key", key), "key", ["id"], F.sum("error").alias("label_error"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
