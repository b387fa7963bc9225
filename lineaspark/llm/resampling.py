"""Importance resampling towards a target: hashed n-gram weights, then a distributed quickselect of the winners.

Tasks count the buckets of their features; the gains of all buckets are one array that every task holds, and a
document's weight is the sum of its features' places in it.  With a draw of its own added, a document's score is a Gumbel
key, and the highest scores are a sample without replacement.  The k-th key of all is found by rounds: some keys are
drawn at random as pivots, all rows are counted by the pivots they stand between or on, and only the part that holds the
k-th stays.  Rows up to that key are sorted and ranked by ranges; the others are never sorted.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle

BUCKETS, LEAST, PERCENT, SEED = 10_000, 20, 10, 2024
PIVOTS = 15  # pivots in a round
PIECE = 4096  # features handled at a time
KNOWN = 100_000  # features whose buckets a task remembers
RANGE_ROWS = 500_000  # winners that one task sorts, about
#: Digits, a-z (A-Z are lower-cased before) and everything outside ASCII, in the bytes of UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Buckets(dict):
    """The bucket of each feature, remembered for the first ``KNOWN`` of them."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        out = zlib.crc32(feature) % self.buckets
        if len(self) < KNOWN:
            self[feature] = out
        return out


def features(text: bytes, longest: int) -> Iterator[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by a space; a text is read word by word."""
    if longest == 1:
        for m in WORD.finditer(text.lower()):
            yield m.group()
        return
    last: deque[bytes] = deque(maxlen=longest)
    for m in WORD.finditer(text.lower()):
        last.append(m.group())
        for n in range(1, len(last) + 1):
            yield b" ".join(islice(last, len(last) - n, None))


def numbers(text: bytes, known: Buckets, longest: int) -> Iterator[np.ndarray]:
    """The buckets of a text's features, piece by piece."""
    todo = map(known.__getitem__, features(text, longest))
    while len(some := np.fromiter(islice(todo, PIECE), np.int64)):
        yield some


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column(batch.num_columns - 1).cast(pa.large_binary()):
        yield x.as_py()


def _counted(buckets: int, longest: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        known, n = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch):
                for some in numbers(text, known, longest):
                    n += np.bincount(some, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of ``texts`` (one column) fall into each bucket; ``buckets`` bounds what the driver gets."""
    parts = texts.mapInArrow(_counted(buckets, longest), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for x in parts.collect():
        out[x.bucket] = x.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket ``floor(1000 * ln(((t + 1) * (S + buckets)) / ((s + 1) * (T + buckets))))``."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    n = len(s)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weighed(gains: np.ndarray, longest: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gains))
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            words = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(_texts(batch)):
                for some in numbers(text, known, longest):
                    n[i] += len(some)
                    weight[i] += gains[some].sum()
                words[i] = n[i] if longest == 1 else sum(1 for _ in WORD.finditer(text.lower()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, words, weight))], names=["doc_id", "n_features", "n_words", "weight"])

    return run


def gumbel(id_col: Column, seed: int) -> Column:
    """``floor(-1000 * ln(-ln((h + 0.5) / 2**32)))``, h being the first 8 hex digits of ``sha256("<seed>:<id>")``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def kth(rows: DataFrame, by: list[str], k: int) -> tuple | None:
    """The ``k``-th (from 1) of the composite keys ``by`` of ``rows``, ascending; the keys are unlike and hold no null.

    Each round counts every row left exactly: those below, on and above each of the pivots, which are the keys with
    the least hashes of that round.  ``PIVOTS`` rows and twice as many counts reach the driver.  None if there are fewer.
    """
    key = F.struct(*by)
    left, made = rows.select(*by), False
    for round_ in range(1000):
        pivots = sorted(tuple(x) for x in left.orderBy(F.xxhash64(*by, F.lit(round_)), *by).limit(PIVOTS).collect())
        if not pivots:
            return None
        literal = [F.struct(*[F.lit(v).cast("long").alias(b) for b, v in zip(by, p)]) for p in pivots]
        counts = left.agg(*[F.count_if(key < p) for p in literal], *[F.count_if(key == p) for p in literal], F.count("*")).first()
        m = len(pivots)
        if k > counts[-1]:
            return None
        for p, below, on in zip(pivots, counts[:m], counts[m : 2 * m]):
            if below < k <= below + on:
                return p
        i = sum(x < k for x in counts[:m])  # pivots below the k-th
        k -= counts[i - 1] + counts[m + i - 1] if i else 0
        part = left
        if i:
            part = part.where(key > literal[i - 1])
        if i < m:
            part = part.where(key < literal[i])
        narrow = settle(part)
        if made:
            discard(left)
        left, made = narrow, True
    raise RuntimeError("pivots do not narrow the keys down")


def ranked(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """``rows`` with their rank by the columns ``by``: ranges are sorted apart and start where those before them end."""
    parts = max(1, -(-n // RANGE_ROWS))
    cut = settle(rows.repartitionByRange(parts, *by).withColumn("range", F.spark_partition_id()))
    sizes = cut.groupBy("range").agg(F.count("*").alias("size"))
    base = sizes.withColumn("base", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*by))
    return cut.withColumn("own", own).join(F.broadcast(base), "range").withColumn("rank", (F.col("own") + F.col("base")).cast("long")).drop("range", "own", "size", "base")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of ``docs``.

    ``floor(percent * N / 100)`` rows are drawn of the N that have ``least`` words or more: those with the highest
    scores, ties to the smaller id (a null id last, then by n_features); ``rank`` counts them from 1 and is null for all others.
    A null or empty text has no features and weight 0; an empty ``target`` counts as one without features.  Repeated rows
    count as often as they stand, and each has a rank of its own.  A null id draws as an empty one.  An empty table
    gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    aim = target.select(F.coalesce(F.col(f"`{target_col}`").cast("string"), F.lit("")).alias("text"))
    gains = gains_of(bucket_counts(docs.select(text.alias("text")), buckets, longest), bucket_counts(aim, buckets, longest))
    weighed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_weighed(gains, longest), "doc_id long, n_features long, n_words long, weight long")
    # Rows get a place of their own, written with them: keys are unlike then, and ties cannot be cut in two ways.
    rows = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("place", F.monotonically_increasing_id())
    rows = settle(rows)
    keys = {"high": -F.col("score"), "nil": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0)), "size": F.col("n_features"), "place": F.col("place")}
    keyed = rows.where(F.col("n_words") >= least).select(*[v.alias(k) for k, v in keys.items()])
    n = keyed.count() * percent // 100
    last = kth(keyed, list(keys), n) if n else None
    out = ("doc_id", "n_features", "weight", "score")
    if last is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    upto = F.struct(*[v.alias(k) for k, v in keys.items()]) <= F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(keys, last)])
    drawn = upto & (F.col("n_words") >= least)
    won = ranked(rows.where(drawn).withColumns(keys), list(keys), n).select(*out, "rank")
    return won.unionByName(rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
