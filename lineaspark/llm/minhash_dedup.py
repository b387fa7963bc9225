"""MinHash near-dedup: universal hash minima, banding, agreement of signatures, exact verification, connected components.

Rows of equal words are one node.  Nodes that share a band of minima are candidates and hang together through the
bucket's least one; the more bands of two signatures agree, the earlier that pair is verified.  Families of
candidates are verified on the words of whole texts (see ``families``), and links contracted by large-star and small-star steps.
Signatures alone decide nothing: the check on their agreement orders the work, since dropping a pair on it could lose a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import components
from .families import Shingles, bounded, family_links, node_of, small_batches, stars_of, texts_of_nodes


def minima(sets: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The least value of each universal hash ``times * x + plus`` modulo 2**32 over a set."""
    low = np.full(len(times), np.iinfo(np.uint32).max, np.uint32)
    x = (sets >> c.U(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        h = np.multiply.outer(times, x[i : i + 2048])
        h += plus[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return low


def _signatures(width: int, rows: int, bands: int, seed: int):
    def run(batches):
        r = np.random.default_rng(20240229)
        times = r.integers(0, 1 << 32, rows * bands, np.uint32) | np.uint32(1)
        plus = r.integers(0, 1 << 32, rows * bands, np.uint32)
        fold = r.integers(0, 1 << 62, rows).astype(c.U) * c.U(2) + c.U(1)
        band = np.arange(bands, dtype=c.U) * c.U(0x9E3779B97F4A7C15)
        for batch in small_batches(batches):
            s = Shingles([x.as_py() for x in batch.column(1).cast(pa.binary())], width)
            low = np.stack([minima(s.hash[b - n : b], times, plus) for b, n in zip(s.stop.tolist(), s.size.tolist())])
            with np.errstate(over="ignore"):
                key = c.mix((low.reshape(-1, bands, rows).astype(c.U) * fold).sum(axis=2, dtype=c.U) + band).astype(np.int64)
            keys = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * bands, key.ravel())
            names = [node_of(x, seed) if x else (None, None) for x in s.lines]
            nodes = [pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *nodes, pa.array(s.size, pa.int64()), keys], names=["doc_id", "node", "rest", "n", "keys"])

    return run


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rows: int = 5, bands: int = 40) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Two rows are linked if ``100 * intersection >= percent * union`` of their sets of ``width``-word
    shingles (all words as one shingle where there are fewer; A-Z lower-cased).  ``component_id`` is the least id reachable;
    ``kept`` says whether that is the row's own.  With ``rows`` and ``bands`` as given here a pair at the
    threshold is missed with a chance below 1e-6.  Null or blank texts have no shingles and are linked with
    nothing.  Rows are told apart by their texts: a repeated id links nothing, repeated rows share their fate.  A null id
    takes no part, has a null component and is kept.  An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    docs = c.id_text(docs, id_col, text_col)
    for seed in range(100):
        known = c.settle(docs.mapInArrow(_signatures(width, rows, bands, seed), "doc_id long, node long, rest long, n long, keys array<long>"))
        if not known.groupBy("node").agg(F.min("rest").alias("a"), F.max("rest").alias("b")).where("a <> b").limit(1).count():
            break  # no two texts share a node
        c.discard(known)
    usable = known.where("node is not null and doc_id is not null")
    sizes, brief = c.settle(usable.groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("low"))), c.settle(known.select("doc_id", "node", "n"))
    buckets = usable.groupBy("node").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "node")
    stars = c.settle(stars_of(buckets.withColumn("asks", F.lit(True))))
    c.discard(known)
    texts = texts_of_nodes(docs.where("doc_id is not null"), stars.select(F.explode(F.array("u", "v")).alias("node")).distinct(), seed)
    linked = components(family_links(stars, sizes.select("node", "n"), texts, width, percent))
    out = c.node_components(brief, sizes, linked)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return minhash_dedup(docs, width=3, percent=85, rows=6, bands=32)
