"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, ``FILTERS`` learned filters slide over overlapping chunks of ``CHUNK`` bytes that cover
the whole document, each filter's largest response is kept, and a small layer combines these into one
probability.  The network is fitted in one task on a bounded number of labelled documents (``SAMPLE``); its
weights are a few dozen kilobytes and go to all tasks.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

STEP, CHUNK, DIM, FILTERS, HIDDEN = 8, 16, 8, 32, 16
SAMPLE, SAMPLE_BYTES = 4000, 128 << 20
THRESHOLD = 0.7
_PIECE = 1 << 19


class Network:
    """Weights and both passes.  A chunk is two neighbouring blocks of STEP bytes, so chunks overlap by half."""

    NAMES = ("embed", "conv", "bias", "w1", "b1", "w2", "b2")

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.embed, self.conv, self.bias = f32(256, DIM, scale=0.5), f32(CHUNK * DIM, FILTERS, scale=0.12), np.zeros(FILTERS, np.float32)
        self.w1, self.b1 = f32(FILTERS, HIDDEN, scale=0.2), np.zeros(HIDDEN, np.float32)
        self.w2, self.b2 = f32(HIDDEN, scale=0.3), np.zeros(1, np.float32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.NAMES})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Network:
        net = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as z:
            for k in cls.NAMES:
                setattr(net, k, z[k])
        return net

    def pool(self, texts: list[bytes], size: int = _PIECE) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter for each document, and the bytes of the chunk that it comes from.

        Documents are cut into whole blocks, two at least, zero padded.  At most about ``size`` bytes are embedded
        at once: longer documents go in pieces that share one block, so no chunk is lost.
        """
        top = np.full((len(texts), FILTERS), -np.inf, np.float32)
        best = np.zeros((len(texts), FILTERS, CHUNK), np.uint8)
        pieces: list[tuple[int, bytes]] = []
        room = size
        for d, text in enumerate(texts):
            whole = max(2, -(-len(text) // STEP)) * STEP
            step = max(STEP, size // STEP * STEP)
            for low in range(0, whole - STEP, step):
                piece = text[low : low + step + STEP].ljust(min(step + STEP, whole - low), b"\0")
                if len(piece) > room and pieces:
                    self._pool(pieces, top, best)
                    pieces, room = [], size
                pieces.append((d, piece))
                room -= len(piece)
        if pieces:
            self._pool(pieces, top, best)
        return np.maximum(top + self.bias, 0), best

    def _pool(self, pieces: list[tuple[int, bytes]], top: np.ndarray, best: np.ndarray) -> None:
        blocks = np.frombuffer(b"".join(p for _, p in pieces), np.uint8).reshape(-1, STEP)
        n = np.array([len(p) // STEP for _, p in pieces])
        first = np.cumsum(n) - n
        x = self.embed[blocks].reshape(len(blocks), -1)
        half = STEP * DIM
        out = x @ self.conv[:half]
        out[:-1] += x[1:] @ self.conv[half:]
        out[first + n - 1] = -np.inf  # a piece's last block begins no chunk
        high = np.maximum.reduceat(out, first, axis=0)
        for k, (d, _) in enumerate(pieces):
            new = np.flatnonzero(high[k] > top[d])
            if len(new):
                at = first[k] + out[first[k] : first[k] + n[k], new].argmax(axis=0)
                top[d, new] = high[k, new]
                best[d, new] = np.concatenate([blocks[at], blocks[at + 1]], axis=1)

    def logit(self, pooled: np.ndarray):
        hidden = np.maximum(pooled @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2[0], hidden

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z, _ = self.logit(self.pool(texts)[0])
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        pooled, best = self.pool(texts)
        z, hidden = self.logit(pooled)
        dz = ((1 / (1 + np.exp(-z)) - labels) / len(texts)).astype(np.float32)
        dh = np.outer(dz, self.w2) * (hidden > 0)
        dp = (dh @ self.w1.T) * (pooled > 0)
        doc, filt = np.nonzero(dp)
        d, chunk = dp[doc, filt], best[doc, filt]
        seen = self.embed[chunk].reshape(len(d), -1)
        conv = np.zeros_like(self.conv)
        for f in range(FILTERS):
            conv[:, f] = d[filt == f] @ seen[filt == f]
        embed = np.zeros_like(self.embed)
        np.add.at(embed, chunk, (d[:, None] * self.conv.T[filt]).reshape(-1, CHUNK, DIM))
        return {"embed": embed, "conv": conv, "bias": dp.sum(axis=0), "w1": pooled.T @ dh, "b1": dh.sum(axis=0), "w2": hidden.T @ dz, "b2": np.array([dz.sum()], np.float32)}

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 900, batch: int = 32, rate: float = 4e-3) -> None:
        """Adam over shuffled batches; both labels are drawn equally often, the prior is put back at the end."""
        r = np.random.default_rng(11)
        groups = [np.flatnonzero(labels == v) for v in (0, 1)]
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        for t in range(1, steps + 1):
            pick = np.concatenate([r.choice(g, batch // 2) for g in groups])
            g = self.gradients([texts[i] for i in pick], labels[pick].astype(np.float32))
            lr = rate * min(1, 2 * (1 - t / (steps + 1)))
            for k in self.NAMES:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                w = getattr(self, k)
                w -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + lr * 1e-3 * w).astype(np.float32)
        self.b2 = (self.b2 + np.log(len(groups[1]) / len(groups[0]))).astype(np.float32)


def _constant(score: float) -> Network:
    """A network that has learned nothing: every text gets one score."""
    net = Network()
    net.w2[:], net.b2[:] = 0, np.log(score / (1 - score))
    return net


def _train(batches):
    rows = [(x.as_py(), y.as_py(), k.as_py()) for b in batches for x, y, k in zip(b.column(0).cast(pa.binary()), b.column(1), b.column(2))]
    rows.sort(key=lambda x: (x[2], x[0]))
    labels = np.array([y for _, y, _ in rows])
    if len(set(labels.tolist())) == 2:
        net = Network()
        net.fit([x for x, _, _ in rows], labels)
    else:
        net = _constant((0.01, 0.99)[labels[0]] if len(labels) else 0.5)
    yield pa.RecordBatch.from_arrays([pa.array([net.dump()], pa.binary())], names=["weights"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """Weights fitted on at most ``sample`` labelled documents, those with the lowest hash of their id.

    Of these, the ones in that order up to ``sample_bytes`` bytes of text are learned, so one task can hold them.
    Labels other than 0 and 1, null ids and ids with differing labels are left out.  Without labels every
    score is one half; with one label only, 0.01 or 0.99.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y", F.xxhash64("doc_id").alias("k"))
    chosen = F.broadcast(known.orderBy("k").limit(sample))  # at most ``sample`` rows of three numbers
    rows = c.id_text(docs, id_col, text_col).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("k").alias("k")).select("text", "y", "k")
    before = F.sum(F.octet_length("text")).over(Window.orderBy("k"))  # of at most ``sample`` rows
    rows = rows.withColumn("before", before - F.octet_length("text")).where(F.col("before") <= sample_bytes).drop("before")
    fitted = rows.repartition(1).mapInArrow(_train, "weights binary").first()
    return bytes(fitted.weights) if fitted else _constant(0.5).dump()


def score_quality(docs: DataFrame, weights: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) for every row of ``docs``; the text alone decides.

    Null text is empty and scored as such.  Texts of any length are read whole, in pieces.  Repeated rows and null ids
    stay rows of their own; an empty table gives an empty result; other columns of ``docs`` are not read.
    """

    def run(batches):
        net = Network.load(weights)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1).cast(pa.binary())]
            out = [net.scores(texts[i : i + 256]) for i in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], names=["doc_id", "score"])

    return c.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id):
    """Rows whose label is never learned: those whose id's text has a CRC-32 with remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = fit_quality(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score_quality(docs, weights)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
