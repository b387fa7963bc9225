"""What the near-copy operators share: sets of shingles, and links inside families of candidates, verified on words.

A text's words, A-Z lower-cased, have a node: 64 bits of a cryptographic hash.  Candidates that hang together are a family.
Small families are verified whole, many in one task.  In a large one every set is compared with its strongest lead first; where
that leaves several parts, chunks of about one size, bounded in shingles and in sets, meet chunks whose sizes allow
a link, each two in one task, which gets all intersections from products of 0/1 matrices.  Tasks return one link for
each set at most.  So no pairs are written out, no task holds more than two chunks, and no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import components

CHUNK = 131_072  # shingles in a chunk, about
CHUNK_ROWS = 2_000  # sets in a chunk, at most: two chunks make a square matrix of both
STRIP = 256  # rows of that matrix at a time in what is made of it
BIN = 4 * CHUNK  # shingles of small families in a task, about
BROADCAST_IDS = 2_000_000  # numbers, 16 MB, that are broadcast at most


class Shingles:
    """The ``width``-word shingles of some texts, A-Z lower-cased; a text of fewer words is one shingle as a whole.

    Each text's words stand in one buffer with a space after each word.  ``doc``, ``start`` and ``end`` give the
    distinct shingles of every text, text by text, equality being decided on their bytes; ``hash`` goes with them.
    """

    def __init__(self, texts: list[bytes], width: int):
        self.lines = [b" ".join(x.lower().split()) for x in texts]
        raw = np.frombuffer(b"".join([x + b" " for x in self.lines if x]), np.uint8)
        stop = np.flatnonzero(raw == 32)
        start = np.append(0, stop[:-1] + 1)[: len(stop)]
        words = np.array([x.count(b" ") + 1 if x else 0 for x in self.lines], np.int64)
        k = np.minimum(words, width)
        n = np.where(words > 0, words - k + 1, 0)
        base = np.cumsum(words) - words
        doc = np.repeat(np.arange(len(texts)), n)
        first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + base[doc]
        a, b = start[first], stop[first + k[doc] - 1]
        h = c.span_hash(raw, a, b)
        _, place = c.name_spans(raw, a, b, doc, h=h)
        place = place[np.lexsort((h[place], doc[place]))]
        self.raw, self.doc, self.start, self.end, self.hash = raw, doc[place], a[place], b[place], h[place]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.stop = np.cumsum(self.size)


def small_batches(batches, rows: int = 512, size: int = 1 << 18):
    """Batches of few rows and bytes, so that what a task makes of one stays small."""
    for batch in batches:
        total = np.cumsum(pa.compute.binary_length(batch.column(1).cast(pa.binary())).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(total, (total[low - 1] if low else 0) + size, side="right"))
            high = min(max(high, low + 1), low + rows)
            yield batch.slice(low, high - low)
            low = high


def linked(place: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """For each set the least place of a set that it hangs together with by links; ``place`` numbers the items, set by set."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    often = np.bincount(place) > 1  # an item of one set is in no intersection
    column = np.cumsum(often) - 1
    use = often[place]
    row, place = row[use], column[place[use]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    shared = np.zeros((n, n), np.float32)
    for low in range(0, int(often.sum()), 2048):
        a, b = np.searchsorted(place, [low, low + 2048])
        m = np.zeros((n, 2048), np.float32)
        m[row[a:b], place[a:b] - low] = 1
        for s in range(0, n, STRIP):
            shared[s : s + STRIP] += m[s : s + STRIP] @ m.T
    link = np.zeros((n, n), bool)
    for s in range(0, n, STRIP):
        both = shared[s : s + STRIP].astype(np.int64)
        link[s : s + STRIP] = 100 * both >= percent * (size[s : s + STRIP, None] + size - both)
    del shared
    label = np.arange(n)
    while True:
        near = np.concatenate([np.where(link[s : s + STRIP], label, n).min(axis=1) for s in range(0, n, STRIP)])
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def chunk_links(sized: DataFrame, items: DataFrame, near: DataFrame, found: DataFrame, percent: int, run) -> DataFrame:
    """Links among classes that hang together by buckets but not by the links found so far.

    ``sized`` (id, n) and ``items`` (id and what ``run`` needs of it) bring the sets, ``run`` gives the links of a group of
    two chunks.  ``near`` and ``found`` give each node's component by buckets and by links.  Two nodes alone have met already.
    """
    nodes = near.select(F.col("node").alias("id"), F.col("component").alias("family")).join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    nodes = c.with_group(nodes, "family", ["id"], F.count("*").alias("k"), F.min("component").alias("a"), F.max("component").alias("b")).where("k > 2 and a < b").drop("k", "a", "b")
    # Sets of a family are dealt to classes of about one size, each class by hash to as many chunks as it needs.
    nodes = nodes.join(sized, "id").withColumn("kind", F.struct("family", F.floor(F.log(F.col("n").cast("double")) * 8).cast("int").alias("class")))
    need = F.ceil(1.1 * F.greatest(F.sum("n") / CHUNK, F.count("*") / CHUNK_ROWS)).cast("int").alias("need")
    nodes = c.with_group(nodes, "kind", ["id"], need)
    nodes = c.settle(nodes.select("id", "family", "component", "n", F.struct("kind.class", F.pmod(F.xxhash64("id"), F.col("need")).alias("cut")).alias("chunk")))
    chunks = nodes.groupBy("family", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("a"), F.max("component").alias("b"))
    one = chunks.select("family", *[F.col(x).alias(f"{x}1") for x in ("chunk", "low", "high", "a", "b")])
    two = chunks.select("family", *[F.col(x).alias(f"{x}2") for x in ("chunk", "low", "high", "a", "b")])
    meet = one.join(two, "family").where("chunk1 <= chunk2").where(100 * F.col("high1") >= percent * F.col("low2")).where("least(a1, a2) < greatest(b1, b2)")
    sides = meet.select("family", "chunk1", "chunk2", F.explode(F.array_distinct(F.array("chunk1", "chunk2"))).alias("chunk"))
    rows = sides.join(nodes.select("family", "chunk", "id"), ["family", "chunk"]).join(items, "id").select("family", "chunk1", "chunk2", *items.columns)
    return rows.groupBy("family", "chunk1", "chunk2").applyInArrow(run, "u long, v long")


def node_of(line: bytes, seed: int) -> tuple[int, int]:
    """128 bits of a text's words in two numbers; the first, its node, is even."""
    d = hashlib.blake2b(line, digest_size=16, person=str(seed).encode()).digest()
    return int.from_bytes(d[:8], "little", signed=True) & ~1, int.from_bytes(d[8:], "little", signed=True)


def _texts(seed: int, wanted: np.ndarray | None):
    """(node, text) of the texts with words, A-Z lower-cased, one space between words; of ``wanted`` nodes if given."""

    def run(batches):
        for batch in batches:
            lines = [b" ".join((x.as_py() or b"").lower().split()) for x in batch.column(1).cast(pa.binary())]
            some = [(node_of(x, seed)[0], x) for x in lines if x]
            if wanted is not None and some:
                at = np.searchsorted(wanted, [a for a, _ in some])
                some = [x for x, i in zip(some, at.tolist()) if i < len(wanted) and wanted[i] == x[0]]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary()).cast(pa.string())], names=["node", "text"])
        c.release()

    return run


def bounded(rows: DataFrame, column: str) -> np.ndarray | None:
    """The sorted values of ``rows``, if there are at most ``BROADCAST_IDS`` of them (16 MB); else None."""
    if rows.count() > BROADCAST_IDS:
        return None
    return np.sort(np.array([x[0] for x in rows.select(column).collect()], np.int64))


def texts_of_nodes(docs: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """(node, text) of the ``nodes``, each once: words A-Z lower-cased, one space between them.  Without a list of nodes that is
    small enough to broadcast, all texts are shuffled."""
    wanted = bounded(nodes, "node")
    texts = docs.select("doc_id", "text").mapInArrow(_texts(seed, wanted), "node long, text string")
    if wanted is None:
        texts = texts.join(nodes, "node", "left_semi")
    return c.settle(texts.dropDuplicates(["node"]))


def _numbered(texts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, Shingles]:
    """Numbers of the shingles of ``texts``, equal exactly for equal words."""
    s = Shingles([x.as_py() for x in texts.cast(pa.binary())], width)
    return c.name_spans(s.raw, s.start, s.end)[0], s


def _whole_families(width: int, percent: int):
    """Links inside the small families of a bin, at most one for each set."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("id", "ascending")])
        place, s = _numbered(table["text"], width)
        ids, family = table["id"].to_numpy(), table["family"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(family)) + 1, [len(family)]]) if len(family) else [0]
        us, vs = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            low = int(s.stop[a] - s.size[a])
            label = linked(np.unique(place[low : s.stop[b - 1]], return_inverse=True)[1], s.size[a:b], percent)
            hit = np.flatnonzero(label < np.arange(len(label)))
            us.append(ids[a + label[hit]])
            vs.append(ids[a + hit])
        none = [np.zeros(0, np.int64)]
        return pa.table({"u": np.concatenate(us or none), "v": np.concatenate(vs or none)})

    return c.lean(run)


def _chunk_pairs(width: int, percent: int):
    """Links between the sets of two chunks, at most one for each set."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        place, s = _numbered(table["text"], width)
        ids = table["id"].to_numpy()
        label = linked(place, s.size, percent)
        hit = label < np.arange(len(label))
        return pa.table({"u": ids[label[hit]], "v": ids[hit]})

    return c.lean(run)


def _alike(width: int, percent: int):
    """The pairs whose two texts are alike enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                s = Shingles([batch.column(k)[i].as_py().encode() for k in (2, 3)], width)
                name = c.name_spans(s.raw, s.start, s.end)[0]
                both = len(np.intersect1d(name[: s.size[0]], name[s.size[0] :], assume_unique=True))
                keep.append(100 * both >= percent * (int(s.size.sum()) - both))
            hit = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["u", "v"])

    return run


def stars_of(members: DataFrame) -> DataFrame:
    """(u, v, n): each set with the least one under a key, and under how many keys, where the key has a set that asks."""
    lead = members.groupBy("key").agg(F.min("node").alias("u"), F.max("asks").alias("asked"), F.max("node").alias("far")).where("asked and u < far").select("key", "u")
    return members.join(lead, "key").where("node <> u").groupBy("u", F.col("node").alias("v")).agg(F.count("*").alias("n"))


def family_links(stars: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v) links that join what is linked inside the families that ``stars`` hold together."""
    near = components(stars.select("u", "v"))
    rows = near.select(F.col("node").alias("id"), F.col("component").alias("family")).join(sizes.withColumnRenamed("node", "id"), "id")
    rows = c.settle(c.with_group(rows, "family", ["id"], F.count("*").alias("k"), F.sum("n").alias("shingles")))
    small = (F.col("k") <= CHUNK_ROWS) & (F.col("shingles") <= CHUNK)
    some = rows.where(small)
    bins = 1 + int(some.agg(F.sum("n")).first()[0] or 0) // BIN
    by_id = texts.withColumnRenamed("node", "id")
    dealt = some.withColumn("bin", F.pmod(F.xxhash64("family"), F.lit(bins))).join(by_id, "id").select("bin", "family", "id", "text")
    links = dealt.groupBy("bin").applyInArrow(_whole_families(width, percent), "u long, v long")
    if not rows.where(~small).limit(1).count():
        return c.settle(links)
    # In large families each set meets the lead it shares most subsets with, before chunks meet.
    large = rows.where(~small).select("id", "family", "n")
    best = stars.join(large.select(F.col("id").alias("v")), "v").groupBy("v").agg(F.max_by("u", F.struct("n", "u")).alias("u")).select("u", "v")
    cut = c.slices_of(best, "u", ["v"], 64)
    left = cut.select("u", "slice").distinct().join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    both = cut.join(left, ["u", "slice"]).join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")
    sure = c.settle(both.mapInArrow(_alike(width, percent), "u long, v long"))
    inside = large.select(F.col("id").alias("node"), F.col("family").alias("component"))
    more = chunk_links(large.select("id", "n"), by_id, inside, components(sure), percent, _chunk_pairs(width, percent))
    return c.settle(links.unionByName(sure).unionByName(more))
