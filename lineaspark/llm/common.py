"""Helpers shared by the corpus operators: block packing, hashes of spans, winnowing, checkpoints.

Documents are dealt to *blocks* by a hash of their id.  A block is the unit that Python sees at once;
the number of blocks follows the corpus, so a block stays near ``BLOCK_BYTES`` whatever the input size.
Before the shuffle each map task packs the documents of one block into one zstd blob, which halves
the shuffled bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
PACK_SCHEMA = "block int, payload binary"

U = np.uint64
_LONG = 512
_LEFT, _RIGHT = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
_SEED = np.random.default_rng(4127).integers(0, 1 << 64, 256, np.uint64, endpoint=False)


def ensure_checkpoint(spark: SparkSession) -> str:
    """The shared folder for checkpoints, named by ``spark.checkpoint.dir`` or set on the context.

    Where neither is set, a local session gets a folder of its own; on a cluster that is an error, since
    executors would write to their own disks.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(f"file:///tmp/lineaspark-{uuid.uuid4().hex}")
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    Unlike a checkpoint, the table read back brings its true size to the optimizer, which loops of joins need.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`settle` that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Only id and text, under fixed names, so that no other column of the input can clash; null text is empty.

    ``carry`` names columns that go along in one struct, ``row``.
    """
    more = [F.struct(*[F.col(f"`{x}`") for x in carry]).alias("row")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def count_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks needed for ``docs`` (as made by :func:`id_text`); one pass over the text column."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, -(-int(total) // block_bytes))


def _pack_batches(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        table = pa.Table.from_batches([batch]).sort_by("block")
        block = table["block"].to_numpy()
        if not len(block):
            continue
        cuts = np.flatnonzero(np.diff(block)) + 1
        edges = np.concatenate([[0], cuts, [len(block)]])
        names, blobs = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            sink = pa.BufferOutputStream()
            part = table.slice(a, b - a).drop_columns("block").combine_chunks()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_table(part)
            names.append(int(block[a]))
            blobs.append(squeeze.compress(sink.getvalue()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "payload"])


def pack(docs: DataFrame, n_blocks: int) -> DataFrame:
    """(block, payload) rows of ``docs`` (as made by :func:`id_text`)."""
    block = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(n_blocks)).cast("int")
    return docs.select(block.alias("block"), *docs.columns).mapInArrow(_pack_batches, PACK_SCHEMA)


def unpack(table: pa.Table) -> pa.Table:
    """The documents of one block, ordered by id (nulls last), then text."""
    if not table.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    open_ = zstandard.ZstdDecompressor()
    parts = [pa.ipc.open_stream(open_.decompressobj().decompress(x.as_py())).read_all() for x in table["payload"]]
    return pa.concat_tables(parts).combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def release() -> None:
    """Give memory that this worker has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def lean(run):
    """``run``, a function of a grouped table; its worker then gives unused memory back, since idle workers stay."""

    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    return one


def lean_pair(run):
    """:func:`lean` for a function of two cogrouped tables."""

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        release()
        return out

    return two


def texts_of(docs: pa.Table) -> list[bytes]:
    return [x.as_py() for x in docs["text"].cast(pa.binary())] if docs.num_rows else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U(33))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two in order; shifts between the products leave no polynomial to attack."""
    with np.errstate(over="ignore"):
        h = (a ^ (a >> U(31))) * _LEFT + b
        h ^= h >> U(32)
        h *= _RIGHT
        h ^= h >> U(29)
    return h


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end], equal for equal contents wherever they stand.

    Spans of a power of two are hashed from their halves, for all places at once; any other length takes the
    two such spans that cover it, and its length.  Spans of ``_LONG`` values or more are hashed one by one.
    Unlike contents may share a hash, so results are never decided on one: see :func:`name_spans`.
    """
    size = (end - start).astype(np.int64)
    out = mix(size.astype(U))
    level = np.frexp(np.maximum(size, 1))[1] - 1
    level[size >= _LONG] = -1
    level[size == 0] = -2
    top = int(level.max(initial=-2))
    if top >= 0:
        h = _pair(_SEED[values] if values.dtype == np.uint8 else mix(values.astype(U) + _LEFT), _RIGHT)
        for k in range(top + 1):
            if k:
                h = _pair(h[: -(1 << (k - 1))], h[1 << (k - 1) :])
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = _pair(_pair(h[start[at]], h[end[at] - (1 << k)]), out[at])
    for i in np.flatnonzero(level == -1).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(values[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """:func:`span_hash` of values[i:i+width] for every i; widths from ``_LONG`` on go another way, equal in themselves."""
    n = len(values) - width + 1
    if n <= 0 or width < 1:
        return np.zeros(max(0, n), U)
    h = _pair(_SEED[values] if values.dtype == np.uint8 else mix(values.astype(U) + _LEFT), _RIGHT)
    k = 1
    while 2 * k <= width:
        h = _pair(h[:-k], h[k:])
        k *= 2
    return _pair(_pair(h[:n], h[width - k : width - k + n]), mix(np.array([width], U)))


def same_spans(values: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> bool:
    """Whether values[a:a+size] equals values[b:b+size] for every pair; compared in pieces of bounded length."""
    keep = (a != b) & (size > 0)
    a, b, size = a[keep], b[keep], size[keep]
    while len(a):
        m = max(1, int(np.searchsorted(np.cumsum(size), most, side="right")))
        if m == 1:
            if not np.array_equal(values[a[0] : a[0] + size[0]], values[b[0] : b[0] + size[0]]):
                return False
        else:
            n = size[:m]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if (values[np.repeat(a[:m], n) + step] != values[np.repeat(b[:m], n) + step]).any():
                return False
        a, b, size = a[m:], b[m:], size[m:]
    return True


def name_spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, tag: np.ndarray | None = None, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, and where each number first stands; numbers are equal exactly for equal contents and ``tag``.

    Spans are sorted by hash; neighbours of one hash are then compared value by value.  Should two unlike spans share
    a hash, all are numbered by their contents.  ``h`` brings the hashes, where they are known.
    """
    start, end = start.astype(np.int64), end.astype(np.int64)
    h = span_hash(values, start, end) if h is None else h
    if tag is not None:
        h = _pair(h, mix(tag.astype(U)))
    order = np.argsort(h, kind="stable")
    s = h[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    i = np.flatnonzero(~head)
    a, b = order[i - 1], order[i]
    size = end - start
    fine = (size[a] == size[b]).all() and (tag is None or (tag[a] == tag[b]).all())
    if fine and same_spans(values, start[a], start[b], size[a]):
        out = np.empty(len(s), np.int64)
        out[order] = np.cumsum(head) - 1
        return out, order[head]
    place: dict = {}
    marks = tag.tolist() if tag is not None else [0] * len(start)
    out = np.array([place.setdefault((values[x:y].tobytes(), t), len(place)) for x, y, t in zip(start.tolist(), end.tolist(), marks)], np.int64)
    return out, np.unique(out, return_index=True)[1]


def window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """min(keys[i:i+width]) for every i with a full window, by block-wise running minima."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    pad = -len(keys) % width
    k = np.concatenate([keys, np.full(pad, np.iinfo(U).max, U)]).reshape(-1, width)
    left = np.minimum.accumulate(k, axis=1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def winnow(hashes: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the grams that are the leftmost minimum of some whole window inside one document.

    ``hashes[i]`` is the hash of values[i:i+gram].  Equal windows choose the same place in themselves, so
    a repeated window always holds a repeated chosen gram.
    """
    width = window - gram + 1
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    low = U((1 << int(n).bit_length()) - 1)
    lows = window_min((hashes & ~low) | np.arange(n, dtype=U), width)
    inside = np.zeros(n + window + 1, np.int32)
    whole = doc_end - doc_start >= window
    np.add.at(inside, doc_start[whole], 1)
    np.add.at(inside, doc_end[whole] - window + 1, -1)
    lows = lows[np.cumsum(inside)[: len(lows)] > 0]
    return np.unique((lows & low).astype(np.int64))


def name_windows(values: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Numbers, at the places ``at`` (ascending), equal exactly for equal values[i:i+width]; -1 elsewhere.

    Windows of one hash are compared with the first of them.  Where the windows one place before are of one hash
    too, the last value decides; this leans on earlier places only, so every equality goes back to a full comparison.
    """
    h = gram_hashes(values, width)[at]
    order = np.argsort(h, kind="stable")
    s = h[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    own = np.empty(len(s), np.int64)
    own[order] = np.cumsum(head) - 1
    first = at[order[head]][own] if len(at) else at
    out = np.full(len(values) + 1, -1, np.int64)  # the last place answers for the one before the first
    out[at] = own
    near = (at != first) & (out[at - 1] >= 0) & (out[at - 1] == out[first - 1])
    last = width - 1
    far = (at != first) & ~near
    if (values[at[near] + last] == values[first[near] + last]).all() and same_spans(values, at[far], first[far], np.full(int(far.sum()), width)):
        return out[:-1]
    out[at] = name_spans(values, at, at + width)[0]
    return out[:-1]


def repeated(number: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Whether the entries of each number, from 0 on, have a total weight of two or more."""
    if not len(number):
        return np.zeros(0, bool)
    if number.max() > 8 * len(number) + (1 << 16):
        _, number = np.unique(number, return_inverse=True)
    return np.bincount(number, weights=weight)[number] >= 2


def extents(group, weight, have_left, have_right, key, reach: int, window: int):
    """For each entry the largest and the smallest offset of its anchor in a window that occurs twice, -1 for none.

    ``key(rows, m)`` gives a number for each of ``rows`` that is equal exactly for entries whose window with
    the anchor at offset ``m`` is equal.  ``weight`` counts an entry's occurrences.  ``group`` numbers the
    anchors' grams; only entries of one group can match, which bounds the work to groups still open.
    """
    n = len(weight)
    high, low = np.full(n, -1, np.int16), np.full(n, -1, np.int16)
    size = np.bincount(group, weights=weight, minlength=group.max() + 1 if n else 0) if n else np.zeros(0)
    for found, order in ((high, range(reach, -1, -1)), (low, range(reach + 1))):
        open_ = (size[group] >= 2) if found is high else high >= 0
        for m in order:
            if not open_.any():
                break
            live = np.zeros(len(size), bool)
            live[group[open_]] = True
            rows = np.flatnonzero(live[group] & (have_left >= m) & (have_right >= window - m))
            if not len(rows):
                continue
            hit = rows[repeated(key(rows, m), weight[rows])]
            hit = hit[open_[hit]]
            found[hit] = m
            open_[hit] = False
    return high, low


def union_mask(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the half-open intervals."""
    step = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def slices_of(rows: DataFrame, key: str, by: list[str], slices: int = 256) -> DataFrame:
    """``rows`` with ``slice``, a hash of ``by``: rows of one ``key`` fall into at most ``slices`` of them."""
    return rows.withColumn("slice", F.pmod(F.xxhash64(*by), F.lit(slices)).cast("int"))


def with_group(rows: DataFrame, key: str, by: list[str], *aggregates) -> DataFrame:
    """``rows`` with aggregates over their ``key``, however many rows one key has.

    The aggregate is combined before the shuffle and goes back to the slices that the key's rows fall into, so the
    rows of a frequent key are dealt to many tasks.  Rows without a key are left out.
    """
    cut = slices_of(rows, key, by)
    total = cut.groupBy(key).agg(*aggregates, F.collect_set("slice").alias("slice"))
    return cut.join(total.withColumn("slice", F.explode("slice")), [key, "slice"]).drop("slice")


def node_components(rows: DataFrame, sizes: DataFrame, linked: DataFrame) -> DataFrame:
    """``rows`` (doc_id, node, n) with component_id, the least id of the nodes that ``linked`` (node, component) joins theirs with.

    ``sizes`` (node, low) has each node's least id.  A row without words (n = 0) has its own id, a row without an id none.  The
    rows of a frequent node are dealt to slices.
    """
    ids = with_group(linked.join(sizes.select("node", "low"), "node"), "component", ["node"], F.min("low").alias("component_id")).select("node", "component_id")
    ids = sizes.select("node", "low").join(ids, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    narrow = slices_of(rows, "node", ["doc_id"])
    there = narrow.where("node is not null").groupBy("node").agg(F.collect_set("slice").alias("slice"))
    ids = ids.join(there, "node").select("node", F.explode("slice").alias("slice"), F.col("component_id").alias("found"))
    out = narrow.join(ids, ["node", "slice"], "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n", comp.alias("component_id"))


FREQUENT = 20_000  # occurrences from which a gram's windows are counted by digest


def repeated_grams(seen: DataFrame, frequent: int) -> DataFrame:
    """(block, g, frequent) of the grams that ``seen`` (g, block, n) has twice; ``frequent`` marks those above that number."""
    total = F.sum("n").over(Window.partitionBy("g"))  # a row for each block at most
    return seen.withColumn("total", total).where("total > 1").select("block", "g", (F.col("total") > frequent).alias("frequent"))


def starts_around(pos: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Where windows begin that hold a gram at one of ``pos`` and lie inside its document."""
    doc = np.searchsorted(doc_end, pos, side="right")
    low, high = np.maximum(pos - (window - gram), doc_start[doc]), np.minimum(pos, doc_end[doc] - window)
    return np.flatnonzero(union_mask(int(doc_end[-1]) + 1, low, np.maximum(high + 1, low))) if len(pos) else pos


def counted_windows(values: np.ndarray, hashes: np.ndarray, at: np.ndarray, window: int, text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows that begin at ``at``: rows of 64-bit hash and 128-bit digest, their counts, one place of each."""
    number, first = name_spans(values, at, at + window, h=hashes[at])
    digest = b"".join(hashlib.blake2b(text(i), digest_size=16).digest() for i in at[first].tolist())
    key = np.concatenate([hashes[at[first]][:, None], np.frombuffer(digest, U).reshape(-1, 2)], axis=1)
    return key, np.bincount(number, minlength=len(first)), at[first]


def dealt_windows(key: np.ndarray, n: np.ndarray, block: int, parts: int):
    """(part, bytes) of the windows of one block, dealt by digest; five numbers a window."""
    rows = np.concatenate([key, n.astype(U)[:, None], np.full((len(n), 1), block, U)], axis=1)
    part = (key[:, 1] % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        yield int(part[some[0]]), rows[some].tobytes()


def repeated_windows(blobs: pa.ChunkedArray) -> pa.Table:
    """(block, w, key) of the windows in the compressed ``blobs`` of :func:`dealt_windows` that occur twice."""
    open_ = zstandard.ZstdDecompressor()
    raw = b"".join(open_.decompress(x.as_py()) for x in blobs if x.is_valid)
    rows = np.frombuffer(raw, U).reshape(-1, 5)
    if len(rows):
        _, number = np.unique(np.ascontiguousarray(rows[:, 1:3]).view("V16").ravel(), return_inverse=True)
        rows = rows[repeated(number, rows[:, 3].astype(np.float64))]
    key = np.ascontiguousarray(rows[:, 1:3]).tobytes()
    keys = pa.array([key[i : i + 16] for i in range(0, len(key), 16)], pa.binary())
    return pa.table({"block": rows[:, 4].astype(np.int32), "passage": pa.nulls(len(rows), pa.binary()), "w": np.ascontiguousarray(rows[:, 0]).view(np.int64), "key": keys})


def found_windows(found: pa.Table, hashes: np.ndarray, doc_end: np.ndarray, window: int, text) -> list[int]:
    """Where the windows inside one document begin whose hash and digest are among ``found``."""
    rows = found.filter(found["key"].is_valid())
    keys = set(rows["key"].to_pylist())
    at = np.flatnonzero(np.isin(hashes.view(np.int64), rows["w"].to_numpy()))
    at = at[at + window <= doc_end[np.searchsorted(doc_end, at, side="right")]]
    return [i for i in at.tolist() if hashlib.blake2b(text(i), digest_size=16).digest() in keys]
