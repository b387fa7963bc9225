"""Suffix-array dedup: remove bytes covered by a long byte string that occurs twice.

A full suffix array of the corpus is far larger than the corpus.  Here only the suffixes at *anchors* are
sorted: places that winnowing picks so that every window of ``window`` bytes holds one, at the same offset
in equal windows.  Anchors whose ``gram`` bytes occur once cannot lie in a repeated window and are dropped.

1. Each block of documents lists its distinct anchor grams; grams seen twice go on.
2. Each block sorts the suffixes (``window`` bytes) of its remaining anchors, equal contexts collapsed to
   one entry with a count, and sends each merge task a front-coded run: the prefix shared with the entry
   before, then the rest of the bytes, beside the bytes left of the anchor.
3. A merge task combines the runs of all blocks by a loser tree that compares only bytes beyond the known
   common prefixes, and so gets the common prefix of neighbours for nothing.  From these and the sorted
   left sides follows, for each entry, how far the repeated windows that hold the anchor reach.
4. The reaches go back to the blocks, which remove the bytes.

Of a gram with more than ``frequent`` occurrences a block sends the digests of the windows around it, with their
counts, dealt by digest, so that no task gets all suffixes behind one gram.  Equality is decided on bytes, for such
grams between blocks on 128 bits of a cryptographic hash of the bytes.  Other hashes only choose anchors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WINDOW, GRAM = 200, 64
MERGE_BYTES = 8 << 20


class _Block:
    """The documents of one block as one byte buffer, with anchors and the names of their contexts."""

    def __init__(self, docs: pa.Table, window: int, gram: int):
        self.texts = c.texts_of(docs)
        self.window, self.gram, self.reach = window, gram, window - gram
        size = np.array([len(x) for x in self.texts], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        n = len(self.bytes)
        grams = c.gram_hashes(self.bytes, gram)
        self.pos = c.winnow(grams, self.start, self.end, gram, window)
        self.gram_hash = grams[self.pos].astype(np.int64)

    def bytes_at(self, i: int) -> bytes:
        return self.bytes[i : i + self.window].tobytes()

    def contexts(self, pick: np.ndarray) -> None:
        """For some of the anchors their reach inside their document, and numbers equal exactly for equal bytes there."""
        at = self.pos[pick]
        doc = np.searchsorted(self.end, at, side="right")
        self.left = np.minimum(at - self.start[doc], self.reach)
        self.right = np.minimum(self.end[doc] - at, self.window)
        self.context, _ = c.name_spans(self.bytes, at - self.left, at + self.right, self.left)


def _grams(window: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        b = _Block(c.unpack(table), window, gram)
        g, n = np.unique(b.gram_hash, return_counts=True)
        block = np.full(len(g), table["block"][0].as_py(), np.int32)
        return pa.table({"g": g, "block": block, "n": n.astype(np.int32)})

    return run


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted rows of equal length as (prefix shared with the row before, the remaining bytes)."""
    shared = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    keep = np.arange(rows.shape[1]) >= shared[:, None]
    return shared, rows[keep].tobytes()


def _runs(window: int, gram: int, parts: int):
    reach = max(1, window - gram)  # a column at least

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        names, blobs, windows = [], [], []
        done = lambda: pa.table({"part": pa.array(names, pa.int32()), "run": pa.array(blobs, pa.binary()), "windows": pa.array(windows, pa.binary())})
        if not docs.num_rows or not wanted.num_rows:
            return done()
        block = docs["block"][0].as_py()
        b = _Block(c.unpack(docs), window, gram)
        squeeze = zstandard.ZstdCompressor(level=3)
        frequent, asked = wanted["frequent"].to_numpy(zero_copy_only=False), wanted["g"].to_numpy()
        often = b.pos[np.isin(b.gram_hash, asked[frequent])]
        if len(often):
            at = c.starts_around(often, b.start, b.end, gram, window)
            key, n, _ = c.counted_windows(b.bytes, c.gram_hashes(b.bytes, window), at, window, b.bytes_at)
            for part, blob in c.dealt_windows(key, n, block, parts):
                names.append(part)
                blobs.append(None)
                windows.append(squeeze.compress(blob))
        pick = np.flatnonzero(np.isin(b.gram_hash, asked[~frequent]))
        if not len(pick):
            return done()
        b.contexts(pick)
        _, first, count = np.unique(b.context, return_index=True, return_counts=True)
        pick, have_left, have_right = pick[first], b.left[first], b.right[first]
        edge = np.concatenate([np.zeros(reach, np.uint8), b.bytes, np.zeros(window, np.uint8)])
        right = edge[b.pos[pick][:, None] + reach + np.arange(window)]
        right[np.arange(window) >= have_right[:, None]] = 0
        left = edge[b.pos[pick][:, None] + reach - 1 - np.arange(reach)]
        left[np.arange(reach) >= have_left[:, None]] = 0
        part = (b.gram_hash[pick].astype(c.U) % c.U(parts)).astype(np.int32)
        order = np.lexsort((np.ascontiguousarray(right).view(f"S{window}").ravel(), part))
        for p, rows in zip(*_split(part, order)):
            shared, rest = front_code(right[rows])
            blob = pa.table({
                "shared": pa.array(shared.astype(np.int32)), "n": pa.array(count[rows].astype(np.int32)), "place": pa.array(pick[rows]),
                "have_left": pa.array(have_left[rows].astype(np.int32)), "have_right": pa.array(have_right[rows].astype(np.int32)),
                "left": pa.FixedSizeBinaryArray.from_buffers(pa.binary(reach), len(rows), [None, pa.py_buffer(left[rows].tobytes())]),
            }).replace_schema_metadata({"block": str(block)})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, blob.schema) as out:
                out.write_table(blob)
            names.append(p)
            head = sink.getvalue().to_pybytes()
            blobs.append(squeeze.compress(len(head).to_bytes(8, "little") + head + rest))
            windows.append(None)
        return done()

    return run


def _split(part: np.ndarray, order: np.ndarray):
    p = part[order]
    cuts = np.flatnonzero(np.diff(p)) + 1
    rows = np.split(order, cuts) if len(order) else []
    return [int(part[r[0]]) for r in rows], rows


class LoserTree:
    """Merge of sorted runs of equal-length byte strings, given with the prefix each shares with the one before.

    Every run's head carries the length it shares with the last string put out.  The longer shared prefix
    wins without looking at bytes; at equal lengths only the bytes beyond are compared.
    """

    def __init__(self, runs: list[tuple[np.ndarray, bytes]], width: int):
        self.width = width
        self.shared = [x.tolist() for x, _ in runs]
        self.rest = [y for _, y in runs]
        k = len(runs)
        self.leaf = 1 << max(0, (k - 1).bit_length())
        self.at, self.off = [-1] * self.leaf, [0] * self.leaf
        self.head: list[bytes | None] = [None] * self.leaf
        self.known = [-1] * self.leaf
        for i in range(k):
            self.known[i] = 0
            self._next(i)
            if self.head[i] is not None:
                self.known[i] = 0
        self.node = [-1] * (2 * self.leaf)
        win = [*([-1] * self.leaf), *range(self.leaf)]
        for i in range(self.leaf - 1, 0, -1):
            win[i], self.node[i] = self._play(win[2 * i], win[2 * i + 1])
        self.top = win[1] if self.leaf > 1 else 0

    def _next(self, i: int) -> None:
        """Advance run i; its new head's known prefix is with the string just put out, its predecessor."""
        j = self.at[i] + 1
        if j >= len(self.shared[i]):
            self.head[i], self.known[i] = None, -1
            return
        s, o = self.shared[i][j], self.off[i]
        tail = self.rest[i][o : o + self.width - s]
        self.head[i] = self.head[i][:s] + tail if s else tail
        self.at[i], self.off[i], self.known[i] = j, o + self.width - s, s

    def _play(self, a: int, b: int) -> tuple[int, int]:
        known = self.known
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = self.head[a][x:], self.head[b][x:]
        if p == q:
            known[b] = self.width
            return a, b
        n = self.width - ((int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_length() + 7) // 8
        if p < q:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def merge(self):
        """Run, place in the run, and prefix shared with the string before, of every string in order."""
        node, leaf, play = self.node, self.leaf, self._play
        w = self.top
        while self.head[w] is not None:
            yield w, self.at[w], self.known[w]
            self._next(w)
            i = (w + leaf) >> 1
            while i:
                w, node[i] = play(w, node[i])
                i >>= 1


def _merge(window: int, gram: int):
    reach = max(1, window - gram)

    def run(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        runs, heads, blocks = [], [], []
        often = c.repeated_windows(table["windows"])
        none = pa.nulls(often.num_rows, pa.int64())
        often = pa.table({"block": often["block"], "place": none, "high": none.cast(pa.int16()), "low": none.cast(pa.int16()), "w": often["w"], "key": often["key"]})
        for x in table["run"].drop_null():
            raw = open_.decompress(x.as_py())
            n = 8 + int.from_bytes(raw[:8], "little")
            head = pa.ipc.open_stream(raw[8:n]).read_all()
            runs.append((head["shared"].to_numpy(), raw[n:]))
            blocks.append(int(head.schema.metadata[b"block"]))
            heads.append(head.replace_schema_metadata(None))
        if not runs:
            return often
        first = np.cumsum([0, *(h.num_rows for h in heads)])
        merged = np.fromiter((v for x in LoserTree(runs, window).merge() for v in x), np.int64).reshape(-1, 3)
        del runs
        row = first[merged[:, 0]] + merged[:, 1]
        shared = merged[:, 2]
        if len(shared):
            shared[0] = 0
        every = pa.concat_tables(heads).take(pa.array(row)).combine_chunks()
        left = np.frombuffer(b"".join(every["left"].to_pylist()), np.uint8).reshape(-1, reach)
        by_left = np.argsort(left.view(f"S{reach}").ravel(), kind="stable")
        left_shared, _ = front_code(left[by_left])
        number = np.empty(len(row), np.int64)

        def key(rows, m):
            number[by_left] = np.cumsum(left_shared < m)
            return np.cumsum(shared < window - m)[rows] * np.int64(len(row) + 1) + number[rows]

        group = np.cumsum(shared < gram)
        high, low = c.extents(group, every["n"].to_numpy(), every["have_left"].to_numpy(), every["have_right"].to_numpy(), key, window - gram, window)
        hit = high >= 0
        rows = {"block": np.array(blocks, np.int32)[merged[:, 0]][hit], "place": every["place"].to_numpy()[hit], "high": high[hit], "low": low[hit]}
        return pa.concat_tables([often, pa.table(rows | {"w": pa.nulls(int(hit.sum()), pa.int64()), "key": pa.nulls(int(hit.sum()), pa.binary())})])

    return run


def _remove(window: int, gram: int):
    def run(docs: pa.Table, reach: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        if not docs.num_rows:
            return pa.table(dict(zip(names, [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())])))
        rows = c.unpack(docs)
        b = _Block(rows, window, gram)
        gone = np.zeros(len(b.bytes), bool)
        if reach.num_rows and reach["key"].null_count < reach.num_rows:
            at = np.array(c.found_windows(reach, c.gram_hashes(b.bytes, window), b.end, window, b.bytes_at), np.int64)
            gone = c.union_mask(len(b.bytes), at, at + window)
            reach = reach.filter(reach["key"].is_null())
        if reach.num_rows and len(b.pos):
            place = reach["place"].to_numpy()
            pick = np.flatnonzero(np.isin(b.gram_hash, b.gram_hash[place]))
            b.contexts(pick)
            row = np.full(int(b.context.max()) + 1, -1)
            row[b.context[np.searchsorted(pick, place)]] = np.arange(len(place))
            row = row[b.context]
            at, row = b.pos[pick[row >= 0]], row[row >= 0]
            gone |= c.union_mask(len(b.bytes), at - reach["high"].to_numpy()[row], at + window - reach["low"].to_numpy()[row])
        removed, spans, kept = [], [], []
        for a, e, text in zip(b.start, b.end, b.texts):
            mask = gone[a:e]
            k = int(mask.sum())
            removed.append(k)
            spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if k else 0)
            kept.append(b.bytes[a:e][~mask].tobytes() if k else text)
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": b.end - b.start, "n_removed": np.array(removed, np.int64), "n_spans": np.array(spans, np.int64), "kept": pa.array(kept, pa.binary())})

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, frequent: int = c.FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary) for every row of ``docs``.

    A byte goes if some ``window`` bytes of its document that cover it also start anywhere else, the same
    document included; judged on the input.  Null text is empty; texts shorter than ``window`` stay whole.
    Repeated rows are documents like others, so both lose what they share.  Null ids are kept as they are.
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    rows = c.id_text(docs, id_col, text_col)
    n_blocks = c.count_blocks(rows)
    parts = max(8, n_blocks * c.BLOCK_BYTES // MERGE_BYTES)
    packed = c.pack(rows, n_blocks)
    seen = packed.groupBy("block").applyInArrow(_grams(window, gram), "g long, block int, n int")
    again = c.repeated_grams(seen, frequent)
    runs = packed.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(_runs(window, gram, parts), "part int, run binary, windows binary")
    reach = runs.groupBy("part").applyInArrow(_merge(window, gram), "block int, place long, high short, low short, w long, key binary")
    return packed.groupBy("block").cogroup(reach.groupBy("block")).applyInArrow(_remove(window, gram), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
