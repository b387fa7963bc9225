"""Substring dedup: remove words covered by a word window that occurs twice, located by Aho-Corasick automata.

1. *Confirm recurring passages.*  Winnowing picks phrases of ``gram`` words so that every window of
   ``window`` words holds one, at the same place in equal windows.  Phrases seen once drop out.  For the
   others each block sends the words around the phrase, equal surroundings collapsed to one entry with a
   count; entries of one phrase meet in one task, which finds the windows around the phrase that occur
   twice.  What they cover together is a passage.  For a phrase with more than ``frequent`` occurrences a block
   sends the digests of the windows around it with their counts instead, dealt by digest, so that no task
   gets all the texts around one phrase.
2. *Compile sharded automata.*  A passage goes to the blocks whose documents hold it; each block compiles
   its passages into one automaton, so no automaton grows with the corpus.
3. *Stream all documents* of the block through its automaton, which locates every occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

WINDOW, GRAM = 35, 8
PART_BYTES = 2 << 20


class _Words:
    """Texts as one buffer of `` word word `` lines, single spaces around the words, with word places.

    Splitting bytes at ASCII white space gives exactly the runs of bytes outside 0x20 and 0x09-0x0D.
    """

    def __init__(self, texts: list[bytes]):
        lines = [b" ".join(x.split()) for x in texts]
        n = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
        self.end = np.cumsum(n)
        self.start = self.end - n
        self.raw = b"\n".join([b" " + x + b" " if x else b"" for x in lines])
        self.bytes = np.frombuffer(self.raw, np.uint8)
        spaces = np.flatnonzero(self.bytes == 32)
        last = np.cumsum(n[n > 0] + 1) - 1
        self.a = np.delete(spaces, last) + 1
        self.b = np.delete(spaces, np.concatenate([[0], last[:-1] + 1]) if len(last) else last)

    def number(self) -> None:
        """Numbers of the words, equal exactly for equal words, and the words' hashes."""
        # One array of words, each with the space behind it: what lies between the words of two documents is left out.
        inside = np.ones(len(self.bytes), bool)
        inside[self.a[self.start[self.end > self.start]] - 1] = inside[self.bytes == 10] = False
        ends = np.concatenate([[0], np.cumsum(self.b - self.a + 1)]).astype(np.int64)
        every = pa.Array.from_buffers(pa.large_binary(), len(self.a), [None, pa.py_buffer(ends), pa.py_buffer(self.bytes[inside])]).dictionary_encode()
        _, at, data = every.dictionary.buffers()
        at, data = np.frombuffer(at, np.int64, len(every.dictionary) + 1).tolist() if len(every) else [0], data.to_pybytes() if data else b""
        unlike = [data[x : y - 1] for x, y in zip(at, at[1:])]
        self.word = every.indices.to_numpy().astype(np.uint32)
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, unlike), c.U, len(unlike))[self.word]

    def text(self, first: int, last: int) -> bytes:
        """The words from ``first`` up to ``last`` with a space on either side."""
        return self.raw[self.a[first] - 1 : self.b[last - 1] + 1]


class _Block(_Words):
    def __init__(self, texts: list[bytes], window: int, gram: int):
        super().__init__(texts)
        self.number()
        self.grams = grams = c.gram_hashes(self.hash, gram)
        self.pos = c.winnow(grams, self.start, self.end, gram, window)
        self.gram_hash = grams[self.pos].astype(np.int64)


def _grams(window: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        b = _Block(c.texts_of(c.unpack(table)), window, gram)
        g, n = np.unique(b.gram_hash, return_counts=True)
        return pa.table({"g": g, "block": np.full(len(g), table["block"][0].as_py(), np.int32), "n": n.astype(np.int32)})

    return run


def _contexts(window: int, gram: int, parts: int):
    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        names, blobs, windows = [], [], []
        if docs.num_rows and wanted.num_rows:
            b, block = _Block(c.texts_of(c.unpack(docs)), window, gram), docs["block"][0].as_py()
            frequent = wanted["frequent"].to_numpy(zero_copy_only=False)
            asked = wanted["g"].to_numpy()
            often = b.pos[np.isin(b.gram_hash, asked[frequent])]
            pos = b.pos[np.isin(b.gram_hash, asked[~frequent])]
            squeeze = zstandard.ZstdCompressor(level=3)
            if len(often):
                at = c.starts_around(often, b.start, b.end, gram, window)
                key, n, _ = c.counted_windows(b.word, c.gram_hashes(b.hash, window), at, window, lambda i: b.text(i, i + window))
                for part, blob in c.dealt_windows(key, n, block, parts):
                    names.append(part)
                    blobs.append(None)
                    windows.append(squeeze.compress(blob))
            doc = np.searchsorted(b.end, pos, side="right")
            left, right = np.minimum(pos - b.start[doc], window - gram), np.minimum(b.end[doc] - pos, window)
            number, first = c.name_spans(b.word, pos - left, pos + right, left)
            n = np.bincount(number, minlength=len(first))
            pos, left, right = pos[first], left[first], right[first]
            g = b.grams[pos]
            part = (g % c.U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
                text = [b.raw[x:y] for x, y in zip(b.a[pos[rows] - left[rows]], b.b[pos[rows] + right[rows] - 1])]
                sink = pa.BufferOutputStream()
                blob = pa.table({"g": g[rows].astype(np.int64), "block": np.full(len(rows), block, np.int32), "n": n[rows].astype(np.int32), "left": left[rows].astype(np.int32), "text": pa.array(text, pa.binary())})
                with pa.ipc.new_stream(sink, blob.schema) as out:
                    out.write_table(blob)
                names.append(int(part[rows[0]]))
                blobs.append(squeeze.compress(sink.getvalue()))
                windows.append(None)
        return pa.table({"part": pa.array(names, pa.int32()), "contexts": pa.array(blobs, pa.binary()), "windows": pa.array(windows, pa.binary())})

    return run


def _confirm(window: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        out = [c.repeated_windows(table["windows"])]
        runs = [pa.ipc.open_stream(open_.decompressobj().decompress(x.as_py())).read_all() for x in table["contexts"] if x.is_valid]
        if runs:
            every = pa.concat_tables(runs).combine_chunks()
            w = _Words(every["text"].to_pylist())
            w.number()
            left = every["left"].to_numpy().astype(np.int64)
            at = w.start + left
            _, group = np.unique(every["g"].to_numpy(), return_inverse=True)
            start = np.flatnonzero(c.union_mask(len(w.word) + 1, w.start, np.maximum(w.end - window + 1, w.start)))
            name = c.name_windows(w.word, window, start)
            high, low = c.extents(group, every["n"].to_numpy(), left, w.end - at, lambda rows, m: name[at[rows] - m], window - gram, window)
            hit = np.flatnonzero(high >= 0)
            text = [w.text(x, y) for x, y in zip(at[hit] - high[hit], at[hit] + window - low[hit])]
            out.append(pa.table({"block": every["block"].to_numpy()[hit], "passage": pa.array(text, pa.binary()), "w": pa.nulls(len(hit), pa.int64()), "key": pa.nulls(len(hit), pa.binary())}))
        return pa.concat_tables([x.select(["block", "passage", "w", "key"]) for x in out])

    return run


def _locate(w: _Words, passages: list[bytes]) -> np.ndarray:
    """Which words of the block lie in an occurrence of a passage.

    Passages begin and end with a space, as words do in the block, so only whole words match; a line end
    between documents keeps matches inside them.  Bytes stand for characters.
    """
    import ahocorasick

    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in set(passages):
        machine.add_word(p.decode("latin-1"))
    if not len(machine):
        return np.zeros(len(w.a), bool)
    machine.make_automaton()
    found = np.fromiter(machine.iter(w.raw.decode("latin-1")), np.dtype([("last", np.int64), ("size", np.int64)]))
    first = np.searchsorted(w.a, found["last"] - found["size"] + 2)
    return c.union_mask(len(w.a), first, np.searchsorted(w.b, found["last"], side="right"))


def _remove(window: int):
    return lambda docs, found: _without(docs, found, window)


def _without(docs: pa.Table, found: pa.Table, window: int) -> pa.Table:
    if not docs.num_rows:  # passages without their block cannot be
        raise ValueError("no documents in a block")
    rows = c.unpack(docs)
    texts = c.texts_of(rows)
    w = _Words(texts)
    passages = found["passage"].drop_null().to_pylist() if found.num_rows else []
    if found.num_rows and found["key"].null_count < found.num_rows:
        w.number()
        at = c.found_windows(found, c.gram_hashes(w.hash, window), w.end, window, lambda i: w.text(i, i + window))
        passages += [w.text(i, i + window) for i in at]
    gone = _locate(w, passages)
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.stack([w.start, w.end])], axis=0)[0]
    kept = []
    for a, e, n in zip(w.start.tolist(), w.end.tolist(), removed.tolist()):
        if n:  # every word goes or stays with the space before it
            line = w.bytes[w.a[a] - 1 : w.b[e - 1]]
            kept.append(line[np.repeat(~gone[a:e], w.b[a:e] - w.a[a:e] + 1)].tobytes()[1:])
        else:
            kept.append(w.text(a, e)[1:-1] if e > a else b"")
    out = {"doc_id": rows["doc_id"], "n_words": w.end - w.start, "n_removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())}
    return pa.table(out | ({"row": rows["row"]} if "row" in rows.column_names else {}))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, carry: list[str] | None = None, frequent: int = c.FREQUENT) -> DataFrame:
    """doc_id, n_words, n_removed and kept (remaining words joined by single spaces) for every row of ``docs``.

    Columns of ``docs`` named in ``carry`` come along in a struct, ``row``.

    A word goes if some ``window`` consecutive words of its document that hold it also start anywhere else,
    the same document included; judged on the input.  Null or blank text has no words; documents shorter
    than ``window`` stay whole.  Repeated rows are documents like others.  Null ids are kept as they are.
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    rows = c.id_text(docs, id_col, text_col, carry)
    n_blocks = c.count_blocks(rows)
    parts = max(8, n_blocks * c.BLOCK_BYTES // PART_BYTES)
    schema = T.StructType([T.StructField(k, T.LongType()) for k in ("doc_id", "n_words", "n_removed")] + [T.StructField("kept", T.StringType())])
    if carry:
        schema = schema.add(rows.schema["row"])
    packed = c.pack(rows, n_blocks)
    seen = packed.groupBy("block").applyInArrow(c.lean(_grams(window, gram)), "g long, block int, n int")
    again = c.repeated_grams(seen, frequent)
    contexts = packed.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(c.lean_pair(_contexts(window, gram, parts)), "part int, contexts binary, windows binary")
    passages = contexts.groupBy("part").applyInArrow(c.lean(_confirm(window, gram)), "block int, passage binary, w long, key binary")
    return packed.groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(c.lean_pair(_remove(window)), schema)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
