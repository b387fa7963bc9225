"""BPE encoding and decoding over a table of distinct words.

1. Blocks of documents are split into the words that byte-level BPE treats on their own; a special token's
   string is a word of its own.  Each block sends its distinct words once, dealt by hash.
2. A task that receives words encodes every distinct one once and answers each block with the ids of its words,
   in the order in which they came.
3. Each block joins the ids back by the position of the words.

Words and ids travel in compressed lists, documents in compressed packs that are shuffled once.  Decoding
gathers each id's piece from the id-to-piece table, whose size is the vocabulary's.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BLOCK_BYTES = 6 << 20
_PIECE = 1 << 18
_ROWS = 256
# The endings that, after an apostrophe, are words of their own, and the Unicode white space.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, NUMBER, OTHER = range(4)


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            out[i] = LETTER if kind == "L" else NUMBER
    out[list(SPACES)] = SPACE
    return out


def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f).get("added_tokens", [])]


def word_starts(codes: np.ndarray, first: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where words begin in code points that hold segments one after the other.

    ``first`` marks the first place of each segment, ``whole`` the places of segments that are one word.  A word
    is a run of letters, of numbers or of other signs, with one space before it where there is one; an
    apostrophe with an ending that begins a word is a word; of a run of white space the last character
    stands apart if something follows.
    """
    n = len(codes)
    kind = _classes()[codes]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[first] = 9
    last = np.append(first[1:], True)
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    after[last] = 9
    space = codes == 32
    led = np.append(False, space[:-1]) & ~first  # a space stands before, and goes with what follows
    start = np.where(kind == SPACE, (before != SPACE) | ((after != SPACE) & (after != 9)), (kind != before) & ~led)
    quote = np.flatnonzero((codes == 39) & start & (after == LETTER))
    for ending in ENDINGS:
        m = len(ending)
        hit = quote[quote + m < n]
        for k, ch in enumerate(ending, 1):
            hit = hit[(codes[hit + k] == ord(ch)) & ~first[hit + k]]
        start[hit + 1] = False
        start[hit[hit + m + 1 < n] + m + 1] = True
    return first | (start & ~whole)


class _Words:
    """The words of a block: its distinct words in order of appearance, and for each piece of it the words' numbers."""

    def __init__(self, texts: list[str], special: list[str]):
        import regex

        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.numbers, self.count = [], []
        place: dict[str, int] = defaultdict(count().__next__)
        piece, size = [], 0
        for text in [*texts, None]:
            if piece and (text is None or size + len(text) > _PIECE):
                joined, a, b, n = self._split(piece, cut, special)
                words = map(joined.__getitem__, map(slice, a.tolist(), b.tolist()))
                self.numbers.append(np.fromiter(map(place.__getitem__, words), np.int32, len(a)))
                self.count += n.tolist()
                piece, size = [], 0
            if text is not None:
                piece.append(text)
                size += len(text)
        self.distinct = list(place)

    def dealt(self, parts: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words, their parts by hash, and their order by part and then alphabet, which compresses well."""
        words = pa.array(self.distinct, pa.string())
        part = np.fromiter((xxhash.xxh32_intdigest(x) % parts for x in self.distinct), np.int32, len(self.distinct))
        order = pa.compute.sort_indices(pa.table({"part": part, "word": words}), [("part", "ascending"), ("word", "ascending")])
        return words, part, order.to_numpy()

    @staticmethod
    def _split(texts: list[str], cut, special: list[str]):
        size = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(size) - size
        text = "".join(texts)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        first, whole = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        first[base[size > 0]] = True
        for s in special:
            if s in text:
                for t, o in zip(texts, base.tolist()):
                    for m in cut.finditer(t) if s in t else ():
                        first[o + m.start()] = True
                        whole[o + m.start() : o + m.end()] = True
                        if m.end() < len(t):
                            first[o + m.end()] = True
        if not len(codes):
            none = np.zeros(0, np.int64)
            return text, none, none, np.zeros(len(texts), np.int64)
        a = np.flatnonzero(word_starts(codes, first, whole))
        return text, a, np.append(a[1:], len(codes)), np.bincount(np.searchsorted(base + size, a, side="right"), minlength=len(texts))


@functools.cache
def _squeeze() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=7)


def _list_blob(values: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch({"x": values})
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return _squeeze().compress(sink.getvalue())


def _list_of(blob) -> pa.Array:
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(blob.as_py())
    return pa.ipc.open_stream(raw).read_all()["x"].combine_chunks()


def _distinct(special: list[str], parts: int):
    def run(table: pa.Table) -> pa.Table:
        w = _Words(c.unpack(table)["text"].to_pylist(), special)
        words, part, order = w.dealt(parts)
        groups = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []
        blobs = [_list_blob(words.take(pa.array(g))) for g in groups]
        return pa.table({"part": pa.array([int(part[g[0]]) for g in groups], pa.int32()), "block": pa.array([table["block"][0].as_py()] * len(groups), pa.int32()), "words": pa.array(blobs, pa.binary())})

    return run


def _encode(path: str):
    """The ids of every block's words; a word that several blocks send is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        place: dict[str, int] = {}
        flat, size, out = [], [], []
        for blob in table["words"]:
            words = _list_of(blob).to_pylist()
            fresh = [x for x in words if x not in place]
            for i in range(0, len(fresh), 4096):
                for e in tokenizer.encode_batch(fresh[i : i + 4096], add_special_tokens=False):
                    ids = e.ids
                    flat += ids
                    size.append(len(ids))
            place.update(zip(fresh, range(len(place), len(place) + len(fresh))))
            out.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
        every, n = np.array(flat, np.uint32), np.array(size, np.int64)
        every = every.astype(np.uint16) if every.max(initial=0) < 1 << 16 else every
        start = np.cumsum(n) - n
        blobs = [_list_blob(pa.ListArray.from_arrays(np.append(0, np.cumsum(n[at])).astype(np.int32), _ragged(every, start[at], n[at]))) for at in out]
        return pa.table({"block": table["block"], "part": table["part"], "ids": pa.array(blobs, pa.binary())})

    return run


def _ragged(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[start : start + n] of every pair, one after the other."""
    stop = np.cumsum(n)
    return values[np.repeat(start - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]


def _join(special: list[str], parts: int):
    def run(docs: pa.Table, encoded: pa.Table) -> pa.Table:
        rows = c.unpack(docs)
        w = _Words(rows["text"].to_pylist(), special)
        _, part, order = w.dealt(parts)
        size, flat = np.zeros(len(part), np.int64), []
        low = 0
        for i in np.argsort(encoded["part"].to_numpy(), kind="stable").tolist() if encoded.num_rows else []:
            ids = _list_of(encoded["ids"][i])
            size[order[low : low + len(ids)]] = np.diff(ids.offsets.to_numpy())
            low += len(ids)
            flat.append(ids.values.to_numpy())
        every = np.concatenate(flat) if flat else np.zeros(0, np.uint16)
        start = np.empty(len(part), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        out, stop = [], np.append(0, np.cumsum(w.count)).astype(np.int64)
        doc = 0
        for at in w.numbers:
            n = size[at]
            found = _ragged(every, start[at], n).astype("<u4")
            cut = np.append(0, np.cumsum(n))
            low = stop[doc]
            while doc < len(w.count) and stop[doc + 1] - low <= len(at):
                out.append(found[cut[stop[doc] - low] : cut[stop[doc + 1] - low]].tobytes())
                doc += 1
        return pa.table({"doc_id": rows["doc_id"], "ids": pa.array(out, pa.binary())})

    return run


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit token ids) for every row of ``docs``.

    ``tokenizer`` is the file of a byte-level BPE tokenizer, present on every machine.  Ids equal those of its
    library without added special tokens, truncation or padding; a special token's string in a text becomes
    its id.  Null text is empty and has no ids.  Repeated rows and null ids stay rows of their own.  An empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = c.id_text(docs, id_col, text_col)
    n_blocks = c.count_blocks(rows, block_bytes)
    parts = max(8, n_blocks // 4)
    special = special_tokens(tokenizer)
    packed = c.pack(rows, n_blocks)
    words = packed.groupBy("block").applyInArrow(c.lean(_distinct(special, parts)), "part int, block int, words binary")
    encoded = words.groupBy("part").applyInArrow(c.lean(_encode(tokenizer)), "block int, part int, ids binary")
    return packed.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(c.lean_pair(_join(special, parts)), "doc_id long, ids binary")


def _pieces(path: str) -> list[bytes]:
    """Bytes of each id.  Vocabularies of this kind write bytes as printable characters."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    entries = dict(model["model"]["vocab"]) | {x["content"]: x["id"] for x in model.get("added_tokens", [])}
    out = [b""] * (max(entries.values(), default=-1) + 1)
    for piece, i in entries.items():
        out[i] = bytes(byte_of[x] for x in piece) if all(x in byte_of for x in piece) else piece.encode()
    return out


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and text of ``encoded`` (columns doc_id and ids, as :func:`bpe_encode` makes); null ids give null text.

    Every task holds the id-to-piece table, which has the size of the vocabulary, and looks ids up in it.  Ids beyond
    the vocabulary have no piece and add nothing, as in the library.  Bytes that are no UTF-8 become U+FFFD.
    """

    def run(batches):
        pieces = dict(enumerate(_pieces(tokenizer)))
        piece = lambda i: pieces.get(i, b"")
        for whole in batches:
            for low in range(0, whole.num_rows, _ROWS):  # small batches keep little in memory
                batch = whole.slice(low, _ROWS)
                text = []
                for x in batch.column(1).to_pylist():
                    ids = None if x is None else np.frombuffer(x, "<u4")
                    known = x is None or not len(ids) or ids.max() < len(pieces)
                    text.append(None if x is None else b"".join(map(pieces.__getitem__ if known else piece, ids.tolist())).decode(errors="replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = bpe_decode(bpe_encode(docs, path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
