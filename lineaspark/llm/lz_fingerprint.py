"""Lempel-Ziv fingerprints: minimum-hash signatures of the phrase sets of an incremental (LZ78) parse.

A phrase is the shortest piece of the rest of a text that was no phrase before.  Texts that would help to
compress each other share phrases, so the share of equal minima of two phrase sets is a compression-like
likeness.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from .minhash_dedup import minima

SIZE = 128
BUCKET_BYTES = 8 << 20
TIE = 32  # characters of the text by which rows of one id are dealt
_PIECE = 1 << 16  # characters of short texts, or phrases of a long one, that are handled together
_draw = np.random.default_rng(7919)
_TIMES = _draw.integers(0, 1 << 32, SIZE, np.uint32) | np.uint32(1)
_PLUS = _draw.integers(0, 1 << 32, SIZE, np.uint32)


def parse(text: str, ends: list[int], tree: dict, start: int, stop: int, nodes: list[dict] | None = None) -> int:
    """Parse text[start:stop] into phrases new to ``tree``, adding their ends; returns where the unfinished one begins.

    ``tree`` has a phrase's longer phrases by their last character, each a tree in turn, so each character is looked at
    once.  ``nodes`` gets the tree that each new phrase was put into.  ``start`` is 0 or where a parse stopped.
    """
    node, put, log = tree, ends.append, ([] if nodes is None else nodes).append
    for low in range(start, stop, _PIECE):
        for j, char in enumerate(text[low : min(low + _PIECE, stop)], low + 1):
            longer = node.get(char)
            if longer is None:
                node[char] = {}
                put(j)
                log(node)
                node = tree
            else:
                node = longer
    return ends[-1] if ends else start


def _span_hashes(text: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ascending spans of ``text`` that do not overlap; a bounded number at a time."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(end), c.U)
    for low in range(0, len(end), _PIECE):
        a, b = start[low : low + _PIECE], end[low : low + _PIECE]
        out[low : low + _PIECE] = c.span_hash(codes[a[0] : b[-1]], a - a[0], b - a[0])
    return out


def _hashes(text: str, ends: list[int], rest: int) -> np.ndarray:
    """Hashes of the phrases that end at ``ends``; an unfinished one, from ``rest`` on, is equal to one of them."""
    end = np.array(ends, np.int64)
    return _span_hashes(text, np.append(0, end[:-1])[: len(end)], end)


def signature(phrases: np.ndarray) -> np.ndarray:
    return minima(phrases, _TIMES, _PLUS).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray, empty_a: bool, empty_b: bool) -> float:
    """Share of equal minima; an empty text is like empty texts only."""
    return float(empty_a and empty_b) if empty_a or empty_b else float((a == b).mean())


def likeness_of(a: Column, b: Column) -> Column:
    """:func:`likeness` of two fingerprint columns; an empty text's fingerprint has no minimum below the greatest."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4))))
    none = F.lit("ffff" * SIZE)
    return F.when((a == none) | (b == none), (a == b).cast("double")).otherwise(same / SIZE)


def lz_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (hex, 128 minima of 16 bits) for every row of ``docs``; equal texts have equal ones.

    Null text is empty; its fingerprint is all f.  Repeated rows and null ids stay rows of their own; an empty table
    gives an empty result; other columns of ``docs`` are not read.
    """

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                text, ends = x.as_py(), []
                out.append(signature(_hashes(text, ends, parse(text, ends, {}, 0, len(text)))).tobytes().hex())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return c.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


class _Probe:
    """The parses of a text and of its edited text, which share the part before the edit.

    ``buffer`` holds the text and then the edited text from the phrase on that the edit meets; the spans are in it.
    ``shared`` and ``own`` count the phrases up to there and of the whole text; the others are the edited text's.
    """

    def __init__(self, doc_id, text: str, following: str):
        n = len(text)
        cut = n - n // 3
        ends, tail, tree, nodes = [], [], {}, []
        rest = parse(text, ends, tree, 0, cut)
        self.shared = len(ends)
        parse(text, ends, tree, rest, n, nodes)
        self.own = len(ends)
        for node, end in zip(nodes, ends[self.shared :]):
            del node[text[end - 1]]
        edited = text[:cut] + following[: n // 3]
        parse(edited, tail, tree, rest, len(edited))
        self.buffer = text + edited[rest:]
        self.end = np.array([*ends, *tail], np.int64)
        self.end[self.own :] += n - rest
        self.start = np.append(0, self.end[:-1])[: len(self.end)]
        self.start[self.own : self.own + 1] = n
        self.id, self.n, self.empty, self.edited_empty = doc_id, n, not text, not edited
        self.digest = hashlib.sha256(edited.encode()).hexdigest()

    def sign(self, phrases: np.ndarray) -> None:
        a, b, d = (minima(x, _TIMES, _PLUS) for x in np.split(phrases, [self.shared, self.own]))
        self.mark, self.edited_mark = np.minimum(a, b).astype(">u2"), np.minimum(a, d).astype(">u2")

    def row(self, following: _Probe) -> tuple:
        near = likeness(self.mark, self.edited_mark, self.empty, self.edited_empty)
        ahead = likeness(self.mark, following.mark, self.empty, following.empty)
        return self.id, self.n, self.digest, self.mark.tobytes(), self.edited_mark.tobytes(), near, ahead


def _probes(pairs):
    """A signed probe for each (doc_id, text, following text); the phrases of short texts are hashed together."""
    group, size = [], 0

    def signed():
        edge = np.cumsum([0, *[len(p.buffer) for p in group]])
        start, end = (np.concatenate([x + e for x, e in zip(spans, edge)]) for spans in ([p.start for p in group], [p.end for p in group]))
        found = _span_hashes("".join(p.buffer for p in group), start, end)
        for p, phrases in zip(group, np.split(found, np.cumsum([len(p.end) for p in group])[:-1])):
            p.sign(phrases)
            p.buffer = p.start = p.end = None
            yield p

    for pair in pairs:
        group.append(_Probe(*pair))
        size += len(group[-1].buffer)
        if size >= _PIECE:
            yield from signed()
            group, size = [], 0
    if group:
        yield from signed()


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in _COLUMNS.split(", ")]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES)], names=_NAMES)


def _compare(batches):
    """Rows of one range come in order; its last row stays open, and comes out with the range's first row as an edge."""
    part = TaskContext.get().partitionId()
    head = last = None

    def out(rows: list[tuple], edges: list[tuple]):
        done = _table(rows + [(e[1], *[None] * (len(_TYPES) - 1)) for e in edges])
        more = [[None] * len(rows) + [e[k] for e in edges] for k in (0, 2, 3)]
        return pa.RecordBatch.from_arrays([*done.columns, *[pa.array(x, t) for x, t in zip(more, (pa.int32(), pa.string(), pa.string()))]], names=[*_NAMES, "part", "last", "head"])

    def pairs():
        nonlocal head, last
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                text = text.as_py()
                if last is None:
                    head = text
                else:
                    yield *last, text
                last = doc_id.as_py(), text
        if last is not None:
            yield *last, ""  # for the row before it, which asks for its fingerprint

    before, rows = None, []
    for probe in _probes(pairs()):
        if before is not None:
            rows.append(before.row(probe))
        before = probe
        if len(rows) == 1000:
            yield out(rows, [])
            rows = []
    yield out(rows, [] if last is None else [(part, *last, head)])


def _finish(batches):
    for batch in batches:
        ends = (_probes([(i, text, head), (None, head, "")]) for i, text, head in zip(*(x.to_pylist() for x in batch.columns)))
        yield _table([a.row(b) for a, b in ends])


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to the edited text and to the next text.

    The edited text has its last third (rounded down) replaced by the first characters of the next document in
    descending order of id, as many as were cut or all; the last document is followed by the first.  Equal ids
    are ordered by descending text, null ids come last.  Null text is empty; an empty table gives an empty result;
    other columns of ``docs`` are not read.  Documents are dealt by ranges of id and of the text's beginning, so one
    id or no id may have any number of rows.  The last row of a range is compared with the first of the next
    range through a table in the shared folder; only the numbers of the ranges are sorted in one task.
    """
    rows = c.id_text(docs, id_col, text_col)
    n = max(8, c.count_blocks(rows, BUCKET_BYTES))
    order = [F.col("doc_id").desc_nulls_last(), F.substring("text", 1, TIE).desc()]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(order[0], F.col("text").desc())
    found = c.settle(dealt.mapInArrow(_compare, f"{_COLUMNS}, part int, last string, head string"))
    edges = found.where("part is not null")
    parts = edges.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"))
    parts = parts.withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy())))
    heads = edges.select(F.col("part").alias("next"), "head")
    open_ = edges.select("part", "doc_id", "last").join(parts, "part").join(heads, "next").select("doc_id", "last", "head")
    every = found.where("part is null").select(*_NAMES).unionByName(open_.mapInArrow(_finish, _COLUMNS))
    return every.withColumns({x: F.lower(F.hex(x)) for x in ("fingerprint", "edited_fingerprint")})


def op10_lz_fingerprint(spark, sf_dir: str) -> DataFrame:
    return edit_probe(spark.read.parquet(f"{sf_dir}/documents.parquet"))
