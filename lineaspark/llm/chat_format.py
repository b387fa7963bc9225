"""Chat formatting by token-level assembly.

Each text is encoded by itself, so nothing in it can become a control token.  Reserved ids above the
vocabulary mark turns: a user's text stands between ``[INST]`` and ``[/INST]``, an assistant's ends with
``</s>``, any other role is written between ``[ROLE]`` and ``[/ROLE]`` before a text that ends with ``[END]``.  A
conversation begins with ``<s>``.  In texts, a backslash goes before every control string and every backslash,
which makes the written-out form unambiguous and reversible.  The loss mask is the running sum of +1 where an
assistant's text begins and -1 where it ends.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings; their ids follow the vocabulary in this order.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[END]")
BEGIN, STOP, ASK, ASKED, ROLE, ROLED, END = range(len(CONTROLS))
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(" + _CONTROL.pattern + ")")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _format(path: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # strings of the vocabulary's own special tokens are ordinary text
        tokenizer.no_truncation()
        tokenizer.no_padding()
        base = tokenizer.get_vocab_size(with_added_tokens=True)
        mark = lambda k: np.array([base + k], "<u4")
        last, number, started = None, 0, False
        for batch in batches:
            rows = list(zip(*(x.to_pylist() for x in batch.columns)))
            flat = [escape(s) for _, role, text in rows for s in (role, text)]
            ids = iter([np.array(e.ids, "<u4") for e in tokenizer.encode_batch(flat, add_special_tokens=False)])
            out = []
            for conv, role, _ in rows:
                role_ids, text_ids = next(ids), next(ids)
                first = not started or conv != last
                number, last, started = 0 if first else number + 1, conv, True
                if role == "user":
                    parts, spot = [mark(ASK), text_ids, mark(ASKED)], 1
                elif role == "assistant":
                    parts, spot = [text_ids, mark(STOP)], 0
                else:
                    parts, spot = [mark(ROLE), role_ids, mark(ROLED), text_ids, mark(END)], 3
                if first:
                    parts, spot = [mark(BEGIN), *parts], spot + 1
                turn = np.concatenate(parts)
                step = np.zeros(len(turn) + 1, np.int8)
                at = sum(map(len, parts[:spot]))
                step[at] += role == "assistant"
                step[at + len(text_ids)] -= role == "assistant"
                out.append((conv, number, turn.tobytes(), np.cumsum(step[:-1]).astype(np.uint8).tobytes()))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["conv_id", "seq", "ids", "mask"])

    return run


def format_chats(conversations: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, seq (0, 1, ... in each conversation), ids (little-endian 32-bit) and mask (a byte for each id) of every turn.

    The turns of a conversation, joined in order of seq, are its formatted form; they stay rows, so that no
    conversation has to fit into memory.  Turns go by ``turn``, nulls first, ties by role and text.  Null text
    and null role are empty; a null conversation is one like others.  Rows of a conversation stay together and in
    order in their partition.  An empty table gives an empty result; other columns are not read.
    """
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format(tokenizer), "conv_id long, seq long, ids binary, mask binary")


class _Reader:
    """Texts of token ids; the written-out form of control ids."""

    def __init__(self, path: str):
        from .bpe import _pieces

        self.piece = _pieces(path)
        self.base = len(self.piece)

    def text(self, ids: np.ndarray) -> str:
        return unescape(b"".join(self.piece[i] for i in ids.tolist()).decode(errors="replace"))

    def written(self, ids: np.ndarray) -> str:
        return b"".join(self.piece[i] if i < self.base else CONTROLS[i - self.base].encode() for i in ids.tolist()).decode(errors="replace")

    def turn(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        ids = ids[int(ids[0] == self.base + BEGIN) :]
        if ids[0] == self.base + ASK:
            return "user", self.text(ids[1:-1])
        if ids[0] == self.base + ROLE:
            cut = int(np.flatnonzero(ids == self.base + ROLED)[0])
            return self.text(ids[1:cut]), self.text(ids[cut + 1 : -1])
        return "assistant", self.text(ids[:-1])


def _read_back(path: str):
    """Digests of each conversation, from the formatted rows in order; only one turn is held at a time."""

    def run(batches):
        reader = _Reader(path)
        now, started = None, False

        def close(out):
            out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            out = []
            for conv, raw, mask in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if not started or conv != now[0]:
                    if started:
                        close(out)
                    now, started = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                ids = np.frombuffer(raw, "<u4")
                role, text = reader.turn(ids)
                learned = reader.text(ids[np.frombuffer(mask, np.uint8) == 1])
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(learned)
                now[4].update(learned.encode())
                now[5] += len(reader.written(ids))
            yield _digests(out)
        if started:
            out = []
            close(out)
            yield _digests(out)

    return run


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=[x.split()[0] for x in _DIGESTS.split(", ")])


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return format_chats(talks.unionByName(more), path).mapInArrow(_read_back(path), _DIGESTS)
