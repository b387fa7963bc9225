"""Encoding, decoding and chat formatting against the tokenizers library and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers
from lineaspark.llm.bpe import bpe_decode, bpe_encode
from lineaspark.llm.chat_format import CONTROLS, _read_back, _DIGESTS, escape, format_chats, unescape
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello world", "it's  we'll I'D  don't", "  lead\n\n\ttail  ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "Ünïcode ñ é 日本語 العربية 😀👍🏽", "12 345 ½ Ⅷ ٣",
    "\x85x\xa0y\u2003z\u3000 \u2028 \x1c a\x1d\u180e b\u200b", "", None, "x" * 3000, "!!!??? ...", "\x00\x01 \x7f", "e\u0301 \u00ad soft", " ", "\n", "a \n b", "_ __ a_b", "ok " * 500,
]


def test_bpe_round_trip(spark):
    rows = [(i, t, 1, "w") for i, t in enumerate(TEXTS)] + [(None, "null id", 1, "w"), (3, TEXTS[3], 1, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, word string")
    got = bpe_decode(bpe_encode(df, PATH, block_bytes=64), PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = sorted((str(i), np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes().hex()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), bytes(r.ids).hex()) for r in got) == want
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert bpe_encode(spark.createDataFrame([], df.schema), PATH).count() == 0


def test_words_split_as_the_library():
    import random
    import unicodedata

    from lineaspark.llm.bpe import _Words

    tok = Tokenizer.from_file(PATH)
    r = random.Random(1)
    # Code points that only one of the two Unicode versions knows are left out.
    marks = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(f"a{m}1{m}{m} {m} " for m in marks[i : i + 400]) for i in range(0, len(marks), 400)]
    texts += ["".join(r.choice("ab1 '  \n\t!.stremvld\u00a0") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for some in (texts, texts[::-1]):
        w = _Words(some, [])
        all_ = np.concatenate(w.numbers)
        low = 0
        for text, n in zip(some, w.count):
            want = [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]
            assert [w.distinct[k] for k in all_[low : low + n].tolist()] == want, text
            low += n


def test_escape():
    for t in ("</s>", "\\</s>", "\\\\[INST]", "<<s>", "[[/INST]]", "\\", "a\\b", "".join(CONTROLS)):
        assert unescape(escape(t)) == t
    assert unescape(escape("\\") + escape("<s>")) == "\\<s>"


def test_chat_format(spark):
    rows = [
        (1, 0, "system", "be [ROLE] kind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "fine\\</s> 日本"), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 5, "assistant", "only"), (2, 7, "assistant", "<|endoftext|>two"), (3, 0, None, "nobody"), (3, None, "tool[/ROLE]", "x"), (None, 1, "user", "u"), (2, 5, "assistant", "only"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in format_chats(df, PATH).mapInArrow(_read_back(PATH), _DIGESTS).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        frame = {"user": "[INST][/INST]", "assistant": "</s>"}
        assert g.formatted_chars == 3 + sum(len(escape(r[3] or "")) + len(frame[r[2]] if r[2] in frame else "[ROLE][/ROLE][END]" + escape(r[2] or "")) for r in turns)
    assert format_chats(df.limit(0), PATH).count() == 0
