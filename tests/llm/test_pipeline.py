"""Each stage of the pipeline against a plain version of it, on what the stage before kept."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from lineaspark.llm.mixing import targets
from tokenizers import Tokenizer

from .test_dedup import brute as covered
from .test_minhash import brute as components

WORDS = "the of river stone green walks under light every morning people found old paper house by water then again".split()


def corpus():
    r = random.Random(12)
    prose = lambda n: ". ".join(" ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(9)) for _ in range(n))
    passage = prose(5)
    rows, labels = [], []
    for i in range(120):
        kind = i % 6
        if kind == 0:
            text = prose(8).upper().replace(" ", "!! ")
        elif kind == 1 and len(rows) > 6:
            text = rows[-3][1].replace("river", "brook", 1)
        elif kind == 2:
            text = prose(4) + " " + passage + " " + prose(3)
        else:
            text = prose(r.randint(2, 12))
        rows.append((i * 5, text, "en", r.choice("aab"), len(text)))
        labels.append((i * 5, int(kind != 0), 0))
    return rows + [(9001, None, None, None, None), (9002, "", "en", "c", 0), (9003, "lone words", "en", "a", 10)], labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "near-copy dedup", "passage dedup", "source mixing", "token encoding"]
    now, seen = docs, [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "token encoding":
            assert now.columns == docs.columns
        seen.append(now.collect())
    first, clean, single, cut, mixed, tokens = seen
    junk = {i for i, q, _ in labels if not q}
    kept = {r.doc_id for r in clean}
    assert kept <= {r.doc_id for r in first} and len(junk & kept) <= 2
    assert len([i for i, q, _ in labels if q and i not in kept]) <= 2
    want = components([(r.doc_id, r.text) for r in clean], 5, 80)
    assert {r.doc_id for r in single} == {i for i, (_, c) in want.items() if i == c}
    split = [(r.text or "").encode().split() for r in single]
    after = {r.doc_id: r for r in cut}
    for r, words, gone in zip(single, split, covered(split, 35)):
        text = b" ".join(w for w, g in zip(words, gone) if not g).decode() if any(gone) else r.text
        assert (after[r.doc_id].text, after[r.doc_id].source) == (text, r.source)
    assert any(any(g) for g in covered(split, 35))
    assert not {r.doc_id for r in mixed} - set(after) and max(Counter(r.doc_id for r in mixed).values()) <= 3
    size = lambda rows, s: sum(len((r.text or "").split()) for r in rows if r.source == s)
    aims = spark.createDataFrame([(s, size(cut, s)) for s in ("a", "b", "c", None)], "source string, source_size long")
    for t in targets(aims).collect():
        assert abs(size(mixed, t.source) - t.target) <= 30
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter((r.doc_id, np.array(tok.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in mixed)
    assert Counter((r.doc_id, bytes(r.ids)) for r in tokens) == ids


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, score double"


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids and texts, columns with the operators' own names, and no rows at all."""
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = " ".join(f"{w}{k}" for k in range(3) for w in WORDS)
    odd = [(None, plain, "en", None, 5, 7, 0.5), (None, None, None, "a", None, None, None), (8, plain, "en", "a", 5, 7, 0.5), (8, plain, "en", "a", 5, 7, 0.5), (9, plain + " end", "en", "b", 5, 7, 0.5), (10, None, "en", "b", 0, 7, 0.5), (10, "", "en", "b", 0, 7, 0.5)]
    frame = spark.createDataFrame(odd, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, frame.limit(0), str(tmp_path)) if name != "quality classifier" else frame.limit(0)
        assert none.count() == 0
    kept = corpus_pipeline.keep_quality(spark, docs.unionByName(frame.select(docs.columns)), str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {None, 8}
    single = corpus_pipeline.drop_near_copies(spark, frame, str(tmp_path))
    assert single.columns == frame.columns and sorted(str(r.doc_id) for r in single.collect()) == ["10", "10", "8", "8", "None", "None"]
    cut = corpus_pipeline.drop_passages(spark, frame, str(tmp_path))
    assert cut.columns == frame.columns and sorted(str(r.doc_id) for r in cut.collect()) == sorted(str(r[0]) for r in odd)
    mixed = corpus_pipeline.mix_sources(spark, frame, str(tmp_path))
    assert mixed.columns == frame.columns and sum(r.text in (None, "") for r in mixed.collect()) == 3
    tokens = corpus_pipeline.to_tokens(spark, frame, str(tmp_path)).collect()
    assert len(tokens) == len(odd) and sorted(r.n_tokens == 0 for r in tokens) == [False] * 4 + [True] * 3
