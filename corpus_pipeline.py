"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineaspark.llm.bpe import bpe_decode, bpe_encode
from lineaspark.llm.common import settle
from lineaspark.llm.minhash_dedup import minhash_dedup
from lineaspark.llm.mixing import mix, repeat
from lineaspark.llm.quality import THRESHOLD, fit_quality, held_out, score_quality
from lineaspark.llm.substring_dedup import substring_dedup


TOKEN_BLOCK = 3 << 20  # bytes of text whose words a task holds at once; less than alone, since here memory counts more than shuffled words


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Only rejected ids are joined.  Rows without an id are rejected by none; rows of one id share their fate, so all go if one
    of them is rejected.  Null and empty texts have a score like others.  An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    weights = fit_quality(docs, labels)
    rejected = score_quality(docs, weights).where(F.col("score") < THRESHOLD).select("doc_id")
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id.

    Rows without an id and texts without words stay.  Rows of one id count as one document: repeated rows stay together,
    and all go if one of them is a near copy of a document with a smaller id.  An empty table gives an empty one.
    """
    gone = minhash_dedup(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur twice; texts without such a passage stay as they are."""
    out = substring_dedup(docs, carry=docs.columns)
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept"))
    names = {"text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept").cast("long"))}
    return out.select(*[names.get(x, F.col(f"row.`{x}`")).alias(x) for x in docs.columns])


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null source is a source of its own, texts without words stay once, repeated rows and null ids are rows of their own.
    An empty table gives an empty one.
    """
    return repeat(docs, mix(docs))


def to_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), and the digests of the ids and of the text decoded from them.

    The ids are a table in the shared folder before they are decoded, so that no task holds the workers of both.
    Null text has no ids.  Repeated rows and null ids stay rows of their own.  An empty table gives an empty one.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe_decode(settle(bpe_encode(docs, path, block_bytes=TOKEN_BLOCK)), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-copy dedup", drop_near_copies),
    ("passage dedup", drop_passages),
    ("source mixing", mix_sources),
    ("token encoding", to_tokens),
]
#: The stages learn, search and encode; SQL cannot express them.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
