"""The corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. Every stage
works on all rows that the one before it kept, whole texts included, and takes an empty table. Columns beside doc_id, text,
source and n_chars pass through as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, mixing, neardup, quality, secret_scan
from citeloom.llm._common import fold, materialize, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.3 or more); it learns from the labels outside the held-out fold.

    Null and empty texts are scored by the model's bias; repeated rows get equal scores and stay or go together. Without
    labels every score is 0.5 and all rows stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    good = quality.score_quality(rows, model, keep=["row"]).where("predicted = 1")
    return good.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, on shingles of five words at similarity 0.8: that of the smallest id.

    Null and empty texts are no duplicates of each other and stay, as do rows with a null id; of repeated rows one stays.
    """
    return neardup.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, plain or wrapped; n_chars follows the text.

    Null and empty texts stay as they are; repeated rows are masked alike. Where n_chars is missing or null it stays so.
    """
    old = neardup.free_name(docs.columns, "old_length")
    out = secret_scan.redact(docs.withColumn(old, F.length("text")))
    if "n_chars" in docs.columns:
        n = F.col("n_chars")
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), n).otherwise((n + F.length("text") - F.col(f"`{old}`")).cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Null and empty texts have no words and are taken 0 times; a null source is a source of its own; repeated rows are drawn
    each on its own.
    """
    return mixing.mix_rows(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and the hashes of the ids and of the decoded text, a row for each row.

    Null and empty texts have no tokens and the hashes of the empty string. Workers come here from four other stages, so
    they remember fewer pieces than the operator would.
    """
    ids = bpe.encode_with_digests(docs.select("doc_id", "lang", "source", "text"), remembered=40_000)
    return ids.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: SQL can't express the classifier, the sketches, the decoding worklist, cube sampling or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
