"""A corpus pipeline of five stages; each works on all that the one before it kept.

quality classifier -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> byte-level BPE

Null and empty texts, null ids, repeated rows and empty tables pass as each stage's operator states; further columns,
whatever their names, are carried along, but that the last stage's ids, n_tokens and decoded_sha256 take the place of
columns of these names, and of text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langlens.llm import bpe, decontaminate, jaccard, linededup, quality
from langlens.llm.common import written

#: The classifier and the component search are no SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.filter_quality(docs, quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go, and documents that consisted of them alone."""
    return linededup.rewrite(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the smallest id; equal rows count as copies."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more benchmark items go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but text, with ids, n_tokens and the SHA-256 of the decoded text."""
    import public_tokenizers

    names = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "decoded_sha256")]
    out = bpe.assembled(docs, names, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)
    return out.select(*names, "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", filter_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i + 1}")
    return docs
