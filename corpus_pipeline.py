"""A training corpus from raw documents: quality rules, line dedup, near-dedup, mixing to target weights, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each one's rows to the shared folder and hands them, reread,
to the next. Every stage but the last returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, line_dedup, mixing, near_dedup, quality, sentencepiece_codec


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the repetition rule."""
    own = dict(zip(docs.columns, common.free_names(docs.select(), *(f"own_{c}" for c in docs.columns))))
    return quality.judge(docs.withColumnsRenamed(own), text=own["text"]).where("kept").select(*(F.col(own[c]).alias(c) for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes windows of three lines where they recur; a document left without a word goes, as all it held stands elsewhere. n_chars follows the text."""
    out = line_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.where((F.col("n_removed") == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup.dedup(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's rate and its draw say."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and the digests of the ids and of the decoded text."""
    return sentencepiece_codec.digests(docs).select("doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokens),
]

#: The sampled bands of near_dedup and the segmentation of sentencepiece have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
