"""The corpus pipeline: six stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import decontamination, line_dedup, near_copies, rule_ensemble, sentencepiece_codec, simhash_dedup
from causeway.llm._common import Tables, scratch
from causeway.llm.queries import piece_model


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return rule_ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut, n_chars follows; documents of which nothing is left go."""
    out = line_dedup.keep_first_runs(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near SimHash fingerprints: that with the smallest doc_id."""
    return simhash_dedup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; before near copies are looked for, so that none of these stands for clean ones."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of what fingerprints leave, one document of each group of near copies by whole sets of shingles: that with the smallest doc_id."""
    return near_copies.keep_one(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the byte ends of their spans."""
    return sentencepiece_codec.encode(docs, piece_model()).select("doc_id", "ids", "ends")


STAGES = [
    ("quality_classifier", good),
    ("line_dedup", fresh_lines),
    ("simhash_dedup", apart),
    ("decontamination", clean),
    ("near_copies", distinct),
    ("sentencepiece", encoded),
]

#: Not expressible in SQL: fitted rules, suffix intervals, hashed walks and piece merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark, "pipeline")
    before = None
    for _, stage in STAGES:
        with scratch():
            docs = tables.put(stage(spark, docs, sf_dir))
        if before is not None:
            tables.drop(before)
        before = docs
    return docs
