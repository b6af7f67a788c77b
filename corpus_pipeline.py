"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, and tokenisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontamination, ngram_join, quality_rules, substring_dedup
from textloom.llm._stage import ship, small_side, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail the base rules and go; a null doc_id has no label but is judged like any other; each of several equal rows is
    judged; an empty table stays empty; other columns, whatever their names, come back as they are.
    """
    ship(spark)
    return quality_rules.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """_row, a number of each row, and doc, all its columns; written, so that the numbers stay."""
    return staged(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*_own(docs)).alias("doc")), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, the first of these on ties.

    Rows are compared as such, so different texts under one doc_id all count, and of equal rows one stays. Rows without doc_id, and those
    without words, link with nothing and stay; an empty table stays empty; other columns, whatever their names, come back as they are.
    """
    ship(spark)
    keyed = _keyed(docs, "rows")
    rows = keyed.where("doc.doc_id is not null").select(F.col("_row").alias("doc_id"), F.col("doc.text").alias("text"), F.col("doc.doc_id").alias("_id"))
    found = ngram_join.near_duplicates(rows, ("_id",))
    first = found.groupBy("component_id").agg(F.min(F.struct("_id", "doc_id")).alias("first")).select(F.col("first.doc_id").alias("_row"))
    kept = keyed.where("doc.doc_id is not null").join(first, "_row", "left_semi").unionByName(keyed.where("doc.doc_id is null"))
    return kept.select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand earlier in the corpus; a document that loses all its words goes.

    n_chars, where there is such a column, follows the text. Rows without doc_id and null or short texts come back whole; equal rows are one
    document and each stays; an empty table stays empty; other columns, whatever their names, come back as they are.
    """
    ship(spark)
    done = substring_dedup.dedup(docs.select("doc_id", "text", F.struct(*_own(docs)).alias("doc")), columns=("doc",))
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("doc.text")), "n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return done.where(~cut | (F.col("n_removed") < F.col("n_words"))).select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Each row is judged by its own text, whatever its doc_id; null and empty texts hold no item and stay; equal rows fare alike; an empty table
    stays empty, and an empty benchmark finds nothing; other columns, whatever their names, come back as they are.
    """
    ship(spark)
    keyed = _keyed(docs, "rows")
    leaks = decontamination.leaks(keyed.select(F.col("_row").alias("doc_id"), F.col("doc.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaking = staged(leaks.select(F.col("doc_id").alias("_row")).distinct(), "leaking")
    return keyed.join(small_side(leaking), "_row", "left_anti").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and of the decoded text.

    Every row gives one row; null text has no tokens; an empty table stays empty; the other columns follow, as own_<name> where a name is taken.
    """
    ship(spark)
    return bpe.encode_decode(docs, bpe.vocabulary_path(), with_ids=True, columns=tuple(c for c in docs.columns if c not in ("doc_id", "text")))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("bpe_codec", tokens),
]

#: Exact grouping by similarity and merges by rank are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
