"""A corpus pipeline: each stage works on all that the one before it kept.

Every stage takes the session, the documents and the folder of the tables, and gives a DataFrame that is
written as Parquet before the next stage reads it. All but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolog.llm import bpe, decontamination, line_dedup, ngram_join, quality
from chronolog.llm.queries import table
from chronolog.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned rules reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; those left without any word go.

    ``n_chars`` follows the new text.
    """
    done = line_dedup.dedup_lines(docs)
    emptied = (F.col("removed_lines") > 0) & ~F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
    kept = done.where(~F.coalesce(emptied, F.lit(False)))
    length = F.when(F.col("removed_lines") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length.cast("bigint")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id."""
    return ngram_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the hash of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256")
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines_once),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: The learned rules have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what one keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
