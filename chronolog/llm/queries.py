"""The queries of this package, one per operator, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolog.llm import (
    bpe, centroids, chat_format, decontamination, html_text, language_id, line_dedup, lm_score, ngram_join, pii, quality, token_counts,
    tokenizer_alignment,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(folds: int) -> Column:
    """Whether a document is kept from learning; one without an id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 2, F.lit(False))


def op1_byte_bpe(spark: SparkSession, folder: str, file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(file))
    encoded = bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identify(docs, language_id.train(docs, ~held_out(4)))
    return found.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


def op9_lm_scoring(spark: SparkSession, folder: str, file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(file))
    scored = lm_score.score(table(spark, folder, "documents"), ~held_out(7), ranks, public_tokenizers.PATTERN)
    return scored.withColumn("held_out", ~F.col("learn")).drop("learn")


def op3_token_counts(spark: SparkSession, folder: str, file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(file))
    return token_counts.count_sections(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold the template's own control strings."""
    text = r"\### Assistant: </turn> ok"
    more = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    columns = "conv_id bigint, turn bigint, role string, text string"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    template = chat_format.MarkedTurns()
    done = chat_format.format_chats(rows.unionByName(spark.createDataFrame(more, columns)), template)
    cut = lambda a, b: F.substring(F.col("formatted"), a + 1, b - a)
    read = F.transform(
        "spans",
        lambda s: F.struct(
            template.role(cut(s["start"], s["text_start"])).alias("role"),
            template.text(cut(s["text_start"], s["text_end"])).alias("text"),
            s["loss"].alias("loss"),
        ),
    )
    turns = done.select("conv_id", "formatted", read.alias("turns"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "rule")


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return done.select(
        "doc_id",
        "removed_lines",
        F.sha2(F.col("text"), 256).alias("text_sha256"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared")


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.detect(table(spark, folder, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(shown(of(*pii.KINDS)), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    a_json, b_model = Path(public_tokenizers.path(a)).read_text(encoding="utf-8"), Path(public_tokenizers.path(b)).read_bytes()
    return tokenizer_alignment.align(table(spark, folder, "documents"), a_json, b_model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op3_token_counts": op3_token_counts,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_html_extraction": op6_html_extraction,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_pii": op11_pii,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
