"""Queries that apply the training-data operators to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.byte_bpe import encode_decode
from tarn.llm.common import table
from tarn.llm.language_id import identify_language
from tarn.llm.near_duplicates import fingerprint_text, near_duplicate_classes
from tarn.llm.neighbours import nearest
from tarn.llm.packing import pack
from tarn.llm.quality_classifier import classify_quality
from tarn.llm.quality_rules import judge
from tarn.llm.repeats import find_repeats
from tarn.llm.token_counts import count_tokens
from tarn.llm.token_output import crc32_of_ids, token_files
from tarn.llm.tokenizer_files import vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode_decode(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc32_of_ids(token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", fingerprint_text().alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_packing": op2_packing,
        "op3_token_counts": op3_token_counts,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_language_id": op5_language_id,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_repeats": op7_repeats,
        "op8_token_output": op8_token_output,
        "op9_nearest_neighbours": op9_nearest_neighbours,
        "op10_near_duplicates": op10_near_duplicates,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """None of these results can be written in SQL: learned models, tokenizers, hashes of bits, graph closures."""
    return {}
