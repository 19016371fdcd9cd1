"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept, as written to Parquet and read back.  All
but the last return the columns of ``documents``.  No stage is expressible in SQL (learned
rules and trees, components of similar texts, byte-level matches, tokenizers), so ORACLE_SQL is
None; the tests hold the near-duplicate and the repeat stage against brute force, packing
against the tokenizer's ids, and the two learned stages against labels.

In all stages null ids stay apart from others and come back as they are, rows may repeat (of
equal id and text one leaves the near-duplicate stage), other columns may have any names, and
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import packing, quality_classifier, quality_rules, repeats, similar_texts
from tarn.llm.common import MADE, drop_made, materialize, table
from tarn.llm.tokenizer_files import vocabulary

#: Bytes of a passage of 50 short words with the blanks between them.
PASSAGE = 256


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list; null, empty and blank texts fail."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees, fitted on a bounded labelled sample, score at least one half (all, without labels)."""
    sample = quality_classifier.labelled(table(spark, sf_dir, "labels"), "quality", F.lit(True))
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, sample))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each component of texts whose 5-word shingles are similar by 0.8 or more.

    Pairs come from operator 10's fingerprints and Golay keys, and those it cannot find from
    prefixes of the shingle sets; all are verified.  Texts without words are similar to each other.
    """
    return similar_texts.keep_one(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages of about 50 words that occur more than once; null texts stay null."""
    return repeats.without_repeats(docs, PASSAGE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a training sequence; a null or empty text is its end id alone."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``.

    What a stage leaves in the shared folder is deleted once the next one's input is written.
    """
    docs, before = table(spark, sf_dir, "documents"), len(MADE)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_made(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
