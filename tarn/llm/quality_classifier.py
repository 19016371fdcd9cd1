"""Document quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import boosting
from tarn.llm.common import id_type, one_of_each_id, small_batches, texts

#: Labelled documents the trees are fitted on at most (in expectation): a bounded sample by a hash of the id.
MAX_LABELLED = 20_000

SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
FEATURES = [
    "log_chars", "log_words", "mean_word", "log_lines", "upper", "digits", "symbols", "pipes", "exclamations",
    "full_stops", "other_punctuation", "spaces", "line_feeds", "non_ascii", "distinct_words", "distinct_pairs",
    "same_as_before", "distinct_lines", "words_per_line", "longest_word", "capital_words",
]


def statistics(text: str) -> list[float]:
    """Statistics of one whole text, in the order of ``FEATURES``; an empty text gives zeros."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, len(data))
    count = np.bincount(data, minlength=256)
    words = text.split()
    w = max(1, len(words))
    lines = [s for s in text.split("\n") if s]
    lengths = list(map(len, words))
    return [
        float(np.log1p(len(data))),
        float(np.log1p(len(words))),
        sum(lengths) / w,
        float(np.log1p(len(lines))),
        count[65:91].sum() / n,
        count[48:58].sum() / n,
        count[SYMBOLS].sum() / n,
        count[ord("|")] / n,
        count[ord("!")] / n,
        count[ord(".")] / n,
        count[[44, 58, 59, 63, 39, 34, 40, 41, 45]].sum() / n,
        count[32] / n,
        count[10] / n,
        count[128:].sum() / n,
        len(set(words)) / w,
        len(set(zip(words, words[1:], strict=False))) / w,
        sum(map(operator.eq, words, words[1:])) / w,
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(words) / max(1, len(lines)))),
        float(np.log1p(max(lengths, default=0))),
        sum(map(str.istitle, words)) / w,
    ]


def matrix(batch: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in batch], dtype=np.float64).reshape(-1, len(FEATURES))


def labelled(labels: DataFrame, label_col: str, learn: Column, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id and label (0 or 1) of a bounded sample of the ids for which ``learn`` holds.

    Null ids and labels are left out; ids labelled more than once take the majority, a tie 1.
    """
    own = labels.where(learn).select("doc_id", F.col(label_col).cast("double").alias("label")).dropna()
    own = own.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    share = min(1.0, most / max(1, own.count()))
    return own.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) < int(share * (1 << 30)))


def train(docs: DataFrame, sample: DataFrame) -> boosting.FlatTrees:
    """Fit the trees on the statistics of the labelled documents; ``sample`` is of bounded size.

    Of rows with one id, that whose text has the least hash is learnt from.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs).join(F.broadcast(sample), "doc_id").select("text", "label", "doc_id", F.xxhash64("text").alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0).to_pylist())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([lists, *batch.columns[1:]], names=["x", "label", "doc_id", "text_hash"])

    described = rows.mapInArrow(run, f"x array<double>, label int, doc_id {id_type(docs)}, text_hash long")
    found = one_of_each_id(described, "x", "label").collect()
    x = np.array([r.x for r in found], dtype=np.float64).reshape(-1, len(FEATURES))
    y = np.array([r.label for r in found], dtype=np.float64)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order in which rows arrive
    return boosting.fit(x[order], y[order])


def score(docs: DataFrame, model: boosting.FlatTrees) -> DataFrame:
    """doc_id and quality_score (0 to 1) of every row, null text as empty; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    docs = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "quality_score"])

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, quality_score double")


def keep_good(docs: DataFrame, model: boosting.FlatTrees, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns of any names unchanged, whose text (null: empty) scores at least ``threshold``.

    Repeated rows stay or go together; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(matrix(batch.column(at).to_pylist())) >= threshold))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # the function takes no names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(fold: int, parts: int) -> Column:
    """Whether the id falls into ``fold`` of ``parts`` by the CRC-32 of its text; a null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == fold, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, fold: int = 1, parts: int = 3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of held-out ids are never seen.

    Null texts count as empty; null ids are not held out; repeated rows come back as often;
    without labels every score is one half; an empty table gives no rows; other columns are
    not looked at.
    """
    model = train(docs, labelled(labels, "quality", ~held_out(fold, parts)))
    return score(docs, model).select(
        "doc_id",
        held_out(fold, parts).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )
