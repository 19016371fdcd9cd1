"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into a fixed number of features.  Document
frequencies are counted over all learnable documents; the weights are trained on a bounded
sample by the follow-the-regularised-leader rule with an L1 and an L2 penalty, and a
temperature fitted on rows that were not trained on makes the probabilities honest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import id_type, small_batches, texts

FEATURES = 1 << 14
SHIFT = np.uint32(32 - 14)
#: One odd multiplier for each n-gram length and place: what the hash multiplies by.
FACTORS = [np.array([2654435761 + 2 * (8 * n + i) * 40503 for i in range(n)], dtype=np.uint32) for n in (1, 2, 3)]
#: Characters handled at once, so that a very long text takes bounded memory.
BLOCK = 1 << 20
#: The fit sees about this many documents in all, at least LEAST of each language, by a hash of the id.
MAX_SAMPLE, LEAST = 4_000, 30
#: Languages that can be told apart at most: the weights of more would not fit into a worker.
MAX_LANGUAGES = 512
UNKNOWN = "und"


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = np.zeros(FEATURES, dtype=np.int64)
    for start in range(0, len(codes), BLOCK):
        for factors in FACTORS:
            n = len(factors)
            own = codes[start : start + BLOCK + n - 1]
            m = len(own) - n + 1
            if m < 1:
                continue
            mixed = own[:m] * factors[0]
            for i in range(1, n):
                mixed += own[i : i + m] * factors[i]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(2246822519)
            total += np.bincount(mixed >> SHIFT, minlength=FEATURES)
    return total


def has_letter(text: str) -> bool:
    """Whether any character is of one of Unicode's letter categories."""
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and values: logarithmic counts times inverse document frequency, of length 1."""
        at = counts.nonzero()[0]
        value = np.log1p(counts[at]) * self.idf[at]
        norm = np.sqrt((value**2).sum())
        return np.append(at, FEATURES), np.append(value / (norm or 1), 1.0)

    def logits(self, text: str) -> np.ndarray:
        at, value = self.vector(ngram_counts(text))
        return value @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: int,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
) -> np.ndarray:
    """Weights (features + 1 for the bias, classes) by per-coordinate FTRL-proximal steps."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            za, na = z[at], n[at]
            w = weights(za, na)
            p = softmax(value @ w)
            p[labels[i]] -= 1
            g = value[:, None] * p
            more = na + g * g
            z[at] = za + g - (np.sqrt(more) - np.sqrt(na)) / alpha * w
            n[at] = more
    return weights(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(u: float) -> float:
        p = softmax(logits / np.exp(u))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, golden = -5.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each feature occurs, and the number of texts.

    Tasks send one row for each feature they met; at most ``FEATURES`` + 1 rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += ngram_counts(text) > 0
                rows += 1
        at = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, FEATURES)), pa.array(np.append(total[at], rows))], names=["feature", "n"]
        )

    found = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(FEATURES + 1, dtype=np.int64)
    for r in found.collect():
        out[r.feature] = r.n
    return out[:FEATURES], int(out[FEATURES])


def train(docs: DataFrame) -> LanguageModel:
    """Fit on ``docs`` (text, lang, id): rows with null text or lang are left out.

    The sample is bounded: about MAX_SAMPLE / languages documents of each language, LEAST at
    least; repeated rows count once.  Every fifth of it, in the order of label and features,
    serves for the temperature only.  More than MAX_LANGUAGES languages are an error.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang").dropna(subset=["text", "lang"])
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different values in lang")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0)), 1.0)
    frequency, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + frequency)) + 0.05
    most = max(LEAST, MAX_SAMPLE // len(languages))
    sides = docs.sparkSession.createDataFrame(
        [(x, i, int(min(1.0, most / sizes[x]) * (1 << 30))) for i, x in enumerate(languages)],
        "lang string, label int, below long",
    )
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30))
    sample = docs.join(F.broadcast(sides), "lang").where(draw < F.col("below"))
    sample = sample.select("doc_id", "text", "label").distinct().select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = [], []
            for text in batch.column(0).to_pylist():
                found = ngram_counts(text)
                own = found.nonzero()[0]
                at.append(own.astype("<u2").tobytes())
                counts.append(found[own].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(at, pa.binary()), pa.array(counts, pa.binary())],
                names=["label", "features", "counts"],
            )

    found = sorted(map(tuple, sample.mapInArrow(run, "label int, features binary, counts binary").collect()))
    model = LanguageModel(languages, idf, np.zeros((FEATURES + 1, len(languages))), 1.0)
    rows, labels = [], np.array([r[0] for r in found], dtype=np.int64)
    for _, at, counts in found:
        whole = np.zeros(FEATURES)
        whole[np.frombuffer(at, "<u2")] = np.frombuffer(counts, "<f4")
        rows.append(model.vector(whole))
    aside = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    model.weights = follow_the_leader([r for r, a in zip(rows, aside) if not a], labels[~aside], len(languages))
    logits = np.array([v @ model.weights[at] for (at, v), a in zip(rows, aside) if a]).reshape(-1, len(languages))
    model.temperature = fit_temperature(logits, labels[aside])
    model.weights = model.weights.astype(np.float32)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every whole text.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if the
    model learnt no language.
    """
    small_batches(docs.sparkSession)
    docs = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, lang_pred string, score double")


def held_out(fold: int, parts: int) -> Column:
    """Whether the id falls into ``fold`` of ``parts`` by the CRC-32 of its text; a null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == fold, F.lit(False))


def identify_language(docs: DataFrame, fold: int = 0, parts: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; texts and languages of held-out ids are never learnt from.

    Null texts and texts without a letter are ``und`` with score 0; null ids are not held out;
    repeated rows come back as often; equal scores go to the language first in order; an
    empty table gives no rows; other columns are not looked at.
    """
    model = train(docs.where(~held_out(fold, parts)))
    return identify(docs, model).select("doc_id", held_out(fold, parts).alias("held_out"), "lang_pred", "score")
