"""Learned decision lists over document statistics, as plain Spark expressions.

The statistics, the join with labels and the verdicts are DataFrame expressions only.
Sequential covering runs on the driver over the statistics of a bounded labelled sample:
it grows conjunctions of thresholds one condition at a time, prunes each on rows kept
aside, and stops when a rule is not precise enough.  The result is an ordered list that
becomes one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import one_of_each_id

#: Labelled documents that rules are learnt from at most (in expectation): a bounded sample by a hash of the id.
MAX_LABELLED = 8_000
SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _window_hashes(words: Column, n: Column) -> Column:
    """A 64-bit hash of every window of three words, in order."""
    at = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` in the struct ``row``, and a column for each statistic; null texts are empty.

    n_words: runs of anything but ASCII white space.  word_chars: their code points.
    n_symbols: characters of #*$%&|<>.  n_dup_lines: lines with a word that equal an earlier
    line.  n_repeat_words: words in windows of three words that occur twice or more.
    n_upper, n_marks, n_digits: upper-case letters, exclamation marks, ASCII digits.
    n_distinct_words: different words.

    Repeated windows are found by sorting 64-bit hashes whose low bits are replaced by the
    window's position; where the shorter hashes collide in a document (the numbers of
    distinct values then differ) pairs of the whole hash and the position are sorted.

    The statistics come out of a generator, below which no filter on them can be pushed:
    otherwise the optimizer would copy their whole expressions into such a filter, and into
    each element of their lambdas.
    """
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    own = own.withColumn("s", F.btrim("t", F.lit(BLANKS)))
    own = own.withColumn(
        "words", F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(F.split("s", SPACES, -1))
    ).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    own = own.select("row", "t", "words", "lines", F.size("words").alias("n"))
    own = own.withColumn("h", _window_hashes(F.col("words"), F.col("n")))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.col("n").cast("long")))) - 1
    different = F.size(F.array_distinct("h"))
    own = own.withColumns({"low": low, "different": different})
    own = own.withColumn("repeats", F.col("different") < F.size("h"))
    high = F.bitwise_not(F.col("low"))
    none = F.array().cast("array<bigint>")
    packed = F.transform("h", lambda x, i: x.bitwiseAND(F.bitwise_not(F.col("low"))).bitwiseOR(i.cast("long")))
    short = F.size(F.array_distinct(F.transform("h", lambda x: x.bitwiseAND(F.bitwise_not(F.col("low"))))))
    own = own.withColumns(
        {
            "sorted": F.when(F.col("repeats"), F.sort_array(packed)).otherwise(none),
            "collided": F.when(F.col("repeats"), short < F.col("different")).otherwise(False),
            "high": high,
        }
    )
    zero = F.lit(0).cast("long")

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce(x.bitwiseXOR(y).bitwiseAND(F.col("high")) == zero, F.lit(False))

    def beside(values: str, same) -> Column:
        own_values = F.col(values)
        last = F.size(values) - 1
        return F.filter(
            values,
            lambda x, j: F.when(j > 0, same(x, F.get(own_values, j - 1))).otherwise(False)
            | F.when(j < last, same(x, F.get(own_values, j + 1))).otherwise(False),
        )

    pairs = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    own = own.withColumn("pairs", F.when(F.col("collided"), pairs))
    exact = F.transform(beside("pairs", lambda a, b: a["x"] == b["x"]), lambda p: p["i"].cast("long"))
    quick = F.transform(beside("sorted", alike), lambda x: x.bitwiseAND(F.col("low")))
    own = own.withColumn("marks", F.when(F.col("collided"), exact).otherwise(quick))
    covered = F.size(
        F.array_distinct(
            F.concat("marks", F.transform("marks", lambda x: x + 1), F.transform("marks", lambda x: x + 2))
        )
    )

    def count_of(pattern: str) -> Column:
        return (F.length("t") - F.length(F.regexp_replace("t", pattern, ""))).cast("long")

    found = F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        count_of(r"\p{Lu}+").alias("n_upper"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        count_of("[0-9]+").alias("n_digits"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    return own.select("row", F.explode(F.array(found)).alias("found")).select("row", "found.*")


def features() -> dict[str, Column]:
    """What conditions may test, from the statistics."""

    def s(name: str) -> Column:
        return F.col(name).cast("double")

    words, chars = F.greatest(s("n_words"), F.lit(1.0)), F.greatest(s("word_chars"), F.lit(1.0))
    return {
        "words": s("n_words"),
        "mean_word": s("word_chars") / words,
        "symbols": s("n_symbols") / chars,
        "upper": s("n_upper") / chars,
        "marks": s("n_marks") / chars,
        "digits": s("n_digits") / chars,
        "repeat_words": s("n_repeat_words") / words,
        "dup_lines": s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1.0)),
        "distinct_words": s("n_distinct_words") / words,
        "words_per_line": s("n_words") / F.greatest(s("n_lines"), F.lit(1.0)),
    }


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def test(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        own = features()[self.feature]
        return own > self.threshold if self.above else own <= self.threshold


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the document is rejected.  ``bad`` of the ``covered`` rows learnt from were bad."""

    conditions: tuple[Condition, ...]
    bad: int
    covered: int

    def test(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.test(x) for c in self.conditions])

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def _candidates(x: dict[str, np.ndarray], most: int = 60) -> list[Condition]:
    out = []
    for name, values in x.items():
        distinct = np.unique(values)
        if len(distinct) > most:
            distinct = np.unique(np.quantile(values, np.linspace(0, 1, most)))
        for cut in ((distinct[:-1] + distinct[1:]) / 2).tolist():
            out += [Condition(name, True, cut), Condition(name, False, cut)]
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Condition]:
    """Add the condition of the largest information gain for the bad rows until only those are covered."""
    held, conditions = np.ones(len(bad), bool), []
    options = [(c, c.test(x)) for c in _candidates(x)]
    while len(conditions) < longest:
        p0, n0 = (held & bad).sum(), (held & ~bad).sum()
        if not p0 or not n0:
            break
        before = math.log2(p0 / (p0 + n0))
        best, choice = 1e-9, None
        for c, test in options:
            p, n = (held & test & bad).sum(), (held & test & ~bad).sum()
            if p and (gain := p * (math.log2(p / (p + n)) - before)) > best:
                best, choice = gain, (c, test)
        if choice is None:
            break
        conditions.append(choice[0])
        held &= choice[1]
    return conditions


def _worth(conditions: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    held = np.logical_and.reduce([c.test(x) for c in conditions])
    p, n = (held & bad).sum(), (held & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(
    x: dict[str, np.ndarray], bad: np.ndarray, longest: int = 4, most: int = 16, precision: float = 0.95
) -> list[Rule]:
    """Sequential covering: grow on two thirds of the rows, prune on the rest, take off what is covered."""
    rules: list[Rule] = []
    aside = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < most:
        grow, prune = left & ~aside, left & aside
        conditions = _grow({k: v[grow] for k, v in x.items()}, bad[grow], longest)
        if not conditions:
            break
        own, own_bad = {k: v[prune] for k, v in x.items()}, bad[prune]
        lengths = range(1, len(conditions) + 1)
        keep = max(lengths, key=lambda m: (_worth(conditions[:m], own, own_bad), -m))
        rule = tuple(conditions[:keep])
        held = left & np.logical_and.reduce([c.test(x) for c in rule])
        p, n = int((held & bad).sum()), int(held.sum())
        if p < 3 or p < precision * n or _worth(list(rule), own, own_bad) <= 2 * precision - 1:
            break
        rules.append(Rule(rule, p, n))
        left &= ~held
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects the row (from 1), 0 if none does: one conditional expression."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), 1)
    for number, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), number)
    return out.otherwise(0)


def learn_rules(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[Rule]:
    """Rules that tell apart documents with quality label 0 among those the base rules let pass.

    Only a bounded labelled sample is read: its ids are broadcast, its statistics (ten
    numbers a document) come to the driver.  Ids labelled more than once take the majority,
    a tie 1; of rows with one id, that whose text has the least hash is learnt from; no labels
    give no rules.
    """
    own = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).dropna()
    own = own.groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("is_bad"))
    share = min(1.0, most / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(own), "doc_id")
    names = features()
    rows = statistics(rows).where(~base_failed())
    rows = rows.select("row.doc_id", "row.text_hash", "row.is_bad", *(c.alias(n) for n, c in names.items()))
    found = sorted(map(tuple, one_of_each_id(rows, "is_bad", *names).collect()))
    order = np.random.default_rng(3).permutation(len(found))
    table = np.array([found[i] for i in order], dtype=np.float64).reshape(-1, len(names) + 1)
    return learn({n: table[:, i] for i, n in enumerate(names, 1)}, table[:, 0] > 0)


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``statistics`` with the columns base_failed, rule (0: none) and kept."""
    return (
        statistics(docs, text_col)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(verdict(rules)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five base statistics, base_failed, kept and rule of every whole text.

    Null, empty and blank texts have no words and fail; repeated rows and null ids come
    back as they are; other columns are not looked at.
    """
    own = docs.select("doc_id", "text")
    done = apply_rules(own, learn_rules(own, labels))
    return done.select("row.doc_id", *BASE, "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns of any names unchanged.

    Null, empty and blank texts fail; repeated rows stay or go together; an empty table stays empty.
    """
    return apply_rules(docs, learn_rules(docs, labels)).where("kept").select("row.*")
