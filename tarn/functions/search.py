"""Full-text search: postings and BM25 scores as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The usual constants of the score.
K, B = 1.2, 0.75


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document and term: id, term, tf and the document's length."""
    words = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("words"))
    words = words.select("id", F.size("words").alias("length"), F.explode("words").alias("term"))
    return words.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def match_bm25(
    docs: DataFrame, query: str, id_col: str, text_col: str, k: float = K, b: float = B, conjunctive: bool = False
) -> DataFrame:
    """(id, score) of the documents that hold a term of ``query``, or all of them if ``conjunctive``.

    One scan counts documents, words and the documents of each term, in a row that is then
    broadcast; a second scan scores each document on its own, so that no words are shuffled.
    """
    import re

    terms = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    own = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("words"))
    own = own.select("id", F.size("words").alias("length"), F.filter("words", lambda w: w.isin(terms)).alias("hits"))
    holds = [F.count_if(F.array_contains("hits", t)).alias(f"df{i}") for i, t in enumerate(terms)]
    whole = own.agg(F.count_if(F.col("length") >= 0).alias("docs"), F.avg(F.when(F.col("length") >= 0, F.col("length"))).alias("mean"), *holds)
    both = own.where(F.size("hits") > 0).crossJoin(F.broadcast(whole))
    score, met = F.lit(0.0), F.lit(True)
    for i, t in enumerate(terms):
        tf = F.size("hits") - F.size(F.array_remove("hits", t))
        df = F.col(f"df{i}")
        idf = F.ln((F.col("docs") - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * (k + 1) / (tf + k * (1 - b + b * F.col("length") / F.col("mean")))
        met = met & (tf > 0)
    return (both.where(met) if conjunctive else both).select("id", score.alias("score"))
