import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import quality_rules as rules

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    at = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 400 else None
    if at is None:
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        at = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(at)


@pytest.mark.parametrize("source", ["odd", "file"])
def test_statistics(spark, odd_docs, source):
    if source == "file":
        docs = spark.read.parquet(f"{SF}/documents.parquet")
    else:
        more = [(70, "a a a a a"), (71, "a b c a b c d"), (72, "x\n\nx\n \nx\ny"), (73, "a b"), (74, "a b c")]
        docs = odd_docs.select("doc_id", "text", F.lit(1).alias("n"), F.lit("q").alias("t"), F.lit(2).alias("stats2"))
        docs = docs.union(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "1", "'q'", "2"))
    rows = rules.statistics(docs).select("row.doc_id", "row.text", *rules.BASE).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r)[2:] == plain(r.text), r.text


def test_colliding_short_hashes(spark, monkeypatch):
    """With few hash bits left, documents take the way by whole hashes."""
    monkeypatch.setattr(rules.F, "length", lambda c, real=F.length: F.lit(62) if "bin" in str(c) else real(c))
    docs = spark.createDataFrame([(1, "a b c a b c d e f g a b"), (2, "a b c d")], "doc_id long, text string")
    for r in rules.statistics(docs).select("row.text", *rules.BASE).collect():
        assert tuple(r)[1:] == plain(r.text)


def test_covering_finds_planted_rules():
    rng = np.random.default_rng(1)
    x = {"words": rng.uniform(0, 100, 3000), "symbols": rng.uniform(0, 1, 3000), "upper": rng.uniform(0, 1, 3000)}
    bad = ((x["symbols"] > 0.8) & (x["words"] > 40)) | (x["upper"] > 0.9)
    found = rules.learn(x, bad)
    rejected = np.logical_or.reduce([r.test(x) for r in found])
    assert (rejected == bad).mean() > 0.98
    assert rules.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []


def test_judge(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = rules.judge(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    judged = [(r.kept, quality[r.doc_id]) for r in rows if r.doc_id in quality and not r.base_failed]
    assert np.mean([k for k, y in judged if y == 1]) > 0.98
    assert np.mean([not k for k, y in judged if y == 0]) > 0.7
    assert len(rules.judge(odd_docs, labels.limit(0)).collect()) == odd_docs.count()
    assert rules.judge(no_docs, labels).collect() == []
    kept = rules.keep_good(docs, labels)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_several_rules_judge_texts_they_were_not_learnt_from(spark):
    rng = np.random.default_rng(5)

    def words(n):
        return ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n)]

    rows, bad = [], {}
    for i in range(600):
        own, kind = words(90), i % 3
        if kind == 1:  # numbers instead of words
            own[::3] = [str(int(rng.integers(1000, 99999))) for _ in own[::3]]
        elif kind == 2:  # signs between words
            own[::3] = [w + "#*|" for w in own[::3]]
        rows.append((i, " ".join(own)))
        bad[i] = kind > 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not bad[i])) for i in range(300)], "doc_id long, quality int")
    found = rules.learn_rules(docs, labels)
    assert len(found) >= 2
    judged = {r.doc_id: r for r in rules.apply_rules(docs, found).select("row.doc_id", "rule", "kept", "base_failed").collect()}
    unseen = [judged[i] for i in range(300, 600)]
    assert np.mean([r.kept != bad[r.doc_id] for r in unseen]) > 0.97
    assert len({r.rule for r in unseen}) >= 3  # none, and two rules at least
    stats = rules.statistics(docs).select("row.doc_id", *(c.alias(n) for n, c in rules.features().items())).toPandas()
    tests = [r.test({n: stats[n].to_numpy(float) for n in rules.features()}) for r in found]
    for at, i in enumerate(stats["doc_id"]):  # the first rule that holds is the one that is named
        first = next((n for n, t in enumerate(tests, 1) if t[at]), 0)
        assert judged[i].base_failed or judged[i].rule == first


def test_no_python_in_the_plan(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    plan = rules.judge(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
