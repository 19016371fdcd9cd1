import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import boosting, language_id, quality_classifier
from tarn.llm.common import one_of_each_id
from tarn.llm.language_id import FEATURES, ngram_counts, identify, identify_language, train
from tarn.llm.quality_classifier import classify_quality, statistics

SF = "/root/testdata/sf0.01"


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_flat_trees_learn_and_walk_like_single_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = boosting.fit(x, y, trees=40, depth=3)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.97
    for i in (0, 5, 77):
        total = model.base
        for f, t, leaf in zip(model.features, model.thresholds, model.leaves):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (x[i, f[node]] > t[node])
            total += leaf[node - len(f)]
        assert np.isclose(total, model.margins(x[i : i + 1])[0])
    assert boosting.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]
    assert len(statistics("")) == len(statistics("A b!\nA b!"))


def test_a_stump_takes_the_best_of_all_splits():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = (x[:, 1] + rng.normal(size=120) > 0.2).astype(float)
    model = boosting.fit(x, y, trees=1, depth=1, bins=1000)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    g, h = prior - y, np.full(len(y), prior * (1 - prior))

    def worth(here):
        return g[here].sum() ** 2 / (h[here].sum() + 1)

    best = max(
        (worth(x[:, f] <= t) + worth(x[:, f] > t), f, t)
        for f in range(3)
        for v in [np.unique(x[:, f])]
        for t in (v[:-1] + v[1:]) / 2
        if min(h[x[:, f] <= t].sum(), h[x[:, f] > t].sum()) >= 2
    )
    f, t = model.features[0, 0], model.thresholds[0, 0]
    assert np.isclose(worth(x[:, f] <= t) + worth(x[:, f] > t), best[0])
    for side, leaf in ((x[:, f] <= t, model.leaves[0, 0]), (x[:, f] > t, model.leaves[0, 1])):
        assert np.isclose(leaf, -0.15 * g[side].sum() / (h[side].sum() + 1))


def test_follow_the_leader_equals_single_steps():
    rng = np.random.default_rng(9)
    rows = [(np.sort(rng.choice(30, 5, replace=False)), rng.random(5)) for _ in range(40)]
    labels = rng.integers(0, 3, 40)
    got = language_id.follow_the_leader(rows, labels, 3, epochs=2)
    z, n = {}, {}

    def weight(key):
        a, b = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(a) <= 0.02 else -(a - math.copysign(0.02, a)) / ((1 + math.sqrt(b)) / 0.5 + 0.02)

    order = np.random.default_rng(11)
    for _ in range(2):
        for i in order.permutation(40):
            at, value = rows[i]
            w = {(f, c): weight((f, c)) for f in at for c in range(3)}
            e = [math.exp(sum(v * w[f, c] for f, v in zip(at, value))) for c in range(3)]
            for f, v in zip(at, value):
                for c in range(3):
                    step = v * (e[c] / sum(e) - (c == labels[i]))
                    b = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + step - (math.sqrt(b + step * step) - math.sqrt(b)) / 0.5 * w[f, c]
                    n[f, c] = b + step * step
    for f in range(30):
        assert np.allclose(got[f], [weight((f, c)) for c in range(3)])
    assert not got[30:].any()


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = "Ünï cödé 🙂 " * 40
    want = ngram_counts(text)
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert (ngram_counts(text) == want).all()


def test_quality(spark, odd_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = classify_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    hits = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(hits) > 0.95
    rows = classify_quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    rows = classify_quality(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in rows} == {0.5}


def test_ngram_counts():
    text = "Añb añB🙂"
    assert ngram_counts(text).sum() == 8 + 7 + 6
    assert ngram_counts("").sum() == 0 and len(ngram_counts("x")) == FEATURES
    assert (ngram_counts("ABC") == ngram_counts("abc")).all()


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = identify_language(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.97
    rows = identify_language(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 2, 3))
    assert identify_language(no_docs).collect() == []
    signs = spark.createDataFrame([(1, "²½Ⅳ 12"), (2, "²½Ⅳ é")], "doc_id long, text string")
    model = train(docs)
    assert [r.lang_pred == "und" for r in identify(signs, model).orderBy("doc_id").collect()] == [True, False]


def test_repeated_rows_do_not_grow_the_samples(spark, monkeypatch):
    rows = [(1, "der Hund und die Katze", "de", 1)] * 3000 + [(2, "the dog and the cat", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int")
    got = identify_language(docs).collect()
    assert len(got) == 3001 and {r.lang_pred for r in got} <= {"de", "en"}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    joined = docs.join(labels, "doc_id").withColumn("text_hash", F.xxhash64("text"))
    assert sorted(r.quality for r in one_of_each_id(joined, "quality").collect()) == [0, 1]
    assert classify_quality(docs, labels).count() == 3001
    kept = quality_classifier.keep_good(docs, quality_classifier.train(docs, labels.selectExpr("doc_id", "quality AS label")))
    assert kept.schema == docs.schema
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        train(docs)
