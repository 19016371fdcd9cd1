import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from tarn.llm import common, similar_texts  # noqa: E402

SF = "/root/testdata/sf0.01"


def plain_kept(rows):
    """str of the ids that stay: the least of each component of texts with a Jaccard of 0.8, over all pairs."""
    sets = []
    for _, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s or [None]:
            by_shingle.setdefault(x, []).append(i)
    shared = {}
    for own in by_shingle.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                shared[j, i] = shared.get((j, i), 0) + 1
    for (j, i), n in shared.items():
        if not sets[i] or 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        own = (d is None, d)
        least[find(i)] = min(own, least.get(find(i), (True, None)), key=lambda r: (r[0], r[1] or 0))
    return sorted(str(d) for _, d in least.values())


@pytest.mark.parametrize("common", [8, 1])
def test_edited_copies(spark, odd_docs, common, monkeypatch):
    monkeypatch.setattr(similar_texts, "COMMON", common)
    monkeypatch.setattr(similar_texts, "SAMPLE", 16 if common > 1 else 2)
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for base in range(25):  # copies with more and more words changed, on both sides of 0.8
        words = [f"w{x}" for x in rng.integers(0, 9999, int(rng.integers(20, 300)))]
        for k in range(8):
            own = list(words)
            for i in rng.integers(0, len(words), k * len(words) // 100 + k // 3):
                own[int(i)] = f"e{rng.integers(0, 9999)}"
            rows.append((100 + 10 * base + k, " ".join(own)))
        rows.append((109 + 10 * base, " ".join(words[:60]) + " " + passage))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = similar_texts.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == plain_kept(rows)
    assert similar_texts.keep_one(docs.limit(0)).collect() == []


def test_stage_keeps_one_of_each_component(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = sorted(str(r.doc_id) for r in stage(spark, docs, SF).collect())
    assert got == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_sketches_never_overstate_a_difference():
    rng = np.random.default_rng(5)
    for size in (0, 1, 900, 1100, 5000):
        own = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        other = np.unique(np.append(own[size // 8 :], rng.integers(0, 1 << 63, size // 20, dtype=np.uint64)))
        assert similar_texts.differing(similar_texts.sketch(own), similar_texts.sketch(other)) <= len(np.setxor1d(own, other))
    far = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert 9 * similar_texts.differing(similar_texts.sketch(own), similar_texts.sketch(far)) > len(own) + len(far)


def test_fingerprints_link_sets(spark, monkeypatch):
    # The stage tries the pairs of operator 10's links: they connect what all pairs within four bits connect.
    rng = np.random.default_rng(6)
    fps = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    fps += [f ^ (1 << int(b)) ^ (1 << int(c)) for f in fps[:30] for b, c in rng.integers(0, 60, (4, 2))] + fps[:10]
    seen = []
    pairs = similar_texts.fingerprint_pairs
    found = pairs(spark.createDataFrame(list(enumerate(fps)), "set long, fp long")).collect()
    bits = np.bitwise_count(np.array(fps)[:, None].view(np.uint64) ^ np.array(fps)[None, :].view(np.uint64))

    def classes(linked):
        label = list(range(len(fps)))
        for a, b in linked:
            label = [label[b] if x == label[a] else x for x in label]
        return [label.index(x) for x in label]

    assert classes([(r.u, r.v) for r in found]) == classes(np.argwhere(bits <= 4).tolist())
    monkeypatch.setattr(similar_texts, "fingerprint_pairs", lambda known: seen.append(pairs(known)) or seen[-1])
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["e"])), (3, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar_texts.keep_one(docs).collect()) == [1, 3]
    assert seen[0].count() == 1


def test_rows_are_shuffled_once_and_nothing_else_stays(spark, odd_docs):
    before = len(common.MADE)
    kept = similar_texts.keep_one(odd_docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if "Exchange" in line]) == 2  # rows, and the ids that stay
    assert [m.rsplit("/", 1)[-1].rsplit("-", 1)[0] for m in common.MADE[before:]] == ["first-rows"]
    base = odd_docs.select(F.struct("doc_id", "length").alias("row"), F.col("length").alias("rest"), "doc_id")
    first = spark.createDataFrame([(7, None), (7, 1), (7, 99)], "rk long, id long")  # a hash that ids share
    got = similar_texts._rows_of(base.withColumn("rk", F.lit(7).cast("long")), first).collect()
    assert sorted((str(r.doc_id), tuple(r.row)) for r in got) == [("1", (1, 0)), ("None", (None, 5))]
