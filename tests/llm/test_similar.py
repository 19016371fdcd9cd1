import re

import numpy as np
import pytest
import xxhash

from tarn.llm import golay, neighbours
from tarn.llm import queries as q
from tarn.llm.components import connected_components
from tarn.llm.near_duplicates import codeword_keys, equal_segment_keys, fingerprint_text, links, near_duplicate_classes
from tarn.llm.neighbours import nearest

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    """Index of the first member of each one's component, over all pairs."""
    fps = np.array(fps, dtype=np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_golay_covers_neighbours():
    assert len({golay.remainder(1 << b) for b in range(23)}) == 23
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 200)
    assert (golay.nearby(words, 3) >= 0).sum(axis=1).tolist() == [1] * 200
    for bit in range(23):
        own, other = golay.nearby(words, 3)[:, 0], golay.nearby(words ^ (1 << bit), 4)
        assert (other == own[:, None]).any(axis=1).all()


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 1 << 63, dtype=np.int64)
        b = a
        for bit in rng.choice(63, rng.integers(0, 5), replace=False):
            b ^= np.int64(1 << int(bit))
        one, two = np.array([a]), np.array([b])
        exact = set(equal_segment_keys(one)[1]) & set(equal_segment_keys(two)[1])
        coded = set(codeword_keys(one, 4)[1]) & set(codeword_keys(two, 3)[1])
        assert exact or coded


def test_keys_are_not_broadcast(spark):
    # A few fingerprints make a hundred times as many keys, which Spark takes for as few.
    rows = [(int(x),) for x in np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 500)]
    plan = links(spark.createDataFrame(rows, "fp long"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for p in pairs for x in p}
    for _ in range(70):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert connected_components(spark.createDataFrame([(1, 1)], "u long, v long")).collect() == []


@pytest.mark.parametrize("source", ["odd", "file", "none"])
def test_near_duplicates(spark, odd_docs, no_docs, source):
    docs = {"odd": odd_docs, "none": no_docs, "file": spark.read.parquet(f"{SF}/documents.parquet")}[source]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    if source == "file":  # a dense group: one text with single words changed
        words = (rows[0][1] + " pad" * 4).split()
        rows += [(10_000 + i, " ".join([*words[:i], f"w{i}", *words[i + 1 :]])) for i in range(0, 150)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [plain_fingerprint(t) for _, t in rows]
    label = plain_classes(fps) if rows else []
    least = {}
    for (d, _), c in zip(rows, label):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    want = sorted((str(d), f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fps, label))
    got = near_duplicate_classes(docs).select("doc_id", fingerprint_text().alias("f"), "component_id").collect()
    assert sorted((str(r.doc_id), r.f, r.component_id) for r in got) == want


def plain_nearest(rows, queries, k=5):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in queries:
        s = np.round(u @ u[ids == i][0], 12)
        s[ids == i] = -9
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[i] = [int(j) for j in ids[order]]
    return out


def test_neighbours_have_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = plain_nearest(rows, [r[0] for r in rows if r[0] % 50 == 0])
    got = {}
    for r in sorted(q.op9_nearest_neighbours(spark, "/root/testdata/sf0.1").collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    recall = np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want])
    print("recall", recall)
    assert recall >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3 + 1), float(i % 5), 1.0]) for i in range(1, 40)]
    bad = [(50, None), (51, [0.0, 0.0, 0.0]), (52, [nan, 1.0, 1.0]), (53, [inf, 1.0, 1.0]), (54, [None, 1.0, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "1 AS list", "2 AS block", "3 AS rank", "'a' AS vec")
    rows = nearest(df, df.where("vec_id IN (1, 7, 50, 51, 52, 53, 54)")).collect()
    want = plain_nearest(good, [1, 7])
    for i in (1, 7):
        assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == i] == want[i]
    assert {r.query_id for r in rows} == {1, 7}
    assert nearest(df.limit(0), df).collect() == []
    many = df.where("vec_id < 20").union(df.where("vec_id = 2")).union(df.where("vec_id = 2"))
    rows = [r.vec_id for r in nearest(many, many.where("vec_id = 1")).orderBy("rank").collect()]
    assert rows == plain_nearest(good[:19], [1])[1]
    other = df.unionByName(spark.createDataFrame([(60, [1.0, 2.0]), (61, [])], "vec_id long, embedding array<float>").selectExpr(
        "*", "1 AS list", "2 AS block", "3 AS rank", "'a' AS vec"))
    again = nearest(other, other.where("vec_id IN (1, 7, 60)")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, nearest(df, df.where("vec_id IN (1, 7)")).collect()))
    few = df.where("vec_id < 3")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest(few, few.where("vec_id = 1")).collect()] == [(1, 1, 2)]


def test_small_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(900, [1.0] * 6)] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id < 60 OR vec_id = 900")
    want = sorted(map(tuple, nearest(df, asked).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    assert sorted(map(tuple, nearest(df, asked).collect())) == want


def test_neighbours_have_recall_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 50)  # 40 lists, found by the graph; the ratios are those in use
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    own = vectors.selectExpr("vec_id", "CAST(embedding AS array<double>) AS vec")
    graph = neighbours.fit(own, len(rows))
    queries = [r for r in rows if r[0] % 50 == 0]
    read = [len(graph.lists(neighbours.unit(np.array([v], dtype=np.float64))[0], neighbours.QUERY_RATIO)) for _, v in queries]
    print("lists", len(graph.centroids), "read", np.mean(read))
    assert len(graph.centroids) > 30 and np.mean(read) < 0.95 * len(graph.centroids)
    want = plain_nearest(rows, [r[0] for r in queries])
    got = {}
    for r in nearest(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[i] & set(want[i])) / 5 for i in want])
    print("recall", recall)
    assert recall >= 0.9
