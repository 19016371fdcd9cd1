import hashlib

import numpy as np
import pytest

from tarn.llm import queries as q
from tarn.llm import repeats
from tarn.llm.bwt import repeated_starts
from tarn.llm.common import materialize


def removed(texts, least):
    """For each text, which bytes are in a string that starts at two places or more, by counting every window."""
    seen = {}
    for t in texts:
        for i in range(len(t) - least + 1):
            seen[t[i : i + least]] = seen.get(t[i : i + least], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        out.append(gone)
    return out


def plain(texts, least):
    """(n_bytes, n_removed, n_spans, sha) of each text."""
    out = []
    for t, gone in zip(texts, removed(texts, least), strict=True):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), len(repeats.runs(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for least in (1, 3, 6):
        for _ in range(60):
            texts = [bytes(rng.choice([97, 98], rng.integers(0, 30)).tolist()) for _ in range(rng.integers(1, 6))]
            windows = [int(rng.integers(0, max(1, len(t) - least + 2))) for t in texts]
            weights = rng.integers(1, 3, len(texts)).tolist()
            seen = {}
            for t, w, times in zip(texts, windows, weights):
                for i in range(w):
                    seen[t[i : i + least]] = seen.get(t[i : i + least], 0) + times
            want = [[seen[t[i : i + least]] > 1 for i in range(w)] for t, w in zip(texts, windows)]
            got = repeated_starts(texts, windows, weights, least)
            assert [g.tolist() for g in got] == want


def corpus():
    rng = np.random.default_rng(7)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 8))) for _ in range(n))

    shared, other = prose(200), prose(120)
    texts = [prose(100), prose(50) + shared + prose(40), shared[60:] + prose(30), prose(20) + shared[:-90], None, ""]
    texts += [other + "x" + other, "z" * 1500, "z" * 399, "z" * 400, prose(90)[:399] + "é"]
    texts += [texts[0], texts[0], texts[1][:700], prose(3) + shared[100:520] + prose(5)]
    words = prose(300).split()
    for i in range(25):  # near copies of one text
        own = list(words)
        own[int(rng.integers(0, 300))] = f"edit{i}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("batch", [2048, 2])
def test_query_equals_counting_all_windows(spark, batch, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH", batch)
    rows = [(i if i != 3 else None, t, i, "s") for i, t in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rk int, spans string").repartition(3)
    monkeypatch.setattr(q, "table", lambda s, d, n: docs)
    got = q.op7_repeats(spark, "").collect()
    want = plain([(t or "").encode() for _, t, *_ in rows], 400)
    want = sorted((str(r[0]), *w) for r, w in zip(rows, want))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("least, batch", [(256, 2048), (100, 1), (7, 1)])
def test_other_lengths_and_crowded_grams(spark, least, batch, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH", batch)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 1 << 12)
    monkeypatch.setattr(repeats, "BLOCK", 1 << 10)
    texts = corpus()
    common = texts[0][:90]  # one passage between different neighbours, again and again
    texts += [f"{i * i} before " + common + f" after {i}" * 40 for i in range(12)]
    rows = [(i if i != 3 else None, t, 7, "s") for i, t in enumerate(texts)] + [(0, texts[0], 7, "s")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, n_chars string").repartition(3)
    cut = repeats.without_repeats(docs, least)
    assert cut.schema == docs.schema
    got = sorted(((str(r.doc_id), r.text, r.n_chars) for r in cut.collect()), key=str)
    whole = [t or "" for _, t, *_ in rows]
    gone = removed([t.encode() for t in whole], least)
    want = []
    for (i, t, *_), g in zip(rows, gone, strict=True):
        kept, at = "", 0
        for c in t or "":
            size = len(c.encode())
            kept += c if not g[at : at + size].any() else ""
            at += size
        want.append((str(i), None if t is None else kept, None if t is None else str(len(kept))))
    assert got == sorted(want, key=str)


def test_groups_keep_a_shuffle_of_their_own_after_a_join_on_the_gram(spark):
    """Spark may turn a sort-merge join into a broadcast join while running and read its rows by map task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = [
        (gram, half, 1, (half, 2 * gram + half, 0, 2, (f"x{letter * 3}", f"{letter * 3}y")[half].encode()))
        for gram, letter in enumerate("abcdefghi")
        for half in range(2)
    ]
    one = "struct<rk: long, doc_id: long, at: long, windows: long, bytes: binary>"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = materialize(spark.createDataFrame(rows, f"gram long, hash long, n long, one {one}"), "counts")
        few = counts.join(repeats._shared(counts), "gram").select("one.*", "gram", "n", "many").where("NOT many")
        found = repeats._compared(few, 3)
        assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.doc_id, r.start, r.stop) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted((2 * gram + half, 1 - half, 4 - half) for gram in range(9) for half in range(2))


def test_odd_and_whole_tables(spark, odd_docs, no_docs):
    rows = repeats.find_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert repeats.find_repeats(no_docs).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cut = repeats.without_repeats(docs)
    assert cut.schema == docs.schema
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = repeats.find_repeats(docs).select("doc_id", "n_bytes", "spans", "kept").collect()
    want = dict(zip(text, plain([t.encode() for t in text.values()], 400)))
    for r in rows:
        n = sum(s.stop - s.start for s in r.spans)
        assert (r.n_bytes, n, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id]
    assert {r.doc_id for r in cut.collect()} == set(text)


def test_cut_texts_keep_their_replacement_characters(spark):
    passage = "".join(chr(0x4E00 + i) for i in range(140))  # 420 bytes
    # The characters around the passage share their outer bytes, so that the cuts go through them.
    texts = ["a\ufffdb\u4e01" + passage + "\u4f01c\ufffd", "d\u5e01" + passage + "\u4f41\ufffde", "f\ufffd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    assert got == {0: "a\ufffdbc\ufffd", 1: "d\ufffde", 2: "f\ufffd"}


def test_whole_characters():
    text = "aé日🙂\ufffdz".encode()
    for start in range(len(text) + 1):
        for stop in range(start, len(text) + 1):
            want = text[start:stop].decode("utf-8", "ignore").encode()
            assert repeats.whole_characters(text, start, stop) == want
