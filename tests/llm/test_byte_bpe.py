import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from tarn.llm.byte_bpe import BytePairVocabulary, PrefixTable, read_ranks
from tarn.llm.queries import op6_byte_bpe
from tarn.llm import queries as q

NAME = "byte_bpe_multi_50k.tiktoken"


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(NAME)), special_tokens={})


def plain_merge(ranks, data):
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        options = [(ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        best, i = min(options)
        if best == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_table_equals_plain_merging_with_appends_and_edits():
    rng = np.random.default_rng(3)
    for _ in range(60):
        ranks = {bytes((b,)): i for i, b in enumerate(b"abc")}
        sample = bytes(rng.choice(list(b"aabc"), 200).tolist())
        while len(ranks) < 25:  # as vocabularies come about: join two neighbours of an encoded text
            names = list(ranks)
            ids = plain_merge(ranks, sample)
            at = rng.integers(0, len(ids) - 1)
            ranks.setdefault(names[ids[at]] + names[ids[at + 1]], len(ranks))
        v = BytePairVocabulary(ranks)
        made = {k for k, r in ranks.items() if plain_merge(ranks, k) == [r]}
        assert made == {k for k, r in ranks.items() if v.made(r)}
        data = bytes(rng.choice(list(b"abc"), 60).tolist())
        table = PrefixTable(v, data[:20])
        table.append(data[20:])
        assert table.ids() == plain_merge(ranks, data)
        for _ in range(5):
            s, e = sorted(rng.integers(0, len(data) + 1, 2))
            new = bytes(rng.choice(list(b"abc"), int(rng.integers(0, 5))).tolist())
            data = data[:s] + new + data[e:]
            table.replace(s, e, new)
            assert table.ids() == plain_merge(ranks, data)
            assert len(table.last) == len(data)


def test_query_equals_the_library(spark, odd_docs, no_docs, monkeypatch):
    enc = library()
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        monkeypatch.setattr(q, "table", lambda s, d, n, docs=docs: docs)
        want = []
        for d in docs.collect():
            ids = enc.encode_ordinary(d.text or "")
            text = hashlib.sha256((d.text or "").encode()).hexdigest()
            want.append((str(d.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text))
        got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op6_byte_bpe(spark, sf).collect()]
        assert sorted(got) == sorted(want)
