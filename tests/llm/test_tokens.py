import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tarn.llm.packing import first_fit_decreasing, pack
from tarn.llm.token_counts import UnigramCounter, count_tokens, counter_for
from tarn.llm.token_output import crc32_of_ids, read_token_ids, token_files, write_token_ids
from tarn.llm.tokenizer_files import id_bytes, vocabulary

DOCS = "/root/testdata/sf0.001/documents.parquet"


def ids_of(name, text):
    t = Tokenizer.from_file(vocabulary(name))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def naive_first_fit(sizes, capacity):
    left, out = [], []
    for s in sizes:
        at = next((i for i, c in enumerate(left) if c >= s), len(left))
        if at == len(left):
            left.append(capacity)
        out.append((at, capacity - left[at]))
        left[at] -= s
    return out


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 300):
        sizes = np.sort(rng.integers(1, 50, n))[::-1]
        bins, offsets = first_fit_decreasing(sizes, 50)
        assert list(zip(bins.tolist(), offsets.tolist())) == naive_first_fit(sizes.tolist(), 50)


@pytest.mark.parametrize("source", ["odd", "file"])
def test_pack(spark, odd_docs, source):
    docs = odd_docs if source == "odd" else spark.read.parquet(DOCS)
    name = "byte_bpe_50k.json"
    rows = pack(docs, vocabulary(name), group_docs=60).collect()
    want = sorted((str(d.doc_id), ids_of(name, d.text)) for d in docs.select("doc_id", "text").collect())
    got = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    expect = []
    for d, ids in want:
        for s in range(0, len(ids), 2048):
            expect.append((d, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048]), len(ids)))
    assert got == sorted(expect)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    if source == "file":
        assert sum(r.length for r in rows) > 0.9 * 2048 * len(seqs)


def test_pack_nothing(no_docs):
    assert pack(no_docs, vocabulary("byte_bpe_50k.json")).collect() == []


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    name = "word_bpe_49k.json"
    for docs in (odd_docs, spark.read.parquet(DOCS).repartition(3)):
        rows = sorted(crc32_of_ids(token_files(docs, vocabulary(name))).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted((d.doc_id for d in docs.collect()), key=lambda x: (x is not None, x))
        at = 0
        for r in rows:
            assert r.start == at
            at += r.n_tokens
        want = sorted((str(d.doc_id), len(i := ids_of(name, d.text)), crc(i)) for d in docs.collect())
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want
    assert token_files(no_docs, vocabulary(name)).collect() == []
    write_token_ids(odd_docs, str(tmp_path / "o"), vocabulary(name))
    back = read_token_ids(spark, str(tmp_path / "o")).where("doc_id = 9").collect()
    assert back[0].ids == ids_of(name, "it's they'll 12345 !!!??? $$$")


def test_words_of_a_batch_are_looked_up_once(odd_docs):
    name = "word_bpe_49k.json"
    texts = [r.text for r in odd_docs.select("text").collect()]
    texts += ["one two\n\none  two", "", "a\u2003b a", None, " ", "\n", "two one", "İ Σας ΟΔΟΣ one"]
    seen, library = [], Tokenizer.from_file(vocabulary(name))

    class Counting(dict):
        def get(self, key, default=None):
            seen.append(key)
            return dict.get(self, key, default)

    table = id_bytes(vocabulary(name), False)
    table.plain[:] = Counting(), {}
    end = (1).to_bytes(4, "little")
    for limit in (table.limit, 1):
        table.limit = limit
        for kind in (pa.string(), pa.large_string()):
            for own in (texts, texts[::-1], [None], ["\t"], []):
                flat, counts = table.ids(pa.array(own, kind), end)
                want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in own]
                assert flat.tolist() == [i for w in want for i in w]
                assert counts.tolist() == [len(w) for w in want]
            if limit > 1:
                assert seen.count("one") == 2 and seen.count("plain") == 2  # once in each batch that has them
                seen.clear()
    id_bytes.cache_clear()


def test_chunks_of_a_batch_are_looked_up_once(odd_docs):
    path, rng, seen = vocabulary("byte_bpe_50k.json"), np.random.default_rng(5), []
    texts = [r.text for r in odd_docs.select("text").collect()]
    texts += ["one, two. one\nOne, one", "one", "\none", "x\n\n\ny", "a<|endoftext|>, b\nc", "<|endoftext|", "\n", ""]
    parts = [*"ab Zé×÷ñ中…'.,;!|<>&7\n", " ", "\n", "'s", "'ll", "<|endoftext|>", "word", "  ", "\u0301", "\u2003", "\t"]
    for n in range(1500):
        some = parts if n % 2 else parts[:-2]
        texts.append("".join(rng.choice(some, rng.integers(0, 12 if n % 3 else 60))))

    class Counting(dict):
        def get(self, key, default=None):
            seen.append(key)
            return dict.get(self, key, default)

    table, library = id_bytes(path, True), Tokenizer.from_file(path)
    table.plain[:] = Counting(), {}
    end = (1).to_bytes(4, "little")
    for limit in (table.limit, 1):
        table.limit = limit
        for kind in (pa.string(), pa.large_string()):
            for own in (texts, texts[::-1], ["", None], [None], ["\t"], ["", "a"], []):
                flat, counts = table.ids(pa.array(own, kind), end)
                want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in own]
                assert flat.tolist() == [i for w in want for i in w]
                assert counts.tolist() == [len(w) for w in want]
            if limit > 1:
                assert seen.count(" one") == seen.count("one") == seen.count(",") == 2  # once in each batch
                assert "one," not in seen and "\nOne," not in seen
                seen.clear()
    id_bytes.cache_clear()


def test_token_files_have_indexes_that_look_ups_use(spark, tmp_path):
    docs = spark.range(60_000).selectExpr("id * 2 AS doc_id", "CONCAT('word ', id % 7) AS text").coalesce(1)
    out = str(tmp_path / "o")
    write_token_ids(docs, out, vocabulary("word_bpe_49k.json"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    orc = jvm.org.apache.orc
    for file in tmp_path.glob("o/*.orc"):
        reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 10_000 and str(reader.getCompressionKind()) == "ZSTD"
        rows = reader.rows()
        at = list(reader.getSchema().getFieldNames()).index("doc_id") + 1
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds = {str(s.getKind()) for s in footer.getStreamsList() if s.getColumn() == at}
            assert {"ROW_INDEX", "BLOOM_FILTER_UTF8", "DATA"} <= kinds
            assert str(footer.getColumns(at).getKind()) == "DIRECT_V2"  # integer run-length encoding
        rows.close()

    def read_rows(condition):
        df = read_token_ids(spark, out).where(condition)
        found = df.collect()
        scans, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                node = node.executedPlan()
            name = node.nodeName()
            if name.startswith("Scan orc") and "ids" in node.toString():
                scans += node.metrics().apply("numOutputRows").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
            if "QueryStage" in name:
                todo.append(node.plan())
        return found, scans

    there, some = read_rows("doc_id = 70000")
    absent, none = read_rows("doc_id = 70001")  # within the range of a row group, so that only the Bloom filter tells
    assert len(there) == 1 and there[0].ids == ids_of("word_bpe_49k.json", "word 0") and absent == []
    assert 0 < some <= 10_000 and none < some


def test_equal_rows_are_spread(spark, tmp_path):
    docs = spark.range(3000).selectExpr("1L AS doc_id", "'the same text' AS text").repartition(8)
    groups = {r.sequence_id >> 32 for r in pack(docs, vocabulary("byte_bpe_50k.json"), group_docs=100).collect()}
    assert len(groups) > 1
    write_token_ids(docs, str(tmp_path / "o"), vocabulary("word_bpe_49k.json"))
    rows = read_token_ids(spark, str(tmp_path / "o"))
    n = rows.first().n_tokens
    assert sorted(r.start for r in rows.collect()) == [i * n for i in range(3000)]


def library_counter(pieces, byte_fallback=True):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(spark, odd_docs, no_docs):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    count = library_counter([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())])
    for docs in (odd_docs, spark.read.parquet(DOCS)):
        want = sorted((str(d.doc_id), count(d.text or ""), len(d.text or "")) for d in docs.collect())
        assert sorted((str(r.doc_id), r.n_tokens, r.n_chars) for r in count_tokens(docs, path).collect()) == want
    assert count_tokens(no_docs, path).collect() == []
    assert counter_for(path).count("▁▁a  b") == count("▁▁a  b")


def test_ties_and_unknowns():
    rng = np.random.default_rng(5)
    for fallback in (False, True):
        for _ in range(150):
            pieces = {"<unk>": 0.0}
            for _ in range(12):
                word = "".join(rng.choice(list("▁abc"), rng.integers(1, 4)))
                pieces.setdefault(word, float(-rng.integers(1, 4)))
            if fallback:
                pieces |= {f"<0x{b:02X}>": -1.0 for b in range(256)}
            count, own = library_counter(list(pieces.items()), fallback), UnigramCounter(list(pieces.items()), fallback)
            for _ in range(10):
                text = "".join(rng.choice(list("abcdé "), rng.integers(0, 12)))
                assert own.count(text) == count(text), (pieces, text)
