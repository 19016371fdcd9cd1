import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from tarn.llm import common, near_duplicates, quality_rules, similar_texts  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_keep_one(spark, odd_docs, no_docs):
    docs = odd_docs.union(odd_docs).union(odd_docs.selectExpr("doc_id + 100", "concat(text, ' ')", *odd_docs.columns[2:]))
    kept = near_duplicates.keep_one(docs)
    assert kept.schema == docs.schema
    classes = near_duplicates.near_duplicate_classes(docs).collect()
    want = {r.component_id for r in classes}
    rows = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    assert near_duplicates.keep_one(no_docs).collect() == []


def test_any_column_names(spark):
    rows = [(1, "a b c d e f", 3, {"k": 1}), (1, "a b c d e f", 4, {"k": 1}), (2, "A b c d e f", 5, None), (3, None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `x.y` int, row map<string,int>")
    for keep in (near_duplicates.keep_one, similar_texts.keep_one):
        kept = keep(docs)
        assert kept.schema == docs.schema
        assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
        assert sorted(r[2] for r in keep(docs.repartition(3)).collect()) == sorted(r[2] for r in kept.collect())


def test_run_on_odd_and_empty_tables(spark, odd_docs, tmp_path):
    small = "/root/testdata/sf0.001"
    own = spark.read.parquet(f"{small}/documents.parquet")
    odd = odd_docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "CAST(NULL AS STRING) AS source", "CAST(length AS LONG) AS n_chars")
    docs = own.unionByName(odd).unionByName(own.limit(20)).withColumn("a.b", F.lit(1)).withColumn("row", F.lit("x"))
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    made = len(common.MADE)
    got = corpus_pipeline.run(spark, str(tmp_path))
    rows = got.collect()
    assert len(common.MADE) == made + 1  # only what the last stage reads is left
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, plain, str(tmp_path))
        assert after.schema == plain.schema
        plain = corpus_pipeline.materialize(after, "step")
    texts = plain.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in texts} and len({r.doc_id for r in texts}) == len(texts)
    assert sum(r.length for r in rows if r.start == 0) >= len(texts)
    assert all(r.n_chars == len(r.text) for r in texts)
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.dtypes == before.dtypes
        sizes.append(docs.count())
        if name == "quality_classifier":
            kept = {r.doc_id for r in docs.collect()}
            rows = quality_rules.statistics(spark.read.parquet(f"{SF}/documents.parquet"))
            passing = {r.doc_id for r in rows.where(~quality_rules.base_failed()).select("row.doc_id").collect()}
            good = [d in kept for d, y in labels.items() if y == 1 and d in passing]
            assert sum(good) > 0.97 * len(good)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0.6 * sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}
