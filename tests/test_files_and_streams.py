from pyspark.sql import functions as F

from tarn.operators import joins, relational
from tarn.sources import files
from tarn.streaming import windows

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_sniff_and_rejects(spark, tmp_path):
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    files.copy_to(nation, str(tmp_path / "n"), "csv", header="true", sep="|")
    back = files.read_csv(spark, str(tmp_path / "n"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, nation.collect()))
    (tmp_path / "bad.csv").write_text("1,a\nx,b\n3,c\n")
    good, bad = files.read_csv_with_rejects(spark, str(tmp_path / "bad.csv"), spark.createDataFrame([], "k int, v string").schema)
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (3, "c")]
    assert [r.rejected_line for r in bad.collect()] == ["x,b"]


def test_partitions_json_text_glob_and_databases(spark, tmp_path):
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    files.copy_to(nation, str(tmp_path / "p"), partition_by=["n_regionkey"], order_by=["n_name"])
    part = files.read_parquet(spark, str(tmp_path / "p")).where("n_regionkey = 1")
    assert part.count() == nation.where("n_regionkey = 1").count()
    files.copy_to(nation, str(tmp_path / "j"), "json")
    assert files.read_json(spark, str(tmp_path / "j")).count() == 25
    (tmp_path / "t.txt").write_text("héllo")
    row = files.read_text(spark, str(tmp_path / "t.txt")).first()
    assert row.content == "héllo" and row.size == 6
    assert [r.file for r in files.glob(spark, str(tmp_path / "*.txt")).collect()] == [str(tmp_path / "t.txt")]
    files.export_database(spark, {"nation": nation}, str(tmp_path / "db"))
    assert files.import_database(spark, str(tmp_path / "db"))["nation"].count() == 25


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counted = windows.tumbling(stream, "ts", "1 day", ["event_type"], "30 days", n=F.count("*"))
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()
    seen = []
    prices = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("pts"), "value")
    work = lambda batch, _: seen.append(joins.asof_join(batch, prices, "ts", "pts", ["user_id"], right_columns=["pts"]).count())
    windows.each_batch(stream, work, str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == events.count()


def test_edges(spark):
    empty = spark.createDataFrame([], "k long, t long, v string")
    some = spark.createDataFrame([(1, 5, "a"), (None, 5, "b"), (1, None, "c")], "k long, t long, v string")
    out = joins.asof_join(some, empty.withColumnRenamed("t", "u"), "t", "u", ["k"], right_columns=["u"]).collect()
    assert len(out) == 3 and all(r.u is None for r in out)
    other = spark.createDataFrame([(1, 5, "x"), (1, 4, "y"), (None, 1, "z")], "k long, u long, w string")
    got = {r.v: r.w for r in joins.asof_join(some, other, "t", "u", ["k"], right_columns=["w"]).collect()}
    assert got == {"a": "x", "b": None, "c": None}
    got = {r.v: r.w for r in joins.asof_join(some, other, "t", "u", ["k"], op=">", right_columns=["w"]).collect()}
    assert got["a"] == "y"
    assert relational.distinct_on(empty, ["k"], [F.col("t").asc()]).collect() == []
    assert joins.with_position(empty, ["k"]).collect() == []
