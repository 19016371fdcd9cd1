"""Streams give what the batch form gives; late rows and repeats are dealt with by the watermark."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarn.streaming import windows

START = datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp, v double"


def rows(*found):
    return [(i, k, START + timedelta(minutes=m), v) for i, k, m, v in found]


def stream_of(spark, tmp_path, name, *batches):
    """A stream of one file a batch, in order."""
    folder = tmp_path / name
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(folder / f"b{n}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "b*"))


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}"))
    q.trigger(availableNow=True).start().awaitTermination(180)
    return df.sparkSession.table(name).collect()


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "sessions"])
def test_windows_of_streams_equal_batches(spark, tmp_path, kind):
    data = rows((1, "a", 0, 1.0), (2, "a", 4, 2.0), (3, "b", 11, 3.0), (4, "a", 12, 4.0), (5, "b", 13, 5.0), (6, "a", 600, 0.0))
    make = {
        "tumbling": lambda df: windows.tumbling(df, "ts", "10 minutes", ["k"], "1 hour", n=F.count("*"), s=F.sum("v")),
        "sliding": lambda df: windows.sliding(df, "ts", "10 minutes", "5 minutes", ["k"], "1 hour", n=F.count("*"), s=F.sum("v")),
        "sessions": lambda df: windows.sessions(df, "ts", "6 minutes", ["k"], "1 hour", n=F.count("*"), s=F.sum("v")),
    }[kind]
    want = {tuple(r) for r in make(spark.createDataFrame(data, SCHEMA)).collect()}
    got = {tuple(r) for r in run(make(stream_of(spark, tmp_path, kind, data[:2], data[2:5], data[5:])), f"w_{kind}", tmp_path)}
    closed = {r for r in want if r[1] < START + timedelta(minutes=540)}
    assert closed and closed <= got <= want


def test_late_rows_are_left_out(spark, tmp_path):
    late = rows((9, "a", 1, 9.0))
    # A batch's watermark holds for late rows from the second batch after it.
    batches = (rows((1, "a", 0, 1.0)), rows((2, "a", 300, 1.0)), rows((4, "a", 301, 1.0)), late, rows((3, "a", 900, 1.0)))
    df = windows.tumbling(stream_of(spark, tmp_path, "late", *batches), "ts", "10 minutes", ["k"], "30 minutes", n=F.count("*"))
    found = {r.start: r.n for r in run(df, "late_rows", tmp_path)}
    assert found[START] == 1


def test_repeats_within_the_watermark(spark, tmp_path):
    batches = (rows((1, "a", 0, 1.0), (1, "a", 1, 2.0)), rows((1, "a", 5, 3.0), (2, "a", 6, 1.0)), rows((3, "b", 7, 1.0)))
    got = run(windows.deduplicated(stream_of(spark, tmp_path, "dedup", *batches), "ts", ["id"], "1 hour"), "dedup_rows", tmp_path)
    assert sorted(r.id for r in got) == [1, 2, 3]


def test_interval_join_of_two_streams(spark, tmp_path):
    left = stream_of(spark, tmp_path, "l", rows((1, "a", 10, 0.0), (2, "a", 50, 0.0)), rows((3, "b", 60, 0.0)))
    right = stream_of(spark, tmp_path, "r", rows((7, "a", 5, 0.0), (8, "a", 49, 0.0)), rows((9, "b", 20, 0.0)))
    two = right.select(F.col("id").alias("rid"), F.col("k").alias("rk"), F.col("ts").alias("rts"))
    joined = windows.interval_joined(left, two, "ts", "rts", F.col("k") == F.col("rk"), "10 minutes", "1 hour")
    got = {(r.id, r.rid) for r in run(joined.select("id", "rid"), "interval_pairs", tmp_path)}
    assert got == {(1, 7), (2, 8)}
