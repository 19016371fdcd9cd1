"""Queries on files, partitions, footers and time windows as streams define them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.registry import Tables, query
from tarn.sources import files
from tarn.streaming import windows


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 49")
def parquet_scan_with_pushdown(t: Tables) -> DataFrame:
    return files.read_parquet(t.spark, t.path("lineitem")).where("l_quantity > 49").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS b, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window_operator(t: Tables) -> DataFrame:
    own = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.tumbling(own, "ts", "1 day", ["event_type"], "1 hour", n=F.count("*"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("b"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) sid FROM g) SELECT user_id, min(ts) b, count(*) n FROM s GROUP BY user_id, sid""")
def session_window_operator(t: Tables) -> DataFrame:
    own = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.sessions(own, "ts", "2 hours", ["user_id"], "1 hour", n=F.count("*"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("b"), "n")
