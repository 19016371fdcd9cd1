"""Queries on aggregate states, ordered and exact aggregates, and window frames that Spark does not name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators import aggregates as agg
from tarn.operators import joins, relational
from tarn.plans.registry import Tables, query


@query("SELECT l_returnflag, round(regr_sxx(l_extendedprice,l_quantity),3) sxx, round(regr_sxy(l_extendedprice,l_quantity),1) sxy, round(regr_syy(l_extendedprice,l_quantity)/1e6,1) syy FROM lineitem GROUP BY 1")
def regression_sums(t: Tables) -> DataFrame:
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.regr_sxx(y, x), 3).alias("sxx"), F.round(F.regr_sxy(y, x), 1).alias("sxy"), F.round(F.regr_syy(y, x) / 1e6, 1).alias("syy")
    )


@query("SELECT o_orderstatus, round(kahan_sum(o_totalprice),2) k, round(favg(o_totalprice),6) f FROM orders GROUP BY 1")
def compensated_sums(t: Tables) -> DataFrame:
    out = agg.kahan_sum(t.orders, ["o_orderstatus"], "o_totalprice", "k")
    return out.select("o_orderstatus", F.round("k", 2).alias("k"), F.round("k_mean", 6).alias("f"))


@query("SELECT p_brand, CAST(sum_no_overflow(p_size) AS BIGINT) s FROM part GROUP BY 1")
def sum_no_overflow(t: Tables) -> DataFrame:
    """The sum is kept in 64 bits, which 32-bit values cannot fill."""
    return t.part.groupBy("p_brand").agg(F.sum(F.col("p_size").cast("long")).alias("s"))


@query("SELECT p_brand, arg_min_null(nullif(p_size%4,0), p_partkey) lo, arg_max_null(nullif(p_size%4,0), p_partkey) hi FROM part GROUP BY 1")
def extreme_aggregates_with_nulls(t: Tables) -> DataFrame:
    x = F.expr("nullif(p_size % 4, 0)")
    return t.part.groupBy("p_brand").agg(agg.arg_min_null(x, F.col("p_partkey")).alias("lo"), agg.arg_max_null(x, F.col("p_partkey")).alias("hi"))


@query("SELECT p_brand, first(nullif(p_size%3,0) ORDER BY p_partkey) f, last(nullif(p_size%3,0) ORDER BY p_partkey) l, any_value(nullif(p_size%3,0) ORDER BY p_partkey) a FROM part GROUP BY 1")
def first_last_any(t: Tables) -> DataFrame:
    x, k = F.expr("nullif(p_size % 3, 0)"), F.col("p_partkey")
    return t.part.groupBy("p_brand").agg(agg.first_value(x, k).alias("f"), agg.last_value(x, k).alias("l"), agg.any_value(x, k).alias("a"))


@query("SELECT l_returnflag, round(q[1],4) a, round(q[2],4) b, round(q[3],4) c, round(d[1],4) d, round(d[2],4) e FROM (SELECT l_returnflag, quantile_cont(l_extendedprice,[0.1,0.5,0.99]) q, quantile_disc(l_extendedprice,[0.25,0.75]) d FROM lineitem GROUP BY 1)")
def quantile_lists(t: Tables) -> DataFrame:
    li, k = t.lineitem, ["l_returnflag"]
    q = agg.quantiles(li, k, "l_extendedprice", [0.1, 0.5, 0.99], "q", [0.25, 0.75])
    return q.select("l_returnflag", *(F.round(F.get("q", F.lit(i)), 4).alias(n) for i, n in enumerate("abcde")))


@query("SELECT event_type, round(extract(epoch FROM mad(ts)),3) AS dev, date_trunc('second', median(ts)) AS middle FROM events GROUP BY 1")
def spread_of_times(t: Tables) -> DataFrame:
    us = t.events.select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    dev = agg.mad(us, ["event_type"], "us", "dev")
    middle = us.groupBy("event_type").agg(F.median("us").alias("m"))
    second = F.date_trunc("second", F.timestamp_micros(F.floor("m").cast("long"))).cast("timestamp_ntz")
    return dev.join(middle, "event_type").select("event_type", F.round(F.col("dev") / 1e6, 3).alias("dev"), second.alias("middle"))


@query("SELECT p_type, mode(p_brand) AS m, max(n) AS times FROM (SELECT p_type, p_brand, count(*) OVER (PARTITION BY p_type, p_brand) AS n FROM (SELECT 'all' AS p_type, CASE WHEN p_size < 30 THEN 'small' ELSE p_brand END AS p_brand FROM part)) GROUP BY 1")
def mode_of_text(t: Tables) -> DataFrame:
    own = t.part.select(F.lit("all").alias("p_type"), F.when(F.col("p_size") < 30, "small").otherwise(F.col("p_brand")).alias("p_brand"))
    times = own.groupBy("p_type", "p_brand").agg(F.count("*").alias("n")).groupBy("p_type").agg(F.max("n").alias("times"))
    return agg.mode(own, ["p_type"], "p_brand", "m").join(times, "p_type")


@query("SELECT p_brand, count(p_retailprice) n, round(sum(p_retailprice),2) s, round(avg(p_retailprice),6) a, round(stddev_samp(p_retailprice),6) d FROM part GROUP BY 1")
def combined_states(t: Tables) -> DataFrame:
    """States are exported by brand and size, stored rows as any other, then combined by brand and finished."""
    states = t.part.groupBy("p_brand", "p_size").agg(agg.export_state(F.col("p_retailprice")).alias("s"))
    whole = states.groupBy("p_brand").agg(agg.combine_states(F.col("s")).alias("s"))
    done = {"n": ("count", None), "s": ("sum", 2), "a": ("avg", 6), "d": ("stddev_samp", 6)}
    finished = {n: agg.finalize_state(F.col("s"), what) for n, (what, _) in done.items()}
    return whole.select("p_brand", *((F.round(c, done[n][1]) if done[n][1] else c).alias(n) for n, c in finished.items()))


EXCLUDED = """SELECT o_orderkey, round(sum(x) OVER w,2) s, count(x) OVER w c, min(x) OVER w lo, max(x) OVER w hi
FROM (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, CASE WHEN o_orderkey%5=0 THEN NULL ELSE o_totalprice END x FROM orders)
WINDOW w AS (PARTITION BY o_custkey ORDER BY {0} ROWS BETWEEN {1} EXCLUDE {2})"""
WHOLE, FEW = "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", "3 PRECEDING AND 2 FOLLOWING"


def _excluded(t: Tables, what: str, order: list[str], rows: tuple[int, int] | None = None) -> DataFrame:
    own = t.orders.withColumn("x", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    out = relational.excluding(own, "x", ["o_custkey"], order, what, rows)
    return out.select(
        "o_orderkey", F.round("sum_x", 2).alias("s"), F.col("count_x").alias("c"), F.col("min_x").alias("lo"), F.col("max_x").alias("hi")
    )


@query(EXCLUDED.format("o_orderpriority", WHOLE, "GROUP"))
def exclude_group(t: Tables) -> DataFrame:
    return _excluded(t, "group", ["o_orderpriority"])


@query(EXCLUDED.format("o_orderpriority", WHOLE, "TIES"))
def exclude_ties(t: Tables) -> DataFrame:
    return _excluded(t, "ties", ["o_orderpriority"])


@query(EXCLUDED.format("o_orderdate, o_orderkey", WHOLE, "CURRENT ROW"))
def exclude_current_row(t: Tables) -> DataFrame:
    return _excluded(t, "current row", ["o_orderdate", "o_orderkey"])


@query(EXCLUDED.format("o_orderdate, o_orderkey", FEW, "CURRENT ROW"))
def exclude_within_rows(t: Tables) -> DataFrame:
    return _excluded(t, "current row", ["o_orderdate", "o_orderkey"], (-3, 2))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN (o_orderkey % 4) PRECEDING AND (o_orderkey % 3) FOLLOWING),2) s,
count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN (o_orderkey % 4) PRECEDING AND (o_orderkey % 3) FOLLOWING) c FROM orders""")
def frame_bounds_per_row(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    out = relational.sums_between(t.orders, "o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"], k % 4, k % 3)
    return out.select("o_orderkey", F.round("sum_x", 2).alias("s"), F.col("count_x").alias("c"))


@query("""SELECT event_id, round(quantile_cont(value,0.25) OVER w,4) q, round(mad(value) OVER w,4) d, mode(event_type) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) m
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING)""")
def holistic_windows(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 1)
    v = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(-2, 0)
    xs = t.events.select("event_id", F.collect_list("value").over(w).alias("xs"), F.collect_list("event_type").over(v).alias("kinds"))
    return xs.select(
        "event_id", F.round(agg.quantile_of(F.col("xs"), 0.25), 4).alias("q"), F.round(agg.mad_of(F.col("xs")), 4).alias("d"),
        agg.mode_of(F.col("kinds")).alias("m"),
    )


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY m COLLATE NOCASE) r FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey%2=0 THEN lower(c_mktsegment) ELSE c_mktsegment END m FROM customer)")
def window_order_by_collation(t: Tables) -> DataFrame:
    m = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    w = Window.partitionBy("c_nationkey").orderBy(F.collate(m, "UTF8_LCASE"))
    return t.customer.select("c_custkey", F.rank().over(w).cast("long").alias("r"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) n, sum(CAST(round(o_totalprice*100) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey)::BIGINT s FROM orders")
def running_window_without_partitions(t: Tables) -> DataFrame:
    order = [F.col(c).asc_nulls_last() for c in ("o_orderdate", "o_orderkey")]
    cents = t.orders.select("o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    summed = joins.running_sum(cents, "cents", order, "s", peers=True)
    return joins.with_position(summed, order, "n").select("o_orderkey", "n", "s")


@query("SELECT event_id, event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER w AS high, last_value(nullif(event_type,'view') IGNORE NULLS) OVER w AS last_other FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def named_window(t: Tables) -> DataFrame:
    text = """SELECT event_id, event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER w AS high,
        last_value(nullif(event_type, 'view')) IGNORE NULLS OVER w AS last_other FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
    return t.sql(text, "events")


@query()
def reservoir_quantile(t: Tables) -> DataFrame:
    return agg.reservoir_quantile(t.events, ["event_type"], "value", 0.5)
