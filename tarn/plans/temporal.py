"""Queries on intervals, ages and parts of times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import dates
from tarn.plans.registry import Tables, query


@query("SELECT l_orderkey, l_linenumber, CAST(extract(year FROM a)*12 + extract(month FROM a) AS INTEGER) m, CAST(extract(day FROM a) AS INTEGER) d, CAST(extract(microsecond FROM a) + 60000000*extract(minute FROM a) + 3600000000*extract(hour FROM a) AS BIGINT) u FROM (SELECT l_orderkey, l_linenumber, age(l_shipdate + INTERVAL 13 HOUR, o_orderdate + INTERVAL (l_linenumber*5) HOUR) a FROM lineitem JOIN orders ON l_orderkey=o_orderkey)")
def ages(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.expr("l_orderkey = o_orderkey"))
    late = F.expr("l_shipdate + INTERVAL 13 HOURS")
    early = F.expr("o_orderdate + make_dt_interval(0, l_linenumber * 5, 0, 0)")
    a = dates.age(late, early)
    return j.select("l_orderkey", "l_linenumber", a["months"].alias("m"), a["days"].alias("d"), a["micros"].alias("u"))


@query("SELECT event_id, ts + to_months((event_id%30)::INTEGER) a, ts + to_weeks((event_id%3)::INTEGER) b, ts - to_hours(event_id%50) c, ts + to_years((event_id%5)::INTEGER) + to_days(1) d, ts + to_milliseconds(event_id*1.0) e, ts + to_quarters((event_id%7)::INTEGER) f FROM events")
def interval_constructors(t: Tables) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts")
    make = dates.to_interval
    return t.events.select(
        "event_id", dates.plus(ts, make("months", k % 30)).alias("a"), dates.plus(ts, make("weeks", k % 3)).alias("b"),
        dates.plus(ts, dates.scale_interval(make("hours", k % 50), -1)).alias("c"),
        dates.plus(dates.plus(ts, make("years", k % 5)), make("days", F.lit(1))).alias("d"),
        dates.plus(ts, make("milliseconds", k)).alias("e"), dates.plus(ts, make("quarters", k % 7)).alias("f"),
    )


@query("SELECT o_orderkey, to_days((o_orderkey%40)::INTEGER) + to_hours(o_orderkey%30) > to_months(1) g, to_days((o_orderkey%40)::INTEGER) = to_hours((o_orderkey%40)*24) e, to_years((o_orderkey%3)::INTEGER) < to_months(((o_orderkey%3)*12+1)::INTEGER) l FROM orders")
def interval_comparison(t: Tables) -> DataFrame:
    k, make, order = F.col("o_orderkey"), dates.to_interval, dates.interval_order
    both = dates.add_intervals(make("days", k % 40), make("hours", k % 30))
    return t.orders.select(
        "o_orderkey", (order(both) > order(make("months", F.lit(1)))).alias("g"),
        (order(make("days", k % 40)) == order(make("hours", (k % 40) * 24))).alias("e"),
        (order(make("years", k % 3)) < order(make("months", (k % 3) * 12 + 1))).alias("l"),
    )


@query("SELECT event_id, isoyear(ts) iy, era(ts) er, round(julian(ts),5) j, round(epoch(ts),3) e, epoch_ms(date_trunc('millisecond', ts)) em, epoch_ns(ts) en, minute(ts) mi, second(ts) s, microsecond(ts) us, millisecond(ts) ms, epoch_us(to_timestamp(epoch(ts)))//1000 tt FROM events")
def more_date_parts(t: Tables) -> DataFrame:
    x = F.col("ts")
    us = F.pmod(dates.micros(x), F.lit(60_000_000))
    return t.events.select(
        "event_id", dates.isoyear(x).alias("iy"), dates.era(x).alias("er"), F.round(dates.julian(x), 5).alias("j"), F.round(dates.epoch(x), 3).alias("e"),
        dates.epoch_ms(x).alias("em"), dates.epoch_ns(x).alias("en"), F.minute(x).cast("long").alias("mi"), F.second(x).cast("long").alias("s"),
        us.alias("us"), F.floor(us / 1000).cast("long").alias("ms"), F.floor(F.unix_micros(dates.to_timestamp(dates.epoch(x))) / 1000).cast("long").alias("tt"),
    )


@query("SELECT o_orderkey, make_time(o_orderkey%24, o_orderkey%60, (o_orderkey%60)+0.25)::VARCHAR t, make_timestamp(2000+o_orderkey%30, 1+o_orderkey%12, 1+o_orderkey%28, 3, 4, 5.5) ts, epoch_us(timezone('Europe/Berlin', make_timestamp(2000+o_orderkey%30, 1+o_orderkey%12, 1+o_orderkey%28, 3, 4, 5.5))) tz FROM orders")
def made_times(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    parts = [(2000 + k % 30).cast("int"), (1 + k % 12).cast("int"), (1 + k % 28).cast("int"), F.lit(3), F.lit(4), F.lit(5.5).cast("decimal(16,6)")]
    return t.orders.select(
        "o_orderkey", dates.make_time(k % 24, k % 60, k % 60 + 0.25).alias("t"), dates.make_timestamp(*parts).alias("ts"),
        F.unix_micros(dates.make_timestamptz(*parts, "Europe/Berlin")).alias("tz"),
    )


@query("SELECT event_id, CAST(ts AS DATE) + CAST(event_id%50 AS INTEGER) a, CAST(ts AS DATE) - CAST(event_id%50 AS INTEGER) b, date_add(CAST(ts AS DATE), INTERVAL 1 MONTH) c, CAST(ts AS DATE) - DATE '2024-01-01' d FROM events")
def date_arithmetic(t: Tables) -> DataFrame:
    d, n = F.to_date("ts"), (F.col("event_id") % 50).cast("int")
    return t.events.select(
        "event_id", F.date_add(d, n).alias("a"), F.date_sub(d, n).alias("b"), F.add_months(d, 1).cast("timestamp_ntz").alias("c"),
        F.datediff(d, F.lit("2024-01-01")).cast("long").alias("d"),
    )


@query("SELECT count(*) FILTER (WHERE today() = current_date) n, count(*) FILTER (WHERE now() = get_current_timestamp()) m, count(*) FILTER (WHERE CAST(now() AS DATE) >= DATE '2024-01-01') k FROM nation")
def current_times(t: Tables) -> DataFrame:
    later = F.to_date(dates.now()) >= F.lit("2024-01-01").cast("date")
    return t.nation.agg(
        F.count_if(dates.today() == F.current_date()).alias("n"), F.count_if(dates.now() == F.current_timestamp()).alias("m"), F.count_if(later).alias("k")
    )


@query("SELECT CAST(i AS BIGINT) AS i, ts FROM (SELECT i, unnest(range(TIMESTAMP '2024-01-31' + to_days(i::INTEGER), TIMESTAMP '2024-06-01', INTERVAL '1 month')) ts FROM range(0, 3) r(i))")
def ranges_of_months(t: Tables) -> DataFrame:
    own = t.spark.range(0, 3).withColumnRenamed("id", "i").withColumn("first", F.expr("TIMESTAMP_NTZ '2024-01-31' + make_dt_interval(CAST(i AS INT))"))
    end = F.expr("TIMESTAMP_NTZ '2024-06-01'")
    return own.select("i", F.explode(dates.range_by_months(F.col("first"), end, 1)).alias("ts"))
