"""Queries on the business tables: scans, joins, aggregation, windows, sorting, sets, statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators import aggregates as agg
from tarn.operators import joins, relational
from tarn.plans.registry import Tables, query


def money(c, n: int = 2):
    return F.round(c, n)


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity),2) sum_qty, round(sum(l_extendedprice),2) sum_base_price,
round(sum(l_extendedprice*(1-l_discount)),4) sum_disc_price, round(avg(l_quantity),4) avg_qty, count(*) count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t: Tables) -> DataFrame:
    li = t.lineitem.where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        money(F.sum("l_quantity")).alias("sum_qty"),
        money(F.sum("l_extendedprice")).alias("sum_base_price"),
        money(F.sum(F.expr("l_extendedprice*(1-l_discount)")), 4).alias("sum_disc_price"),
        money(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.count("*").alias("count_order"),
    )


@query("""SELECT n_name, round(sum(l_extendedprice*(1-l_discount)),4) revenue FROM customer JOIN orders ON c_custkey=o_custkey
JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey AND c_nationkey=s_nationkey
JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA' GROUP BY n_name""")
def local_supplier_volume(t: Tables) -> DataFrame:
    """The region is applied to suppliers and customers first, so that little of the two large tables is shuffled."""
    nations = t.nation.join(t.region.where("r_name = 'ASIA'"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", "n_name")
    suppliers = t.supplier.join(nations, F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    customers = t.customer.join(nations, F.expr("c_nationkey = n_nationkey"), "left_semi").select("c_custkey", "c_nationkey")
    orders = t.orders.join(customers, F.expr("o_custkey = c_custkey")).select("o_orderkey", "c_nationkey")
    lines = t.lineitem.join(suppliers, F.expr("l_suppkey = s_suppkey"))
    joined = lines.join(orders, F.expr("l_orderkey = o_orderkey AND s_nationkey = c_nationkey"))
    return joined.groupBy("n_name").agg(money(F.sum(F.expr("l_extendedprice*(1-l_discount)")), 4).alias("revenue"))


@query("""SELECT round(sum(l_extendedprice*l_discount),4) revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity<24""")
def forecast_revenue(t: Tables) -> DataFrame:
    li = t.lineitem.where("l_discount BETWEEN 0.05D AND 0.07D AND l_quantity < 24")
    return li.agg(money(F.sum(F.expr("l_extendedprice*l_discount")), 4).alias("revenue"))


@query("""SELECT l_orderkey, round(sum(l_extendedprice*(1-l_discount)),4) revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment='BUILDING' AND c_custkey=o_custkey AND l_orderkey=o_orderkey GROUP BY l_orderkey, o_orderdate
ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def shipping_priority(t: Tables) -> DataFrame:
    j = t.customer.where("c_mktsegment = 'BUILDING'").join(t.orders, F.expr("c_custkey = o_custkey"))
    j = j.join(t.lineitem, F.expr("l_orderkey = o_orderkey")).groupBy("l_orderkey", "o_orderdate")
    revenue = money(F.sum(F.expr("l_extendedprice*(1-l_discount)")), 4).alias("revenue")
    return j.agg(revenue).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("""SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o.o_orderkey AND l_quantity>45) GROUP BY 1""")
def exists_subquery(t: Tables) -> DataFrame:
    big = t.lineitem.where("l_quantity > 45")
    kept = t.orders.join(big, F.expr("l_orderkey = o_orderkey"), "left_semi")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, round(sum(c_acctbal),2) AS bal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)""")
def anti_join_scalar_subquery(t: Tables) -> DataFrame:
    mean = t.customer.agg(F.avg("c_acctbal").alias("mean"))
    out = t.customer.join(t.orders, F.expr("o_custkey = c_custkey"), "left_anti").crossJoin(F.broadcast(mean))
    return out.where("c_acctbal > mean").agg(F.count("*").alias("n"), money(F.sum("c_acctbal")).alias("bal"))


@query("""SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.8*avg(o_totalprice) FROM orders i WHERE i.o_custkey=o.o_custkey)""")
def correlated_subquery(t: Tables) -> DataFrame:
    mean = t.orders.groupBy("o_custkey").agg((1.8 * F.avg("o_totalprice")).alias("most"))
    return t.orders.join(mean, "o_custkey").where("o_totalprice > most").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey >= ALL (SELECT n_nationkey FROM nation WHERE n_regionkey=1) AND c_nationkey IN (SELECT n_nationkey FROM nation)")
def all_and_in_subquery(t: Tables) -> DataFrame:
    most = t.nation.where("n_regionkey = 1").agg(F.max("n_nationkey").alias("m"))
    out = t.customer.crossJoin(F.broadcast(most)).where("c_nationkey >= m")
    return out.join(t.nation, F.expr("c_nationkey = n_nationkey"), "left_semi").select("c_custkey", "c_nationkey")


@query("""SELECT n_name, s_name, round(s_acctbal,2) AS bal FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey AND s_acctbal > 5000""")
def left_join(t: Tables) -> DataFrame:
    j = t.nation.join(t.supplier, F.expr("s_nationkey = n_nationkey AND s_acctbal > 5000"), "left")
    return j.select("n_name", "s_name", money(F.col("s_acctbal")).alias("bal"))


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey=o_custkey")
def full_join(t: Tables) -> DataFrame:
    c, o = t.customer, t.orders
    return c.join(o, F.expr("c_custkey = o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey=n_nationkey")
def right_join(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.expr("s_nationkey = n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < 2")
def cross_product(t: Tables) -> DataFrame:
    return t.region.where("r_regionkey < 2").crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey AND length(a.n_name) > length(b.n_name) + 3")
def theta_join(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("ka"), F.col("n_regionkey").alias("ra"))
    j = a.join(t.nation, F.expr("ka < n_nationkey AND ra <> n_regionkey AND length(a) > length(n_name) + 3"))
    return j.select("a", F.col("n_name").alias("b"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_acctbal BETWEEN a.s_acctbal - 15 AND a.s_acctbal + 15 AND a.s_suppkey < b.s_suppkey")
def band_join(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x"))
    b = t.supplier.select(F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("y"))
    return joins.band_join(a, b, "x", "y", 15, 15).where("a < b").select("a", "b")


@query("""WITH r AS (SELECT event_id, user_id, epoch_us(ts)/1000000 AS s, epoch_us(ts)/1000000 + value AS e FROM events WHERE value > 0)
SELECT x.event_id AS a, y.event_id AS b FROM r x JOIN r y ON x.user_id=y.user_id AND x.s < y.e AND y.s < x.e AND x.event_id < y.event_id""")
def interval_overlap_join(t: Tables) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    r = t.events.where("value > 0").select("event_id", "user_id", seconds.alias("s"), (seconds + F.col("value")).alias("e"))
    a = r.select(F.col("event_id").alias("a"), "user_id", F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = r.select(F.col("event_id").alias("b"), "user_id", F.col("s").alias("s2"), F.col("e").alias("e2"))
    out = joins.overlap_join(a, b, ("s1", "e1"), ("s2", "e2"), 100.0, by=["user_id"])
    return out.where("a < b").select("a", "b")


ASOF = """WITH p AS (SELECT DISTINCT ON (user_id, ts) user_id, ts AS pts, event_id AS pid FROM events WHERE event_type='purchase' ORDER BY user_id, ts, event_id)
SELECT e.event_id, {0} FROM events e ASOF {1} JOIN p ON e.user_id=p.user_id AND e.ts {2} p.pts WHERE e.event_type<>'purchase'"""


def _purchases(t: Tables) -> DataFrame:
    p = t.events.where("event_type = 'purchase'")
    p = relational.distinct_on(p, ["user_id", "ts"], [F.col("event_id").asc()])
    return p.select("user_id", F.col("ts").alias("pts"), F.col("event_id").alias("pid"))


def _asof(t: Tables, how: str, op: str, *columns: str) -> DataFrame:
    left = t.events.where("event_type <> 'purchase'")
    return joins.asof_join(left, _purchases(t), "ts", "pts", ["user_id"], how, op).select("event_id", *columns)


@query(ASOF.format("pid", "LEFT", ">="))
def asof_left_join(t: Tables) -> DataFrame:
    return _asof(t, "left", ">=", "pid")


@query(ASOF.format("pid, pts", "", ">"))
def asof_inner_join_strict(t: Tables) -> DataFrame:
    return _asof(t, "inner", ">", "pid", "pts")


@query(ASOF.format("pid", "LEFT", "<="))
def asof_forward_join(t: Tables) -> DataFrame:
    return _asof(t, "left", "<=", "pid")


@query("""SELECT event_id FROM events e WHERE event_type<>'purchase' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type='purchase' AND p.user_id=e.user_id AND p.ts <= e.ts)""")
def asof_semi_join(t: Tables) -> DataFrame:
    return _asof(t, "semi", ">=")


@query("""SELECT event_id FROM events e WHERE event_type<>'purchase' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type='purchase' AND p.user_id=e.user_id AND p.ts <= e.ts)""")
def asof_anti_join(t: Tables) -> DataFrame:
    return _asof(t, "anti", ">=")


@query("""SELECT n_name, r_name FROM (SELECT n_name FROM nation ORDER BY n_name) a POSITIONAL JOIN (SELECT r_name FROM region ORDER BY r_name) b""")
def positional_join(t: Tables) -> DataFrame:
    return joins.positional_join(t.nation.select("n_name"), t.region.select("r_name"), ["n_name"], ["r_name"])


@query("SELECT c_custkey, c_custkey IN (SELECT CASE WHEN o_custkey%7=0 THEN NULL ELSE o_custkey END FROM orders) AS mark FROM customer")
def mark_join(t: Tables) -> DataFrame:
    c, o = t.customer, t.orders
    some = o.select(F.expr("CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END k"))
    return joins.mark_join(c.select("c_custkey"), some, "c_custkey", "k")


@query("SELECT count(*) AS n FROM (SELECT nullif(o_custkey%5,0) k FROM orders) a JOIN (SELECT nullif(c_custkey%5,0) j FROM customer) b ON k IS NOT DISTINCT FROM j")
def null_safe_join(t: Tables) -> DataFrame:
    o, c = t.orders, t.customer
    a = o.selectExpr("nullif(o_custkey % 5, 0) k").groupBy("k").agg(F.count("*").alias("x"))
    b = c.selectExpr("nullif(c_custkey % 5, 0) j").groupBy("j").agg(F.count("*").alias("y"))
    return a.join(b, F.col("k").eqNullSafe(F.col("j"))).agg(F.sum(F.col("x") * F.col("y")).alias("n"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey=c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)")
def lateral_top_two(t: Tables) -> DataFrame:
    c, o = t.customer, t.orders
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = relational.qualify(o, F.row_number().over(w), lambda n: n <= 2)
    j = c.join(top, F.expr("o_custkey = c_custkey"))
    return j.select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus, o_orderpriority, count(*) n, grouping(o_orderstatus) gs, grouping_id(o_orderstatus,o_orderpriority) gid FROM orders GROUP BY CUBE(o_orderstatus,o_orderpriority)")
def cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.grouping("o_orderstatus").cast("long").alias("gs"),
        F.grouping_id("o_orderstatus", "o_orderpriority").alias("gid"),
    )


@query("SELECT r_name, n_name, round(sum(c_acctbal),2) bal FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ROLLUP(r_name,n_name)")
def rollup(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.expr("c_nationkey = n_nationkey")).join(t.region, F.expr("n_regionkey = r_regionkey"))
    return j.rollup("r_name", "n_name").agg(money(F.sum("c_acctbal")).alias("bal"))


@query("SELECT p_brand, p_size, count(*) n FROM part GROUP BY GROUPING SETS ((p_brand),(p_size),())")
def grouping_sets(t: Tables) -> DataFrame:
    b, s = F.col("p_brand"), F.col("p_size")
    return t.part.groupingSets([[b], [s], []], b, s).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) dc, CAST(sum(DISTINCT o_custkey) AS BIGINT) ds, count(*) FILTER (WHERE o_totalprice>1000) f, count(DISTINCT o_orderpriority) FILTER (WHERE o_custkey<500) df FROM orders GROUP BY 1")
def distinct_and_filtered_aggregates(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(
        F.countDistinct("o_custkey").alias("dc"), F.sum_distinct(F.col("o_custkey")).alias("ds"),
        F.count_if(F.col("o_totalprice") > 1000).alias("f"),
        F.countDistinct(F.when(F.col("o_custkey") < 500, F.col("o_orderpriority"))).alias("df"),
    )


@query("SELECT p_brand, round(avg(p_retailprice),4) mean, round(stddev_samp(p_retailprice),4) sd, round(stddev_pop(p_retailprice),4) sp, round(var_samp(p_retailprice),3) vs, round(var_pop(p_retailprice),3) vp, round(sem(p_retailprice),4) se, round(skewness(p_retailprice),6) sk, round(kurtosis(p_retailprice),6) ku, round(kurtosis_pop(p_retailprice),6) kp, round(geomean(p_retailprice),4) gm FROM part GROUP BY 1")
def moments(t: Tables) -> DataFrame:
    x = F.col("p_retailprice")
    r = F.round
    return t.part.groupBy("p_brand").agg(
        r(F.avg(x), 4).alias("mean"), r(F.stddev_samp(x), 4).alias("sd"), r(F.stddev_pop(x), 4).alias("sp"),
        r(F.var_samp(x), 3).alias("vs"), r(F.var_pop(x), 3).alias("vp"), r(agg.sem(x), 4).alias("se"),
        r(agg.skewness(x), 6).alias("sk"), r(agg.kurtosis(x), 6).alias("ku"), r(F.kurtosis(x), 6).alias("kp"),
        r(agg.geomean(x), 4).alias("gm"),
    )


@query("SELECT l_returnflag, round(corr(l_extendedprice,l_quantity),6) c, round(covar_pop(l_extendedprice,l_quantity),2) cp, round(covar_samp(l_extendedprice,l_quantity),2) cs, round(regr_slope(l_extendedprice,l_quantity),3) sl, round(regr_intercept(l_extendedprice,l_quantity),2) ic, round(regr_r2(l_extendedprice,l_quantity),6) r2, CAST(regr_count(l_extendedprice,l_quantity) AS BIGINT) n, round(regr_avgx(l_extendedprice,l_quantity),4) ax, round(regr_avgy(l_extendedprice,l_quantity),3) ay FROM lineitem GROUP BY 1")
def regression(t: Tables) -> DataFrame:
    y, x, r = F.col("l_extendedprice"), F.col("l_quantity"), F.round
    return t.lineitem.groupBy("l_returnflag").agg(
        r(F.corr(y, x), 6).alias("c"), r(F.covar_pop(y, x), 2).alias("cp"), r(F.covar_samp(y, x), 2).alias("cs"),
        r(F.regr_slope(y, x), 3).alias("sl"), r(F.regr_intercept(y, x), 2).alias("ic"), r(F.regr_r2(y, x), 6).alias("r2"),
        F.regr_count(y, x).alias("n"), r(F.regr_avgx(y, x), 4).alias("ax"), r(F.regr_avgy(y, x), 3).alias("ay"),
    )


@query("SELECT p_brand, arg_min(p_partkey, p_retailprice*1000000+p_partkey) lo, arg_max(p_partkey, p_retailprice*1000000+p_partkey) hi, bit_and(p_size) ba, bit_or(p_size) bo, bit_xor(p_size) bx, bool_and(p_size>0) al, bool_or(p_size>49) an FROM part GROUP BY 1")
def extreme_and_bit_aggregates(t: Tables) -> DataFrame:
    by = F.expr("p_retailprice*1000000+p_partkey")
    return t.part.groupBy("p_brand").agg(
        agg.arg_min(F.col("p_partkey"), by).alias("lo"), agg.arg_max(F.col("p_partkey"), by).alias("hi"),
        F.bit_and("p_size").alias("ba"), F.bit_or("p_size").alias("bo"), F.bit_xor("p_size").alias("bx"),
        F.bool_and(F.col("p_size") > 0).alias("al"), F.bool_or(F.col("p_size") > 49).alias("an"),
    )


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) names, list(n_nationkey ORDER BY n_name DESC)::VARCHAR ks FROM nation GROUP BY 1")
def ordered_aggregates(t: Tables) -> DataFrame:
    listed = F.reverse(agg.ordered_list(F.col("n_nationkey"), F.col("n_name")))
    return t.nation.groupBy("n_regionkey").agg(
        agg.ordered_string(F.col("n_name"), ", ", F.col("n_name")).alias("names"),
        F.concat(F.lit("["), F.array_join(listed.cast("array<string>"), ", "), F.lit("]")).alias("ks"),
    )


@query("SELECT event_type, round(median(value),4) med, round(quantile_cont(value,0.9),4) q9, round(mad(value),4) dev, round(quantile_disc(value,0.25),4) qd FROM events GROUP BY 1")
def quantiles(t: Tables) -> DataFrame:
    e, k = t.events, ["event_type"]
    q = agg.quantiles(e, k, "value", [0.5, 0.9], "q", [0.25]).join(agg.mad(e, k, "value", "dev"), k)
    values = {"med": F.get("q", F.lit(0)), "q9": F.get("q", F.lit(1)), "dev": F.col("dev"), "qd": F.get("q", F.lit(2))}
    return q.select("event_type", *(F.round(c, 4).alias(n) for n, c in values.items()))


@query("SELECT o_orderstatus, round(entropy(o_orderpriority),6) en FROM orders GROUP BY 1")
def entropy(t: Tables) -> DataFrame:
    return agg.entropy(t.orders, ["o_orderstatus"], "o_orderpriority", "en").select("o_orderstatus", F.round("en", 6).alias("en"))


@query("SELECT k.o_orderstatus, unnest(map_entries(h)).key AS v, CAST(unnest(map_entries(h)).value AS BIGINT) AS n FROM (SELECT o_orderstatus, histogram(o_orderpriority) h FROM orders GROUP BY 1) k")
def histogram(t: Tables) -> DataFrame:
    h = agg.histogram(t.orders, ["o_orderstatus"], "o_orderpriority", "h")
    return h.select("o_orderstatus", F.explode("h").alias("v", "n"))


@query("WITH c AS (SELECT p_brand, p_size, count(*) n FROM part GROUP BY ALL) SELECT DISTINCT ON (p_brand) p_brand, p_size AS m FROM c ORDER BY p_brand, n DESC, p_size")
def mode(t: Tables) -> DataFrame:
    return agg.mode(t.part, ["p_brand"], "p_size", "m")


@query("SELECT bitstring_agg(p_size, 1, 60)::VARCHAR bits FROM part")
def bitstring_agg(t: Tables) -> DataFrame:
    return t.part.agg(agg.bitstring(range(1, 61), F.col("p_size")).alias("bits"))


@query("SELECT l_orderkey, round(product(1 + l_discount), 9) p FROM lineitem GROUP BY 1")
def product(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.product(1 + F.col("l_discount")), 9).alias("p"))


@query("""SELECT o_orderkey, row_number() OVER w rn, rank() OVER v rk, dense_rank() OVER v dr, round(percent_rank() OVER v,6) pr, round(cume_dist() OVER v,6) cd, ntile(4) OVER w nt,
lag(o_orderkey,1,-1) OVER w lg, lead(o_orderkey,2) OVER w ld, first_value(o_orderkey) OVER w fv, nth_value(o_orderkey,2) OVER w nv
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)""")
def ranking_windows(t: Tables) -> DataFrame:
    o = t.orders
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    long = lambda c: c.cast("long")
    return o.select(
        "o_orderkey", long(F.row_number().over(w)).alias("rn"), long(F.rank().over(v)).alias("rk"),
        long(F.dense_rank().over(v)).alias("dr"), F.round(F.percent_rank().over(v), 6).alias("pr"),
        F.round(F.cume_dist().over(v), 6).alias("cd"), long(F.ntile(4).over(w)).alias("nt"),
        F.lag("o_orderkey", 1, -1).over(w).alias("lg"), F.lead("o_orderkey", 2).over(w).alias("ld"),
        F.first("o_orderkey").over(w).alias("fv"), F.nth_value("o_orderkey", 2).over(w).alias("nv"),
    )


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING),2) s,
count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) c,
round(avg(o_totalprice) FILTER (WHERE o_orderstatus='F') OVER (PARTITION BY o_custkey),4) f FROM orders""")
def framed_windows(t: Tables) -> DataFrame:
    rows = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 1)
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    span = Window.partitionBy("o_custkey").orderBy(day).rangeBetween(-90 * 86_400_000_000, 0)
    final = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return t.orders.select(
        "o_orderkey", money(F.sum("o_totalprice").over(rows)).alias("s"), F.count("*").over(span).alias("c"),
        F.round(F.avg(final).over(Window.partitionBy("o_custkey")), 4).alias("f"),
    )


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW),2) rest,
count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) dp FROM orders""")
def exclude_and_distinct_windows(t: Tables) -> DataFrame:
    own = relational.excluding(t.orders, "o_totalprice", ["o_custkey"], ["o_orderkey"], "current row")
    priorities = F.size(F.collect_set("o_orderpriority").over(Window.partitionBy("o_custkey"))).cast("long")
    return own.select("o_orderkey", money(F.col("sum_x")).alias("rest"), priorities.alias("dp"))


@query("SELECT event_id, last_value(CASE WHEN value>50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) lv, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),4) med FROM events")
def ignore_nulls_and_holistic_windows(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    big = F.when(F.col("value") > 50, F.col("event_id"))
    return t.events.select(
        "event_id", F.last(big, ignorenulls=True).over(w).alias("lv"),
        F.round(agg.median_of(F.collect_list("value").over(w.rowsBetween(-4, 0))), 4).alias("med"),
    )


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)=1")
def qualify(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return relational.qualify(t.lineitem, F.row_number().over(w), lambda n: n == 1).select("l_orderkey", "l_linenumber")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t: Tables) -> DataFrame:
    out = relational.distinct_on(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey").asc()])
    return out.select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_size").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def top_n_with_offset(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice").orderBy(*relational.descending("o_totalprice"), "o_orderkey")
    return rows.limit(35).offset(10)


@query("SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 10%")
def limit_percent(t: Tables) -> DataFrame:
    return relational.limit_percent(t.part.select("p_partkey", "p_retailprice"), 10, ["p_retailprice", "p_partkey"]).select("p_partkey")


@query("SELECT row_number() OVER (ORDER BY nullif(p_size%9,0) DESC NULLS LAST, p_partkey) AS place, p_partkey FROM part")
def order_by_nulls_last(t: Tables) -> DataFrame:
    own = t.part.selectExpr("nullif(p_size % 9, 0) AS s", "p_partkey")
    return joins.with_position(own, [F.col("s").desc_nulls_last(), F.col("p_partkey").asc()], "place").select("place", "p_partkey")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_acctbal<0")
def union_distinct(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_nationkey k").union(t.supplier.where("s_acctbal < 0").selectExpr("s_nationkey")).distinct()


@query("SELECT c_custkey AS k, c_name AS n FROM customer UNION ALL BY NAME SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier")
def union_by_name(t: Tables) -> DataFrame:
    a, b = t.customer.selectExpr("c_custkey k", "c_name n"), t.supplier.selectExpr("s_suppkey k", "s_acctbal bal")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT c_nationkey k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_distinct(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_nationkey k").subtract(t.supplier.where("s_acctbal > 5000").selectExpr("s_nationkey"))


@query("SELECT c_nationkey k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_nationkey k").exceptAll(t.supplier.selectExpr("s_nationkey"))


@query("SELECT c_nationkey k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_nationkey k").intersectAll(t.supplier.selectExpr("s_nationkey"))


@query("SELECT c_nationkey k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal>0")
def intersect_distinct(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_nationkey k").intersect(t.supplier.where("s_acctbal > 0").selectExpr("s_nationkey"))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority='1-URGENT') AS \"1-URGENT\", count(*) FILTER (WHERE o_orderpriority='5-LOW') AS \"5-LOW\" FROM orders GROUP BY 1")
def pivot(t: Tables) -> DataFrame:
    out = relational.pivot(t.orders, ["o_orderstatus"], "o_orderpriority", ["1-URGENT", "5-LOW"], n=F.count(F.lit(1)))
    return out.select("o_orderstatus", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in ("1-URGENT", "5-LOW")))


@query("SELECT s_suppkey, name, value FROM (UNPIVOT (SELECT s_suppkey, s_acctbal AS bal, CASE WHEN s_suppkey%3=0 THEN NULL ELSE s_nationkey::DOUBLE END AS nat FROM supplier) ON bal, nat INTO NAME name VALUE value)")
def unpivot(t: Tables) -> DataFrame:
    own = t.supplier.selectExpr(
        "s_suppkey", "s_acctbal AS bal", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_nationkey AS DOUBLE) END AS nat"
    )
    return relational.unpivot(own, ["bal", "nat"])


@query("SELECT * EXCLUDE (c_name) REPLACE (lower(c_mktsegment) AS c_mktsegment, round(c_acctbal/2,3) AS c_acctbal) FROM customer")
def star_exclude_replace(t: Tables) -> DataFrame:
    out = relational.exclude(t.customer, "c_name")
    return relational.replace(out, c_mktsegment=F.lower("c_mktsegment"), c_acctbal=F.round(F.col("c_acctbal") / 2, 3))


@query("SELECT min(COLUMNS('.*key')) FROM (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem)")
def star_columns_regex(t: Tables) -> DataFrame:
    return t.lineitem.agg(*relational.columns_like(t.lineitem, ".*key", F.min))


@query("SELECT #2 AS name, #1 AS key FROM nation")
def positional_reference(t: Tables) -> DataFrame:
    return relational.positional(t.nation, 2, 1).toDF("name", "key")


@query("SELECT c_custkey, CASE WHEN c_acctbal<0 THEN 'neg' WHEN c_acctbal<5000 THEN 'low' ELSE 'high' END lvl, coalesce(nullif(c_nationkey,3),-1) nk, TRY_CAST(c_mktsegment AS INTEGER) tc, c_acctbal BETWEEN 0 AND 100 b, c_nationkey IN (1,2,3) i, c_name LIKE '%1' l, c_acctbal IS NOT DISTINCT FROM NULL d FROM customer")
def predicates_and_case(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, "neg").when(F.col("c_acctbal") < 5000, "low").otherwise("high").alias("lvl"),
        F.coalesce(F.nullif(F.col("c_nationkey"), F.lit(3)), F.lit(-1)).alias("nk"), F.expr("try_cast(c_mktsegment AS INT)").alias("tc"),
        F.col("c_acctbal").between(0, 100).alias("b"), F.col("c_nationkey").isin(1, 2, 3).alias("i"),
        F.col("c_name").like("%1").alias("l"), F.col("c_acctbal").eqNullSafe(F.lit(None)).alias("d"),
    )


@query("WITH a AS MATERIALIZED (SELECT o_custkey, count(*) n FROM orders GROUP BY 1), b AS (SELECT max(n) m FROM a) SELECT o_custkey, n FROM a, b WHERE n=m")
def common_table_expression(t: Tables) -> DataFrame:
    text = "WITH a AS (SELECT o_custkey, count(*) n FROM {orders} GROUP BY 1), b AS (SELECT max(n) m FROM a) SELECT o_custkey, n FROM a, b WHERE n = m"
    return t.sql(text, "orders")


@query("WITH RECURSIVE r(k, hops) AS (SELECT 0, 0 UNION SELECT (k*3+1) % 25, hops+1 FROM r WHERE hops<6) SELECT n_name, hops FROM r JOIN nation ON n_nationkey=k")
def recursive_query(t: Tables) -> DataFrame:
    seed = t.spark.sql("SELECT 0 AS k, 0 AS hops")
    r = relational.recursive_union(seed, lambda f: f.where("hops < 6").selectExpr("(k*3+1) % 25 AS k", "hops + 1 AS hops"))
    return r.join(t.nation, F.expr("n_nationkey = k")).select("n_name", "hops")


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) n FROM customer WHERE c_acctbal > 100 AND c_mktsegment = 'BUILDING' GROUP BY ALL HAVING count(*) > 2")
def prepared_parameters_and_having(t: Tables) -> DataFrame:
    text = "SELECT c_nationkey, count(*) n FROM {customer} WHERE c_acctbal > :least AND c_mktsegment = :segment GROUP BY ALL HAVING count(*) > 2"
    return t.spark.sql(text, args={"least": 100, "segment": "BUILDING"}, customer=t.customer)


@query("SELECT s_suppkey, CASE WHEN s_suppkey%2=0 THEN s_acctbal+1 ELSE s_acctbal END AS bal FROM supplier UNION ALL SELECT 100000+s_suppkey, 0.0 FROM supplier WHERE s_suppkey%2=1")
def insert_on_conflict_update(t: Tables) -> DataFrame:
    old = t.supplier.selectExpr("s_suppkey", "s_acctbal AS bal")
    new = t.supplier.selectExpr("CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 100000 + s_suppkey END AS s_suppkey", "CAST(0 AS DOUBLE) AS bal")
    return relational.insert_or(old, new, ["s_suppkey"], {"bal": F.col("old.bal") + 1})


@query("SELECT c_custkey, CASE WHEN c_nationkey=1 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT (c_mktsegment='MACHINERY')")
def update_and_delete(t: Tables) -> DataFrame:
    left = relational.delete_where(t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), F.expr("c_mktsegment = 'MACHINERY'"))
    return relational.update_where(left, F.expr("c_nationkey = 1"), c_acctbal=F.lit(0.0)).select("c_custkey", "c_acctbal")


@query("SELECT CAST(i AS BIGINT) AS i, CAST(i*i AS BIGINT) AS s FROM range(3, 200, 7) r(i) UNION ALL SELECT x, y FROM (VALUES (1,2),(3,NULL)) v(x,y) UNION ALL SELECT 1, 1")
def generators(t: Tables) -> DataFrame:
    r = t.spark.range(3, 200, 7).selectExpr("id AS i", "id * id AS s")
    return r.union(t.spark.sql("SELECT * FROM VALUES (1, 2), (3, NULL) AS v(x, y)")).union(t.spark.sql("SELECT 1, 1"))


@query("SELECT CAST(count(*) AS BIGINT) n FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey < 500 AND l_orderkey > 600)")
def empty_result(t: Tables) -> DataFrame:
    return t.lineitem.where("l_orderkey < 500 AND l_orderkey > 600").agg(F.count("*").alias("n"))


@query()
def reservoir_sample(t: Tables) -> DataFrame:
    return relational.reservoir(t.orders, 100, 7)


@query()
def bernoulli_sample(t: Tables) -> DataFrame:
    return relational.sample_rows(t.orders, percent=10, seed=3)


@query()
def summarize(t: Tables) -> DataFrame:
    return relational.summarize(t.lineitem)


@query()
def approximate_aggregates(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("middle")
    )
