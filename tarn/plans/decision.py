"""Decision-support queries, written in SQL that both engines take; tables are bound by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tarn.plans.registry import NAMES, ORACLE, QUERIES, Tables

SQL = {
    "volume_shipping": """SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, year(l_shipdate) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
        FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
        WHERE a.n_regionkey = 1 AND b.n_regionkey = 2 GROUP BY a.n_name, b.n_name, year(l_shipdate)""",
    "returned_items": """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey
        JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name""",
    "customer_distribution": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey
        AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) x GROUP BY c_count""",
    "promotion_effect": """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "top_supplier": """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM lineitem GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "parts_supplier_relationship": """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_size IN (1, 4, 9, 15, 25, 36, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "small_quantity_orders": """SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem l JOIN part ON p_partkey = l_partkey
        WHERE l_quantity < (SELECT 0.4 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""",
    "large_volume_customers": """SELECT c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice""",
    "discounted_revenue": """SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE (p_size BETWEEN 1 AND 10 AND l_quantity BETWEEN 1 AND 20) OR (p_size BETWEEN 11 AND 30 AND l_quantity BETWEEN 10 AND 30) OR (p_size > 40 AND l_discount > 0.05)""",
    "waiting_orders": """SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey JOIN orders ON o_orderkey = a.l_orderkey WHERE o_orderstatus = 'F'
        AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R') GROUP BY s_name""",
    "idle_customers": """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') GROUP BY c_nationkey""",
    "market_share": """SELECT year(o_orderdate) AS o_year, round(sum(CASE WHEN n.n_name = 'BRAZIL' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation n ON s_nationkey = n.n_nationkey GROUP BY year(o_orderdate)""",
    "product_profit": """SELECT n_name AS nation, year(o_orderdate) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - 10 * l_quantity), 4) AS profit FROM part JOIN lineitem ON p_partkey = l_partkey
        JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%a%' GROUP BY n_name, year(o_orderdate)""",
    "year_over_year": """WITH m AS (SELECT year(o_orderdate) AS y, c_mktsegment AS seg, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
        SELECT y, seg, total, round(total - lag(total) OVER (PARTITION BY seg ORDER BY y), 2) AS change, rank() OVER (PARTITION BY y ORDER BY total DESC) AS place FROM m""",
    "cohort_retention": """WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS y0 FROM orders GROUP BY o_custkey)
        SELECT y0, year(o_orderdate) - y0 AS age, count(DISTINCT o.o_custkey) AS customers FROM orders o JOIN f ON o.o_custkey = f.o_custkey GROUP BY y0, year(o_orderdate) - y0""",
    "event_funnel": """WITH u AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN ts END) AS v, min(CASE WHEN event_type = 'click' THEN ts END) AS c, min(CASE WHEN event_type = 'purchase' THEN ts END) AS p FROM events GROUP BY user_id)
        SELECT count(*) AS users, count(v) AS viewed, count(CASE WHEN c > v THEN 1 END) AS clicked, count(CASE WHEN p > c AND c > v THEN 1 END) AS bought FROM u""",
    "lateral_column_alias": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, round(net * (1 + l_tax), 6) AS gross FROM lineitem",
    "group_by_sum_h2o": "SELECT l_returnflag, l_suppkey, round(sum(l_quantity), 2) AS v1, round(avg(l_extendedprice), 4) AS v3 FROM lineitem GROUP BY l_returnflag, l_suppkey",
    "top_two_per_group_h2o": "SELECT l_suppkey, l_extendedprice AS largest FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS place FROM lineitem) x WHERE place <= 2",
    "group_by_two_keys_h2o": "SELECT l_returnflag, l_linestatus, l_suppkey, round(sum(l_extendedprice), 2) AS v1, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey",
    "group_by_many_h2o": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sum(l_extendedprice), 2) AS v3, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber",
    "median_and_deviation_h2o": "SELECT l_returnflag, l_suppkey, round(median(l_extendedprice), 4) AS med, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY l_returnflag, l_suppkey",
    "range_of_groups_h2o": "SELECT l_suppkey, max(l_quantity) - min(l_discount) AS span FROM lineitem GROUP BY l_suppkey",
    "correlation_by_group_h2o": "SELECT l_returnflag, l_suppkey, round(power(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem GROUP BY l_returnflag, l_suppkey",
    "join_small_h2o": "SELECT l_orderkey, l_linenumber, s_name, s_acctbal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "join_medium_h2o": "SELECT l_orderkey, l_linenumber, p_name, p_retailprice FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25",
    "join_large_h2o": "SELECT l_orderkey, l_linenumber, o_totalprice, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "important_suppliers": """SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2
        GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT 3 * avg(v) FROM (SELECT sum(l_extendedprice) AS v FROM lineitem GROUP BY l_partkey) x) / 10""",
    "least_cost_supplier": """WITH c AS (SELECT l_partkey, s_suppkey, s_acctbal, min(l_extendedprice / l_quantity) AS cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        WHERE n_regionkey = 3 GROUP BY l_partkey, s_suppkey, s_acctbal)
        SELECT l_partkey, s_suppkey, round(s_acctbal, 2) AS bal, round(cost, 6) AS cost FROM c WHERE cost = (SELECT min(d.cost) FROM c d WHERE d.l_partkey = c.l_partkey)""",
    "shipping_priorities_by_status": """SELECT o_orderstatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate GROUP BY o_orderstatus""",
    "potential_promotion": """SELECT s_name, s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name LIKE '%a%' GROUP BY l_suppkey
        HAVING sum(l_quantity) > (SELECT avg(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name LIKE '%a%' GROUP BY l_suppkey) x))""",
    "hits_by_hour": "SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS hits, count(DISTINCT user_id) AS users FROM events GROUP BY date_trunc('hour', ts), event_type",
    "busiest_users": "SELECT user_id, count(*) AS hits, round(avg(value), 4) AS mean, min(ts) AS first_seen FROM events GROUP BY user_id HAVING count(*) > 3",
    "long_texts": "SELECT source, count(*) AS n, round(avg(length(text)), 4) AS len, min(length(text)) AS shortest FROM documents WHERE text LIKE '% the %' GROUP BY source HAVING count(*) > 1",
    "users_seen_again": """SELECT count(*) AS users FROM (SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'
        EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 200) x""",
    "label_statistics": "SELECT lang, source, count(*) AS n, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang, source",
    "conversation_turns": "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS convs, max(length(text)) AS longest, round(avg(turn), 4) AS depth FROM conversations GROUP BY role",
    "page_hosts": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1",
}


def _register(name: str, text: str) -> None:
    tables = [n for n in NAMES if re.search(rf"(FROM|JOIN) {n}\b", text)]
    bound = re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", text)

    def run(spark, folder: str) -> DataFrame:
        return Tables(spark, folder).sql(bound, *tables)

    QUERIES[name], ORACLE[name] = run, text


for _name, _text in SQL.items():
    _register(_name, _text)
