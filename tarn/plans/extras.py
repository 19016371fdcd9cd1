"""Queries on macros, user functions, collations, unions, series, catalogues and nested data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import collections as lists
from tarn.functions import json, user
from tarn.plans.registry import Tables, query
from tarn.sources import files


@query("SELECT c_custkey, round(c_acctbal * 1.1 + 5, 4) AS x FROM customer")
def scalar_macro(t: Tables) -> DataFrame:
    user.macro(t.spark, "tarn_raise", "x DOUBLE, share DOUBLE DEFAULT 1.1", "DOUBLE", "x * share + 5")
    return t.customer.select("c_custkey", F.expr("round(tarn_raise(c_acctbal), 4)").alias("x"))


@query("SELECT CAST(i AS BIGINT) AS i FROM range(3, 909) r(i)")
def table_macro(t: Tables) -> DataFrame:
    user.macro(t.spark, "tarn_span", "a BIGINT, b BIGINT", "i BIGINT", "SELECT i FROM (SELECT explode(sequence(a, b)) AS i) WHERE i < b", table=True)
    return t.spark.sql("SELECT * FROM tarn_span(3, 909)")


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total, CAST(max(p_size) AS BIGINT) AS most FROM part GROUP BY p_brand")
def user_aggregate(t: Tables) -> DataFrame:
    own = t.part.select("p_brand", F.col("p_size").cast("long").alias("p_size"))
    return user.aggregate(
        own, ["p_brand"], ["p_size"], (0, -1), lambda s, x: (s[0] + x, max(s[1], x)), lambda a, b: (a[0] + b[0], max(a[1], b[1])), lambda s: s,
        "total long, most long",
    )


@query("SELECT p_partkey, length(p_name) * 2 AS d FROM part")
def user_scalar(t: Tables) -> DataFrame:
    from pyspark.sql.types import LongType

    double = user.scalar(lambda s: s.str.len() * 2, LongType())
    return t.part.select("p_partkey", double("p_name").alias("d"))


@query("SELECT c_mktsegment COLLATE NOCASE = 'building' AS same, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def collation(t: Tables) -> DataFrame:
    same = (F.collate("c_mktsegment", "UTF8_LCASE") == F.lit("building")).alias("same")
    return t.customer.groupBy(same).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey%2=0 THEN 'num' ELSE 'str' END AS tag, CASE WHEN s_suppkey%2=0 THEN s_nationkey END AS num FROM supplier")
def tagged_union(t: Tables) -> DataFrame:
    members = {"num": "int", "str": "string"}
    u = F.when(F.col("s_suppkey") % 2 == 0, lists.union_value("num", F.col("s_nationkey"), members)).otherwise(
        lists.union_value("str", F.col("s_name"), members)
    )
    own = t.supplier.withColumn("u", u)
    return own.select("s_suppkey", F.col("u.tag").alias("tag"), lists.union_extract(F.col("u"), "num").alias("num"))


@query("SELECT vec_id, round(v[1],4) AS x, round(v[2],4) AS y, round(v[3],4) AS z FROM (SELECT vec_id, array_cross_product(embedding[1:3]::DOUBLE[3], embedding[4:6]::DOUBLE[3]) v FROM embeddings)")
def vector_cross_product(t: Tables) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    own = t.embeddings.select("vec_id", lists.cross_product(F.slice(e, 1, 3), F.slice(e, 4, 3)).alias("v"))
    return own.select("vec_id", *(F.round(F.get("v", F.lit(i)), 4).alias(c) for i, c in enumerate("xyz")))


@query("SELECT n_regionkey, to_json(list(n_name ORDER BY n_name))::VARCHAR AS names FROM nation GROUP BY 1")
def json_aggregate(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(json.group_array(F.col("n_name"), F.col("n_name")).alias("names"))


@query("SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL '6 hours')) AS ts")
def time_series(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-03', INTERVAL '6' HOUR)) AS ts")


@query("SELECT CAST(i AS BIGINT) AS i, list_sum(range(0, i))::BIGINT AS s FROM range(1, 12) r(i)")
def list_ranges(t: Tables) -> DataFrame:
    own = t.spark.range(1, 12).withColumnRenamed("id", "i")
    return own.select("i", lists.total(lists.range_list(F.lit(0).cast("long"), F.col("i")), "long").alias("s"))


@query("SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS ordinal_position FROM information_schema.columns WHERE table_name IN ('region', 'nation')")
def information_schema(t: Tables) -> DataFrame:
    rows = files.information_schema({"region": t.region, "nation": t.nation})
    return t.spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position long, kind string").drop("kind")


@query("SELECT CAST(1000 + 5 * (row_number() OVER (ORDER BY n_name) - 1) AS BIGINT) AS id, n_name FROM nation")
def sequence_values(t: Tables) -> DataFrame:
    from tarn.operators.joins import with_position

    return with_position(t.nation.select("n_name"), ["n_name"], "p").select((1000 + 5 * (F.col("p") - 1)).alias("id"), "n_name")


@query("SELECT e.event_id, CAST(epoch_us(timezone('America/New_York', timezone('UTC', ts))) AS BIGINT) AS local FROM events e")
def time_zones(t: Tables) -> DataFrame:
    e = t.events
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))
    return e.select("event_id", F.unix_micros(local.cast("timestamp")).alias("local"))


@query("WITH RECURSIVE f(n, a, b) AS (SELECT 1, 0, 1 UNION ALL SELECT n+1, b, a+b FROM f WHERE n < 20) SELECT n, a FROM f")
def recursive_union_all(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE f(n, a, b) AS (SELECT 1, 0, 1 UNION ALL SELECT n+1, b, a+b FROM f WHERE n < 20) SELECT n, a FROM f")
