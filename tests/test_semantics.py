"""Nulls, odd values, errors and properties that the comparison with SQL does not show."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import dates, generic, inet, json, numbers, search, text
from tarn.operators import aggregates as agg
from tarn.operators import joins, relational
from tarn.plans import load
from tarn.sources import files
from tarn.sources.tables import Database

SF = "/root/testdata/sf0.001"


def values(df):
    return [tuple(r) for r in df.collect()]


def test_text_with_nulls_and_odd_patterns(spark):
    df = spark.createDataFrame([("en\n", "en"), ("banana", "bananb"), (None, "x"), ("a[1]", None)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = values(df.select(text.regexp_full_match(a, "en"), text.glob(a, "en"), text.regexp_replace_first(a, "(n)a", "<\\1>"), text.glob(a, "*[[]1]")))
    assert got == [(False, False, "en\n", False), (False, False, "ba<n>na", False), (None, None, None, None), (False, False, "a[1]", True)]
    assert values(df.where("a = 'banana' OR a IS NULL OR b IS NULL").select(text.hamming(a, b))) == [(1,), (None,), (None,)]
    with pytest.raises(Exception, match="equal length"):
        df.limit(1).select(text.hamming(a, b)).collect()
    assert values(df.select(text.unicode(F.lit("🦆")), text.chr(F.lit(129414)), text.unicode(F.lit(""))).limit(1)) == [(129414, "🦆", -1)]
    assert values(spark.range(1).select(text.regexp_replace(F.lit("a1b2"), "(\\d)", "$\\1"))) == [("a$1b$2",)]


def test_addresses(spark):
    df = spark.createDataFrame([("10.0.0.1/8", 2), (None, 2), ("10.0.0.1", None), ("::1", 1)], "a string, n int")
    assert values(df.select(inet.add("a", "n"), inet.family("a"))) == [("10.0.0.3/8", 4), (None, None), (None, 4), ("::2", 6)]
    bad = spark.createDataFrame([("no",), ("1.2.3.4",)], "a string")
    assert values(bad.select(inet.try_family("a"), inet.try_netmask("a"))) == [(None, None), (4, "255.255.255.255")]
    with pytest.raises(Exception, match="no"):
        bad.select(inet.family("a")).collect()


def test_numbers_and_dates_with_nulls(spark):
    df = spark.createDataFrame([(None,), (-0.0,), (float("nan"),), (float("-inf"),)], "x double")
    x = F.col("x")
    assert values(df.select(numbers.isinf(x), numbers.isfinite(x), numbers.signbit(x))) == [
        (None, None, None), (False, True, True), (False, False, False), (True, False, True)
    ]
    t = spark.sql("SELECT TIMESTAMP_NTZ '2024-02-29 00:00:00' a, TIMESTAMP_NTZ '2023-01-31 12:00:00' b, CAST(NULL AS TIMESTAMP_NTZ) n")
    row = t.select(dates.age(F.col("a"), F.col("b")).alias("p"), dates.age(F.col("b"), F.col("a")).alias("m"), dates.age(F.col("a"), F.col("n")).alias("n")).first()
    assert tuple(row.p) == (12, 28, 43_200_000_000) and tuple(row.m) == (-12, -28, -43_200_000_000) and row.n is None
    assert values(t.select(dates.plus(F.col("b"), dates.to_interval("months", F.lit(1))).cast("string"))) == [("2023-02-28 12:00:00",)]
    with pytest.raises(Exception, match="out of range"):
        t.select(dates.make_time(F.lit(25), F.lit(0), F.lit(0))).collect()


def test_json_of_any_kind(spark):
    df = spark.createDataFrame([('{"a":[1,{"b":null}]}',), ("3",), (None,)], "j string")
    j = F.col("j")
    assert values(df.select(json.extract(j, "$.a[1].b"), json.extract(j, "$.a[#-1]"), json.type_of(j), json.structure(j))) == [
        ("null", '{"b":null}', "OBJECT", '{"a":["JSON"]}'), (None, None, "UBIGINT", '"UBIGINT"'), (None, None, None, None)
    ]


def test_exclude_takes_a_null_current_value(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, None), (1, 3, 5)], "k int, o int, x int")
    for rows in (None, (-5, 5)):
        got = sorted(values(relational.excluding(df, "x", ["k"], ["o"], "current row", rows).select("o", "sum_x", "count_x")))
        assert got == [(1, 5, 1), (2, 15, 2), (3, 10, 1)]
    with pytest.raises(ValueError):
        relational.excluding(df, "x", ["k"], ["o"], "tie")


@pytest.mark.parametrize("what", ["current row", "group", "ties", "no others"])
@pytest.mark.parametrize("rows", [None, (-2, 1)])
def test_exclude_equals_brute_force(spark, what, rows):
    rng = np.random.default_rng(4)
    data = [(int(k), int(o), int(i), None if rng.random() < 0.2 else int(v)) for i, (k, o, v) in enumerate(rng.integers(0, [3, 4, 50], (60, 3)))]
    df = spark.createDataFrame(data, "k int, o int, i int, x int")
    order = ["o"] if rows is None else ["o", "i"]
    got = {r.i: (r.sum_x, r.count_x, r.min_x, r.max_x) for r in relational.excluding(df, "x", ["k"], order, what, rows).collect()}
    for k in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2]))
        for at, d in enumerate(own):
            frame = range(len(own)) if rows is None else range(max(0, at + rows[0]), min(len(own), at + rows[1] + 1))
            peer = (lambda e, d=d: e[1] == d[1]) if rows is None else (lambda e, d=d: e[1:3] == d[1:3])
            gone = {"current row": lambda e, d=d: e is d, "group": peer, "ties": lambda e, d=d, peer=peer: peer(e) and e is not d, "no others": lambda e: False}
            xs = [own[j][3] for j in frame if not gone[what](own[j]) and own[j][3] is not None]
            assert got[d[2]] == (sum(xs) if xs else None, len(xs), min(xs, default=None), max(xs, default=None))


def test_insert_or_update_with_odd_keys(spark):
    old = spark.createDataFrame([(1, 5), (None, 7)], "k int, v int")
    new = spark.createDataFrame([(1, 6), (None, 8), (2, 9)], "k int, v int")
    assert sorted(values(relational.insert_or(old, new, ["k"], {"v": F.col("new.v")})), key=str) == [(1, 6), (2, 9), (None, 7), (None, 8)]
    assert sorted(values(relational.insert_or(old, new, ["k"], None)), key=str) == [(1, 5), (2, 9), (None, 7), (None, 8)]
    with pytest.raises(Exception, match="same key"):
        relational.insert_or(old, new.union(new), ["k"], None).collect()


def test_overlaps_of_any_length(spark):
    rng = np.random.default_rng(6)
    starts = rng.integers(0, 1000, 80)
    rows = [(i, float(s), float(s + d)) for i, (s, d) in enumerate(zip(starts, rng.choice([0, 1, 7, 90, 10**9], 80)))]
    a, b = spark.createDataFrame(rows[:40], "i int, s double, e double"), spark.createDataFrame(rows[40:], "j int, t double, f double")
    for closed in (False, True):
        got = sorted((r.i, r.j) for r in joins.overlap_join(a, b, ("s", "e"), ("t", "f"), 4.0, closed).collect())
        meets = (lambda x, y: x[1] <= y[2] and y[1] <= x[2]) if closed else (lambda x, y: x[1] < y[2] and y[1] < x[2])
        assert got == sorted((x[0], y[0]) for x in rows[:40] for y in rows[40:] if meets(x, y))
    assert joins.overlap_join(a.limit(0), b, ("s", "e"), ("t", "f"), 4.0).collect() == []


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
def test_asof_in_buckets_equals_asof(spark, op):
    rng = np.random.default_rng(8)
    left = spark.createDataFrame([(int(k) if k else None, int(t), i) for i, (k, t) in enumerate(rng.integers(0, [3, 100], (60, 2)))] + [(1, None, 99)], "k int, t int, i int")
    right = spark.createDataFrame([(int(k), int(t)) for k, t in sorted({tuple(r) for r in rng.integers(1, [3, 100], (25, 2)).tolist()})], "k int, u int")
    for by in (["k"], []):
        own = right if by else right.select("u").distinct()
        for how in ("left", "inner", "semi", "anti"):
            one = joins.asof_join(left, own, "t", "u", by, how, op, ["u"])
            two = joins.asof_join(left, own, "t", "u", by, how, op, ["u"], width=7)
            assert sorted(values(one), key=str) == sorted(values(two), key=str)


def test_single_and_natural_joins(spark):
    one = spark.createDataFrame([(1,), (2,)], "k int")
    assert sorted(values(joins.single_join(one, spark.createDataFrame([(1, "a"), (3, "b"), (3, "c")], "k int, v string"), ["k"])), key=str) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="more than one row"):
        joins.single_join(one, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"]).collect()
    with pytest.raises(ValueError, match="common"):
        joins.natural_join(one, spark.createDataFrame([(1,)], "j int"))


def test_sums_and_frames(spark):
    df = spark.createDataFrame([("a", 1e16), ("a", 1.0), ("a", -1e16), ("b", None)], "k string, x double")
    assert sorted(values(agg.kahan_sum(df, ["k"], "x"))) == [("a", 1.0, 1 / 3), ("b", None, None)]
    assert values(agg.kahan_sum(df.where("k = 'a'"), [], "x")) == [(1.0, 1 / 3)]
    rows = spark.createDataFrame([(1, 1, 5, 1, 0), (1, 2, None, 0, 0), (1, 3, 7, None, 1), (1, 4, 2, -1, 2), (1, 5, 3, 9, 9)], "k int, o int, x int, b int, a int")
    got = values(relational.sums_between(rows, "x", ["k"], ["o"], F.col("b"), F.col("a")).orderBy("o").select("sum_x", "count_x"))
    assert got == [(5, 1), (None, 0), (None, None), (3, 1), (17, 4)]


def test_samples(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    keys = {r.o_orderkey for r in orders.select("o_orderkey").collect()}
    queries = load()[0]
    one = [r.o_orderkey for r in queries["reservoir_sample"](spark, SF).collect()]
    assert len(one) == 100 == len(set(one)) and set(one) <= keys
    assert one == [r.o_orderkey for r in queries["reservoir_sample"](spark, SF).collect()]
    share = queries["bernoulli_sample"](spark, SF).count() / len(keys)
    assert abs(share - 0.1) < 4 * math.sqrt(0.09 / len(keys))
    assert share == queries["bernoulli_sample"](spark, SF).count() / len(keys)


def test_approximations_are_near(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    exact = {r.l_returnflag: (r.n, r.q) for r in li.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n"), F.expr("percentile(l_extendedprice, array(0.45, 0.55))").alias("q")).collect()}
    for r in load()[0]["approximate_aggregates"](spark, SF).collect():
        n, (low, high) = exact[r.l_returnflag]
        assert abs(r.parts - n) < 0.2 * n and low <= r.middle <= high
    events = spark.read.parquet(f"{SF}/events.parquet")
    bounds = {r.event_type: r.q for r in events.groupBy("event_type").agg(F.expr("percentile(value, array(0.3, 0.7))").alias("q")).collect()}
    for size in (64, 8192):
        for r in agg.reservoir_quantile(events, ["event_type"], "value", 0.5, size).collect():
            assert bounds[r.event_type][0] <= r.quantile <= bounds[r.event_type][1]


def test_summaries(spark):
    nation = spark.read.parquet(f"{SF}/nation.parquet").withColumn("gone", F.lit(None).cast("double"))
    rows = {r.column_name: r for r in relational.summarize(nation).collect()}
    assert rows["n_nationkey"].min == "0" and rows["n_nationkey"].avg == 12.0 and rows["gone"].null_percentage == 100.0
    inet_rows = load()[0]["inet_functions"](spark, SF).collect()
    assert all(r.host == r.later.split("/")[0].replace(r.later.split("/")[0], r.host) and r.family == 4 and r["mask"] == "255.255.0.0/16" for r in inet_rows)


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "a cat, a dog"), (2, None), (3, ""), (4, "Dog dog")], "id int, t string")
    got = dict(values(search.match_bm25(docs, "dog", "id", "t")))
    assert set(got) == {1, 4} and got[4] > got[1]
    assert set(dict(values(search.match_bm25(docs, "dog cat", "id", "t", conjunctive=True)))) == {1}
    assert values(search.match_bm25(docs, "...", "id", "t")) == []


def test_csv_that_does_not_fit(spark, tmp_path):
    path = str(tmp_path / "late.csv")
    (tmp_path / "late.csv").write_text("n\n" + "\n".join(map(str, range(2000))) + "\nhello\n")
    df = files.read_csv(spark, path, sep=",", header=True)
    assert dict(df.dtypes)["n"] == "string" and df.where("n = 'hello'").count() == 1
    with pytest.raises(Exception, match="hello|MALFORMED|Malformed"):
        files.read_csv(spark, path, "n int", header=True).agg(F.sum("n")).collect()
    assert files.read_csv(spark, path, "n int", ignore_errors=True, header=True).count() == 2000
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,q\n")
    both = files.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], union_by_name=True, sep=",", header=True)
    assert sorted(values(both), key=str) == [(1, 2, None), (None, 3, "q")]
    (tmp_path / "bad.json").write_text('{"a":1}\nno\n')
    assert files.read_json(spark, str(tmp_path / "bad.json"), schema="a int", ignore_errors=True).where("a = 1").count() == 1
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_json(spark, str(tmp_path / "bad.json"), schema="a int").collect()


def test_database_errors_and_recovery(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    db.create("n", nation)
    for wrong in (lambda: db.create("n", nation), lambda: db.insert("n", nation.select("n_name")), lambda: db.insert("n", nation.withColumn("q", F.lit(1)), True), db.commit, db.rollback):
        with pytest.raises((ValueError, RuntimeError)):
            wrong()
    with pytest.raises(KeyError):
        db.table("absent")
    db.create("n", nation, if_not_exists=True)
    db.begin()
    with pytest.raises(RuntimeError):
        db.begin()
    db.truncate("n")
    db.commit()
    assert Database(spark, db.root).table("n").collect() == [] and db.vacuum() == 1
    db.drop("n")
    db.drop("n", if_exists=True)
    assert db.tables() == []
    db.create("e", nation.schema)
    assert db.table("e").collect() == []


def test_catalogue(spark):
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    nation.createOrReplaceTempView("tarn_seen")
    assert generic.tables(spark).where("table_name = 'tarn_seen' AND temporary").count() == 1
    spark.catalog.dropTempView("tarn_seen")
    assert generic.functions(spark).where("function_name = 'abs'").count() == 1
    assert generic.settings(spark).where("name = 'spark.sql.shuffle.partitions'").count() == 1
    with pytest.raises(ValueError):
        generic.current_setting(spark, "no.such.setting")
    assert relational.explain(nation.where("n_regionkey = 1")).where("plan LIKE '%PushedFilters%'").count() == 1
    assert generic.type_name("array<decimal(5,2)>") == "DECIMAL(5,2)[]"


def test_introspection(spark):
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    assert generic.stats(nation, "n_nationkey") == "[Min: 0, Max: 24][Has Null: false, Has No Null: true]"
    assert generic.keywords(spark).where("keyword_name = 'select'").count() == 1
    assert generic.calendar_names(spark).where("name = 'gregorian'").count() == 1
    nation.createOrReplaceTempView("tarn_words")
    found = [tuple(r) for r in generic.auto_complete(spark, "SELECT n_na").collect()]
    assert ("n_name", 7) in found and ("n_nationkey", 7) in found
    spark.catalog.dropTempView("tarn_words")
    assert "UnresolvedRelation" in generic.serialize_sql(spark, "SELECT a FROM b")
    with pytest.raises(Exception, match="PARSE|syntax"):
        generic.serialize_sql(spark, "SELEC a")
    assert "LogicalRelation" in generic.serialize_plan(nation) and generic.current_user(spark)


def test_sampling_methods(spark):
    rows = spark.range(0, 100_000, 1, 4)
    assert relational.sample_rows(rows, rows=70).count() == 70
    for method in ("bernoulli", "system"):
        n = relational.sample_rows(rows, percent=20, method=method, seed=2).count()
        assert 10_000 < n < 30_000 and n == relational.sample_rows(rows, percent=20, method=method, seed=2).count()
    assert relational.sample_rows(rows, percent=0, method="system").count() == 0
    for wrong in ({}, {"rows": 1, "percent": 1}, {"percent": 101}, {"percent": 1, "method": "x"}):
        with pytest.raises(ValueError):
            relational.sample_rows(rows, **wrong)
    one = spark.range(5)
    assert relational.limit_by(one, spark.range(1).selectExpr("2 AS n"), ["id"]).count() == 2
    assert relational.limit_by(one, spark.range(1).selectExpr("CAST(NULL AS INT) AS n"), ["id"]).count() == 5
    with pytest.raises(ValueError, match="more than one row"):
        relational.limit_by(one, spark.range(2), ["id"])


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        spark.sql("SELECT CAST(9223372036854775807 AS BIGINT) + id FROM range(1, 2)").collect()
    assert values(spark.sql("SELECT try_add(9223372036854775807L, 1L), try_cast('x' AS INT)")) == [(None, None)]


def test_shape_of_plans(spark):
    """Scans and shuffles of operators that have to hold at a large scale."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = search.match_bm25(docs, "the thing", "doc_id", "text")
    assert plan(found).count("Relation [") == 2 and "Generate" not in plan(found)
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 0
    events = spark.read.parquet(f"{SF}/events.parquet")
    low, high = events.select(F.col("event_id").alias("a"), F.col("ts").alias("x")), events.select(F.col("ts").alias("y"))
    spread = joins.asof_join(low, high, "x", "y", width=3600.0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in spread


@pytest.mark.parametrize("merged", ["true", "false"])
def test_positions_and_running_sums_over_many_range_partitions(spark, merged):
    # So many rows that the bounds of the partitions are drawn from a sample; columns that only one reader needs.
    rows, option = 120_000, "spark.sql.adaptive.coalescePartitions.enabled"
    df = spark.range(0, rows, 1, 6).selectExpr("id * 7919 % 120000 AS k", "id AS v", "uuid() AS pad")
    right = (F.col("n") == F.col("k") + 1) & (F.col("s") == (F.col("k") * (F.col("k") + 1) / 2).cast("long"))
    spark.conf.set(option, merged)
    try:
        both = joins.with_position(joins.running_sum(df, "k", ["k"], "s"), ["k"], "n")
        assert values(both.agg(F.count("*"), F.count_if(right), F.countDistinct("pad"))) == [(rows, rows, rows)]
    finally:
        spark.conf.unset(option)


def test_running_window_with_nulls_and_ties(spark, tmp_path):
    import duckdb

    queries, oracle = load()
    name = "running_window_without_partitions"
    own = "o_orderkey long, o_totalprice double, o_orderdate timestamp"
    rows = [(1, None, "2020-01-01"), (2, 1.5, "2020-01-02"), (2, 2.5, "2020-01-02"), (None, 4.0, "2020-01-02"), (3, 8.0, None), (4, None, "2020-01-03")]
    df = spark.createDataFrame(rows, own.replace("timestamp", "string")).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(oracle[name]).fetchall()
    assert sorted(values(queries[name](spark, str(tmp_path))), key=str) == sorted(want, key=str)
