"""Queries on mathematics, text beyond ASCII, nested values, JSON and introspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import collections as lists
from tarn.functions import generic, inet, json, numbers, text
from tarn.operators import joins, relational
from tarn.plans.registry import Tables, query


@query("SELECT p_partkey, round(exp(x),9) ex, round(sqrt(p_size),9) sq, round(pi()*x,9) p, round(radians(p_size),9) ra, round(acos(x),9) ac, round(asin(x),9) a, round(atan(x),9) an, round(cot(p_size),6) ct, ~p_size nb, p_size >> 1 rs, isnan(n) nn, isinf(n) ni, isfinite(n) nf, least(p_size,20,nullif(p_partkey%7,0)) le, greatest(p_size,20,nullif(p_partkey%7,0)) gr, signbit(-x) sb, round(nextafter(x, 1.0::DOUBLE),9) na FROM (SELECT *, (p_size-25)/50.0::DOUBLE x, CASE p_partkey%4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE p_size END n FROM part)")
def numbers_more(t: Tables) -> DataFrame:
    own = t.part.withColumn("x", (F.col("p_size") - 25) / F.lit(50.0)).withColumn(
        "n", F.expr("CASE p_partkey % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') ELSE p_size END")
    )
    x, n, s = F.col("x"), F.col("n"), F.col("p_size")
    some = F.expr("nullif(p_partkey % 7, 0)")
    r = lambda c, k, name: F.round(c, k).alias(name)
    return own.select(
        "p_partkey", r(F.exp(x), 9, "ex"), r(F.sqrt(s), 9, "sq"), r(F.pi() * x, 9, "p"), r(F.radians(s), 9, "ra"), r(F.acos(x), 9, "ac"), r(F.asin(x), 9, "a"),
        r(F.atan(x), 9, "an"), r(F.cot(s), 6, "ct"), numbers.bitwise_not(s).alias("nb"), F.shiftright(s, 1).alias("rs"), F.isnan(n).alias("nn"),
        numbers.isinf(n).alias("ni"), numbers.isfinite(n).alias("nf"), generic.least(s.cast("long"), F.lit(20), some).alias("le"),
        generic.greatest(s.cast("long"), F.lit(20), some).alias("gr"), numbers.signbit(-x).alias("sb"), r(numbers.nextafter(x, F.lit(1.0)), 9, "na"),
    )


@query("SELECT p_partkey, fdiv(p_retailprice, 7) d, round(fmod(p_retailprice, 7),6) m, p_partkey // -7 i, p_size / nullif(p_size%5,0) z, p_size % nullif(p_size%5,0) zm FROM part")
def divisions(t: Tables) -> DataFrame:
    r = F.col("p_retailprice")
    return t.part.select(
        "p_partkey", numbers.fdiv(r, F.lit(7)).cast("double").alias("d"), F.round(numbers.fmod(r, F.lit(7)), 6).alias("m"), F.expr("p_partkey div -7").alias("i"),
        F.expr("try_divide(p_size, p_size % 5)").alias("z"), F.expr("try_mod(p_size, p_size % 5)").alias("zm"),
    )


WORDS = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Motörhead' WHEN 2 THEN '🦆 duck' WHEN 3 THEN '' WHEN 4 THEN E'two\\nlines' ELSE p_name END s, p_size FROM part"


def _words(t: Tables) -> DataFrame:
    s = (
        F.when(F.col("p_partkey") % 6 == 1, "Motörhead").when(F.col("p_partkey") % 6 == 2, "🦆 duck").when(F.col("p_partkey") % 6 == 3, "")
        .when(F.col("p_partkey") % 6 == 4, "two\nlines").when(F.col("p_partkey") % 6 == 5, F.col("p_name"))
    )
    return t.part.select("p_partkey", s.alias("s"), "p_size")


@query(f"SELECT p_partkey, length(s) n, length_grapheme(s) g, strlen(s) b, upper(s) u, unicode(s) un, ord(s) o, chr(120000+p_size) c, reverse(s) r, left(s,2) l, regexp_full_match(s,'two') fm, s GLOB 'M*d' gl, s GLOB '[!M]*' gn, regexp_replace(s,'(o)(t?)','<\\1\\2>') rr, regexp_replace(s,'(\\w)o','\\1_','g') rg, array_to_string(regexp_extract_all(s,'[a-z]+'),'/') ra, substring_grapheme(s,2,3) sg FROM ({WORDS})")
def strings_beyond_ascii(t: Tables) -> DataFrame:
    s = F.col("s")
    long = lambda c, n: c.cast("long").alias(n)
    return _words(t).select(
        "p_partkey", long(F.length(s), "n"), text.length_grapheme(s).alias("g"), long(F.octet_length(s), "b"), F.upper(s).alias("u"), text.unicode(s).alias("un"),
        text.unicode(s).alias("o"), text.chr(120000 + F.col("p_size")).alias("c"), F.reverse(s).alias("r"), text.left(s, 2).alias("l"),
        text.regexp_full_match(s, "two").alias("fm"), text.glob(s, "M*d").alias("gl"), text.glob(s, "[!M]*").alias("gn"),
        text.regexp_replace_first(s, "(o)(t?)", "<\\1\\2>").alias("rr"), text.regexp_replace(s, "(\\w)o", "\\1_").alias("rg"),
        F.array_join(F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0)), "/").alias("ra"), text.substring_grapheme(2, 3)(s).alias("sg"),
    )


@query(f"SELECT p_partkey, formatReadableDecimalSize(p_partkey*1234567) f, to_base(p_partkey,16) h, to_base(p_partkey,36,6) z, bin(p_partkey) b, hex(s) x, bar(p_size,0,50,10) ba, md5_number_lower(s)::VARCHAR ml, printf('%d-%s-%8.3f', p_partkey, s, p_size/3.0) pf, format('{{}}|{{:>6}}', s, p_size) fo, trim(s,'Md') tr, ltrim(s,'Mo') lt, rtrim(s,'dk') rt FROM ({WORDS}) WHERE s IS NOT NULL AND p_size IS NOT NULL")
def strings_formats(t: Tables) -> DataFrame:
    k, s, n = F.col("p_partkey"), F.col("s"), F.col("p_size")
    own = _words(t).where("s IS NOT NULL AND p_size IS NOT NULL")
    return own.select(
        "p_partkey", text.format_bytes(k * 1234567).alias("f"), text.to_base(k, 16).alias("h"), text.to_base(k, 36, 6).alias("z"), F.bin(k).alias("b"),
        F.hex(s).alias("x"), text.bar(n, 0, 50, 10).alias("ba"), text.md5_lower(s).cast("string").alias("ml"),
        F.format_string("%d-%s-%8.3f", k, s, n / 3.0).alias("pf"), text.format_braces("{}|{:6d}", s, n).alias("fo"), F.btrim(s, F.lit("Md")).alias("tr"),
        F.ltrim(s, F.lit("Mo")).alias("lt"), F.rtrim(s, F.lit("dk")).alias("rt"),
    )


@query("SELECT page_id, array_to_string(parse_path(url),'|') p, regexp_split_to_table(url, '[/.]') part FROM pages")
def strings_split_to_rows(t: Tables) -> DataFrame:
    own = t.pages.select("page_id", F.array_join(text.parse_path(F.col("url")), "|").alias("p"), "url")
    return text.regexp_split_to_table(own, "url", "[/.]").drop("url")


NESTED = "WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) ks, list(nullif(o_orderkey%3,0) ORDER BY o_orderkey) ns FROM orders GROUP BY 1)"


def _lists(t: Tables) -> DataFrame:
    from tarn.operators import aggregates as agg

    k = F.col("o_orderkey")
    return t.orders.groupBy("o_custkey").agg(agg.ordered_list(k, k).alias("ks"), agg.ordered_list(F.expr("nullif(o_orderkey % 3, 0)"), k).alias("ns"))


@query(NESTED + """ SELECT o_custkey, array_to_string(list_append(ks,7),',') ap, array_to_string(list_prepend(7,ks),',') pp, array_to_string(array_pop_back(ks),',') pb, array_to_string(array_pop_front(ks),',') pf, array_to_string(list_reverse(ks),',') rv, len(list_intersect(ks,[ks[1],-1])) it, list_has_all(ks,[ks[1],ks[-1]]) ha, array_to_string(generate_subscripts(ks,1),',') gs FROM l""".replace("array_to_string(generate_subscripts(ks,1),',')", "array_to_string(range(1,len(ks)+1),',')"))
def list_macros(t: Tables) -> DataFrame:
    k, seven = F.col("ks"), F.lit(7).cast("long")
    ends = F.array(lists.extract(k, 1), lists.extract(k, -1))
    joined = lambda c, n: F.array_join(c.cast("array<string>"), ",").alias(n)
    return _lists(t).select(
        "o_custkey", joined(lists.push_back(k, seven), "ap"), joined(lists.push_front(k, seven), "pp"), joined(lists.pop_back(k), "pb"), joined(lists.pop_front(k), "pf"),
        joined(F.reverse(k), "rv"), F.size(lists.intersect(k, F.array(lists.extract(k, 1), F.lit(-1).cast("long")))).cast("long").alias("it"),
        lists.has_all(k, ends).alias("ha"), joined(lists.subscripts(k), "gs"),
    )


@query(NESTED + """ SELECT o_custkey, array_to_string(ks[2:-2],',') sl, array_to_string(list_select(ks,[1,3]),',') se, array_to_string(list_where(ks,list_transform(ks,lambda x: x%2=0)),',') wh, list_sum([z[1] FOR z IN list_zip(ks,ns) IF z[2] IS NULL])::BIGINT z, list_count(ns) c, array_to_string([x+1 FOR x IN ks IF x%2=1],',') co, array_to_string(list_transform(ks, lambda x, i: x*i),',') ti FROM l""")
def list_slices_and_comprehensions(t: Tables) -> DataFrame:
    k, n = F.col("ks"), F.col("ns")
    joined = lambda c, name: F.array_join(c.cast("array<string>"), ",").alias(name)
    missing = F.filter(lists.zip_lists(k, n), lambda s: s["_2"].isNull())
    odd = F.transform(F.filter(k, lambda x: x % 2 == 1), lambda x: x + 1)
    return _lists(t).select(
        "o_custkey", joined(lists.slice_any(k, 2, -2), "sl"), joined(lists.select(k, F.array(F.lit(1), F.lit(3))), "se"),
        joined(lists.where(k, F.transform(k, lambda x: x % 2 == 0)), "wh"), lists.total(F.transform(missing, lambda s: s["_1"]), "long").alias("z"),
        F.size(F.array_compact(n)).cast("long").alias("c"), joined(odd, "co"), joined(F.transform(k, lambda x, i: x * (i + 1)), "ti"),
    )


@query("SELECT n_nationkey, s.a a, s.c c, r[1] r1, r[2] r2, m.key mk, m.value mv, v[2] v2, enum_range(NULL::ENUM('x','y','z'))[2] er, enum_first(NULL::ENUM('x','y','z')) ef, enum_last(NULL::ENUM('x','y','z')) el FROM (SELECT n_nationkey, struct_insert({'a': n_name}, c := n_regionkey) s, row(n_name, n_nationkey) r, unnest(map_entries(MAP {n_name: n_regionkey})) m, array_value(n_nationkey, n_regionkey) v FROM nation)")
def structs_rows_and_maps(t: Tables) -> DataFrame:
    kinds = lists.Enum("x", "y", "z")
    own = t.nation.select(
        "n_nationkey", lists.struct_insert(F.struct(F.col("n_name").alias("a")), ["a"], c=F.col("n_regionkey")).alias("s"),
        lists.row(F.col("n_name"), F.col("n_nationkey")).alias("r"), F.explode(lists.map_entries(F.create_map("n_name", "n_regionkey"))).alias("m"),
        lists.array_value(F.col("n_nationkey"), F.col("n_regionkey")).alias("v"),
    )
    return own.select(
        "n_nationkey", "s.a", "s.c", F.col("r._1").alias("r1"), F.col("r._2").alias("r2"), F.col("m.key").alias("mk"), F.col("m.value").alias("mv"),
        lists.extract(F.col("v"), 2).alias("v2"), F.lit(kinds.range()[1]).alias("er"), F.lit(kinds.first()).alias("ef"), F.lit(kinds.last()).alias("el"),
    )


@query("SELECT n_nationkey, unnest([n_name, n_nationkey::VARCHAR, NULL]) u, unnest([n_regionkey, n_regionkey+1]) v FROM nation")
def parallel_unnest(t: Tables) -> DataFrame:
    """Two lists side by side: the shorter one is padded with nulls."""
    a = F.array("n_name", F.col("n_nationkey").cast("string"), F.lit(None).cast("string"))
    b = F.array(F.col("n_regionkey"), F.col("n_regionkey") + 1)
    return t.nation.select("n_nationkey", F.explode(lists.zip_lists(a, b)).alias("z")).select("n_nationkey", F.col("z._1").alias("u"), F.col("z._2").alias("v"))


DOCS = """SELECT event_id, CASE event_id%5 WHEN 0 THEN NULL WHEN 1 THEN '{"a":[1,-2,3.5,null,"x"],"b":{"c":true}}' WHEN 2 THEN '[]' WHEN 3 THEN '{"a":{"d é":"ü"},"n":-7}' ELSE props END j FROM events"""


def _docs(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    j = (
        F.when(k == 1, '{"a":[1,-2,3.5,null,"x"],"b":{"c":true}}').when(k == 2, "[]").when(k == 3, '{"a":{"d é":"ü"},"n":-7}')
        .when(k == 4, F.col("props"))
    )
    return t.events.select("event_id", j.alias("j"))


@query(f"""SELECT event_id, (j->'$.a')::VARCHAR a, (j->'/a/1')::VARCHAR p, j->>'$.b.c' c, json_extract_string(j,'$.a."d é"') d, json_type(j) t, json_type(j,'$.a') ta, json_type(j,'$.a[2]') t2, json_type(j,'$.n') tn, (json_extract(j,['$.k','$.n'])[2])::VARCHAR l, json_structure(j)::VARCHAR s, CAST(json_array_length(j) AS BIGINT) n FROM ({DOCS})""")
def json_paths_and_structure(t: Tables) -> DataFrame:
    j = F.col("j")
    return _docs(t).select(
        "event_id", json.extract(j, "$.a").alias("a"), json.extract(j, "/a/1").alias("p"), json.extract_string(j, "$.b.c").alias("c"),
        json.extract_string(j, "$.a['d é']").alias("d"), json.type_of(j).alias("t"), json.type_of(j, "$.a").alias("ta"), json.type_of(j, "$.a[2]").alias("t2"),
        json.type_of(j, "$.n").alias("tn"), F.get(json.extract(j, "$.k", "$.n"), F.lit(1)).alias("l"), json.structure(j).alias("s"),
        F.when(j.isNotNull(), json.array_length(j)).alias("n"),
    )


@query("SELECT event_id, s.k k, s.z z FROM (SELECT event_id, json_transform(props, '{\"k\":\"BIGINT\",\"z\":\"VARCHAR\"}') s FROM events)")
def json_transform(t: Tables) -> DataFrame:
    own = t.events.select("event_id", json.transform(F.col("props"), "k BIGINT, z STRING").alias("s"))
    return own.select("event_id", "s.k", "s.z")


@query("SELECT c_custkey, json_array(c_nationkey, c_custkey)::VARCHAR a, json_object('n', c_name, 's', nullif(c_mktsegment,'BUILDING'))::VARCHAR o, json_quote(c_name)::VARCHAR q, row_to_json({'k': c_custkey, 's': c_mktsegment})::VARCHAR r, array_to_json([c_nationkey])::VARCHAR l FROM customer")
def json_builders(t: Tables) -> DataFrame:
    own = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    c = t.customer.select(
        "c_custkey", json.array(F.col("c_nationkey").cast("long"), F.col("c_custkey")).alias("a"),
        json.object_of(n=F.col("c_name"), s=F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).alias("o"), json.quote(F.col("c_name")).alias("q"),
        json.array(F.col("c_nationkey")).alias("l"),
    )
    return c.join(own.select(F.col("k").alias("c_custkey"), json.row_to_json(own).alias("r")), "c_custkey")


@query("SELECT n_regionkey, json_group_object(n_name, n_nationkey)::VARCHAR o FROM (SELECT * FROM nation ORDER BY n_name) GROUP BY 1")
def json_group_object(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(json.group_object(F.col("n_name"), F.col("n_nationkey")).alias("o"))


@query("SELECT event_type, json_group_structure(props::JSON)::VARCHAR s FROM events GROUP BY 1")
def json_group_structure(t: Tables) -> DataFrame:
    return json.group_structure(t.events, ["event_type"], "props", "s")


@query("SELECT c_custkey, 'INTEGER' AS t, 'DOUBLE' AS d, 'VARCHAR' AS s, 'c_name' AS a, hash(c_custkey) = hash(c_custkey) h FROM (SELECT c_custkey, typeof(c_nationkey) t, typeof(c_acctbal) d, typeof(c_name) s, alias(c_name) a FROM customer)")
def types_and_names(t: Tables) -> DataFrame:
    c, col = t.customer, F.col
    return c.select(
        "c_custkey", generic.typeof(c, col("c_nationkey")).alias("t"), generic.typeof(c, col("c_acctbal")).alias("d"), generic.typeof(c, col("c_name")).alias("s"),
        generic.alias(c, col("c_name")).alias("a"), (generic.hash64("c_custkey") == generic.hash64("c_custkey")).alias("h"),
    )


@query("SELECT count(*) n, count(*) FILTER (WHERE random() BETWEEN 0 AND 1) r, count(DISTINCT uuid()) u, min(length(uuid()::VARCHAR)) l, count(DISTINCT hash(p_partkey)) h FROM part")
def random_values(t: Tables) -> DataFrame:
    own = t.part.select(generic.random(7).alias("r"), generic.uuid().alias("u"), generic.hash64("p_partkey").alias("h"))
    return own.agg(
        F.count("*").alias("n"), F.count_if(F.col("r").between(0, 1)).alias("r"), F.countDistinct("u").alias("u"),
        F.min(F.length("u")).cast("long").alias("l"), F.countDistinct("h").alias("h"),
    )


@query("SELECT p_partkey, row_number() OVER (ORDER BY create_sort_key(b, 'ASC NULLS LAST', p_size, 'DESC NULLS FIRST', p_partkey, 'ASC NULLS LAST')) n FROM (SELECT *, nullif(p_brand,'Brand#1') b FROM part)")
def sort_keys(t: Tables) -> DataFrame:
    own = t.part.select("p_partkey", "p_size", F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("b"))
    key = generic.sort_key(own, ("b", "ASC NULLS LAST"), ("p_size", "DESC NULLS FIRST"), ("p_partkey", "ASC NULLS LAST"))
    return joins.with_position(own.select("p_partkey", key.alias("k")), ["k"], "n").select("p_partkey", "n")


@query("SELECT current_schema() s, len(current_schemas(true))::BIGINT > 0 l, in_search_path(current_database(), current_schema()) p, length(version()) > 1 v, current_setting('default_null_order') IS NOT NULL c FROM region")
def session_functions(t: Tables) -> DataFrame:
    spark, lit = t.spark, F.lit
    schema = generic.current_schema(spark)
    return t.region.select(
        lit(schema).alias("s"), lit(len(generic.current_schemas(spark)) > 0).alias("l"),
        lit(generic.in_search_path(spark, generic.current_database(spark), schema)).alias("p"), lit(len(generic.version(spark)) > 1).alias("v"),
        lit(generic.current_setting(spark, "spark.sql.session.timeZone") is not None).alias("c"),
    )


@query("SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM orders)")
def describe(t: Tables) -> DataFrame:
    return relational.describe(t.orders).drop("ordinal")


@query("SELECT CAST(cid AS INTEGER) cid, name, type FROM pragma_table_info('embeddings')")
def table_info(t: Tables) -> DataFrame:
    return generic.table_info(t.embeddings).select("cid", "name", "type")


@query("SELECT column_name, min, max, count AS n, CAST(null_percentage AS DOUBLE) AS nulls FROM (SUMMARIZE SELECT c_custkey, c_nationkey, nullif(c_mktsegment,'BUILDING') seg FROM customer)")
def summarize_columns(t: Tables) -> DataFrame:
    own = t.customer.select("c_custkey", "c_nationkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return relational.summarize(own).select("column_name", "min", "max", F.col("count").alias("n"), F.round("null_percentage", 2).alias("nulls"))


@query("SELECT c_custkey, c_acctbal > 0 IS TRUE a, (nullif(c_nationkey,3) = 5) IS UNKNOWN b, (nullif(c_nationkey,3) = 5) IS NOT TRUE c, (nullif(c_nationkey,3) = 5) IS FALSE d FROM customer".replace("c_acctbal > 0 IS TRUE", "(c_acctbal > 0) IS TRUE").replace("(nullif(c_nationkey,3) = 5) IS UNKNOWN", "(nullif(c_nationkey,3) = 5) IS NULL"))
def truth_tests(t: Tables) -> DataFrame:
    text = """SELECT c_custkey, (c_acctbal > 0) IS TRUE a, (nullif(c_nationkey, 3) = 5) IS UNKNOWN b, (nullif(c_nationkey, 3) = 5) IS NOT TRUE c,
        (nullif(c_nationkey, 3) = 5) IS FALSE d FROM {customer}"""
    return t.sql(text, "customer")


@query("FROM nation SELECT n_name, n_nationkey WHERE n_regionkey = 2")
def from_first(t: Tables) -> DataFrame:
    return t.sql("FROM {nation} |> WHERE n_regionkey = 2 |> SELECT n_name, n_nationkey", "nation")


@query("SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
def natural_join(t: Tables) -> DataFrame:
    a, b = t.nation.selectExpr("n_name", "n_regionkey AS k"), t.region.selectExpr("r_regionkey AS k", "r_name")
    return joins.natural_join(a, b).select("n_name", "r_name")


@query("SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) n FROM customer")
def single_join(t: Tables) -> DataFrame:
    names = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("n"))
    return joins.single_join(t.customer, names, ["c_nationkey"]).select("c_custkey", "n")


@query("SELECT k, v FROM (SELECT r_regionkey AS k, r_name AS v FROM region UNION ALL SELECT n_nationkey + 0.5, NULL FROM nation) ORDER BY 1".replace("r_regionkey AS k", "r_regionkey::DOUBLE AS k"))
def aligned_set_operation(t: Tables) -> DataFrame:
    return relational.aligned_union(t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v")), t.nation.selectExpr("n_nationkey + 0.5D", "NULL")).select(F.col("k").cast("double").alias("k"), "v")


@query("SELECT p_brand, p_size, n FROM (SELECT p_brand, p_size, count(*) n FROM part GROUP BY ALL ORDER BY ALL LIMIT 40)")
def order_by_all(t: Tables) -> DataFrame:
    return relational.order_by_all(t.part.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))).limit(40)


@query("SELECT 'x' AS a, 1 AS b FROM range(7)")
def repeated_rows(t: Tables) -> DataFrame:
    return relational.repeat_rows(t.spark, 7, a="x", b=1)


@query("SELECT CAST(i AS BIGINT) AS i, 'n' || i AS s FROM range(5) r(i)")
def local_relations(t: Tables) -> DataFrame:
    """An Arrow table, a pandas frame and a list of rows, all handed over by name."""
    import pandas as pd
    import pyarrow as pa

    from tarn.sources import files

    a, b, c = pa.table({"i": [0, 1], "s": ["n0", "n1"]}), pd.DataFrame({"i": [2, 3], "s": ["n2", "n3"]}), [{"i": 4, "s": "n4"}]
    return files.sql_over(t.spark, "SELECT * FROM {a} UNION ALL SELECT * FROM {b} UNION ALL SELECT * FROM {c}", a=a, b=b, c=c)


@query("SELECT c_custkey, c_name, unnest(range(0, c_custkey % 3)) AS i FROM customer".replace("unnest(range(0, c_custkey % 3))", "CAST(unnest(range(0, c_custkey % 3)) AS INTEGER)"))
def table_function_over_a_table(t: Tables) -> DataFrame:
    """A user's table function fed by each row of a table."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="i int")
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    own = t.customer.selectExpr("c_custkey", "c_name", "CAST(c_custkey % 3 AS INT) AS n")
    return own.lateralJoin(Count(F.col("n").outer())).select("c_custkey", "c_name", "i")


@query("SELECT s_suppkey, '10.0.' || s_nationkey || '.7' AS host, 4 AS family, '10.0.' || s_nationkey || '.255/24' AS last, '10.0.' || s_nationkey || '.9/24' AS later FROM supplier")
def inet_addresses(t: Tables) -> DataFrame:
    a = F.concat(F.lit("10.0."), F.col("s_nationkey"), F.lit(".7/24"))
    own = t.supplier.select("s_suppkey", a.alias("a"))
    return own.select("s_suppkey", inet.host("a").alias("host"), inet.family("a").alias("family"), inet.broadcast("a").alias("last"), inet.add("a", F.lit(2)).alias("later"))
