"""Queries that write: files read back in other formats, and statements on tables of the library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.registry import Tables, query
from tarn.sources import files
from tarn.sources.tables import Database


def _folder(t: Tables, name: str) -> str:
    return files.scratch(t.spark, name)


CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(CUSTOMERS)
def csv_round_trip(t: Tables) -> DataFrame:
    path = _folder(t, "csv")
    files.copy_to(t.customer, path, "csv", header="true", sep=";", compression="gzip")
    return files.read_csv(t.spark, path, t.customer.schema, header=True, sep=";")


@query("SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN NULL ELSE p_name END AS p_name, p_brand || ',\"x\"' AS b FROM part")
def csv_sniffed(t: Tables) -> DataFrame:
    """The dialect and the types are found from the file; fields hold delimiters, quotes and a word for null."""
    path = _folder(t, "csv")
    own = t.part.selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS p_name", "p_brand || ',\"x\"' AS b")
    files.copy_to(own, path, "csv", header="true", sep="|", nullValue="NA", escape='"')
    out = files.read_csv(t.spark, path, nullValue="NA", escape='"')
    return out.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "b")


@query("SELECT CAST(count(*) FILTER (WHERE o_orderkey%10<>0) AS BIGINT) good, CAST(count(*) FILTER (WHERE o_orderkey%10=0) AS BIGINT) bad, CAST(sum(CASE WHEN o_orderkey%10<>0 THEN o_custkey ELSE 0 END) AS BIGINT) s FROM orders")
def csv_rejects(t: Tables) -> DataFrame:
    """A tenth of the lines hold a word where the schema has a number."""
    path = _folder(t, "csv")
    key = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("no. "), F.col("o_orderkey"))).otherwise(F.col("o_orderkey").cast("string"))
    files.copy_to(t.orders.select(key.alias("k"), "o_custkey"), path, "csv")
    schema = t.spark.createDataFrame([], "k long, o_custkey long").schema
    good, bad = files.read_csv_with_rejects(t.spark, path, schema)
    return good.agg(F.count("*").alias("good"), F.sum("o_custkey").alias("s")).crossJoin(bad.agg(F.count_if(F.length("rejected_line") > 0).alias("bad")))


@query("SELECT event_id, epoch_us(ts) us, user_id, event_type, value, props FROM events")
def json_round_trip(t: Tables) -> DataFrame:
    path = _folder(t, "json")
    own = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    files.copy_to(own, path, "json", compression="gzip")
    return files.read_json(t.spark, path).select("event_id", "us", "user_id", "event_type", "value", "props")


@query("SELECT CAST(count(*) AS BIGINT) n, CAST(sum(event_id) AS BIGINT) s FROM events")
def json_objects(t: Tables) -> DataFrame:
    path = _folder(t, "json")
    files.copy_to(t.events.select("event_id", "event_type"), path, "json")
    lines = files.read_json_objects(t.spark, path)
    return lines.agg(F.count("*").alias("n"), F.sum(F.get_json_object("json", "$.event_id").cast("long")).alias("s"))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def hive_partitions(t: Tables) -> DataFrame:
    """Written in folders by two columns; only the folder asked for is read."""
    path = _folder(t, "hive")
    files.copy_to(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), path, partition_by=["o_orderstatus", "o_orderpriority"])
    out = files.read_parquet(t.spark, path).where("o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
    return out.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("SELECT n_nationkey, n_name, NULL::INTEGER AS n_regionkey FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation WHERE n_regionkey >= 2")
def files_of_different_columns(t: Tables) -> DataFrame:
    path = _folder(t, "mixed")
    files.copy_to(t.nation.where("n_regionkey < 2").select("n_nationkey", "n_name"), f"{path}/one")
    files.copy_to(t.nation.where("n_regionkey >= 2").select("n_nationkey", "n_regionkey"), f"{path}/two")
    return files.read_parquet(t.spark, f"{path}/one", f"{path}/two", union_by_name=True).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_name || E'\\n' AS content, CAST(octet_length(encode(n_name)) + 1 AS BIGINT) AS size FROM nation")
def text_files(t: Tables) -> DataFrame:
    """A file for each row, found by a pattern and read whole."""
    path = _folder(t, "text")
    t.nation.select("n_nationkey", "n_name").repartition(25, "n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = files.glob(t.spark, f"{path}/*/*.txt")
    whole = files.read_text(t.spark, f"{path}/*/*.txt")
    inner = whole.withColumn("file", F.regexp_replace("filename", "^file:/*", "/")).join(found, "file", "left_semi")
    return inner.select("content", "size")


@query("SELECT path_in_schema, row_group_id, num_values, type FROM parquet_metadata('/root/testdata/sf0.01/nation.parquet')")
def parquet_footer(t: Tables) -> DataFrame:
    out = files.parquet_metadata(t.spark, t.path("nation"))
    return out.select("path_in_schema", "row_group_id", "num_values", "type")


@query("SELECT name, type FROM parquet_schema('/root/testdata/sf0.01/nation.parquet') WHERE type IS NOT NULL")
def parquet_columns(t: Tables) -> DataFrame:
    return files.parquet_schema(t.spark, t.path("nation")).select("name", "type")


@query("SELECT num_rows, num_row_groups FROM parquet_file_metadata('/root/testdata/sf0.01/nation.parquet')")
def parquet_files(t: Tables) -> DataFrame:
    return files.parquet_file_metadata(t.spark, t.path("nation")).select("num_rows", "num_row_groups")


@query("SELECT n_nationkey, file_row_number FROM read_parquet('/root/testdata/sf0.01/nation.parquet', file_row_number=true)")
def parquet_scan_with_file_columns(t: Tables) -> DataFrame:
    own = files.read_parquet(t.spark, t.path("nation"), filename=True, row_number=True)
    return own.where("filename IS NOT NULL").select("n_nationkey", "file_row_number")


def _database(t: Tables) -> Database:
    db = Database(t.spark, _folder(t, "tables"))
    db.create("accounts", t.customer.selectExpr("c_custkey AS k", "c_nationkey AS n", "c_acctbal AS b"))
    return db


@query("SELECT k, n, b FROM (SELECT c_custkey k, c_nationkey n, c_acctbal b FROM customer UNION ALL SELECT 1000000+s_suppkey, s_nationkey, NULL FROM supplier UNION ALL SELECT 2000000+s_suppkey, 1, s_acctbal FROM supplier)")
def inserts(t: Tables) -> DataFrame:
    """CREATE TABLE AS, INSERT BY NAME and INSERT by position."""
    db = _database(t)
    db.insert("accounts", t.supplier.selectExpr("s_nationkey AS n", "1000000 + s_suppkey AS k"), by_name=True)
    db.insert("accounts", t.supplier.selectExpr("2000000 + s_suppkey", "1", "s_acctbal"))
    return db.table("accounts")


@query("SELECT 1000000+s_suppkey AS k, s_nationkey AS n, s_acctbal AS b FROM supplier")
def insert_returning(t: Tables) -> DataFrame:
    return _database(t).insert("accounts", t.supplier.selectExpr("1000000 + s_suppkey", "s_nationkey", "s_acctbal"))


@query("SELECT c_custkey k, c_nationkey n, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey=1) THEN round(c_acctbal+10,2) ELSE round(c_acctbal,2) END b FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey=2) AND NOT (CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey=1) THEN c_acctbal+10 ELSE c_acctbal END < 0)")
def update_from_delete_using(t: Tables) -> DataFrame:
    db = _database(t)
    n = t.nation.select(F.col("n_nationkey").alias("n"), "n_regionkey")
    db.update_from("accounts", n.where("n_regionkey = 1"), ["n"], b=F.col("t.b") + 10)
    db.delete_using("accounts", n.where("n_regionkey = 2"), ["n"])
    db.delete("accounts", F.col("b") < 0)
    return db.table("accounts").select("k", "n", F.round("b", 2).alias("b"))


@query("SELECT c_custkey k, c_nationkey n, c_acctbal b FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, c_nationkey, -1.0 FROM customer")
def transactions(t: Tables) -> DataFrame:
    """What is rolled back is gone; what is committed is there all at once."""
    db = _database(t)
    db.begin()
    db.truncate("accounts")
    assert db.table("accounts").isEmpty()
    db.rollback()
    db.begin()
    db.delete("accounts", F.col("b") <= 0)
    db.insert("accounts", t.customer.selectExpr("c_custkey", "c_nationkey", "-1.0D"))
    assert Database(t.spark, db.root).table("accounts").count() == t.customer.count()  # others see nothing yet
    db.commit()
    return Database(t.spark, db.root).table("accounts")


@query("SELECT c_custkey AS key, c_nationkey::BIGINT AS n, 'new' AS tag FROM customer")
def alter_table(t: Tables) -> DataFrame:
    db = _database(t)
    db.add_column("accounts", "tag", "string", F.lit("new"))
    db.drop_column("accounts", "b")
    db.rename_column("accounts", "k", "key")
    db.set_type("accounts", "n", "bigint")
    db.rename("accounts", "customers")
    db.comment("customers", "altered")
    assert db.tables() == ["customers"] and db.comment("customers") == "altered"
    return db.table("customers")


@query("SELECT CASE WHEN s_suppkey%2=0 THEN s_suppkey ELSE 100000+s_suppkey END AS k, s_acctbal AS b FROM supplier WHERE s_suppkey%2=1 UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey%2=0 THEN -1.0 ELSE s_acctbal END FROM supplier")
def upserts(t: Tables) -> DataFrame:
    db = Database(t.spark, _folder(t, "tables"))
    db.create("s", t.supplier.selectExpr("s_suppkey AS k", "s_acctbal AS b"))
    new = t.supplier.selectExpr("CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 100000 + s_suppkey END AS k", "s_acctbal AS b")
    db.upsert("s", new, ["k"], {"b": F.lit(-1.0)})
    db.upsert("s", new.select("k", F.lit(0.0).alias("b")), ["k"])  # DO NOTHING
    return db.table("s")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def copy_from(t: Tables) -> DataFrame:
    path = _folder(t, "csv")
    files.copy_to(t.nation, path, "csv")
    db = Database(t.spark, _folder(t, "tables"))
    db.create("nation", t.nation.schema)
    assert db.copy_from("nation", path, "csv") == t.nation.count()
    return db.table("nation")


@query("SELECT 10 + 3 * (row_number() OVER (ORDER BY n_name) - 1) AS id, n_name FROM nation UNION ALL SELECT 10 + 3 * (24 + row_number() OVER (ORDER BY r_name)), r_name FROM region")
def sequences(t: Tables) -> DataFrame:
    """Rows of two inserts numbered by one sequence."""
    db = Database(t.spark, _folder(t, "tables"))
    db.create_sequence("ids", 10, 3)
    one = db.numbered("ids", t.nation.select("n_name"), ["n_name"])
    two = db.numbered("ids", t.region.select(F.col("r_name").alias("n_name")), ["n_name"])
    assert db.currval("ids") == 10 + 3 * 29
    return one.unionByName(two)


@query("SELECT c_nationkey, count(*) n FROM customer GROUP BY 1")
def views_and_export(t: Tables) -> DataFrame:
    """A view over an exported and imported table."""
    folder = _folder(t, "export")
    files.export_database(t.spark, {"customer": t.customer}, folder)
    db = Database(t.spark, _folder(t, "tables"))
    for name, df in files.import_database(t.spark, folder).items():
        db.create(name, df)
    db.create_view("per_nation", db.table("customer").groupBy("c_nationkey").agg(F.count("*").alias("n")))
    return db.table("per_nation")


@query("SELECT CAST(count(*) AS BIGINT) n, CAST(sum(n_nationkey) AS BIGINT) s FROM nation")
def incremental_fetch(t: Tables) -> DataFrame:
    """The result is pulled in pieces of seven rows."""
    pieces = list(files.fetch(t.nation.select("n_nationkey"), 7))
    assert all(len(p) == 7 for p in pieces[:-1])
    return t.spark.createDataFrame([(sum(map(len, pieces)), sum(r[0] for p in pieces for r in p))], "n long, s long")


@query("SELECT r_regionkey, r_name FROM region")
def format_of_ones_own(t: Tables) -> DataFrame:
    """A copy function that writes a row a line, with a tab between fields."""
    from tarn.sources import formats

    def write(rows, columns):
        for r in rows:
            yield ("\t".join(map(str, r)) + "\n").encode()

    def read(stream, schema):
        kinds = [int if f.dataType.typeName() in ("integer", "long") else str for f in schema.fields]
        for line in stream.read().decode().splitlines():
            yield tuple(k(v) for k, v in zip(kinds, line.split("\t"), strict=True))

    formats.register(t.spark, "tabbed", write, read)
    path = _folder(t, "tabbed")
    t.region.write.format("tabbed").mode("append").save(path)
    return t.spark.read.format("tabbed").schema(t.region.schema).load(path)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT count(*) // 100 FROM customer)")
def limit_by_subquery(t: Tables) -> DataFrame:
    from tarn.operators import relational

    rows = t.customer.agg((F.floor(F.count("*") / 100)).alias("n"))
    return relational.limit_by(t.orders, rows, [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey")


@query("SELECT CAST(count(*) AS BIGINT) n FROM (SELECT o_orderkey FROM orders LIMIT 100)")
def unordered_limit(t: Tables) -> DataFrame:
    """Tasks stop early; which rows come is not defined, how many is."""
    return t.orders.select("o_orderkey").limit(100).agg(F.count("*").alias("n"))
