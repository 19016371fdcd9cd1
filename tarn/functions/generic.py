"""Introspection, session state, random values and order-preserving keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Type names of the dialect by Spark's.
TYPE_NAMES = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE",
    "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "binary": "BLOB", "void": "\"NULL\"",
}


def type_name(kind: DataType | str) -> str:
    """``typeof``: the dialect's name of a type."""
    kind = kind if isinstance(kind, str) else kind.simpleString()
    if kind.startswith("array<"):
        return type_name(kind[6:-1]) + "[]"
    if kind.startswith("decimal("):
        return kind.upper()
    return TYPE_NAMES.get(kind, kind.upper())


def typeof(df: DataFrame, column: Column) -> Column:
    return F.lit(type_name(df.select(column).schema.fields[0].dataType))


def alias(df: DataFrame, column: Column) -> Column:
    """The name of an expression."""
    return F.lit(df.select(column).columns[0])


def error(message: str) -> Column:
    return F.raise_error(F.lit(message))


def hash64(*columns: Column | str) -> Column:
    """``hash``: equal values hash equally; the numbers are Spark's own."""
    return F.xxhash64(*columns)


def least(*columns: Column) -> Column:
    """Nulls are left out."""
    return F.least(*columns)


def greatest(*columns: Column) -> Column:
    return F.greatest(*columns)


def random(seed: int | None = None) -> Column:
    """Uniform in [0, 1); with a seed (``setseed``) the same for the same rows in the same partitions."""
    return F.rand(seed) if seed is not None else F.rand()


def uuid() -> Column:
    return F.uuid()


def sort_key(df: DataFrame, *by: tuple[str, str]) -> Column:
    """Binary keys whose byte order is the order of (column, "ASC NULLS LAST") and the like.

    Numbers are integers up to 64 bits; text is compared by its UTF-8 bytes.
    """
    out = []
    for name, order in by:
        down, last = "DESC" in order.upper(), "LAST" in order.upper()
        kind = df.schema[name].dataType.typeName()
        if kind in ("byte", "short", "integer", "long"):
            flipped = F.col(name).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
            digits = F.lpad(F.hex(flipped), 16, "0")
        elif kind == "string":
            # A zero byte ends a text; those inside it and bytes of one are written as a one and themselves.
            raw = F.regexp_replace(F.hex(F.encode(F.col(name), "UTF-8")), "(0[01])(?=(?:..)*$)", "01$1")
            digits = F.concat(raw, F.lit("00"))
        else:
            raise ValueError(f"no sort key for {kind}")
        if down:
            digits = F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210")
        out.append(F.when(F.col(name).isNull(), "02" if last else "00").otherwise(F.concat(F.lit("01"), digits)))
    return F.unhex(F.concat(*out))


def current_schema(spark: SparkSession) -> str:
    """The dialect's name for the schema that queries start in is main."""
    name = spark.catalog.currentDatabase()
    return "main" if name == "default" else name


def current_schemas(spark: SparkSession, implicit: bool = False) -> list[str]:
    return [current_schema(spark), *(["system"] if implicit else [])]


def current_database(spark: SparkSession) -> str:
    return spark.catalog.currentCatalog()


def in_search_path(spark: SparkSession, database: str, schema: str) -> bool:
    return database == current_database(spark) and schema in current_schemas(spark, True)


def current_setting(spark: SparkSession, name: str) -> str:
    """A setting's value; an unknown one is an error."""
    value = spark.conf.get(name, None)
    if value is None:
        raise ValueError(f"unrecognized configuration parameter {name}")
    return value


def version(spark: SparkSession) -> str:
    return f"v{spark.version}"


def settings(spark: SparkSession) -> DataFrame:
    """(name, value) of the session's settings."""
    rows = [(r["key"], r["value"]) for r in spark.sql("SET").collect()]
    return spark.createDataFrame(rows, "name string, value string")


def functions(spark: SparkSession) -> DataFrame:
    """Names of all functions of the session."""
    return spark.sql("SHOW FUNCTIONS").withColumnRenamed("function", "function_name")


def tables(spark: SparkSession) -> DataFrame:
    """(schema_name, table_name, temporary) of the session's tables and views."""
    rows = [(".".join(t.namespace or []), t.name, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "schema_name string, table_name string, temporary boolean")


def table_info(df: DataFrame) -> DataFrame:
    """``pragma_table_info``: cid from 0, name, type, notnull."""
    rows = [(i, f.name, type_name(f.dataType), not f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "cid int, name string, type string, notnull boolean")


def identifier(text: str) -> str:
    """A name as SQL text: quoted unless it is plain."""
    return text if re.fullmatch("[A-Za-z_][A-Za-z_0-9]*", text) else "`" + text.replace("`", "``") + "`"


def current_user(spark: SparkSession) -> str:
    return spark.sparkContext.sparkUser()


def stats(df: DataFrame, column: str) -> str:
    """A column's least and greatest value and whether it holds nulls, as text."""
    x = F.col(f"`{column}`")
    r = df.agg(F.min(x), F.max(x), F.coalesce(F.max(x.isNull()), F.lit(False)), F.coalesce(F.max(x.isNotNull()), F.lit(False))).first()
    return f"[Min: {r[0]}, Max: {r[1]}][Has Null: {str(r[2]).lower()}, Has No Null: {str(r[3]).lower()}]"


def keywords(spark: SparkSession) -> DataFrame:
    """(keyword_name, reserved) of the SQL dialect that the session reads."""
    return spark.sql("SELECT lower(keyword) AS keyword_name, reserved FROM sql_keywords()")


def calendar_names(spark: SparkSession) -> DataFrame:
    """The calendars that the platform knows."""
    found = spark._jvm.java.time.chrono.Chronology.getAvailableChronologies()
    names = sorted({"gregorian" if c.getId() == "ISO" else str(c.getCalendarType() or c.getId()).lower() for c in found})
    return spark.createDataFrame([(n,) for n in names], "name string")


def auto_complete(spark: SparkSession, text: str, most: int = 50) -> DataFrame:
    """(suggestion, suggestion_start): tables, columns, keywords and functions that go on from the last word of ``text``."""
    word = re.search(r"[A-Za-z_0-9]*$", text)[0]
    known = [t.name for t in spark.catalog.listTables()]
    columns = [c.name for t in known for c in spark.catalog.listColumns(t)]
    names = [r.keyword_name.upper() for r in keywords(spark).collect()] + [r.function_name for r in functions(spark).collect()]
    found = [n for n in dict.fromkeys([*known, *columns, *names]) if n.lower().startswith(word.lower())][:most]
    return spark.createDataFrame([(n, len(text) - len(word)) for n in found], "suggestion string, suggestion_start int")


def serialize_sql(spark: SparkSession, text: str) -> str:
    """``json_serialize_sql``: the parsed statement as JSON; text that is no SQL is an error."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toJSON()


def serialize_plan(df: DataFrame, optimized: bool = True) -> str:
    """``json_serialize_plan``: the logical plan as JSON."""
    run = df._jdf.queryExecution()
    return (run.optimizedPlan() if optimized else run.analyzed()).toJSON()
