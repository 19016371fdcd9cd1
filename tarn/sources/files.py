"""Reading and writing files: formats, sniffing, rejected rows, partitions, footers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def sniff_csv(spark: SparkSession, path: str, lines: int = 1000) -> dict:
    """Delimiter, quote, header and schema of a CSV file from its first lines."""
    import csv

    sample = [r.value for r in spark.read.text(path).limit(lines).collect()]
    dialect = csv.Sniffer().sniff("\n".join(sample[:50]), delimiters=",;|\t")
    header = csv.Sniffer().has_header("\n".join(sample[:50]))
    quote = dialect.quotechar or '"'
    rows = spark.createDataFrame([(s,) for s in sample], "value string").select("value").rdd.map(lambda r: r.value)
    schema = spark.read.csv(rows, sep=dialect.delimiter, header=header, quote=quote, inferSchema=True).schema
    return {"delimiter": dialect.delimiter, "quote": quote, "header": header, "schema": schema}


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str | StructType | None = None, ignore_errors: bool = False,
    union_by_name: bool = False, filename: bool = False, all_varchar: bool = False, **options,
) -> DataFrame:
    """CSV files.

    Without a schema the dialect is found from the first lines and the types from all lines,
    so that a late value only widens its column.  A value that does not fit a given schema is
    an error; ``ignore_errors`` leaves such lines out.  With ``union_by_name`` files of
    different columns are put together, absent ones null.  ``nullValue`` and other options go
    to the reader.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if union_by_name and len(paths) > 1:
        parts = [read_csv(spark, p, schema, ignore_errors, False, filename, all_varchar, **options) for p in paths]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out
    if "sep" not in options and schema is None:
        found = sniff_csv(spark, paths[0])
        options = {"sep": found["delimiter"], "header": found["header"], "quote": found["quote"]} | options
    if schema is None:
        schema = spark.read.csv(paths, inferSchema=not all_varchar, **options).schema
    out = spark.read.csv(paths, schema=schema, mode="DROPMALFORMED" if ignore_errors else "FAILFAST", **options)
    out = out.where(_all_read(out.schema)) if ignore_errors else out
    return out.select("*", F.col("_metadata.file_path").alias("filename")) if filename else out


def _all_read(schema: StructType) -> Column:
    """Always true, of all columns: a line is then judged by all of its fields, whichever are asked for."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in schema.fieldNames())) >= F.lit(-(1 << 63))


def read_csv_with_rejects(spark: SparkSession, path: str, schema: StructType, **options) -> tuple[DataFrame, DataFrame]:
    """Good rows, and for rows that do not fit the schema their text and what was read of the first column."""
    whole = StructType([*schema.fields, StructField("rejected_line", StringType())])
    rows = spark.read.csv(path, schema=whole, mode="PERMISSIVE", columnNameOfCorruptRecord="rejected_line", **options)
    rows = rows.where(_all_read(schema))
    good = rows.where("rejected_line IS NULL").drop("rejected_line")
    first = F.col(f"`{schema.fieldNames()[0]}`")
    bad = rows.where("rejected_line IS NOT NULL").select("rejected_line", first.alias("first_value"))
    return good, bad


def read_json(spark: SparkSession, path: str | Sequence[str], array: bool = False, schema: str | None = None, ignore_errors: bool = False, **options) -> DataFrame:
    """Newline-delimited JSON, or one array per file; the structure is found from all of it.

    A record that is no JSON is an error; ``ignore_errors`` leaves it out.
    """
    mode = "DROPMALFORMED" if ignore_errors else "FAILFAST"
    return spark.read.json(path, schema=schema, multiLine=array, mode=mode, **options)


def read_json_objects(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Each line's JSON as text, in a column named json; lines that hold none are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("json"))
    return lines.where(F.col("json") != "")


def read_parquet(spark: SparkSession, *paths: str, union_by_name: bool = False, filename: bool = False, row_number: bool = False) -> DataFrame:
    out = spark.read.parquet(*paths, mergeSchema=union_by_name)
    extra: list[Column] = []
    if filename:
        extra.append(F.col("_metadata.file_path").alias("filename"))
    if row_number:
        extra.append(F.col("_metadata.row_index").alias("file_row_number"))
    return out.select("*", *extra)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: filename, content, size, last_modified."""
    return read_blob(spark, path).withColumn("content", F.decode("content", "UTF-8"))


def read_blob(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_text``, with the content as bytes."""
    out = spark.read.format("binaryFile").load(path)
    return out.select(
        F.col("path").alias("filename"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")
    )


def glob(spark: SparkSession, pattern: str) -> DataFrame:
    """The files that match, without reading them."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or []
    return spark.createDataFrame([(str(f.getPath().toUri().getPath()),) for f in found], "file string")


def _footers(spark: SparkSession, path: str, schema: str, rows_of) -> DataFrame:
    """Rows made of each file's Parquet footer, on the executors; only the footers are read.

    Where the store is one that the workers' file systems do not know, whole files are read instead.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if "content" in r:
                    meta = pq.ParquetFile(pa.BufferReader(r["content"])).metadata
                else:
                    files, name = fs.FileSystem.from_uri(r["path"].replace("file:/", "file:///", 1) if r["path"][:8] != "file:///" else r["path"])
                    with files.open_input_file(name) as f:
                        meta = pq.ParquetFile(f).metadata
                rows += rows_of(r["path"], meta)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    known = first is not None and first.path.split(":")[0] in ("file", "hdfs", "s3", "gs", "abfss")
    return files.select("path", *([] if known else ["content"])).mapInArrow(run, schema)


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per row group and column of every file."""

    def rows_of(name, meta):
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for c in range(group.num_columns):
                col = group.column(c)
                least, most, nulls = (None, None, None)
                if col.is_stats_set:
                    stats = col.statistics
                    nulls = stats.null_count if stats.has_null_count else None
                    least, most = (str(stats.min), str(stats.max)) if stats.has_min_max else (None, None)
                yield {
                    "file_name": name, "row_group_id": g, "row_group_num_rows": group.num_rows, "column_id": c,
                    "path_in_schema": col.path_in_schema, "type": col.physical_type, "compression": col.compression,
                    "num_values": col.num_values, "stats_min": least, "stats_max": most, "stats_null_count": nulls,
                    "total_compressed_size": col.total_compressed_size, "total_uncompressed_size": col.total_uncompressed_size,
                }

    return _footers(
        spark, path,
        "file_name string, row_group_id long, row_group_num_rows long, column_id long, path_in_schema string, type string, compression string,"
        " num_values long, stats_min string, stats_max string, stats_null_count long, total_compressed_size long, total_uncompressed_size long",
        rows_of,
    )


def parquet_file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per file."""

    def rows_of(name, meta):
        yield {
            "file_name": name, "created_by": meta.created_by, "num_rows": meta.num_rows, "num_row_groups": meta.num_row_groups,
            "format_version": meta.format_version,
        }

    return _footers(spark, path, "file_name string, created_by string, num_rows long, num_row_groups long, format_version string", rows_of)


def parquet_kv_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per key of every footer's own metadata."""

    def rows_of(name, meta):
        for k, v in (meta.metadata or {}).items():
            yield {"file_name": name, "key": k, "value": v}

    return _footers(spark, path, "file_name string, key binary, value binary", rows_of)


def parquet_schema(spark: SparkSession, path: str) -> DataFrame:
    """One row per leaf column of every file's schema."""

    def rows_of(name, meta):
        for i in range(meta.num_columns):
            col = meta.schema.column(i)
            logical = str(col.logical_type.type) if col.logical_type is not None else "NONE"
            yield {"file_name": name, "name": col.name, "path": col.path, "type": col.physical_type, "logical_type": logical, "max_definition": col.max_definition_level}

    return _footers(spark, path, "file_name string, name string, path string, type string, logical_type string, max_definition long", rows_of)


def copy_to(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), overwrite: bool = False, order_by: Sequence[Column | str] = (), **options) -> None:
    """COPY .. TO: partitioned folders, kept order within files, options of the format."""
    if partition_by:
        df = df.repartition(*partition_by)
    if order_by:
        df = df.sortWithinPartitions(*partition_by, *order_by)
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").options(**options).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def export_database(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet, with a list of them."""
    for name, df in tables.items():
        copy_to(df, f"{folder}/{name}.parquet", overwrite=True)
    listed = spark.createDataFrame([(n, df.schema.json()) for n, df in tables.items()], "name string, schema string")
    listed.coalesce(1).write.mode("overwrite").json(f"{folder}/tables.json")


def import_database(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    listed = spark.read.schema("name string, schema string").json(f"{folder}/tables.json").collect()
    return {r.name: spark.read.schema(StructType.fromJson(json.loads(r.schema))).parquet(f"{folder}/{r.name}.parquet") for r in listed}


def information_schema(tables: dict[str, DataFrame]) -> list[tuple[str, str, int, str]]:
    """(table, column, ordinal, type) of the given tables."""
    return [(n, c, i, k) for n, df in tables.items() for i, (c, k) in enumerate(df.dtypes, 1)]


def read_arrow(spark: SparkSession, data) -> DataFrame:
    """Rows of an Arrow table or batches, without going through Python rows."""
    import pyarrow as pa

    return spark.createDataFrame(data if isinstance(data, pa.Table) else pa.Table.from_batches(list(data)))


def sql_over(spark: SparkSession, text: str, **objects) -> DataFrame:
    """SQL in which ``{name}`` stands for a DataFrame, a pandas frame, an Arrow table or a list of rows handed over by name."""
    import pandas as pd
    import pyarrow as pa

    def frame(value) -> DataFrame:
        if isinstance(value, pa.Table):
            return read_arrow(spark, value)
        return value if isinstance(value, DataFrame) else spark.createDataFrame(value)

    kinds = (DataFrame, pd.DataFrame, pa.Table, list)
    return spark.sql(text, **{k: frame(v) if isinstance(v, kinds) else v for k, v in objects.items()})


def fetch(df: DataFrame, rows: int = 1000):
    """The result in lists of ``rows`` rows, as a consumer asks for them; at most two partitions are at the driver at once."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the place all executors share; a temporary one for a local master that has none."""
    import re
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tarn-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
