"""Shared plumbing of the training-data operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker: very long texts must not pile up.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; any other is an error, as
    executors do not see each other's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarn-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders that ``materialize`` has made and nothing has deleted, oldest first.
MADE: list[str] = []


def materialize(df: DataFrame, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    The files stay until ``drop_materialized`` or ``drop_made``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.format(fmt).options(**options).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` once nothing reads them any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            _delete(spark, folder)
            name = folder.rsplit("/", 1)[-1]
            MADE[:] = [m for m in MADE if m.rsplit("/", 1)[-1] != name]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_made(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete all folders that ``materialize`` has made, after the first ``since`` of them, but for that of ``keep``.

    To be called once the results that read them are written.
    """
    kept = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if keep is not None else set()
    gone = [m for m in MADE[since:] if m.rsplit("/", 1)[-1] not in kept]
    for folder in gone:
        _delete(spark, folder)
    MADE[:] = [m for m in MADE if m not in gone]


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished queries that nothing refers to any more.

    It does so when the driver's garbage is collected, which else may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that other columns can neither clash nor be carried along."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def whole_row(docs: DataFrame) -> Column:
    """All columns, of any names, as one struct."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def other_columns_hash(docs: DataFrame) -> Column:
    """A hash of the columns besides doc_id and text, which tells rows apart that are equal in those."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)


def one_of_each_id(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of one row for each doc_id, that of the least ``text_hash``, so that a sample of ids bounds the rows."""
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*columns), "text_hash").alias("row")).select("row.*")


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()
