"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on the document id.

The files of one data set hold the documents in ascending id order, one file per range of
ids.  Each row keeps the number of its range and its position in it, so where a document's
ids start in the whole stream follows from one total per file.  Stripes are read in
parallel; a look-up of some ids skips stripes by their statistics and Bloom filters.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import id_type, shared_dir, small_batches, texts
from tarn.llm.tokenizer_files import id_bytes

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(32 << 20),
}


def write_token_ids(docs: DataFrame, out: str, path: str, end_id: int = 1) -> None:
    """Encode every whole text (null: empty), append ``end_id``, write ORC to ``out`` by ascending id.

    Null ids come first; rows with equal ids follow each other in the order of a hash of
    their texts, which also spreads a hot id over several files, and equal rows in the order
    of the input's partitions, which spreads those.
    """
    small_batches(docs.sparkSession)
    docs = texts(docs)
    ranged = (
        docs.withColumn("tie", F.xxhash64("text"))
        .withColumn("origin", F.spark_partition_id())
        .repartitionByRange("doc_id", "tie", "origin")
        .sortWithinPartitions("doc_id", "tie", "origin")
        .drop("tie", "origin")
    )
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_ids = id_bytes(path, False)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, counts = chunk_ids.ids(batch.column(1), end)
            ends = counts.cumsum()
            bounds = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(counts), part, np.int32)),
                    pa.array(at + ends - counts),
                    pa.array(counts),
                    pa.ListArray.from_arrays(bounds, pa.array(flat)),
                ],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            at += int(ends[-1])

    schema = f"doc_id {id_type(docs)}, part int, part_start long, n_tokens long, ids array<int>"
    ranged.mapInArrow(run, schema).write.options(**ORC_OPTIONS).orc(out)


def read_token_ids(spark: SparkSession, out: str, doc_id_type: str = "bigint") -> DataFrame:
    """The documents of a data set with their global start: doc_id, start, n_tokens, ids.

    The totals per file (one row of two numbers each) are summed in file order and broadcast:
    there are as many as the write had range partitions, whatever the documents.
    """
    schema = f"doc_id {doc_id_type}, part int, part_start long, n_tokens long, ids array<int>"
    rows = spark.read.schema(schema).orc(out)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("part").alias("base_part"), F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base")
    )
    return rows.join(F.broadcast(bases), rows["part"] == bases["base_part"]).select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def crc32_of_ids(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by ids_crc32, the unsigned CRC-32 of the little-endian 32-bit ids."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type(rows)}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 1, out: str | None = None) -> DataFrame:
    """Write ``docs`` to ``out`` (by default in the shared folder) and read the files back."""
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(docs, out, path, end_id)
    return read_token_ids(spark, out, id_type(texts(docs)))
