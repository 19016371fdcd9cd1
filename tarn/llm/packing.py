"""Sequence packing: first-fit decreasing on a tournament tree, in randomised groups.

Documents become pieces of at most ``length`` tokens (whole blocks, then the rest); the
pieces of one randomised group of documents are packed independently of other groups, so
no task ever holds more than a group, and a group holds about ``GROUP_DOCS`` documents
however many there are.  A document of very many blocks spreads over several groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import id_type, small_batches, texts
from tarn.llm.tokenizer_files import id_bytes

#: Documents in a group on average: enough for little padding, few enough for any worker.
GROUP_DOCS = 20_000
#: Blocks of one document that stay in one group.
GROUP_BLOCKS = 64


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``sizes`` must be in decreasing order.

    A tournament tree over the bins holds in each inner node the larger remaining capacity
    of its two children; walking down to the left child whenever it is large enough finds
    the first bin that fits in logarithmic time.
    """
    n = len(sizes)
    leaves = 1
    while leaves < n:
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left >= right else right
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def pieces(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Token pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, doc_crc.

    A null text counts as empty: its only token is the end id.
    """
    small_batches(docs.sparkSession)
    docs = texts(docs)
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_ids = id_bytes(path, True)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows: list[tuple] = []
            where: list[int] = []
            flat, counts = chunk_ids.ids(batch.column(1), end)
            ids = memoryview(flat).cast("B")
            at = 0
            for i, n in enumerate(counts.tolist()):
                doc = ids[4 * at : 4 * (at + n)]
                at += n
                crc = zlib.crc32(doc)
                for s in range(0, n, length):
                    own = doc[4 * s : 4 * (s + length)]
                    rows.append((s, len(own) // 4, zlib.crc32(own) if n > length else crc, n, crc))
                    where.append(i)
            cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(c) for c in cols)], names=names
            )

    schema = f"doc_id {id_type(docs)}, start long, length long, ids_crc32 long, doc_tokens long, doc_crc long"
    return docs.mapInArrow(run, schema)


def pack(
    docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, group_docs: int = GROUP_DOCS
) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.  Null and empty texts give a piece of the end id alone; rows with equal ids or
    null ids are packed like any others; an empty table gives no rows.
    """
    if length < 1:
        raise ValueError("length must be positive")
    groups = max(1, round(docs.count() / group_docs))
    block = GROUP_BLOCKS * length

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), length)
        return frame.drop(columns=["doc_crc", "pack_group"]).assign(
            sequence_id=(int(key[0]) << 32) + bins, offset=offsets
        )

    cut = pieces(docs, path, length, end_id)
    cut = cut.withColumn(
        "pack_group",
        # With the input's partition, so that a row that occurs very often is spread over groups.
        F.pmod(F.xxhash64("doc_id", "doc_crc", F.floor(F.col("start") / block), F.spark_partition_id()), F.lit(groups)),
    )
    schema = (
        f"doc_id {id_type(cut)}, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long"
    )
    return cut.groupBy("pack_group").applyInPandas(run, schema)
