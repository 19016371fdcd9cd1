"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint has three segments of 22, 21 and 21 bits.  If two fingerprints differ
in at most four bits, either some segment is equal in both, or some two segments differ by
one bit each.  The first kind meets on the segment's value.  For the second, each segment
is read as a word of the Golay code: one side is keyed by the codeword that its segment
decodes to (distance 3 at most), the other by all codewords within distance 4 (six at
most), which contain it whenever the segments differ by one bit.  Pairs of codeword indices
make keys of 24 bits.  What is left of the fingerprints differs in four bits at most in the
first case and in two in the second, so that of five (three) parts of it one is equal: its
value makes keys of 30 bits and more, by which a billion fingerprints stay apart.  Every
candidate is verified on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import golay
from tarn.llm.common import id_type, materialize, other_columns_hash, small_batches, texts, whole_row
from tarn.llm.components import connected_components
from tarn.llm.simhash import fingerprint

#: Low bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Bits that linked fingerprints may differ in; the keys below are complete up to this.
MAX_BITS = 4
#: Parts of the bits outside an equal segment, and outside two segments that differ by one bit each.
OUTSIDE_ONE, OUTSIDE_TWO = MAX_BITS + 1, MAX_BITS - 1
#: Fingerprints whose keys one task makes.
EXPANDED = 25_000


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, id_col: str = "doc_id") -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) of every whole text; no words: 0."""
    small_batches(docs.sparkSession)
    docs = texts(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words_per_shingle) for t in batch.column(1).to_pylist()]
            bits = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), bits], names=["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, fp long")


def segments(fps: np.ndarray) -> list[np.ndarray]:
    bits = fps.view(np.uint64)
    return [(bits >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]


def _keys(fps: DataFrame, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            at, keys = make(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[at])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def segment_keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint's three segment values."""
    parts = segments(own)
    keys = np.concatenate([p | np.int64(i << 48) for i, p in enumerate(parts)])
    return np.tile(np.arange(len(own)), len(parts)), keys


def parts_of(own: np.ndarray, without: tuple[int, ...], count: int) -> list[np.ndarray]:
    """The values of ``count`` about equal parts of the bits that lie in none of the segments ``without``."""
    rest, width = np.zeros(len(own), np.int64), 0
    for i, (segment, (_, size)) in enumerate(zip(segments(own), SEGMENTS, strict=True)):
        if i not in without:
            rest, width = rest << size | segment, width + size
    edges = [width * i // count for i in range(count + 1)]
    return [rest >> a & np.int64((1 << b - a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def equal_segment_keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment, its value with that of each part of the other bits."""
    keys = []
    for i, segment in enumerate(segments(own)):
        for j, part in enumerate(parts_of(own, (i,), OUTSIDE_ONE)):
            keys.append(segment | part << 22 | np.int64((OUTSIDE_ONE * i + j) << 48))
    return np.tile(np.arange(len(own)), len(keys)), np.concatenate(keys)


def codeword_keys(own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each two segments, every pair of codeword indices within ``radius`` of them, with each part of the third."""
    near = [golay.nearby(p, radius) for p in segments(own)]
    ats, keys = [], []
    for kind, (a, b) in enumerate(combinations(range(len(near)), 2)):
        first, second = near[a][:, :, None], near[b][:, None, :]
        at, i, j = np.nonzero((first >= 0) & (second >= 0))
        pair = first[at, i, 0] << 12 | second[at, 0, j]
        for n, part in enumerate(parts_of(own, (a, b), OUTSIDE_TWO)):
            ats.append(at)
            keys.append(pair | part[at] << 24 | np.int64((OUTSIDE_TWO * kind + n + 1 << 5) << 48))
    return np.concatenate(ats), np.concatenate(keys)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints within ``max_bits`` of each other.

    First every bucket's members are tried against its least member only.  What two members
    share such a neighbour is connected already, so that the bucket join, which tries all
    others, emits no pairs from inside a dense group around one fingerprint.

    Spark takes a table of keys for as small as the fingerprints it is made from, and would
    broadcast it; the joins on keys are sort-merge joins by name.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be between 0 and {MAX_BITS}")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    exact = _keys(fps, segment_keys)
    hubs = exact.groupBy("key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = exact.withColumnRenamed("fp", "u").join(hubs.hint("merge"), "key").where("u > v").where(near).select("u", "v")
    stars = materialize(stars.distinct(), "stars")
    hub = stars.groupBy("u").agg(F.min("v").alias("hub"))
    named = fps.join(hub, fps["fp"] == hub["u"], "left").select("fp", F.coalesce("hub", "fp").alias("hub"))
    named = materialize(named, "hubs")
    # Each row is about to make a hundred: as many tasks as there is work for.
    named = named.repartition(max(named.sparkSession.sparkContext.defaultParallelism, named.count() // EXPANDED))

    def side(keys: DataFrame, fp: str, hub: str) -> DataFrame:
        return keys.select("key", F.col("fp").alias(fp), F.col("hub").alias(hub))

    def with_hub(make) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, hubs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                for start in range(0, len(own), 2048):
                    at, keys = make(own[start : start + 2048])
                    at = at + start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(own[at]), pa.array(hubs[at])], names=["key", "fp", "hub"]
                    )

        return named.mapInArrow(run, "key long, fp long, hub long")

    def radius(r: int):
        return lambda own: codeword_keys(own, r)

    apart = F.col("hub_u") != F.col("hub_v")
    found = [stars]
    for index, probe in ((equal_segment_keys, equal_segment_keys), (radius(3), radius(4))):
        u, v = side(with_hub(probe), "u", "hub_u"), side(with_hub(index), "v", "hub_v")
        met = (u["key"] == v["key"]) & (F.col("u") > F.col("v")) & apart & near
        found.append(u.join(v.hint("merge"), met).select("u", "v"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``distinct`` (one row per fingerprint ``fp``) with the least fingerprint of its component as ``root``."""
    found = connected_components(links(distinct.select("fp"), max_bits))
    joined = distinct.join(found, distinct["fp"] == found["node"], "left")
    return joined.select(*(distinct[c] for c in distinct.columns), F.coalesce("root", "fp").alias("root"))


def near_duplicate_classes(docs: DataFrame, words_per_shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``.

    The component id is the least id in the row's connected component of linked
    fingerprints.  Null and blank texts have the fingerprint 0 and are linked like any
    other; rows with null ids take part but never name a component unless all ids in it are
    null; an empty table gives no rows.
    """
    own = materialize(fingerprints(docs, words_per_shingle), "fingerprints")
    rooted = materialize(roots(own.groupBy("fp").agg(F.min("doc_id").alias("least")), max_bits), "roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(names, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words_per_shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which one stays for each component: that of the least id.

    A null id counts as greater than any other; of rows with equal ids and texts one
    stays, that whose other columns have the least hash; an empty table stays empty.
    """
    base = docs.select(whole_row(docs).alias("row"), other_columns_hash(docs).alias("rest"), "doc_id", "text")
    base = base.withColumn("rk", F.xxhash64("doc_id", "text"))
    keyed = fingerprints(base.select(F.struct("doc_id", "rk").alias("id"), "text"), words_per_shingle, "id")
    keyed = keyed.select(F.struct(F.col("doc_id.doc_id").isNull(), "doc_id.doc_id", "doc_id.rk").alias("rank"), "fp")
    distinct = materialize(keyed.groupBy("fp").agg(F.min("rank").alias("rank")), "fingerprints")
    first = roots(distinct, max_bits).groupBy("root").agg(F.min("rank").alias("rank"))
    first = first.select(F.col("rank.rk").alias("rk"), F.col("rank.doc_id").alias("id"))
    met = (base["rk"] == first["rk"]) & base["doc_id"].eqNullSafe(first["id"])
    stay = base.join(first, met, "left_semi").groupBy("rk", "doc_id").agg(F.min_by("row", "rest").alias("row"))
    return stay.select("row.*")


def fingerprint_text(column: str = "fp") -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
