"""Texts of a Jaccard similarity of at least 4/5 on distinct word shingles, without loss.

First come operator 10's links: SimHash fingerprints of the shingle sets that differ in four
bits at most, by Golay keys.  Few pairs of that similarity are so near, and not all that are
so near are similar, so that these links are verified on the whole sets like all others, and
the rest is found by prefixes.

Shingles are ordered the same way everywhere: by hash, but common ones last.  Of two sets
as similar as that, the least shingle they share is among the first fifth (and one) of
both, so that equal keys from these prefixes meet every pair, and what comes after it is
enough to share: a pair that meets too far from the start of either is not similar, or meets
earlier too.  Parity sketches then drop
pairs that are certainly too different, and the others are verified on the whole sets.  The
order decides only how many other pairs meet, never which are found, so that a sample may
tell what is common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import near_duplicates
from tarn.llm.common import (
    MADE,
    drop_made,
    drop_materialized,
    drop_shuffles,
    id_type,
    materialize,
    other_columns_hash,
    small_batches,
    whole_row,
)
from tarn.llm.components import connected_components
from tarn.llm.simhash import majority, shingle_hashes

WORDS = 5
#: The least similarity, as a fraction.
ABOVE, BELOW = 4, 5
#: One of so many texts tells the common shingles: those in COMMON of them at least, or in one of SHARE of them.
SAMPLE, COMMON, SHARE = 16, 8, 5_000
#: Least bits of a sketch.
BITS = 1024


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes in increasing order; none for a text without words."""
    return np.unique(shingle_hashes(text, WORDS))


def name_of(own: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def sketch(own: np.ndarray) -> bytes:
    """The parity of the number of hashes in each of some classes, as many as hashes or more, a power of two.

    Sets differ in at least as many hashes as their sketches in bits.
    """
    size = max(BITS, 1 << len(own).bit_length())
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the larger folded to the size of the smaller."""
    one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(one), len(two))
    one, two = (np.bitwise_xor.reduce(s.reshape(-1, size), axis=0) for s in (one, two))
    return int(np.bitwise_count(one ^ two).sum())


def prefix(own: np.ndarray, common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which every set as similar has at least one among its own first.

    ``common`` are shingles that come last, in increasing order, and ``places`` their order.
    """
    at = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
    late = common[at] == own if len(common) else np.zeros(len(own), bool)
    order = np.concatenate([own[~late], own[late][np.argsort(places[at[late]], kind="stable")]]) if late.any() else own
    return order[: len(own) + (-ABOVE * len(own) // BELOW) + 1 if len(own) else 0]


def _named(base: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            made = [
                pa.array([name_of(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([sketch(s) for s in sets], pa.binary()),
                pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *made], names=["rk", "doc_id", "set", "n", "sketch", "fp"]
            )

    schema = f"rk long, doc_id {id_type(base)}, set long, n long, sketch binary, fp long"
    return base.select("rk", "doc_id", "text").mapInArrow(run, schema)


def _common(base: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample in increasing order, and their places by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], names=["key"])

    drawn = base.where(F.pmod(F.xxhash64("rk"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "key long")
    least = max(COMMON, rows // SAMPLE // SHARE)
    found = drawn.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).toPandas()
    keys, n = found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    places = np.empty(len(keys), np.int64)
    places[np.lexsort((keys, n))] = np.arange(len(keys))
    return keys, places


def _prefix_keys(base: DataFrame, common: np.ndarray, places: np.ndarray) -> DataFrame:
    """key, set and place of every shingle in a prefix; places count from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            own = [prefix(s, common, places) for s in sets]
            names = np.repeat(np.array([name_of(s) for s in sets], np.int64), [len(p) for p in own])
            keys = np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64)
            at = np.concatenate([np.empty(0, np.int64), *(np.arange(len(p)) for p in own)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(names), pa.array(at)], names=["key", "set", "place"]
            )

    return base.select("text").mapInArrow(run, "key long, set long, place int")


def _whole_sets(base: DataFrame, first: DataFrame) -> DataFrame:
    """set and its shingles, from one text for each row of ``first`` (rk, id)."""
    met = (base["rk"] == first["rk"]) & base["doc_id"].eqNullSafe(first["id"])
    one = base.join(first, met).groupBy(base["rk"], "doc_id").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            names = pa.array([name_of(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [names, pa.array([s.tobytes() for s in sets], pa.binary())], names=["set", "shingles"]
            )

    return one.select("text").mapInArrow(run, "set long, shingles binary")


def _perhaps(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``pairs`` (u, v) without those whose sizes or sketches show that too many shingles differ."""
    one = known.select(F.col("set").alias("u"), F.col("n").alias("n_u"), F.col("sketch").alias("x"))
    two = known.select(F.col("set").alias("v"), F.col("n").alias("n_v"), F.col("sketch").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            x, y = (batch.column(i).to_pylist() for i in (4, 5))
            bits = np.fromiter(map(differing, x, y), np.int64, len(n))
            apart = np.maximum(bits, np.abs(n - m))
            yield batch.select([0, 1]).filter(pa.array((ABOVE + BELOW) * apart <= (BELOW - ABOVE) * (n + m)))

    joined = pairs.join(one, "u").join(two, "v").select("u", "v", "n_u", "n_v", "x", "y")
    return joined.mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, base: DataFrame, known: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose whole sets are similar enough."""
    pairs = materialize(_perhaps(pairs, known), "pairs")
    either = pairs.select(F.col("u").alias("set")).unionByName(pairs.select(F.col("v").alias("set"))).distinct()
    wanted = materialize(known.join(either, "set").select("rank.rk", "rank.id"), "wanted")
    sets = materialize(_whole_sets(base, wanted), "shingle-sets")
    one = sets.select(F.col("set").alias("u"), F.col("shingles").alias("x"))
    two = sets.select(F.col("set").alias("v"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append((ABOVE + BELOW) * both >= ABOVE * (len(a) + len(b)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y")
    out = materialize(joined.mapInArrow(run, "u long, v long"), "similar-pairs")
    drop_materialized(sets)
    return out


def fingerprint_pairs(known: DataFrame) -> DataFrame:
    """Pairs (u, v) of the sets of ``known`` (set, fp) that connect all whose fingerprints operator 10 links.

    Each set is paired with the least one of its fingerprint, and of linked fingerprints the
    least ones with each other.
    """
    heads = materialize(known.groupBy("fp").agg(F.min("set").alias("head")), "heads")
    own = known.join(heads, "fp").select(F.col("set").alias("u"), F.col("head").alias("v")).where("u <> v")
    met = near_duplicates.links(heads.select("fp")).distinct()
    one = heads.select(F.col("fp").alias("u"), F.col("head").alias("one"))
    two = heads.select(F.col("fp").alias("v"), F.col("head").alias("two"))
    across = met.join(one, "u").join(two, "v").select(F.col("one").alias("u"), F.col("two").alias("v"))
    return own.unionByName(across)


def links(base: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """Links (u, v) that connect exactly the different sets of ``known`` (set, n, sketch, fp, rank) that are similar enough.

    First the pairs of linked fingerprints are tried, and every set against one other only, the one
    that is the hub of most of its buckets; what these connect is not tried again, so that a dense group makes no pairs of its
    members.  A bucket's hub is the member with the fewest shingles before the bucket's, as the
    middle of a group of variants has none of its own.
    """
    near = materialize(fingerprint_pairs(known.select("set", "fp")), "near-fingerprints")
    drop_shuffles(known.sparkSession)
    keys = _prefix_keys(base, *_common(base, rows)).repartition("key")
    rank = F.shiftleft(F.col("place").cast("long"), 40) + F.col("set").bitwiseAND(F.lit((1 << 40) - 1))
    hubs = keys.groupBy("key").agg(F.min_by("set", rank).alias("hub"), F.min("set").alias("least"), F.max("set").alias("last"))
    hubs = hubs.where("least < last").select("key", "hub")
    shared = materialize(keys.join(hubs, "key").distinct(), "shared-keys")
    tried = shared.where("set <> hub").groupBy("set", "hub").agg(F.count("*").alias("times"))
    tried = tried.groupBy("set").agg(F.max(F.struct("times", "hub")).alias("best"))
    first = tried.select(F.col("set").alias("u"), F.col("best.hub").alias("v")).unionByName(near)
    first = first.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars = _verified(first, base, known)
    groups = materialize(connected_components(stars), "groups")
    own = known.select("set", "n").join(groups, known["set"] == groups["node"], "left")
    own = own.select("set", "n", F.coalesce("root", "set").alias("root"))
    placed = materialize(shared.select("key", "set", "place").join(own, "set"), "placed")
    drop_materialized(shared)
    u = placed.select("key", *(F.col(c).alias(f"{c}_u") for c in ("set", "n", "root", "place")))
    v = placed.select("key", *(F.col(c).alias(f"{c}_v") for c in ("set", "n", "root", "place")))
    needed = ABOVE * (F.col("n_u") + F.col("n_v"))
    left = [(ABOVE + BELOW) * (F.col(f"n_{x}") - F.col(f"place_{x}")) >= needed for x in "uv"]
    apart = (F.col("root_u") != F.col("root_v")) & (F.col("set_u") > F.col("set_v"))
    sizes = (ABOVE * F.col("n_u") <= BELOW * F.col("n_v")) & (ABOVE * F.col("n_v") <= BELOW * F.col("n_u"))
    others = u.join(v, (u["key"] == v["key"]) & apart & sizes & left[0] & left[1])
    others = others.select(F.col("set_u").alias("u"), F.col("set_v").alias("v")).distinct()
    return stars.unionByName(_verified(others, base, known))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which one stays for each component of similar texts: that of the least id.

    Texts with the same shingles, also those without words, are similar.  A null id counts as
    greater than any other; of rows with equal ids and texts one
    stays, that whose other columns have the least hash; an empty table stays empty.
    """
    spark, before = docs.sparkSession, len(MADE)
    small_batches(spark)
    base = docs.select(whole_row(docs).alias("row"), other_columns_hash(docs).alias("rest"), "doc_id", "text")
    base = base.withColumn("rk", F.xxhash64("doc_id", "text"))
    named = materialize(_named(base), "named-sets")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rk"))
    least = named.groupBy("set").agg(F.min(rank).alias("rank"), *(F.first(c).alias(c) for c in ("n", "sketch", "fp")))
    least = materialize(least, "sets")
    found = connected_components(links(base, least, named.count()))
    rooted = least.join(found, least["set"] == found["node"], "left")
    first = rooted.groupBy(F.coalesce("root", "set")).agg(F.min("rank").alias("rank")).select("rank.rk", "rank.id")
    first = materialize(first, "first-rows")
    # The rows are about to be shuffled: nothing else needs to lie on the disks.
    drop_made(spark, before, keep=first)
    drop_shuffles(spark)
    return _rows_of(base, first).select("row.*")


def _rows_of(base: DataFrame, first: DataFrame) -> DataFrame:
    """One row of ``base`` for each of ``first`` (rk, id), that whose ``rest`` is least.

    The join is on rk alone, by which the groups lie together too, so that rows are shuffled once.
    """
    ids = first.groupBy("rk").agg(F.collect_list(F.struct("id")).alias("ids"))
    met = base.join(ids.hint("merge"), "rk").where(F.exists("ids", lambda x: x["id"].eqNullSafe(F.col("doc_id"))))
    return met.groupBy("rk", "doc_id").agg(F.min_by("row", "rest").alias("row"))
