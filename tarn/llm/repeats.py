"""Removal of long byte strings that occur more than once, across all documents.

Every window of ``least`` bytes is assigned to one of its grams, the one of least hash
(rightmost of equals); equal windows choose equal grams, so that only windows under the
same gram need comparing.  Neighbouring windows of a document under one gram make a
passage.  Equal passages are counted by hash and settle most windows.  Different passages
that share a gram are compared on a Burrows-Wheeler transform of a bounded batch of them.
If more than ``BATCH`` different passages share a gram, they are dealt again by more of what
they share: each window's core, the gram at first, grows to the side on which the window
reaches farther, by half of what the core lacks, so that equal windows keep equal cores.
After at most ten such steps a core is its whole window, so that every group ends up small
enough for a batch or equal, however many passages share a gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from tarn.llm.bwt import repeated_starts
from tarn.llm.common import id_type, materialize, small_batches

#: Bytes of a string whose repetition counts, unless another length is asked for.
LEAST = 400
#: Different passages of one gram that a batch may hold, and bytes after which a batch is closed.
BATCH, BATCH_BYTES = 1_024, 1 << 20
#: Window starts handled at once, so that a very long text takes bounded memory.
BLOCK = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
_RANDOM = np.random.default_rng(400)
BYTE_VALUES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_of(least: int) -> int:
    """Bytes of a gram: 64 for strings of 400."""
    return max(1, least * 4 // 25)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` bytes, by doubling; any size is two overlapping powers of two."""
    h = BYTE_VALUES[data]
    width, step = 1, 0
    while 2 * width <= size:
        h = h[:-width] * FACTORS[step] + h[width:]
        width, step = 2 * width, step + 1
    if width < size:
        h = h[: len(data) - size + 1] * FACTORS[step] + h[size - width :]
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :])


def passages(data: bytes, least: int = LEAST) -> Iterator[tuple[int, int, int, int]]:
    """(first window, windows, hash of the gram, hash of the passage) in order, over all windows."""
    import xxhash

    gram = gram_of(least)
    width = least - gram + 1
    for block in range(0, len(data) - least + 1, BLOCK):
        own = np.frombuffer(data, np.uint8)[block : block + BLOCK + least - 1]
        hashes = gram_hashes(own, gram)
        places = PLACE - np.arange(len(hashes), dtype=np.uint64)
        chosen = PLACE - (sliding_least((hashes & ~PLACE) | places, width) & PLACE)
        firsts = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        ends = np.append(firsts[1:], len(chosen))
        grams = hashes[chosen[firsts].astype(np.int64)].view(np.int64).tolist()
        for a, b, g in zip((firsts + block).tolist(), (ends + block).tolist(), grams, strict=True):
            yield a, b - a, g, xxhash.xxh3_64_intdigest(data[a : b - 1 + least]) - (1 << 63)


def core_of(data: bytes, windows: int, gram: int, least: int) -> int:
    """Where a passage's gram is that all its windows chose: the last place within all of them with that hash."""
    own = np.frombuffer(data, np.uint8)[windows - 1 : least]
    return windows - 1 + int(np.flatnonzero(gram_hashes(own, gram_of(least)).view(np.int64) == gram)[-1])


def grown(windows: int, core: int, size: int, step: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(first window, end, start of the grown core) for the parts of a passage whose core grows to one side.

    The core of ``size`` bytes grows by ``step``, half of what it lacks (or one byte more), to
    the right in windows that reach so far beyond it, to the left in the others.
    """
    turn = min(windows, max(0, core + size + step - least))
    if turn < windows:
        yield turn, windows, core
    if turn > 0:
        yield 0, turn, core - step


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def whole_characters(data: bytes, start: int, stop: int) -> bytes:
    """``data[start:stop]`` of UTF-8 without the parts of characters that it shares with what lies outside."""
    while start < stop and data[start] & 0xC0 == 0x80:
        start += 1
    end = stop
    while start < end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return data[start:end]


def _bytes_of(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts.to_pylist()]


def _all_passages(own: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, data in enumerate(_bytes_of(batch.column(2))):
                found = list(passages(data, least))
                rows += found
                at += [i] * len(found)
            cols = np.array(rows, dtype=np.int64).reshape(-1, 4).T
            taken = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, *(pa.array(c) for c in cols)], names=["rk", "doc_id", "at", "windows", "gram", "hash"]
            )

    schema = f"rk long, doc_id {id_type(own)}, at long, windows long, gram long, hash long"
    return own.select("rk", "doc_id", "text").mapInArrow(run, schema)


def _with_bytes(own: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``wanted`` passages (rk, id, at, windows, gram, n, many) with their bytes, each document read once.

    The merge join brings equal rows of a document together, of which one is read.
    """
    lists = wanted.groupBy("rk", "id").agg(
        F.collect_list(F.struct("at", "windows", "gram", "n", "many")).alias("passages")
    )
    lists = lists.withColumnRenamed("rk", "rk2")
    met = (own["rk"] == lists["rk2"]) & own["doc_id"].eqNullSafe(lists["id"])
    joined = own.hint("merge").join(lists, met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            texts, keys = _bytes_of(batch.column(2)), list(zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True))
            rows, at = [], []
            for i, own_passages in enumerate(batch.column(3).to_pylist()):
                if keys[i] == before:
                    continue
                before = keys[i]
                for p in own_passages:
                    end = p["at"] + p["windows"] - 1 + least
                    rows.append((*p.values(), texts[i][p["at"] : end]))
                    at.append(i)
            taken = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            cols = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            names = ["rk", "doc_id", "at", "windows", "gram", "n", "many", "bytes"]
            yield pa.RecordBatch.from_arrays([*taken.columns, *cols], names=names)

    schema = (
        f"rk long, doc_id {id_type(own)}, at long, windows long, gram long, n long, many boolean, bytes binary"
    )
    return joined.select("rk", "doc_id", "text", "passages").mapInArrow(run, schema)


def _compared(few: DataFrame, least: int) -> DataFrame:
    """Spans of single passages that repeat in another passage of the same gram, batch by batch."""
    kind = id_type(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def close() -> pa.RecordBatch:
            masks = repeated_starts(
                [p["bytes"] for p in held], [p["windows"] for p in held], [p["n"] for p in held], least
            )
            rows = [
                (p["rk"], p["doc_id"], p["at"] + a, p["at"] + b - 1 + least)
                for p, mask in zip(held, masks, strict=True)
                if p["n"] == 1
                for a, b in runs(mask)
            ]
            return pa.RecordBatch.from_pylist(
                [dict(zip(("rk", "doc_id", "start", "stop"), r, strict=True)) for r in rows], schema=out
            )

        out = None
        for batch in batches:
            if out is None:
                fields = [batch.schema.field("rk"), batch.schema.field("doc_id")]
                out = pa.schema([*fields, ("start", pa.int64()), ("stop", pa.int64())])
            for p in batch.to_pylist():
                if size >= BATCH_BYTES and p["gram"] != held[-1]["gram"]:
                    yield close()
                    held, size = [], 0
                held.append(p)
                size += len(p["bytes"])
        if held:
            yield close()

    rows = few.select("rk", "doc_id", "at", "windows", "gram", "n", "bytes")
    # Not on the gram itself: Spark would take a join's shuffle on it for this one, and may read that by map task instead.
    sorted_rows = rows.repartition(F.xxhash64("gram")).sortWithinPartitions("gram")
    return sorted_rows.mapInArrow(run, f"rk long, doc_id {kind}, start long, stop long")


def _dealt_again(many: DataFrame, size: int, step: int, least: int) -> DataFrame:
    """Passages (with ``core`` unless it is the gram) in parts whose cores are ``step`` longer, the key in ``gram``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def digest(data: bytes, seed: int) -> int:
            return xxhash.xxh3_64_intdigest(data, seed & (1 << 64) - 1) - (1 << 63)

        for batch in batches:
            rows, at = [], []
            for i, p in enumerate(batch.to_pylist()):
                data = p["bytes"]
                core = p["core"] if "core" in p else core_of(data, p["windows"], p["gram"], least)
                for first, end, start in grown(p["windows"], core, size, step, least):
                    own = data[first : end - 1 + least]
                    key = digest(data[start : start + size + step], p["gram"] + (start < core))
                    rows.append((p["at"] + first, end - first, key, digest(own, 0), p["n"], start - first, own))
                    at.append(i)
            taken = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            cols = [pa.array([r[j] for r in rows], pa.int64() if j < 6 else pa.binary()) for j in range(7)]
            names = ["rk", "doc_id", "at", "windows", "gram", "hash", "n", "core", "bytes"]
            yield pa.RecordBatch.from_arrays([*taken.columns, *cols], names=names)

    return many.mapInArrow(
        run,
        f"rk long, doc_id {id_type(many)}, at long, windows long, gram long, hash long, n long, core long, bytes binary",
    )


def _shared(counts: DataFrame) -> DataFrame:
    """Grams of more than one different passage, and whether of more than a batch may hold."""
    different = counts.groupBy("gram").agg(F.count("*").alias("different")).where("different > 1")
    return different.select("gram", (F.col("different") > BATCH).alias("many"))


def _span(least: int) -> list[Column]:
    stop = F.col("at") + F.col("windows") - 1 + least
    return [F.col("rk"), F.col("doc_id"), F.col("at").alias("start"), stop.alias("stop")]


def spans(own: DataFrame, least: int = LEAST) -> DataFrame:
    """(rk, doc_id, start, stop): byte spans, perhaps overlapping, that cover exactly what repeats."""
    found = materialize(_all_passages(own, least), "passages")
    counts = found.groupBy("gram", "hash").agg(
        F.count("*").alias("n"), F.min(F.struct("rk", "doc_id", "at", "windows")).alias("one")
    )
    counts = materialize(counts, "passage-counts")
    equal = counts.where("n > 1").select("gram", "hash")
    out = found.join(equal, ["gram", "hash"]).select(*_span(least))
    wanted = counts.join(_shared(counts), "gram").select(
        "one.rk", F.col("one.doc_id").alias("id"), "one.at", "one.windows", "gram", "n", "many"
    )
    rows = materialize(_with_bytes(own, wanted, least), "passage-bytes", compression="zstd")
    out = out.unionByName(_compared(rows.where("NOT many"), least))
    size, many = gram_of(least), rows.where("many").drop("many")
    while size < least and not many.isEmpty():
        step = (least - size + 1) // 2
        parts = materialize(_dealt_again(many, size, step, least), "passage-parts", compression="zstd")
        size += step
        place = F.struct("rk", "doc_id", "at")
        counts = parts.groupBy("gram", "hash").agg(
            F.sum("n").alias("n"), F.min_by(F.struct("rk", "doc_id", "at", "windows", "core", "bytes"), place).alias("one")
        )
        counts = materialize(counts, "part-counts", compression="zstd")
        equal = counts.where("n > 1").select("gram", "hash")
        out = out.unionByName(parts.where("n = 1").join(equal, ["gram", "hash"]).select(*_span(least)))
        rows = counts.join(_shared(counts), "gram").select("one.*", "gram", "n", "many")
        out = out.unionByName(_compared(rows.where("NOT many"), least))
        many = rows.where("many").drop("many")
    return out


def find_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", characters: bool = False, least: int = LEAST
) -> DataFrame:
    """doc_id, rest (a struct of the other columns), n_bytes, spans, kept and had_text for every row of ``docs``.

    ``spans`` are the maximal removed byte ranges (start, stop), ``kept`` the remaining bytes,
    with ``characters`` without the parts of characters left over at a cut.
    Removed is each byte of a string of ``least`` bytes that also starts elsewhere.  A null text
    is empty (had_text is false); shorter texts than ``least`` keep everything; equal rows lose
    the same bytes, as each repeats in the other; matches never cross documents; other columns
    may have any names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("struct<none:int>")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest"))
    base = base.withColumn("rk", F.xxhash64("doc_id", "text"))
    found = spans(base.select("rk", "doc_id", "text"), least)
    lists = found.groupBy("rk", "doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    lists = lists.withColumnsRenamed({"rk": "rk2", "doc_id": "id2"})
    joined = base.join(lists, (base["rk"] == lists["rk2"]) & base["doc_id"].eqNullSafe(lists["id2"]), "left")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for data, own in zip(_bytes_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                cuts = merged([(s["start"], s["stop"]) for s in own or []])
                edges = [0, *(x for c in cuts for x in c), len(data)]
                pieces = zip(edges[::2], edges[1::2], strict=True)
                kept.append(b"".join(whole_characters(data, a, b) if characters else data[a:b] for a, b in pieces))
                sizes.append(len(data))
                gone.append([{"start": a, "stop": b} for a, b in cuts])
            made = [pa.array(sizes, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *made, batch.column(2).is_valid()],
                names=["doc_id", "rest", "n_bytes", "spans", "kept", "had_text"],
            )

    span = StructType([StructField("start", LongType()), StructField("stop", LongType())])
    made = (("n_bytes", LongType()), ("spans", ArrayType(span)), ("kept", BinaryType()), ("had_text", BooleanType()))
    schema = StructType([base.schema["doc_id"], base.schema["rest"], *(StructField(n, k) for n, k in made)])
    return joined.select("doc_id", "rest", "text", "spans").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text`` and n_chars, if there, counted again.

    Repeated are strings of ``least`` bytes.  Parts of a character left over at a cut are
    dropped.  Null texts stay null, empty ones empty; equal rows all stay, each cut; an empty
    table stays empty.
    """
    found = find_repeats(docs, characters=True, least=least)
    out = found.withColumn("new_text", F.when(F.col("had_text"), F.col("kept").cast("string")))
    columns = [
        F.col("doc_id") if c == "doc_id"
        else F.col("new_text").alias(c) if c == "text"
        else F.length("new_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col("rest").getField(c).alias(c)
        for c in docs.columns
    ]
    return out.select(*columns)
