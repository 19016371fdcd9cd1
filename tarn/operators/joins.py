"""Joins that Spark has no operator for, as compositions of joins and windows it has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: Sequence[str] = (),
    how: str = "left",
    op: str = ">=",
    right_columns: Sequence[str] | None = None,
    width: float | None = None,
) -> DataFrame:
    """Each left row with the nearest right row for which ``left_on op right_on`` holds.

    ``op`` is >=, > (the latest right row before) or <=, < (the earliest after); ``by``
    columns must be equal.  ``how`` is left, inner, semi or anti.  Both sides are put into
    one stream per key and the last right row is carried along, so the work is one shuffle
    and one sort however many right rows a key has; no pairs are made.  Null keys or times
    match nothing.  With ``width`` (of a number, or seconds of a time) a key's stream is cut
    into buckets of that width, which tasks share: for keys, or no key at all, that hold
    more rows than one task should.  The last right row of each bucket, one row a bucket, is
    then carried to the buckets after it.
    """
    if op not in (">=", ">", "<=", "<") or how not in ("left", "inner", "semi", "anti"):
        raise ValueError("unknown comparison or join type")
    by = list(by)
    right_columns = [c for c in (right_columns or right.columns) if c not in by]
    payload = F.struct(*(F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(right_columns)), F.lit(True).alias("there"))
    row = F.struct(*(F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(left.columns)))
    forward = op in (">=", ">")
    # Among equal times the right rows come first if they count as matches.
    first = 0 if op in (">=", "<=") else 1
    kinds = dict(right.dtypes)
    payload_type = "struct<" + ",".join(f"r{i}:{kinds[c]}" for i, c in enumerate(right_columns)) + ",there:boolean>"
    row_type = "struct<" + ",".join(f"l{i}:{t}" for i, (_, t) in enumerate(left.dtypes)) + ">"
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)]
    names = [f"k{i}" for i in range(len(by))]
    usable = F.col(f"`{right_on}`").isNotNull()
    for c in by:
        usable = usable & F.col(f"`{c}`").isNotNull()
    one = left.select(*keys, F.col(f"`{left_on}`").alias("at"), F.lit(1 - first).alias("side"), row.alias("row"),
                      F.lit(None).cast(payload_type).alias("hit"))
    two = right.where(usable).select(*keys, F.col(f"`{right_on}`").alias("at"), F.lit(first).alias("side"),
                                     F.lit(None).cast(row_type).alias("row"), payload.alias("hit"))
    both = one.unionByName(two)
    if width is not None:
        time = both.schema["at"].dataType.typeName().startswith(("timestamp", "date"))
        place = F.unix_micros(F.col("at").cast("timestamp")) / 1e6 if time else F.col("at")
        both = both.withColumn("bucket", F.floor(place / width).cast("long"))
    order = (
        [F.col("at").asc_nulls_first(), F.col("side").asc()]
        if forward
        else [F.col("at").desc_nulls_first(), F.col("side").asc()]
    )
    window = Window.partitionBy(*names, *(["bucket"] if width is not None else [])).orderBy(*order)
    window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("hit", F.last("hit", ignorenulls=True).over(window)).where(F.col("row").isNotNull())
    if width is not None:
        # The right row that a bucket hands on is that of its latest (backward: earliest) time, the last by side.
        best = (F.max_by if forward else F.min_by)("hit", F.struct("at", F.xxhash64("hit")))
        heads = both.where("hit IS NOT NULL").groupBy(*names, "bucket").agg(best.alias("kept"))
        marks = both.where("row IS NOT NULL").select(*names, "bucket").distinct()
        heads = marks.join(heads, [*names, "bucket"], "full") if names else marks.join(heads, "bucket", "full")
        along = Window.partitionBy(*names).orderBy(F.col("bucket").asc() if forward else F.col("bucket").desc())
        heads = heads.withColumn("before", F.last("kept", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
        heads = heads.select(*(F.col(n).alias(f"h{n}") for n in names), F.col("bucket").alias("h"), "before")
        met = F.col("bucket") == F.col("h")
        for n in names:
            met = met & (F.col(n) == F.col(f"h{n}"))
        carried = carried.join(heads, met, "left").withColumn("hit", F.coalesce("hit", "before"))
    if how in ("inner", "semi"):
        carried = carried.where("hit.there")
    if how == "anti":
        carried = carried.where(F.col("hit.there").isNull())
    out = [F.col(f"row.l{i}").alias(c) for i, c in enumerate(left.columns)]
    if how in ("left", "inner"):
        out += [F.col(f"hit.r{i}").alias(c) for i, c in enumerate(right_columns)]
    return carried.select(*out)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    width: float,
    closed: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Pairs of rows whose numeric ranges overlap (``closed``: touching counts).

    Buckets come in levels, each twice as wide as the one below, from ``width`` on.  A range
    belongs to the lowest level whose buckets are as long as itself, where it meets two of
    them at most, and is also entered into the buckets it meets on each higher level that some
    range belongs to.  Two ranges meet on the higher of their levels, and a pair is kept in
    the bucket where the later of the two starts lies, so that it appears once.  A row is
    entered twice a level at most, however long its range is.
    """
    ls, le, rs, re = F.col(left_range[0]), F.col(left_range[1]), F.col(right_range[0]), F.col(right_range[1])

    def level(start: Column, end: Column) -> Column:
        return F.greatest(F.ceil(F.log2(F.greatest((end - start) / width, F.lit(1.0)))), F.lit(0)).cast("int")

    def bucket(x: Column, at: Column) -> Column:
        return F.floor(x / (width * F.pow(F.lit(2.0), at))).cast("long")

    one, two = left.where(ls <= le).withColumn("own_l", level(ls, le)), right.where(rs <= re).withColumn("own_r", level(rs, re))
    found = one.select("own_l").distinct().union(two.select("own_r").distinct()).distinct()
    levels = sorted(r[0] for r in found.collect())  # a level for each doubling of the length: never many
    used = F.array(*(F.lit(i) for i in levels)) if levels else F.array().cast("array<int>")

    def entered(df: DataFrame, side: str, start: Column, end: Column) -> DataFrame:
        df = df.withColumn(f"level_{side}", F.explode(F.filter(used, lambda i: i >= F.col(f"own_{side}"))))
        at = F.col(f"level_{side}")
        return df.withColumn(f"bucket_{side}", F.explode(F.sequence(bucket(start, at), bucket(end, at))))

    one, two = entered(one, "l", ls, le), entered(two, "r", rs, re)
    meets = (ls <= re) & (rs <= le) if closed else (ls < re) & (rs < le)
    same = (F.col("level_l") == F.col("level_r")) & (F.col("bucket_l") == F.col("bucket_r"))
    for c in by:
        same = same & (one[c] == two[c])
    once = (F.col("level_l") == F.greatest("own_l", "own_r")) & (F.col("bucket_l") == bucket(F.greatest(ls, rs), F.col("level_l")))
    return one.join(two, same & meets & once).drop("own_l", "own_r", "level_l", "level_r", "bucket_l", "bucket_r")


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, below: float, above: float) -> DataFrame:
    """Pairs with ``left - below <= right <= left + above``: buckets as wide as the band, at most two of them a row."""
    width = float(below + above) or 1.0
    x, y = F.col(left_on), F.col(right_on)
    first, last = F.floor((x - below) / width).cast("long"), F.floor((x + above) / width).cast("long")
    one = left.where(x.isNotNull()).withColumn("bucket_l", F.explode(F.sequence(first, last)))
    two = right.withColumn("bucket_r", F.floor(y / width).cast("long"))
    near = (F.col("bucket_l") == F.col("bucket_r")) & (y >= x - below) & (y <= x + above)
    return one.join(two, near).drop("bucket_l", "bucket_r")


def _ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` in sorted range partitions, with ``part`` (in their order) and ``place`` (increasing) of each row.

    The rows are shuffled here, once.  Whoever reads the result reads those partitions: planned
    twice, the bounds are drawn from another sample and the partitions are merged in another
    way, so that what one reader counts in a partition is not what the other finds there.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33))
    own = ranged._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(own.queryExecution().toRdd(), own.schema(), False), spark)


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Global row numbers from 1 without sorting everything in one task.

    The rows are range-partitioned and sorted; each partition numbers its own rows, and the
    counts of the partitions before it, one number each, are added.
    """
    ranged = _ranged(df, order).withColumn("inner_place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("own"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    out = ranged.join(F.broadcast(starts), F.col("part") == F.col("own"))
    return out.select(*df.columns, (F.col("start") + F.col("inner_place") + 1).alias(name))


def running_sum(
    df: DataFrame, value: str, order: Sequence[Column | str], name: str = "running", peers: bool = False
) -> DataFrame:
    """Sums of ``value`` up to each row, over the whole table, without sorting everything in one task.

    As ``with_position``: each range partition sums its own rows, and the totals of those
    before it, one number each, are added.  Rows are taken one by one, also equal ones; with
    ``peers`` rows of equal order share the sum up to the last of them.  Null values add
    nothing, and the sum is null until there is a value.
    """
    ranged = _ranged(df, order)
    totals = ranged.groupBy("part").agg(F.sum(value).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("part").alias("own"), F.sum("total").over(before).alias("start"))
    # Rows of equal order lie in one range partition.
    inner = Window.partitionBy("part").orderBy(*(order if peers else ["place"]))
    inner = (inner.rangeBetween if peers else inner.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("inner_sum", F.sum(value).over(inner)).join(F.broadcast(starts), F.col("part") == F.col("own"))
    upto = F.coalesce(F.col("start") + F.col("inner_sum"), "inner_sum", "start")
    return summed.select(*df.columns, upto.alias(name))


def positional_join(
    left: DataFrame, right: DataFrame, left_order: Sequence[Column | str], right_order: Sequence[Column | str]
) -> DataFrame:
    """Rows zipped by their position in the given orders; the shorter side is padded with nulls."""
    one, two = with_position(left, left_order, "position_l"), with_position(right, right_order, "position_r")
    both = one.join(two, F.col("position_l") == F.col("position_r"), "full")
    return both.drop("position_l", "position_r")


def mark_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, mark: str = "mark") -> DataFrame:
    """``left`` with the three-valued result of ``left_on IN (right_on of right)``."""
    seen = right.agg(F.count("*").alias("rows_r"), F.max(F.col(right_on).isNull()).alias("null_r"))
    values = right.select(F.col(right_on).alias("value_r")).where("value_r IS NOT NULL").distinct()
    joined = left.join(values, left[left_on] == F.col("value_r"), "left").crossJoin(F.broadcast(seen))
    unknown = (F.col(left_on).isNull() & (F.col("rows_r") > 0)) | F.coalesce(F.col("null_r"), F.lit(False))
    out = F.when(F.col("value_r").isNotNull(), True).when(unknown, F.lit(None)).otherwise(False)
    return joined.select(*(left[c] for c in left.columns), out.alias(mark))


def single_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join for scalar subqueries: every left row stays once; a key that ``right`` holds twice is an error if it is met.

    The count and a row of each key are taken by one aggregation, so that nothing multiplies.
    """
    values = [c for c in right.columns if c not in on]
    one = right.groupBy(*on).agg(*(F.first(F.col(c)).alias(c) for c in values), F.count("*").alias("rows_r"))
    joined = left.join(one, list(on), "left")
    more = F.raise_error(F.lit("more than one row returned by a subquery used as an expression"))
    checked = [F.when(F.col("rows_r") > 1, more.cast(right.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select(*left.columns, *checked)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """On all columns of the same name; none in common is an error."""
    both = [c for c in left.columns if c in right.columns]
    if not both:
        raise ValueError("no columns in common")
    return left.join(right, both, how)
