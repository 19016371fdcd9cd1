"""Clauses of SQL dialects that Spark's DataFrame API has under other names or not at all."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ascending(*names: str) -> list[Column]:
    """Order keys with nulls last, the default of the dialect in both directions."""
    return [F.col(n).asc_nulls_last() for n in names]


def descending(*names: str) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


def qualify(df: DataFrame, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Rows for which ``keep`` holds of a window expression, as QUALIFY does."""
    return df.withColumn("qualified", value).where(keep(F.col("qualified"))).drop("qualified")


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), lambda n: n == 1)


def exclude(df: DataFrame, *names: str) -> DataFrame:
    """``* EXCLUDE``: an unknown name is an error."""
    unknown = set(names) - set(df.columns)
    if unknown:
        raise ValueError(f"columns not found: {sorted(unknown)}")
    return df.drop(*names)


def replace(df: DataFrame, **columns: Column) -> DataFrame:
    """``* REPLACE``: columns in place."""
    unknown = set(columns) - set(df.columns)
    if unknown:
        raise ValueError(f"columns not found: {sorted(unknown)}")
    return df.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in df.columns))


def columns_like(df: DataFrame, pattern: str, make: Callable[[Column], Column] = lambda c: c) -> list[Column]:
    """``COLUMNS('regex')``: an expression for each matching column, under its name."""
    return [make(F.col(c)).alias(c) for c in df.columns if re.search(pattern, c)]


def positional(df: DataFrame, *ordinals: int) -> DataFrame:
    """``#n``: columns by their ordinal from 1."""
    return df.select(*(F.col(df.columns[i - 1]) for i in ordinals))


def pivot(df: DataFrame, keys: Sequence[str], on: str, values: Sequence, **aggregates: Column) -> DataFrame:
    """Columns from values; null keys form a group, absent cells are null."""
    return df.groupBy(*keys).pivot(on, list(values)).agg(*(a.alias(n) for n, a in aggregates.items()))


def unpivot(
    df: DataFrame, columns: Sequence[str], name: str = "name", value: str = "value", include_nulls: bool = False
) -> DataFrame:
    """Rows from columns; null values are left out unless asked for."""
    keep = [c for c in df.columns if c not in columns]
    out = df.unpivot(keep, list(columns), name, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())


def limit_percent(df: DataFrame, percent: float, order: Sequence[Column]) -> DataFrame:
    """The first ``percent`` of the rows in order (rounded down)."""
    from tarn.operators.joins import with_position

    rows = df.count()
    return with_position(df, order, "position").where(F.col("position") <= int(rows * percent / 100)).drop("position")


def reservoir(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """A uniform sample of a fixed number of rows, the same for the same rows and seed."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed))).limit(rows)


def summarize(df: DataFrame) -> DataFrame:
    """One row per column: type, least, greatest, distinct and total count, share of nulls, and moments of numbers."""
    kinds = dict(df.dtypes)
    stats = []
    for c in df.columns:
        number = re.match("tinyint|smallint|int|bigint|float|double|decimal", kinds[c])
        x = F.col(c).cast("double") if number else F.lit(None).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("column_type"),
                F.min(F.col(c)).cast("string").alias("min"), F.max(F.col(c)).cast("string").alias("max"),
                F.approx_count_distinct(F.col(c)).alias("approx_unique"),
                F.avg(x).alias("avg"), F.stddev_samp(x).alias("std"),
                F.percentile_approx(x, [0.25, 0.5, 0.75]).alias("quartiles"),
                F.count("*").alias("count"),
                (100 * F.count_if(F.col(c).isNull()) / F.count("*")).alias("null_percentage"),
            )
        )
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def recursive_union(
    seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, rounds: int = 1000
) -> DataFrame:
    """A recursive query: ``step`` is applied to the rows new in the round before, until none are.

    With ``distinct`` (UNION) rows seen before do not come again: new rows are tried against
    what is there by a null-safe anti join.  Every round is written by ``checkpoint`` so that
    the plan does not grow; where no checkpoint folder is set, only a local master gets one.
    """
    context = seed.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = seed.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tarn-")
        context.setCheckpointDir(folder)
    fresh = (seed.distinct() if distinct else seed).checkpoint()
    total = fresh
    for _ in range(rounds):
        following = step(fresh)
        if distinct:
            seen = total.toDF(*(f"seen{i}" for i in range(len(total.columns))))
            same = F.lit(True)
            for i, c in enumerate(following.columns):
                same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"seen{i}"))
            following = following.distinct().join(seen, same, "left_anti")
        fresh = following.checkpoint()
        if fresh.isEmpty():
            return total
        total = total.union(fresh)
    raise RuntimeError("the recursion did not end")


def insert_or(table: DataFrame, rows: DataFrame, keys: Sequence[str], update: Mapping[str, Column] | None) -> DataFrame:
    """The table after INSERT .. ON CONFLICT: DO NOTHING without ``update``, else DO UPDATE SET.

    In ``update`` expressions, ``old.x`` and ``new.x`` name the columns of both rows.  Null
    keys never conflict; two new rows of one key are an error.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    twice = F.count("*").over(Window.partitionBy(*keys)) > 1
    message = F.raise_error(F.lit("two inserted rows have the same key")).cast("boolean")
    new = rows.withColumn("is_new", F.when(whole & twice, message).otherwise(True)).alias("new")
    old = table.withColumn("is_old", F.lit(True)).alias("old")
    both = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full")
    was, came = F.col("old.is_old").isNotNull(), F.coalesce(F.col("new.is_new"), F.lit(False))
    out = []
    for c in table.columns:
        kept = F.when(was, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        out.append((F.when(was & came, update[c]).otherwise(kept) if update and c in update else kept).alias(c))
    return both.where(was | came).select(*out)


def excluding(
    df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], exclude: str, rows: tuple[int, int] | None = None
) -> DataFrame:
    """``df`` with sum_x, count_x, min_x and max_x of ``value`` over a window frame with EXCLUDE.

    ``exclude`` is current row, group (the row and its peers), ties (its peers without
    itself) or no others.  Without ``rows`` the frame is the whole partition: it is taken as
    the rows before and the rows after what is excluded, two running frames, so nothing is
    gathered or subtracted.  With ``rows`` (offsets from the current row) the frame's few
    values are gathered and those excluded are filtered out.
    """
    if exclude not in ("current row", "group", "ties", "no others"):
        raise ValueError(f"unknown exclusion {exclude}")
    by = Window.partitionBy(*keys)
    x = F.col(value)
    own = df.withColumn("peers_x", F.dense_rank().over(by.orderBy(*order))).withColumn(
        "place_x", F.row_number().over(by.orderBy(*order))
    )
    total = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    how = {"sum_x": (F.sum, total), "count_x": (F.count, total), "min_x": (F.min, F.least), "max_x": (F.max, F.greatest)}
    out = {}
    if rows is None:
        unit = "place_x" if exclude == "current row" else "peers_x"
        along = by.orderBy(unit)
        if exclude == "no others":
            frames = [by]
        else:
            frames = [along.rangeBetween(Window.unboundedPreceding, -1), along.rangeBetween(1, Window.unboundedFollowing)]
        for name, (f, join) in how.items():
            parts = [f(x).over(w) for w in frames]
            if exclude == "ties":
                parts.append(F.count(x).over(by.orderBy("place_x").rowsBetween(0, 0)) if f is F.count else x)
            made = parts[0]
            for part in parts[1:]:
                made = join(made, part)
            out[name] = made
        return own.select("*", *(c.alias(n) for n, c in out.items())).drop("peers_x", "place_x")
    frame = F.collect_list(F.struct("peers_x", "place_x", x.alias("x"))).over(by.orderBy("place_x").rowsBetween(*rows))
    keep = {
        "current row": lambda s: s["place_x"] != F.col("place_x"),
        "group": lambda s: s["peers_x"] != F.col("peers_x"),
        "ties": lambda s: (s["peers_x"] != F.col("peers_x")) | (s["place_x"] == F.col("place_x")),
        "no others": lambda s: F.lit(True),
    }[exclude]
    held = own.withColumn("frame_x", F.array_compact(F.transform(F.filter(frame, keep), lambda s: s["x"])))
    xs = F.col("frame_x")
    zero = F.lit(0).cast(df.schema[value].dataType)
    return held.select(
        "*",
        F.when(F.size(xs) > 0, F.aggregate(xs, zero, lambda t, v: (t + v).cast(df.schema[value].dataType))).alias("sum_x"),
        F.size(xs).cast("long").alias("count_x"), F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"),
    ).drop("frame_x", "peers_x", "place_x")


def sums_between(
    df: DataFrame, value: str, keys: Sequence[str], order: Sequence[Column | str], before: Column, after: Column
) -> DataFrame:
    """``df`` with sum_x and count_x over ROWS BETWEEN ``before`` PRECEDING AND ``after`` FOLLOWING, both read from each row.

    Running totals are taken once and looked up at the frame's two ends by equality joins on
    the row number, so that the work does not depend on the length of the frames.  An empty
    frame has a null sum and a count of zero; a null bound makes both null.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    own = df.withColumn("place_x", F.row_number().over(w).cast("long")).withColumn("rows_x", F.count("*").over(Window.partitionBy(*keys)))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("total_x", F.sum(value).over(run)).withColumn("seen_x", F.count(value).over(run))
    own = own.withColumn("low_x", F.greatest(F.col("place_x") - before - 1, F.lit(0).cast("long")))
    own = own.withColumn("high_x", F.least(F.col("place_x") + after, F.col("rows_x")))
    names = [f"k{i}_x" for i in range(len(keys))]

    def end(prefix: str) -> DataFrame:
        renamed = [F.col(k).alias(f"{prefix}_{n}") for k, n in zip(keys, names, strict=True)]
        ends = (F.col(f"{c}_x").alias(f"{prefix}_{n}") for c, n in (("place", "at"), ("total", "total"), ("seen", "seen")))
        return own.select(*renamed, *ends)

    def met(prefix: str, at: str) -> Column:
        out = F.col(at) == F.col(f"{prefix}_at")
        for k, n in zip(keys, names, strict=True):
            out = out & F.col(k).eqNullSafe(F.col(f"{prefix}_{n}"))
        return out

    both = own.join(end("a"), met("a", "low_x"), "left").join(end("b"), met("b", "high_x"), "left")
    zero = F.lit(0).cast("long")
    seen = F.coalesce("b_seen", zero) - F.coalesce("a_seen", zero)
    there = F.col("low_x") < F.col("high_x")
    known = before.isNotNull() & after.isNotNull()
    total = F.coalesce("b_total", F.lit(0)) - F.coalesce("a_total", F.lit(0))
    return both.select(
        *df.columns,
        F.when(known & there & (seen > 0), total).alias("sum_x"),
        F.when(known, F.when(there, seen).otherwise(zero)).alias("count_x"),
    )


def update_where(table: DataFrame, condition: Column, **columns: Column) -> DataFrame:
    """The table after UPDATE .. SET .. WHERE; an unknown condition changes nothing."""
    held = F.coalesce(condition, F.lit(False))
    return replace(table, **{c: F.when(held, v).otherwise(F.col(c)) for c, v in columns.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """The table after DELETE .. WHERE; an unknown condition deletes nothing."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def update_from(table: DataFrame, other: DataFrame, on: Sequence[str], **columns: Column) -> DataFrame:
    """The table after UPDATE .. SET .. FROM ``other``, joined on equal ``on``; ``o.x`` names its columns.

    ``other`` may hold a key once only.
    """
    one = other.withColumn("met_o", F.lit(True)).alias("o")
    joined = table.alias("t").join(one, [F.col(f"t.{k}") == F.col(f"o.{k}") for k in on], "left")
    met = F.col("met_o").isNotNull()
    return joined.select(
        *(F.when(met, columns[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in columns else F.col(f"t.{c}") for c in table.columns)
    )


def delete_using(table: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """The table after DELETE .. USING ``other`` on equal ``on``."""
    return table.join(other.select(*on).distinct(), list(on), "left_anti").select(*table.columns)


def describe(df: DataFrame) -> DataFrame:
    """DESCRIBE: column_name and column_type, under the dialect's type names, in order."""
    from tarn.functions.generic import type_name

    rows = [(i, c, type_name(k)) for i, (c, k) in enumerate(df.dtypes, 1)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, column_type string")


def explain(df: DataFrame, mode: str = "formatted") -> DataFrame:
    """EXPLAIN: the plan's lines, numbered."""
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )
    return df.sparkSession.createDataFrame(list(enumerate(plan.splitlines(), 1)), "line int, plan string")


def order_by_all(df: DataFrame, descending_order: bool = False) -> DataFrame:
    """ORDER BY ALL: every column from left to right, nulls last."""
    return df.orderBy(*(descending if descending_order else ascending)(*df.columns))


def repeat_rows(spark, rows: int, **values) -> DataFrame:
    """``repeat_row``: constant rows."""
    return spark.range(rows).select(*(F.lit(v).alias(c) for c, v in values.items()))


def aligned_union(*parts: DataFrame) -> DataFrame:
    """UNION ALL by position with the types widened, under the first part's names."""
    names = parts[0].columns
    out = parts[0]
    for part in parts[1:]:
        if len(part.columns) != len(names):
            raise ValueError("set operations need as many columns on both sides")
        out = out.union(part)
    return out.toDF(*names)


def limit_by(df: DataFrame, rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """LIMIT with a subquery: the first rows in order, as many as the one value of ``rows`` says."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ValueError("more than one row returned by a subquery used as an expression" if found else "the limit has no row")
    return df.orderBy(*order) if found[0][0] is None else df.orderBy(*order).limit(int(found[0][0]))


def sample_rows(df: DataFrame, rows: int | None = None, percent: float | None = None, method: str = "bernoulli", seed: int = 0) -> DataFrame:
    """TABLESAMPLE: a fixed number of rows (reservoir), or a share of rows (bernoulli) or of partitions' rows (system)."""
    if (rows is None) == (percent is None):
        raise ValueError("either rows or percent")
    if rows is not None:
        return reservoir(df, rows, seed)
    if not 0 <= percent <= 100:
        raise ValueError("a percentage is between 0 and 100")
    if method == "bernoulli":
        return df.sample(fraction=percent / 100, seed=seed)  # by name: a seed after a share given by place is ignored
    if method == "system":
        block = F.floor(F.monotonically_increasing_id() / 2048)
        return df.where(F.pmod(F.xxhash64(block, F.lit(seed)), F.lit(10_000)) < percent * 100)
    raise ValueError(f"unknown method {method}")
