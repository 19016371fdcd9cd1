"""Aggregate functions whose definition differs from Spark's, or that Spark lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skewness(x: Column) -> Column:
    """Bias-corrected; null for fewer than three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    """Bias-corrected excess; null for fewer than four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def sem(x: Column) -> Column:
    """Standard error of the mean, of the population form."""
    return F.stddev_pop(x) / F.sqrt(F.count(x).cast("double"))


def geomean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))


def arg_min(value: Column, by: Column) -> Column:
    """The non-null value at the least ``by``."""
    return F.min_by(value, F.when(value.isNotNull(), by))


def arg_max(value: Column, by: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), by))


def ordered_list(value: Column, by: Column) -> Column:
    """``list(value ORDER BY by)``, nulls kept."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by.alias("k"), value.alias("v")))), lambda s: s["v"])


def ordered_string(value: Column, separator: str, by: Column) -> Column:
    """``string_agg(value, separator ORDER BY by)``."""
    return F.array_join(ordered_list(value, by), separator)


def histogram(df: DataFrame, keys: Sequence[str], value: str, name: str = "histogram") -> DataFrame:
    """Exact value counts of each group as a map: counted per value before any group is gathered."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(value), F.col("n"))))
    return counted.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def entropy(df: DataFrame, keys: Sequence[str], value: str, name: str = "entropy") -> DataFrame:
    """Base-2 entropy of the values' counts, from sums over distinct values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").cast("double").alias("n"))
    total, weighted = F.sum("n"), F.sum(F.col("n") * F.log2("n"))
    return counted.groupBy(*keys).agg((F.log2(total) - weighted / total).alias(name))


def mode(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value, the least of equally frequent ones."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counted.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias(name))


def mad(df: DataFrame, keys: Sequence[str], value: str, name: str = "mad") -> DataFrame:
    """Median absolute deviation: the medians are joined back and deviations from them taken."""
    medians = df.groupBy(*keys).agg(F.median(value).alias("middle"))
    both = df.join(medians, list(keys)) if keys else df.crossJoin(F.broadcast(medians))
    return both.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("middle"))).alias(name))


def median_of(values: Column) -> Column:
    """Median of a list of numbers; over a window, of the values of a bounded frame."""
    xs, n = F.array_sort(values), F.size(values)
    low = F.get(xs, F.floor((n - 1) / 2).cast("int"))
    return (low + F.get(xs, F.floor(n / 2).cast("int"))) / 2


def bitstring(values: Sequence[int], x: Column) -> Column:
    """A bit for each of the given values, set if it occurs."""
    found = F.collect_set(x)
    bits = [F.when(F.array_contains(found, F.lit(v)), "1").otherwise("0") for v in values]
    return F.concat(*bits)


def any_value(value: Column, by: Column) -> Column:
    """``any_value(value ORDER BY by)``: the first that is not null."""
    return F.min_by(value, F.when(value.isNotNull(), by))


def first_value(value: Column, by: Column) -> Column:
    """``first(value ORDER BY by)``: nulls count."""
    return F.min_by(value, by)


def last_value(value: Column, by: Column) -> Column:
    return F.max_by(value, by)


def arg_min_null(value: Column, by: Column) -> Column:
    """The value at the least ``by``, null or not."""
    return F.min_by(value, by)


def arg_max_null(value: Column, by: Column) -> Column:
    return F.max_by(value, by)


def kahan_sum(df: DataFrame, keys: Sequence[str], value: str, name: str = "total") -> DataFrame:
    """``kahan_sum`` / ``fsum``: sums of doubles without the loss of small parts, and ``name``_mean, that of ``favg``.

    Each task sends one exactly rounded sum and a count for each key, and those are summed the
    same way.  Null values are left out; a group without others has a null sum.
    """
    import math
    from collections.abc import Iterator

    import pandas as pd

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for k, own in batch.groupby(list(keys), dropna=False)[value] if keys else [((), batch[value])]:
                own = own.dropna()
                state = held.setdefault(k, [0.0, 0])
                state[0], state[1] = math.fsum([state[0], *own]), state[1] + len(own)
        yield pd.DataFrame([(*k, *s) for k, s in held.items()], columns=[*keys, "part", "n"])

    def final(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, total = int(frame["n"].sum()), math.fsum(frame["part"])
        return pd.DataFrame([(*key, total if n else None, total / n if n else None)], columns=[*keys, name, f"{name}_mean"])

    parts = df.select(*keys, F.col(value).cast("double").alias(value)).mapInPandas(partial, ", ".join(filter(None, [kinds, "part double, n long"])))
    out = ", ".join(filter(None, [kinds, f"{name} double, {name}_mean double"]))
    return parts.groupBy(*keys).applyInPandas(final, out)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], name: str = "quantiles", discrete: Sequence[float] = ()
) -> DataFrame:
    """Exact quantiles of each group as a list, however large the groups: counted per value, then looked up by running counts.

    Those of ``at`` are interpolated; those of ``discrete``, which follow them, are values of the group.

    The counts run over range partitions, so that neither a buffer of values nor a window in
    one task holds a group.
    """
    from tarn.operators.joins import running_sum

    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    counted = running_sum(counted, "n", [*keys, value], "upto")
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("rows"), F.min(F.col("upto") - F.col("n")).alias("base"))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}"))
    both = counted.alias("v").join(sizes.alias("s"), met)
    x, upto, rows = F.col(f"v.{value}"), F.col("upto") - F.col("base"), F.col("rows")

    def holds(place: Column) -> Column:  # the value at a place from 0
        return F.min(F.when((upto > place) & (upto - F.col("n") <= place), x))

    out = []
    for q in at:
        place = (rows - 1) * F.lit(float(q))
        low, high = holds(F.floor(place)), holds(F.ceil(place))
        out.append(low + (high - low) * F.min(place - F.floor(place)))
    for q in discrete:
        out.append(holds(F.greatest(F.ceil(rows * F.lit(float(q))) - 1, F.lit(0))))
    return both.groupBy(*(F.col(f"v.{k}").alias(k) for k in keys)).agg(F.array(*out).alias(name))


def reservoir_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, size: int = 8192, name: str = "quantile") -> DataFrame:
    """The quantile of a uniform sample of ``size`` values of each group, the same for the same rows.

    A group's sample is its values of least hash; each task keeps no more than that many of
    each key before the shuffle.
    """
    ranked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"))
    ranked = ranked.withColumn("draw", F.xxhash64(F.monotonically_increasing_id(), "x"))
    w = Window.partitionBy(*keys).orderBy("draw")
    sample = ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size)
    return sample.groupBy(*keys).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY x)").alias(name))


def export_state(x: Column) -> Column:
    """The state of count, sum, avg and the variances of numbers, as a struct that can be stored."""
    x = x.cast("double")
    return F.struct(F.count(x).alias("n"), F.sum(x).alias("total"), (F.var_pop(x) * F.count(x)).alias("m2"))


def combine_states(state: Column) -> Column:
    """The state of the union of several states' rows (an aggregate over states)."""
    n, total, m2 = F.sum(state["n"]), F.sum(state["total"]), F.sum(state["m2"])
    between = F.sum(F.when(state["n"] > 0, state["total"] * state["total"] / state["n"])) - total * total / F.nullif(n, F.lit(0))
    return F.struct(n.alias("n"), total.alias("total"), (m2 + between).alias("m2"))


def finalize_state(state: Column, what: str) -> Column:
    n, total, m2 = state["n"], state["total"], state["m2"]
    return {
        "count": n, "sum": total, "avg": total / F.nullif(n, F.lit(0)), "var_samp": F.when(n > 1, m2 / (n - 1)),
        "stddev_samp": F.when(n > 1, F.sqrt(m2 / (n - 1))),
    }[what]


def mad_of(values: Column) -> Column:
    """Median absolute deviation of a list; over a window, of the values of a bounded frame."""
    middle = median_of(values)
    return median_of(F.transform(values, lambda x: F.abs(x - middle)))


def quantile_of(values: Column, q: float) -> Column:
    """Interpolated quantile of a list."""
    xs = F.array_sort(values)
    place = (F.size(values) - 1) * F.lit(float(q))
    low, high = (F.get(xs, f(place).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (place - F.floor(place))


def mode_of(values: Column) -> Column:
    """The most frequent value of a list, the first met of equally frequent ones."""
    distinct = F.array_distinct(F.array_compact(values))
    counted = F.transform(distinct, lambda v, i: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), i.alias("i"), v.alias("v")))
    return F.get(F.array_sort(counted), F.lit(0))["v"]
