"""Math functions with the dialect's definitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def even(x: Column) -> Column:
    """The next even number away from zero."""
    return F.signum(x) * 2 * F.ceil(F.abs(x) / 2)


def trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def log(x: Column) -> Column:
    """One argument: base 10."""
    return F.log10(x)


def signbit(x: Column) -> Column:
    return (x < 0) | (x.cast("string") == "-0.0")


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, folded: 93 are enough for any two 64-bit numbers."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    steps = F.sequence(F.lit(1), F.lit(93))
    done = F.aggregate(
        steps, start,
        lambda s, _: F.struct(
            F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"),
            F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["a"], s["b"])).alias("b"),
        ),
    )
    return done["a"]


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise((F.abs(a) / g).cast("long") * F.abs(b))


def fdiv(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def fmod(a: Column, b: Column) -> Column:
    return a - b * F.floor(a / b)


@F.pandas_udf(DoubleType())
def gamma(x: pd.Series) -> pd.Series:
    import math

    return x.map(math.gamma, na_action="ignore")


@F.pandas_udf(DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    import math

    return x.map(math.lgamma, na_action="ignore")


@F.pandas_udf(DoubleType())
def nextafter(x: pd.Series, y: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series(np.nextafter(x.astype("float64"), y.astype("float64")))


def isinf(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def isfinite(x: Column) -> Column:
    return ~F.isnan(x) & ~isinf(x)


def bitwise_not(x: Column) -> Column:
    return F.bitwise_not(x)
