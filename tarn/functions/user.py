"""User-defined scalar, aggregate and table functions, and macros."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scalar(f: Callable, kind) -> Callable[..., Column]:
    """A vectorised scalar function over pandas series."""
    return F.pandas_udf(f, kind)


def aggregate(df: DataFrame, keys: list[str], columns: list[str], start, update: Callable, combine: Callable, finish: Callable, schema: str) -> DataFrame:
    """An aggregate of the user's: states are updated per partition, combined per key, and finished.

    Only one pickled state per key and partition is shuffled.
    """
    import pickle

    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for batch in batches:
            for row in batch[keys + columns].itertuples(index=False, name=None):
                k = row[: len(keys)]
                states[k] = update(states.get(k, start), *row[len(keys) :])
        yield pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*keys, "state"])

    def final(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = start
        for s in frame["state"]:
            total = combine(total, pickle.loads(s))
        return pd.DataFrame([(*key, *finish(total))])

    states = df.mapInPandas(partial, f"{key_types}, state binary")
    return states.groupBy(*keys).applyInPandas(final, f"{key_types}, {schema}")


def macro(spark: SparkSession, name: str, parameters: str, returns: str, body: str, table: bool = False) -> None:
    """CREATE MACRO as a temporary SQL function; ``table`` for one that returns a query's rows."""
    kind = f"TABLE({returns})" if table else returns
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
