"""Network addresses as text, each kind of result by one Arrow function over Python's address types.

Null in, null out; text that is no address is an error, or null in the ``try_`` form.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StringType


def _each(make: Callable, kind: DataType, lenient: bool) -> Callable[..., Column]:
    def one(text, *more):
        import ipaddress

        if text is None or any(pd.isna(m) for m in more):
            return None
        try:
            return make(ipaddress.ip_interface(text), text, *more)
        except ValueError:
            if lenient:
                return None
            raise

    if make.__code__.co_argcount == 3:

        def run(s: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([one(a, k) for a, k in zip(s, n, strict=True)], dtype=object)
    else:

        def run(s: pd.Series) -> pd.Series:
            return pd.Series([one(a) for a in s], dtype=object)

    return F.pandas_udf(run, kind)


def _moved(own, text: str, by) -> str:
    tail = f"/{own.network.prefixlen}" if "/" in text else ""
    return f"{own.ip + int(by)}{tail}"


def _masked(address, own) -> str:
    return str(address) if own.network.prefixlen == own.max_prefixlen else f"{address}/{own.network.prefixlen}"


def _host(own, text: str) -> str:
    return text.split("/")[0]


def _family(own, text: str) -> int:
    return own.version


def _netmask(own, text: str) -> str:
    return _masked(own.netmask, own)


def _network(own, text: str) -> str:
    return _masked(own.network.network_address, own)


def _broadcast(own, text: str) -> str:
    return _masked(own.network.broadcast_address, own)


host, try_host = (_each(_host, StringType(), lenient) for lenient in (False, True))
family, try_family = (_each(_family, IntegerType(), lenient) for lenient in (False, True))
netmask, try_netmask = (_each(_netmask, StringType(), lenient) for lenient in (False, True))
network, try_network = (_each(_network, StringType(), lenient) for lenient in (False, True))
broadcast, try_broadcast = (_each(_broadcast, StringType(), lenient) for lenient in (False, True))
add, try_add = (_each(_moved, StringType(), lenient) for lenient in (False, True))


def subtract(s: Column | str, n: Column) -> Column:
    return add(s, -n)
