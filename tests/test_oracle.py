"""Every registered query with an equivalent in SQL gives the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

from tarn.plans import load

SF = os.environ.get("TARN_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            path = f"{SF}/{f}"
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order]), sorted(
        (tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in ORACLE:
        assert got[0]
        return
    cur = duck.execute(ORACLE[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    odd = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    assert not odd, (got[0], len(odd), odd[:2])
