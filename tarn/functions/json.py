"""JSON text functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType


def extract_string(doc: Column, path: str) -> Column:
    """``doc ->> path``"""
    return F.get_json_object(doc, path)


def valid(doc: Column) -> Column:
    return F.try_parse_json(doc).isNotNull()


def keys(doc: Column) -> Column:
    return F.json_object_keys(doc)


def array_length(doc: Column) -> Column:
    return F.coalesce(F.json_array_length(doc), F.lit(0)).cast("long")


def group_array(value: Column, by: Column) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(by.alias("k"), value.alias("v"))))
    return F.to_json(F.transform(pairs, lambda s: s["v"]))


def _merge(target: object, patch: object) -> object:
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merge(out.get(k), v)
    return out


@F.pandas_udf(StringType())
def merge_patch(doc: pd.Series, patch: pd.Series) -> pd.Series:
    """RFC 7396."""
    return pd.Series(
        [
            None if a is None or b is None
            else json.dumps(_merge(json.loads(a), json.loads(b)), separators=(",", ":"), ensure_ascii=False)
            for a, b in zip(doc, patch, strict=True)
        ]
    )


@F.pandas_udf(BooleanType())
def contains(doc: pd.Series, part: pd.Series) -> pd.Series:
    """Whether ``part`` is contained in ``doc`` at any depth of arrays, and by all members in objects."""

    def held(a: object, b: object) -> bool:
        if isinstance(b, dict):
            if isinstance(a, dict) and all(k in a and held(a[k], v) for k, v in b.items()):
                return True
        elif isinstance(b, list):
            if isinstance(a, list) and all(any(held(x, y) for x in a) for y in b):
                return True
        elif a == b and type(a) is type(b):
            return True
        inner = a.values() if isinstance(a, dict) else a if isinstance(a, list) else ()
        return any(held(x, b) for x in inner)

    return pd.Series(
        [None if a is None or b is None else held(json.loads(a), json.loads(b)) for a, b in zip(doc, part, strict=True)]
    )


def _steps(path: str) -> list[str | int]:
    """The keys and places of a path ``$.a.b[0]``, ``$."a b"`` or a pointer ``/a/b/0``; a plain name is a key."""
    import re

    if path.startswith("/"):
        parts = [p.replace("~1", "/").replace("~0", "~") for p in path[1:].split("/")]
        return [int(p) if p.isdigit() else p for p in parts]
    if not path.startswith("$"):
        return [path]
    found = re.findall(r'\.(?:"([^"]*)"|([^.\[]+))|\[(#-)?(\d+)\]', path[1:])
    return [q or k if q or k else -int(i) if back else int(i) for q, k, back, i in found]


def _at(value: object, steps: list[str | int]) -> tuple[bool, object]:
    for step in steps:
        if isinstance(step, int) and isinstance(value, list) and -len(value) <= step < len(value):
            value = value[step]
        elif isinstance(value, dict) and str(step) in value:
            value = value[str(step)]
        else:
            return False, None
    return True, value


def _text(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def extract(doc: Column, *paths: str) -> Column:
    """``doc -> path`` as JSON text, null if absent; for several paths a list of them."""
    steps = [_steps(p) for p in paths]

    def run(s: pd.Series) -> pd.Series:
        def one(text: str | None):
            if text is None:
                return None
            whole = json.loads(text)
            found = [_text(v) if there else None for there, v in (_at(whole, p) for p in steps)]
            return found if len(steps) > 1 else found[0]

        return s.map(one)

    kind: DataType = ArrayType(StringType()) if len(steps) > 1 else StringType()
    return F.pandas_udf(run, kind)(doc)


def _kind(value: object) -> str:
    if isinstance(value, dict):
        return "OBJECT"
    if isinstance(value, list):
        return "ARRAY"
    return _scalar(value)


def _scalar(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "BOOLEAN"
    if isinstance(value, int):
        return "UBIGINT" if value >= 0 else "BIGINT"
    return "DOUBLE" if isinstance(value, float) else "VARCHAR"


def type_of(doc: Column, path: str = "$") -> Column:
    """``json_type``: OBJECT, ARRAY, VARCHAR, UBIGINT, BIGINT, DOUBLE, BOOLEAN or NULL; null if absent."""
    steps = _steps(path)

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            there, value = _at(json.loads(text), steps)
            return _kind(value) if there else None

        return s.map(one, na_action="ignore")

    return run(doc)


def _shape(value: object) -> object:
    if isinstance(value, dict):
        return {k: _shape(v) for k, v in value.items()}
    if isinstance(value, list):
        out: object = None
        for v in value:
            out = _joined(out, _shape(v))
        return ["NULL" if out is None else out]
    return _scalar(value)


def _joined(a: object, b: object) -> object:
    """The structure that takes values of both."""
    if a is None or a == "NULL" or a == b:
        return b
    if b == "NULL":
        return a
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _joined(a.get(k), b[k]) if k in b else a[k] for k in [*a, *(k for k in b if k not in a)]}
    if isinstance(a, list) and isinstance(b, list):
        return [_joined(a[0], b[0])]
    numbers = {"UBIGINT": 0, "BIGINT": 1, "DOUBLE": 2}
    if isinstance(a, str) and isinstance(b, str) and a in numbers and b in numbers:
        return max(a, b, key=numbers.get)
    return "JSON"


@F.pandas_udf(StringType())
def structure(doc: pd.Series) -> pd.Series:
    """``json_structure``: the types of a document's values in its own shape."""
    return doc.map(lambda t: _text(_shape(json.loads(t))), na_action="ignore")


def group_structure(df: DataFrame, keys: list[str], doc: str, name: str = "structure") -> DataFrame:
    """``json_group_structure``: one structure for all documents of a group; different ones are first counted."""
    different = df.where(F.col(doc).isNotNull()).select(*keys, structure(F.col(doc)).alias("shape")).distinct()

    @F.pandas_udf(StringType())
    def join(shapes: pd.Series) -> pd.Series:
        def one(own) -> str:
            out: object = None
            for s in sorted(own):
                out = _joined(out, json.loads(s))
            return _text(out)

        return shapes.map(one)

    return different.groupBy(*keys).agg(F.collect_list("shape").alias("shapes")).select(*keys, join("shapes").alias(name))


def transform(doc: Column, kind: str, strict: bool = False) -> Column:
    """``json_transform``: values by a DDL type, null where they do not fit; the strict form raises on text that is no JSON."""
    return F.from_json(doc, kind, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def array(*values: Column) -> Column:
    """``json_array``: values of one type."""
    return F.to_json(F.array(*values), {"ignoreNullFields": "false"})


def object_of(**fields: Column) -> Column:
    """``json_object``: null fields are kept."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def quote(value: Column) -> Column:
    """``json_quote`` / ``to_json`` of one value."""
    inner = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substr(inner, F.lit(2), F.length(inner) - 2)


def row_to_json(df: DataFrame) -> Column:
    """``row_to_json`` of all columns."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})


def group_object(key: Column, value: Column) -> Column:
    """``json_group_object``, by key; keys are unique."""
    pairs = F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))
    return F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"})
