"""List, map, struct, union, enum and bit-string functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(xs: Column, i: int) -> Column:
    """From 1, negative from the end, null beyond."""
    return F.try_element_at(xs, F.lit(i)) if i else F.lit(None)


def concat_lists(a: Column, b: Column) -> Column:
    """A null list counts as absent; two null lists give null."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def resize(xs: Column, n: int, fill: Column) -> Column:
    return F.slice(F.concat(xs, F.array_repeat(fill, n)), 1, n)


def select(xs: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.try_element_at(xs, i.cast("int")))


def where(xs: Column, mask: Column) -> Column:
    kept = F.filter(F.arrays_zip(xs.alias("x"), mask.alias("m")), lambda s: s["m"])
    return F.transform(kept, lambda s: s["x"])


def slice_step(xs: Column, begin: int, end: int, step: int) -> Column:
    own = F.slice(xs, begin, end - begin + 1)
    return F.filter(own, lambda x, i: i % step == 0)


def grade_up(xs: Column) -> Column:
    """The 1-based places of the values in sorted order."""
    pairs = F.transform(xs, lambda x, i: F.struct(x.alias("x"), (i + 1).cast("long").alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"])


def distinct(xs: Column) -> Column:
    return F.array_distinct(F.array_compact(xs))


def unique(xs: Column) -> Column:
    return F.size(distinct(xs)).cast("long")


def reduce(xs: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Fold from the first element."""
    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, F.lit(0)), f)


def total(xs: Column, kind: str = "double") -> Column:
    """Null for an empty list."""
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0).cast(kind), lambda t, x: t + x.cast(kind)))


def mean(xs: Column) -> Column:
    return total(xs) / F.size(xs)


def inner_product(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(total(d))


def cosine_similarity(a: Column, b: Column) -> Column:
    return inner_product(a, b) / (F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b)))


def cross_product(a: Column, b: Column) -> Column:
    def x(v: Column, i: int) -> Column:
        return F.get(v, F.lit(i))

    turns = ((1, 2), (2, 0), (0, 1))
    return F.array(*(x(a, i) * x(b, j) - x(a, j) * x(b, i) for i, j in turns))


def map_extract(m: Column, key: Column) -> Column:
    """A list of the value, empty if the key is absent."""
    value = F.try_element_at(m, key)
    return F.when(F.map_contains_key(m, key), F.array(value)).otherwise(F.array().cast("array<string>"))


def range_list(start: Column, stop: Column, step: int = 1) -> Column:
    """Without the end."""
    full = F.sequence(start, F.greatest(stop - 1, start), F.lit(step))
    return F.when(start >= stop, F.slice(full, 1, 0)).otherwise(full)


def union_value(tag: str, value: Column, members: dict[str, str]) -> Column:
    """A tagged union as a struct of the tag and one field per member."""
    fields = [(value if m == tag else F.lit(None)).cast(kind).alias(m) for m, kind in members.items()]
    return F.struct(F.lit(tag).alias("tag"), *fields)


def union_extract(u: Column, tag: str) -> Column:
    return F.when(u["tag"] == tag, u[tag])


class Enum:
    """An enumeration: text with an order of its own."""

    def __init__(self, *values: str):
        self.values = values

    def literal(self) -> Column:
        return F.array(*map(F.lit, self.values))

    def code(self, x: Column) -> Column:
        return (F.array_position(self.literal(), x) - 1).cast("int")

    def first(self) -> str:
        return self.values[0]

    def last(self) -> str:
        return self.values[-1]

    def range(self, start: str | None = None, end: str | None = None) -> list[str]:
        a = self.values.index(start) if start else 0
        b = self.values.index(end) if end else len(self.values) - 1
        return list(self.values[a : b + 1])


def get_bit(bits: Column, i: int) -> Column:
    return F.substring(bits, i + 1, 1).cast("int")


def set_bit(bits: Column, i: int, value: int) -> Column:
    return F.overlay(bits, F.lit(str(value)), F.lit(i + 1), F.lit(1))


def bit_position(part: Column, bits: Column) -> Column:
    return F.locate(part, bits) if isinstance(part, str) else F.call_function("instr", bits, part)


def bitstring(bits: Column, n: int) -> Column:
    return F.lpad(bits, n, "0")


def first_of(values: Sequence[str], x: Column) -> Column:
    return x.isin(list(values))


def struct_insert(s: Column, fields: Sequence[str], **added: Column) -> Column:
    """A struct with more fields; ``fields`` are those it has."""
    named = [(f, s[f]) for f in fields] + list(added.items())
    return F.named_struct(*(x for n, c in named for x in (F.lit(n), c)))


def row(*values: Column) -> Column:
    """An unnamed struct: fields by position."""
    return F.named_struct(*(x for i, v in enumerate(values, 1) for x in (F.lit(f"_{i}"), v)))


def array_value(*values: Column) -> Column:
    return F.array(*values)


def map_entries(m: Column) -> Column:
    """Structs of key and value, in the map's order."""
    return F.map_entries(m)


def zip_lists(*xs: Column, truncate: bool = False) -> Column:
    """Structs of the values at each place; shorter lists are padded with nulls, or all cut to the shortest."""
    zipped = F.arrays_zip(*(x.alias(f"_{i}") for i, x in enumerate(xs, 1)))
    return F.slice(zipped, F.lit(1), F.least(*map(F.size, xs))) if truncate else zipped


def subscripts(xs: Column) -> Column:
    """``generate_subscripts``: 1 to the length, nothing for an empty list."""
    return F.transform(xs, lambda x, i: (i + 1).cast("int"))


def push_front(xs: Column, x: Column) -> Column:
    return F.concat(F.array(x), xs)


def push_back(xs: Column, x: Column) -> Column:
    return F.concat(xs, F.array(x))


def pop_front(xs: Column) -> Column:
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0)))


def pop_back(xs: Column) -> Column:
    return F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0)))


def intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def has_all(xs: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, xs)) == 0


def slice_any(xs: Column, begin: int, end: int) -> Column:
    """``l[begin:end]``, both inclusive, from 1, negative from the end; nothing if they cross."""
    n = F.size(xs)
    first = F.greatest(F.lit(begin) if begin >= 0 else n + begin + 1, F.lit(1))
    last = F.least(F.lit(end) if end >= 0 else n + end + 1, n)
    return F.slice(xs, first, F.greatest(last - first + 1, F.lit(0)))
