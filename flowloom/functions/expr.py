"""The expression language's functions on objects, arrays and strings, as Spark columns.

Objects are maps or structs; arrays are typed. What would be an error is null. Where a function can give several values
(range, limit, paths, ...), the array of them is returned; an expression's own value is the first (first_of)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

Fn = Callable[[Column], Column]


def first_of(values: Column) -> Column:
    return F.get(values, F.lit(0))


def alternative(a: Column, b: Column, a_is_flag: bool = False) -> Column:
    """a // b: a unless it is null or false."""
    return F.when(a.isNotNull() & (a if a_is_flag else F.lit(True)), a).otherwise(b)


def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def has(m: Column, key: Column) -> Column:
    return F.map_contains_key(m, key)


def to_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def from_entries(entries: Column) -> Column:
    """Of entries with one key the last stays."""
    last = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + 2, F.greatest(F.size(entries) - k - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def with_entries(m: Column, f: Fn) -> Column:
    return from_entries(F.transform(F.map_entries(m), f))


def contains_all(a: Column, b: Column) -> Column:
    """Every element of b is in a."""
    return F.size(F.array_except(b, a)) == 0


def sort_by(values: Column, by: Fn) -> Column:
    """By a key, equal ones in the order they had."""
    keyed = F.transform(values, lambda x, k: F.struct(by(x).alias("by"), k.alias("at"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda e: e["x"])


def group_by(values: Column, by: Fn) -> Column:
    """Groups as arrays, in the order of their keys."""
    groups = F.array_sort(F.array_distinct(F.transform(values, by)))
    return F.transform(groups, lambda g: F.filter(values, lambda x: by(x).eqNullSafe(g)))


def unique_by(values: Column, by: Fn) -> Column:
    """The first of each key, in the order of the keys."""
    return F.transform(group_by(values, by), first_of)


def min_by(values: Column, by: Fn) -> Column:
    return first_of(sort_by(values, by))


def max_by(values: Column, by: Fn) -> Column:
    """Of equal ones the last."""
    return F.try_element_at(sort_by(values, by), F.lit(-1))


def limit(values: Column, n: int) -> Column:
    return F.slice(values, 1, max(n, 0))


def numbers(start: int, stop: Column) -> Column:
    """range(start; stop)."""
    return F.when(stop > start, F.sequence(F.lit(start).cast("long"), (stop - 1).cast("long"))).otherwise(F.array().cast("array<long>"))


def indices(values: Column, x: Column) -> Column:
    return F.filter(F.transform(values, lambda v, k: F.when(v == x, k.cast("long"))), lambda k: k.isNotNull())


def reduce(values: Column, start: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, start, f)


def running(values: Column, start: Column, f: Callable[[Column, Column], Column]) -> Column:
    """foreach: the state after each element."""
    return F.transform(values, lambda _, k: F.aggregate(F.slice(values, F.lit(1), k + 1), start, f))


def ltrimstr(s: Column, prefix: str) -> Column:
    return F.when(F.startswith(s, F.lit(prefix)), F.substring(s, len(prefix) + 1, 1 << 30)).otherwise(s)


def rtrimstr(s: Column, suffix: str) -> Column:
    return F.when(F.endswith(s, F.lit(suffix)) & F.lit(bool(suffix)), F.substr(s, F.lit(1), F.char_length(s) - len(suffix))).otherwise(s)


def pieces(s: Column, separator: str) -> Column:
    """split/1: by a plain text; no text has no pieces."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, F.lit("\\Q" + separator + "\\E"), -1))


def joined(values: Column, separator: str) -> Column:
    return F.array_join(F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit(""))), separator)


def to_number(s: Column) -> Column:
    return s.try_cast("double")


def code_points(s: Column) -> Column:
    """explode: the characters' code points."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))


def from_code_points(codes: Column) -> Column:
    """implode; null where a number is no character."""
    good = F.forall(codes, lambda k: k.between(0, 0xD7FF) | k.between(0xE000, 0x10FFFF))
    return F.when(good, F.array_join(F.transform(codes, lambda k: F.decode(F.unhex(F.lpad(F.hex(k), 8, "0")), "UTF-32")), ""))


def type_name(c: Column) -> Column:
    """Of a VARIANT: null, boolean, number, string, array or object."""
    text = F.to_json(c)
    start = F.substring(text, 1, 1)
    return F.when(c.isNull() | F.is_variant_null(c), "null").when(text.isin("true", "false"), "boolean").when(start == '"', "string").when(start == "[", "array").when(start == "{", "object").otherwise("number")


def flattened(values: Column) -> Column:
    """flatten(1): one level of arrays in an array; null elements are left out."""
    return F.flatten(F.filter(values, lambda x: x.isNotNull()))


def nth(values: Column, k: int) -> Column:
    """The k-th value from 0; null for a negative k or where there is none."""
    return F.get(values, F.lit(k)) if k >= 0 else F.get(values, F.size(values))


def last_of(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def inside(a: Column, b: Column) -> Column:
    """Whether b contains a: text in a text."""
    return F.contains(b, a)


def within(key: Column, m: Column) -> Column:
    """in: whether an object has the key."""
    return F.map_contains_key(m, key)


def until(start: Column, done: Fn, step: Fn, most: int) -> Column:
    """The first of start, step(start), ... for which `done` holds; null if it is none of the first `most` steps."""
    found = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, lambda x, _: F.when(F.coalesce(done(x), F.lit(False)), x).otherwise(step(x)))
    return F.when(done(found), found)


def to_json_text(c: Column) -> Column:
    """tojson, of a VARIANT."""
    return F.when(c.isNull() | F.is_variant_null(c), "null").otherwise(F.to_json(c))


def from_json_text(text: Column) -> Column:
    """fromjson: a VARIANT; null for what is no JSON."""
    return F.try_parse_json(text)


@F.pandas_udf(ArrayType(StringType()))
def value_paths(texts: pd.Series) -> pd.Series:
    """paths: of a JSON text all places below it, each as its keys and indexes joined by dots, parents before children. `..` is the text and what lies there."""

    def below(value, at: str) -> Iterator[str]:
        rows = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for key, child in rows:
            path = f"{at}.{key}" if at else str(key)
            yield path
            yield from below(child, path)

    def places(t: str | None) -> list[str] | None:
        if t is None:
            return None
        try:
            return list(below(json.loads(t), ""))
        except ValueError:
            return None

    return texts.map(places)
