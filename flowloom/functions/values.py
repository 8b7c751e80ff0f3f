"""JSON-style values as Spark columns: truthiness, paths, arithmetic without errors, order across types, envelopes.

Typed columns are preferred; a VARIANT is for values whose schema is unknown. All functions return columns, so Catalyst
prunes and pushes them down; nothing here is a Python UDF but fnv1a64 and nested_key."""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, IntegralType, MapType, NumericType, StringType, StructType, VariantType


def type_of(df: DataFrame, column: str) -> DataType:
    return df.schema[column].dataType


def truthy(c: Column, kind: DataType) -> Column:
    """Item truthiness: null, false, 0, "", [] and {} are not."""
    if isinstance(kind, BooleanType):
        found = c
    elif isinstance(kind, NumericType):
        found = c != 0
    elif isinstance(kind, StringType):
        found = c != ""
    elif isinstance(kind, ArrayType | MapType):
        found = F.size(c) > 0
    elif isinstance(kind, VariantType):
        text = F.to_json(c)
        found = ~F.is_variant_null(c) & ~text.isin("false", '""', "[]", "{}") & (F.startswith(text, F.lit('"')) | (F.coalesce(F.try_variant_get(c, "$", "double"), F.lit(1.0)) != 0))
    elif isinstance(kind, StructType):
        found = F.lit(len(kind.fields) > 0) & c.isNotNull()
    else:
        found = c.isNotNull()
    return F.coalesce(found, F.lit(False))


def holds(c: Column, kind: DataType) -> Column:
    """The expression language's own truthiness: only null and false are not."""
    return F.coalesce(c, F.lit(False)) if isinstance(kind, BooleanType) else c.isNotNull()


def at_path(c: Column, path: str, kind: DataType, cast: str = "string") -> Column:
    """A dotted walk by keys; what is missing is null. Arrays aren't indexed by a walk."""
    if isinstance(kind, VariantType):
        return F.try_variant_get(c, "$." + path, cast)
    if isinstance(kind, StringType):
        return F.get_json_object(c, "$." + path)
    for key in path.split("."):
        if isinstance(kind, MapType):
            c, kind = F.try_element_at(c, F.lit(key)), kind.valueType
        elif isinstance(kind, StructType) and key in kind.fieldNames():
            c, kind = c.getField(key), kind[key].dataType
        else:
            return F.lit(None)
    return c


def element(c: Column, k: int) -> Column:
    """The k-th element from 0, from the end if negative; null where there is none."""
    return F.get(c, F.lit(k)) if k >= 0 else F.try_element_at(c, F.lit(k))


def total(c: Column, kind: DataType | None = None) -> Column:
    """Sum of an array, nulls counting nothing; of an empty array, or of nulls alone, null. By the type of its elements: whole numbers stay whole
    (null where they leave 64 bits), strings and arrays are joined; without a type they are taken as double numbers."""
    some = F.filter(c, lambda x: x.isNotNull())
    if isinstance(kind, StringType):
        made = F.array_join(some, "")
    elif isinstance(kind, ArrayType):
        made = F.flatten(some)
    elif isinstance(kind, IntegralType):
        made = F.aggregate(some, F.lit(0).cast("long"), lambda s, x: F.try_add(s, x.cast("long")))
    else:
        made = F.aggregate(some, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(F.size(some) > 0, made)


def first_where(c: Column, keep) -> Column:
    """The first element for which `keep` holds, null if there is none."""
    return F.get(F.filter(c, keep), F.lit(0))


def port_name(c: Column, kind: DataType) -> Column:
    """A scalar's text names a port; null, arrays and objects go to `default`."""
    if isinstance(kind, ArrayType | MapType | StructType):
        return F.lit("default")
    return F.coalesce(c.cast("string"), F.lit("default"))


def order_key(c: Column) -> Column:
    """Of a VARIANT: a struct that sorts null < false < true < numbers < strings < arrays < objects; strings by code point, arrays
    element by element, objects by their sorted keys and then by the values of these."""
    text, number, flag = F.to_json(c), F.try_variant_get(c, "$", "double"), F.try_variant_get(c, "$", "boolean")
    start = F.substring(text, 1, 1)
    rank = (
        F.when(c.isNull() | F.is_variant_null(c), 0).when(text == "false", 1).when(text == "true", 2).when(start == '"', 4).when(start == "[", 5).when(start == "{", 6).otherwise(3)
    )
    string = F.when(rank == 4, F.try_variant_get(c, "$", "string"))
    return F.struct(rank.alias("rank"), F.when(rank == 3, number).alias("number"), string.alias("text"), F.when(rank <= 2, flag).alias("flag"), nested_key(F.when(rank >= 5, text)).alias("nested"))


def ordered_bytes(value) -> bytes:
    """Of a JSON value: bytes that sort as order_key has it."""
    if value is None:
        return b"\1"
    if isinstance(value, bool):
        return b"\3" if value else b"\2"
    if isinstance(value, int | float):
        try:
            bits = struct.unpack(">Q", struct.pack(">d", value + 0.0))[0]
        except OverflowError:
            bits = struct.unpack(">Q", struct.pack(">d", float("inf") if value > 0 else float("-inf")))[0]
        return b"\4" + struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))
    if isinstance(value, str):
        return b"\5" + value.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\1") + b"\0\0"
    if isinstance(value, list):
        return b"\6" + b"".join(map(ordered_bytes, value)) + b"\0"
    keys = sorted(value)
    return b"\7" + ordered_bytes(keys) + b"".join(ordered_bytes(value[k]) for k in keys)


@F.pandas_udf(BinaryType())
def nested_key(texts: pd.Series) -> pd.Series:
    """ordered_bytes of JSON texts; null for null. For arrays and objects, whose depth no column expression can follow."""
    import json

    return pd.Series([None if t is None else ordered_bytes(json.loads(t)) for t in texts], dtype=object)


def envelope(raw: Column) -> Column:
    """JSON text as {json, text, raw}: json is null unless an object or array; text is a string itself, or an object's `text`."""
    v = F.try_parse_json(raw)
    start = F.substring(F.to_json(v), 1, 1)
    return F.struct(
        F.when(start.isin("{", "["), F.to_json(v)).alias("json"),
        F.when(start == '"', F.try_variant_get(v, "$", "string")).when(start == "{", F.try_variant_get(v, "$.text", "string")).alias("text"),
        raw.alias("raw"),
    )


def bounded(c: Column, most: int) -> Column:
    """At most `most` UTF-8 bytes of a text, never half a character."""
    cut = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, most).cast("string"))  # half a character becomes a replacement character
    whole = F.when(F.startswith(c, cut), cut).otherwise(F.regexp_replace(cut, "\ufffd$", ""))
    return F.when(F.octet_length(c) <= most, c).otherwise(whole)


def glob(c: Column, pattern: str) -> Column:
    """Whether all of a text matches a pattern in which * stands for anything. Each piece between stars takes its first
    place and keeps it, so a*b doesn't match axbxb."""
    first, *others = pattern.split("*")
    body = re.escape(first) + "".join(f"(?>.*?{re.escape(p)})" for p in others if p)
    return c.rlike("(?s)^" + body + (".*" if others and not others[-1] else "") + "\\z")


def rounded(c: Column, places: int) -> Column:
    return F.round(c, places)


@F.pandas_udf(StringType())
def fnv1a64(texts: pd.Series) -> pd.Series:
    """The 64-bit FNV-1a digest of UTF-8 text, as 16 hexadecimal digits."""

    known = texts.dropna()
    raw = [t.encode() for t in known]
    sizes = np.array([len(t) for t in raw], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")  # all texts advance together, a byte at a time; those that have ended come last
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    starts = (np.cumsum(sizes) - sizes)[order]
    longer = len(raw) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max(initial=0))), side="right")
    h = np.full(len(raw), 0xCBF29CE484222325, dtype=np.uint64)
    for k, n in enumerate(longer.tolist()):
        h[:n] = (h[:n] ^ data[starts[:n] + k]) * np.uint64(0x100000001B3)
    back = np.empty(len(raw), dtype=object)
    back[order] = [f"{x:016x}" for x in h.tolist()]
    return pd.Series(back, index=known.index, dtype=object).reindex(texts.index)
