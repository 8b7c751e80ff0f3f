"""Texts of flow definitions: expressions, bindings, quoted literals, pasted values, prose."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the expression language that are no prose.
_BINDING = r"^=nodes\.([A-Za-z_][A-Za-z0-9_]*)\.item(\.json(?=\.))?\.([A-Za-z_][A-Za-z0-9_.]*)"
KEYWORDS = "and or not if then elif else end as def reduce foreach try catch import include label".split()


def is_expression(c: Column) -> Column:
    return F.startswith(c, F.lit("="))


def quoted_literals(c: Column) -> Column:
    """What stands between double quotes, with escapes undone; an open quote at the end is none."""
    raw = F.regexp_extract_all(F.regexp_replace(c, r'^[^"]+', ""), F.lit(r'(?s)"((?:[^"\\]|\\.)*)"'), F.lit(1))
    plain = lambda x: F.aggregate(
        F.regexp_extract_all(x, F.lit(r"(?s)(\\.|[^\\])"), F.lit(1)),
        F.lit(""),
        lambda s, ch: F.concat(s, F.when(F.char_length(ch) == 1, ch).when(ch == "\\n", "\n").when(ch == "\\t", "\t").when(ch == "\\r", "\r").otherwise(F.substring(ch, 2, 1))),
    )
    return F.transform(raw, plain)


def pasted(leaf: Column, value: Column) -> Column:
    """Whether a value was written into a text of a definition: anywhere in plain text, in a quoted literal of an expression."""
    return F.when(is_expression(leaf), F.exists(quoted_literals(leaf), lambda x: F.contains(x, value))).otherwise(F.contains(leaf, value))


def node_binding(c: Column) -> Column:
    """Of =nodes.<id>.item[.json].<path>: node_id, through_envelope and field_path; null for any other expression."""
    found = lambda k: F.regexp_extract(c, _BINDING, k)
    made = F.struct(found(1).alias("node_id"), (found(2) != "").alias("through_envelope"), F.regexp_replace(found(3), r"\.+$", "").alias("field_path"))
    return F.when(c.rlike(_BINDING), made)


def reads_as_prose(body: Column) -> Column:
    """Whether two words of letters alone stand next to each other outside of string literals, none of them a keyword."""
    bare = F.regexp_replace(F.regexp_replace(body, r'(?s)"(?:[^"\\]|\\.)*"?', ""), r"^\s+", "")
    core = lambda t: F.regexp_replace(F.regexp_replace(t, r"^[^A-Za-z]+", ""), r"[^A-Za-z]+$", "")
    is_word = lambda t: core(t).rlike("^[A-Za-z]+$") & ~F.contains(t, F.lit(".")) & ~F.lower(core(t)).isin(KEYWORDS)
    marks = F.array_join(F.transform(F.split(bare, r"\s+"), lambda t: F.when(is_word(t), "1").otherwise("0")), "")
    return F.contains(marks, F.lit("11"))


def expressions(nodes: DataFrame, node: str = "id", config: str = "config") -> DataFrame:
    """(node, location, expression): every expression text in a node's config (JSON text), with its dotted place. Configs are nested to any
    depth, so each is walked in the tasks."""

    def walk(value, at: str) -> Iterator[tuple[str, str]]:
        rows = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for key, child in rows:
            yield from walk(child, f"{at}.{key}" if at else str(key))
        if isinstance(value, str) and value.startswith("="):
            yield at, value

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(k, *x) for k, c in zip(part["node"], part["config"]) if c is not None for x in walk(json.loads(c), "")]
            yield pd.DataFrame(found, columns=["node", "location", "expression"])

    kind = nodes.schema[node].dataType.simpleString()
    return nodes.select(F.col(node).alias("node"), F.col(config).alias("config")).mapInPandas(run, f"node {kind}, location string, expression string")
