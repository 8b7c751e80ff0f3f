"""Operators on items: rows in an observable order.

An item's order is the column ORD, a key that is unique and stable (from the source, never from the partitioning).
`paired_item` is the ORD of the item that a row came from. Positions 0, 1, 2, ... are made only where a result needs them
(positions()), as they take a sort of all rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from flowloom.functions.values import at_path, port_name, truthy
from flowloom.sources.staging import staged

ORD, PAIRED = "ord", "paired_item"


def as_items(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(ORD, F.col(key).cast("long"))


def transform_set(items: DataFrame, sets: Mapping[str, Column]) -> DataFrame:
    """Sets columns; all expressions see the item as it was. Rows stay paired with themselves."""
    return items.withColumns({**sets, PAIRED: F.col(ORD)})


def first_item(items: DataFrame, value: Column, name: str = "first") -> DataFrame:
    """One row: the value of the first item, null without items. An aggregate, so no sort."""
    return items.agg(F.min_by(value, F.col(ORD)).alias(name))


def condition(items: DataFrame, value: Column, kind, port: bool, first: DataFrame | None = None) -> DataFrame:
    """The first item decides for the whole batch; all items go on by port true or false (false without items). `first` is that item, where it is known
    without the others, so that costly columns aren't made twice."""
    decided = first_item(items if first is None else first, truthy(value, kind), "_port").select(F.coalesce("_port", F.lit(False)).alias("_port"))
    return items.crossJoin(F.broadcast(decided.where(F.col("_port") == port))).drop("_port")


def switch(items: DataFrame, value: Column, kind) -> DataFrame:
    """All items, with the port that the first item names."""
    decided = first_item(items, value, "_value").select(port_name(F.col("_value"), kind).alias("port"))
    return items.crossJoin(F.broadcast(decided))


def split_out(items: DataFrame, column: str, path: str = "", into: str = "value") -> DataFrame:
    """One item for each element of the array at a path; a value that is no array, or missing, gives one item; an empty
    array gives none. `element` is the place in the array."""
    kind = items.schema[column].dataType
    value = at_path(F.col(column), path, kind) if path else F.col(column)
    if isinstance(items.select(value.alias("v")).schema["v"].dataType, ArrayType):
        many = F.when(value.isNull(), F.array(F.lit(None))).otherwise(value)
    else:
        many = F.array(value)
    return items.select("*", F.posexplode(many).alias("element", into)).withColumn(PAIRED, F.col(ORD))


def merge(*inputs: DataFrame) -> DataFrame:
    """Items of all inputs, in the inputs' order, then in their own; missing columns are null."""
    out = None
    for k, df in enumerate(inputs):
        df = df.withColumn("input", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def positions(df: DataFrame, *order: str, into: str = "position") -> DataFrame:
    """Places from 0 in a total order: rows are range-partitioned and counted, and each partition starts where those before
    it end; no task sees more than its range."""
    ranged = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "positions")
    sizes = ranged.groupBy("_part").count()  # a row for each partition
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "_part").withColumn(into, (local + F.col("_before")).cast("long")).drop("_part", "_before")


def null_bindings(sets: Mapping[str, Column]) -> Column:
    """Names of expressions that came to null, in the order given, as an array."""
    return F.array_compact(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in sets.items()]))


def with_errors(items: DataFrame, value: Column, failed: Column, message: Column, on_error: str = "collect", into: str = "value") -> DataFrame:
    """What a per-item call gives: collect (rows with error and failed), skip, or fail_fast (the error of the lowest ORD is raised)."""
    made = items.withColumn(into, F.when(~failed, value)).withColumn("error", F.when(failed, message)).withColumn("failed", F.coalesce(failed, F.lit(False)))
    if on_error == "skip":
        return made.where(~F.col("failed")).drop("error", "failed")
    if on_error == "fail_fast":
        first = made.agg(F.min_by("error", F.when(F.col("failed"), F.col(ORD))).alias("_error"))
        checked = made.crossJoin(F.broadcast(first)).where(F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error")).cast("boolean")).otherwise(F.lit(True)))
        return checked.drop("_error", "error", "failed")
    if on_error != "collect":
        raise ValueError(f"unknown on_error {on_error!r}")
    return made


def schema_errors(schema: dict, column: Column, kind, path: str = "$") -> list[Column]:
    """Of the keywords enum, type, required, properties and items: a text for each breach, null where there is none."""
    out = []
    if "enum" in schema:
        out.append(F.when(~F.coalesce(column.isin([x for x in schema["enum"] if x is not None]), F.lit(None in schema["enum"])), F.lit(f"{path}: not one of the values")))
    if "type" in schema:
        allowed = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        name = {"string": "string", "boolean": "boolean", "array": "array", "struct": "object", "map": "object"}.get(kind.typeName(), "number")
        fits = column.isNotNull() & F.lit(name in allowed) if not (name == "number" and "integer" in allowed and "number" not in allowed) else column.isNotNull() & (column % 1 == 0)
        fits = fits | (column.isNull() & F.lit("null" in allowed))
        out.append(F.when(~fits, F.lit(f"{path}: not of type {'|'.join(allowed)}")))
    fields = {f.name: f.dataType for f in getattr(kind, "fields", [])}
    for key in schema.get("required", []):
        missing = column.getField(key).isNull() if key in fields else F.lit(True)
        out.append(F.when(column.isNotNull() & missing, F.lit(f"{path}.{key}: missing")))
    for key, inner in schema.get("properties", {}).items():
        if key in fields:
            out += [F.when(column.getField(key).isNotNull(), e) for e in schema_errors(inner, column.getField(key), fields[key], f"{path}.{key}")]
    if "items" in schema and isinstance(kind, ArrayType):
        inner = lambda x: F.coalesce(*schema_errors(schema["items"], x, kind.elementType, f"{path}[]"), F.lit(None).cast("string"))
        out.append(F.get(F.filter(F.transform(column, inner), lambda e: e.isNotNull()), F.lit(0)))
    return out


def validated(items: DataFrame, schema: dict, columns: list[str], on_error: str = "collect") -> DataFrame:
    """`errors` (an array of texts) and `valid`; on_error fail raises the first."""
    whole = items.select("*", F.struct(*columns).alias("_whole"))
    errors = F.array_compact(F.array(*schema_errors(schema, F.col("_whole"), whole.schema["_whole"].dataType)))
    out = whole.withColumn("errors", errors).drop("_whole").withColumn("valid", F.size("errors") == 0)
    if on_error == "fail":
        out = out.where(F.when(~F.col("valid"), F.raise_error(F.col("errors")[0]).cast("boolean")).otherwise(F.lit(True)))
    return out


def auto_fixed(items: DataFrame, schema: dict, columns: list[str], fix: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """`validated`, with one try to repair: rows that breach the schema go through `fix` (a node that gives the same columns back; it sees `errors`, and
    sources.tables.call_each makes one of a model's call) and are validated once more. `fixed` tells which were repaired; what still
    breaches it keeps its errors. Without `fix` nothing is tried."""
    first = validated(items, schema, columns)
    if fix is None:
        return first.withColumn("fixed", F.lit(False))
    first = staged(first, "validated")
    again = validated(fix(first.where(~F.col("valid"))).select(*items.columns), schema, columns)
    return first.where("valid").withColumn("fixed", F.lit(False)).unionByName(again.withColumn("fixed", F.col("valid")))
