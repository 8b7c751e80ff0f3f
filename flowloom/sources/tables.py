"""Sources and sinks: parquet tables, layered JSON document stores, journals, the void sink, and capability nodes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_documents(spark: SparkSession, folders: list[str], schema: str | StructType) -> DataFrame:
    """Documents of all folders with the layer (place in the list) they come from; see operators.ledger.layered_override."""
    layers = [spark.read.schema(schema).json(f).withColumn("layer", F.lit(k)) for k, f in enumerate(folders)]
    out = layers[0]
    for df in layers[1:]:
        out = out.unionByName(df)
    return out


def append_journal(rows: DataFrame, path: str, by: str = "run_id") -> None:
    """Adds observations to a journal, one folder for each run."""
    rows.write.mode("append").partitionBy(by).parquet(path)


def read_journal(spark: SparkSession, path: str, run_id: str, offset: int = 0) -> DataFrame:
    """A run's observations from an offset on; the run's folder and the row groups are pruned."""
    return spark.read.parquet(path).where((F.col("run_id") == run_id) & (F.col("offset") >= offset))


def void(df: DataFrame, path: str | None = None) -> int:
    """Consumes every row, keeps none, and tells how many there were, in one pass. With a path, a sink that writes."""
    seen = Observation("void")
    watched = df.observe(seen, F.count(F.lit(1)).alias("discarded"))
    if path is None:
        watched.write.format("noop").mode("overwrite").save()
    else:
        watched.write.parquet(path)
    return int(seen.get["discarded"])


def latest_documents(df: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: of each key the row with the greatest order."""
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(row, order).alias("_row")).select(key, "_row.*").select(*df.columns)


def call_each(df: DataFrame, call: Callable[[dict], str | None], column: str = "response", on_error: str = "collect") -> DataFrame:
    """A capability node (tool, HTTP, model, code): `call` gets each row as a dict and gives JSON text. It runs in the tasks,
    batch by batch, and must be safe to repeat, as tasks are. on_error: collect (text in `error`), skip, or fail_fast."""
    if on_error not in ("collect", "skip", "fail_fast"):
        raise ValueError(f"unknown on_error {on_error!r}")
    schema = StructType([*df.schema.fields]).add(column, "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for row in batch.to_pylist():
                try:
                    out.append(call(row))
                    errors.append(None)
                except Exception as e:
                    if on_error == "fail_fast":
                        raise
                    out.append(None)
                    errors.append(str(e) or type(e).__name__)
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, column, "error"])
            yield made.filter(made.column(made.num_columns - 1).is_null()) if on_error == "skip" else made

    return df.mapInArrow(run, schema)


def agent_turn(df: DataFrame, runner: Callable[[dict], str], tool: Callable[[dict], object], column: str = "response", on_error: str = "collect") -> DataFrame:
    """An agent node: `runner` gets each row and gives JSON text; where that is an object with a `tool_call`, `tool` gets it, and the runner is asked once more, with
    the row and its `tool_result`. There is one such hop; a second wish for a tool is the answer. See operators.items.auto_fixed for the parser behind it."""

    def call(row: dict) -> str | None:
        answer = runner(row)
        made = json.loads(answer) if answer is not None else None
        if isinstance(made, dict) and made.get("tool_call") is not None:
            answer = runner({**row, "tool_result": tool(made["tool_call"])})
        return answer

    return call_each(df, call, column, on_error)
