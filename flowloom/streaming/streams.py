"""Structured Streaming: journals as sources, windows with watermarks, duplicates, and first-in-first-out latencies as a
stateful operator. State is keyed and timed out by the watermark, so it stays bounded."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from flowloom.sources.staging import shared_folder


def tail(spark: SparkSession, path: str, schema: StructType, files_a_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder (or glob) as a stream."""
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


def window_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Tumbling windows; rows later than `late` behind the newest are dropped and their state let go."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def first_of_each(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Drops rows whose keys were seen no longer than `late` ago; keys are forgotten after that."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def latencies(stream: DataFrame, keys: list[str], seq: str, time: str, started: str, late: str) -> DataFrame:
    """Each end paired with the oldest open start of its key. `started` is a boolean column. Rows of a key are taken in the
    order of seq within a batch; open starts wait in the state until the watermark has passed them by `late` once more."""
    schema = StructType([stream.schema[k] for k in keys]).add("seq", "long").add("elapsed_ms", "long")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        waiting = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(seq)
        out = []
        for n, at, start in zip(rows[seq], rows["_ms"], rows[started]):
            if start:
                waiting.append(int(at))
            elif waiting:
                out.append((*key, int(n), max(int(at) - waiting.pop(0), 0)))
        state.update((waiting,))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(int(rows["_ms"].max()), mark) + int(pd.Timedelta(late).total_seconds() * 1000) + 1)
        yield pd.DataFrame(out, columns=[*keys, "seq", "elapsed_ms"])

    timed = stream.withColumn("_ms", F.unix_millis(F.col(time))).withWatermark(time, late)
    return timed.groupBy(*keys).applyInPandasWithState(step, schema, "waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def to_table(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Runs a stream over all that is there, writes every batch (exactly once for each batch number) and reads the result:
    column `batch` tells which one a row comes from. A restart goes on from the checkpoint in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/flowloom/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={k}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields]).add("batch", "long")).parquet(f"{at}/rows")
