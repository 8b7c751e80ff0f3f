"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.sources.staging import staged


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches between Spark and Python small, as texts may be long; sets the session's limit if it is larger."""
    limit = int(str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).removesuffix("b"))
    if limit <= 0 or limit > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: a staged table, packed, as it may hold texts and vectors. Lost executors cost a reread."""
    bounded_batches(df.sparkSession)
    return staged(df, name, "zstd")


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as strings without nulls; null texts count as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if pa.types.is_large_string(col.type) or pa.types.is_string_view(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string array as one uint8 array, and the offsets of each."""
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, or one row where that is longer; bounds the numpy arrays made from a batch."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def bounded_broadcast(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A broadcast hint only where a count proves that df is small; otherwise the join shuffles. For tables that are cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def one_text_each(docs: DataFrame, sample: DataFrame, text: str = "text") -> DataFrame:
    """sample (doc_id, ...: few rows, one for each doc_id) with a text of that document in column text: of several the one with the smallest
    hash, so a doc_id that very many rows share is one row. Ids without a document are left out."""
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample.select("doc_id")), "doc_id")
    return texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).join(F.broadcast(sample), "doc_id").select("doc_id", F.col("t.text").alias("text"), *[c for c in sample.columns if c != "doc_id"])
