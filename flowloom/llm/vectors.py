"""What the operators on embeddings share: valid vectors, their scale and length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(col: pa.Array, kind: str = "<f8") -> np.ndarray:
    """Rows of a list or binary column (its bytes are of that kind) whose entries all have one length, as float64."""
    if pa.types.is_binary(col.type):
        size = col.buffers()[2]
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
        return np.frombuffer(size, dtype=np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(col), -1).astype(np.float64, copy=False)
    return np.asarray(col.flatten()).astype(np.float64).reshape(len(col), -1)


def narrowest(vectors: DataFrame, embedding: str = "embedding") -> str:
    """The kind of number that holds every component as it is: floats stay floats, at half the bytes."""
    return "<f4" if vectors.select(embedding).dtypes[0][1] == "array<float>" else "<f8"


def valid_vectors(vectors: DataFrame, embedding: str = "embedding", row_id: str = "vec_id", kind: str = "<f8") -> DataFrame:
    """(id, vec, dim): vec the components as bytes of that kind. Rows with a null id, and vectors that are null, empty, zero or
    hold null or non-finite components are left out; -0.0 counts as 0.0. Components may be as small or large as doubles are."""

    number = pa.float32() if kind == "<f4" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1)
            flat, sizes = rows.flatten(), rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = np.asarray(flat.cast(number).fill_null(np.nan)) + number.to_pandas_dtype()(0)
            ends = np.cumsum(sizes)
            out_ids, out = [], []
            for k, i in enumerate(ids):
                x = values[ends[k] - sizes[k] : ends[k]]
                if i is not None and sizes[k] and np.isfinite(x).all() and x.any():
                    out_ids.append(i)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.binary()), pa.array([len(x) * 8 // number.bit_width for x in out], pa.int32())], names=["id", "vec", "dim"])

    return vectors.select(F.col(row_id).cast("long").alias("id"), F.col(embedding).cast("array<float>" if kind == "<f4" else "array<double>").alias("e")).mapInArrow(run, "id long, vec binary, dim int")


def scaled_rows(x: np.ndarray) -> np.ndarray:
    """Each row by a power of two that brings its largest component to between 1/2 and 1, so squares neither vanish nor overflow.
    That is exact (but for components that are nothing beside the largest), so a cosine is what it would be without."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    half = -exponent // 2  # two steps, as 2.0**1074 is no double
    return np.ldexp(np.ldexp(x, half[:, None]), (-exponent - half)[:, None])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = scaled_rows(x)
    return x / lengths(x)[:, None]
