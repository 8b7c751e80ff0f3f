"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Texts are lower-cased, and each white-space or ASCII punctuation character counts as a space. The n-grams of SIZES
characters (code points), spaces included, are hashed to 2**BITS buckets. With p of P toxic and q of Q other labelled texts that
hold a bucket, its ratio is log((p + P / (P + Q)) / P) - log((q + Q / (P + Q)) / Q), 0 for what no text holds, brought nearer to 0 by
SURE of its standard errors, so that a bucket that few texts hold has no say, but any number of buckets may have one. A bucket is a
feature: 0, or the ratio where the text holds it. A logistic regression on these, penalised by the squares of its weights, gives the score.

Fit: on at most PER_CLASS labelled rows of each class, those with the smallest hashes of doc_id (a documented sample; all
rows where there are fewer). Counts of buckets are added up in tasks, SLICE buckets in a row; the driver gets only the ratios that are not 0. What these texts hold of the buckets with a ratio
stays in a table; each step of the regression (L-BFGS) is a job of at most TASKS tasks over it, each of which sends its part of the slope, a number for each such bucket, to the driver.
Scoring reads every whole text once, without a shuffle.

Cases: null and empty texts have no n-grams but the one of two spaces that every text has, and score by it and the intercept; a doc_id labelled twice takes its
larger label; a doc_id with several texts teaches by one of them (the smallest hash); rows with null labels don't teach; a
null doc_id is held out; without labelled rows of both classes every score is the share of toxic labels (0 without any);
repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import one_text_each, slices, table, text_column, written

SIZES = (3, 4, 5, 6)
BITS = 20
PER_CLASS = 4000
SURE = 2.0
TASKS = 8
SLICE = 1 << 14

_SPACED = np.arange(128, dtype=np.uint32)
_SPACED[[k for k in range(128) if not chr(k).isalnum()]] = 32


def gram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The batch's buckets, one array for each n in SIZES, and where each text's characters start. An n-gram belongs to
    its first character; those that would run over a text's end have bucket -1."""
    padded = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in padded], dtype=np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(codes < 128, _SPACED[np.minimum(codes, 127)], codes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    left = np.repeat(starts[1:], sizes) - np.arange(len(codes))
    found = []
    h = codes.astype(np.uint32)
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x9E3779B1) + codes[n - 1 :] if len(h) > 1 else h[:0]
        if n in SIZES:
            m = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + np.uint32(n * 0x2545F491 & 0xFFFFFFFF)
            m = (m ^ (m >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
            bucket = (m >> np.uint32(32 - BITS)).astype(np.int32)
            bucket[left[: len(bucket)] < n] = -1
            found.append(bucket)
    return found, starts


def held_buckets(texts: list[str]) -> Iterator[np.ndarray]:
    """The different buckets that each text holds, in no order."""
    found, starts = gram_buckets(texts)
    last = np.empty((1 << BITS) + 1, dtype=np.int32)  # of each bucket the last place; the last one is for those over a text's end
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own = np.concatenate([x[a:b] for x in found])
        place = np.arange(len(own), dtype=np.int32)
        last[own] = place
        last[-1] = -1
        yield own[last[own] == place]


def is_training(folds: int, held_out: int) -> Column:
    """Whether crc32 of doc_id as text leaves another remainder than that of the rows held out; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, training: Column, per_class: int) -> DataFrame:
    """(doc_id, y): at most per_class rows of each class, by smallest hash of doc_id."""
    known = labels.where(training & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    known = written(known, "labelled")
    order = (F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id"))
    return known.where("y = 1").orderBy(*order).limit(per_class).unionByName(known.where("y = 0").orderBy(*order).limit(per_class))


@dataclass
class Model:
    weights: np.ndarray  # of all buckets
    intercept: float


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], size: int) -> np.ndarray:
    """The sum over all tasks of the vector of `size` numbers to which `add` adds what a batch gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            add(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.coalesce(TASKS).mapInArrow(run, "part binary").collect()
    return np.sum([np.frombuffer(r["part"], dtype="<f8") for r in parts], axis=0) if parts else np.zeros(size)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(y, buckets) of each row."""
    lists = batch.column(1)
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    for k, y in enumerate(batch.column(0).to_pylist()):
        yield y, values[offsets[k] : offsets[k + 1]]


def loss_of(weights: np.ndarray, intercept: float) -> Callable[[np.ndarray, pa.RecordBatch], None]:
    """The sum of errors over the rows that hold each feature, then over all rows, then the sum of losses."""

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for y, held in _rows(batch):
            margin = float(weights[held].sum()) + intercept
            error = float(logistic(np.float64(margin))) - y
            total[held] += error
            total[-2] += error
            total[-1] += np.logaddexp(0, margin if not y else -margin)

    return add


def class_ratios(p: np.ndarray, q: np.ndarray, n_p: float, n_q: float, sure: float = SURE) -> np.ndarray:
    """The log-count ratio of each bucket, nearer to 0 by `sure` standard errors."""
    p, q = p + n_p / (n_p + n_q), q + n_q / (n_p + n_q)
    ratio = np.log(p / n_p) - np.log(q / n_q)
    return np.sign(ratio) * np.maximum(np.abs(ratio) - sure * np.sqrt(1 / p + 1 / q), 0)


def telling_ratios(rows: DataFrame, n_p: float, n_q: float) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose ratio isn't 0, ascending, and these ratios. Counts stay in tasks: a row for each slice of the buckets is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), dtype="<i4")
        for batch in batches:
            for y, held in _rows(batch):
                total[y, held] += 1
        parts = total.reshape(2, -1, SLICE).swapaxes(0, 1)
        full = np.flatnonzero(parts.any(axis=(1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([parts[k].tobytes() for k in full], pa.binary())], names=["slice", "part"])

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(part.as_buffer(), dtype="<i4").reshape(2, SLICE)
        for k, (q, p) in sums.items():
            ratio = class_ratios(p, q, n_p, n_q)
            used = np.flatnonzero(ratio)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(used + k * SLICE).astype("<i4").tobytes()], pa.binary()), pa.array([ratio[used].astype("<f8").tobytes()], pa.binary())], names=["slice", "used", "ratio"])

    parts = rows.coalesce(TASKS).mapInArrow(counted, "slice int, part binary").repartition("slice")
    found = sorted(parts.mapInArrow(ratios, "slice int, used binary, ratio binary").collect())
    return tuple(np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], dtype=kind) for r in found)]) for c, kind in (("used", "<i4"), ("ratio", "<f8")))


def least(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, calls: int, held: int = 6) -> np.ndarray:
    """L-BFGS: where f (value and slope) is least, after at most `calls` calls of it. Steps are halved until they gain enough."""
    value, slope = f(x)
    calls -= 1
    steps: list[tuple[np.ndarray, np.ndarray]] = []  # steps taken, and what they changed in the slope
    while calls > 0 and np.abs(slope).max() > 1e-7:
        way, shares = -slope, []
        for s, d in reversed(steps):
            shares.append((s @ way) / (s @ d))
            way = way - shares[-1] * d
        way = way * ((steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.sqrt(slope @ slope)))
        for (s, d), share in zip(steps, reversed(shares)):
            way = way + (share - (d @ way) / (s @ d)) * s
        size, gain = 1.0, slope @ way
        while calls > 0:
            new_value, new_slope = f(x + size * way)
            calls -= 1
            if new_value <= value + 1e-4 * size * gain:
                break
            size /= 2
        else:
            return x
        s, d = size * way, new_slope - slope
        x, value, slope = x + s, new_value, new_slope
        if s @ d > 1e-12:
            steps = [*steps, (s, d)][-held:]
    return x


def fit(docs: DataFrame, labels: DataFrame, label: str, training: Column, text: str = "text", per_class: int = PER_CLASS, calls: int = 24, penalty: float = 1e-4) -> Model:
    sample = labelled_sample(labels, label, training, per_class)
    taught = one_text_each(docs, sample, text).select("y", "text")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lists = list(held_buckets(text_column(batch, "text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["y", "at"])

    rows = written(taught.mapInArrow(held, "y int, at array<int>"), "toxicity-sample")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_q, n_p = float(sizes.get(0, 0)), float(sizes.get(1, 0))
    if not n_q or not n_p:
        share = n_p / max(1, n_p + n_q)
        return Model(np.zeros(1 << BITS, dtype=np.float32), 30.0 * (2 * share - 1) if share in (0, 1) else float(np.log(share / (1 - share))))
    used, ratio = telling_ratios(rows, n_p, n_q)

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[used] = np.arange(len(used))
        for batch in batches:
            lists = [x[x >= 0] for x in (place[held] for _, held in _rows(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["y", "at"])

    rows = written(rows.mapInArrow(telling, "y int, at array<int>"), "toxicity-features")

    def risk(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x[:-1]
        sums = _summed(rows, loss_of(w * ratio, float(x[-1])), len(x) + 1) / (n_p + n_q)
        return sums[-1] + penalty / 2 * (w @ w), np.append(ratio * sums[:-2] + penalty * w, sums[-2])

    x = least(risk, np.zeros(len(used) + 1), calls)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[used] = x[:-1] * ratio
    return Model(weights, float(x[-1]))


def scores(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """doc_id and the score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sums = [model.weights[held].sum(dtype=np.float64) for held in held_buckets(text_column(batch, text).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(logistic(np.array(sums) + model.intercept))], names=["doc_id", into])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id long, `{into}` double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", is_training(5, 0))
    found = scores(docs, model)
    return found.select("doc_id", (~is_training(5, 0)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
