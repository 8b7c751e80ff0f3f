"""Quality classifier by positive-unlabelled learning.

Features of a whole text (text_features): SHAPE figures of its form (shares of kinds of bytes, words, repeats, lines), and what it
says: its words, and its strings of GRAM bytes, each hashed to WORD_BUCKETS and GRAM_BUCKETS sums with a sign of the hash (A-Z lower-cased),
over the square root of their number. Model: a small network on the standardised features, where each of the latter counts one BALANCE-th, so
that very many of them don't outweigh the shape. Risk: the non-negative unbiased one,
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
with sigmoid loss, minimised with Adam; while the second term is under 0, a step goes against it. Positives are documents
with label 1, unlabelled are documents of any kind, whose labels aren't looked at. Labels 0 are never used. The class prior
is estimated: a first network is taught to tell half of the positives from half of the unlabelled; on the other halves,
the least ratio, over all thresholds, of the shares of unlabelled and of positives above it bounds the prior (with a
margin for the sizes of these shares).

Fit: at most N_POSITIVE trusted positives and N_UNLABELLED unlabelled documents, those with the smallest hashes of doc_id (a
documented sample; all where there are fewer). Only their features come to the driver, one row for each doc_id. Scoring reads every
whole text once, without a shuffle.

Cases: null and empty texts have all features 0 and score like any text; a doc_id labelled twice counts as positive if one
label is 1; a doc_id with several texts teaches by one of them (the smallest hash); rows with null labels don't teach; a null
doc_id is held out; without positives or unlabelled rows every score is 0.5; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import one_text_each, slices, table, text_column, utf8, written
from flowloom.llm.toxicity import is_training, logistic
from flowloom.llm.words import NOT_SPACE, lowered, word_hashes, word_spans

N_POSITIVE, N_UNLABELLED = 6000, 9000
WORD_BUCKETS, GRAM_BUCKETS, GRAM = 192, 192, 4
BALANCE = 4.0

_KINDS = 10


def _kinds() -> np.ndarray:
    out = np.full(256, 9, dtype=np.int64)  # other control bytes
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 0
        elif c.islower():
            out[b] = 1
        elif c.isupper():
            out[b] = 2
        elif c.isdigit():
            out[b] = 3
        elif c in ".,;:'\"?-()":
            out[b] = 4
        elif c == "!":
            out[b] = 5
        elif c == "|":
            out[b] = 6
        elif c == "\n":
            out[b] = 7
        elif c in " \t\r\x0b\x0c":
            out[b] = 8
        elif b > 32 and b != 127:
            out[b] = 9
    return out


KINDS = _kinds()
SHAPE = _KINDS + 8
FEATURES = SHAPE + WORD_BUCKETS + GRAM_BUCKETS


def signed_sums(doc: np.ndarray, h: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """For each text and bucket the sum of signs of the hashes in it, over the square root of the text's hashes. A hash's low bits are the bucket, the highest one its sign."""
    signs = 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
    sums = np.bincount(doc * buckets + (h % np.uint64(buckets)).astype(np.int64), weights=signs, minlength=n * buckets).reshape(n, buckets)
    return sums / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))[:, None]


def gram_hashes(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and a 64-bit hash of each string of GRAM bytes."""
    size = max(0, len(low) - GRAM + 1)
    code = np.zeros(size, dtype=np.uint64)
    for k in range(GRAM):
        code = code << np.uint64(8) | low[k : k + size].astype(np.uint64)
    h = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:size] == doc[len(doc) - size :]
    return doc[:size][inside], h[inside]


def text_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: its shape, then signed sums of its words and of its strings of GRAM bytes."""
    n = len(offsets) - 1
    low = lowered(raw)
    starts, ends, doc = word_spans(raw, offsets, NOT_SPACE)
    said = signed_sums(doc, word_hashes(low, starts, ends), n, WORD_BUCKETS)
    return np.hstack([shape_features(raw, offsets), said, signed_sums(*gram_hashes(low, offsets), n, GRAM_BUCKETS)])


def shape_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: shares of bytes by kind; log of words; mean and spread of their lengths; shares of words equal
    to the one before, of words seen before, of words that start upper-case, of pairs seen before; log of words a line."""
    n = len(offsets) - 1
    sizes = np.maximum(np.diff(offsets), 1)
    of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(of * _KINDS + KINDS[raw], minlength=n * _KINDS).reshape(n, _KINDS)
    del of
    starts, ends, doc = word_spans(raw, offsets, NOT_SPACE)
    h = word_hashes(raw, starts, ends)
    words = np.bincount(doc, minlength=n)
    many = np.maximum(words, 1)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(doc, weights=length, minlength=n) / many
    spread = np.sqrt(np.maximum(np.bincount(doc, weights=length**2, minlength=n) / many - mean**2, 0))
    together = doc[1:] == doc[:-1]
    same = np.bincount(doc[1:][together & (h[1:] == h[:-1])], minlength=n) / many
    upper = np.bincount(doc[(raw[starts] >= 65) & (raw[starts] <= 90)], minlength=n) / many

    def seen(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, doc))
        d, k = doc[order], h[order]
        return np.bincount(d[1:][(d[1:] == d[:-1]) & (k[1:] == k[:-1])], minlength=n) / many

    pairs = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
    other = [np.log1p(words), mean, spread, same, seen(doc, h), upper, seen(doc[1:][together], pairs[together]), np.log1p(words / (kinds[:, 7] + 1))]
    return np.column_stack([kinds / sizes[:, None], *other])


@dataclass
class Model:
    """g(x) = relu(z @ w1 + b1) @ w2 + b2 with z the standardised features; the score is its logistic."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean.astype(x.dtype)) / self.scale.astype(x.dtype), -8, 8)

    def of_standard(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.of_standard(self.standard(x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.margins(x))


def risk_parts(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """Of scores p of positives and u of unlabelled: the risk on positives, and the one on negatives, which the risk takes from 0 on. The loss of a score s is 1 - s as a positive, s as a negative."""
    return prior * (1 - p).mean(), u.mean() - prior * p.mean()


def slopes(p: np.ndarray, u: np.ndarray, prior: float | None) -> np.ndarray:
    """What a step goes along, by margin, of positives and then unlabelled: the slope of the risk, or, while the risk on negatives is under 0,
    minus that risk's own. prior None: of the logistic loss of positives against unlabelled."""
    if prior is None:
        return np.concatenate([(p - 1) / len(p), u / len(u)])
    dp, du = p * (1 - p) / len(p), u * (1 - u) / len(u)
    if risk_parts(p, u, prior)[1] >= 0:
        return np.concatenate([-2 * prior * dp, du])
    return np.concatenate([prior * dp, -du])


def weight_slopes(m: Model, z: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray | float]:
    """Of each weight, from the slopes by margin of standardised rows."""
    active = z @ m.w1 + m.b1
    h = np.maximum(active, 0)
    back = np.outer(slope, m.w2) * (active > 0)
    return {"w1": z.T @ back, "b1": back.sum(axis=0), "w2": h.T @ slope, "b2": slope.sum()}


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 5, hidden: int = 24, rounds: int = 60, batches: int = 24, rate: float = 3e-3, decay: float = 1e-4) -> Model:
    """prior None: plain logistic loss of positives against unlabelled, for estimating the prior."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate([positive, unlabelled])
    m = Model(everything.mean(axis=0, dtype=np.float64), everything.std(axis=0, dtype=np.float64) + 1e-6, rng.normal(0, (2 / positive.shape[1]) ** 0.5, (positive.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    m.scale[SHAPE:] *= BALANCE
    zp, zu = m.standard(positive), m.standard(unlabelled)
    first, second = ({k: np.zeros_like(np.asarray(getattr(m, k), dtype=float)) for k in ("w1", "b1", "w2", "b2")} for _ in range(2))
    step = 0
    for _ in range(rounds):
        parts = zip(np.array_split(rng.permutation(len(zp)), batches), np.array_split(rng.permutation(len(zu)), batches))
        for ip, iu in parts:
            if not len(ip) or not len(iu):
                continue
            z = np.concatenate([zp[ip], zu[iu]])
            s = logistic(m.of_standard(z))
            step += 1
            for name, grad in weight_slopes(m, z, slopes(s[: len(ip)], s[len(ip) :], prior)).items():
                grad = grad + decay * getattr(m, name)
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad**2
                setattr(m, name, getattr(m, name) - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8))
    return m


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from above; see the module's text."""
    first = fit_network(positive[::2], unlabelled[::2], None)
    p, u = np.sort(first.margins(positive[1::2])), np.sort(first.margins(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    above_p = 1 - np.searchsorted(p, p, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, p, side="left") / len(u)
    margin = np.sqrt(np.log(20) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    bound = np.where(above_p > 0.05, (above_u + margin) / np.maximum(above_p, 1e-9), np.inf)
    k = int(np.argmin(bound))
    return float(np.clip(above_u[k] / above_p[k], 0.01, 0.99))


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the features of every whole text, as the bytes of single-precision numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            x = text_features(*utf8(text_column(batch, text)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array([row.tobytes() for row in x.astype("<f4")], pa.binary())], names=["doc_id", "x"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, x binary")


def fit(docs: DataFrame, labels: DataFrame, label: str, training: Column, text: str = "text", n_positive: int = N_POSITIVE, n_unlabelled: int = N_UNLABELLED) -> Model | None:
    order = (F.xxhash64(F.lit(13), "doc_id"), F.col("doc_id"))
    positive = labels.where(training & (F.col(label) > 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*order).limit(n_positive)
    other = docs.where(training & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*order).limit(n_unlabelled)
    sample = positive.withColumn("p", F.lit(1)).unionByName(other.withColumn("p", F.lit(0))).groupBy("doc_id").agg(F.max("p").alias("p"), (F.min("p") == 0).alias("u"))
    sample = written(sample, "quality-sample")
    rows = featured(one_text_each(docs, sample.select("doc_id"), text)).join(F.broadcast(sample), "doc_id").collect()  # a row for each id of the sample at most
    rows.sort(key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype="<f4").reshape(len(rows), FEATURES)
    p, u = (x[np.array([bool(r[k]) for r in rows], dtype=bool)] for k in "pu")
    if not len(p) or not len(u):
        return None
    shuffled = np.random.default_rng(3)
    p, u = p[shuffled.permutation(len(p))], u[shuffled.permutation(len(u))]
    return fit_network(p, u, class_prior(p, u))


def scores(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """doc_id and the score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            s = model.scores(text_features(*utf8(text_column(batch, text)))) if model is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(s)], names=["doc_id", "score"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, score double")


def good_documents(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs that score 0.5 at least, all columns kept. Narrow: texts aren't shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            keep = model.scores(text_features(*utf8(text_column(batch, text)))) >= 0.5 if model is not None else np.ones(batch.num_rows, dtype=bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = is_training(3, 1)
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels"), "quality", training))
    return found.select("doc_id", (~training).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
