"""Features, counts, risks and slopes of the classifiers against plain versions."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import quality, toxicity

TEXTS = ["", None, "A small Text, a small text!\nIt says |this| 12 times.", "é▁☃ x", "aaaa " * 300, "x", "Toxic words here", "toxic  WORDS there"]


def plain_buckets(text):
    t = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in f" {text.lower()} ")
    out = set()
    for n in toxicity.SIZES:
        for k in range(len(t) - n + 1):
            h = ord(t[k])
            for c in t[k + 1 : k + n]:
                h = (h * 0x9E3779B1 + ord(c)) % 2**32
            m = ((h ^ (h >> 15)) * 0x85EBCA77 + n * 0x2545F491) % 2**32
            out.add(((m ^ (m >> 13)) * 0xC2B2AE3D) % 2**32 >> (32 - toxicity.BITS))
    return out


def test_buckets_match_a_plain_version():
    texts = [t or "" for t in TEXTS]
    assert [set(x.tolist()) for x in toxicity.held_buckets(texts)] == [plain_buckets(t) for t in texts]
    assert all(len(set(x.tolist())) == len(x) for x in toxicity.held_buckets(texts))


def test_toxicity_fit_matches_a_plain_version(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["good", "kind", "nice", "vile", "awful", "rotten", "the", "a"]
    texts = [" ".join(rng.choice(vocabulary[k % 2 * 3 : k % 2 * 3 + 5], 6)) for k in range(40)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "vile", "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", F.lit(True), calls=80)
    x = np.zeros((40, 1 << toxicity.BITS))
    for k, t in enumerate(texts):
        x[k, list(plain_buckets(t))] = 1
    y = np.arange(40) % 2
    ratio = np.zeros(1 << toxicity.BITS)
    for bucket in np.flatnonzero(x.any(axis=0)).tolist():
        p, q = x[y == 1, bucket].sum() + 0.5, x[y == 0, bucket].sum() + 0.5
        r = math.log(p / 20) - math.log(q / 20)
        ratio[bucket] = math.copysign(max(0, abs(r) - toxicity.SURE * math.sqrt(1 / p + 1 / q)), r)
    used = np.flatnonzero(ratio)
    assert np.array_equal(used, np.flatnonzero(model.weights)) and len(used) > 20
    z = np.column_stack([x[:, used] * ratio[used], np.ones(40)])
    w = np.zeros(len(used) + 1)
    keep = np.append(np.full(len(used), 1e-4), 0)
    for _ in range(60):  # Newton's steps, halved where they are too long
        loss = lambda v: np.logaddexp(0, -(2 * y - 1) * (z @ v)).mean() + (keep * v * v).sum() / 2
        s = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(z.T @ (z * (s * (1 - s))[:, None]) / 40 + np.diag(keep + 1e-12), z.T @ (s - y) / 40 + keep * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert all(math.isclose(got[k], 1 / (1 + math.exp(-z[k] @ w)), abs_tol=2e-3) for k in range(40))


def test_counts_of_buckets_stay_off_the_driver(spark, monkeypatch):
    """Of 2**20 buckets in two classes the driver gets the telling ones only."""
    sent, frame = [], type(spark.range(1))
    plain = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: [sent.append(sum(len(x) for x in r if isinstance(x, (bytes, bytearray)))) or r for r in plain(df)])
    docs = spark.createDataFrame([(k, ("vile rotten " if k % 2 else "good kind ") * 3 + f"w{k}") for k in range(40)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int"), "toxic", F.lit(True), calls=3)
    assert sent and max(sent) <= 12 * (np.count_nonzero(model.weights) + 2) < 1 << 16


def spread(h):
    h = h ^ h >> 29
    h = h * 0xBF58476D1CE4E5B9 % 2**64
    return h ^ h >> 32


def plain_sums(hashes, buckets):
    out = [0.0] * buckets
    for h in hashes:
        out[h % buckets] += -1 if h >> 63 else 1
    return [x / max(1, len(hashes)) ** 0.5 for x in out]


def plain_features(text):
    raw = (text or "").encode()
    words = raw.split()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    kinds = [0] * 10
    for c in raw:
        ch = chr(c)
        kind = 0 if c > 127 else 1 if "a" <= ch <= "z" else 2 if "A" <= ch <= "Z" else 3 if ch.isdigit() else 4 if ch in ".,;:'\"?-()" else 5 if ch == "!" else 6 if ch == "|" else 7 if ch == "\n" else 8 if ch in " \t\r\v\f" else 9
        kinds[kind] += 1
    n = max(1, len(words))
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    pairs = list(zip(words, words[1:]))
    other = [
        math.log1p(len(words)), mean, max(0, sum(s * s for s in sizes) / n - mean**2) ** 0.5, sum(a == b for a, b in pairs) / n, (len(words) - len(set(words))) / n,
        sum(65 <= w[0] <= 90 for w in words) / n, (len(pairs) - len(set(pairs))) / n, math.log1p(len(words) / (kinds[7] + 1)),
    ]
    word = [spread(sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, c in enumerate(w)) % 2**64) for w in low.split()]
    gram = [spread((int.from_bytes(low[k : k + quality.GRAM]) + 1) * 0x9E3779B97F4A7C15 % 2**64) for k in range(len(low) - quality.GRAM + 1)]
    return [k / max(1, len(raw)) for k in kinds] + other + plain_sums(word, quality.WORD_BUCKETS) + plain_sums(gram, quality.GRAM_BUCKETS)


def test_features_match_a_plain_version(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["x"], dtype="<f4") for r in quality.featured(df).collect()}
    for k, t in enumerate(TEXTS):
        assert np.allclose(got[k], plain_features(t), atol=1e-5), t


@pytest.mark.parametrize("shift", [-1.5, 3.0])
def test_slopes_are_those_of_the_risk(shift):
    """By differences; with the risk on negatives over 0, and under it."""
    rng = np.random.default_rng(4)
    zp, zu, prior = rng.normal(size=(30, 5)), rng.normal(size=(40, 5)), 0.6
    m = quality.Model(np.zeros(5), np.ones(5), rng.normal(size=(5, 3)), rng.normal(size=3), np.abs(rng.normal(size=3)), 0.0)
    if shift > 0:  # positives score high, unlabelled low
        side = np.sign(m.w1.sum(axis=1))
        zp, zu, m.b2 = zp + shift * side, zu - shift * side, -2.0

    def parts():
        p, u = (quality.logistic(m.of_standard(z)) for z in (zp, zu))
        losses = prior * sum(1 - x for x in p) / len(p), sum(u) / len(u) - prior * sum(p) / len(p)
        assert np.allclose(losses, quality.risk_parts(p, u, prior))
        return losses, quality.slopes(p, u, prior)

    (positive, negative), slope = parts()
    assert (negative < 0) == (shift > 0)
    got = quality.weight_slopes(m, np.concatenate([zp, zu]), slope)
    for name in ("w1", "b1", "w2", "b2"):
        value = np.asarray(getattr(m, name), dtype=float)
        want = np.zeros_like(value)
        for at in np.ndindex(value.shape):
            found = []
            for d in (1e-5, -1e-5):
                moved = value.copy()
                moved[at] += d
                setattr(m, name, moved if value.shape else float(moved))
                losses, _ = parts()
                found.append(sum(losses) if negative >= 0 else -losses[1])
            want[at] = (found[0] - found[1]) / 2e-5
        setattr(m, name, value if value.shape else float(value))
        assert np.allclose(got[name], want, atol=1e-5), name


def test_held_out_is_never_null(spark, sf_dir):
    docs = spark.createDataFrame([(None, "x"), (5, None), (7, "y")], "doc_id long, text string")
    for folds, out in ((3, 1), (5, 0)):
        got = {r["doc_id"]: r["t"] for r in docs.select("doc_id", toxicity.is_training(folds, out).alias("t")).collect()}
        assert got == {None: False, **{k: zlib.crc32(str(k).encode()) % folds != out for k in (5, 7)}}


def test_a_doc_id_of_very_many_rows_teaches_once(spark):
    docs = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("text")).unionByName(spark.createDataFrame([(2, "other")], "doc_id long, text string"))
    sample = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, y int")
    assert sorted(r["doc_id"] for r in quality.one_text_each(docs, sample).collect()) == [1, 2]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels, "quality", F.lit(True)) is not None
