"""Suffix dedup against brute force over all 200-byte strings."""

import collections
import hashlib
import random

import numpy as np
import pytest

from flowloom.llm import suffix_dedup as S


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = b"\x01" * length
        runs = sum(1 for i in range(len(t)) if covered[i] and not (i and covered[i - 1]))
        out.append((len(t), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(t, covered) if not c)).hexdigest()))
    return out


def texts():
    r = random.Random(1)
    base = "".join(r.choice("abcde \n") for _ in range(3000))
    out = [base, base[500:1500] + "x" * 900, "x" * 450, base[:260], "é" * 300 + base[1000:1210], base[1000:1199], base[100:400] + "|" + base[350:650] + "|" + base[350:560]]
    out += [None, "", "ab" * 400, "ab" * 400, base[700:905], "q" + base[700:904] + "r", "shared " * 60]
    return out + [f"{i} {base[2000:2230]} {i * 7}" for i in range(40)] + [base[2000 : 2195 + i] + "z" * i for i in range(20)]


def result(df, hot):
    S.covered_segments.__defaults__ = (hot,)
    try:
        rows = S._joined(df.select("doc_id", "text"), "text", 200).mapInArrow(S._measured, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    finally:
        S.covered_segments.__defaults__ = (S.HOT,)
    return sorted(tuple(r)[1:] for r in rows)


@pytest.mark.parametrize("hot", [S.HOT, 2])
def test_matches_brute_force(spark, hot):
    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    assert result(df, hot) == sorted(brute(t))


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in S.op6_suffix_dedup(spark, sf_dir).collect()}
    docs = df.select("doc_id", "text").collect()
    assert got == {r["doc_id"]: x for r, x in zip(docs, brute([r["text"] for r in docs]))}


def test_multikey_order():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, size=(500, 32)).astype(np.uint8)
    rows[100:200, :30] = rows[:100, :30]
    order, common = S.multikey_order(rows)
    want = sorted(bytes(r) for r in rows)
    assert [bytes(rows[k]) for k in order] == want
    for k in range(1, len(want)):
        n = next((i for i in range(32) if want[k][i] != want[k - 1][i]), 32)
        assert common[k] == n


def test_very_long_texts_are_cut_in_pieces(spark, monkeypatch):
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh") for _ in range(6000))
    monkeypatch.setattr(S, "_PIECE", 1000)
    forward, backward = S._powers(2000), S._powers(2000, S._INVERSE)
    x = np.frombuffer(long.encode(), dtype=np.uint8)
    starts = np.concatenate([S.runs_of(x[a : a + 1000 + 199], 200, forward, backward)[1] for a in range(0, 5801, 1000)])
    assert starts.sum() == 6000 - 199


def test_deduplicated_keeps_columns_and_rows(spark):
    t = "".join(chr(97 + k * k % 26) for k in range(300))
    df = spark.createDataFrame([(1, "é" + t, 1, "s"), (2, t + "ü", 2, None), (None, t, 3, "x"), (4, None, 4, "y"), (4, "short", 5, "y")], "doc_id long, text string, spans long, rid string")
    out = sorted((r["spans"], r["text"], r["rid"]) for r in S.deduplicated(df).select("doc_id", "text", "spans", "rid").collect())
    assert [(a, b) for a, b, _ in out] == [(1, "é"), (2, "ü"), (3, ""), (4, ""), (5, "short")]
    assert S.deduplicated(df.limit(0)).count() == 0
