"""SimHash against brute force: fingerprints, links of large buckets, components, edge cases."""

import re

import numpy as np
import pytest
import xxhash

from flowloom.llm import simhash
from flowloom.llm.components import connected_components, merge_labels


def brute_fingerprint(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64(b" ".join(words[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps, most=4):
    f = np.array(fps, dtype=np.uint64)
    labels = np.arange(len(f))
    for i in range(len(f)):
        j = np.flatnonzero(np.bitwise_count(f ^ f[i]) <= most)
        merge_labels(labels, np.full(len(j), i), j)
    least = {}
    for i, root in zip(ids, labels.tolist()):
        least[root] = min(least.get(root, i), i)
    return [least[root] for root in labels.tolist()]


def test_documents_match_brute_force(spark, sf_dir):
    got = simhash.op3_simhash_dedup(spark, sf_dir).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    fps = [brute_fingerprint(t) for t in docs["text"]]
    assert got["fingerprint"].tolist() == [f"{x:016x}" for x in fps]
    assert got["component_id"].tolist() == brute_components(docs["doc_id"].tolist(), fps)


@pytest.mark.parametrize("chunk", [1 << 13, 400])
def test_large_groups_of_near_copies(spark, chunk):
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, size=6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    fps = set(rng.integers(0, 1 << 63, size=3000, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(700):
            fps.add(c ^ sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 5), replace=False)))
    fps = sorted(fps)
    ids = rng.permutation(len(fps)).tolist()
    rows = [(x - (1 << 64) if x >= 1 << 63 else x, i) for x, i in zip(fps, ids)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, rep long"), 4, chunk=chunk)
    found = {r["node"]: r["component"] for r in connected_components(links, "test").collect()}
    assert [found.get(i, i) for i in ids] == brute_components(ids, fps)
    finer = {r["node"]: r["component"] for r in connected_components(simhash.near_links(spark.createDataFrame(rows, "fp long, rep long"), 4, blocks=6), "test").collect()}
    assert finer == found


def test_a_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges, "path").collect()}
    assert found == {**{k: 0 for k in range(201)}, 1000: 1000, 1001: 1000}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (5, "one"), (None, "one"), (6, "a b c d e " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.simhash_components(docs).collect()))
    assert [(i, c) for i, _, c in got] == [(0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6)]
    assert sorted(r["doc_id"] or 0 for r in simhash.one_of_each(docs).collect()) == [0, 1, 4, 6]
    twice = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x")], docs.schema)
    assert simhash.one_of_each(twice).count() == 1
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_one_doc_id_with_several_texts(spark):
    """Its fingerprints are rows of their own and one group where that doc_id names both."""
    texts = ["one two three four five six", "other words that share nothing at all with it", "one two three four five six"]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[1]), (4, "x " * 100_000)], "doc_id long, text string")
    rows = simhash.simhash_components(df).collect()
    assert len(rows) == 5 and len({r["fp"] for r in rows if r["doc_id"] == 1}) == 2
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (2, 1), (3, 1), (4, 4)}
