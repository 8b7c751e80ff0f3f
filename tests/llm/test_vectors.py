"""Nearest neighbours and near duplicates of embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import multi_index, vantage
from flowloom.llm.components import merge_labels
from flowloom.llm.vectors import valid_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(spark, n=3000, dim=24, seed=0):
    """Clusters of near copies, very frequent equal vectors, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[200:500] = x[0] + 0.05 * rng.normal(size=(300, dim))
    x[500:900] = x[1]
    x[900:1000] = 4 * x[2]
    rows = [(k, [float(np.float32(v)) for v in r], k % 3) for k, r in enumerate(x)]
    rows += [(n, None, 0), (n + 50, [0.0] * dim, 0), (n + 100, [float("nan")] * dim, 0), (n + 150, [1.0, None] + [0.0] * (dim - 2), 0), (None, rows[0][1], 0), (n + 200, [], 0), (n + 250, [1.0, 2.0], 0), (n + 300, [2.0, 4.0], 0), (n + 250, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, SCHEMA)


def taken(df):
    """Ids and vectors that take part, of the frequent dimension."""
    ids, out = [], []
    for r in df.collect():
        e = r["embedding"]
        if r["vec_id"] is not None and e and len(e) > 2 and None not in e and np.isfinite(e).all() and np.any(e):
            ids.append(r["vec_id"])
            out.append(np.asarray(e, dtype=np.float64))
    return np.array(ids), np.stack(out)


def brute_nearest(ids, x, k, every):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for q in np.flatnonzero(ids % every == 0):
        s = np.round(unit @ unit[q], 12)
        s[ids == ids[q]] = -2
        found[int(ids[q])] = [int(i) for i in ids[np.lexsort((ids, -s))[:k]]]
    return found


def test_factor_one_is_exact(spark):
    df = made(spark)
    got = {}
    for r in vantage.nearest(df, F.col("id") % 50 == 0, factor=1.0, shard=700, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    small = {3250: [3300], 3300: [3250]}
    assert {q: v for q, v in got.items() if q in small} == small
    want = brute_nearest(*taken(df), 5, 50)
    assert {q: v for q, v in got.items() if q not in small} == want


def test_ties_go_to_smaller_ids(spark):
    df = made(spark)
    got = [r["vec_id"] for r in vantage.nearest(df, F.col("id") == 600, factor=1.0).orderBy("rank").collect()]
    assert got == [1, 500, 501, 502, 503]


def test_scaled_copies_tie(spark):
    """Vectors of one direction all have cosine 1, so ids decide; components may be tiny or huge."""
    rows = [(k, [3.0 * 2.0 ** (k % 7), 4.0 * 2.0 ** (k % 7)]) for k in range(1, 21)] + [(50, [6.0, 8.0])]
    rows += [(30, [3e-200, 4e-200]), (31, [3e200, 4e200]), (32, [5e-324, 0.0]), (33, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for factor in (1.0, vantage.FACTOR):
        got = [(r["vec_id"], round(r["score"], 12)) for r in vantage.nearest(df, F.col("id") == 50, factor=factor).orderBy("rank").collect()]
        assert got == [(k, 1.0) for k in range(1, 6)]
    every = vantage.nearest(df, F.col("id") == 50, k=30, factor=1.0).orderBy("rank").collect()
    assert [r["vec_id"] for r in every][:22] == [*range(1, 21), 30, 31] and {r["vec_id"] for r in every} == {r[0] for r in rows} - {50}
    links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_duplicates(df).collect()}
    assert links[50] == (23, 1) and links[30][1] == links[31][1] == 1 and links[32] == (0, 32) and links[33][1] == 1


def test_clashing_columns_and_other_dimensions(spark):
    df = made(spark, n=1100)
    for name in ("id", "vec", "dim", "ids", "rep", "cell", "task", "query", "score", "rank", "node", "n_links", "component_id", "kept", "pivot", "shard"):
        df = df.withColumn(name, F.lit("x"))
    plain = df.select("vec_id", "embedding")
    for run in (lambda x: vantage.nearest(x, F.col("id") % 50 == 0), multi_index.near_duplicates):
        a, b = run(df), run(plain)
        assert a.columns == b.columns and sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


@pytest.mark.parametrize("pivots", [1, 6, 40])
def test_pivots_lose_nothing_at_factor_one(spark, pivots):
    df = made(spark)
    want = brute_nearest(*taken(df), 5, 50)
    got = {}
    for r in vantage.nearest(df, F.col("id") % 50 == 0, factor=1.0, shard=60, block=16, pivots=pivots).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {q: got[q] for q in want} == want


def test_recall_of_the_production_factor(spark):
    table = "/root/testdata/sf0.1"
    ids, x = taken(spark.read.parquet(f"{table}/embeddings.parquet"))
    want = brute_nearest(ids, x, 5, 50)
    for rows in (vantage.op4_nearest_neighbours(spark, table).collect(), vantage.nearest(spark.read.parquet(f"{table}/embeddings.parquet"), F.col("id") % 50 == 0, shard=200).collect()):
        hits = sum(r["vec_id"] in want[r["query_id"]] for r in rows)
        assert hits / sum(map(len, want.values())) > 0.95


def brute_links(ids, x, least=0.9):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    labels = np.arange(len(ids))
    merge_labels(labels, *np.nonzero(near))
    least_id = {}
    for i, root in zip(ids.tolist(), labels.tolist()):
        least_id[root] = min(least_id.get(root, i), i)
    return {i: (int(n), least_id[root]) for i, n, root in zip(ids.tolist(), near.sum(axis=1), labels.tolist())}


@pytest.mark.parametrize("chunk", [4096, 90])
def test_links_match_brute_force(spark, chunk):
    df = made(spark)
    ids, x = taken(df)
    want = brute_links(ids, x)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_duplicates(df, chunk=chunk).collect()}
    assert {i: got[i] for i in want} == want
    for i in (3000, 3050, 3100, 3150, 3200):
        assert got[i] == (0, i)
    assert got[3250] == (2, 3250) and got[3300] == (2, 3250)
    assert multi_index.near_duplicates(df).count() == df.count()


def test_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = multi_index.op9_embedding_dedup(spark, sf_dir)
    assert out.count() == df.count()
    assert out.where("kept <> (vec_id = component_id)").count() == 0
    empty = df.limit(0)
    assert multi_index.near_duplicates(empty).count() == 0
    assert vantage.nearest(empty, F.col("id") % 50 == 0).count() == 0
    assert valid_vectors(empty).count() == 0


def test_links_match_sql(spark):
    import duckdb

    df = made(spark, n=1100).where("vec_id is not null and (vec_id < 1000 or vec_id <> 1350)")
    con = duckdb.connect()
    con.register("embeddings", df.toPandas())
    want = sorted(con.execute(multi_index.OP9_SQL).fetchall())
    got = sorted(tuple(r) for r in multi_index.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want and sum(r[1] for r in got) > 100_000


def test_multi_sequence_visits_nearest_cells():
    rng = np.random.default_rng(3)
    grid = multi_index.Grid(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    x = rng.normal(size=(20, 6))
    got = grid.nearest_cells(x, 12)
    for r in range(20):
        d = multi_index.squared(x[r : r + 1, :3], grid.first)[0][:, None] + multi_index.squared(x[r : r + 1, 3:], grid.second)[0][None]
        want = np.sort(d.reshape(-1))[:12]
        assert np.allclose(d.reshape(-1)[got[r]], want)


def plain(spark, x, folder):
    """Rows of x as a table of floats, and x as those floats."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = x.astype(np.float32)
    (folder / "embeddings.parquet").mkdir()
    for k, part in enumerate(np.array_split(np.arange(len(x)), 4)):
        rows = pa.FixedSizeListArray.from_arrays(pa.array(x[part].reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))
        pq.write_table(pa.table({"vec_id": part, "embedding": rows}), folder / "embeddings.parquet" / f"{k}.parquet", use_dictionary=False)
    return spark.read.parquet(str(folder / "embeddings.parquet")), x.astype(np.float64)


def test_disk_grows_with_the_vectors_only(spark, tmp_path):
    """What is staged and shuffled at once stays under four times the components' bytes (with 41 float64 copies of every vector it was 40 times)."""
    import os
    import threading

    rng = np.random.default_rng(8)
    df, x = plain(spark, rng.normal(size=(40_000, 64)), tmp_path)
    tops = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()] + [spark.conf.get("spark.checkpoint.dir").removeprefix("file:")]

    def used():
        total = 0
        for top in tops:
            for d, _, names in os.walk(top):
                for name in names:
                    try:
                        total += os.lstat(f"{d}/{name}").st_size * (".data" in name or ".parquet" in name)
                    except OSError:
                        pass
        return total

    before, most, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], used() - before)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        assert multi_index.near_duplicates(df).count() == 40_000
    finally:
        over.set()
        thread.join()
    assert 0 < most[0] < 4 * x.size * 4


def test_links_at_the_border_are_found(spark, tmp_path):
    """Vectors turned until they only just link, in the thinnest data: at least 0.995 of them, and no other links."""
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(16_000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    df, x = plain(spark, np.concatenate([unit, multi_index.moved_rows(unit[:4000], 0.9001, seed=10)]), tmp_path)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_duplicates(df).collect()}
    want = brute_links(np.arange(len(x)), x)
    assert len(want) == len(got) and sum(v[0] for v in want.values()) >= 8000
    assert all(got[i][0] <= want[i][0] and got[i][1] in (i, want[i][1]) for i in want)
    assert sum(v[0] for v in got.values()) >= 0.995 * sum(v[0] for v in want.values())


@pytest.mark.parametrize("crowd", [1 << 17, 150])
def test_large_components_count_each_pair_once(spark, tmp_path, crowd):
    """A long chain, where most link outside of a core, a dense group, and vectors beside both; cells in chunks."""
    rng = np.random.default_rng(11)
    turn = np.linspace(0, 5, 1200)[:, None]
    plane = np.linalg.qr(rng.normal(size=(24, 2)))[0].T
    chain = np.cos(turn) * plane[0] + np.sin(turn) * plane[1] + 0.03 * rng.normal(size=(1200, 24))
    dense = 3 * plane[0] + 2 * rng.normal(size=24) + 0.25 * rng.normal(size=(800, 24))
    df, x = plain(spark, np.concatenate([chain, dense, rng.normal(size=(500, 24))]), tmp_path)
    want = brute_links(np.arange(len(x)), x)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_duplicates(df, chunk=100, per_cell=50, crowd=crowd).collect()}
    assert len({v[1] for v in want.values()}) > 100 and {i: v[1] for i, v in got.items()} == {i: v[1] for i, v in want.items()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.999 * sum(v[0] for v in want.values()) > 300_000


def test_forest_joins_what_may_link():
    """Sets of a cell by codes, with one side and with two, hold every pair that links."""
    rng = np.random.default_rng(12)
    x = multi_index.unit_rows(np.concatenate([rng.normal(size=64) + 0.1 * rng.normal(size=(3000, 64)), rng.normal(size=(600, 64))])[rng.permutation(3600)])
    code, fit = multi_index.coded(x)
    left, right = multi_index.bounds(code, fit)
    assert (left @ right.T >= x @ x.T - 1e-5).all()
    near = x @ x.T >= 0.9
    for side in (np.zeros(3600, dtype=np.int8), rng.integers(1, 3, size=3600)):
        labels = multi_index.forest(code, fit, side, 0.9)
        i, j = np.nonzero(near & ((side[:, None] != side) | (side == 0)))
        assert len(i) > 1_000_000 and (labels[i] == labels[j]).all() and len(np.unique(labels)) > 500
