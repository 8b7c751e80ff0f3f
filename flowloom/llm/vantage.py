"""Approximate nearest neighbours by vantage-point trees, one for each shard of the vectors.

Distance is that of unit vectors, which orders like the cosine. A node holds a vantage point and the median distance of
its points from it; the nearer half lies inside, the rest outside. A query visits the half it falls in, then the other
one only if the ball of its k-th best distance, shrunk by `factor`, still crosses the median: |d - median| * factor <=
best. Factor 1 is the triangle inequality, so the search is exact; larger factors prune more. What is held as best is ordered by
the cosine of the original vectors in double precision, then by the smaller id, so ties are settled by id in the search itself.

Shards: at most PIVOTS vectors with the smallest hashes are pivots (a documented sample); every vector belongs to its
nearest one, and a pivot's vectors are dealt to shards of about `shard` points by a hash. A query first searches the
shards of its own pivot, then those of each other pivot whose ball can still hold something better, by the same rule: (distance
to the pivot - radius) * factor <= k-th best. A shard is sent to one task for each `block` queries, which builds its tree
once and lets the queries pass, so neither side of a task is unbounded.

Equal vectors are combined first, keeping for each distinct vector its k + 1 smallest ids, in each task and
then by vector, so that a vector that very many rows share is one point.

Recall against brute force at the production factor is measured in tests/llm/test_vectors.py.

Cases: null, zero and non-finite vectors and null ids take no part; vectors of another dimension than a query's aren't
its candidates; equal cosines tie, the smaller id first; a repeated id with one vector is one candidate; components of any size
a double can have take part; an empty table gives an empty result; fewer candidates than k give all; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import bounded_broadcast, table, written
from flowloom.llm.vectors import lengths, matrix, scaled_rows, unit_rows, valid_vectors

FACTOR = 4.0
LEAF = 64
PIVOTS = 256
_SLACK = 1e-7  # rounding of a distance near 0


def distance(cosine: np.ndarray) -> np.ndarray:
    """Of unit vectors; infinite where the cosine is."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Tree:
    """Over vectors with their ids; nodes in arrays. A node without a vantage point is a range of `order`."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = 1):
        self.raw, self.ids, self.leaf = scaled_rows(vectors), ids, leaf
        self.norm = lengths(self.raw)
        self.points = self.raw / self.norm[:, None]
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, int, float, int, int]] = []  # from, to, vantage point, median, inside, outside
        if len(vectors):
            self._build(0, len(vectors), np.random.default_rng(seed))

    def _build(self, a: int, b: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append((a, b, -1, 0.0, -1, -1))
        if b - a > self.leaf:
            own = self.order[a:b]
            k = int(rng.integers(len(own)))
            own[0], own[k] = own[k], own[0]
            d = distance(self.points[own[1:]] @ self.points[own[0]])
            half = len(d) // 2
            part = np.argpartition(d, half)
            own[1:] = own[1:][part]
            median = float(d[part[half]])
            inside = self._build(a + 1, a + 1 + half, rng)
            outside = self._build(a + 1 + half, b, rng)
            self.nodes[me] = (a, b, int(own[0]), median, inside, outside)
        return me

    def search(self, vectors: np.ndarray, k: int, factor: float, piece: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """For each query vector the k nearest found, by cosine and then id: cosines (-inf where there are fewer) and points."""
        raw = scaled_rows(vectors)
        norm = lengths(raw)
        queries = raw / norm[:, None]
        best = np.full((len(queries), k), -np.inf)
        names = np.full((len(queries), k), np.iinfo(np.int64).max)
        found = np.full((len(queries), k), -1)

        def offer(rows: np.ndarray, near: np.ndarray, points: np.ndarray) -> None:
            floor = best[rows, -1]
            if near.shape[1] > k:
                floor = np.maximum(floor, np.partition(near, -k, axis=1)[:, -k])
            r, c = np.nonzero(near >= floor[:, None] - 1e-9)
            if not len(r):
                return
            q, p = rows[r], points[c]
            exact = np.empty(len(r))
            step = max(1, piece // raw.shape[1])
            for a in range(0, len(r), step):
                exact[a : a + step] = np.einsum("ij,ij->i", raw[q[a : a + step]], self.raw[p[a : a + step]])
            exact /= norm[q] * self.norm[p]
            row = np.concatenate([np.repeat(np.arange(len(rows)), k), r])
            score, name, point = (np.concatenate([x[rows].ravel(), y]) for x, y in ((best, exact), (names, self.ids[p]), (found, p)))
            order = np.lexsort((name, -score, row))
            row = row[order]
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
            best[rows], names[rows], found[rows] = (x[order].reshape(-1, k) for x in (score, name, point))

        def visit(node: int, rows: np.ndarray) -> None:
            a, b, vantage, median, inside, outside = self.nodes[node]
            if vantage < 0:
                offer(rows, queries[rows] @ self.points[self.order[a:b]].T, self.order[a:b])
                return
            cosine = queries[rows] @ self.points[vantage : vantage + 1].T
            offer(rows, cosine, np.array([vantage]))
            d = distance(cosine[:, 0])
            for first, second, mine in ((inside, outside, d < median), (outside, inside, d >= median)):
                if mine.any():
                    visit(first, rows[mine])
                    again = mine & (np.abs(d - median) * factor <= distance(best[rows, -1]) + _SLACK)
                    if again.any():
                        visit(second, rows[again])

        if len(self.points) and len(queries):
            visit(0, np.arange(len(queries)))
        return best, found


def smallest_ids(valid: DataFrame, keep: int) -> DataFrame:
    """(vec, dim, ids): each distinct vector with its `keep` smallest ids. Combined in each batch, then by vector and
    partition group, then by vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(v, []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.binary()), pa.array([len(v) // 8 for v in held], pa.int32()), pa.array([sorted(set(x))[:keep] for x in held.values()], pa.list_(pa.int64()))], names=["vec", "dim", "ids"]
            )

    def merged(df: DataFrame, *keys: str | Column) -> DataFrame:
        return df.groupBy("vec", "dim", *keys).agg(F.slice(F.array_distinct(F.array_sort(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))

    first = valid.mapInArrow(run, "vec binary, dim int, ids array<long>")
    return merged(merged(first, F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).drop("part"))


def _search(k: int, factor: float):
    """Rows (task, query, id, vec, ids) sorted by task and query -> candidates of the queries; points come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, points, ids, tree = None, [], [], None
        for batch in batches:
            tasks = np.asarray(batch.column(0))
            is_query = np.asarray(batch.column(1))
            edge = np.flatnonzero(np.r_[True, (tasks[1:] != tasks[:-1]) | (is_query[1:] != is_query[:-1])]) if len(tasks) else []
            for a, b in zip(edge, np.r_[edge[1:], len(tasks)] if len(tasks) else []):
                part = batch.slice(a, b - a)
                if tasks[a] != task:
                    task, points, ids, tree = tasks[a], [], [], None
                if not is_query[a]:
                    points.append(matrix(part.column(3)))
                    ids += part.column(4).to_pylist()
                    continue
                if not points:
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(points), np.array([x[0] for x in ids], dtype=np.int64))
                cosine, found = tree.search(matrix(part.column(3)), k + 1, factor)  # one more, as a query may find itself
                query, candidate, score = [], [], []
                row, col = np.nonzero(found >= 0)
                names = part.column(2).to_pylist()
                for r, p, s in zip(row.tolist(), found[row, col].tolist(), cosine[row, col].tolist()):
                    for i in ids[p]:
                        if i != names[r]:
                            query.append(names[r])
                            candidate.append(i)
                            score.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(candidate, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _nearest_pivots(pivots: dict[int, np.ndarray]):
    """Rows (vec, dim, ...) with the nearest pivot of their dimension (-1 where it has none) and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            pivot, far = np.full(len(dims), -1, dtype=np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                if int(dim) in pivots:
                    at = np.flatnonzero(dims == dim)
                    cosine = unit_rows(matrix(batch.column(0).take(pa.array(at)))) @ pivots[int(dim)].T
                    pivot[at], far[at] = cosine.argmax(axis=1), distance(cosine.max(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(far)], names=[*batch.schema.names, "pivot", "far"])

    return run


def _other_pivots(pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float], factor: float):
    """Rows (vec, dim, id, pivot, kth) -> those pivots besides the row's own whose balls can hold something better."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, kth = np.asarray(batch.column(1)), distance(np.asarray(batch.column(4).fill_null(-np.inf)))
            own = np.asarray(batch.column(3))
            rows: list[list[int]] = [[] for _ in range(len(dims))]
            for dim in np.unique(dims):
                if int(dim) in pivots:
                    at = np.flatnonzero(dims == dim)
                    d = distance(unit_rows(matrix(batch.column(0).take(pa.array(at)))) @ pivots[int(dim)].T)
                    r = np.array([radius.get((int(dim), p), -np.inf) for p in range(d.shape[1])])
                    go = (d - r) * factor <= kth[at][:, None] + _SLACK
                    go[np.arange(len(at)), own[at]] = False
                    go[:, np.isinf(r)] = False  # a pivot without vectors
                    for x, places in zip(at.tolist(), go):
                        rows[x] = np.flatnonzero(places).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.int32()))], names=["vec", "dim", "id", "pivots"])

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, factor: float = FACTOR, shard: int = 1 << 14, block: int = 1 << 18, embedding: str = "embedding", row_id: str = "vec_id", pivots: int = PIVOTS
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row where is_query (a condition on `id`)."""
    valid = written(valid_vectors(vectors, embedding, row_id), "vantage-valid")
    distinct = written(smallest_ids(valid, k + 1), "vantage-points")
    asked = valid.where(is_query).dropDuplicates(["id", "vec"])
    wanted = max(1, min(pivots, -(-distinct.count() // shard)))
    chosen: dict[int, list[np.ndarray]] = {}
    for r in distinct.orderBy(F.xxhash64(F.lit(19), "vec"), "vec").limit(wanted).select("vec", "dim").collect():
        chosen.setdefault(r["dim"], []).append(unit_rows(np.frombuffer(r["vec"], dtype="<f8")[None])[0])
    centres = {dim: np.stack(x) for dim, x in chosen.items()}
    to_pivot = _nearest_pivots(centres)
    placed = written(distinct.mapInArrow(to_pivot, "vec binary, dim int, ids array<long>, pivot int, far double"), "vantage-placed")
    asked = written(asked.select("vec", "dim", "id").mapInArrow(to_pivot, "vec binary, dim int, id long, pivot int, far double"), "vantage-queries")
    blocks = max(1, -(-asked.count() // block))
    sizes = placed.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"), F.max("far").alias("radius"))
    sizes = written(sizes, "vantage-sizes")
    radius = {(r["dim"], r["pivot"]): r["radius"] for r in sizes.where("pivot >= 0").collect()}  # at most `pivots` rows
    sizes = sizes.select("dim", "pivot", "shards")
    placed = placed.join(bounded_broadcast(sizes), ["dim", "pivot"]).withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")))

    def searched(queries: DataFrame, name: str) -> DataFrame:
        """queries (vec, dim, id, pivot) -> candidates from all shards of that pivot."""
        each = queries.join(bounded_broadcast(sizes), ["dim", "pivot"])
        part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
        each = each.select("dim", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long") - 1)).alias("shard"), part.alias("block"), F.lit(True).alias("query"), "id", "vec", F.lit(None).cast("array<long>").alias("ids"))
        points = placed.select("dim", "pivot", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(False).alias("query"), F.lit(None).cast("long").alias("id"), "vec", "ids")
        rows = points.unionByName(each).select(F.xxhash64("dim", "pivot", "shard", "block").alias("task"), "query", "id", "vec", "ids")
        tasks = max(1, len(radius)) * blocks
        rows = rows.repartition(max(32, min(4 * tasks, 4096)), "task").sortWithinPartitions("task", "query")
        return written(rows.mapInArrow(_search(k, factor), "query_id long, vec_id long, score double"), name)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = searched(asked, "vantage-near")
    if len(radius) > 1:
        kth = best(found).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        onward = asked.join(kth, "id", "left").select("vec", "dim", "id", "pivot", "kth")
        onward = written(onward.mapInArrow(_other_pivots(centres, radius, factor), "vec binary, dim int, id long, pivots array<int>"), "vantage-onward")
        found = found.unionByName(searched(onward.withColumn("pivot", F.explode("pivots")).drop("pivots"), "vantage-found"))
    return best(found)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
