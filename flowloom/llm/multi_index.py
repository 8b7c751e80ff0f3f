"""Embedding near-dedup by inverted multi-indexes.

Each half of a unit vector is quantised by its own codebook of K centroids; the K * K pairs of centroids are the cells of
a grid. A vector visits the few cells nearest to it, in the order of the sum of squared distances of its halves to the
centroids, found by the multi-sequence traversal: the cell with the least sum is taken next, and only its two neighbours
in the sorted lists of centroids become candidates. Two vectors meet where both visit a cell. There are several grids,
each over the dimensions in an order of its own, so that the halves differ; their number is fixed by a target recall: on a
bounded sample of vectors, not those that the codebooks are fitted on, that are moved by the largest angle that still links, grids are added
until the target share meets. Where a bounded number of grids can't reach it, they are made coarser until they do.

Nothing but a code goes to the cells: a byte for each component, and how far that is from the vector, which bounds the
cosine from above. Pairs whose bound allows a link make a forest of near vectors, whose components are dealt out with the
vectors themselves, each once, and there every pair is held against each other by its cosine in double precision. One
grid is dealt at a time, and its shuffle files go before the next one's are written.

Codebooks are fitted (Lloyd's k-means) on two thirds of at most SAMPLE vectors with the smallest hashes; every vector is indexed. K grows with the
square root of the number of vectors, so that a cell keeps its size. A cell that by the sample has over `crowd` visitors is cut into chunks
by a hash, each pair of chunks a task of its own; in a cell most near copies meet one head only, not each other. In components of over `chunk`
vectors those within half the largest angle of one member (of a few the one in the densest place) all link with each other, so they are counted; the pairs of the others are those that meet
in a cell, where the vectors go then, and each is counted in the first cell that both visit. Equal vectors are combined first, with their number.
A task returns sums of links for vectors and a forest of links, no pairs.

Cases: null, zero and non-finite vectors and rows with a null id link with nothing (n_links 0, component their own id,
kept); vectors of another dimension don't link; equal vectors link; a repeated vec_id is several vectors that share their
row's result; an empty table gives an empty result; labels and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import bounded_broadcast, table, written
from flowloom.llm.components import connected_components, merge_labels
from flowloom.llm.vectors import lengths, matrix, narrowest, unit_rows, valid_vectors
from flowloom.sources.staging import shuffles_dropped

LEAST = 0.9
SAMPLE = 12_288
RECALL = 0.999


def halves(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mid = (unit.shape[1] + 1) // 2
    return unit[:, :mid], unit[:, mid:]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T, 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 2) -> np.ndarray:
    """Lloyd's k-means from k rows of x; an empty cluster takes the row that lies farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        d = squared(x, c)
        near = d.argmin(axis=1)
        size = np.bincount(near, minlength=k)
        for j in np.flatnonzero(size == 0):
            far = int(d[np.arange(len(x)), near].argmax())
            near[far], d[far] = j, 0
        size = np.maximum(np.bincount(near, minlength=k), 1)
        for col in range(x.shape[1]):
            c[:, col] = np.bincount(near, weights=x[:, col], minlength=k) / size
    return c


def nearest(d: np.ndarray, n: int) -> np.ndarray:
    """For each row the places of its n least entries (all, if there are fewer), least first, ties by place."""
    if n > 4:
        return np.argsort(d, axis=1, kind="stable")[:, :n]
    d, rows, out = d.copy(), np.arange(len(d)), np.empty((len(d), min(n, d.shape[1])), dtype=np.int64)
    for k in range(out.shape[1]):
        out[:, k] = d.argmin(axis=1)
        d[rows, out[:, k]] = np.inf
    return out


@dataclass
class Grid:
    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    def cell(self, unit: np.ndarray) -> np.ndarray:
        a, b = halves(unit)
        return squared(a, self.first).argmin(axis=1) * len(self.second) + (squared(b, self.second).argmin(axis=1) if b.shape[1] else 0)

    def nearest_cells(self, unit: np.ndarray, visits: int, piece: int = 1 << 21) -> np.ndarray:
        """Multi-sequence traversal for every row: its `visits` nearest cells, nearest first. All rows advance together: of each
        centroid of the first half, in order, the next one of the second half is a candidate once its predecessor has been visited."""
        a, b = halves(unit)
        k1, k2 = len(self.first), len(self.second)
        visits = min(visits, k1 * k2)
        out = np.empty((len(unit), visits), dtype=np.int64)
        for at in range(0, len(unit), step := max(1, piece // max(k1, k2))):
            x, y = a[at : at + step], b[at : at + step]
            da, db = squared(x, self.first), squared(y, self.second) if y.shape[1] else np.zeros((len(x), 1))
            oa, ob = (nearest(d, visits) for d in (da, db))
            da, db = np.take_along_axis(da, oa, 1), np.take_along_axis(db, ob, 1)
            rows = np.arange(len(x))
            after = np.zeros(da.shape, dtype=np.int64)  # the next of the second half for each of the first
            sums = np.full(da.shape, np.inf)
            sums[:, 0] = da[:, 0] + db[:, 0]
            for v in range(visits):
                i = sums.argmin(axis=1)
                j = after[rows, i]
                out[at : at + step, v] = oa[rows, i] * k2 + ob[rows, j]
                more = j + 1 < db.shape[1]
                sums[rows, i] = np.where(more, da[rows, i] + db[rows, np.minimum(j + 1, db.shape[1] - 1)], np.inf)
                after[rows, i] = j + 1
                new = np.flatnonzero((j == 0) & (i + 1 < da.shape[1]))
                sums[new, i[new] + 1] = da[new, i[new] + 1] + db[new, 0]
        return out


@dataclass
class Placing:
    """A grid over the dimensions in `order`, and how many chunks each cell is cut into."""

    order: np.ndarray
    grid: Grid
    parts: np.ndarray
    regions: int

    def tasks(self, at: int) -> int:
        """The first number after those that the tasks of this grid have, which begin with `at`."""
        return at + self.regions + int((self.parts[self.parts > 1].astype(np.int64) ** 2).sum())

    def visits(self, unit: np.ndarray) -> np.ndarray:
        return self.grid.nearest_cells(unit.astype(np.float32)[:, self.order], self.grid.visits)

    def dealt(self, unit: np.ndarray, rep: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        """Row, cell, task and side of each visit. A cell in one piece, or a chunk with itself, has side 0; where two chunks meet these are sides 1 and 2."""
        return self.sent(self.visits(unit), rep, at)

    def sent(self, cells: np.ndarray, rep: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        row, cell = np.repeat(np.arange(len(cells)), cells.shape[1]), cells.ravel()
        task, side = at + cell % self.regions, np.zeros(len(cell), dtype=np.int8)
        hot = np.flatnonzero(self.parts[cell] > 1)
        if len(hot):
            squares = np.where(self.parts > 1, self.parts.astype(np.int64) ** 2, 0)
            first = at + self.regions + np.cumsum(squares) - squares
            many = self.parts[cell[hot]]
            own = np.repeat(_hashed(rep[row[hot]]) % many, many)
            other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            again, cold = np.repeat(hot, many), np.flatnonzero(self.parts[cell] <= 1)
            low, high = np.minimum(own, other), np.maximum(own, other)
            task = np.concatenate([task[cold], first[cell[again]] + low * self.parts[cell[again]] + high])
            side = np.concatenate([side[cold], np.sign(own - other).astype(np.int8) % 3])
            row, cell = np.concatenate([row[cold], row[again]]), np.concatenate([cell[cold], cell[again]])
        return row, cell, task, side


def _hashed(x: np.ndarray) -> np.ndarray:
    """Mixed bits of whole numbers, not negative."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def moved_rows(unit: np.ndarray, least: float, seed: int = 4) -> np.ndarray:
    """Each row turned in some direction until its cosine with what it was is `least`."""
    side = np.random.default_rng(seed).normal(size=unit.shape)
    side = side - (side * unit).sum(axis=1)[:, None] * unit
    norm = np.sqrt((side**2).sum(axis=1))[:, None]
    return np.where(norm > 1e-9, least * unit + np.sqrt(1 - least**2) * side / np.maximum(norm, 1e-9), unit)


def fit_grids(sample: np.ndarray, n: int, least: float, recall: float, per_cell: int, crowd: int, visits: int = 3, most: int = 32, region: int = 1 << 15) -> list[Placing]:
    """Grids for n vectors, as fine as `per_cell` asks for, as many as the target recall needs; if that would be over `most`,
    they are made coarser until it is reached (a single cell holds all, so in the end every pair meets)."""
    unit = unit_rows(sample)
    fit, tried = unit[: max(1, len(unit) * 2 // 3)], unit[-max(1, len(unit) // 3) :]  # codebooks fit what they were made of too well
    moved = moved_rows(tried, least)
    k = max(1, min(len(fit), int(np.ceil(np.sqrt(n / per_cell)))))
    while True:
        rng, found, missed = np.random.default_rng(5), [], np.ones(len(tried), dtype=bool)
        while missed.sum() > (1 - recall) * len(tried) and len(found) < most:
            order = rng.permutation(unit.shape[1])
            a, b = halves(fit[:, order].astype(np.float32))
            seed = 2 + 2 * len(found)
            grid = Grid(codebook(a, k, seed=seed), codebook(b, k, seed=seed + 1) if b.shape[1] else np.zeros((1, 0), np.float32))
            grid.visits = min(visits, len(grid.first) * len(grid.second))
            placing = Placing(order, grid, np.ones(len(grid.first) * len(grid.second), dtype=np.int32), max(1, -(-n * grid.visits // region)))
            here, there = placing.visits(unit), placing.visits(moved)
            missed &= ~(here[-len(tried) :, :, None] == there[:, None]).any(axis=(1, 2))
            crowds = np.bincount(here.ravel(), minlength=len(placing.parts)) * (n / len(unit))
            placing.parts = np.maximum(1, np.ceil(crowds / crowd)).astype(np.int32)
            found.append(placing)
        if missed.sum() <= (1 - recall) * len(tried):
            return found
        k = max(1, k // 2)


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each component, and of each row the step that they count in and the length of what they miss (rounded up)."""
    step = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    code = np.clip(np.rint(unit / step[:, None]), -127, 127).astype(np.int8)
    missed = lengths(unit - code * step[:, None].astype(np.float64))
    return code, np.stack([step, (missed * (1 + 1e-6) + 1e-7).astype(np.float32)], axis=1)


def bounds(code: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices (left, right): left[i] @ right[j] is at least the cosine of the vectors i and j, up to the rounding of floats."""
    x = code * fit[:, :1]
    size, missed = lengths(x)[:, None], fit[:, 1:]
    return np.concatenate([x, missed, size, missed], axis=1), np.concatenate([x, size, missed, missed], axis=1)


MET = "task long, dim int, cell binary, side binary, rep binary, code binary, fit binary"


def _dealt(placings: dict[int, tuple[int, Placing]], kind: str, most: int = 1 << 16):
    """Distinct vectors -> codes by task, those of many vectors in one row. placings: by dimension, with the number of the first task."""

    def packed(dim: int, rep: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, placing = placings[dim]
        code, fit = coded(unit)
        row, cell, task, side = placing.dealt(unit, rep, at)
        order = np.lexsort((cell, task))
        starts = np.flatnonzero(np.diff(task[order], prepend=-1))
        for a in range(0, len(starts), 512):
            out = []
            for begin, end in zip(starts[a : a + 512], [*starts[a + 1 : a + 513], len(order)]):
                own = order[begin:end]
                r = row[own]
                # bytes of ids by place, as most of the upper ones are equal and pack well
                out.append((int(task[own[0]]), dim, cell[own].astype("<i4").tobytes(), side[own].tobytes(), rep[r].view(np.uint8).reshape(-1, 8).T.tobytes(), code[r].tobytes(), fit[r].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.binary()] * 5))], names=["task", "dim", "cell", "side", "rep", "code", "fit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> Iterator[pa.RecordBatch]:
            rep, unit = (np.concatenate(x) for x in zip(*kept.pop(dim)))
            yield from packed(dim, rep, unit)

        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims).tolist():
                if dim in placings:
                    part = batch.filter(pa.array(dims == dim))
                    kept.setdefault(dim, []).append((np.array(part.column(0)), unit_rows(matrix(part.column(1), kind))))
                    if sum(len(x) for x, _ in kept[dim]) * dim >= most * 64:
                        yield from flush(dim)
        for dim in list(kept):
            yield from flush(dim)

    return run


def _met(least: float, piece: int = 1 << 22):
    """The codes of a task -> (a, b): a forest of the pairs in its cells that may link."""

    def run(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        cell, side, code, fit = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=d) for c, d in (("cell", "<i4"), ("side", "i1"), ("code", "i1"), ("fit", "<f4")))
        rep = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T.copy().view("<i8")[:, 0] for x in rows.column("rep").to_pylist()])
        order = np.argsort(cell, kind="stable")
        starts = [*np.flatnonzero(np.diff(cell[order], prepend=-1)), len(order)]
        code, fit = code.reshape(-1, dim), fit.reshape(-1, 2)
        found = [np.empty((2, 0), dtype=np.int64)]
        for begin, end in zip(starts[:-1], starts[1:]):
            if end - begin < 2:
                continue
            own = order[begin:end]
            labels = forest(code[own], fit[own], side[own], least, piece)
            up = np.flatnonzero(labels != np.arange(len(own)))
            found.append(np.stack([rep[own[up]], rep[own[labels[up]]]]))
        a, b = np.concatenate(found, axis=1)
        return pa.table({"a": a, "b": b})

    return run


def forest(code: np.ndarray, fit: np.ndarray, side: np.ndarray, least: float, piece: int = 1 << 22) -> np.ndarray:
    """Labels of sets (each by its first member) that the pairs which may link make: all pairs, or those of sides 1 and 2.
    What is near to one head is one set at once, so large groups of near copies are held against the others only."""
    left, right = bounds(code, fit)
    least = np.float32(least - 1e-4)
    labels = np.arange(len(code))
    p, q = np.flatnonzero(side < 2), np.flatnonzero(side == 2)
    apart = bool(side.any())

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        if len(i) > len(j):
            i, j = j, i
        for a in range(0, len(i), step := max(1, piece // max(1, len(j)))):
            part = i[a : a + step]
            for b in range(0, len(j), piece):
                held = j[b : b + piece]
                x, y = np.divmod(np.flatnonzero(left[part] @ right[held].T >= least), len(held))
                merge_labels(labels, part[x], held[y])

    while len(p):
        if len(p) + len(q) > 2048:
            heads = p[:: max(1, len(p) // 8)][:8]
            near_p, near_q = (left[x] @ right[heads].T >= least for x in (p, q))
            best = int((near_p.sum(axis=0) + near_q.sum(axis=0)).argmax())
            near_p, near_q = near_p[:, best] | (p == heads[best]), near_q[:, best]
            if (near_p.sum() + near_q.sum()) * 8 >= len(p) + len(q):
                star = np.concatenate([p[near_p], q[near_q]])
                merge_labels(labels, star, np.full(len(star), heads[best]))
                pairs(p[near_p], q[~near_q] if apart else p[~near_p])
                pairs(p[~near_p], q[near_q])
                p, q = p[~near_p], q[~near_q]
                continue
        for a in range(0, 0 if apart else len(p), 256):
            pairs(p[a : a + 256], p[a:])
        pairs(p, q)
        break
    return labels


def linked(p: np.ndarray, q: np.ndarray, rep_p: np.ndarray, rep_q: np.ndarray, least: float) -> np.ndarray:
    """For unit vectors which of q link with which of p, as a matrix; vectors of one id don't."""
    cosine = q @ p.T
    near = cosine >= least + 1e-9
    i, j = np.nonzero(np.abs(cosine - least) < 1e-9)
    near[i, j] = np.einsum("ij,ij->i", q[i], p[j]) >= least
    return near & (rep_q[:, None] != rep_p)


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
    """Joins the sets of a[i] and b[j] where near[i, j]; overwrites near. The first of each row joins most sets, few pairs are left then."""
    while True:
        near &= labels[a, None] != labels[b]
        i = np.flatnonzero(near.any(axis=1))
        if not len(i):
            return
        merge_labels(labels, a[i], b[near[i].argmax(axis=1)])


def told(rep: np.ndarray, counts: np.ndarray, labels: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """(a, b, n): links counted (n > 0), and a forest of labels (n = 0)."""
    some, up = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(labels)))
    nothing = np.zeros(len(some), dtype=np.int64), np.zeros(len(up), dtype=np.int64)
    return pd.DataFrame({"a": np.concatenate([rep[some], names[up]]), "b": np.concatenate([nothing[0], names[labels[up]]]), "n": np.concatenate([counts[some], nothing[1]])})


LINKS = "a long, b long, n long"


def _units(rows: pd.DataFrame, kind: str) -> np.ndarray:
    return unit_rows(np.frombuffer(b"".join(rows["vec"]), dtype=kind).reshape(len(rows), -1).astype(np.float64))


def _compared(least: float, kind: str, piece: int = 1 << 21):
    """Whole components (component, dim, rep, copies, vec), some in a task -> LINKS."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        unit, rep, copies = _units(rows, kind), rows["rep"].to_numpy(), rows["copies"].to_numpy()
        names, node = np.unique(rep, return_inverse=True)
        counts, labels = np.zeros(len(unit), dtype=np.int64), np.arange(len(names))
        for a in range(0, len(unit), step := max(1, piece // len(unit))):
            part = slice(a, a + step)
            near = linked(unit, unit[part], rep, rep[part], least)
            counts[part] = near @ copies
            joined(labels, node[part], node, near)
        return told(rep, counts, labels, names)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([compare(some) for _, some in rows.groupby(["component", "dim"], sort=False)], ignore_index=True)

    return run


LARGE = "rep long, vec binary, dim int, copies long, component long, core boolean, cells binary"


def _placed(heads: dict[tuple[int, int], np.ndarray], grids: dict[int, list[Placing]], least: float, kind: str):
    """Vectors of large components -> LARGE: whether each is in the core, within half the largest angle of its component's head, and the cells that it
    visits of all grids."""
    core = np.sqrt((1 + least) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                unit, component = unit_rows(matrix(part.column(1), kind)), np.asarray(part.column(4))
                near = np.zeros(len(unit), dtype=bool)
                for c in np.unique(component).tolist():
                    if (c, dim) in heads:
                        own = component == c
                        near[own] = unit[own] @ heads[c, dim] >= core
                cells = np.concatenate([x.visits(unit) for x in grids[dim]], axis=1).astype("<i4")
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(5)), pa.array(near), pa.array([x.tobytes() for x in cells], pa.binary())], names=["rep", "vec", "dim", "copies", "component", "core", "cells"])

    return run


def _sent(placings: dict[int, tuple[int, Placing]], k: int, passes: int, turn: int):
    """LARGE -> a row for each cell of grid k that a vector visits, of the cells whose turn it is, with task, cell and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims).tolist():
                if dim not in placings:
                    continue
                at, placing = placings[dim]
                part = batch.filter(pa.array(dims == dim))
                v = placing.grid.visits
                row, cell, task, side = placing.sent(matrix(part.column(6), "<i4")[:, k * v : (k + 1) * v].astype(np.int64), np.asarray(part.column(0)), at)
                own = np.flatnonzero(_hashed(cell) % passes == turn)
                for a in range(0, len(own), 1 << 14):
                    o = own[a : a + (1 << 14)]
                    some = part.take(pa.array(row[o]))
                    yield pa.RecordBatch.from_arrays([pa.array(task[o]), pa.array(cell[o]), pa.array(side[o].astype(np.int32)), *some.columns], names=["task", "cell", "side", *some.schema.names])

    return run


def _counted(k: int, visits: dict[int, int], least: float, kind: str, piece: int = 1 << 20):
    """The rows of a task -> LINKS of the pairs in its cells, but for pairs inside of a core and such as meet in an earlier grid or cell."""

    def earlier(a: np.ndarray, b: np.ndarray, cell: int, v: int) -> np.ndarray:
        """Matrix: whether rows of cells share one of grid 0, or of grid k one before `cell`."""
        met = np.zeros((len(a), len(b)), dtype=bool)
        for i in range(v):
            for j in range(v):
                if k:
                    met |= a[:, i, None] == b[:, j]
                met |= np.where(a[:, k * v + i] < cell, a[:, k * v + i], -1)[:, None] == b[:, k * v + j]
        return met

    def between(a: np.ndarray, b: np.ndarray, v: int) -> np.ndarray:
        """For pairs of rows: whether they share a cell of the grids from 1 to k - 1."""
        met = np.zeros(len(a), dtype=bool)
        for g in range(1, k):
            for i in range(g * v, (g + 1) * v):
                for j in range(g * v, (g + 1) * v):
                    met |= a[:, i] == b[:, j]
        return met

    def compare(rows: pd.DataFrame, cell: int) -> pd.DataFrame:
        rep, copies, core, side = (rows[c].to_numpy() for c in ("rep", "copies", "core", "side"))
        unit, cells = _units(rows, kind), np.frombuffer(b"".join(rows["cells"]), dtype="<i4").reshape(len(rows), -1)
        v = visits[int(rows["dim"].iloc[0])]
        names, node = np.unique(rep, return_inverse=True)
        counts, labels = np.zeros(len(unit), dtype=np.int64), np.arange(len(names))
        apart, others = bool(side.any()), np.flatnonzero(~core)
        for mine, against in ([(1, 2), (2, 1)] if apart else [(0, 0)]):
            asked, held = others[side[others] == mine], np.flatnonzero(side == against)
            if mine == 2:
                held = held[core[held]]  # two outside of the core have met the other way round
            for a in range(0, len(asked), step := max(1, piece // max(1, len(held)))):
                part = asked[a : a + step]
                new = ~earlier(cells[part], cells[held], cell, v)
                if not apart:
                    new &= core[held] | (part[:, None] < held)
                some = np.flatnonzero(new.any(axis=0))
                if not len(some):
                    continue
                other = held[some]
                near = linked(unit[other], unit[part], rep[other], rep[part], least) & new[:, some]
                if k > 1:
                    i, j = np.nonzero(near)
                    near[i, j] = ~between(cells[part[i]], cells[other[j]], v)
                counts[part] += near @ copies[other]
                counts[other] += copies[part] @ near
                joined(labels, node[part], node[other], near)
        return told(rep, counts, labels, names)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [compare(some, key[0]) for key, some in rows.groupby(["cell", "component", "dim"], sort=False) if len(some) > 1 and not some["core"].all()]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in "abn"})

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST, recall: float = RECALL, per_cell: int = 256, chunk: int = 1 << 14, embedding: str = "embedding", row_id: str = "vec_id", crowd: int = 1 << 17) -> DataFrame:
    """row_id, n_links, component_id, kept for each row of vectors."""
    with shuffles_dropped(vectors.sparkSession):
        known = _known(vectors, least, recall, per_cell, chunk, embedding, row_id, crowd)
    every = vectors.select(F.col(row_id).cast("long").alias(row_id))
    every = every.join(known, every[row_id] == known.id, "left")
    component = F.coalesce("component_id", row_id)
    return every.select(row_id, F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(row_id), F.lit(True)).alias("kept"))


def _tasks(grids: dict[int, list[Placing]], k: int) -> dict[int, tuple[int, Placing]]:
    """Of each dimension that has a grid k the number of its first task, and the grid."""
    found, at = {}, 0
    for dim, own in grids.items():
        if k < len(own):
            found[dim] = (at, own[k])
            at = own[k].tasks(at)
    return found


def _known(vectors: DataFrame, least: float, recall: float, per_cell: int, chunk: int, embedding: str, row_id: str, crowd: int) -> DataFrame:
    """(id, n_links, component_id) of those that link or have copies."""
    kind = narrowest(vectors, embedding)
    valid = valid_vectors(vectors, embedding, row_id, kind)
    distinct = written(valid.groupBy("vec", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", "vec", "dim", "copies"), "multi-distinct")
    grids: dict[int, list[Placing]] = {}
    for row in distinct.groupBy("dim").count().orderBy("dim").collect():  # a row for each dimension in use
        some = distinct.where(F.col("dim") == row["dim"]).orderBy(F.xxhash64(F.lit(17), "vec"), "rep").limit(SAMPLE).select("vec").toPandas()
        grids[row["dim"]] = fit_grids(np.stack([np.frombuffer(v, dtype=kind) for v in some["vec"]]).astype(np.float64), row["count"], least, recall, per_cell, crowd)
    pairs = []
    for k in range(max(map(len, grids.values()), default=0)):
        codes = distinct.select("rep", "vec", "dim").mapInArrow(_dealt(_tasks(grids, k), kind), MET)
        pairs.append(written(codes.groupBy("task").applyInArrow(_met(least), "a long, b long"), f"multi-met-{k}"))
    if not pairs:
        return distinct.select(F.col("rep").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id")).limit(0)
    edges = pairs[0]
    for more in pairs[1:]:
        edges = edges.unionByName(more)
    found = _links(distinct, connected_components(written(edges.distinct(), "multi-near-edges"), "multi-near"), grids, least, chunk, kind)
    counts = found.where(F.col("n") > 0).groupBy("a").agg(F.sum("n").alias("n"))
    joined = connected_components(found.where(F.col("n") == 0).select("a", "b"), "multi")
    classes = written(joined.join(counts, joined.node == counts.a, "left").select("node", "component", F.coalesce("n", F.lit(0)).alias("n")), "multi-classes")
    repeated = distinct.where(F.col("copies") > 1)
    names = classes.select(F.col("node").alias("id"), F.col("node").alias("rep"), F.lit(1).cast("long").alias("copies"))
    if not repeated.isEmpty():
        hashes = [F.xxhash64(F.lit(seed), "vec").alias(h) for seed, h in ((17, "h1"), (29, "h2"))]
        twins = bounded_broadcast(repeated.select(*hashes, F.col("dim").alias("d"), "rep", "copies"))
        ids = valid.select("id", "dim", *hashes)
        names = names.unionByName(ids.join(twins, ["h1", "h2"]).where(F.col("dim") == F.col("d")).select("id", "rep", "copies").distinct())
    n_links, component = F.coalesce("n", F.lit(0)) + F.col("copies") - 1, F.coalesce("component", "rep")
    known = names.join(classes, names.rep == classes.node, "left").groupBy("id").agg(F.max(n_links).alias("n_links"), F.min(component).alias("component_id"))
    return written(known, "multi-known")


def _links(distinct: DataFrame, groups: DataFrame, grids: dict[int, list[Placing]], least: float, chunk: int, kind: str) -> DataFrame:
    """(a, b, n): the number of links of a (n > 0), or an edge of a forest of all links (n = 0), of the pairs inside of a group (node, component)."""
    sizes = groups.groupBy("component").count()
    large = [(r["component"], r["count"]) for r in sizes.where(F.col("count") > chunk).collect()]  # at most one for each `chunk` vectors
    near = written(distinct.join(bounded_broadcast(groups), distinct.rep == groups.node).select("rep", "vec", "dim", "copies", "component"), "multi-near-vectors")
    if not large:
        return written(_of_whole(near, groups, least, chunk, kind), "multi-links")
    large = F.broadcast(distinct.sparkSession.createDataFrame(large, "large long, size long"))
    some = near.join(large, near.component == large.large).where(F.pmod(F.xxhash64(F.lit(23), "vec"), F.col("size")) < 16).select("component", "dim", "vec")
    heads = _heads(some.toPandas(), least, kind)  # some 16 for each `chunk` vectors
    found = [written(_of_whole(near.join(large, near.component == large.large, "left_anti"), groups, least, chunk, kind), "multi-links")]
    members = written(near.join(large, near.component == large.large, "left_semi").mapInArrow(_placed(heads, grids, least, kind), LARGE), "multi-large")
    core = members.where("core").groupBy("component", "dim", "rep").agg(F.sum("copies").alias("own"), F.count(F.lit(1)).alias("vectors"))
    total = core.groupBy("component", "dim").agg(F.sum("own").alias("total"), F.min("rep").alias("first"))
    core = written(core.join(F.broadcast(total), ["component", "dim"]).select("rep", "first", (F.col("vectors") * (F.col("total") - F.col("own"))).alias("n")), "multi-core")
    found.append(core.where(F.col("n") > 0).select(F.col("rep").alias("a"), F.lit(0).cast("long").alias("b"), "n"))
    found.append(core.where(F.col("rep") != F.col("first")).select(F.col("rep").alias("a"), F.col("first").alias("b"), F.lit(0).cast("long").alias("n")))
    # components that are all core are settled; of the others so many cells at a time that a pass deals out each vector of the table about once
    open_ones = F.broadcast(members.where("not core").select(F.col("component").alias("open")).distinct())
    members = members.join(open_ones, members.component == open_ones.open, "left_semi")
    visits = {dim: own[0].grid.visits for dim, own in grids.items()}
    if n := members.count():
        passes = -(-n * max(visits.values()) // distinct.count())
        for k in range(max(map(len, grids.values()))):
            for turn in range(passes):
                sent = members.mapInArrow(_sent(_tasks(grids, k), k, passes, turn), f"task long, cell long, side int, {LARGE}")
                found.append(written(sent.groupBy("task").applyInPandas(_counted(k, visits, least, kind), LINKS), f"multi-links-{k}-{turn}"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _heads(some: pd.DataFrame, least: float, kind: str) -> dict[tuple[int, int], np.ndarray]:
    """By component and dimension the one of some vectors that has most of the others within half the largest angle."""
    found = {}
    for key, rows in some.groupby(["component", "dim"]):
        unit = _units(rows, kind)
        found[key] = unit[int((unit @ unit.T >= np.sqrt((1 + least) / 2)).sum(axis=1).argmax())]
    return found


def _of_whole(near: DataFrame, groups: DataFrame, least: float, chunk: int, kind: str) -> DataFrame:
    """LINKS of components that one task can hold, many to a task."""
    tasks = 1 + 4 * groups.count() // chunk
    return near.withColumn("task", F.pmod(F.xxhash64("component"), F.lit(tasks))).groupBy("task").applyInPandas(_compared(least, kind), LINKS)


#: All pairs, so for small tables only.
OP9_SQL = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
