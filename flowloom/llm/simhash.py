"""SimHash near-dedup by binary trie self-joins.

Fingerprint: texts are lower-cased (A-Z), cut to words at ASCII white space; every shingle of `width` words, joined by
one space, is hashed by XXH64 (seed 42). A bit is set if it is set in over half of the hashes, repeats included. Fewer
words than `width` make one shingle; no words give fingerprint 0, which links like any other.

Join: distinct fingerprints are dealt to buckets by the bits that two linked ones must share: with `most` differing bits
and the 64 bits cut into `blocks` parts, at least blocks - most parts are equal, so a bucket is a choice of that many
parts and their bits. A bucket is sorted, which makes its binary trie a set of ranges; node pairs are traversed
together, level by level, adding up differing bits, and a pair is pruned once that exceeds `most`. Pairs of small
nodes are verified directly. A bucket of over `chunk` fingerprints is cut into chunks, and each pair of chunks is a task
of its own. A task returns a forest of its links, not the links, so groups of near copies stay linear.

Components of the links are found by components.connected_components on representatives (smallest doc_id of each
fingerprint).

Cases: null text counts as empty; very long texts are one fingerprint each, read whole; rows of one doc_id with several texts have a
fingerprint each, and fingerprints named by one doc_id are one group; null doc_id belongs to its fingerprint's group but never names one; repeated rows are
kept; ties don't arise (smallest doc_id); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import slices, table, text_column, written
from flowloom.llm.components import connected_components, merge_labels

WIDTH, MOST = 4, 4
CHUNK = 1 << 13


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and white space is 20 and 09 to 0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    lasts = (ends - 1).tolist()[width - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, lasts)), dtype="<u8", count=len(lasts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id and fp: the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = np.array([fingerprint(x, width) for x in text_column(batch, text).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, fp long")


def bucket_masks(blocks: int, most: int) -> list[int]:
    """A mask of shared bits for each choice of blocks - most parts."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(part[k] for k in chosen) for chosen in combinations(range(blocks), blocks - most)]


def trie_pairs(fps: np.ndarray, lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, most: int, small: int = 128, wide: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs within `most` bits between the tries of fps[lo_a:hi_a] and fps[lo_b:hi_b], each sorted; equal
    ranges are joined with themselves. Yields bounded pieces."""
    ones: dict[int, np.ndarray] = {}

    def split(level: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - level)) & np.uint64(1), dtype=np.int64)])
        return hi - (ones[level][hi] - ones[level][lo])

    todo = [(0, lo_a, hi_a, lo_b, hi_b, np.zeros(len(lo_a), dtype=np.int8))]
    while todo:
        level, la, ha, lb, hb, err = todo.pop()
        if len(la) > wide:
            half = len(la) // 2
            todo += [(level, *(x[s] for x in (la, ha, lb, hb, err))) for s in (slice(half, None), slice(None, half))]
            continue
        sizes = (ha - la) * (hb - lb)
        leaf = (sizes <= small) | (level == 64)
        if leaf.any():
            yield from _verified(fps, la[leaf], ha[leaf], lb[leaf], hb[leaf], most)
            go = ~leaf
            la, ha, lb, hb, err = la[go], ha[go], lb[go], hb[go], err[go]
        if not len(la):
            continue
        ma, mb = split(level, la, ha), split(level, lb, hb)
        same = (la == lb) & (ha == hb)
        nodes = [(la, ma, lb, mb, err), (ma, ha, mb, hb, err), (la, ma, mb, hb, err + 1), (ma[~same], ha[~same], lb[~same], mb[~same], err[~same] + 1)]
        la, ha, lb, hb, err = (np.concatenate(x) for x in zip(*nodes))
        keep = (ha > la) & (hb > lb) & (err <= most)
        todo.append((level + 1, *(x[keep] for x in (la, ha, lb, hb, err.astype(np.int8)))))


def _verified(fps: np.ndarray, la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray, most: int, piece: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (ha - la) * (hb - lb)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(la):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + piece, side="right")))
        n = sizes[at:to]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        across = np.repeat(hb[at:to] - lb[at:to], n)
        a, b = np.repeat(la[at:to], n) + k // across, np.repeat(lb[at:to], n) + k % across
        near = (np.bitwise_count(fps[a] ^ fps[b]) <= most) & (a != b)
        yield a[near], b[near]
        at = to


def _forests(most: int):
    """Rows (task, side, fp, rep) sorted by task, side, fp -> links (a, b) of representatives, a forest for each run of tasks."""

    def links(task: np.ndarray, side: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pd.DataFrame:
        ends = np.flatnonzero(np.r_[(task[1:] != task[:-1]) | (side[1:] != side[:-1]), True]) + 1
        starts = np.r_[0, ends[:-1]]
        first = side[starts] == 0
        second = np.flatnonzero(~first)
        alone = np.flatnonzero(first & ~np.r_[(task[starts[1:]] == task[starts[:-1]]) if len(starts) > 1 else np.zeros(0, bool), False])
        a, b = np.r_[alone, second - 1], np.r_[alone, second]
        paired = task[starts[a]] == task[starts[b]]
        a, b = a[paired], b[paired]
        reps, node = np.unique(rep, return_inverse=True)
        labels = np.arange(len(reps))
        for x, y in trie_pairs(fp.view(np.uint64), starts[a], ends[a], starts[b], ends[b], most):
            merge_labels(labels, node[x], node[y])
        linked = np.flatnonzero(labels != np.arange(len(reps)))
        return pd.DataFrame({"a": reps[linked], "b": reps[labels[linked]]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for part in parts:
            if not len(part):
                continue
            held.append(part)
            n += len(part)
            last = part["task"].to_numpy()[-1]
            if n > 100_000 and held[0]["task"].to_numpy()[0] != last:
                rows = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted((rows["task"].to_numpy() == last), True))  # the last task may go on
                yield links(*(rows[c].to_numpy()[:cut] for c in ("task", "side", "fp", "rep")))
                held = [rows.iloc[cut:]]
                n = len(held[0])
        if n:
            rows = pd.concat(held, ignore_index=True)
            yield links(*(rows[c].to_numpy() for c in ("task", "side", "fp", "rep")))

    return run


def near_links(distinct: DataFrame, most: int = MOST, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """distinct (fp, rep: long) -> links (a, b) of reps that connect what lies within `most` bits."""
    if blocks is None:  # about a thousand fingerprints to a bucket at most, if they were spread evenly
        blocks, n = most + 1, distinct.count()
        while blocks < 16 and n > 1024 * 2 ** (64 * (blocks - most) // blocks):
            blocks += 1
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in bucket_masks(blocks, most)])
    rows = distinct.select("fp", "rep", F.posexplode(masks).alias("choice", "mask"))
    rows = rows.select("fp", "rep", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    hot = written(rows.groupBy("choice", "bits").count().where(F.col("count") > chunk), "simhash-hot")
    hot = hot.select("choice", "bits", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    known = hot.count()
    if known:
        rows = rows.join(F.broadcast(hot) if known <= 100_000 else hot, ["choice", "bits"], "left")
    else:
        rows = rows.withColumn("chunks", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select(F.xxhash64("choice", "bits", low, high).alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "rep")
    # two tasks of one hash share ranges; that adds comparisons of other buckets, no wrong link, as each pair is verified
    unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))  # as a trie has it, high bit first
    return rows.repartition("task").sortWithinPartitions("task", "side", unsigned).mapInPandas(_forests(most), "a long, b long")


def simhash_components(docs: DataFrame, text: str = "text", width: int = WIDTH, most: int = MOST) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    prints = written(fingerprints(docs, text, width), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where(F.col("rep").isNotNull()), "simhash-distinct")
    found = connected_components(near_links(distinct, most), "simhash")
    classes = written(distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "simhash-classes")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", width: int = WIDTH, most: int = MOST) -> DataFrame:
    """The rows of docs whose doc_id names their group; all columns kept. Rows with null doc_id can't be named and stay; of
    rows that repeat a doc_id one stays."""
    return heads_only(docs, simhash_components(docs, text, width, most))


def heads_only(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of docs that components (doc_id, component_id for each row) name, as one_of_each has it."""
    found = written(components, "simhash-found")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = written(found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"), "simhash-repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
