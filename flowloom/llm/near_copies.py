"""Near copies by SimHash: groups of texts whose sets of WIDTH-word shingles have Jaccard similarity LEAST or more, over links.

Sets: words as in simhash (A-Z lowered, cut at ASCII white space), each shingle of `width` words hashed to 64 bits; fewer words
make one shingle, no words an empty set. Equal sets are one row, named by a hash of 64 bits, with their smallest doc_id. A set's
fingerprint has a bit where over half of its hashes have it.

Finding: a text has further SimHash bits, each of another hash of its shingles, for two sets of similarity 0.8 differ in 8 to 20 of 64 and share too few to be
dealt by these alone. A bucket is one of `tables` and its `bits` bits, about 64 sets (tables_of: more bits and tables for more sets): two sets of
similarity 0.8 agree in a bit with a chance of 0.8485 (smaller for few shingles, 0.8125 for 4 of 5), so none of the tables has both with a chance of 8 in ten million
(2 in ten thousand for 4 of 5). In a bucket simhash.trie_pairs joins the fingerprints with an error budget of BUDGET bits (a pair of similarity 0.8 is over it with a chance
of some 1 in a million), pairs that differ in over MORE of 128 further bits are left out, and what hangs together is a cluster of the bucket. Only clusters go on.

Check: what a cluster holds is verified by the exact similarity of the sets: first every set against one of its cluster, its head; then clusters that
are not in one group yet are joined by the same trie, without the pairs of the label that most of them have. Of their sets only those go on to the exact check, in parts that
hang together, that have another label's set within the budget which can be similar enough: by the two sizes, and by the parities of the sets, for two sets differ in at least as many
shingles as their parities do in bits. Neither leaves out a pair of similarity LEAST. Pairs with the head are known by then, pairs that have become one group meanwhile are skipped; no other pair is left out.

Large groups: in a bucket of over LARGE sets those near one of some of them are one cluster without being held against each other. A bucket or cluster of over `chunk` goes to tasks in
chunks, a pair of chunks to each.

Cases: null text counts as empty; empty sets are equal; rows with null doc_id belong to their set's group but never name one; repeated rows are
kept; an empty table gives an empty result; other columns are not read. Sets so small that no other one is similar enough are in no bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import bounded_broadcast, slices, text_column, utf8, written
from flowloom.llm.components import connected_components, merge_labels
from flowloom.llm.simhash import heads_only, trie_pairs
from flowloom.llm.words import NOT_SPACE, lowered, word_hashes, word_spans

WIDTH, LEAST = 5, 0.8
BUDGET, MORE = 26, 43
PARITY = 4
CHUNK, BUCKET = 512, 1 << 15
LARGE = 1024
_ODD = np.random.default_rng(42).integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def shingle_sets(col: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different shingle hashes of each text, one after the other, and the offsets of each text's."""
    raw, offsets = utf8(col)
    low = lowered(raw)
    starts, ends, doc = word_spans(low, offsets, NOT_SPACE)
    words = word_hashes(low, starts, ends)
    first = np.searchsorted(doc, np.arange(len(col) + 1))
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(col)), many)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
    last = first[owner + 1] if len(owner) else at
    h = np.zeros(len(owner), dtype=np.uint64)
    for j in range(width):
        here = at + j < last
        h[here] = _mixed((h[here] ^ words[at[here] + j]) + np.uint64(0x632BE59BD9B4E019))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], np.searchsorted(owner[new], np.arange(len(col) + 1))


def set_names(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set as a long; 0 for the empty one."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(_mixed(h ^ np.uint64(0xA5CB9243F0ACE1B5)), dtype=np.uint64)]
    return _mixed(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)


def set_fingerprints(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 64 bits of each set; 0 for the empty one."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    for bit in range(64) if len(full) else ():
        ones = np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int32), offsets[full])
        out[full] |= (2 * ones > sizes[full]).astype(np.uint64) << np.uint64(bit)
    return out


def set_parities(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """PARITY longs of each set: a bit is 1 if an odd number of its hashes fall on it. Two of them differ in no more bits than the sets in hashes."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, PARITY), dtype=np.uint64)
    if len(full):
        x = _mixed(h * _ODD[-1])
        bit, part = np.uint64(1) << (x & np.uint64(63)), (x >> np.uint64(6)) % np.uint64(PARITY)
        for k in range(PARITY):
            out[full, k] = np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), offsets[full])
    return out


def tables_of(n: int) -> tuple[int, int]:
    """Tables, and bits of each, for n texts: enough to share one with a chance of 1 - exp(-14) at similarity 0.8."""
    bits = min(16, max(10, int(np.ceil(np.log2(max(n, 1) / 64)))))
    return int(np.ceil(14 / 0.8485**bits)), bits


def further_bits(h: np.ndarray, offsets: np.ndarray, longs: int) -> np.ndarray:
    """As set_fingerprints, `longs` times 64 bits, each 64 of another hash. Eight bits are counted at once, in the bytes of a long, over 255 shingles at most."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), longs), dtype=np.uint64)
    if not len(full):
        return out
    parts = -(-sizes[full] // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(offsets[full], parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    ones = np.empty((len(full), 64), dtype=np.int64)
    for k in range(longs):
        x = _mixed(h * _ODD[k])
        for j in range(8):
            counts = np.add.reduceat((x >> np.uint64(j)) & np.uint64(0x0101010101010101), starts).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[:, j::8] = np.add.reduceat(counts, first, axis=0, dtype=np.int64)
        out[full, k] = np.packbits(2 * ones > sizes[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def sketches(docs: DataFrame, text: str, width: int, tables: int, bits: int) -> DataFrame:
    """doc_id, the name, size and fingerprint of its set, 128 further bits, and its bits of each table."""
    longs = 2 - (-tables * bits // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            h, offsets = shingle_sets(text_column(batch, text), width)
            sizes = np.diff(offsets)
            more = further_bits(h, offsets, longs)
            dealt = np.unpackbits(more[:, 2:].astype("<u8").view(np.uint8), axis=1, bitorder="little", count=tables * bits).reshape(-1, bits)
            keys = dealt.astype(np.int32) @ (1 << np.arange(bits, dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, tables, dtype=np.int32)), pa.array(keys.astype(np.int32)))
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            longs_of = [set_names(h, offsets), sizes.astype(np.int64), set_fingerprints(h, offsets).view(np.int64), more[:, 0].view(np.int64), more[:, 1].view(np.int64)]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(x)) for x in longs_of), lists], names=["doc_id", "name", "size", "fp", "more1", "more2", "keys"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, name long, size long, fp long, more1 long, more2 long, keys array<int>")


def _sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            h, offsets = shingle_sets(text_column(batch, text), width)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))
            parities = pa.ListArray.from_arrays(pa.array(np.arange(len(offsets), dtype=np.int32) * PARITY), pa.array(set_parities(h, offsets).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(set_names(h, offsets)), parities, lists], names=["name", "parity", "shingles"])

    return docs.select(text).mapInArrow(run, "name long, parity array<long>, shingles array<long>")


def similar(sets: list[np.ndarray], one: int, others: np.ndarray, least: float) -> np.ndarray:
    """Which of the other sets have similarity `least` at least with that one; sets are sorted."""
    mine = sets[one]
    sizes = np.array([len(sets[k]) for k in others.tolist()])
    every = np.concatenate([sets[k] for k in others.tolist()])
    at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
    both = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return both >= least * (len(mine) + sizes - both) - 1e-9


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes can have similarity `least` at least."""
    return np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9


def _clusters(budget: int, many: int = 100_000, least: float = LEAST):
    """Rows (task, fp, more1, more2, name, and size where it is known) sorted by task -> (bucket, name, head) of those with another one near, a bucket for each cluster of a task;
    its head is the name whose hash is smallest, so a large group has few heads over all buckets."""

    def near(fp: np.ndarray, more: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(fp[a] ^ fp[b]) <= budget) & (np.bitwise_count(more[a] ^ more[b]).sum(axis=1, dtype=np.int64) <= MORE) & _alike(size[a], size[b], least)

    def pairs(fp: np.ndarray, more: np.ndarray, size: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        large = ends - starts > LARGE
        for lo, hi in zip(starts[large].tolist(), ends[large].tolist()):
            probes = [(lead, lo + np.flatnonzero(near(fp, more, size, np.array([lead]), np.arange(lo, hi)))) for lead in np.linspace(lo, hi - 1, 8).astype(int).tolist()]
            lead, group = max(probes, key=lambda x: len(x[1]))
            yield np.full(len(group), lead), group
            rest = np.setdiff1d(np.arange(lo, hi), group)
            both = np.concatenate([rest, group])  # each sorted, as the rows are
            cut, n = len(rest), len(both)
            for i, j in trie_pairs(fp[both], *(np.array(x) for x in ([0, 0], [cut, cut], [0, cut], [cut, n])), budget):
                yield both[i], both[j]
        some = ends - starts > 1
        some &= ~large
        if some.any():
            yield from trie_pairs(fp, starts[some], ends[some], starts[some], ends[some], budget)

    def clusters(rows: pa.Table) -> pa.RecordBatch:
        task, fp, more1, more2, name = (rows.column(k).to_numpy() for k in range(5))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, task))
        task, fp, name = task[order], fp[order], name[order]
        more = np.column_stack([more1[order], more2[order]]).view(np.uint64)
        size = rows.column(5).to_numpy()[order] if rows.num_columns > 5 else np.ones(len(task), dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        labels = np.arange(len(task))
        for i, j in pairs(fp, more, size, starts, np.r_[starts[1:], len(task)]):
            ok = near(fp, more, size, i, j)
            merge_labels(labels, i[ok], j[ok])
        alone = np.bincount(labels, minlength=len(labels))[labels] == 1
        found = np.flatnonzero(~alone)
        by_hash = found[np.lexsort((_mixed(name[found].view(np.uint64) * _ODD[0]), labels[found]))]
        first = by_hash[np.r_[True, labels[by_hash[1:]] != labels[by_hash[:-1]]]] if len(found) else found
        head = name[first][np.searchsorted(labels[first], labels[found])]
        bucket = _mixed((task[found].view(np.uint64) ^ _mixed(name[labels[found]].view(np.uint64))) + np.uint64(0x632BE59BD9B4E019))
        return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(name[found]), pa.array(head)], names=["bucket", "name", "head"])

    return _whole_runs(clusters, many)


def _contested(least: float, budget: int, chunk: int, many: int = 100_000):
    """Rows (bucket, name, head, label, size, fp, parity) sorted by bucket -> (bucket, name, label, size, fp, is_major, majors, minors, small) of those that a set of another label
    may be similar to, but for pairs with the head; a bucket for each part that such pairs connect, with its chunks of the most frequent label and of the others."""

    def of_label(group: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a row has its group's most frequent label, how many rows do, and how many the group has."""
        order = np.lexsort((label, group))
        new = np.r_[True, (group[order[1:]] != group[order[:-1]]) | (label[order[1:]] != label[order[:-1]])]
        first = np.flatnonzero(new)
        run = np.empty(len(group), dtype=np.int64)
        run[order] = np.cumsum(new) - 1
        n, of = np.diff(np.r_[first, len(group)]), group[order[first]]
        by_size = np.lexsort((n, of))
        last = by_size[np.r_[of[by_size[1:]] != of[by_size[:-1]], True]]  # the longest run of each group, by group
        at = np.searchsorted(of[last], group)
        return run == last[at], n[last][at], np.bincount(np.searchsorted(of[last], group))[at]

    def contested(rows: pa.Table) -> pa.RecordBatch:
        bucket, name, head, label, size, fp = (rows.column(k).to_numpy() for k in range(6))
        parity = pc.list_flatten(rows.column(6)).to_numpy().reshape(-1, PARITY).view(np.uint64)
        is_major, most, n = of_label(bucket, label)
        order = np.flatnonzero(most < n)
        order = order[np.lexsort((fp.view(np.uint64)[order], is_major[order], bucket[order]))]
        bucket, name, head, label, size, fp, parity, is_major = (x[order] for x in (bucket, name, head, label, size, fp.view(np.uint64), parity, is_major))
        longs = np.ascontiguousarray(parity.T)
        total = len(order)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if total else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], total].astype(np.int64)[: len(starts)]
        cuts = starts + np.add.reduceat((~is_major).astype(np.int64), starts) if total else starts
        part = np.arange(total)
        for i, j in trie_pairs(fp, *(np.concatenate(x) for x in ((starts, starts), (cuts, cuts), (starts, cuts), (cuts, ends))), budget) if total else ():
            ok = (label[i] != label[j]) & (name[i] != head[i]) & (name[j] != head[j]) & _alike(size[i], size[j], least)
            i, j = i[ok], j[ok]
            apart = np.zeros(len(i), dtype=np.int64)
            for one in longs:
                apart += np.bitwise_count(one[i] ^ one[j])
            ok = apart <= (1 - least) / (1 + least) * (size[i] + size[j]) + 1e-6
            merge_labels(part, i[ok], j[ok])
        found = np.flatnonzero(np.bincount(part, minlength=total)[part] > 1)
        part = part[found]
        is_major, most, n = of_label(part, label[found]) if len(found) else (found > 0, found, found)
        within = _mixed((bucket[found].view(np.uint64) ^ _mixed(name[part].view(np.uint64))) + np.uint64(0x632BE59BD9B4E019)).view(np.int64)
        majors, minors = -(-most // chunk), np.maximum(-(-(n - most) // chunk), 1)
        columns = {"bucket": within, "name": name[found], "label": label[found], "size": size[found], "fp": fp[found].view(np.int64), "is_major": is_major, "majors": majors.astype(np.int32), "minors": minors.astype(np.int32), "small": n <= chunk}
        return pa.RecordBatch.from_pydict({k: pa.array(x) for k, x in columns.items()})

    return _whole_runs(contested, many)


def _whole_runs(made: Callable[[pa.Table], pa.RecordBatch], many: int):
    """Batches sorted by their first column -> what `made` makes of pieces of about `many` rows; no value of that column is in two of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tasks = np.asarray(batch.column(0))
            if not len(tasks):
                continue
            cut = int(np.flatnonzero(np.r_[True, tasks[1:] != tasks[:-1]])[-1])  # the last task may go on
            if sum(b.num_rows for b in held) + cut > many and (cut or held[-1].column(0)[-1].as_py() != tasks[0]):
                yield made(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield made(pa.Table.from_batches(held))

    return run


def candidates(distinct: DataFrame, least: float = LEAST, chunk: int = BUCKET, budget: int = BUDGET) -> DataFrame:
    """distinct (name, size, fp, more1, more2, keys) -> (bucket, name, head): clusters of sets that the trie self-joins of a bucket connect."""
    some = distinct.where(F.col("size") >= least * (F.col("size") + 1) - 1e-9)
    keys = some.select(F.posexplode("keys").alias("table", "key"))
    hot = written(keys.groupBy("table", "key").count().where(F.col("count") > chunk), "near-hot").select("table", "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    rows = some.select("name", "size", "fp", "more1", "more2", F.posexplode("keys").alias("table", "key"))
    task = F.xxhash64("table", "key")
    if not hot.isEmpty():
        rows = rows.join(bounded_broadcast(hot), ["table", "key"], "left").withColumn("own", F.pmod(F.xxhash64("name"), F.coalesce("chunks", F.lit(1))).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        task = F.xxhash64("table", "key", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(task.alias("task"), "fp", "more1", "more2", "name", "size")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(_clusters(budget, least=least), "bucket long, name long, head long")


def _bucket_links(least: float, budget: int):
    """Rows (task, side, fp, size, label, shingles), sorted by task, side and fp: side 1 where a task has a pair of chunks -> links (a, b)
    of labels, a forest for each task."""

    def links(side: np.ndarray, fp: np.ndarray, size: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        names, node = np.unique(label, return_inverse=True)
        group = np.arange(len(names))
        cut, n = int(np.searchsorted(side, 1)), len(side)
        if cut == n and len(names) == 1:
            return names[:0], names[:0]
        ranges = (0, n, 0, n) if cut == n else (0, cut, cut, n)
        for i, j in trie_pairs(fp.view(np.uint64), *(np.array([x]) for x in ranges), budget):
            keep = _alike(size[i], size[j], least)
            i, j = i[keep], j[keep]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
            for a, b in zip(edge, np.r_[edge[1:], len(i)] if len(i) else []):
                one, others = int(i[a]), j[a:b]
                while len(others := others[group[node[others]] != group[node[one]]]):
                    some, others = others[:64], others[64:]
                    near = some[similar(sets, one, some, least)]
                    merge_labels(group, np.full(len(near), node[one]), node[near])
        linked = np.flatnonzero(group != np.arange(len(names)))
        return names[linked], names[group[linked]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held)
                side, fp, size, label = (rows.column(k).to_numpy() for k in (1, 2, 3, 4))
                sets = [x for chunk in rows.column(5).chunks for x in np.split(np.asarray(chunk.flatten()).view(np.uint64), np.cumsum(chunk.value_lengths())[:-1])]
                a, b = links(side, fp, size, label, sets)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held.clear()

        for batch in batches:
            tasks = np.asarray(batch.column(0))
            edge = np.flatnonzero(np.r_[True, tasks[1:] != tasks[:-1]]) if len(tasks) else []
            for a, b in zip(edge, np.r_[edge[1:], len(tasks)] if len(tasks) else []):
                if held and held[-1].column(0)[0].as_py() != tasks[a]:
                    yield from flush()
                held.append(batch.slice(a, b - a))
        yield from flush()

    return run


def jaccard_links(docs: DataFrame, distinct: DataFrame, text: str = "text", width: int = WIDTH, least: float = LEAST, chunk: int = CHUNK, budget: int = BUDGET) -> DataFrame | None:
    """distinct (name, size, fp, more1, more2, keys) -> (node, component) over all links, None where no bucket has a cluster."""
    rows = written(candidates(distinct, least, max(chunk, min(BUCKET, 64 * chunk)), budget), "near-clusters")
    known = written(rows.select("name").distinct(), "near-known")
    if known.isEmpty():
        return None
    sets = written(_sets(docs, text, width).join(bounded_broadcast(known), "name", "left_semi").dropDuplicates(["name"]), "near-sets")

    facts = written(sets.select("name", "parity").join(distinct.select("name", "size", "fp"), "name"), "near-facts")
    pairs = rows.where(F.col("name") != F.col("head")).select(F.col("name").alias("a"), F.col("head").alias("b")).distinct()
    a, b = (facts.select(F.col("name").alias(x), F.col("size").alias(f"_{x}"), F.col("parity").alias(f"_p{x}")) for x in "ab")
    apart = sum(F.bit_count(F.col("_pa")[k].bitwiseXOR(F.col("_pb")[k])) for k in range(PARITY))
    near = (F.least("_a", "_b") >= least * F.greatest("_a", "_b") - 1e-9) & (apart <= (1 - least) / (1 + least) * (F.col("_a") + F.col("_b")) + 1e-6)  # of others none is similar enough
    pairs = written(pairs.join(a, "a").join(b, "b").where(near).select("a", "b"), "near-pairs")
    a, b = (sets.select(F.col("name").alias(x), F.col("shingles").alias(f"_{x}")) for x in "ab")
    both = pairs.join(b, "b").join(a, "a").withColumn("_n", F.size(F.array_intersect("_a", "_b")))
    links = written(both.where(F.col("_n") >= least * (F.size("_a") + F.size("_b") - F.col("_n")) - 1e-9).select("a", "b"), "near-stars")
    found = connected_components(links, "near-stars")

    # a row for each set first, as it comes with a row for each of its clusters
    own = facts.join(found.withColumnRenamed("node", "name"), "name", "left")
    own = written(own.select("name", F.coalesce("component", "name").alias("label"), "size", "fp", "parity"), "near-own")
    labelled = rows.join(own, "name").select("bucket", "name", "head", "label", "size", "fp", "parity")
    contested = labelled.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_contested(least, budget, chunk), "bucket long, name long, label long, size long, fp long, is_major boolean, majors int, minors int, small boolean")
    members = written(contested, "near-contested")
    # a small bucket is one task; else each pair of chunks of minor labels is one, and each chunk of the major label with one of minor labels
    is_major = F.col("is_major")
    own = F.pmod(F.xxhash64("name"), F.when(is_major, F.col("majors")).otherwise(F.col("minors"))).cast("int")
    others = F.sequence(F.lit(0), F.col("minors") - 1)
    with_minors = F.transform(others, lambda k: F.struct(F.when(is_major, -1 - F.col("own")).otherwise(F.least(k, F.col("own"))).alias("low"), F.when(is_major, k).otherwise(F.greatest(k, F.col("own"))).alias("high"), (~is_major & (F.col("own") > k)).cast("int").alias("side")))
    with_majors = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda k: F.struct((-1 - k).alias("low"), F.col("own").alias("high"), F.lit(1).alias("side")))
    places = F.when(F.col("small"), F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side")))).when(is_major, with_minors).otherwise(F.concat(with_minors, with_majors))
    members = members.withColumn("own", own).withColumn("place", F.explode(places))
    tasks = members.select(F.xxhash64("bucket", "place.low", "place.high").alias("task"), F.col("place.side").alias("side"), "fp", "size", "label", "name")
    tasks = written(tasks, "near-tasks").join(sets, "name").select("task", "side", "fp", "size", "label", "shingles")
    unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))  # as a trie has it, high bit first
    joined = tasks.repartition("task").sortWithinPartitions("task", "side", unsigned).mapInArrow(_bucket_links(least, budget), "a long, b long")
    more = written(joined, "near-links")
    return connected_components(links.unionByName(more), "near")


def near_components(docs: DataFrame, text: str = "text", width: int = WIDTH, least: float = LEAST, **options) -> DataFrame:
    """doc_id, name, component_id (the smallest doc_id of its group) for each row of docs."""
    prints = written(sketches(docs, text, width, *tables_of(docs.count())), "near-sketches")
    named = prints.where(F.col("doc_id").isNotNull()).groupBy("name")
    distinct = written(named.agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), *[F.first(c).alias(c) for c in ("fp", "more1", "more2", "keys")]), "near-distinct")
    found = jaccard_links(docs, distinct, text, width, least, **options)
    groups = distinct.select("name", "rep", F.col("name").alias("group"))
    if found is not None:
        groups = distinct.join(found, distinct.name == found.node, "left").select("name", "rep", F.coalesce("component", "name").alias("group"))
    groups = written(groups, "near-groups")
    heads = groups.groupBy("group").agg(F.min("rep").alias("component_id"))
    classes = written(groups.join(heads, "group").select("name", "component_id"), "near-classes")
    return prints.select("doc_id", "name").join(classes, "name", "left")


def one_of_each(docs: DataFrame, text: str = "text", width: int = WIDTH, least: float = LEAST, **options) -> DataFrame:
    """The rows of docs whose doc_id names their group, as simhash.one_of_each has it."""
    return heads_only(docs, near_components(docs, text, width, least, **options))
