"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts anywhere else.

A plain suffix array would carry `length` bytes for each byte of text. This one is sparse: in each window of `length`
bytes the leftmost smallest hash of its `LEAD`-byte strings names an anchor. Equal windows have equal anchors at equal
places, so only suffixes that start at anchors are compared. The starts whose windows share an anchor form a run, and
the runs partition the starts of a text. A run's segment is all bytes of its windows.

1. For each run: hashes of its anchor's leading bytes and of its segment (64 bits each, grouped on together).
2. Counts by both hashes, combined before the shuffle. A segment that occurs twice is covered whole. An anchor that has
   one segment only is done. The remaining segments, one copy of each, are cut from their texts.
3. Sampled splitters range-partition them by the leading bytes of their anchor's suffix, which keeps suffixes with equal
   leading bytes in one bucket. A bucket is sorted by multikey quicksort (eight bytes at a time, going on only among
   equal ones), once by the suffixes from the anchor on and once by the reversed bytes before it; neighbours' common
   prefixes tell for each depth which are equal. A window that starts `a` bytes before the anchor occurs twice where
   both its parts are equal. An anchor with over `hot` segments would overfill a bucket; its windows are counted by hash
   instead, as small rows combined before the shuffle. As a bucket's edges lie between leading bytes, and those of hot
   anchors don't come to buckets, comparing across a boundary comes down to these counts.
4. The covered intervals return to the texts, which lose them.

Cases: null texts count as empty; texts under `length` bytes lose nothing; doc_ids may repeat or be null: rows are known
by 128 bits of hashes of doc_id and text, and rows alike in both lose the same; repeated rows are copies of each other; empty
tables give an empty result; other columns, whatever their names, are kept by deduplicated() and not read by op6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import slices, table, text_column, utf8, written

LENGTH = 200
LEAD = 24
HOT = 1 << 14
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)
_PIECE = 1 << 22


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def lead_hashes(x: np.ndarray) -> np.ndarray:
    """The hash of each LEAD-byte string of x (uint8)."""
    h = x.astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4):
        h = _mixed(h[:-step] * _ODD + h[step:])
    n = len(x) - LEAD + 1
    return _mixed((h[:n] * _ODD + h[8 : 8 + n]) * _ODD + h[16 : 16 + n])


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost smallest of each `width` consecutive hashes, of which 40 bits count."""
    m = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)  # unique, and the leftmost of equal ones is smallest
    n = 1
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    if width > n:
        m = np.minimum(m[: len(m) - (width - n)], m[width - n :])
    return (m & _PLACE).astype(np.int64)


def prefix_hashes(x: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sums of byte * ODD**place up to each place; differences, multiplied to one power, are hashes of substrings."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers[: len(x)], dtype=np.uint64)])


def _powers(n: int, base: int = int(_ODD)) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_INVERSE = pow(int(_ODD), -1, 1 << 64)


def runs_of(x: np.ndarray, length: int, forward: np.ndarray, backward: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run: first start, number of starts, place of the anchor, hash of its lead, hash of the segment."""
    h = lead_hashes(x)
    at = anchors(h, length - LEAD + 1)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[lo, len(at)])
    q = at[lo]
    sums = prefix_hashes(x, forward)
    segment = (sums[lo + n + length - 1] - sums[lo]) * backward[lo]
    segment = _mixed(segment + (n * 1024 + (q - lo)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return lo, n, q, h[q], segment


def runs(texts: DataFrame, length: int) -> DataFrame:
    """(rid, text) -> the runs of each text. Very long texts are cut in pieces that overlap by length - 1 bytes, which only makes more runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, backward = _powers(1 << 12), _powers(1 << 12, _INVERSE)
        for batch in slices(batches, "text"):
            raw, offsets = utf8(text_column(batch, "text"))
            sizes = np.diff(offsets)
            need = min(int(sizes.max()), _PIECE + length) if len(sizes) else 0
            if need > len(forward):
                forward, backward = _powers(min(need * 5 // 4, _PIECE + length)), _powers(min(need * 5 // 4, _PIECE + length), _INVERSE)
            rows, found = [], []
            for k in np.flatnonzero(sizes >= length).tolist():
                for at in range(0, int(sizes[k]) - length + 1, _PIECE):
                    lo, n, q, lead, segment = runs_of(raw[offsets[k] + at : min(offsets[k] + at + _PIECE + length - 1, offsets[k + 1])], length, forward, backward)
                    rows.append(np.full(len(lo), k))
                    found.append((lo + at, n, q + at, lead, segment))
            if not found:
                continue
            rid = batch.column(batch.schema.get_field_index("rid")).take(pa.array(np.concatenate(rows)))
            lo, n, q, lead, segment = (np.concatenate(x) for x in zip(*found))
            columns = [rid] + [pa.array(x.astype(np.int32)) for x in (lo, n, q)] + [pa.array(x.view(np.int64)) for x in (lead, segment)]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "lo", "n", "q", "lead", "segment"])

    return texts.mapInArrow(run, "rid binary, lo int, n int, q int, lead long, segment long")


def packed(texts: DataFrame, text: str = "text") -> DataFrame:
    """The text column as zstd bytes, for a shuffle of whole texts; other columns stay."""
    kept = [c for c in texts.columns if c != text]
    schema = T.StructType([*(texts.schema[c] for c in kept), T.StructField(text, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, text):
            zipped = pa.array([pack(x) for x in text_column(batch, text).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), zipped], names=[*kept, text])

    return texts.mapInArrow(run, schema)


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows of bytes (their width a multiple of 8): the order, and each row's common prefix with the one before it
    in that order. Ranges of equal rows are sorted by their next eight bytes; a range of one is done."""
    n, width = rows.shape
    words = rows.view(">u8").astype(np.uint64).reshape(n, width // 8)
    order = np.arange(n)
    common = np.zeros(n, dtype=np.int64)
    group = np.zeros(n, dtype=np.int64)  # of the rows at the places in `todo`
    todo = np.arange(n)
    for k in range(width // 8):
        key = words[order[todo], k]
        by = np.lexsort((key, group))
        order[todo] = order[todo[by]]
        key, group = key[by], group[by]
        new = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        edge = np.flatnonzero(new & np.r_[False, group[1:] == group[:-1]])  # differs within its range here
        if len(edge):
            differ = key[edge] ^ key[edge - 1]
            common[todo[edge]] = 8 * k + sum((differ >> np.uint64(64 - 8 * b) == 0).astype(np.int64) for b in range(1, 8))
        group = np.cumsum(new)
        size = np.bincount(group)
        more = size[group] > 1
        todo, group = todo[more], group[more]
        if not len(todo):
            break
        common[todo[np.r_[False, group[1:] == group[:-1]]]] = width
    return order, common


def repeated_starts(n: np.ndarray, before: np.ndarray, segments: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start (from the run's first) whose window occurs twice, for each of a bucket's different segments;
    -1 and -1 if none. n: starts; before: the anchor's distance from the first start; ends: where a segment ends in
    `segments`."""
    m = len(n)
    starts = ends - (n + length - 1)
    anchor, ends, starts = ((x + 0).astype(np.int32) for x in (starts + before, ends, starts))
    width_r, width_l = -(-length // 8) * 8, -(-(length - LEAD) // 8) * 8
    place = np.arange(width_r, dtype=np.int32)
    at = anchor[:, None] + place
    right = np.where((at < ends[:, None]) & (place < length), segments[np.minimum(at, np.int32(len(segments) - 1))], 0).astype(np.uint8)
    place = np.arange(width_l, dtype=np.int32)
    at = anchor[:, None] - np.int32(1) - place
    left = np.where(at >= starts[:, None], segments[np.maximum(at, np.int32(0))], 0).astype(np.uint8)
    del at
    (order_r, common_r), (order_l, common_l) = multikey_order(right), multikey_order(left)
    first, last = np.full(m, -1), np.full(m, -1)
    rank_r, rank_l = np.empty(m, np.int64), np.empty(m, np.int64)
    lowest, highest = before - n + 1, before  # `a` of the last and of the first start
    for a in range(0, length - LEAD + 1):
        live = np.flatnonzero((lowest <= a) & (a <= highest))
        if len(live) < 2:
            continue
        rank_r[order_r] = np.cumsum(common_r < length - a)
        rank_l[order_l] = np.cumsum(common_l < a) if a else 1
        key = rank_r[live] * (m + 1) + rank_l[live]
        by = np.argsort(key, kind="stable")
        key = key[by]
        equal = key[1:] == key[:-1]
        twice = live[by[np.r_[False, equal] | np.r_[equal, False]]]
        start = before[twice] - a
        last[twice] = np.maximum(last[twice], start)
        first[twice] = np.where(first[twice] < 0, start, np.minimum(first[twice], start))
    return first, last


_CUT = "lead long, segment long, lo int, n int, before int, leading binary, bytes binary"
_COVERED = "lead long, segment long, first int, last int"


def _cut(length: int):
    """Texts with the runs to cut from each -> segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            raw, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            wanted = batch.column(batch.schema.get_field_index("wanted"))
            flat = wanted.flatten()
            lo, n, q = (np.asarray(flat.field(c)).astype(np.int64) for c in ("lo", "n", "q"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(wanted.offsets)))
            text = raw.tobytes()
            base = offsets[row]
            leading = [text[a : a + LEAD] for a in (base + q).tolist()]
            cut = [text[a:b] for a, b in zip((base + lo).tolist(), (base + lo + n + length - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [flat.field("lead"), flat.field("segment"), flat.field("lo"), flat.field("n"), pa.array((q - lo).astype(np.int32)), pa.array(leading, pa.binary()), pa.array(cut, pa.binary())],
                names=["lead", "segment", "lo", "n", "before", "leading", "bytes"],
            )

    return run


def _bucket(length: int, piece: int = 8_000):
    """A bucket, sorted by leading bytes -> covered starts; whole groups of leading bytes are compared together."""

    def done(rows: pa.Table) -> list[pa.RecordBatch]:
        rows = rows.combine_chunks()
        lead, segment = (rows.column(c).to_numpy() for c in ("lead", "segment"))
        rows = rows.filter(pa.array(np.r_[True, (lead[1:] != lead[:-1]) | (segment[1:] != segment[:-1])]))  # of repeated rows
        data, offsets = utf8(rows.column("bytes").combine_chunks())
        n, before = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "before"))
        first, last = repeated_starts(n, before, data, offsets[1:], length)
        out = pa.table({"lead": rows.column("lead"), "segment": rows.column("segment"), "first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32))})
        return out.filter(pa.array(first >= 0)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]).select(["lead", "segment", "n", "before", "bytes"]))
            count += batch.num_rows
            if count > piece:
                rows = pa.concat_tables(held)
                lead = rows.column("lead").to_numpy()
                cut = int(np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])[-1])  # the last group may go on
                if cut:
                    yield from done(rows.slice(0, cut))
                    held, count = [rows.slice(cut)], rows.num_rows - cut
        if count:
            yield from done(pa.concat_tables(held))

    return run


def _windows(length: int):
    """Segments of hot anchors -> a row for each window: two hashes, and where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 20):
            lead, segment = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("lead", "segment"))
            n = np.asarray(batch.column(batch.schema.get_field_index("n"))).astype(np.int64)
            texts = batch.column(batch.schema.get_field_index("bytes")).to_pylist()
            hashes = np.frombuffer(b"".join(hashlib.blake2b(t[k : k + length], digest_size=16).digest() for t, m in zip(texts, n.tolist()) for k in range(m)), dtype="<i8").reshape(-1, 2)
            start = np.concatenate([np.arange(m) for m in n]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(lead, n)), pa.array(np.repeat(segment, n)), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), pa.array(start)], names=["lead", "segment", "h1", "h2", "start"]
            )

    return run


def covered_segments(texts: DataFrame, repeats: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(lead, segment, first, last): of segments with starts whose window occurs twice, the first and the last of these.
    repeats: the runs whose lead occurs twice at least."""
    copies = repeats.groupBy("lead", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "lo", "n", "q")).alias("at"))
    copies = written(copies, "suffix-segments")
    kinds = written(copies.groupBy("lead").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1), "suffix-kinds")
    whole = copies.where(F.col("copies") > 1).select("lead", "segment", F.lit(0).alias("first"), (F.col("at.n") - 1).alias("last"))
    compare = copies.join(kinds, "lead").select("lead", "segment", "at.*")
    wanted = compare.groupBy("rid").agg(F.collect_list(F.struct("lead", "segment", "lo", "n", "q")).alias("wanted"))
    cut = written(packed(texts).join(wanted, "rid").select("text", "wanted").mapInArrow(_cut(length), _CUT), "suffix-cut")
    many = written(kinds.where(F.col("kinds") > hot).select("lead"), "suffix-hot")
    if (n_hot := many.count()) == 0:
        few, heavy = cut, None
    else:
        many = F.broadcast(many) if n_hot <= 1_000_000 else many
        few, heavy = cut.join(many, "lead", "left_anti"), cut.join(many, "lead", "left_semi").dropDuplicates(["lead", "segment"])
    total = cut.agg(F.coalesce(F.sum(F.col("n") + length), F.lit(0))).first()[0]
    ranged = few.repartitionByRange(max(8, int(total >> 23)), "leading").sortWithinPartitions("leading", "lead", "segment")
    compared = ranged.mapInArrow(_bucket(length), _COVERED)
    if heavy is not None:
        windows = written(heavy.select("lead", "segment", "n", "bytes").mapInArrow(_windows(length), "lead long, segment long, h1 long, h2 long, start int"), "suffix-windows")
        twice = written(windows.groupBy("h1", "h2").count().where(F.col("count") > 1).select("h1", "h2"), "suffix-twice")
        more = windows.join(twice, ["h1", "h2"], "left_semi").groupBy("lead", "segment").agg(F.min("start").alias("first"), F.max("start").alias("last"))
        compared = compared.unionByName(more)
    return written(whole.unionByName(compared).groupBy("lead", "segment").agg(F.min("first").alias("first"), F.max("last").alias("last")), "suffix-covered")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose `text` is packed, with the bytes of the text instead, in bounded batches."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, "text", 2 << 20):
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array([unpack(x) for x in batch.column(at).to_pylist()], pa.binary()))


def row_name(*columns: str) -> Column:
    """16 bytes: two hashes of the columns, from different seeds."""
    both = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns)), 16, "0") for seed in (1, 2)]
    return F.unhex(F.concat(*both))


def covered_intervals(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(rid, spans): for texts that lose bytes, sorted arrays of (a, b), b exclusive; they may overlap."""
    texts = docs.select(row_name("doc_id", text).alias("rid"), F.col(text).alias("text"))
    found = runs(texts, length)  # made twice, which costs less than keeping them
    leads = written(found.select("lead").groupBy("lead").count().where(F.col("count") > 1).select("lead"), "suffix-leads")
    repeats = written(found.join(leads.hint("merge"), "lead", "left_semi"), "suffix-repeats")
    covered = covered_segments(texts, repeats, length)
    hits = repeats.select("rid", "lo", "lead", "segment").join(covered, ["lead", "segment"])
    spans = hits.select("rid", (F.col("lo") + F.col("first")).alias("a"), (F.col("lo") + F.col("last") + length).alias("b"))
    return spans.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))


def _joined(docs: DataFrame, text: str, length: int) -> DataFrame:
    """docs with packed text as `text`, and spans; both under names of their own."""
    spans = written(covered_intervals(docs, text, length), "suffix-spans")
    others = [F.col(c).alias(f"_{k}") for k, c in enumerate(docs.columns) if c != text]
    here = packed(docs.select(row_name("doc_id", text).alias("rid"), F.col(text).alias("text"), *others))
    return here.join(spans, "rid", "left").drop("rid")


def kept_parts(size: int, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """What is kept, as ranges; the bytes removed; the maximal removed runs."""
    kept, at, removed, n = [], 0, 0, 0
    end = -1
    for a, b in spans:
        if a > end:
            n += 1
            if a > at:
                kept.append((at, a))
        end = max(end, b)
        at = max(at, b)
    if size > at:
        kept.append((at, size))
    removed = size - sum(b - a for a, b in kept)
    return kept, removed, n


def _kept_bytes(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int, int]]:
    spans = batch.column(batch.schema.get_field_index("spans"))
    flat, sizes = spans.flatten(), pc.fill_null(pc.list_value_length(spans), 0).to_pylist()
    a, b = (flat.field(c).to_pylist() for c in ("a", "b"))
    place = 0
    for raw, m in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), sizes):
        if not m:
            yield raw, raw, 0, 0
            continue
        kept, removed, n = kept_parts(len(raw), list(zip(a[place : place + m], b[place : place + m])))
        place += m
        yield raw, b"".join(raw[x:y] for x, y in kept), removed, n


def deduplicated(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with what is kept of each text, n_chars (where there is such a column) made anew. A character that loses some
    of its bytes goes."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            kept = [x[1].decode("utf-8", "ignore") for x in _kept_bytes(batch)]
            new = {text: pa.array(kept, pa.string()), "n_chars": pa.array([len(x) for x in kept], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(batch.schema.get_field_index(f"_{k}")) for k, c in enumerate(names)], names=names)

    return _joined(docs, text, length).mapInArrow(run, docs.schema)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in unpacked(batches):
        rows = [(len(raw), removed, n, hashlib.sha256(kept).hexdigest()) for raw, kept, removed, n in _kept_bytes(batch)]
        size, removed, n, digest = zip(*rows)
        columns = [batch.column(batch.schema.get_field_index("_0")).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (size, removed, n)), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _joined(docs, "text", LENGTH).mapInArrow(_measured, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
