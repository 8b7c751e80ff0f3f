"""SentencePiece encoding and decoding with a given model, by batched numpy Viterbi.

A text is a space, then the text, with spaces as U+2581; it falls into words, which end before a U+2581 that follows
another character, and at characters that no piece holds, as no piece of such a model reaches over these places (that is
checked when the model is read). Words of a batch are grouped by length and made distinct; all words of one length
advance together, one character at a time: for each length of a last piece the substring's hash is looked up in the sorted
hashes of the pieces, and the best sum of scores so far and the piece that gives it are kept.

For a model of type BPE (its scores are the ranks of merges) a piece may only follow one that it is compatible with: merging the
characters of the two in order of rank must never join characters across the border between them. Pieces that are compatible
from neighbour to neighbour are what the merges make of a text, so the best path is the model's own segmentation; that is tested against the
installed library over all documents. Compatibility is found by undoing merges on both sides of the border, the latest first,
and looking up whether what then meets there would have been merged before. For a unigram model every piece may follow every
other, and the best path is its segmentation.

Pieces of several spaces have one rank, the last, in such a model: each space starts a word of its own, and single spaces that are left in a row
are merged afterwards, the leftmost two that can be first.

A character that no piece holds becomes the byte pieces of its UTF-8 bytes, and so
does a U+2581 in the text itself, so decoding always gives the text back.

Words of over LONG characters are cut into overlapping windows that advance together like words. Two windows are joined at a
border in their overlap where both paths have the same last piece; what follows is then the same as in one piece. Where they have
none, other starts of the window are tried, and else it is advanced from the last known border. So long words take time in
proportion to their length.

The tokenizer's file is a parameter and read on the driver; its pieces (some 32,000) go to the tasks with the function.
Narrow: nothing is shuffled, each text is encoded whole in one task, in slices of bounded size.

Cases: null and empty texts have no tokens; repeated rows give repeated results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.common import slices, table, text_column, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
LONG = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LITERAL = 0x110000  # stands for a U+2581 of the text


def _hash(codes: np.ndarray) -> np.ndarray:
    """Of each row of code points."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(codes.shape[1]):
        h = h * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
    return h


@dataclass
class Pieces:
    keys: np.ndarray  # sorted hashes of the pieces
    ids: np.ndarray
    scores: np.ndarray  # these and what follows in the order of keys
    sizes: np.ndarray  # in characters
    rank: np.ndarray  # of the merge that makes a piece, -1 for single characters
    left: np.ndarray  # the two pieces that merge makes a piece of, -1 where there is none
    right: np.ndarray
    merges: bool  # a BPE model
    spaces: dict[int, int]  # of a BPE model: the ids of pieces of so many spaces
    maybe: np.ndarray  # by the high bits of a hash: whether some piece has these
    powers: np.ndarray
    longest: int
    known: np.ndarray  # code points that are pieces, sorted
    byte_ids: np.ndarray
    data: np.ndarray  # bytes of all pieces as decoded, and where each starts
    starts: np.ndarray
    seen: np.ndarray  # pairs of pieces looked at last and whether they are compatible, by a hash of the pair
    found: np.ndarray

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, -1 where there is none."""
        out = np.full(len(h), -1, dtype=np.int32)
        hit = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
        real = self.keys[at] == h[hit]
        out[hit[real]] = at[real]
        return out

    def separate(self, a: np.ndarray, b: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether merging the characters of piece a, then piece b joins none across the border; `joined`: but the two pieces."""
        out = np.ones(len(a), dtype=bool)
        never = np.iinfo(np.int32).max
        live, x, y = np.arange(len(a)), a, b
        x_until, y_until = np.full(len(a), never, dtype=np.int32), np.full(len(a), never, dtype=np.int32)
        while len(live):
            # x and y meet at the border until one of them becomes part of a larger piece on its side
            if not joined:
                both = self.lookup(self.keys[x] * self.powers[self.sizes[y]] + self.keys[y])
                merged = np.where(both >= 0, self.rank[both], never)
                across = (merged < x_until) & (merged <= y_until)  # of equal ranks the merge further left comes first
                out[live[across]] = False
                go = ~across
            else:
                go = np.ones(len(live), dtype=bool)
            joined = False
            go &= (self.rank[x] >= 0) | (self.rank[y] >= 0)
            live, x, y, x_until, y_until = (z[go] for z in (live, x, y, x_until, y_until))
            undo_y = self.rank[y] >= self.rank[x]
            x_until, y_until = np.where(undo_y, x_until, self.rank[x]), np.where(undo_y, self.rank[y], y_until)
            x, y = np.where(undo_y, x, self.right[x]), np.where(undo_y, self.left[y], y)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """separate(), with a memory of the pairs met before."""
        pair = a.astype(np.int64) * len(self.keys) + b
        slot = ((pair.astype(np.uint64) * _BASE) >> np.uint64(64 - 18)).astype(np.int64)
        new = np.flatnonzero(self.seen[slot] != pair)
        if len(new):
            _, first = np.unique(pair[new], return_index=True)
            new = new[first]
            ok = self.separate(a[new], b[new])
            self.seen[slot[new]], self.found[slot[new]] = pair[new], ok
            out = self.found[slot]
            lost = np.flatnonzero(self.seen[slot] != pair)  # two pairs of this call have one slot
            out[lost] = self.separate(a[lost], b[lost])
            return out
        return self.found[slot]


def read_pieces(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept, byte_ids, shown = [], np.full(256, -1, dtype=np.int32), []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
            shown.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            shown.append(b"")
        else:
            kept.append((piece, k, model.get_score(k)))
            shown.append(piece.replace("▁", " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    if any("▁" in p.lstrip("▁") or p.startswith("▁▁") and p.strip("▁") for p, _, _ in kept):
        raise ValueError("a piece reaches over the start of a word")
    sizes = np.array([len(p) for p, _, _ in kept])
    longest = int(sizes.max())
    codes = np.zeros((len(kept), longest), dtype=np.int64)
    for k, (p, _, _) in enumerate(kept):
        codes[k, : len(p)] = [ord(c) for c in p]
    hashes = np.zeros(len(kept), dtype=np.uint64)
    for n in range(1, longest + 1):
        hashes[sizes == n] = _hash(codes[sizes == n, :n])
    order = np.argsort(hashes)
    keys, sizes, codes = hashes[order], sizes[order], codes[order]
    if (keys[1:] == keys[:-1]).any():
        raise ValueError("two pieces have one hash")
    scores = np.array([s for _, _, s in kept])[order]
    blank = np.array([set(p) == {"▁"} for p, _, _ in kept])[order]
    merged = scores[(sizes > 1) & ~blank]
    merges = bool((merged == np.round(merged)).all() and len(np.unique(merged)) == len(merged) and (scores[blank & (sizes > 1)] < merged.min(initial=0)).all())
    spaces = {len(p): k for p, k, _ in kept if set(p) == {"▁"}} if merges else {}
    maybe = np.zeros(1 << 20, dtype=bool)
    maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
    known = np.array(sorted(ord(p) for p, _, _ in kept if len(p) == 1), dtype=np.int64)
    ends = np.array([len(x) for x in shown], dtype=np.int64)
    none = np.full(len(keys), -1, dtype=np.int32)
    p = Pieces(
        keys, np.array([k for _, k, _ in kept], dtype=np.int32)[order], scores, sizes, np.where(sizes > 1, -np.round(scores), -1).astype(np.int32), none, none.copy(), merges, spaces, maybe,
        np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(longest, _BASE)])), longest, known, byte_ids, np.frombuffer(b"".join(shown), dtype=np.uint8),
        np.concatenate([[0], np.cumsum(ends)]), np.full(1 << 18, -1, dtype=np.int64), np.zeros(1 << 18, dtype=bool),
    )
    if merges:
        _find_merges(p, codes, blank)
    return p


def _find_merges(p: Pieces, codes: np.ndarray, blank: np.ndarray) -> None:
    """The last merge of each piece: of the ways to cut it in two pieces, the one whose border no earlier merge crosses."""
    made = p.sizes == 1
    for n in range(2, p.longest + 1):
        at = np.flatnonzero((p.sizes == n) & ~blank)
        for cut in range(1, n):
            a, b = p.lookup(_hash(codes[at, :cut])), p.lookup(_hash(codes[at, cut:n]))
            go = np.flatnonzero((a >= 0) & (b >= 0) & made[a] & made[b])
            go = go[p.separate(a[go], b[go], joined=True)]
            p.left[at[go]], p.right[at[go]], made[at[go]] = a[go], b[go], True
    at = np.flatnonzero(made & (p.sizes > 1))
    if (np.maximum(p.rank[p.left[at]], p.rank[p.right[at]]) >= p.rank[at]).any():
        raise ValueError("a merge comes before the ones that it needs")


def _advance(words: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length (a row of code points each): for every end and word the size and the number of the best path's last piece, 0 and -1 without a path."""
    n, length = words.shape
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    prefix = np.zeros((length + 1, n), dtype=np.uint64)
    size = np.zeros((length + 1, n), dtype=np.int16)
    piece = np.full((length + 1, n), -1, dtype=np.int32)
    for end in range(1, length + 1):
        prefix[end] = prefix[end - 1] * _BASE + words[:, end - 1].astype(np.uint64) + np.uint64(1)
        rows = np.arange(n)
        for m in range(min(p.longest, end), 0, -1):
            at = p.lookup(prefix[end, rows] - prefix[end - m, rows] * p.powers[m])
            go = at >= 0
            if p.merges and m > 1:
                go[go] = p.left[at[go]] >= 0
            hit, at = rows[go], at[go]
            total = best[end - m, hit] + p.scores[at]
            better = total > best[end, hit]
            if p.merges and m < end and len(hit):
                before = piece[end - m, hit]
                better &= before >= 0
                better[better] = p.compatible(before[better], at[better])
            hit, at = hit[better], at[better]
            best[end, hit], size[end, hit], piece[end, hit] = total[better], m, at
            if p.merges and len(hit):  # there is only one
                rows = rows[piece[end, rows] < 0]
    return size, piece


def best_pieces(words: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi on words of one length: all their piece ids in one array, and how many each has."""
    n, length = words.shape
    size, piece = _advance(words, p)
    end = np.full(n, length)
    row = np.arange(n)
    found = []
    while len(row):
        found.append((row, p.ids[piece[end, row]]))
        end = end - size[end, row]
        left = end > 0
        row, end = row[left], end[left]
    counts = np.bincount(np.concatenate([r for r, _ in found]), minlength=n)
    out = np.empty(int(counts.sum()), dtype=np.int32)
    last = np.cumsum(counts) - 1
    for k, (rows, ids) in enumerate(found):  # from the last piece to the first
        out[last[rows] - k] = ids
    return out, counts


def _path(size: list[int], piece: list[int], end: int) -> list[tuple[int, int]]:
    """Ends and numbers of the pieces of a window's best path to `end`, the first one last."""
    out = []
    while end > 0:
        out.append((end, piece[end]))
        end -= size[end]
    return out


class _Windows:
    """The best paths of a long word's windows, made for a group of windows at once when one of them is asked for."""

    def __init__(self, word: np.ndarray, p: Pieces, width: int, overlap: int, group: int = 1024):
        self.word, self.p, self.width, self.span, self.group = word, p, width, width + overlap, group
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.at = -1

    def get(self, start: int, shift: int) -> tuple[list[int], list[int]]:
        """Sizes and numbers of the last pieces at each end, of the window `shift` characters after start."""
        if start + shift + self.span > len(self.word):
            size, piece = _advance(self.word[None, start + shift :], self.p)
            return size[:, 0].tolist(), piece[:, 0].tolist()
        k = start // self.width
        if k // self.group != self.at:
            self.at, self.made = k // self.group, {}
        first = self.at * self.group
        if shift not in self.made:
            n = min(self.group, (len(self.word) - self.span - shift) // self.width - first + 1)
            places = (first + np.arange(n)) * self.width + shift
            self.made[shift] = _advance(self.word[places[:, None] + np.arange(self.span)], self.p)
        size, piece = self.made[shift]
        return size[:, k - first].tolist(), piece[:, k - first].tolist()


def long_word(word: np.ndarray, p: Pieces, width: int = 256, overlap: int = 64) -> np.ndarray:
    """The ids of a long word, by windows of width + overlap characters."""
    starts = list(range(0, max(1, len(word) - overlap), width))
    windows = _Windows(word, p, width, overlap)
    out: list[int] = []  # numbers of pieces, up to the last joint
    at, (size, piece) = 0, windows.get(0, 0)  # where the window in use starts, and its paths
    joint, joint_piece = 0, -1  # the last joint, and the piece that ends there
    shifts = list(range(min(p.longest, overlap // 2) + 1))

    def steps_to(end: int) -> list[int] | None:
        """The pieces of the window's path to `end` after the last joint, if it passes through that, the first piece last."""
        path = _path(size, piece, end - at)
        if at and (joint - at, joint_piece) not in path:
            return None
        return [k for e, k in path if e + at > joint]

    k = 1
    while k < len(starts):
        joined = None
        for shift in shifts:
            begin = starts[k] + shift
            other = windows.get(starts[k], shift)
            for e, number in _path(*other, len(other[0]) - 1):
                if begin + e < at + len(size) and piece[begin + e - at] == number and (steps := steps_to(begin + e)) is not None:
                    joined = begin + e, number, steps
                    break
            if joined:
                shifts.remove(shift)
                shifts.insert(0, shift)  # a repeated string asks for the same one again
                break
        if joined:
            joint, joint_piece, steps = joined
            out += reversed(steps)
            at, (size, piece) = begin, other
            k += 1
        else:  # the window in use goes on, twice as long
            stop = min(len(word), at + 2 * len(size))
            b, c = _advance(word[None, at:stop], p)
            size, piece = b[:, 0].tolist(), c[:, 0].tolist()
            while k < len(starts) and (starts[k] + overlap < stop or stop == len(word)):
                k += 1
    steps = steps_to(len(word))
    if steps is None:  # no joint holds to the end, so the word is advanced as one
        size, piece = (x[:, 0] for x in _advance(word[None], p))
        out, steps = [], [k for _, k in _path(size, piece, len(word))]
    return p.ids[np.array(out + steps[::-1], dtype=np.int64)]


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[start : start + size] of all, joined."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return data[shift + np.arange(len(shift))]


def encode(texts: list[str], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in one array, and where each text's start."""
    spaced = [" " + t if t else "" for t in texts]
    codes = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in spaced])]).astype(np.int64)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    codes = np.where(codes == SPACE, _LITERAL, np.where(codes == 32, SPACE, codes))
    small = np.zeros(0x110001, dtype=bool)
    small[p.known] = True
    unknown = ~small[codes]
    space = codes == SPACE
    edge = np.zeros(len(codes) + 1, dtype=bool)
    edge[starts] = True
    edge[1:-1] |= space[1:] if p.merges else space[1:] & ~space[:-1]
    edge[:-1] |= unknown
    edge[1:] |= unknown
    word = np.flatnonzero(edge)
    word, sizes = word[:-1], np.diff(word)
    n_ids = np.zeros(len(word), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their ids, where each word's start
    odd = unknown[word]
    for size in np.unique(sizes[~odd]):
        at = np.flatnonzero((sizes == size) & ~odd)
        if size > LONG:
            found = [long_word(codes[w : w + size], p) for w in word[at].tolist()]
            counts = np.array([len(x) for x in found])
            n_ids[at] = counts
            parts.append((at, np.concatenate(found), np.cumsum(counts) - counts))
            continue
        rows = codes[word[at][:, None] + np.arange(size)]
        _, first, inverse = np.unique(_hash(rows), return_index=True, return_inverse=True)
        distinct = rows[first]
        if not np.array_equal(distinct[inverse], rows):  # two words of one hash
            distinct, inverse = np.unique(rows, axis=0, return_inverse=True)
            inverse = inverse.reshape(-1)
        ids, counts = best_pieces(distinct, p)
        n_ids[at] = counts[inverse]
        parts.append((at, ids, (np.cumsum(counts) - counts)[inverse]))
    at = np.flatnonzero(odd)
    if len(at):
        chars, inverse = np.unique(codes[word[at]], return_inverse=True)
        raw = [(chr(SPACE) if c == _LITERAL else chr(c)).encode("utf-8", "surrogatepass") for c in chars.tolist()]
        counts = np.array([len(x) for x in raw], dtype=np.int64)
        n_ids[at] = counts[inverse]
        parts.append((at, p.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)], (np.cumsum(counts) - counts)[inverse]))
    ends = np.cumsum(n_ids)
    out = np.empty(int(ends[-1]), dtype=np.int32)
    for at, ids, first in parts:
        n = n_ids[at]
        place = np.repeat((ends - n_ids)[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[place] = _gather(ids, first, n)
    return _spaces_merged(out, np.concatenate([[0], ends])[np.searchsorted(word, starts)], p)


def _spaces(n: int, p: Pieces) -> list[int]:
    """The ids of n spaces in a row."""
    held: list[int] = []
    for _ in range(n):
        held.append(1)
        while len(held) > 1 and held[-2] + held[-1] in p.spaces:
            held[-2:] = [held[-2] + held[-1]]
    return [p.spaces[k] for k in held]


def _spaces_merged(ids: np.ndarray, starts: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids with single spaces in a row replaced by pieces of several."""
    if len(p.spaces) < 2:
        return ids, starts
    single = ids == p.spaces[1]
    inner = np.zeros(len(ids) + 1, dtype=bool)  # of a run of single spaces, but not its first
    inner[1:-1] = single[1:] & single[:-1]
    inner[starts] = False
    run = np.flatnonzero(inner[1:] & single & ~inner[:-1])  # the first of two or more
    if not len(run):
        return ids, starts
    places = np.append(np.flatnonzero(~inner), len(ids))
    sizes = places[np.searchsorted(places, run) + 1] - run
    kinds, of = np.unique(sizes, return_inverse=True)
    table = [np.array(_spaces(n, p), dtype=np.int32) for n in kinds.tolist()]
    counts = (~inner[:-1]).astype(np.int64)
    counts[run] = np.array([len(x) for x in table])[of]
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(ends[-1]), dtype=np.int32)
    out[ends[:-1][~inner[:-1]]] = ids[~inner[:-1]]
    data, first = np.concatenate(table), np.cumsum([0, *map(len, table)])
    n = counts[run]
    out[np.repeat(ends[run] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = _gather(data, first[of], n)
    return out, ends[starts]


def decode(ids: np.ndarray, starts: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and where each text's start. Every text with tokens loses its first space."""
    sizes = np.diff(p.starts)[ids]
    data = _gather(p.data, p.starts[ids], sizes)
    places = np.concatenate([[0], np.cumsum(sizes)])[starts]
    filled = np.diff(places) > 0
    keep = np.ones(len(data), dtype=bool)
    keep[places[:-1][filled]] = False
    return data[keep], places - np.concatenate([[0], np.cumsum(filled)])


def tokenized(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, token_ids, n_tokens, n_bytes, and whether decoding gave the text's bytes back."""
    pieces = read_pieces(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            col = text_column(batch, text)
            raw, offsets = utf8(col)
            ids, starts = encode(col.to_pylist(), pieces)
            back, places = decode(ids, starts, pieces)
            if len(back) == len(raw) and np.array_equal(places, offsets) and np.array_equal(back, raw):
                same = np.ones(batch.num_rows, dtype=bool)
            else:
                same = np.array([np.array_equal(back[places[k] : places[k + 1]], raw[offsets[k] : offsets[k + 1]]) for k in range(batch.num_rows)])
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            columns = [batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), lists, pa.array(np.diff(starts)), pa.array(np.diff(offsets)), pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "token_ids", "n_tokens", "n_bytes", "round_trip"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, n_bytes long, round_trip boolean")


def detokenized(tokens: DataFrame, token_ids: str = "token_ids", into: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id and the texts that lists of ids stand for; null lists give empty texts, bytes that aren't UTF-8 the replacement character."""
    pieces = read_pieces(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            starts = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            ids = np.array([i for x in lists for i in x or ()], dtype=np.int64)
            data, places = decode(ids, starts, pieces)
            texts = [data[places[k] : places[k + 1]].tobytes().decode("utf-8", "replace") for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", into])

    return tokens.select("doc_id", token_ids).mapInArrow(run, f"doc_id long, `{into}` string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))
