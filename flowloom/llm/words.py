"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_cache.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(n * 5 // 4 + 16, base, dtype=np.uint64)
            out[0] = 1
            _cache[name] = np.multiply.accumulate(out)
    return _cache["up"], _cache["down"]


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes with is_word[byte] that stays in one text, and the text's index."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = is_word[raw]
    edge = inside[1:] != inside[:-1]
    places = offsets[:-1][np.diff(offsets) > 0]
    places = places[1:] if len(places) and places[0] == 0 else places
    joined = places[inside[places] & inside[places + 1]]  # a word may not run on from one text into the next
    starts = np.sort(np.concatenate([np.flatnonzero(edge & inside[1:]), joined]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge & inside[:-1]), joined]))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each word."""
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


#: Of ASCII, letters and digits; of other characters, all.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: All but the space and 09 to 0D.
NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
