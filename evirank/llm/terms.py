"""Hashed words of byte buffers, without a Python step per word."""

from __future__ import annotations

import numpy as np

from evirank.llm.common import CHUNK_BYTES

#: Byte map of terms: A-Z lower-cased, digits, a-z and bytes of multi-byte characters kept, the rest separates (0).
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
#: Bytes of the prefix that stands for a longer word's stem.
PREFIX = 6
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: base^(done + i) = base^done * base^i
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """uint32 hash and row of every term of the rows data[offsets[i]:offsets[i + 1]]: each word, and of a longer word also its
    first PREFIX bytes, which compounds share. Words never cross rows.

    A term's hash is its polynomial value mod 2^64, from prefix sums over the whole buffer, mixed down to 32 bits."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(data) > most and len(offsets) == 2:  # one long row: in parts that end between words
        cuts = [0]
        while len(data) - cuts[-1] > most:
            after = next((at + int(gap[0]) for at in range(cuts[-1] + most, len(data), most)
                          if len(gap := np.flatnonzero(_FOLD[data[at : at + most]] == 0))), len(data))
            cuts.append(after)
        cuts.append(len(data))
        found = [word_hashes(data[a:b], np.array([0, b - a]), b - a)[0] for a, b in zip(cuts, cuts[1:]) if b > a]
        joined = np.concatenate(found)
        return joined, np.zeros(len(joined), np.int64)
    folded = _FOLD[data]
    inside = folded != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    starts[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = firsts - 1
    lasts = lasts[lasts >= 0]
    ends[lasts] = inside[lasts]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends)
    sums = np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE))
    before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
    back = _powers(len(data), _INVERSE)[begin]
    rows = np.searchsorted(offsets, begin, "right") - 1
    long = end - begin >= PREFIX
    prefix = (sums[begin[long] + PREFIX - 1] - before[long]) * back[long] + np.uint64(PREFIX)
    value = np.concatenate(((sums[end] - before) * back, prefix))
    value ^= value >> np.uint64(32)
    value *= _MIX
    return (value >> np.uint64(32)).astype(np.uint32), np.concatenate((rows, rows[long]))
