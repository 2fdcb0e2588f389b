"""Burrows-Wheeler transforms of sets of short strings, and their merge by interleave refinement."""

from __future__ import annotations

import numpy as np


def shard_order(strings: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort all rotations of a shard's strings, each closed by a 0: (bwt, string index, offset) in rotation order.

    strings: rows of `width` bytes, zero after their length. Rotations are compared over width + 1 bytes, which no two distinct
    strings of at most `width` bytes share in full, so the order is that of the infinite rotations."""
    full = width + 1
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1)
    padded = np.zeros((len(strings), full), np.uint8)
    padded[:, :width] = strings
    # each string repeated far enough that every rotation is a stretch of it
    period = (lengths + 1)[:, None]
    wound = np.take_along_axis(padded, np.arange(full + width)[None, :] % period, axis=1)
    rotations = np.lib.stride_tricks.sliding_window_view(wound, full, axis=1)[owner, offset]
    order = np.argsort(rotations.view(f"S{full}").ravel(), kind="stable")
    before = padded[owner, (offset - 1) % (lengths + 1)[owner]]
    return before[order], owner[order], offset[order]


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the transforms of several shards to rotations sorted by `depth` bytes, without looking at a suffix again.

    The interleave lists the shards' rows in the present order; the rows of a shard keep their order in it. One refinement reads
    the byte before each rotation, deals the places stably by it, and moves each row to the one with that byte in front, which its
    shard's transform gives: what was sorted by d bytes is then sorted by d + 1. Beside it go the borders between rows whose first
    d bytes differ, so the places without a border after `depth` rounds are the common prefixes of at least `depth` bytes.
    Returns (row ids: shard after shard, in merged order; border flags)."""
    bwt = np.concatenate(shards)
    n = len(bwt)
    front = np.empty(n, np.int32)  # the row of the rotation that starts one byte earlier
    at = 0
    for shard in shards:
        front[at + np.argsort(shard, kind="stable")] = np.arange(at, at + len(shard), dtype=np.int32)
        at += len(shard)
    row = np.arange(n, dtype=np.int32)
    block = np.zeros(n, np.int32)
    border = np.zeros(n, bool)
    for _ in range(depth):
        byte = bwt[row]
        order = np.argsort(byte, kind="stable")
        row, byte, block = front[row[order]], byte[order], block[order]
        border[:1] = True
        border[1:] = (byte[1:] != byte[:-1]) | (block[1:] != block[:-1])
        np.cumsum(border, dtype=np.int32, out=block)
    return row, border


def earliest_repeat(strings: np.ndarray, lengths: np.ndarray, owner: np.ndarray, depth: int, shard_bytes: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every depth-byte substring that also starts in a string of a smaller owner.

    Distinct strings as rows of bytes, zero after their length; owner: a number per string."""
    if not len(strings):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = strings.shape[1]
    per_shard = max(1, shard_bytes // (width + 1))
    parts = [shard_order(strings[at : at + per_shard], lengths[at : at + per_shard], width) for at in range(0, len(strings), per_shard)]
    row, border = merge([p[0] for p in parts], depth)
    who = np.concatenate([p[1] + i * per_shard for i, p in enumerate(parts)])[row]
    offset = np.concatenate([p[2] for p in parts])[row]
    whole = offset + depth <= lengths[who]  # no string end inside the prefix
    starts = np.flatnonzero(border)
    least = np.minimum.reduceat(np.where(whole, owner[who], np.iinfo(np.int64).max), starts)
    repeated = whole & (owner[who] > np.repeat(least, np.diff(np.append(starts, len(row)))))
    return who[repeated], offset[repeated]
