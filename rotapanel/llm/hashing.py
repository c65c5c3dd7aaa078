"""Words, shingles and minima of Arrow text batches, as numpy arrays.

Everything works on the bytes of a batch at once; texts longer than a chunk are
cut at white space, so memory follows the chunk and the number of words.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def draws(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers of a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 7)) * _STEP)


_BYTE = draws(256, 1)
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x5851F42D4C957F2D)


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def cuts(raw: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Positions where the bytes may be cut: starts of texts, or after white space in long ones."""
    out, end = [0], len(raw)
    while out[-1] < end:
        want = out[-1] + CHUNK
        if want >= end:
            out.append(end)
            continue
        k = int(np.searchsorted(offsets, want, side="right")) - 1
        at = int(offsets[k])
        if at <= out[-1]:
            at = want
            while at < end and not _SPACE[raw[at - 1]] and at not in (int(offsets[k + 1]),):
                at += 1
        out.append(at)
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased white-space word, and offsets of each text in them."""
    global _POWERS
    hashes, starts_all, offsets = [], [], text_bytes(column)[1]
    with np.errstate(over="ignore"):
        for lo, part, at in word_starts(column, _SPACE):
            lengths = np.diff(at, append=len(part))
            part = part[at[0] :]
            if lengths.max() > len(_POWERS):
                _POWERS = powers(int(lengths.max()) * 2)
            place = np.arange(len(part), dtype=np.int32)
            place -= np.repeat((at - at[0]).astype(np.int32), lengths)
            value = _BYTE[part]
            value *= _POWERS[place]
            hashes.append(mix(np.add.reduceat(value, at - at[0])))
            starts_all.append(at + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    words, at = np.concatenate(hashes), np.concatenate(starts_all)
    return words, np.searchsorted(at, offsets).astype(np.int64)


def word_starts(column: pa.Array, gap: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of a batch: first byte's place, lower-cased bytes, and where words start in them."""
    raw, offsets = text_bytes(column)
    edges = cuts(raw, offsets)
    for lo, hi in zip(edges, edges[1:]):
        part = LOWER[raw[lo:hi]]
        space = gap[part]
        start = ~space
        start[1:] &= space[:-1]
        inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        start[inner] |= ~space[inner]
        at = np.flatnonzero(start)
        if len(at):
            yield lo, part, at


def prefix_hashes(part: np.ndarray, at: np.ndarray, gap: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """Hashes of the first bytes of words, for each length (whole words where they are shorter)."""
    out, total, alive = [], np.zeros(len(at), np.uint64), np.ones(len(at), bool)
    room = np.diff(at, append=len(part))  # a word ends with its text
    with np.errstate(over="ignore"):
        for k in range(max(lengths)):
            place = np.minimum(at + k, len(part) - 1)
            alive &= (k < room) & ~gap[part[place]]
            total = total + np.where(alive, (_BYTE[part[place]] + np.uint64(1)) * _POWERS[k], np.uint64(0))
            if k + 1 in lengths:
                out.append(mix(total))
    return out


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    words, off = word_hashes(column)
    out = []
    with np.errstate(over="ignore"):
        scale = draws(width, 2) | np.uint64(1)
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += words[k : k + n] * scale[k]
        rolled = mix(rolled)
        for lo, hi in zip(off[:-1], off[1:]):
            if hi - lo >= width:
                out.append(np.unique(rolled[lo : hi - width + 1]))
            elif hi > lo:
                tail = (words[lo:hi] * scale[: hi - lo]).sum() + np.uint64(hi - lo)
                out.append(mix(np.array([tail], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20):
    """Parts of a batch with about ``size`` bytes of the text column each."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def minima(sets: list[np.ndarray], count: int, seed: int = 3) -> np.ndarray:
    """Minimum of each of ``count`` universal hashes over each set; sets must not be empty."""
    a, b = draws(count, seed) | np.uint64(1), draws(count, seed + 1)
    values = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), count), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(count):
            out[:, k] = np.minimum.reduceat((values * a[k] + b[k]) >> np.uint64(32), first)
    return out
