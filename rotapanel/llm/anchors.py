"""Anchors of byte windows: where a repeated window must share a hash.

The anchor of a window of ``WINDOW`` bytes is its ``GRAM``-byte gram with the smallest
hash (the leftmost of equal ones). Equal windows have equal anchors at equal places,
so only windows around repeated anchors can repeat, and windows that share an
anchor form a run of neighbouring starts.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rotapanel.llm.hashing import draws, mix, text_bytes

WINDOW, GRAM = 200, 64
PIECE = 1 << 21
_PLACE_BITS = np.uint64(22)
_VALUE = draws(256, 11)
_BASE = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1), _powers(_BACK, 1)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        _UP, _DOWN = _powers(_BASE, 2 * n), _powers(_BACK, 2 * n)
    return _UP, _DOWN


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about a piece: whole texts, or parts of a long one that overlap by a window."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        while b - a > PIECE:
            yield a, a + PIECE
            a += PIECE - WINDOW + 1
        if b > a:
            yield a, b
        lo = hi


class Sums:
    """Hashes of any range of a piece of bytes."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = _grown(len(raw) + 1)
        with np.errstate(over="ignore"):
            value = _VALUE[raw]
            value *= self.up[: len(raw)]
            self.total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(value, out=self.total[1:])

    def grams(self, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self.total[k:] - self.total[:-k]
            out *= self.down[: len(out)]
        return mix(out)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = (self.total[end] - self.total[start]) * self.down[start]
            return mix(out + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchor_runs(column: pa.Array, window: int = WINDOW, gram: int = GRAM) -> Iterator[dict[str, np.ndarray]]:
    """Runs of window starts with one anchor: text number, anchor hash, first and last start and the
    anchor's place (bytes from the text's start), and the hash of the bytes that the run covers."""
    raw, offsets = text_bytes(column)
    reach = window - gram + 1
    for lo, hi in pieces(offsets):
        part = raw[lo:hi]
        if len(part) < window:
            continue
        sums = Sums(part)
        grams = sums.grams(gram)
        places = np.arange(len(grams), dtype=np.uint64)
        packed = (grams >> _PLACE_BITS << _PLACE_BITS) | places
        anchor = (_sliding_least(packed, reach) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        # Windows must not reach beyond their text.
        k = np.searchsorted(offsets, np.arange(lo, lo + len(anchor), window), side="right") - 1
        first_text, last_text = int(k[0]), int(np.searchsorted(offsets, lo + len(anchor) - 1, side="right")) - 1
        ok = np.ones(len(anchor), bool)
        ends = offsets[first_text + 1 : last_text + 2] - lo
        for e in ends[ends < len(part)]:
            ok[max(0, e - window + 1) : e] = False
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(anchor)) - 1
        at, last = at[ok[at]], last[ok[at]]
        place = anchor[at]
        text = np.searchsorted(offsets, at + lo, side="right") - 1
        base = offsets[text] - lo
        yield {
            "text": text, "anchor": grams[place], "first": at - base, "last": last - base, "place": place - base,
            "segment": sums.ranges(at, last + window),
        }
