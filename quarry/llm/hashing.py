"""Vectorised word and window hashes over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INNER = np.ones(256, bool)
_INNER[[9, 10, 11, 12, 13, 32]] = False
CHUNK_BYTES = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.empty(0, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << int(n).bit_length()
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_byte_powers, _word_powers = _Powers(_BASE), _Powers(_WORD_BASE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit moves all output bits."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


@dataclass
class Words:
    """Words of some texts: bytes [start, end) of data each; those of text i are [first[i], first[i + 1])."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    rows: slice

    def hashes(self, lower: bool) -> np.ndarray:
        b = _LOWER[self.data] if lower else self.data
        up, down = _byte_powers(len(b) + 1)
        total = np.zeros(len(b) + 1, U)
        np.cumsum(_BYTES[b] * up[: len(b)], out=total[1:])
        return mixed((total[self.end] - total[self.start]) * down[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_chunks(texts: pa.Array) -> Iterator[Words]:
    """Words of a string array, CHUNK_BYTES or one text at a time. Null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, raw, body = texts.buffers()
    at = np.frombuffer(raw, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
        j = min(j, len(texts))
        data, bounds = body[at[i] : at[j]], at[i : j + 1] - at[i]
        inner = np.zeros(len(data) + 2, bool)
        inner[1:-1] = _INNER[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        starts = np.flatnonzero(inner[1:] & (~inner[:-1] | cut))
        ends = np.flatnonzero(inner[:-1] & (~inner[1:] | cut))
        yield Words(data, starts, ends, np.searchsorted(starts, bounds), slice(i, j))
        i = j


def windows(words: Words, hashes: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words and the index of their first word; short: a text of fewer words is one window."""
    up, down = _word_powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    n = words.counts()
    last = np.repeat(words.first[1:], n)
    begin = np.flatnonzero(np.arange(len(hashes)) + size <= last)
    found = mixed((total[begin + size] - total[begin]) * down[begin])
    if short and len(few := np.flatnonzero((n > 0) & (n < size))):
        a, b = words.first[few], words.first[few + 1]
        extra = mixed((total[b] - total[a]) * down[a] + U(1) + n[few].astype(U))
        order = np.argsort(np.concatenate([begin, a]), kind="stable")
        begin, found = np.concatenate([begin, a])[order], np.concatenate([found, extra])[order]
    return found, begin
