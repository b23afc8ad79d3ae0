"""Vectorised word and n-gram primitives over Arrow string buffers.

All functions work on the UTF-8 bytes of a slice of rows at once, so no Python
code runs per word or per row.  A slice holds about ``SLICE_BYTES`` of text (one
row, where a row is longer), which bounds the memory of a task whatever the
Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

U = np.uint64
_MIX1, _MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)  # odd, so invertible modulo 2**64


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * _MIX1
    h ^= h >> U(33)
    h *= _MIX2
    h ^= h >> U(33)
    return h


#: A random 64-bit value for each byte, of the fixed seed that all tasks share.
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
_INV_P, _INV_Q = U(pow(int(_P), -1, 1 << 64)), U(pow(int(_Q), -1, 1 << 64))


class _Powers:
    """Powers of a base modulo 2**64, grown as longer slices come."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.table = base, np.ones(1, dtype=U)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            full = np.full(n + (1 << 14), self.base, dtype=U)
            full[0] = 1
            self.table = np.multiply.accumulate(full)
        return self.table


_pow_p, _pow_inv_p, _pow_q, _pow_inv_q = (_Powers(x) for x in (_P, _INV_P, _Q, _INV_Q))


def forget() -> None:
    """Lets the tables of powers go; they are made again when they are needed."""
    for x in (_pow_p, _pow_inv_p, _pow_q, _pow_inv_q):
        x.table = np.ones(1, dtype=U)


def byte_class(separators: bytes) -> np.ndarray:
    """A table that is True for the bytes that words are made of."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = byte_class(b" \t\n\x0b\x0c\r")
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, a-z and all that is not ASCII.
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of consecutive slices; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind, texts = np.int64, texts
    else:
        kind, texts = np.int32, texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (rows + 1 entries)."""
    n = len(buf)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offs), dtype=np.int64)
    inside = table[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offs[1:-1]
    at = at[at < n]
    first[at] = inside[at]
    at = at[at > 0]
    last[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, from one running sum over the bytes."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    run = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum(_BYTE[buf] * _pow_p(len(buf))[: len(buf)], out=run[1:])
    h = (run[ends] - run[starts]) * _pow_inv_p(len(buf))[starts]
    return mix(h + (ends - starts).astype(U))


def gram_hashes(h: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that lie in one row, and the index of each window's first word."""
    if len(h) < n:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    counts = np.diff(firsts)
    # a window may start at each word but the last n - 1 of its row
    ok = np.ones(len(h), dtype=bool)
    if n > 1:
        edge = np.zeros(len(h) + 1, dtype=np.int32)
        has = counts > 0
        np.add.at(edge, np.maximum(firsts[:-1], firsts[1:] - (n - 1))[has], 1)
        np.add.at(edge, firsts[1:][has], -1)
        ok = np.cumsum(edge)[:-1] == 0
    at = np.flatnonzero(ok)
    run = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * _pow_q(len(h))[: len(h)], out=run[1:])
    g = (run[at + n] - run[at]) * _pow_inv_q(len(h))[at]
    return mix(g + U(n)), at


def row_of(firsts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row of each word index."""
    return np.searchsorted(firsts, at, side="right") - 1


def cover(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """True for each word inside any of the n-word windows that start at the given words."""
    edge = np.zeros(n_words + n + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge)[:n_words] > 0


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
