"""Vectorised scanning of Arrow text: words, lines, prefix sums and 64-bit hashes of byte ranges.

Works on the UTF-8 bytes of a slice of rows at a time, so that memory follows the slice and
not the table. A range's hash takes eight bytes a step through a bit mixer, which is not
linear; it depends on the range's bytes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Ranges up to this many bytes are hashed in eights, all at once; longer ones by a library's hash each.
_SHORT = 128


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def byte_set(pattern_bytes: bytes | range, negate: bool = False) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(pattern_bytes)] = True
    return ~t if negate else t


#: Words of the contracts: everything but space, tab, LF, VT, FF and CR.
SPACED = byte_set(b" \t\n\x0b\x0c\r", negate=True)
#: Words of letters, digits and all non-ASCII.
ALNUM = byte_set(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))


@dataclass
class Slice:
    """Rows lo..hi of a batch: their bytes, and row offsets into these (hi - lo + 1 of them)."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray


def slices(col: pa.Array, size: int = 1 << 18) -> Iterator[Slice]:
    """Cut a string column into slices of about `size` bytes; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    if not len(col):
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo, n = 0, len(col)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Spans:
    """Byte ranges in a slice, and for each row the index of its first range (rows + 1 of them)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(s: Slice, kind: np.ndarray) -> Spans:
    """Maximal runs of bytes of a kind, never across rows."""
    m = kind[s.buf]
    n = len(m)
    if not n:
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(s.offs), np.int64))
    cut = s.offs[(s.offs > 0) & (s.offs < n)]
    begin = m.copy()
    begin[1:] &= ~m[:-1]
    begin[cut] |= m[cut]
    end = m.copy()
    end[:-1] &= ~m[1:]
    end[cut - 1] |= m[cut - 1]
    starts = np.flatnonzero(begin)
    return Spans(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, s.offs))


def lines(s: Slice) -> Spans:
    """The \\n-separated lines of each row (at least one a row)."""
    brk = np.flatnonzero(s.buf == 10)
    per = np.searchsorted(brk, s.offs)
    first = per + np.arange(len(s.offs))
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[first[:-1]] = s.offs[:-1]
    ends[first[1:] - 1] = s.offs[1:]
    row = np.searchsorted(s.offs, brk, "right") - 1
    at = np.arange(len(brk)) + row
    ends[at] = brk
    starts[at + 1] = brk + 1
    return Spans(starts, ends, first)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each range; fold: A-Z count as a-z."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    if not len(size):
        return out
    data = np.zeros(len(buf) + 8, np.uint8)
    data[: len(buf)] = _LOWER[buf] if fold else buf
    eights = np.ndarray(len(buf) + 1, "<u8", data, 0, (1,))  # the eight bytes from each place on
    at = np.flatnonzero(size <= _SHORT)
    k = 0
    while len(at := at[size[at] > k]):
        x = eights[starts[at] + k].astype(np.uint64)
        rest = size[at] - k
        tail = rest < 8
        x[tail] &= (np.uint64(1) << (rest[tail].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[at] = mix(out[at] ^ x)
        k += 8
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes (order counts); len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out *= np.uint64(0x9DDFEA08EB382D69)
            out += h[i : i + n]
    return mix(out)


def row_counts(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of set flags in each row."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]
