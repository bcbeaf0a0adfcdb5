"""Words of whole Arrow batches as numpy arrays: boundaries, 64-bit hashes and k-gram hashes, without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = 0xD6E8FEB86659FD93
#: Bytes worked on at once; a longer text is taken alone.
CHUNK = 1 << 19


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte, by SplitMix64."""
    return mix(np.arange(1, 257, dtype=U) * U(_BASE))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (SplitMix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def plain_table() -> np.ndarray:
    """Bytes of words as they are; 0 separates: 0x20 and 0x09 to 0x0D. Byte 0 itself maps to 255, which UTF-8 never holds."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 255
    t[[0x20, 9, 10, 11, 12, 13]] = 0
    return t


def folded_table() -> np.ndarray:
    """ASCII letters in lower case, digits and all non-ASCII bytes; all else separates."""
    t = np.zeros(256, dtype=np.uint8)
    for a, b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        t[a : b + 1] = np.arange(a, b + 1)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U)


_POWERS: dict[int, np.ndarray] = {}


def _power(n: int, base: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = powers(max(n, CHUNK), base)
    return have[:n]


@dataclass
class Words:
    """Words of some texts: byte starts and ends in ``data``, hashes, and for text i its words first[i]:first[i+1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return ends - np.arange(len(self.starts))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def pieces(offsets: np.ndarray, chunk: int = CHUNK):
    """Ranges of texts of about ``chunk`` bytes, one text at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + chunk, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def split(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]]; table maps bytes, 0 separates."""
    n = len(data)
    mapped = table[data]
    word = mapped != 0
    begins, stops = word.copy(), word.copy()
    if n:
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        inner = offsets[:-1][(offsets[:-1] < offsets[1:])]  # texts that have bytes
        begins[inner] = word[inner]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        stops[last] = word[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    values = byte_values()[mapped]
    values *= _power(n, _BASE)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(values, out=sums[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    hashes = mix((sums[ends] - sums[starts]) * _power(n, inverse)[starts]) if len(starts) else np.zeros(0, U)
    return Words(data, offsets, starts, ends, first, hashes)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k hashes (len - k + 1 of them), by doubling; the caller masks runs that cross texts."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    total, covered, power, width, bits = None, 0, hashes, 1, k
    while bits:
        if bits & 1:
            part = power
            if total is None:
                total, covered = part, width
            else:
                m = n - covered - width + 1
                total = total[:m] + U(pow(_STEP, covered, 1 << 64)) * part[covered : covered + m]
                covered += width
        bits >>= 1
        if bits:
            m = n - 2 * width + 1
            power = power[:m] + U(pow(_STEP, width, 1 << 64)) * power[width : width + m]
            width *= 2
    return mix(total[: n - k + 1])


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest of each w neighbours (len - w + 1 results), the leftmost of equals."""
    n = len(x)
    if n < w:
        return np.zeros(0, np.int64)
    at, width = np.arange(n), 1
    while width < w:
        step = min(width, w - width)
        m = len(at) - step
        a, b = at[:m], at[step : step + m]
        at = np.where(x[b] < x[a], b, a)
        width += step
    return at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
