"""Chroma audio fingerprints, and classes of recordings that align.

A media value is a WAV file (PCM of 8 or 16 bits, mixed to mono and brought to 8 kHz) or, without a RIFF header, raw
8-bit unsigned PCM at 8 kHz. Frames of 256 samples every 64 are windowed and transformed, their power is summed into 12
pitch classes and normalised. Sixteen Haar-like filters of areas of an integral image over 16 frames are quantised to 2
bits each in Gray code, which packs a 32-bit integer for each frame.

Candidates share a key of an anchor. Anchors are places chosen by the sound itself, the largest sums of 32 samples within
windows, so they stay where they are in it however a recording was cut: frames are laid from the anchor on, and those of
equal sound are equal. Two integers of an anchor, 8 frames apart, give a key for each of several sets of their bits, so
a few bits outside a set may differ. A pair is aligned at the offset with the least share of differing bits (the longest part
of equals, then the least offset) among those whose part is at least half of the shorter recording and 24 integers, and
is linked if at most 12 % of the bits differ there; candidates are held against the offsets at which they share a key. Two cuts of one recording that begin
half a hop apart differ in 9 % of their bits (95 % of pairs: under 11 %). With shorter parts or more errors, pairs that
agree by chance outnumber the others. Equal fingerprints are one class head from the start; classes are the connected
components of links, named by the least id.

The query takes the UTF-8 bytes of documents as its recordings, since the tables have no sound: every byte is a sample.

Cases: recordings under 1216 samples have no integers, and are in one class if their samples are equal, empty ones too;
those of under 24 integers (2688 samples) join a class by equal integers only; nulls are classes of their own; a WAV
header that can't be read makes its bytes raw samples; rows with a null id have a null class; rows that share an id are
one node; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._links import components
from ._shared import Scratch, bitmap, in_bitmap, small_batches, table

U = np.uint64
RATE, FRAME, HOP = 8000, 256, 64
#: Frames that a filter's image spans.
SPAN = 16
#: Samples of an anchor's window and of the sums compared, and frames between the integers of an anchor's key.
NEIGHBOURHOOD, SUMMED, APART = 768, 32, 8
#: Sets of bits, and bits in a set: one is equal with 0.95**34 = 0.17 where 5 % of the bits differ, and there are several anchors.
#: A key's chance to repeat grows with the number of anchors: beyond some 1 TB take more bits (and bands).
BANDS, BITS = 7, 34
#: Bits that are nearly the same in all integers, so a key gains nothing by them.
STEADY_BITS = (0, 4, 22, 23)
#: Products of lengths from which offsets are counted by Fourier transforms.
LARGE = 1 << 18
#: Bits of both integers that may differ where a key is shared: of the 22 that count and aren't in the key, chance leaves 8.
MARK_ERRORS = 5
#: Recordings of a bucket that are held against each other at once.
BLOCK = 1024
#: Bits of a key by which keys are counted (equal ones by chance do no harm), and keys that a task sorts at once.
CELL_BITS, KEYS = 42, 1 << 20
#: Groups of so many rows or fewer are compared all at once, larger ones row by row.
SMALL = 32
#: Rows, and bytes, of whole groups worked on at once, and integers compared at once.
ROWS, BYTES, INTEGERS = 20_000, 16 << 20, 1 << 20
#: Bits of the bitmap of keys that several recordings have, as a power of two: 16 MB.
BITMAP = 27
LEAST_OVERLAP, LEAST_INTEGERS, MOST_ERRORS = 0.5, 24, 0.12
#: Steps between the four levels of a filter's value.
STEPS = (-0.12, 0.0, 0.12)


def filters():
    """(shape, first pitch, pitches, frames) of the 16 filters: all shapes at spread places and sizes."""
    out = []
    for i in range(16):
        pitches = (4, 6, 8, 12)[i // 4]
        out.append((i % 5, (5 * i) % (13 - pitches), pitches, (4, 8, 12, 16)[(i + i // 4) % 4]))
    return out


def pitch_matrix() -> np.ndarray:
    """(bins, 12): the pitch class of each bin from 90 Hz to 3600 Hz."""
    m = np.zeros((FRAME // 2 + 1, 12), np.float32)
    for k in range(m.shape[0]):
        f = k * RATE / FRAME
        if 90 <= f <= 3600:
            m[k, round(12 * np.log2(f / 440)) % 12] = 1
    return m


def wav(value: bytes) -> np.ndarray | None:
    """Samples of a WAV file at RATE, or None if it can't be read."""
    at, kind, out = 12, None, None
    try:
        while at + 8 <= len(value):
            name, size = value[at : at + 4], struct.unpack_from("<I", value, at + 4)[0]
            if name == b"fmt ":
                kind = struct.unpack_from("<HHIIHH", value, at + 8)
            elif name == b"data" and kind:
                code, channels, rate, _, _, bits = kind
                if code != 1 or bits not in (8, 16) or not channels or not rate:
                    return None
                body = value[at + 8 : at + 8 + size]
                x = np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], "<u1" if bits == 8 else "<i2").astype(np.float32)
                x = x - 128 if bits == 8 else x / 256
                x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
                n = int(len(x) * RATE / rate)
                out = np.interp(np.arange(n) * rate / RATE, np.arange(len(x)), x).astype(np.float32) if rate != RATE and len(x) else x
                break
            at += 8 + size + size % 2
    except struct.error:
        return None
    return out


def chroma_of(samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Normalised power of the 12 pitch classes of the frames that begin at starts."""
    window, chroma = np.hanning(FRAME).astype(np.float32), np.zeros((len(starts), 12), np.float32)
    to_pitch = pitch_matrix()
    low, high = np.flatnonzero(to_pitch.any(axis=1))[[0, -1]]  # a mean leaks into bins 0 and 1 only, so it may stay
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32, copy=False), FRAME) if len(starts) else None
    for a in range(0, len(starts), 2048):
        spectrum = np.fft.rfft(frames[starts[a : a + 2048]] * window, axis=1)[:, low : high + 1]
        chroma[a : a + 2048] = (spectrum.real**2 + spectrum.imag**2) @ to_pitch[low : high + 1]
    norm = np.sqrt((chroma**2).sum(axis=1, keepdims=True))
    return chroma / np.maximum(norm, 1e-3)


def integers(chroma: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Packed levels of the filters over the SPAN frames from each place in ``at``."""
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def area(t0, t1, p0, p1):
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    packed = np.zeros(len(at), np.uint32)
    for shape, y, h, w in filters():
        whole, half, mid = area(0, w, y, y + h), w // 2, y + h // 2
        if shape == 0:  # later against earlier frames
            one = area(half, w, y, y + h)
        elif shape == 1:  # upper against lower pitches
            one = area(0, w, mid, y + h)
        elif shape == 2:  # crossed quarters
            one = area(0, half, y, mid) + area(half, w, mid, y + h)
        elif shape == 3:  # middle frames against both ends
            one = area(w // 4, w - w // 4, y, y + h)
        else:  # middle pitches against both ends
            one = area(0, w, y + h // 4, y + h - h // 4)
        level = np.searchsorted(STEPS, np.log((1 + one) / (1 + whole - one)))
        packed = (packed << np.uint32(2)) | np.array([0, 1, 3, 2], np.uint32)[level]
    return packed


def prints_of(samples: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers of recordings samples[offsets[i]:offsets[i+1]], and the first integer of each."""
    lengths = np.diff(offsets)
    frames = np.where(lengths >= FRAME, (lengths - FRAME) // HOP + 1, 0)
    first = np.cumsum(frames) - frames
    of = np.repeat(np.arange(len(frames)), frames)
    counts = np.maximum(frames - SPAN + 1, 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    if not begin[-1]:
        return np.zeros(0, np.uint32), begin
    place = np.arange(len(of)) - first[of]
    return integers(chroma_of(samples, offsets[:-1][of] + place * HOP), np.flatnonzero(place < counts[of])), begin


def _largest(x: np.ndarray, w: int, whole: bool) -> np.ndarray:
    """Index of the largest of each w neighbours, the leftmost of equals; whole numbers carry it in their low bits."""
    if not whole or len(x) < w:
        return W.sliding_argmin(-x, w)
    low, width = (1 << 40) - 1, 1
    best = (x.astype(np.int64) << 40) + (low - np.arange(len(x)))
    while width < w:
        step = min(width, w - width)
        best = np.maximum(best[: len(best) - step], best[step:])
        width += step
    return low - (best & low)


def anchors(samples: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Recordings and places of anchors: largest sums of samples in each window of places from which a key's frames fit.

    A recording with fewer places than a window has one anchor, the largest of all. Places on a plateau are left out.
    """
    need = FRAME + HOP * (APART + SPAN - 1)
    sums = np.concatenate([[0.0], np.cumsum(samples, dtype=np.float64)])
    loud = sums[SUMMED:] - sums[:-SUMMED]
    room = np.diff(offsets) - need + 1
    windows = np.maximum(room - NEIGHBOURHOOD + 1, 0)
    begin = np.repeat(offsets[:-1] + windows - np.cumsum(windows), windows) + np.arange(windows.sum())
    at = np.unique(_largest(loud, NEIGHBOURHOOD, samples.dtype == np.uint8)[begin]) if len(begin) else np.zeros(0, np.int64)
    few = np.flatnonzero((room > 0) & (room < NEIGHBOURHOOD))
    at = np.concatenate([at, np.array([offsets[i] + loud[offsets[i] : offsets[i] + room[i]].argmax() for i in few], np.int64)])
    before, after = loud[np.maximum(at - 1, 0)], loud[np.minimum(at + 1, len(loud) - 1)]
    at = at[(loud[at] != before) | (loud[at] != after)]
    return np.searchsorted(offsets, at, side="right") - 1, at


def band_masks() -> np.ndarray:
    """(BANDS, 2): the bits of the two integers of an anchor that count in each key."""
    draw = W.mix(np.arange(1, BANDS * 64 + 1, dtype=U)).reshape(BANDS, 2, 32)
    draw[:, :, STEADY_BITS] = U(2**64 - 1)
    chosen = np.zeros((BANDS, 64), np.uint32)
    np.put_along_axis(chosen, np.argsort(draw.reshape(BANDS, 64), axis=1)[:, :BITS], 1, axis=1)
    return (chosen.reshape(BANDS, 2, 32) << np.arange(32, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)


MASKS = band_masks()


def anchored(samples: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two integers of each anchor, packed, and its place, for each recording."""
    of, at = anchors(samples, offsets)
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    frames = APART + SPAN
    first = np.arange(len(at)) * frames
    chroma = chroma_of(samples, (at[:, None] + np.arange(frames) * HOP).ravel())
    one, two = (integers(chroma, first + k).astype(U) for k in (0, APART))
    ends = np.searchsorted(of, np.arange(1, len(offsets) - 1))
    return list(zip(np.split(one << U(32) | two, ends), np.split(at - offsets[of], ends)))


def keys_of(ints: np.ndarray, at: np.ndarray, of: np.ndarray):
    """Distinct keys of anchors by recording: key, integers, place (of the first of equal keys) and recording."""
    one, two = ints >> U(32), ints & U(0xFFFFFFFF)
    keys = [W.mix(W.mix((one & U(int(m[0]))) + U((band + 1) * W._STEP & (1 << 64) - 1)) + (two & U(int(m[1])))) for band, m in enumerate(MASKS)]
    keys, ints, at, of = np.concatenate(keys), np.tile(ints, BANDS), np.tile(at, BANDS), np.tile(of, BANDS)
    order = np.lexsort((at, keys, of))
    keys, ints, at, of = keys[order], ints[order], at[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return keys[new], ints[new], at[new], of[new]


def fingerprints(column) -> tuple[list[np.ndarray], list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """Of each value of an Arrow column of bytes: packed integers, what equal recordings have in common, and anchors.

    What equals share is a hash of the integers, or of the samples where there are none.
    """
    values, offsets = W.utf8(column)
    out: list[np.ndarray] = []
    same: list[bytes] = []
    places_of: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in W.pieces(offsets):
        own, places = values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        heads = [own[p : p + 4].tobytes() == b"RIFF" for p in places[:-1]]
        raw = [True] * len(heads)
        if any(heads):
            parts = [wav(own[p:q].tobytes()) if h else None for h, p, q in zip(heads, places, places[1:])]
            raw = [x is None for x in parts]
            parts = [own[p:q].astype(np.float32) if x is None else x for x, p, q in zip(parts, places, places[1:])]
            own, places = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        packed, begin = prints_of(own, places)
        prints = np.split(packed, begin[1:-1])
        out += prints
        places_of += [x if len(y) >= LEAST_INTEGERS else tuple(part[:0] for part in x) for x, y in zip(anchored(own, places), prints)]
        for x, head, p, q in zip(prints, raw, places, places[1:]):
            whole = b"p" + x.astype("<u4").tobytes() if len(x) else b"s" + (own[p:q].astype("<f4") - (128 if head else 0)).tobytes()
            same.append(hashlib.sha256(whole).digest()[:16])
    return out, same, places_of


def errors_by_shift(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits in the common part at each offset of b against a, from 1 - len(b) to len(a) - 1."""
    n, m = len(a), len(b)
    if n * m <= LARGE:
        skewed = np.zeros((m, n + m), np.uint8)
        skewed[:, :n] = np.bitwise_count(b[::-1, None] ^ a)
        return skewed.ravel()[: m * (n + m - 1)].reshape(m, n + m - 1).sum(axis=0, dtype=np.int64)
    size, total = 1 << int(n + m - 1).bit_length(), 0
    for k in range(32):
        x, y = (1.0 - 2.0 * ((v >> np.uint32(k)) & np.uint32(1)) for v in (a, b))
        total = total + np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size))
    same = np.rint(np.fft.irfft(total, size)).astype(np.int64)[np.arange(1 - m, n)]
    return (32 * common_part(n, m) - same) // 2


def common_part(n: int, m: int) -> np.ndarray:
    shift = np.arange(1 - m, n)
    return np.minimum(n, m + shift) - np.maximum(0, shift)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Offset of b against a, integers in common at it, and the share of their bits that differ."""
    n = common_part(len(a), len(b))
    able = np.flatnonzero(n >= max(LEAST_INTEGERS, LEAST_OVERLAP * min(len(a), len(b)))) if len(a) and len(b) else ()
    if not len(able):
        return 0, 0, 1.0
    share = errors_by_shift(a, b)[able] / (32 * n[able])
    best = able[np.lexsort((able, -n[able], share))[0]]
    return int(best) - len(b) + 1, int(n[best]), float(share.min())


def aligned(a: np.ndarray, b: np.ndarray) -> bool:
    _, n, errors = align(a, b)
    return n > 0 and errors <= MOST_ERRORS


def sharing(keys: list[np.ndarray], outer: np.ndarray) -> tuple[list[int], list[int]]:
    """Places of outer and other recordings of a block that share a key, by products of 0/1 matrices."""
    of = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    _, column, counts = np.unique(np.concatenate([*keys, np.zeros(0, U)]), return_inverse=True, return_counts=True)
    common = counts[column] > 1
    of, column = of[common], np.unique(column[common], return_inverse=True)[1]
    x, y = np.flatnonzero(outer), np.flatnonzero(~outer)
    shared, chunk = np.zeros((len(x), len(y)), bool), 8192
    for at in range(0, int(column.max()) + 1 if len(column) else 0, chunk):
        now = (column >= at) & (column < at + chunk)
        has = np.zeros((len(keys), chunk), np.float32)
        has[of[now], column[now] - at] = 1
        shared |= has[x] @ has[y].T > 0
    i, j = np.nonzero(shared)
    return x[i].tolist(), y[j].tolist()


def _lists(parts: list[np.ndarray], kind):
    """Offsets and values of an Arrow list column."""
    return np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32), np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)


def pack(x: np.ndarray) -> bytes:
    """Integers, of which neighbours are alike, in some 0.7 of their size: what changes from each to the next, by planes of bytes."""
    changes = (x ^ np.concatenate([np.zeros(1, np.uint32), x[:-1]])).astype("<u4")
    return len(x).to_bytes(4, "little") + pa.compress(changes.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpack(value: bytes) -> np.ndarray:
    n = int.from_bytes(value[:4], "little")
    planes = np.frombuffer(pa.decompress(value[4:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.bitwise_xor.accumulate(np.ascontiguousarray(planes.T).view("<u4").ravel())


def _print(batches):
    for batch in batches:
        prints, same, found = fingerprints(batch.column(1))
        same = [x if valid else None for x, valid in zip(same, batch.column(1).is_valid().to_pylist())]
        crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in prints]
        packed = [pack(x) if len(y[0]) else None for x, y in zip(prints, found)]
        (ends, ints), (_, at) = _lists([x[0] for x in found], U), _lists([x[1] for x in found], np.int32)
        anchors_ = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(W.signed(ints)), pa.array(at)], ["ints", "at"]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in prints], pa.int64()), pa.array(crcs, pa.int64()), pa.array(packed, pa.binary()), pa.array(same, pa.binary()), anchors_],
            ["v", "n_prints", "prints_crc32", "prints", "same", "anchors"],
        )


def keyed(own: DataFrame, several=None) -> DataFrame:
    """v and bands (keys with their marks) of each row's anchors; with a broadcast bitmap only keys that may be in it."""

    def keys(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ints, at = flat.field(0).to_numpy().view(U), flat.field(1).to_numpy()
            key, ints, at, of = keys_of(ints, at, np.repeat(np.arange(len(sizes)), sizes))
            if several is not None:
                ok = in_bitmap(several.value, key)
                key, ints, at, of = key[ok], ints[ok], at[ok], of[ok]
            mark = pa.StructArray.from_arrays([pa.array(W.signed(ints)), pa.array(at)], ["ints", "at"])
            ends = np.searchsorted(of, np.arange(len(sizes) + 1)).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(W.signed(key)), mark], ["bucket", "mark"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), bands], ["v", "bands"])

    return own.select("v", "anchors").mapInArrow(keys, f"v {dict(own.dtypes)['v']}, bands array<struct<bucket: long, mark: struct<ints: long, at: int>>>")


def shared_keys(own: DataFrame, tasks: int) -> DataFrame:
    """bucket and n: the low CELL_BITS bits of keys that several rows have, and by how many. Keys move as sorted arrays of steps, in planes of bytes, which shuffles compress."""

    def deal(batches):
        held, n = [], 0

        def blobs():
            cells = np.sort(np.concatenate(held) & U((1 << CELL_BITS) - 1))
            part, first = np.unique(cells >> U(32), return_index=True)
            values = [np.diff(x & U(0xFFFFFFFF), prepend=U(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in np.split(cells, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(values, pa.binary())], ["part", "cells"])

        for batch in batches:
            lists = batch.column(0)
            flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            held.append(keys_of(flat.field(0).to_numpy().view(U), flat.field(1).to_numpy(), np.repeat(np.arange(len(sizes)), sizes))[0])
            n += len(held[-1])
            if n >= KEYS:
                yield blobs()
                held, n = [], 0
        if n:
            yield blobs()

    def count(batches):
        for table, first in whole_groups(batches, 1):
            cells = table.column("cells").to_pylist()
            for f, e in zip(first.tolist(), [*first[1:].tolist(), len(cells)]):
                steps = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel() for x in cells[f:e]]
                low, n = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint32) for x in steps]), return_counts=True)
                bucket = (int(table.column("part")[f].as_py()) << 32) + low[n > 1].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n[n > 1].astype(np.int64))], ["bucket", "n"])

    dealt = own.select("anchors").mapInArrow(deal, "part int, cells binary").repartition(tasks, "part")
    return dealt.sortWithinPartitions("part").mapInArrow(count, "bucket long, n long")


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose v is in ids, and a few more: told by a bitmap of hashes, so rows aren't moved."""
    own = rows.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("v").alias("h")), "h", BITMAP))

    def keep(batches):
        for batch in batches:
            ok = in_bitmap(own.value, batch.column(0).to_numpy().view(U))
            yield pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:]).filter(pa.array(ok))

    return rows.select(F.xxhash64("v").alias("h"), "*").mapInArrow(keep, rows.schema)


def linked_at(a: np.ndarray, b: np.ndarray, shifts) -> bool:
    """Whether a and b align where b's samples lie ``shift`` after a's, for one of the shifts, at the hops around it."""
    shifts = np.array(list(shifts), np.int64)
    ints, begin = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    return bool(links_at(ints, begin, np.zeros(len(shifts), np.int64), np.ones(len(shifts), np.int64), shifts).any())


def links_at(ints: np.ndarray, begin: np.ndarray, x: np.ndarray, y: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Whether recordings x[i] and y[i], of ints[begin[k]:begin[k+1]], align at the hops around shift[i], y's samples after x's."""
    out = np.zeros(len(x), bool)
    size = np.diff(begin)
    least = np.maximum(LEAST_INTEGERS, LEAST_OVERLAP * np.minimum(size[x], size[y]))
    for k, apart in ((shift // HOP, True), (-(shift // -HOP), shift % HOP != 0)):
        lo, hi = np.maximum(0, -k), np.minimum(size[x], size[y] - k)
        able = np.flatnonzero((hi - lo >= least) & apart & ~out)
        n = (hi - lo)[able]
        p, q = begin[x[able]] + lo[able], begin[y[able]] + (lo + k)[able]
        total, at = np.cumsum(n), 0
        while at < len(able):
            to = max(at + 1, int(np.searchsorted(total, total[at] - n[at] + INTEGERS, side="right")))
            m = n[at:to]
            first = np.cumsum(m) - m
            step = np.arange(int(m.sum()))
            differ = np.bitwise_count(ints[np.repeat(p[at:to] - first, m) + step] ^ ints[np.repeat(q[at:to] - first, m) + step])
            out[able[at:to]] = np.add.reduceat(differ, first, dtype=np.int64) <= MOST_ERRORS * 32 * m
            at = to
    return out


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component; a[i] and b[i] are linked."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def group_labels(first: np.ndarray, ends: np.ndarray, linked) -> np.ndarray:
    """For each row the least row of its component, links being among the rows first[i]:ends[i] of a group.

    linked(x, y) tells which pairs of rows are links. In a large group a row is compared only with rows that no row
    before it has reached, so a group of copies takes one comparison a row.
    """
    sizes, a, b = ends - first, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        i, j = np.triu_indices(n, 1)
        starts = first[sizes == n]
        for at in range(0, len(starts), max(1, INTEGERS // len(i))):
            some = starts[at : at + max(1, INTEGERS // len(i)), None]
            x, y = (some + i).ravel(), (some + j).ravel()
            ok = linked(x, y)
            a.append(x[ok])
            b.append(y[ok])
    for f, e in zip(first[sizes > SMALL].tolist(), ends[sizes > SMALL].tolist()):
        rest = np.arange(f, e)
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = np.full(len(rest), queue.pop())
                ok = linked(x, rest)
                a.append(x[ok])
                b.append(rest[ok])
                queue += rest[ok].tolist()
                rest = rest[~ok]
    return least_labels(int(ends[-1]) if len(ends) else 0, np.concatenate(a), np.concatenate(b))


def whole_groups(batches, keys: int):
    """Tables of whole groups, equal in their first ``keys`` columns, from batches in their order; and where groups begin."""
    held, rows, size = [], 0, 0

    def cut(table):
        new = np.ones(len(table), bool)
        new[1:] = False
        for c in range(keys):
            x = table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
        if rows >= ROWS or size >= BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            first = cut(table)
            if len(first) > 1:
                yield table.slice(0, first[-1]).combine_chunks(), first[:-1]
                table = table.take(pa.array(np.arange(first[-1], len(table))))
            held = table.to_batches()
            rows, size = (len(table), table.nbytes) if len(first) > 1 else (0, 0)
    if held and sum(map(len, held)):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _may_align(batches):
    """hub, v and e of sorted rows bucket, part, h, v, ints, at: those that another's marks allow.

    Ids whose marks, one after the other, allow each other are a group. hub is part of the hash of its first id, e holds 32 bits of a
    hash of the ids and their distances, so groups that tell the same are the same, and the distance from the first id.
    """
    for table, first in whole_groups(batches, 2):
        h, ints, at = (_column(table, c) for c in ("h", "ints", "at"))
        ints, at = ints.view(U), at.astype(np.int64)
        label = group_labels(first, np.append(first[1:], len(table)), lambda x, y: np.bitwise_count(ints[x] ^ ints[y]) <= MARK_ERRORS)  # noqa: B023
        at = at - at[label]
        sums = np.zeros(len(label), U)
        np.add.at(sums, label, W.mix(W.mix(h.view(U)) + at.view(U)))
        e = (W.mix(sums)[label] << U(32)) | (at.view(U) & U(0xFFFFFFFF))
        kept = np.bincount(label, minlength=len(label))[label] > 1
        out = pa.table([pa.array((h[label] >> 32).astype(np.int32)), table.column("v"), pa.array(W.signed(e))], ["hub", "v", "e"]).filter(pa.array(kept))
        yield from out.combine_chunks().to_batches()


def _prints_column(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(x) for x in table.column("prints").to_pylist()]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _links(batches):
    """Links within groups, of sorted rows hub, h, v, es, prints: each with the first of its component among these rows."""
    for table, first in whole_groups(batches, 1):
        h, es = _column(table, "h"), table.column("es").combine_chunks()
        ints, begin = _prints_column(table)
        e, sizes = es.flatten().to_numpy().view(U), es.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(table)), sizes)
        hub = np.searchsorted(first, row, side="right")
        sig, at = e >> U(32), (e & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32).astype(np.int64)
        order = np.lexsort((row, sig, hub))
        row, hub, sig, at = row[order], hub[order], sig[order], at[order]
        new = np.ones(len(row), bool)
        new[1:] = (hub[1:] != hub[:-1]) | (sig[1:] != sig[:-1])
        begins = np.flatnonzero(new)

        def linked(x, y):
            shift = at[y] - at[x]  # noqa: B023
            pair = W.mix((row[x] * len(h) + row[y]).view(U)) + shift.view(U)  # noqa: B023
            _, one, every = np.unique(pair, return_index=True, return_inverse=True)
            return links_at(ints, begin, row[x[one]], row[y[one]], shift[one])[every]  # noqa: B023

        label = group_labels(begins, np.append(begins[1:], len(row)), linked)
        # Groups share ids: components of all these rows, with the rows of an id as one.
        ids, of = np.unique(h, return_index=True)
        node = np.searchsorted(ids, h)[row]
        far = np.flatnonzero(label != np.arange(len(label)))
        root = least_labels(len(ids), node[far], node[label[far]])
        ends = np.flatnonzero(root != np.arange(len(ids)))
        v = table.column("v")
        yield from pa.table([v.take(pa.array(of[root[ends]])), v.take(pa.array(of[ends]))], ["a", "b"]).combine_chunks().to_batches()


def _links_across(batches):
    """Links of sorted rows bucket, i, j, h, outer, root, v, ints, at, prints between outer rows and rows of other roots."""
    for table, first in whole_groups(batches, 3):
        ints, at, root = _column(table, "ints").view(U), _column(table, "at").astype(np.int64), _column(table, "root")
        outer, v = table.column("outer").to_numpy(), table.column("v")
        prints, begin = _prints_column(table)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for f, e in zip(first.tolist(), [*first[1:].tolist(), len(table)]):
            inner = f + np.flatnonzero(~outer[f:e])
            for x in (f + np.flatnonzero(outer[f:e])).tolist():
                y = inner[(root[inner] != root[x]) & (np.bitwise_count(ints[inner] ^ ints[x]) <= MARK_ERRORS)]
                y = y[links_at(prints, begin, np.full(len(y), x), y, at[y] - at[x])]
                _, one = np.unique(root[y], return_index=True)  # a root's other rows are linked to it already
                a.append(np.full(len(one), x))
                b.append(y[one])
        yield from pa.table([v.take(pa.array(np.concatenate(a))), v.take(pa.array(np.concatenate(b)))], ["a", "b"]).combine_chunks().to_batches()


def classes_of(scratch: Scratch, own: DataFrame, kind: str, block: int = BLOCK) -> DataFrame:
    """(v, root) of the ends of links among recordings that share a key; root is the least id of the component.

    The recordings of a bucket meet in one task, as rows of an array, and pairs are never written. A bucket of more than
    ``block`` is dealt into parts, each with the bucket's least recording. What then is still outside the component of
    that recording is held against the whole bucket, block by block.
    """
    spark = own.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Most keys are one recording's alone; a bitmap of the others lets each task leave them out.
    buckets = scratch.save(shared_keys(own, tasks), "buckets")
    several = spark.sparkContext.broadcast(bitmap(buckets, "bucket", BITMAP))
    scratch.tidy()
    members = keyed(own, several).select(F.explode("bands").alias("e"), "v").select(F.col("e.bucket").bitwiseAND(F.lit((1 << CELL_BITS) - 1)).alias("bucket"), "v", "e.mark.ints", "e.mark.at")
    large = buckets.filter(F.col("n") > block)
    some = large.limit(1).count() > 0
    if some:
        large = members.join(large.select("bucket"), "bucket", "left_semi").groupBy("bucket").agg(F.min("v").alias("least"), F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
        large = scratch.save(large.filter("parts > 1"), "large")
        own_part = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
        part = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("v") == F.col("least"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own_part))
        dealt = members.join(large, "bucket", "left").withColumn("part", F.explode(part))
    else:
        dealt = members.withColumn("part", F.lit(0))
    # The hash orders rows alike in all buckets.
    rows = dealt.select("bucket", "part", "v", "ints", "at").repartition(tasks, "bucket", "part").select("bucket", "part", F.xxhash64("v").alias("h"), "v", "ints", "at")
    met = rows.sortWithinPartitions("bucket", "part", "h").mapInArrow(_may_align, f"hub int, v {kind}, e long")
    # Groups of one hub meet in one task, so each of its recordings goes there once.
    met = scratch.save(met.repartition(tasks, "v").groupBy("hub", "v").agg(F.collect_set("e").alias("es")), "met")
    scratch.tidy()
    prints = among(own.select("v", "prints"), met).hint("merge")
    rows = met.join(prints, "v").repartition(tasks, "hub").select("hub", F.xxhash64("v").alias("h"), "v", "es", "prints")
    links = scratch.save(rows.sortWithinPartitions("hub", "h").mapInArrow(_links, f"a {kind}, b {kind}").filter("a <> b").distinct(), "links")
    scratch.tidy()
    roots = components(scratch, links, "roots1")
    if not some:
        return roots

    named = members.join(large, "bucket").select("bucket", "v", "ints", "at", "least", "parts")
    named = named.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = named.join(roots.select(F.col("v").alias("least"), F.col("root").alias("main")), "least", "left").withColumn("outer", F.col("root") != F.coalesce("main", "least"))
    named = scratch.save(named.drop("main", "least"), "named")
    sizes = named.filter("outer").groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("rows"))
    placed = named.join(sizes, "bucket").withColumn("h", F.xxhash64("v"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.filter("outer").withColumn("i", F.pmod("h", F.col("rows")).cast("int")).withColumn("j", all_of("parts"))
    right = placed.withColumn("outer", F.lit(False)).withColumn("j", F.pmod("h", F.col("parts")).cast("int")).withColumn("i", all_of("rows"))
    columns = ["bucket", "i", "j", "h", "outer", F.xxhash64("root").alias("root"), "v", "ints", "at"]
    blocks = left.select(*columns).unionByName(right.select(*columns)).join(own.select("v", "prints"), "v").repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "h")
    more = blocks.select("bucket", "i", "j", "h", "outer", "root", "v", "ints", "at", "prints").mapInArrow(_links_across, f"a {kind}, b {kind}").filter("a <> b").distinct()
    more = scratch.save(more, "more")
    scratch.tidy()
    return components(scratch, links.union(more), "roots2") if more.limit(1).count() else roots


def recordings(media: DataFrame, key: str, value: str) -> DataFrame:
    """id, n_prints, prints_crc32, class_id of every row."""
    spark = media.sparkSession
    small_batches(spark, 500)
    scratch = Scratch(spark, "audio")
    kind = dict(media.dtypes)[key]
    rows = media.select(F.col(key).alias("v"), F.col(value).cast("binary").alias("media"))
    found = scratch.save(rows.mapInArrow(_print, f"v {kind}, n_prints long, prints_crc32 long, prints binary, same binary, anchors array<struct<ints: long, at: int>>"), "prints")
    valued = found.filter("v is not null and same is not null").select("v", "same")
    heads = valued.groupBy("same").agg(F.min("v").alias("head"))
    heads = scratch.save(valued.join(heads, "same").select("v", "head"), "heads")
    # A copy that the bitmap lets through is linked to its head.
    own = scratch.save(among(found.filter("v is not null and same is not null and size(anchors) > 0").select("v", "prints", "anchors"), heads.filter("v = head")), "own")
    found = scratch.save(found.select("v", "n_prints", "prints_crc32"), "rows")
    scratch.drop("prints")
    scratch.tidy()
    roots = classes_of(scratch, own, kind)
    named = heads.distinct().join(roots.withColumnRenamed("v", "head"), "head", "left").select("v", F.coalesce("root", "head").alias("class_id"))
    named = named.groupBy("v").agg(F.min("class_id").alias("class_id"))
    out = found.select("v", "n_prints", "prints_crc32").join(named, "v", "left")
    return scratch.finish(out.select(F.col("v").alias(key), "n_prints", "prints_crc32", F.coalesce("class_id", "v").alias("class_id")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
