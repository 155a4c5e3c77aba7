"""Vectorised text kernels over Arrow string buffers.

All functions work on slices of whole texts (a slice holds at least one whole
text and about ``SLICE`` bytes), so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 20
U64 = np.uint64

#: Byte tables. UTF-8 bytes of 0x80 and above belong to words in both classes,
#: which equals the code-point classes of the contracts.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[32] = False
NONSPACE[9:14] = False

#: str.translate-style tables for ``bytes.translate``.
TO_LOWER = LOWER_BYTES.tobytes()
TO_WORDS = bytes(c if ALNUM[c] else 32 for c in TO_LOWER)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices of a string column; null counts as empty."""
    arr = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    if not n:
        return
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, min(to, n), data[offs[at] : offs[min(to, n)]], offs[at : min(to, n) + 1] - offs[at]
        at = min(to, n)


def word_spans(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes, cut at text borders, and per text the index of its first word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = member[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offs[1:-1]
    before[cuts[cuts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent hash of two hashes."""
    return mix(a * U64(0x9E3779B97F4A7C15) + (b ^ U64(0xA0761D6478BD642F)))


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time. Seeds give families of their own, also for words of different lengths."""
    size = ends - starts
    out = size.astype(np.uint64) * U64(0x9E3779B185EBCA87)
    if seed:
        out = mix(out + U64(seed))
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    live = np.arange(len(size))
    long = size > LONG_WORD
    if long.any():
        live = live[~long]
        for i in np.flatnonzero(long):
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    k = 0
    while len(live):
        left = size[live] - k
        lane = lanes[starts[live] + k] & _KEEP[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ lane)
        k += 8
        live = live[left > 8]
    return out


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive entries, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, step = None, 0, h, 1
    while True:
        if width & step:
            part = power[done : done + n]
            out = part.copy() if out is None else join_hash(out, part)
            done += step
        if step * 2 > width:
            return out
        power = join_hash(power[: len(power) - step], power[step:])
        step *= 2


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of one long column, by which it deals rows to partitions and buckets: Murmur3, 32 bits, seed 42."""
    low32 = U64(0xFFFFFFFF)
    turn = lambda v, r: ((v << U64(r)) | (v >> U64(32 - r))) & low32
    x = np.asarray(x, np.int64).view(np.uint64)
    h = np.full(len(x), 42, np.uint64)
    for half in (x & low32, x >> U64(32)):
        k = turn(half * U64(0xCC9E2D51) & low32, 15) * U64(0x1B873593) & low32
        h = (turn(h ^ k, 13) * U64(5) + U64(0xE6546B64)) & low32
    h ^= U64(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> U64(shift))) * U64(factor) & low32
    return (h ^ (h >> U64(16))).astype(np.uint32).view(np.int32)
