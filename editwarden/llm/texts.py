"""Numpy helpers on the bytes of whole Arrow batches: words, hashes, spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
# The finaliser of a common 64-bit hash, and an odd base for polynomial hashes.
MIX_1 = U64(0xFF51AFD7ED558CCD)
MIX_2 = U64(0xC4CEB9FE1A85EC53)
BASE = 0x9E3779B97F4A7C15 | 1
SLICE = 1 << 20  # bytes hashed at once; bounds the memory of the power tables
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(values, seed: int = 0):
    """A 64-bit bijective scramble of unsigned integers."""
    x = values ^ U64((seed * BASE + seed) & 0xFFFFFFFFFFFFFFFF)
    x = x ^ (x >> U64(33))
    x = x * MIX_1
    x = x ^ (x >> U64(33))
    x = x * MIX_2
    return x ^ (x >> U64(33))


def _cumulative_powers(base: int, count: int):
    out = np.full(count, base & 0xFFFFFFFFFFFFFFFF, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _powers(count: int):
    """Powers of BASE and of its inverse modulo 2**64, kept per process."""
    size = max(count, SLICE + (1 << 16))
    if "up" not in _POWERS or len(_POWERS["up"]) < size:
        _POWERS["up"] = _cumulative_powers(BASE, size)
        _POWERS["down"] = _cumulative_powers(pow(BASE, -1, 1 << 64), size)
        _POWERS["byte"] = mix(np.arange(1, 257, dtype=U64), 7)
    return _POWERS["up"], _POWERS["down"], _POWERS["byte"]


def batch_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary Arrow column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def lowered(data):
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


def word_bounds(data, offsets, apart=_SPACE):
    """(starts, ends, words per document) of runs of bytes that are not in ``apart`` (a table of 256 flags).

    Without ``apart``, words stand between ASCII white space. Words never cross a document's end."""
    n, docs = len(data), len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(docs, np.int64)
    inside = ~apart[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    begins, stops = offsets[:-1][full], offsets[1:][full] - 1
    first[begins] = inside[begins]
    last[stops] = inside[stops]
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, np.flatnonzero(last) + 1, counts


def span_hashes(data, starts, ends, seed: int = 1):
    """A 64-bit hash of each byte span; equal bytes give equal hashes. Spans are in order."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, low + SLICE)))
        high = int(ends[i:j].max())
        up, down, byte = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, dtype=U64)
        np.cumsum(byte[data[low:high]] * up[:high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64), seed)
        i = j
    return out


def sequence_hashes(hashes, length: int, seed: int = 1):
    """The hash of each run of ``length`` neighbouring hashes (as if they were one document)."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=U64)
    up, down, _ = _powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(mix(hashes, seed + 11) * up[:len(hashes)], out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[:count], seed)


def merged(starts, ends):
    """Union of half-open spans as ordered, disjoint, not touching spans."""
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    last = np.flatnonzero(np.append(new[1:], True))
    return starts[new], reach[last]


def pack(*columns) -> bytes:
    """Integer columns as one compressed value; the first is sorted and stored as differences."""
    planes = []
    for k, column in enumerate(columns):
        values = np.ascontiguousarray(column).astype(np.int64, copy=False).view(U64)
        if k == 0 and len(values):
            values = np.diff(values, prepend=U64(0))
        planes.append(values.view(np.uint8).reshape(-1, 8).T.tobytes())
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(blob: bytes, count: int, width: int = 1):
    """The unsigned columns that ``pack`` stored."""
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=8 * count * width, codec="zstd", asbytes=True), dtype=np.uint8)
    out = []
    for k in range(width):
        values = np.ascontiguousarray(raw[8 * count * k:8 * count * (k + 1)].reshape(8, count).T).view(U64).reshape(-1)
        out.append(np.cumsum(values, dtype=U64) if k == 0 else values)
    return out
