"""Words and hashes of whole Arrow batches of texts, by numpy, without a Python loop per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LONG = 128


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: none) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = 1_000_000):
    """Runs of rows of about ``most`` bytes of text together, or of one longer row."""
    raw, at = text_bytes(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word, and the index of the first word of each row plus the total."""
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mixed(x: np.ndarray) -> np.ndarray:
    return _rotl(x * _P2, 31) * _P1


def xxh64(raw: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the byte spans, as numpy computes it for all spans of one length at a time."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    buf = np.concatenate([raw, np.zeros(8, np.uint8)])
    by8 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    by4 = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    kind = np.minimum(length, _LONG + 1).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=_LONG + 2))
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        for n in np.unique(kind):
            at = order[ends[n] - (ends[n] - (ends[n - 1] if n else 0)) : ends[n]]
            if n > _LONG:
                for i in at:
                    out[i] = xxhash.xxh64_intdigest(buf[start[i] : start[i] + length[i]].tobytes(), seed)
                continue
            p, left = start[at], int(n)
            if left >= 32:
                acc = [np.full(len(at), v) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
                while left >= 32:
                    for k in range(4):
                        acc[k] = _rotl(acc[k] + by8[p + 8 * k] * _P2, 31) * _P1
                    p, left = p + 32, left - 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for a in acc:
                    h = (h ^ _mixed(a)) * _P1 + _P4
            else:
                h = np.full(len(at), s + _P5)
            h = h + np.uint64(n)
            while left >= 8:
                h = _rotl(h ^ _mixed(by8[p]), 27) * _P1 + _P4
                p, left = p + 8, left - 8
            if left >= 4:
                h = _rotl(h ^ (by4[p].astype(np.uint64) * _P1), 23) * _P2 + _P3
                p, left = p + 4, left - 4
            while left:
                h = _rotl(h ^ (buf[p].astype(np.uint64) * _P5), 11) * _P1
                p, left = p + 1, left - 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[at] = h ^ (h >> np.uint64(32))
    return out
