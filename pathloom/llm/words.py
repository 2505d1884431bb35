"""Whole-batch word handling on Arrow buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` in a text's UTF-8
form.  Those six bytes never occur inside a multi-byte character, so byte-wise
splitting equals the character-wise pattern ``[^\\x20\\x09-\\x0D]+``; lower-casing
A-Z is byte-wise too.  Everything works on a slice of bounded bytes at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    o = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(texts: pa.Array, most: int = 8 << 20):
    """(first, end) row ranges whose texts hold about ``most`` bytes; a longer text stands alone."""
    _, o = buffers(texts)
    first, n = 0, len(texts)
    while first < n:
        end = max(first + 1, int(np.searchsorted(o, o[first] + most, "right")) - 1)
        yield first, min(end, n)
        first = min(end, n)


def split_words(texts: pa.Array, lower: bool, between: np.ndarray = _SPACE) -> tuple[pa.Array, np.ndarray]:
    """(binary array of all words, pointers of len(texts)+1 into it); ``between``: whether a byte is none of a word."""
    raw, offs = buffers(texts)
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
    ws = between[raw]
    word = ~ws
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = ws[:-1]
    full = offs[1:] > offs[:-1]
    before[offs[:-1][full]] = True
    starts = np.flatnonzero(word & before)
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = ws[1:]
    after[offs[1:][full] - 1] = True
    ends = np.flatnonzero(word & after) + 1
    data = raw[word]
    if lower:
        data = _LOWER[data]
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.searchsorted(starts, offs)


def hashed_words(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(uint64 hash of each lower-cased word, pointers), eight bytes of all words at a time."""
    words, ptr = split_words(texts, lower=True)
    return hash_bytes(words, seed), ptr


def hash_bytes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A uint64 hash of each value of a binary array, by values alone."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    raw, offs = buffers(values)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes that begin at each byte
    start, size = offs[:-1], np.diff(offs)
    out = mix(size.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    live = None
    for k in range(0, int(size.max()), 8):
        live = np.flatnonzero(size > k) if live is None else live[size[live] > k]
        left = np.minimum(size[live] - k, 8)
        got = eight[start[live] + k] & _MASK[left]
        out[live] = mix(out[live] * np.uint64(0x9E3779B97F4A7C15) + got)
    return out


def mix(a: np.ndarray) -> np.ndarray:
    """A bijection of uint64 values that spreads them evenly."""
    a = a ^ (a >> np.uint64(32))
    a = a * np.uint64(0xD6E8FEB86659FD93)
    a = a ^ (a >> np.uint64(32))
    a = a * np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(32))


def ragged(ptr: np.ndarray) -> np.ndarray:
    """Row number of every element of a ragged array with pointers ``ptr``."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def shingle_sets(texts: pa.Array, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(distinct uint64 shingle hashes, sorted within each text; pointers).

    A text of fewer than ``width`` words has its whole sequence as one shingle;
    a text without words has none.
    """
    h, ptr = hashed_words(texts, seed)
    n = np.diff(ptr)
    golden = np.uint64(0x9E3779B97F4A7C15)
    acc = mix(h + np.uint64(width))
    for k in range(1, width):
        acc = mix(acc[: max(0, len(h) - k)] * golden + h[k:])
    made = np.where(n >= width, n - width + 1, 0)
    short = np.flatnonzero((n > 0) & (n < width))
    made[short] = 1
    row = np.repeat(np.arange(len(n)), made)
    out_ptr = np.zeros(len(n) + 1, np.int64)
    np.cumsum(made, out=out_ptr[1:])
    at = np.arange(out_ptr[-1]) - out_ptr[row] + ptr[row]
    sets = np.concatenate([acc, np.zeros(width, np.uint64)])[at]
    for i in short:
        own = mix(h[ptr[i] : ptr[i] + 1] + np.uint64(n[i]))
        for k in range(1, n[i]):
            own = mix(own * golden + h[ptr[i] + k : ptr[i] + k + 1])
        sets[out_ptr[i]] = own[0]
    for a, b in zip(out_ptr[:-1].tolist(), out_ptr[1:].tolist()):
        sets[a:b].sort()
    keep = np.ones(len(sets), bool)
    keep[1:] = (sets[1:] != sets[:-1]) | (row[1:] != row[:-1])
    sets, row = sets[keep], row[keep]
    return sets, np.searchsorted(row, np.arange(len(n) + 1))
