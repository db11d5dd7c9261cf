"""Whole Arrow batches of texts as flat numpy arrays: words, hashes of words and n-grams."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about this many bytes (one long text is a slice of its own).
SLICE_BYTES = 1 << 20
MUL = 0x9E3779B97F4A7C15
_INV = pow(MUL, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def give_back() -> None:
    """Give the system the memory that this process no longer uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def tidy(f: Callable) -> Callable:
    """``f`` over the batches of a task; when the task ends its worker gives the system the memory that it no longer
    uses, which it would keep through later stages."""
    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()
    return run


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows whose texts have about ``most`` bytes."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a string array; null is empty."""
    b = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    b = pa.concat_arrays([b]).cast(pa.large_binary())
    off = np.frombuffer(b.buffers()[1], np.int64)[b.offset:b.offset + len(b) + 1]
    data = b.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; words never run across documents."""
    sep = _SPACE[buf]
    first, last = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
    first[1:] = np.r_[sep, True][:-1] if len(buf) else False
    first[off[:-1]] = True
    last[:-1] = np.r_[sep[1:], True] if len(buf) else False
    last[off[1:] - 1] = True
    start = np.flatnonzero(first[:len(buf)] & ~sep)
    end = np.flatnonzero(last[:len(buf)] & ~sep) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def _pow(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        p[0] = 1
        have = np.cumprod(p, dtype=np.uint64)
        if n <= 2 * SLICE_BYTES + 8192:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    n = len(buf)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _pow(n, MUL), out=s[1:])
    return mixed((s[end] - s[start]) * _pow(n + 1, _INV)[start] + (end - start).astype(np.uint64))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word that ``words`` gave.  Distinct words are told apart by their bytes and hashed by SipHash, so that no
    arithmetic makes two different words collide (as it does for a polynomial modulo 2^64)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    coded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(buf[~_SPACE[buf]])]).dictionary_encode()
    distinct = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False)
    return distinct[coded.indices.to_numpy(zero_copy_only=False)]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive items (k fewer one at the end)."""
    m = max(0, len(h) - k + 1)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(MUL) + h[j:j + m])
    return out
