"""Vectorised text kernels used inside Arrow-batched Spark tasks.

Texts of a batch are laid end to end as bytes, so words and their hashes come from a few numpy passes instead of
a Python loop per word. Hashes are 64-bit and depend on content only, so they agree across tasks and retries.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A slice of a batch holds this many bytes of text, or one longer text.
SLICE_BYTES = 1 << 20
#: The same where several arrays of eight bytes for each byte of text are held: they fit the cache, and workers stay small.
SMALL_SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x + U64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64))
_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE_BYTES + (1 << 16)), base, dtype=U64)
        full[0] = 1
        have = np.cumprod(full, dtype=U64)
        if n <= SLICE_BYTES + (1 << 16):
            _POW[base] = have
    return have[:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span follows; see ``span_hash``."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Content hash of each span [start, end)."""
    inv = powers(BASE_INV, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(U64))


class Texts:
    """Texts of one slice laid end to end, each followed by a line feed."""

    def __init__(self, blobs: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b"\n".join([*blobs, b""]), np.uint8)
        if lower:
            self.data = LOWER[self.data]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
        self.end = self.start + sizes

    def words(self, separator: np.ndarray = SEPARATOR) -> None:
        """Find maximal runs of non-separator bytes: word_start, word_end, word_hash, word_off (per text)."""
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = ~separator[self.data]
        step = np.diff(inside)
        self.word_start = np.flatnonzero(step == 1)
        self.word_end = np.flatnonzero(step == -1)
        self.prefix = rolling(self.data)
        self.word_hash = span_hash(self.prefix, self.word_start, self.word_end)
        self.word_off = np.concatenate([np.searchsorted(self.word_start, self.start), [len(self.word_start)]])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words starting at each word; the last n-1 entries of a text reach into the next text."""
        h = self.word_hash
        out = np.zeros(len(h), U64)
        mult = powers(0xD6E8FEB86659FD93, n + 1)[1:]
        for j in range(min(n, len(h))):
            out[: len(h) - j] += h[j:] * mult[j]
        return mix(out)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 0) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into slices of about ``size`` (``SLICE_BYTES``) of text; a null text is empty."""
    size = size or SLICE_BYTES
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        blobs = [b or b"" for b in column.cast(pa.binary()).to_pylist()]
        at = used = 0
        for k, b in enumerate(blobs):
            if used and used + len(b) > size:
                yield batch.slice(at, k - at), blobs[at:k]
                at, used = k, 0
            used += len(b) + 1
        if at < len(blobs):
            yield batch.slice(at), blobs[at:]
    batch = column = blobs = b = None
    release()


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values and its length."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return first, np.diff(np.concatenate([first, [len(sorted_values)]]))


def split_by(part: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple]:
    """Yield (p, rows of each array whose part is p), for parts that have rows."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(n + 1))
    arrays = [a[order] for a in arrays]
    for p in range(n):
        a, b = bounds[p], bounds[p + 1]
        if a < b:
            yield (p, *[x[a:b] for x in arrays])


def range_of(h: np.ndarray, n: int) -> np.ndarray:
    """Even range of a 64-bit hash among n, by its high half."""
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def long_of(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
