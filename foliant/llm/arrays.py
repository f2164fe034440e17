"""Texts of an Arrow batch as flat numpy arrays: words, word hashes, window hashes.

Hashes are 64-bit and polynomial: the hash of a run is a difference of prefix
sums times the inverse power of its start, so every window of any length costs
the same.  ``mix`` spreads the result over all bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = pow(0x9E3779B97F4A7C15, 3, 1 << 64) | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PART = 2 << 20  # bytes of text worked on at once (a longer text is worked on alone)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``symbols[s:e]`` for each pair."""
    p, q = powers(len(symbols) + 1)
    sums = np.empty(len(symbols) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(symbols * p[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (UTF-8) or binary values and their offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    else:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offs[0]: offs[-1]], offs - offs[0]


def parts(offs: np.ndarray, size: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of non-space bytes) and, per text, the index of its first word."""
    return tokens(~SPACE[data], offs)


def tokens(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(inside)
    first = np.ones(n + 1, bool)
    first[1:n] = ~inside[:-1]
    last = np.ones(n + 1, bool)
    last[: n - 1 if n else 0] = ~inside[1:]
    first[offs] = True
    last[offs[1:][offs[1:] > 0] - 1] = True
    s = np.flatnonzero(inside & first[:n])
    e = np.flatnonzero(inside & last[:n]) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the words, in stretches of about 4 MB: a very long text needs no tables of its length."""
    out, i = [np.zeros(0, np.uint64)], 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + (4 << 20), "right")))
        out.append(run_hashes(BYTES[data[s[i]: e[j - 1]]], s[i:j] - s[i], e[i:j] - s[i]))
        i = j
    return np.concatenate(out)


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """For each item, the text it belongs to (``bounds``: first item of each text, then the end)."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Indices at which a run of ``width`` items stays within its text."""
    ok = np.zeros(bounds[-1] + 1 if len(bounds) else 1, np.int32)
    has = np.diff(bounds) >= width
    np.add.at(ok, bounds[:-1][has], 1)
    np.add.at(ok, (bounds[1:] - width + 1)[has], -1)
    return np.flatnonzero(np.cumsum(ok[:-1]))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours (length shrinks by width - 1)."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = np.minimum(a[:-step], a[step:])
        have += step
    return a


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions inside any of the spans."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def large(schema: pa.Schema, rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def giving_back(run: Callable) -> Callable:
    """The batch function ``run``, after which a worker returns freed memory to the system: it outlives its tasks."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped
