"""Shared helpers: row identity, byte-level word hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.scratch import discard, materialize, sweep  # noqa: F401  used by the operators

#: ASCII white space: space, tab, line feed, vertical tab, form feed, return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def row_key(*cols: Column) -> list[Column]:
    """96 bits that identify a row by its content: columns ``k1`` and ``k2``.

    Rows equal in all the given columns share a key; a null is not an empty
    string.
    """
    safe = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*safe).alias("k1"), F.hash(*safe).alias("k2")]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast path of ``lower``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


# --- bytes of an Arrow string column -------------------------------------------------


def arrow_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string array; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if n == 0 or arr.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def tidy(run):
    """A batch function that hands freed memory back when its task ends: workers are used again by later stages."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def byte_slices(off: np.ndarray, limit: int = 1 << 20):
    """Row ranges of at most ``limit`` bytes each (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_RNG = np.random.default_rng(20240607)
#: A random 64-bit value for each byte.
BYTE_MIX = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _inverse(b: np.uint64) -> np.uint64:
    return np.uint64(pow(int(b), -1, 1 << 64))


#: Powers are kept up to this exponent; longer runs make their own each time.
KEPT = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if n <= KEPT:
            _POWERS[int(base)] = have
    return have[:n]


def finish(h: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words(data: np.ndarray, off: np.ndarray, lut: np.ndarray, piece: int = KEPT // 2):
    """Words of concatenated texts.

    ``lut`` maps a byte to 0 (separator) or to the byte it counts as. Returns
    (start, end, text index, hash) of each word; no word spans two texts. Long
    buffers are read in pieces that end where a word does, so that memory beside
    the words is that of a piece (or of the longest word).
    """
    if len(data) <= piece:
        return _words(data, off, lut)
    parts, at = [], 0
    while at < len(data):
        to, ahead = min(at + piece, len(data)), piece
        while to < len(data):
            gap = np.flatnonzero(lut[data[to : to + ahead]] == 0)
            edge = int(np.searchsorted(off, to))  # a text's end is a word's end too
            to = min(to + int(gap[0]) if len(gap) else to + ahead, int(off[edge]), len(data))
            if len(gap) or to == off[edge]:
                break
        lo = int(np.searchsorted(off, at, side="right")) - 1
        hi = int(np.searchsorted(off, to, side="left"))
        s, e, doc, h = _words(data[at:to], np.clip(off[lo : hi + 1], at, to) - at, lut)
        parts.append((s + at, e + at, doc + lo, h))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _words(data: np.ndarray, off: np.ndarray, lut: np.ndarray):
    low = lut[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = off[:-1][off[:-1] < off[1:]]
    first[begin] = inside[begin]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:][off[:-1] < off[1:]] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_MIX[low] * powers(_B1, n), out=total[1:])
    h = finish((total[e] - total[s]) * powers(_inverse(_B1), n + 1)[s] + (e - s).astype(np.uint64))
    return s, e, np.searchsorted(off, s, side="right") - 1, h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (runs cross texts)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(_B2, n), out=total[1:])
    return finish((total[k:] - total[:-k]) * powers(_inverse(_B2), n + 1)[: n - k + 1] + np.uint64(k))
