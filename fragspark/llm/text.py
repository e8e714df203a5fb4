"""Byte-level text kernels on numpy: word splitting, polynomial hashes, sorted-key coding.

All kernels see a batch of documents as one byte buffer with document offsets,
so the cost per byte is a few vectorised passes and no Python object is made per
word. Words are maximal runs of bytes other than space and 0x09-0x0D; bytes of
multi-byte UTF-8 characters are never in that set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.Generator(np.random.PCG64(20240501))
BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: For a second hash that shares nothing with the first.
OTHER_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
CHUNK = 1 << 18

_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = str(int(base))
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 4096)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        np.cumprod(out, out=out)
        have = _powers[key] = out
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply and xor-shift rounds)."""
    x = x ^ U64(seed)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls become empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = pc.fill_null(array, b"")
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = array.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def split_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of the first word of each document (n_docs + 1 values)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray = BYTE_KEYS) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends), which must be sorted by start."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + CHUNK)))
        high = int(ends[i:j].max())
        size = high - low
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(keys[buf[low:high]] * powers(BASE, size), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * powers(BASE_INV, size + 1)[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def fold(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``width`` consecutive values, by doubling."""
    base &= (1 << 64) - 1
    out, have = None, 0
    part, size = hashes, 1
    left = width
    while left:
        if left & 1:
            if out is None:
                out, have = part, size
            else:
                n = min(len(out) - size, len(part))
                out = part[: max(n, 0)] * U64(pow(base, have, 2**64)) + out[size : size + max(n, 0)]
                have += size
        left >>= 1
        if left:
            part = part[: max(len(part) - size, 0)] * U64(pow(base, size, 2**64)) + part[size:]
            size *= 2
    return out


def windows_inside(firsts: np.ndarray, width: int) -> np.ndarray:
    """Starts (item numbers) of all windows of ``width`` items that lie inside one document."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = firsts[:-1] - (np.cumsum(counts) - counts)
    return np.arange(total) + np.repeat(shift, counts)


def pack_sorted(values: np.ndarray) -> bytes:
    """Rice-codes a non-decreasing array of uint64: remainders of whole bytes, quotients in unary."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=U64(0)).astype(np.uint64)
    first, gaps = gaps[0], gaps.copy()
    gaps[0] = 0
    mean = float(values[-1] - values[0]) / n
    k = 0
    while k < 7 and mean >= 4096.0 * 256.0 ** (k - 1):
        k += 1
    quotients = gaps >> U64(8 * k)
    stops = np.cumsum(quotients + U64(1)) - U64(1)
    bits = np.zeros(int(stops[-1]) + 1, dtype=bool)
    bits[stops.astype(np.int64)] = True
    planes = [(gaps >> U64(8 * i)).astype(np.uint8) for i in range(k)]
    head = np.array([n, first, k], dtype=np.uint64)
    return b"".join([head.tobytes(), *(p.tobytes() for p in planes), np.packbits(bits).tobytes()])


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, first, k = (int(x) for x in np.frombuffer(data, np.uint64, 3))
    planes = np.frombuffer(data, np.uint8, n * k, 24).reshape(k, n)
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=24 + n * k)))[:n]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << U64(8 * k)
    for i in range(k):
        gaps |= planes[i].astype(np.uint64) << U64(8 * i)
    gaps[0] = first
    return np.cumsum(gaps)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]
