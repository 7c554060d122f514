"""Hashes of words and of word shingles, over whole Arrow columns of text at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words of a shingle, and the length in bits of a set's parity signature.
WIDTH, BITS = 5, 512
_CHUNK = 1 << 22
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20_011))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | _U(1)
_LEN = _rng.integers(1, 1 << 63, WIDTH + 1, dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A to Z count as a to z
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_to(n: int):
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def text_chunks(column: pa.Array, size: int = _CHUNK):
    """Runs of rows with their bytes: (first row, byte offsets of the rows and of the end, bytes). Null counts as empty."""
    column = pa.array(column).cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


def bounds(off: np.ndarray, data: np.ndarray):
    """Where the words of a run of rows begin and end."""
    size = len(data)
    if not size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = ~_IS_SPACE[data]
    edge = np.zeros(size + 1, dtype=bool)  # a row begins here
    edge[off] = True
    begins = np.flatnonzero(word & np.concatenate(([True], ~word[:-1] | edge[1:size])))
    return begins, np.flatnonzero(word & np.concatenate((~word[1:] | edge[1:size], [True]))) + 1


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """Hashes of the words between these places."""
    size = len(data)
    up, down = _powers_to(size + 1)
    total = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:size], out=total[1:])
    return scramble((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def words(off: np.ndarray, data: np.ndarray):
    """Hashes of the words of a run of rows, and where each row's words begin among them (one more entry at the end)."""
    begins, ends = bounds(off, data)
    return hashes(data, begins, ends), np.searchsorted(begins, off)


def shingle_sets(column: pa.Array):
    """For each row the sorted distinct hashes of its shingles: WIDTH words each, all words as one where there are fewer, none without words."""
    for _, off, data in text_chunks(column):
        h, at = words(off, data)
        if len(h) >= WIDTH:
            m = len(h) - WIDTH + 1
            s = np.full(m, _LEN[WIDTH], dtype=np.uint64)
            for k in range(WIDTH):
                s += h[k : k + m] * _MUL[k]
            s = scramble(s)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= WIDTH:
                yield np.unique(s[a : b - WIDTH + 1])
            elif b > a:
                yield scramble(np.array([(h[a:b] * _MUL[: b - a]).sum(dtype=np.uint64)]) + _LEN[b - a])
            else:
                yield h[:0]


def set_key(s: np.ndarray) -> np.ndarray:
    """64 bits that stand for a set: equal sets have equal keys, different ones differ but for chance in 2**64."""
    return scramble(scramble(s * _U(_BASE)).sum(dtype=np.uint64, keepdims=True) + _U(len(s)))[0]


def min_hashes(s: np.ndarray) -> np.ndarray:
    """The first elements of a sorted set in four orders. Two sets share each of them with the chance of their similarity."""
    if not len(s):
        return s
    other = s * _MUL[0]
    return scramble(np.array([s[0], s[-1], other.min(), other.max()]) + np.arange(4, dtype=np.uint64))


def parity(s: np.ndarray) -> np.ndarray:
    """A signature of 64-bit words, at least BITS and at least two bits an element; each element flips one bit. Two sets differ in at least as many elements as their signatures do in bits."""
    size = max(BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else BITS
    odd = np.bincount((s >> _U(17)).astype(np.int64) & (size - 1), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def folded(signature: np.ndarray) -> np.ndarray:
    """The signature of the same set at BITS bits."""
    return np.bitwise_xor.reduce(signature.reshape(-1, BITS // 64), axis=0)
