"""Words and their hashes from Arrow string columns, as numpy operations over whole batches.

A word is a maximal run of bytes outside a table of delimiters. Hashes are sums of a random value for
each byte times a power of an odd base, modulo 2**64; as the base has an inverse, the hash of every
span comes from one running sum. They depend on the span's bytes alone, not on batch or chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at a time, so that the arrays stay small; one longer text is one chunk.
CHUNK = 1 << 19
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B, 0xD6E8FEB86659FD93)
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words without ASCII punctuation.
PUNCT_SPACE = np.zeros(256, bool)
PUNCT_SPACE[[x for x in range(128) if not chr(x).isalnum()]] = True
_T = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=U)
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least."""
    have = _pow.get(base)
    if have is None or len(have[0]) < n:
        # What a chunk takes; for a longer text, twice as many as there were at least.
        n = max(CHUNK + 1, n) if have is None else max(n, 2 * len(have[0]))
        with np.errstate(over="ignore"):
            out = []
            for b in (base, pow(base, -1, 2**64)):
                p = np.full(n, b, U)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
        have = _pow[base] = tuple(out)
    return have


def sums(values: np.ndarray, base: int) -> np.ndarray:
    p = np.empty(len(values) + 1, U)
    p[0] = 0
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return mix((p[ends] - p[starts]) * powers(base, len(p))[1][starts])


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    _, off, data = arr.buffers()
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    off = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(arr: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets in them)."""
    data, off = buffers(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = WORD_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row its first word, with the count of all words last."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = ~space[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before &= ~edge[:n]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(w & ~before)
    return starts, np.flatnonzero(w & ~after) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(sums(_T[buf], BASES[0]), starts, ends, BASES[0])


def gram_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of the n words from each word on, for every word that has n - 1 after it in the array."""
    if len(words) < n:
        return np.zeros(0, U)
    p = sums(words, base)
    at = np.arange(len(words) - n + 1)
    return span_hash(p, at, at + n, base)


def rows_of(ptr: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
