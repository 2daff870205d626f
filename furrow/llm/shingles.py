"""Word and shingle hashes of whole Arrow batches of texts, without a Python object for a word.

Words are runs of bytes other than the six ASCII spaces, A-Z lower-cased. Each has a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer word is taken whole.
PIECE = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    return mix((lower + np.uint64(1)) * BASE)


VALUES = byte_values()


class Powers:
    """Powers of the odd base and of its inverse modulo 2^64, as many as a piece needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            cls.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, BASE))])
            cls.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, inverse))])
        return cls.up, cls.down


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each word; words are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + PIECE, "right")))
        piece = data[first : ends[j - 1]]
        up, down = Powers.reach(max(PIECE, len(piece)) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(VALUES[piece] * up[: len(piece)], out=sums[1:])
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def spans(texts: pa.Array, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For an array of strings without nulls: its bytes, where each run of bytes of `member` starts and ends, and the first run's number of each text, and last the number of runs."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = member[data]
    bounds = np.zeros(len(data) + 1, bool)
    bounds[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | bounds[:-1]))
    ends = np.flatnonzero(inside & (~after | bounds[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For an array of strings without nulls: each word's hash, and the first word's number of each text, and last the number of words."""
    data, starts, ends, first = spans(texts, ~SPACE)
    return hash_words(data, starts, ends), first


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most that many bytes of text, or one row; nulls are left as they are."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of k-word shingles as sorted hashes, one after the other, and where each begins. A text of fewer words has its whole sequence as one, an empty one none."""
    hashes, first = words(pc.fill_null(texts, ""))
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes)) - first[rows]
    whole = place <= n[rows] - k
    at = np.flatnonzero(whole)
    turn = mix((np.arange(k, dtype=np.uint64) + np.uint64(1)) * BASE) | np.uint64(1)
    grams = np.full(len(at), np.uint64(k * int(BASE) % (1 << 64)))
    for j in range(k):
        grams += hashes[at + j] * turn[j]
    owner = rows[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        more = n[short].astype(np.uint64) * BASE
        for j in range(k - 1):
            has = n[short] > j
            more[has] += hashes[first[short[has]] + j] * turn[j]
        grams, owner = np.concatenate([grams, more]), np.concatenate([owner, short])
    grams = mix(grams)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(n) + 1))


def set_keys(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set (sums of two hashes of its members)."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams ^ np.uint64(salt)), out=sums[1:])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]
