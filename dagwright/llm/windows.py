"""Hashed word windows over chunks of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from dagwright.llm.common import kept_by_worker

#: An odd base, and its inverse modulo 2**64, for the rolling polynomial.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class WordHashes(dict):
    """Word to 64-bit hash; cleared when it holds LIMIT words, which only costs hashing them again."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i under n."""
    at = kept_by_worker("windows", "powers", dict)
    if len(at.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for key, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            at[key] = np.cumprod(p)
    return at["up"][:n], at["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of a 64-bit hash over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp: the hash of the k words from each position on, from prefix sums of a polynomial modulo 2**64."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * down[:n], out=sums[1:])
    return mixed((sums[k:] - sums[: n - k + 1]) * up[k - 1 : n])


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def split_words(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words (parted by ASCII white space) of each text, their number, and all their hashes in order."""
    hashes = kept_by_worker("windows", "word_hashes", WordHashes)
    words = [t.split() for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    out = np.empty(int(lens.sum()), np.uint64)
    at = 0
    for w in words:
        out[at : at + len(w)] = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
        at += len(w)
    return words, lens, out


def starts(lens: np.ndarray, k: int) -> np.ndarray:
    """Positions, over all documents one after another, at which a window of k words lies within one document."""
    ends = np.repeat(np.cumsum(lens), lens)
    return np.flatnonzero(np.arange(len(ends)) + k <= ends)


def bucket_edges(buckets: int) -> np.ndarray:
    """First hash of each of a power of two of equal ranges."""
    return np.arange(buckets, dtype=np.uint64) << np.uint64(64 - (buckets.bit_length() - 1)) if buckets > 1 else np.zeros(1, np.uint64)
