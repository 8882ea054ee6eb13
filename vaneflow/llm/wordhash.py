"""Word hashes of many texts at once, on their bytes, with numpy.

Texts are laid end to end; words are runs of bytes that a table marks as word bytes.  A word's hash is a
polynomial over a fixed random value per byte, modulo 2^64, taken from one running sum for all words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at a time.
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit values that scatters all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=np.uint64) * _BASE)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def space_words() -> np.ndarray:
    """True for the bytes of a word where words are cut at ASCII white space only."""
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def letter_words() -> np.ndarray:
    """True for ASCII letters and digits and for all bytes of non-ASCII characters."""
    table = np.zeros(256, dtype=bool)
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return table


def hash_words(texts: list[bytes], word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and where each text's words begin (one entry more than texts)."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    inside = word_bytes[data]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    begin, end = edges[::2], edges[1::2]
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    value = _byte_values()[data]
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value * up[: len(data)], dtype=np.uint64)])
    hashes = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(begin, starts)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return seeds(256, start=1_000)[lower_table()]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words (of the whole sequence, if it is shorter; none without words)."""
    k = min(k, len(words))
    if k == 0:
        return words
    n = len(words) - k + 1
    out = words[:n].copy()
    for t in range(1, k):
        out = out * _BASE + words[t : t + n]
    return mix(out + np.uint64(k))


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `most` bytes together, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def each_words(texts: list[str | None], word_bytes: np.ndarray) -> Iterator[np.ndarray]:
    """The word hashes of one text after the other."""
    encoded = [(t or "").encode("utf-8", "replace") for t in texts]
    for a, b in chunks(encoded):
        words, at = hash_words(encoded[a:b], word_bytes)
        for i in range(b - a):
            yield words[at[i] : at[i + 1]]
