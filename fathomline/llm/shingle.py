"""Shingles of words and their minhash bands."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash

WORDS = re.compile(r"\w+|[^\w\s]")


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that sums of word hashes spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(200_000)
def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def shingles(code: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words or signs; a shorter text is one run."""
    w = np.fromiter(map(word_hash, WORDS.findall(code)), np.uint64)
    if not len(w):
        return np.zeros(0, np.int64)
    runs = max(1, len(w) - words + 1)
    with np.errstate(over="ignore"):
        at = np.zeros(runs, np.uint64)
        for i in range(min(words, len(w))):
            at = mixed(at * np.uint64(0x9E3779B97F4A7C15) + w[i : i + runs])
    return np.unique(at.view(np.int64))


@lru_cache(8)
def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(1, 2**63, (count, 1), dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, (count, 1), dtype=np.uint64)


def band_keys(words: list[list[str]], bands: int, rows: int, size: int = 5, most: int = 200_000) -> list[list[int]]:
    """Minhash keys, `bands` a text, over shingles of `size` words; a shorter text is one shingle, one without words none."""
    out: list[list[int]] = [[] for _ in words]
    run, held = [], 0
    for i, w in enumerate(words):
        if w:
            run.append(i)
            held += len(w)
        if run and (held >= most or i == len(words) - 1):  # some `most` words at once, whatever the texts' lengths
            for j, keys in zip(run, _band_keys([words[j] for j in run], bands, rows, size).tolist(), strict=True):
                out[j] = keys
            run, held = [], 0
    return out


def _band_keys(words: list[list[str]], bands: int, rows: int, size: int) -> np.ndarray:
    """The words of all texts lie in one array, so that each permutation is one pass."""
    counts = np.array([len(w) for w in words])
    first = np.cumsum(counts) - counts
    flat = np.fromiter((word_hash(x) for w in words for x in w), np.uint64, int(counts.sum()))
    padded = np.concatenate([flat, np.zeros(size, np.uint64)])
    left = np.repeat(first + counts, counts) - np.arange(len(flat))  # words from here to the text's end
    with np.errstate(over="ignore"):
        at = np.zeros(len(flat), np.uint64)
        for i in range(size):
            at = np.where(left > i, mixed(at * np.uint64(0x9E3779B97F4A7C15) + padded[i : i + len(flat)]), at)
        # a start too near the end makes no shingle of its own, unless the text is shorter than one
        short = (left < size) & (np.repeat(counts, counts) >= size)
        short |= (np.repeat(counts, counts) < size) & (left < np.repeat(counts, counts))
        a, b = permutations(bands * rows)
        keys = np.zeros((len(words), bands), np.uint64)
        for band in range(bands):
            key = np.full(len(words), np.uint64(band + 1))
            for i in range(band * rows, (band + 1) * rows):
                seen = (at * a[i] + b[i]) >> np.uint64(16)
                seen[short] = np.uint64(2**63)
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(seen, first))
            keys[:, band] = key
    return keys.view(np.int64)
