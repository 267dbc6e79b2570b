"""Word and shingle hashes in vectorised numpy.

Words are what a boolean table of separator bytes leaves, A-Z lower-cased;
a shingle is five words in a row, or all words of a shorter text.  Hashes have
64 bits, so two different shingles of even 10^9 texts collide with a chance
that a verification on words (``jaccard``) removes where it would matter.
"""

from __future__ import annotations

import numpy as np

WORDS_PER_SHINGLE = 5
SEGMENT = 1 << 19              # bytes hashed at once, which bounds the memory
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, SEGMENT + 1), _BASE if kind == "up" else _UNBASE, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def _hash_segment(data: np.ndarray, separators: np.ndarray) -> np.ndarray:
    data = FOLD[data]
    inside = ~separators[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=sums[1:])
    return _mix((sums[last] - sums[first]) * _power("down", len(data))[first])


def word_hashes(text: bytes, separators: np.ndarray = SPACE) -> np.ndarray:
    """One hash per word of ``text``, in order."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= SEGMENT:
        return _hash_segment(data, separators)
    gaps = np.flatnonzero(separators[data])
    out, at = [], 0
    while at < len(data):
        to = len(data)
        if to - at > SEGMENT:                  # cut at the last gap that fits, else at the next one
            i = np.searchsorted(gaps, at + SEGMENT, side="right")
            if i and gaps[i - 1] > at:
                to = int(gaps[i - 1])
            elif i < len(gaps):
                to = int(gaps[i])
        out.append(_hash_segment(data[at:to], separators))
        at = to
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """One hash per shingle, repeats included."""
    n = len(words)
    if n == 0:
        return words
    width, places = min(n, k), _PLACES
    out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out += words[i:n - width + 1 + i] * places[i]
    return _mix(out)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (null: none)."""
    return np.unique(shingle_hashes(word_hashes(text))) if text else np.zeros(0, np.uint64)


def fold_words(text: bytes) -> list[bytes]:
    """The words themselves (``bytes.lower`` and ``bytes.split`` are ASCII-only)."""
    return text.lower().split()


def words_in_common(a: bytes, b: bytes, k: int = WORDS_PER_SHINGLE) -> tuple[int, int]:
    """Size of the intersection and of the union of two texts' shingle sets,
    compared word by word."""
    sets = []
    for text in (a, b):
        words = fold_words(text)
        width = min(len(words), k)
        sets.append({tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set())
    both = len(sets[0] & sets[1])
    return both, len(sets[0]) + len(sets[1]) - both
