"""Words, word hashes and shingle sets."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import TASK_TABLES

SHINGLE = 5
#: Words whose hashes a task keeps at most, and bytes of the longest.
CACHE_WORDS, CACHE_LONGEST = 60_000, 48
_known: dict[bytes, int] = {}
TASK_TABLES.append(_known)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    out = [_known.get(w) for w in words]
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                out[i] = h = xxhash.xxh3_64_intdigest(words[i])
                if len(_known) < CACHE_WORDS and len(words[i]) <= CACHE_LONGEST:
                    _known[words[i]] = h
    return np.array(out, np.uint64)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes, put together from runs of 1, 2, 4, ... words."""
    n = len(h) - k + 1
    out, done, power, length = None, 0, h, 1
    while done < k:
        if k & length:
            part = power[done : done + n]
            out = part if out is None else mix(out) + part
            done += length
        if done < k:
            power = mix(power[: len(power) - length]) + power[length:]
            length *= 2
    return mix(out)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct 63-bit shingle hashes, ascending: runs of 5 words of the text with A-Z in lower case, or all words if fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    return np.unique((run_hashes(word_hashes(words), min(SHINGLE, len(words))) >> np.uint64(1)).astype(np.int64))
