"""Word shingles as 64-bit hashes, for whole blocks of texts at a time.

Words are runs of bytes other than blanks and the control characters 9 to 13; A to Z count as a to z.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_BYTE = mix64(_FOLD + np.uint64(1) << np.uint64(8))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n-1, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n, 64), _BASE))))
    return _POWERS[:n]


def hash_runs(data: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of kept bytes (folded), and where each starts."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], keep.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    inside = np.arange(sizes.sum()) - np.repeat(first, sizes)
    return mix64(np.add.reduceat(_BYTE[data[keep]] * powers(int(sizes.max()))[inside], first)), starts


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the bounds of each text's words among them."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    hashes, starts = hash_runs(data, ~_SPACE[data])
    at = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return hashes, np.searchsorted(starts, at)


def shingle_sets(texts: Sequence[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of k words; of fewer words, the whole sequence's."""
    words, bounds = word_hashes(texts)
    factors = mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - k + 1)
    flat = np.zeros(n, np.uint64)
    for j in range(k):
        flat += words[j : j + n] * factors[j]
    flat = mix64(flat)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            hashes = np.sort(flat[a : b - k + 1])
            found.append(hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))])
        elif b > a:  # the length goes in, so that it is no part of a longer text's
            found.append(mix64(np.array([(words[a:b] * factors[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found
