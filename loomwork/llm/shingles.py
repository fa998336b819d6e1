"""Words and five-word shingles as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

WIDTH = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers, one for each place in a shingle, from a fixed seed.
_PLACE = np.random.default_rng(20240917).integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z in lower case, split at space and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which neighbours look unrelated."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes.

    A text of fewer than five words has its whole sequence as one shingle; a
    text without words has none.
    """
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < WIDTH:
        return np.array([xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        total += hashes[k : k + n] * _PLACE[k]
    return np.unique(mixed(total))


def set_name(shingles: np.ndarray) -> bytes:
    """16 bytes that are equal for equal sets."""
    with np.errstate(over="ignore"):
        one = mixed(shingles + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
        two = mixed(shingles ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return np.array([one, two ^ np.uint64(len(shingles))], "<u8").tobytes()
