"""Word shingles as 64-bit hashes, and MinHash signatures over them (numpy, batch at a time)."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_CACHE_MAX = 400_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_MAX:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles.

    Words are runs of bytes other than space and \\t..\\r, with A-Z lower-cased: just what
    ``bytes.lower().split()`` yields on UTF-8.  Fewer words than ``width`` make one shingle; none, none.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    if n < width:
        total = np.full(1, n, dtype=np.uint64)
        for k in range(n):
            total = total * _MULT[0] + _mix(h[k : k + 1] + _MULT[k % 5])
        return _mix(total)
    m = n - width + 1
    s = np.full(m, np.uint64(width))
    for k in range(width):
        s = s * _MULT[0] + _mix(h[k : k + m] + _MULT[k % 5])
    return np.unique(_mix(s))


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a shingle set, as two signed longs."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def hash_family(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)), rng.integers(0, 2**32, n, dtype=np.uint32)


def signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """len(sets) x len(a) minima of a*x+b mod 2**32; all sets must have members. Works in cache-sized blocks."""
    out = np.full((len(sets), len(a)), 0xFFFFFFFF, dtype=np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= block):
            size += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        for lo in range(0, len(x), block):  # only a set larger than a block takes more than one turn
            part = x[lo : lo + block]
            at = starts if len(x) <= block else np.zeros(1, dtype=np.int64)
            buf = np.empty_like(part)
            for k in range(len(a)):
                np.multiply(part, a[k], out=buf)
                np.add(buf, b[k], out=buf)
                got = np.minimum.reduceat(buf, at)
                np.minimum(out[i:j, k], got, out=out[i:j, k])
        i = j
    return out
