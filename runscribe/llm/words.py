"""Words of a text, and hashes of words and of runs of words, as numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: A word is a maximal run of bytes other than space and \t..\r; ``bytes.split`` cuts at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; null and blank texts have none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


_INVERSE = pow(_BASE, -1, 1 << 64)


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = sum of hashes[t] * base**t over i <= t < j; hashes are mixed first."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes) * powers(len(hashes)), out=out[1:])
    return out


def run_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run [start, end) that depends on its words and length only."""
    back = np.full(len(prefix), _INVERSE, np.uint64)
    if len(back):
        back[0] = 1
    back = np.multiply.accumulate(back)
    return mix((prefix[ends] - prefix[starts]) * back[starts] + mix((ends - starts).astype(np.uint64)))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, in order; none when there are fewer than k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, out = mix(hashes), np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += h[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    if width < w:
        out = np.minimum(out[: len(out) - (w - width)], out[w - width :])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Spark's long holds the same 64 bits."""
    return x.view(np.int64)
