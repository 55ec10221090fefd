"""Vectorised term hashing and bit voting for SimHash fingerprints (NumPy, one document at a time)."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: splitmix64's multipliers
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
_BLOCK = 1 << 16
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept between calls up to the longest text of the worker so far."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((salt * _BASE) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word (run of bytes other than ASCII white space) in order."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    inside = np.concatenate(([False], ~_IS_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)), out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * _power(_INVERSE, len(raw))[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; fewer words make one shingle of them all, none make none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(_BASE) + words[k : k + len(out)])
    return out


def xxh64_shingles(data: bytes, size: int, seed: int = 42) -> list[np.ndarray]:
    """XXH64 of every space-joined run of ``size`` words of the lower-cased (A-Z) text, in blocks."""
    words = data.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    out, digest = [], xxhash.xxh64_intdigest
    for at in range(0, len(words) - size + 1, _BLOCK):
        to = min(at + _BLOCK, len(words) - size + 1)
        pairs = zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist())
        out.append(np.fromiter((digest(joined[a:b], seed) for a, b in pairs), dtype=np.uint64, count=to - at))
    return out


def vote(hashes: list[np.ndarray], words: int = 1, weights: np.ndarray | None = None) -> list[int]:
    """Sign of each bit's vote as ``words`` unsigned 64-bit integers; a tie and an empty list give 0.

    With one word the hashes' own bits vote, with more each word takes another mix of them.
    weights, if given, belong to a single block.
    """
    total, count = np.zeros((words * 8, 256)), 0.0
    for block in hashes:
        if not len(block):
            continue
        wide = block[:, None] if words == 1 else np.stack([mix(block, k + 1) for k in range(words)], axis=1)
        flat = np.ascontiguousarray(wide.astype(">u8")).view(np.uint8).reshape(len(block), words * 8)
        at = flat.astype(np.intp) + np.arange(words * 8) * 256
        w = None if weights is None else np.repeat(weights, words * 8)
        total += np.bincount(at.ravel(), weights=w, minlength=words * 2048).reshape(words * 8, 256)
        count += len(block) if weights is None else float(weights.sum())
    ones = (total @ _BITS_OF_BYTE).ravel()
    packed = np.packbits(2 * ones > count).tobytes() if count else bytes(words * 8)
    return [int.from_bytes(packed[8 * k : 8 * k + 8], "big") for k in range(words)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
