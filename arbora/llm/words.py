"""Words and word shingles of many texts at once, as 64-bit hashes made with NumPy from the texts' UTF-8 bytes.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Hashes stand for
words and shingles; two different ones of a corpus of a billion meet with a probability of about 1 in 40.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
LONG = 4096
#: Primes below 2^32 and a base for each.
_FIELDS = [(4294967291, 2654435769), (4294967279, 3266489917)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; another seed gives another function."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, prime: int, base: int) -> np.ndarray:
    p = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        p[done : done + more] = p[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return p


_POWERS = [_powers(LONG, prime, base) for prime, base in _FIELDS]


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the first byte, place after the last byte) of each word of the texts raw[at[i]:at[i + 1]], in order."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACES[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(first):
        return np.zeros(0, np.uint64), first, last
    own = raw[inside]
    if lower:
        own = _LOWER[own]
    size = last - first
    start = np.cumsum(size) - size
    within = np.arange(len(own)) - np.repeat(start, size)
    value, within = own.astype(np.uint64) + np.uint64(1), np.minimum(within, LONG - 1)
    # LONG terms below 2^41 stay below 2^64
    a, b = (np.add.reduceat(value * up[within], start) % np.uint64(prime) for up, (prime, _) in zip(_POWERS, _FIELDS))
    h = a << np.uint64(32) | b
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(own[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h + size.astype(np.uint64) * _ODD[1]), first, last


def per_text(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each text's words begin and end among all words: n + 1 numbers."""
    return np.searchsorted(first, at)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of k words; with short, fewer words than k make one shingle of the whole sequence."""
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    total = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _ODD[i % 5] if len(total) else total
        if i % 5 == 4:
            total = mix(total, i)
    ok = text[: len(total)] == text[k - 1 :] if len(total) else np.zeros(0, bool)
    out, of = mix(total[ok], k), text[: len(total)][ok]
    few = np.flatnonzero((n > 0) & (n < k)) if short else np.zeros(0, np.int64)
    if len(few):
        whole = np.array([_sequence(h[bounds[i] : bounds[i + 1]]) for i in few], np.uint64)
        out, of = np.concatenate([out, whole]), np.concatenate([of, few])
    return out, of


def _sequence(h: np.ndarray) -> np.uint64:
    x = np.zeros(1, np.uint64)
    for one in h:
        x = mix(x * _ODD[2] + one, len(h))
    return x[0]


def distinct(h: np.ndarray, of: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, one text after another, and the n_texts + 1 places where they begin and end."""
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[keep], of[keep]
    return h, np.searchsorted(of, np.arange(n_texts + 1))
