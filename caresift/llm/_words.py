"""Words, shingles and tokenizer pieces of many texts at once, as numpy arrays.

A run of symbols is hashed from prefix sums of a polynomial over 64-bit words: the sum between two positions, divided by
the power at the first, depends on the run alone.  Long runs are hashed with blake2b instead, as such polynomials have
known clashes there.
"""

from __future__ import annotations

import functools
from hashlib import blake2b

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 5
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, U), np.empty(n, U)
    up[0] = down[0] = 1
    for table, step in ((up, BASE), (down, pow(BASE, -1, 1 << 64))):
        done = 1
        while done < n:
            take = min(done, n - done)
            table[done : done + take] = table[:take] * U(pow(step, done, 1 << 64))
            done += take
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(19, int(n).bit_length()))


@functools.lru_cache(1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U))


def runs_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray, raw) -> np.ndarray:
    """A 64-bit hash of each run ``values[first:last]``; ``raw(i)`` is the i-th run as bytes, asked for long runs only."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    out = mix((total[last] - total[first]) * down[first] + (last - first).astype(U))
    for i in np.flatnonzero(last - first > LONG):
        out[i] = int.from_bytes(blake2b(raw(i), digest_size=8).digest(), "little")
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def words(body: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes outside blank and 9 to 13.  Each word's hash, first byte and end, and each text's word range."""
    body = LOWER[body] if lower else body
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = ~BLANK[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[at] = True
    here, before = inside[1:], inside[:-1]
    first = np.flatnonzero(here & (~before | edge))
    last = np.flatnonzero(before & (~here | edge))
    hashed = runs_hash(byte_values()[body], first, last, lambda i: body[first[i] : last[i]].tobytes())
    return hashed, first, last, np.searchsorted(first, at)


def shingles(hashed: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs of each text (a shorter text is one run; no words, no runs), and each text's range."""
    n = len(hashed)
    count = np.diff(bounds)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    where = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=where[1:])
    start = np.repeat(bounds[:-1] - where[:-1], made) + np.arange(where[-1])
    size = np.repeat(np.minimum(count, k), made)
    out = mix(size.astype(U) + U(0x5851F42D4C957F2D))
    for j in range(k):
        own = j < size
        out = np.where(own, mix(out * U(3) + hashed[np.minimum(start + j, max(n - 1, 0))]) if n else out, out)
    return out, where


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """For each code point: 0 letter, 1 number, 2 white space, 3 other."""
    import regex

    out = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in enumerate((r"\p{L}+", r"\p{N}+", r"\s+")):
        for run in regex.finditer(pattern, every):
            a, b = ord(run[0][0]), ord(run[0][-1])
            out[a : b + 1] = kind
    return out


ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def pieces(body: np.ndarray, at: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The matches of ``public_tokenizers.PATTERN`` in each text.

    Returns the joined text, each piece's hash, first code point and end, and each text's range of pieces.
    """
    joined = body.tobytes().decode("utf-8")
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    heads = np.zeros(len(body) + 1, np.int64)
    np.cumsum((body & 0xC0) != 0x80, out=heads[1:])
    at = heads[at]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    if not n:
        none = np.empty(0, np.int64)
        return joined, np.empty(0, U), none, none, np.zeros(len(at), np.int64)
    kind = classes()[points]
    turn = edge.copy()
    turn[1:n] |= kind[1:] != kind[:-1]
    start = turn[:n].copy()
    # a run of white space before a symbol of the same text leaves its last sign: a blank joins what follows, others stand alone
    follow = np.flatnonzero(turn[:n] & ~edge[:n] & (kind != 2))
    follow = follow[kind[follow - 1] == 2] if len(follow) else follow
    start[follow - 1] = True
    start[follow[points[follow - 1] == 32]] = False
    # 's 't 're 've 'm 'll 'd where a piece starts with the quote
    for i in np.flatnonzero((points == 39) & start[:n]):
        for ending in ENDINGS:
            if joined.startswith(ending, i + 1) and not edge[i + 1 : i + 1 + len(ending)].any():
                start[i + 1] = False
                if i + 1 + len(ending) < n:
                    start[i + 1 + len(ending)] = True
                break
    first = np.flatnonzero(start)
    last = np.append(first[1:], n)
    hashed = runs_hash(mix(points.astype(U) + U(1)), first, last, lambda i: joined[first[i] : last[i]].encode())
    return joined, hashed, first, last, np.searchsorted(first, at)
