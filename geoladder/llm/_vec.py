"""Vectorised text kernels on byte buffers: word bounds, rolling hashes, sliding minima.

Texts of a batch lie one after another in one uint8 array; ``bounds`` (n + 1 offsets) says where each begins. Nothing
here makes a Python object per word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
#: Modulus and the two bases of rolling hashes. A power of two as modulus would let texts that repeat themselves by halves
#: (the Thue-Morse word and its complement) collide whatever the base is; a prime does not.
PRIME = (1 << 31) - 1
BASES = (1_481_765_933, 873_911_279)
#: `[\x20\x09-\x0D]`, the white space of all word counts here.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Upper-case A-Z to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on at once (a longer text is worked on alone).
CHUNK = 3 << 20

#: Stretches up to this length are hashed lane by lane; longer ones one by one.
LONG = 512
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], U)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.ones(max(n, CHUNK + 1), np.uint32)
        done = 1
        while done < len(x):
            step = min(done, len(x) - done)
            x[done : done + step] = x[:step].astype(U) * U(pow(base, done, PRIME)) % U(PRIME)
            done += step
        _powers[base] = x
    return _powers[base][:n]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place; x < 2**63."""
    for _ in range(2):
        high = x >> U(31)
        x &= U(PRIME)
        x += high
    x -= (x >= U(PRIME)).astype(U) * U(PRIME)
    return x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Rolling:
    """Hashes of any stretch of a buffer, from prefix sums: two polynomials modulo a prime, 62 bits in all."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.parts = []
        for base in BASES:
            x = buf.astype(U)
            x += U(1)
            x *= powers(base, n)
            if n >= 1 << 23:  # else the sums stay below 2**63 as they are
                _reduced(x)
            h = np.zeros(n + 1, U)
            np.cumsum(x, out=h[1:])
            self.parts.append((h, powers(pow(base, -1, PRIME), n + 1)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (end - start).astype(U)
        out *= U(0xD6E8FEB86659FD93)
        for (h, inverse), odd in zip(self.parts, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=True):
            x = _reduced(h[end] - h[start])
            x *= inverse[start]
            out += mix(_reduced(x) * U(odd))
        return mix(out)


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number (zeros behind the end)."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def stretch_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch: eight bytes at a time, mixed in turn. Stretches of one length up to eight bytes never
    collide."""
    lanes, n = _lanes(buf), end - start
    out = mix(n.astype(U) * U(0xD6E8FEB86659FD93) + U(0x2545F4914F6CDD1D))
    out = mix(out + (lanes[start] & _MASK[np.minimum(n, 8)]))
    left = np.flatnonzero((n > 8) & (n <= LONG))
    for at in range(8, LONG, 8):
        if not len(left):
            break
        out[left] = mix(out[left] * U(0x9E3779B97F4A7C15) + (lanes[start[left] + at] & _MASK[np.minimum(n[left] - at, 8)]))
        left = left[n[left] > at + 8]
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_stretches(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the ``n`` bytes of each pair of stretches are the same."""
    la, lb = _lanes(a), _lanes(b)
    out = ((la[a_start] ^ lb[b_start]) & _MASK[np.minimum(n, 8)]) == 0
    left = np.flatnonzero((n > 8) & (n <= LONG))
    for at in range(8, LONG, 8):
        if not len(left):
            break
        out[left] &= ((la[a_start[left] + at] ^ lb[b_start[left] + at]) & _MASK[np.minimum(n[left] - at, 8)]) == 0
        left = left[n[left] > at + 8]
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = np.array_equal(a[a_start[i] : a_start[i] + n[i]], b[b_start[i] : b_start[i] + n[i]])
    return out


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of an Arrow string or binary array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    _, offs, data = arr.buffers()
    bounds = np.frombuffer(offs, np.int64 if wide else np.int32, len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(buf: np.ndarray, bounds: np.ndarray, size: int = CHUNK):
    """(first row, row after the last, bytes, bounds) of runs of whole texts, each about ``size`` bytes at most."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, j, buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 numbers)."""
    inside = ~IS_SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = inside[bounds[1:][bounds[:-1] < bounds[1:]] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(buf: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and for each text the index of its first word (n + 1 numbers)."""
    starts, ends, first = words(buf, bounds)
    return stretch_hashes(LOWER[buf] if lower else buf, starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text (one of all words, if a text has fewer), and each text's first."""
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    at = first[:-1][doc] + (np.arange(begin[-1]) - begin[:-1][doc])
    out, left = np.zeros(len(at), U), first[1:][doc] - at
    for i in range(k):
        here = left > i
        out = np.where(here, mix(out * U(0x100000001B3) + hashes[np.minimum(at + i, max(len(hashes) - 1, 0))]), out) if len(hashes) else out
    return out, begin


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, in two passes over blocks."""
    n = len(x)
    if w <= 1 or n < w:
        return x if w <= 1 else x[:0]
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, for all i, in one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
