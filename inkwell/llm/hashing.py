"""Fingerprints of any stretch of a buffer, from running sums: polynomials modulo the prime 2**61 - 1 at two points.

Two stretches of up to n bytes that differ agree at both points with a chance of (n / 2**61)**2, whatever they are: as
the field is prime, words built against hashes modulo 2**64 (Thue-Morse words and the like) do not agree either.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
P = (1 << 61) - 1
POINTS = (0x0F1B5D3A96C7E481, 0x12D4A7C98B3E6F05)  # any two numbers under P
PART, WIDE = 1 << 19, 1 << 15  # starts in one sum; wider stretches are hashed one by one


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U(P)) + (x >> U(61))
    return np.where(x >= U(P), x - U(P), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b modulo P, of numbers under P: in halves of 31 bits, as 2**62 is 2 and 2**61 is 1."""
    a1, a0, b1, b0 = a >> U(31), a & U(0x7FFFFFFF), b >> U(31), b & U(0x7FFFFFFF)
    mid = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << U(1)) + (mid >> U(30)) + ((mid & U(0x3FFFFFFF)) << U(31)) + a0 * b0)


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n."""
    if (base, n) not in _powers:
        out, step = np.ones(1, U), base
        while len(out) <= n:
            out, step = np.concatenate([out, times(out, np.full(len(out), step, U))]), step * step % P
        _powers[base, n] = out[: n + 1].copy()
    return _powers[base, n]


def _sums(b: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Of each stretch the sum of (byte + 1) base**k, times base**PART, however far from the buffer's start it lies."""
    up = powers(base, PART + WIDE)
    x, p, value = b.astype(U) + U(1), up[: len(b)], None
    for shift, part in ((32, p >> U(32)), (0, p & U(0xFFFFFFFF))):  # of a stretch, each sum is under 2**56
        total = np.zeros(len(b) + 1, U)
        np.cumsum(x * part, out=total[1:])
        own = reduced(total[stop] - total[start])
        value = times(own, np.full(1, 1 << 32, U)) if shift else reduced(value + own)
    return mixed(times(value, up[PART - start]))


def fingerprints(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each b[start:stop]."""
    out = np.zeros(len(start), U), np.zeros(len(start), U)
    wide = stop - start > WIDE
    for k in np.flatnonzero(wide):
        d = hashlib.blake2b(b[start[k] : stop[k]].tobytes(), digest_size=16).digest()
        for o, at in zip(out, (0, 8), strict=True):
            o[k] = int.from_bytes(d[at : at + 8], "little")
    for a in range(0, len(b), PART):
        own = slice(None) if len(b) <= PART and not wide.any() else np.flatnonzero((start >= a) & (start < a + PART) & ~wide)
        for o, base in zip(out, POINTS, strict=True):
            o[own] = _sums(b[a : a + PART + WIDE], start[own] - a, stop[own] - a, base)
    return out
