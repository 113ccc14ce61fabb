"""Exact products of whole matrices over a prime field, by products of limbs in doubles."""

from __future__ import annotations

import numpy as np

from ..spec import P61

#: Bits of a limb, and terms that a product may add up: limbs' products stay below 2^53.
LIMB, MOST_TERMS = 21, 1 << 11


def _turned(x: np.ndarray, s: int) -> np.ndarray:
    """x * 2^s mod 2^61 - 1 for 0 <= x < 2^61: bits turn around."""
    s %= 61
    if not s:
        return x
    low = np.uint64((1 << (61 - s)) - 1)
    return ((x & low) << np.uint64(s)) | (x >> np.uint64(61 - s))


def _limbs(x: np.ndarray, n: int) -> list[np.ndarray]:
    mask = np.uint64((1 << LIMB) - 1)
    return [((x >> np.uint64(LIMB * k)) & mask).astype(np.float64) for k in range(n)]


def matmul(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b mod p for entries in [0, p), as unsigned 64-bit integers; stacks of matrices too. For 2^61 - 1 and
    primes below 2^32; longer contractions than MOST_TERMS are cut."""
    if p != P61 and p >= 1 << 32:
        raise ValueError("p must be 2^61 - 1 or below 2^32")
    if a.shape[-1] > MOST_TERMS:
        half = MOST_TERMS
        return add(matmul(a[..., :half], b[..., :half, :], p), matmul(a[..., half:], b[..., half:, :], p), p)
    n = -(-p.bit_length() // LIMB)
    left, right = _limbs(a.astype(np.uint64), n), _limbs(b.astype(np.uint64), n)
    out = np.zeros((*a.shape[:-1], b.shape[-1]), np.uint64)
    for i in range(n):
        for j in range(n):
            part = (left[i] @ right[j]).astype(np.uint64)
            if p == P61:
                part = _turned(part, LIMB * (i + j))
            else:
                part = part % np.uint64(p) * np.uint64(pow(2, LIMB * (i + j), p)) % np.uint64(p)
            out = add(out, part, p)
    return out


def add(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a + b mod p; entries may be p itself."""
    s = a + b
    return np.where(s >= np.uint64(p), s - np.uint64(p), s)


def sub(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    return add(a, np.uint64(p) - b, p)


def scaled(a: np.ndarray, c: int, p: int) -> np.ndarray:
    """c * a mod p, as a product with one column."""
    flat = a.reshape(-1, 1)
    return matmul(flat, np.array([[c % p]], np.uint64), p).reshape(a.shape)
