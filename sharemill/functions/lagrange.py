"""Interpolation coefficients: a handful of integers, worked out on the driver."""

from __future__ import annotations

from collections.abc import Sequence


def inverse(a: int, p: int) -> int:
    if a % p == 0:
        raise ZeroDivisionError("no inverse")
    return pow(a, -1, p)


def basis(points: Sequence[int], target: int, p: int) -> list[int]:
    """What each point's value counts for in the value at target."""
    if len({x % p for x in points}) != len(points):
        raise ValueError("points repeat")
    out = []
    for i, x in enumerate(points):
        num = den = 1
        for j, other in enumerate(points):
            if j != i:
                num, den = num * (target - other) % p, den * (x - other) % p
        out.append(num * inverse(den, p) % p)
    return out


def vanishing(points: Sequence[int], at: int, p: int) -> int:
    """The product of (at - point): zero at each point."""
    out = 1
    for x in points:
        out = out * (at - x) % p
    return out
