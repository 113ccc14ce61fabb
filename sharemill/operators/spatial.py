"""Pooling and convolution over arrays of cells in row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def windows(height: int, width: int, size: int, stride: int, pad: int = 0) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(ho, wo, [(kh, kw, cell)]) of every window; cells in the padding are left out."""
    out = []
    for ho in range((height + 2 * pad - size) // stride + 1):
        for wo in range((width + 2 * pad - size) // stride + 1):
            cells = [(kh, kw, (h, w)) for kh in range(size) for kw in range(size) if 0 <= (h := ho * stride + kh - pad) < height and 0 <= (w := wo * stride + kw - pad) < width]
            out.append((ho, wo, [(kh, kw, h * width + w) for kh, kw, (h, w) in cells]))
    return out


def at(x: Column, k: int) -> Column:
    return F.get(x, F.lit(k))


def _rows(parts: list[tuple[int, int, Column]], names: Sequence[str]) -> Column:
    return F.inline(F.array(*(F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]), y.cast("long").alias("y")) for a, b, y in parts)))


def total(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def pool(x: Column, height: int, width: int, size: int = 2, stride: int = 2, kind: str = "sum") -> Column:
    """A generator of (ho, wo, y): sum, max or avg (to the nearest) of each window."""
    from ..functions.field import rescale

    parts = []
    for ho, wo, cells in windows(height, width, size, stride):
        own = [at(x, c) for _, _, c in cells]
        y = F.greatest(*own) if kind == "max" else total(own) if kind == "sum" else rescale(total(own), len(own))
        parts.append((ho, wo, y))
    return _rows(parts, ("ho", "wo"))


def pool_backward(g: Column, height: int, width: int, size: int = 2, stride: int = 2) -> Column:
    """A generator of (h, w, y): every cell gets the gradients of its windows, in row order."""
    of: dict[int, list[Column]] = {c: [] for c in range(height * width)}
    for k, (_, _, cells) in enumerate(windows(height, width, size, stride)):
        for _, _, c in cells:
            of[c].append(at(g, k))
    return _rows([(c // width, c % width, total(v) if v else F.lit(0)) for c, v in of.items()], ("h", "w"))


#: Convolutions fold over the kernel's places with an array per image, so their code stays the same
#: size whatever the image and kernel are. Cells are in (row, column, channel) order, kernels in
#: (kernel row, kernel column, channel in, channel out) order, both flat.


def _literal(kernel: Sequence) -> Column:
    flat = list(kernel)
    while flat and isinstance(flat[0], (list, tuple)):
        flat = [v for row in flat for v in row]
    return F.lit(flat).cast("array<bigint>")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int") if b != 1 else a


def _fold(n: int, term) -> Column:
    """The sum of term(k) for k from 0 to n - 1."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda acc, k: acc + term(k))


def _inside(h: Column, w: Column, height: int, width: int, value: Column) -> Column:
    return F.when((h >= 0) & (h < height) & (w >= 0) & (w < width), value).otherwise(F.lit(0).cast("long"))


def _cells(n: int, y, width: int, channels: int, names: Sequence[str]) -> Column:
    """A generator of places and values of n flat outputs."""
    place = lambda o: (_div(o, width * channels), _div(o, channels) % width, o % channels)

    def row(o: Column) -> Column:
        h, w, c = place(o)
        more = [c.cast("int").alias(names[2])] if len(names) > 2 else []
        return F.struct(h.cast("int").alias(names[0]), w.cast("int").alias(names[1]), *more, y(h, w, c).alias("y"))

    return F.inline(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), row))


def extent(size: int, kernel: int, stride: int, pad: int) -> int:
    return (size + 2 * pad - kernel) // stride + 1


def conv2d(x: Column, kernel: Sequence, height: int, width: int, stride: int = 1, pad: int = 0, channels: tuple[int, int] = (1, 1)) -> Column:
    """A generator of (ho, wo, y), with several channels (ho, wo, co, y): products with the kernel,
    summed over its places and the channels in, without rescaling."""
    size, (ci, co), k = len(kernel), channels, _literal(kernel)
    ho, wo = extent(height, size, stride, pad), extent(width, size, stride, pad)

    def at_output(h: Column, w: Column, c: Column) -> Column:
        def term(n: Column) -> Column:
            r, q, i = h * stride + _div(n, size * ci) - pad, w * stride + _div(n, ci) % size - pad, n % ci
            return _inside(r, q, height, width, F.get(x, (r * width + q) * ci + i) * F.get(k, n * co + c))

        return _fold(size * size * ci, term)

    return _cells(ho * wo * co, at_output, wo, co, ("ho", "wo", "co") if channels != (1, 1) else ("ho", "wo"))


def conv2d_grad_input(g: Column, kernel: Sequence, height: int, width: int, stride: int = 1, pad: int = 0, channels: tuple[int, int] = (1, 1)) -> Column:
    """A generator of (h, w, y), with several channels (h, w, ci, y): gradients of the outputs that a
    cell counts in, through the kernel's places that they meet it at."""
    size, (ci, co), k = len(kernel), channels, _literal(kernel)
    ho, wo = extent(height, size, stride, pad), extent(width, size, stride, pad)

    def at_cell(h: Column, w: Column, i: Column) -> Column:
        def term(n: Column) -> Column:
            kh, kw, c = _div(n, size * co), _div(n, co) % size, n % co
            r, q = h + pad - kh, w + pad - kw
            value = F.get(g, (_div(r, stride) * wo + _div(q, stride)) * co + c) * F.get(k, ((kh * size + kw) * ci + i) * co + c)
            return F.when((r % stride == 0) & (q % stride == 0), _inside(_div(r, stride), _div(q, stride), ho, wo, value)).otherwise(F.lit(0).cast("long"))

        return _fold(size * size * co, term)

    return _cells(height * width * ci, at_cell, width, ci, ("h", "w", "ci") if channels != (1, 1) else ("h", "w"))


def conv2d_grad_kernel(x: Column, g: Column, size: int, height: int, width: int, stride: int = 1, pad: int = 0, channels: tuple[int, int] = (1, 1)) -> Column:
    """A generator of (kh, kw, y), with several channels (kh, kw, cc, y) where cc is channel in times
    channels out plus channel out, for one image; images add up."""
    ci, co = channels
    ho, wo = extent(height, size, stride, pad), extent(width, size, stride, pad)

    def at_kernel(kh: Column, kw: Column, cc: Column) -> Column:
        i, c = _div(cc, co), cc % co

        def term(n: Column) -> Column:
            r, q = _div(n, wo) * stride + kh - pad, n % wo * stride + kw - pad
            return _inside(r, q, height, width, F.get(x, (r * width + q) * ci + i) * F.get(g, n * co + c))

        return _fold(ho * wo, term)

    return _cells(size * size * ci * co, at_kernel, size, ci * co, ("kh", "kw", "cc") if channels != (1, 1) else ("kh", "kw"))
