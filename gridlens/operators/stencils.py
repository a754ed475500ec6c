"""Neighbourhood and resampling operators on small images as array Columns.

An image is a row-major array of a fixed width. One row holds one image, so none of these
needs a shuffle. Borders differ by operator: the blur repeats edge pixels, median,
dilation and erosion shrink their window, the gradient leaves the border 0. Large images
take the kernels of ``gridlens.operators.kernels``, which compute the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from gridlens.functions.elementwise import _c, clamp, trunc_int


def _each(width: int, height: int, value: Callable[[Column, Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: value(i % width, F.floor(i / width).cast("int")))


def at(px, width: int, x: Column, y: Column) -> Column:
    return F.get(_c(px), (y * width + x).cast("int"))


def _window(px, width: int, height: int, k: int, x: Column, y: Column) -> Column:
    """Pixels of the k x k window that lie inside the image."""
    r = k // 2
    near = []
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            inside = (x + dx >= 0) & (x + dx < width) & (y + dy >= 0) & (y + dy < height)
            near.append(F.when(inside, at(px, width, x + dx, y + dy)))
    return F.array_compact(F.array(*near))


def dilate(px, width: int, height: int, k: int = 3) -> Column:
    return _each(width, height, lambda x, y: F.array_max(_window(px, width, height, k, x, y)))


def erode(px, width: int, height: int, k: int = 3) -> Column:
    return _each(width, height, lambda x, y: F.array_min(_window(px, width, height, k, x, y)))


def median(px, width: int, height: int, k: int = 3) -> Column:
    """The upper median of the window."""

    def middle(x: Column, y: Column) -> Column:
        near = F.array_sort(_window(px, width, height, k, x, y))
        return F.element_at(near, F.floor(F.size(near) / 2).cast("int") + 1)

    return _each(width, height, middle)


def convolve(px, width: int, height: int, kernel: list[list[float]]) -> Column:
    """Weighted sums with repeated edge pixels."""
    r = len(kernel) // 2

    def total(x: Column, y: Column) -> Column:
        parts = [at(px, width, clamp(x + (j - r), 0, width - 1), clamp(y + (i - r), 0, height - 1)) * F.lit(w) for i, row in enumerate(kernel) for j, w in enumerate(row)]
        return sum(parts[1:], parts[0])

    return _each(width, height, total)


def gaussian_kernel(k: int, sigma: float) -> list[list[float]]:
    r = k // 2
    rows = [[math.exp(-(x * x + y * y) / (2 * sigma * sigma)) for x in range(-r, r + 1)] for y in range(-r, r + 1)]
    total = sum(map(sum, rows))
    return [[v / total for v in row] for row in rows]


def gaussian_blur(px, width: int, height: int, k: int = 5, sigma: float = 1.0) -> Column:
    """Truncated, with a little added first, so that a sum just short of a whole number by rounding counts as it."""
    return F.transform(convolve(px, width, height, gaussian_kernel(k, sigma)), lambda v: clamp(trunc_int(v + F.lit(1e-9)), 0, 255))


def conv_valid(px, width: int, height: int, kernel: list[list[float]]) -> Column:
    """Cross-correlation where the kernel fits, stride 1."""
    k = len(kernel)
    w, h = width - k + 1, height - k + 1

    def total(x: Column, y: Column) -> Column:
        parts = [at(px, width, x + j, y + i) * F.lit(v) for i, row in enumerate(kernel) for j, v in enumerate(row)]
        return sum(parts[1:], parts[0])

    return _each(w, h, total)


def sobel(px, width: int, height: int) -> Column:
    def magnitude(x: Column, y: Column) -> Column:
        def p(dx: int, dy: int) -> Column:
            return at(px, width, x + dx, y + dy)

        gx = p(1, -1) + 2 * p(1, 0) + p(1, 1) - p(-1, -1) - 2 * p(-1, 0) - p(-1, 1)
        gy = p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1)
        inner = (x > 0) & (x < width - 1) & (y > 0) & (y < height - 1)
        return F.when(inner, F.least(F.lit(255), trunc_int(F.sqrt((gx * gx + gy * gy).cast("double"))))).otherwise(0)

    return _each(width, height, magnitude)


def max_pool(px, width: int, height: int, size: int = 2) -> Column:
    def most(x: Column, y: Column) -> Column:
        return F.greatest(*[at(px, width, x * size + j, y * size + i) for i in range(size) for j in range(size)])

    return _each(width // size, height // size, most)


def resize(px, width: int, height: int, to_width: int, to_height: int) -> Column:
    """Bilinear, source = target * ratio, edges repeated, truncated."""
    rx, ry = width / to_width, height / to_height

    def value(x: Column, y: Column) -> Column:
        sx, sy = x * F.lit(rx), y * F.lit(ry)
        x0, y0 = F.floor(sx).cast("int"), F.floor(sy).cast("int")
        x1, y1 = F.least(x0 + 1, F.lit(width - 1)), F.least(y0 + 1, F.lit(height - 1))
        fx, fy = sx - x0, sy - y0
        top = at(px, width, x0, y0) * (1 - fx) + at(px, width, x1, y0) * fx
        low = at(px, width, x0, y1) * (1 - fx) + at(px, width, x1, y1) * fx
        return trunc_int(top * (1 - fy) + low * fy)

    return _each(to_width, to_height, value)


def centre_of_mass(px, width: int, height: int) -> Column:
    """(x, y) weighted by intensity; the middle if nothing is lit."""
    steps = F.sequence(F.lit(0), F.lit(width * height - 1))
    mass = F.aggregate(_c(px), F.lit(0).cast("long"), lambda a, v: a + v)

    def moment(place: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.zip_with(_c(px), steps, lambda v, i: v * place(i)), F.lit(0).cast("long"), lambda a, v: a + v)

    mx, my = moment(lambda i: i % width), moment(lambda i: F.floor(i / width).cast("int"))
    safe = F.nullif(mass, F.lit(0))
    return F.struct(F.coalesce(mx / safe, F.lit(width / 2.0)).alias("x"), F.coalesce(my / safe, F.lit(height / 2.0)).alias("y"))


def shift(px, width: int, height: int, dx: Column, dy: Column) -> Column:
    """Moved by (dx, dy); what falls off is lost, what comes in is 0."""

    def value(x: Column, y: Column) -> Column:
        sx, sy = x - dx, y - dy
        inside = (sx >= 0) & (sx < width) & (sy >= 0) & (sy < height)
        return F.when(inside, at(px, width, sx, sy)).otherwise(0)

    return _each(width, height, value)


def centre(px, width: int, height: int) -> Column:
    """Centre of mass moved to the middle of the image."""
    c = centre_of_mass(px, width, height)
    return shift(px, width, height, trunc_int(F.lit(width / 2.0) - c["x"]), trunc_int(F.lit(height / 2.0) - c["y"]))
