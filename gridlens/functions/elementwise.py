"""Scalar and element-wise functions: activations, pixel maps, matrices as flat arrays.

Arrays are row-major. Every function takes and returns Columns and treats null as null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Weights of red, green and blue in a gray value.
GRAY_WEIGHTS = (0.299, 0.587, 0.114)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# -- scalars ----------------------------------------------------------------------------


def clamp(x, lo, hi) -> Column:
    return F.greatest(_c(lo), F.least(_c(hi), _c(x)))


def relu(x) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


def relu_derivative(x) -> Column:
    return F.when(_c(x) > 0, 1.0).otherwise(0.0)


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def sigmoid_derivative(x) -> Column:
    """Of the activation's input."""
    s = sigmoid(x)
    return s * (1.0 - s)


def tanh_derivative(x) -> Column:
    t = F.tanh(_c(x))
    return 1.0 - t * t


def trunc_int(x) -> Column:
    """Towards zero."""
    return _c(x).cast("int")


def rgb_to_gray(r, g, b) -> Column:
    wr, wg, wb = GRAY_WEIGHTS
    return trunc_int(F.lit(wr) * _c(r) + F.lit(wg) * _c(g) + F.lit(wb) * _c(b))


def quantise(x, lo: float = -0.6, hi: float = 0.6) -> Column:
    """A real number as a pixel 0..255."""
    return clamp(F.floor((_c(x).cast("double") - F.lit(lo)) / F.lit(hi - lo) * F.lit(256)).cast("int"), 0, 255)


# -- pixels in arrays -------------------------------------------------------------------


def gray_to_rgb(px) -> Column:
    return F.flatten(F.transform(_c(px), lambda v: F.array(v, v, v)))


def threshold_binary(px, t) -> Column:
    return F.transform(_c(px), lambda v: F.when(v > _c(t), 255).otherwise(0))


def invert(px) -> Column:
    return F.transform(_c(px), lambda v: F.lit(255) - v)


def normalise(px) -> Column:
    return F.transform(_c(px), lambda v: v / F.lit(255.0))


def fill_ratio(px, over: int = 128) -> Column:
    """Share of pixels above ``over``; 0 of an empty image."""
    return F.coalesce(F.size(F.filter(_c(px), lambda v: v > over)) / F.nullif(F.size(_c(px)), F.lit(0)), F.lit(0.0))


def is_empty(px, share: float = 0.05) -> Column:
    return fill_ratio(px) < F.lit(share)


def crop(px, width: int, x: int, y: int, w: int, h: int) -> Column:
    """A box of an image, clamped to it."""
    x0, x1 = max(0, x), min(width, x + w)
    rows = F.sequence(F.lit(max(0, y)), F.least(F.lit(y + h), F.floor(F.size(_c(px)) / width).cast("int")) - 1)
    return F.flatten(F.transform(rows, lambda r: F.slice(_c(px), r * width + x0 + 1, F.lit(x1 - x0))))


def crop_margin(px, width: int, height: int, margin: float) -> Column:
    mx, my = int(width * margin), int(height * margin)
    return crop(px, width, mx, my, width - 2 * mx, height - 2 * my)


# -- vectors ----------------------------------------------------------------------------


def softmax(xs) -> Column:
    """Shifted by the greatest value, so it can't overflow."""
    shifted = F.transform(_c(xs), lambda v: F.exp(v.cast("double") - F.array_max(_c(xs)).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
    return F.transform(shifted, lambda v: v / total)


def argmax(xs) -> Column:
    """Place of the greatest value, from 0; the first of equals."""
    return (F.array_position(_c(xs), F.array_max(_c(xs))) - 1).cast("int")


def cross_entropy(probabilities, target) -> Column:
    pairs = F.zip_with(_c(probabilities), _c(target), lambda p, t: t * F.log(p + F.lit(1e-7)))
    return -F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)


def one_hot(label, n: int = 10) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == _c(label)).cast("double"))


def best_digit(probabilities) -> Column:
    """Greatest probability of the digits 1..9."""
    return F.array_max(F.slice(_c(probabilities), 2, 9))


def candidates(probabilities, top: int = 5) -> Column:
    """The ``top`` digits of 1..9 as (prob, digit), most probable first, the lower digit of equals first."""
    pairs = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda d: F.struct((-F.element_at(_c(probabilities), d + 1)).alias("low"), d.alias("digit")))
    return F.slice(F.transform(F.array_sort(pairs), lambda p: F.struct((-p["low"]).alias("prob"), p["digit"].alias("digit"))), 1, top)


# -- matrices ---------------------------------------------------------------------------


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def multiply(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def scale(a, s) -> Column:
    return F.transform(_c(a), lambda x: x * _c(s))


def filled(value, rows: int, cols: int) -> Column:
    return F.array_repeat(_c(value), rows * cols)


def randomized(key, seed: int, rows: int, cols: int, lo: float = -1.0, hi: float = 1.0) -> Column:
    """A matrix of uniform numbers in [lo, hi) that hang on a key and a seed."""
    span = float(1 << 52)
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: F.lit(lo) + F.pmod(F.xxhash64(F.lit(seed), _c(key), i), F.lit(1 << 52)) / F.lit(span) * F.lit(hi - lo))


def copied(a) -> Column:
    """The matrix itself: columns are never changed in place, so a copy is the same values."""
    return F.transform(_c(a), lambda x: x)


def transpose(a, rows: int, cols: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: F.get(_c(a), (i % rows) * cols + F.floor(i / rows).cast("int")))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def matmul(a, b, n: int, k: int, m: int) -> Column:
    """(n x k) times (k x m)."""
    bt = transpose(b, k, m)
    return F.transform(F.sequence(F.lit(0), F.lit(n * m - 1)), lambda i: dot(F.slice(_c(a), F.floor(i / m).cast("int") * k + 1, F.lit(k)), F.slice(bt, (i % m) * k + 1, F.lit(k))))


def dense(x, weights, bias, n_in: int, n_out: int, activate: bool = True) -> Column:
    out = F.transform(F.sequence(F.lit(0), F.lit(n_out - 1)), lambda i: dot(F.slice(_c(weights), i * n_in + 1, F.lit(n_in)), x) + F.get(_c(bias), i))
    return F.transform(out, lambda v: relu(v)) if activate else out


# -- points and planes ------------------------------------------------------------------


def determinant3(h) -> Column:
    a, b, c, d, e, f, g, i, j = (F.get(_c(h), F.lit(k)) for k in range(9))
    return a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)


def invert3(h) -> Column:
    """Inverse of a 3 x 3 matrix; null if its determinant is below 1e-10."""
    a, b, c, d, e, f, g, i, j = (F.get(_c(h), F.lit(k)) for k in range(9))
    det = determinant3(h)
    parts = (e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d)
    return F.when(F.abs(det) >= 1e-10, F.transform(F.array(*parts), lambda v: v / F.nullif(det, F.lit(0.0))))


def transform_point(h, x, y) -> Column:
    """(x, y) under a homography; null where it has no image."""
    p = [F.get(_c(h), F.lit(3 * k)) * _c(x) + F.get(_c(h), F.lit(3 * k + 1)) * _c(y) + F.get(_c(h), F.lit(3 * k + 2)) for k in range(3)]
    w = F.nullif(p[2], F.lit(0.0))
    return F.struct((p[0] / w).alias("x"), (p[1] / w).alias("y"))


def rectangle_quad(w, h) -> Column:
    """Corners of a rectangle: top left, top right, bottom right, bottom left."""
    right, low = _c(w).cast("double") - 1, _c(h).cast("double") - 1
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.lit(0.0), F.lit(0.0)), (right, F.lit(0.0)), (right, low), (F.lit(0.0), low))])


def order_corners(points) -> Column:
    """Of an array of points (x, y): top left, top right, bottom right, bottom left, by sum and difference of the coordinates; the first of equals."""

    def least(key) -> Column:
        best = F.array_min(F.transform(_c(points), lambda p, i: F.struct(key(p["x"], p["y"]).alias("key"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
        return F.struct(best["x"].alias("x"), best["y"].alias("y"))

    return F.array(least(lambda x, y: x + y), least(lambda x, y: y - x), least(lambda x, y: -x - y), least(lambda x, y: x - y))


def intersection(rho1, theta1, rho2, theta2) -> Column:
    """Where two lines x cos t + y sin t = rho (t in degrees) meet; null if they are parallel."""
    t1, t2 = F.radians(_c(theta1)), F.radians(_c(theta2))
    det = F.cos(t1) * F.sin(t2) - F.sin(t1) * F.cos(t2)
    safe = F.when(F.abs(det) >= 1e-10, det)
    x = (F.sin(t2) * _c(rho1) - F.sin(t1) * _c(rho2)) / safe
    y = (F.cos(t1) * _c(rho2) - F.cos(t2) * _c(rho1)) / safe
    return F.when(safe.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


# -- bytes ------------------------------------------------------------------------------


def big_endian_int(body, at) -> Column:
    """Unsigned 32-bit number at a byte offset from 0; 0 if the bytes end before."""
    four = F.substring(_c(body), _c(at) + 1, F.lit(4))
    return F.when(F.length(four) == 4, F.conv(F.hex(four), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
