"""NumPy kernels for images of any size, and their use over DataFrames, one image a row.

Gray images are uint8 arrays of height x width. Kernels carry what Columns can't: fixpoints,
labels, large windows. They follow the same rules as ``gridlens.operators.stencils``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridlens.operators.stencils import gaussian_kernel

IMAGE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("data", T.BinaryType())])


# -- maps -------------------------------------------------------------------------------


def gray(rgb: np.ndarray) -> np.ndarray:
    w = np.array([0.299, 0.587, 0.114])
    return (rgb[..., :3] @ w + 1e-9).astype(np.uint8)


def threshold(img: np.ndarray, t: int) -> np.ndarray:
    return np.where(img > t, 255, 0).astype(np.uint8)


def otsu(img: np.ndarray) -> int:
    n = np.bincount(img.ravel(), minlength=256).astype(float)
    bins = np.arange(256)
    wb, sb = np.cumsum(n), np.cumsum(n * bins)
    wf = n.sum() - wb
    ok = (wb > 0) & (wf > 0)
    between = np.zeros(256)
    between[ok] = wb[ok] * wf[ok] * (sb[ok] / wb[ok] - (sb[-1] - sb[ok]) / wf[ok]) ** 2
    return int(between.argmax()) if between.any() else 0


# -- windows ----------------------------------------------------------------------------


def _windows(img: np.ndarray, k: int, fill: float) -> np.ndarray:
    r = k // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(img.astype(float), r, constant_values=fill), (k, k))


def dilate(img: np.ndarray, k: int = 3) -> np.ndarray:
    """Greatest of the window, by row and then by column."""
    return _separable(img, k, np.maximum, 0)


def erode(img: np.ndarray, k: int = 3) -> np.ndarray:
    return _separable(img, k, np.minimum, 255)


def _separable(img: np.ndarray, k: int, pick: Callable, fill: int) -> np.ndarray:
    r, (h, w) = k // 2, img.shape
    wide = np.pad(img, ((0, 0), (r, r)), constant_values=fill)
    rows = wide[:, :w].copy()
    for d in range(1, 2 * r + 1):
        pick(rows, wide[:, d : d + w], out=rows)
    tall = np.pad(rows, ((r, r), (0, 0)), constant_values=fill)
    out = tall[:h].copy()
    for d in range(1, 2 * r + 1):
        pick(out, tall[d : d + h], out=out)
    return out


def median(img: np.ndarray, k: int = 3) -> np.ndarray:
    """Upper median; the window shrinks at borders."""
    near = np.sort(_windows(img, k, np.inf).reshape(*img.shape, -1), axis=2)
    count = np.isfinite(near).sum(axis=2)
    return np.take_along_axis(near, (count // 2)[..., None], axis=2)[..., 0].astype(np.uint8)


def gaussian_blur(img: np.ndarray, k: int = 5, sigma: float = 1.0) -> np.ndarray:
    """Repeated edge pixels, truncated."""
    r, (h, w) = k // 2, img.shape
    wide = np.pad(img.astype(float), r, mode="edge")
    out = np.zeros((h, w))
    for i, row in enumerate(gaussian_kernel(k, sigma)):
        for j, v in enumerate(row):
            out += v * wide[i : i + h, j : j + w]
    return np.clip(out + 1e-9, 0, 255).astype(np.uint8)


def gradient(img: np.ndarray) -> np.ndarray:
    """Sobel magnitude; 0 on the border."""
    a = img.astype(int)
    out = np.zeros(img.shape, np.uint8)
    if min(img.shape) < 3:
        return out
    gx = (a[:-2, 2:] + 2 * a[1:-1, 2:] + a[2:, 2:]) - (a[:-2, :-2] + 2 * a[1:-1, :-2] + a[2:, :-2])
    gy = (a[2:, :-2] + 2 * a[2:, 1:-1] + a[2:, 2:]) - (a[:-2, :-2] + 2 * a[:-2, 1:-1] + a[:-2, 2:])
    out[1:-1, 1:-1] = np.minimum(255, np.sqrt(gx * gx + gy * gy)).astype(np.uint8)
    return out


def canny(img: np.ndarray, low: int, high: int) -> np.ndarray:
    """Gradient above ``high``, and above ``low`` where 8-connected to that through inner pixels; no thinning."""
    g = gradient(img)
    strong = g >= high
    weak = (g >= low) & ~strong
    weak[[0, -1]] = weak[:, [0, -1]] = False
    while True:
        near = _separable(strong.astype(np.uint8), 3, np.maximum, 0).astype(bool)
        new = near & weak & ~strong
        if not new.any():
            return np.where(strong, 255, 0).astype(np.uint8)
        strong = strong | new


# -- resampling -------------------------------------------------------------------------


def _sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, w = img.shape
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy, a = x - x0, y - y0, img.astype(float)
    top = a[y0, x0] * (1 - fx) + a[y0, x1] * fx
    low = a[y1, x0] * (1 - fx) + a[y1, x1] * fx
    return (top * (1 - fy) + low * fy + 1e-9).astype(np.uint8)


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = img.shape
    y, x = np.mgrid[0:height, 0:width]
    return _sample(img, x * (w / width), y * (h / height))


def solve_linear(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """None if a pivot is below 1e-10."""
    a, b, n = a.astype(float).copy(), b.astype(float).copy(), len(b)
    for k in range(n):
        p = k + int(np.abs(a[k:, k]).argmax())
        if abs(a[p, k]) < 1e-10:
            return None
        a[[k, p]], b[[k, p]] = a[[p, k]], b[[p, k]]
        for r in range(k + 1, n):
            f = a[r, k] / a[k, k]
            a[r, k:] -= f * a[k, k:]
            b[r] -= f * b[k]
    for k in range(n - 1, -1, -1):
        b[k] = (b[k] - a[k, k + 1 :] @ b[k + 1 :]) / a[k, k]
    return b


def homography(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> np.ndarray | None:
    """3 x 3 matrix that takes four points to four others; None if there is none."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    h = solve_linear(np.array(rows), np.array(right))
    return None if h is None else np.append(h, 1.0).reshape(3, 3)


def warp(img: np.ndarray, h: np.ndarray, width: int, height: int) -> np.ndarray | None:
    """The image under a homography, by its inverse; 0 outside; None if it has no inverse."""
    if abs(np.linalg.det(h)) < 1e-10:
        return None
    back = np.linalg.inv(h)
    y, x = np.mgrid[0:height, 0:width]
    p = np.einsum("ij,jyx->iyx", back, np.stack([x, y, np.ones_like(x)]).astype(float))
    w = np.where(np.abs(p[2]) < 1e-12, np.nan, p[2])
    sx, sy = p[0] / w, p[1] / w
    inside = (sx >= 0) & (sx < img.shape[1] - 1) & (sy >= 0) & (sy < img.shape[0] - 1)
    out = np.zeros((height, width), np.uint8)
    out[inside] = _sample(img, sx[inside], sy[inside])
    return out


def rectify(img: np.ndarray, quad: list[tuple[float, float]], size: int) -> np.ndarray | None:
    """The quadrilateral as a square image."""
    edge = size - 1
    h = homography(quad, [(0, 0), (edge, 0), (edge, edge), (0, edge)])
    return None if h is None else warp(img, h, size, size)


def augment(img: np.ndarray, seed: int, rotate: float = 10.0, move: int = 2, noise: float = 0.05) -> np.ndarray:
    """A float image 0..1 turned about its middle and moved as a whole (nearest pixel), with uniform noise."""
    rng = np.random.default_rng(seed)
    h, w = img.shape
    t = math.radians(rng.uniform(-rotate, rotate))
    dx, dy = rng.integers(-move, move + 1, 2)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    cx, cy = x - w / 2 - dx, y - h / 2 - dy
    sx = np.round(cx * math.cos(t) + cy * math.sin(t) + w / 2).astype(int)
    sy = np.round(-cx * math.sin(t) + cy * math.cos(t) + h / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.zeros((h, w))
    out[inside] = img[sy[inside], sx[inside]]
    return np.clip(out + rng.uniform(-noise, noise, (h, w)), 0, 1)


# -- components -------------------------------------------------------------------------


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected components, each named by its first pixel in scan order; -1 elsewhere.

    Least names pass along rows and columns until none changes.
    """
    h, w = mask.shape
    names = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        old = names
        for axis in (0, 1):
            for flip in (False, True):
                names = _sweep(names, mask, axis, flip)
        if (names == old).all():
            return np.where(mask, names, -1)


def _sweep(names: np.ndarray, mask: np.ndarray, axis: int, flip: bool) -> np.ndarray:
    """Running least along an axis, anew after every gap."""
    a, m = (names, mask) if axis else (names.T, mask.T)
    if flip:
        a, m = a[:, ::-1], m[:, ::-1]
    top = int(a.max()) + 1 if a.size else 1
    run = np.cumsum(~m, axis=1)  # gaps so far: a later run has lower keys, so its least never looks back
    key = np.where(m, a, top) - run * (top + 1)
    out = np.where(m, np.minimum.accumulate(key, axis=1) + run * (top + 1), a)
    if flip:
        out = out[:, ::-1]
    return out if axis else out.T


def blob_table(img: np.ndarray, over: int = 128) -> list[tuple[int, int, int, int, int, int]]:
    """(first pixel, area, min x, min y, max x, max y) of every blob above ``over``."""
    names = label(img > over)
    out = []
    for k in np.unique(names[names >= 0]):
        y, x = np.nonzero(names == k)
        out.append((int(k), len(x), int(x.min()), int(y.min()), int(x.max()), int(y.max())))
    return out


def largest_mask(img: np.ndarray, over: int = 128) -> np.ndarray | None:
    """The largest blob, the first of equals; None if there is none."""
    names = label(img > over)
    k, n = np.unique(names[names >= 0], return_counts=True)
    return names == k[n.argmax()] if len(k) else None


def remove_border_noise(cell: np.ndarray) -> np.ndarray:
    """Keeps the largest component; a pixel of exactly 128 belongs to one but doesn't start one."""
    names = label(cell >= 128)
    seeds = np.unique(names[cell > 128])
    if not len(seeds):
        return np.zeros_like(cell)
    area = [(names == k).sum() for k in seeds]
    return np.where(names == seeds[int(np.argmax(area))], cell, 0).astype(cell.dtype)


def corners(mask: np.ndarray) -> list[tuple[int, int]]:
    """Top left, top right, bottom right and bottom left of a mask, the first in scan order of equals."""
    y, x = np.nonzero(mask)
    picks = ((x + y).argmin(), (y - x).argmin(), (x + y).argmax(), (y - x).argmax())
    return [(int(x[k]), int(y[k])) for k in picks]


def hough(edges: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(theta, rho, votes) of peaks above ``least``, most votes first."""
    h, w = edges.shape
    y, x = np.nonzero(edges > 128)
    size = int(math.hypot(w, h)) + 1
    t = np.deg2rad(np.arange(180))
    rho = np.round(x[:, None] * np.cos(t) + y[:, None] * np.sin(t), 9).astype(int)
    votes = np.zeros((180, 2 * size + 1), int)
    np.add.at(votes, (np.broadcast_to(np.arange(180), rho.shape), rho + size), 1)
    near = np.pad(votes, 1)
    around = np.max([near[1 + a : 181 + a, 1 + b : votes.shape[1] + 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
    at = np.argwhere((votes > least) & (votes >= around))
    return sorted(((int(a), int(r - size), int(votes[a, r])) for a, r in at), key=lambda p: (-p[2], p[0], p[1]))


def _cross(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[float, float] | None:
    t1, t2 = math.radians(a[0]), math.radians(b[0])
    det = math.cos(t1) * math.sin(t2) - math.sin(t1) * math.cos(t2)
    if abs(det) < 1e-10:
        return None
    return (math.sin(t2) * a[1] - math.sin(t1) * b[1]) / det, (math.cos(t1) * b[1] - math.cos(t2) * a[1]) / det


def order_corners(quad: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Top left, top right, bottom right, bottom left."""
    return [min(quad, key=lambda p: p[0] + p[1]), min(quad, key=lambda p: p[1] - p[0]), max(quad, key=lambda p: p[0] + p[1]), max(quad, key=lambda p: p[1] - p[0])]


def find_quad(img: np.ndarray, least_votes: int = 50) -> list[tuple[float, float]] | None:
    """Corners of the largest blob if its box covers more than a sixteenth of the image; else those of the outermost strong lines."""
    h, w = img.shape
    blob = largest_mask(img)
    if blob is not None:
        y, x = np.nonzero(blob)
        if (x.max() - x.min() + 1) * (y.max() - y.min() + 1) > w * h // 16:
            return [(float(a), float(b)) for a, b in corners(blob)]
    lines = hough(img, least_votes)
    upright = [p for p in lines if p[0] < 30 or p[0] > 150][:20]
    level = [p for p in lines if 60 < p[0] < 120][:20]
    if len(lines) < 4 or len(upright) < 2 or len(level) < 2:
        return None
    ends = [(min(s, key=lambda p: abs(p[1])), max(s, key=lambda p: abs(p[1]))) for s in (upright, level)]
    quad = [_cross(a, b) for a in ends[0] for b in ends[1]]
    if any(p is None for p in quad):
        return None
    out = order_corners(quad)
    return out if -w / 2 <= out[0][0] <= 1.5 * w and -h / 2 <= out[0][1] <= 1.5 * h else None


# -- cells ------------------------------------------------------------------------------


def centre_of_mass(img: np.ndarray) -> tuple[float, float]:
    mass = float(img.sum())
    h, w = img.shape
    if not mass:
        return w / 2, h / 2
    y, x = np.mgrid[0:h, 0:w]
    return float((x * img.astype(float)).sum() / mass), float((y * img.astype(float)).sum() / mass)


def centre(img: np.ndarray) -> np.ndarray:
    h, w = img.shape
    cx, cy = centre_of_mass(img)
    dx, dy = int(w / 2 - cx), int(h / 2 - cy)
    out = np.zeros_like(img)
    ys, xs = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
    out[ys, xs] = img[max(0, -dy) : min(h, h - dy), max(0, -dx) : min(w, w - dx)]
    return out


def split_cells(grid: np.ndarray, margin: float = 0.2, size: int = 28) -> list[np.ndarray]:
    """81 cells of a square grid: cut out, margin taken off, resized, centred, cleaned."""
    ch, cw = grid.shape[0] // 9, grid.shape[1] // 9
    out = []
    for r in range(9):
        for c in range(9):
            my, mx = int(ch * margin), int(cw * margin)
            cell = grid[r * ch + my : (r + 1) * ch - my, c * cw + mx : (c + 1) * cw - mx]
            out.append(remove_border_noise(centre(resize(cell, size, size))))
    return out


def is_empty(cell: np.ndarray, share: float = 0.05) -> bool:
    return float((cell > 128).mean()) < share


# -- over DataFrames --------------------------------------------------------------------


def map_images(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], image: str = "image") -> DataFrame:
    """Every image (a struct of width, height and data) through a kernel that gives an image; null where it gives None."""
    schema = T.StructType([T.StructField(f.name, IMAGE if f.name == image else f.dataType) for f in df.schema])
    at = df.columns.index(image)
    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column(at).to_pylist():
                made = kernel(decode(cell)) if cell else None
                out.append(None if made is None else {"width": made.shape[1], "height": made.shape[0], "data": made.astype(np.uint8).tobytes()})
            yield pa.RecordBatch.from_arrays([pa.array(out, kind) if k == at else c for k, c in enumerate(batch.columns)], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(cell: dict) -> np.ndarray:
    return np.frombuffer(cell["data"], np.uint8).reshape(cell["height"], cell["width"])


def blobs(df: DataFrame, key: str, px: str, width: int, over: int = 128) -> DataFrame:
    """key, first_pixel, area and box of all blobs of images in arrays."""
    made = T.StructType([df.schema[key], *[T.StructField(n, T.IntegerType()) for n in ("first_pixel", "area_", "min_x", "min_y", "max_x", "max_y")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, cell in zip(batch.column(0), batch.column(1), strict=True):
                img = np.asarray(cell.values).reshape(-1, width) if cell.is_valid else np.zeros((0, width))
                for b in blob_table(img, over):
                    keys.append(k)
                    rows.append(b)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], batch.column(0).type), *[pa.array(c, pa.int32()) for c in columns]], names=made.names)

    return df.select(key, px).mapInArrow(run, made).withColumn("area", F.col("area_").cast("long")).drop("area_")


def largest_blobs(df: DataFrame, key: str, px: str, width: int, over: int = 128) -> DataFrame:
    """The largest blob of each image that has one, the first of equals."""
    best = blobs(df, key, px, width, over).groupBy(key).agg(F.min(F.struct((-F.col("area")).alias("low"), "first_pixel", "min_x", "min_y", "max_x", "max_y")).alias("b"))
    return best.select(key, (-F.col("b.low")).alias("area"), *[f"b.{c}" for c in ("min_x", "min_y", "max_x", "max_y")])


def map_arrays(df: DataFrame, px: str, width: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Every image in an array column through a kernel; null stays null, as does what a kernel gives None for."""
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.IntegerType())) if f.name == px else f for f in df.schema])
    at = df.columns.index(px)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column(at):
                made = kernel(np.asarray(cell.values).astype(np.uint8).reshape(-1, width)) if cell.is_valid else None
                out.append(None if made is None else made.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())) if k == at else c for k, c in enumerate(batch.columns)], names=schema.names)

    return df.mapInArrow(run, schema)


def _map_rows(df: DataFrame, columns: list[str], made: T.StructType, value: Callable[..., np.ndarray | None]) -> DataFrame:
    """The first of ``columns`` and an array of doubles that ``value`` makes of the others; null where one of them is null or it gives None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(k).to_pylist() for k in range(1, batch.num_columns)]
            out = [None if any(c is None for c in row) else value(*row) for row in zip(*rest, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else np.ravel(x) for x in out], pa.list_(pa.float64()))], names=made.names)

    return df.select(*columns).mapInArrow(run, made)


def solve_systems(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key and solution of linear systems: ``a`` holds n x n numbers row by row, ``b`` n; null where a pivot is below 1e-10."""
    made = T.StructType([df.schema[key], T.StructField("solution", T.ArrayType(T.DoubleType()))])
    return _map_rows(df, [key, a, b], made, lambda m, v: solve_linear(np.reshape(m, (len(v), len(v))), np.array(v)))


def fit_homographies(df: DataFrame, key: str, target: str, source: list[tuple[float, float]]) -> DataFrame:
    """key and h, nine numbers row by row, of the homographies that take the four points ``source`` to each row's ``target`` (x and y in turn); null where there is none."""
    made = T.StructType([df.schema[key], T.StructField("h", T.ArrayType(T.DoubleType()))])
    return _map_rows(df, [key, target], made, lambda t: homography(source, list(zip(t[::2], t[1::2], strict=True))))
