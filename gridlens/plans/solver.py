"""From photos of puzzles to solved photos, one photo a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridlens.operators import draw, kernels as K, nn, puzzle

GRID = 252


def prepare(photo: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float]] | None]:
    """Light-on-dark image of a photo, and the corners of its grid (None if not found)."""
    flat = K.gray(photo) if photo.ndim == 3 else photo
    blur = K.gaussian_blur(flat, 5, 1.0)
    ink = 255 - K.threshold(blur, K.otsu(blur))
    return ink, K.find_quad(K.dilate(ink, 3))


def rank_cells(cells: list[np.ndarray], m: nn.Model) -> list[tuple[int, list[int]]]:
    """(cell, digits 1..9 by probability) of cells that are not empty, the surest first."""
    full = [k for k, c in enumerate(cells) if not K.is_empty(c)]
    if not full:
        return []
    p, _ = nn.forward(m, np.stack([cells[k] for k in full]).astype(np.float32) / 255)
    ranked = []
    for k, row in zip(full, p, strict=True):
        digits = sorted(range(1, 10), key=lambda d: (-row[d], d))
        ranked.append((-float(row[1:].max()), k, digits))
    return [(k, digits) for _, k, digits in sorted(ranked)]


def solve_photo(photo: np.ndarray, m: nn.Model) -> dict:
    """status ('solved', 'no grid' or 'no solution'), corners, clues, solution and the solved photo as PNG."""
    ink, quad = prepare(photo)
    grid = K.rectify(ink, quad, GRID) if quad else None
    if grid is None:
        return {"status": "no grid"}
    found = puzzle.find_clues(rank_cells(K.split_cells(grid), m))
    corners = [v for p in quad for v in p]
    if found is None:
        return {"status": "no solution", "corners": corners}
    colour = photo if photo.ndim == 3 else np.repeat(photo[..., None], 3, axis=2)
    clues = found[0].replace("0", ".")
    image = draw.solved_photo(colour[..., :3], quad, clues, found[1], GRID)
    return {"status": "solved", "corners": corners, "clues": clues, "solution": found[1], "image": draw.png_encode(image)}


RESULT = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("corners", T.ArrayType(T.DoubleType())),
        T.StructField("clues", T.StringType()),
        T.StructField("solution", T.StringType()),
        T.StructField("image", T.BinaryType()),
    ]
)


def solve_photos(photos: DataFrame, m: nn.Model) -> DataFrame:
    """origin, status, corners, clues, solution and image of photos (origin, width, height, channels, data)."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in batch.schema.names}
                shape = (row["height"], row["width"]) + ((row["channels"],) if row["channels"] > 1 else ())
                out = {"origin": row["origin"]} | solve_photo(np.frombuffer(row["data"], np.uint8).reshape(shape), m)
                yield pa.RecordBatch.from_arrays([pa.array([out.get(n)], t) for n, t in zip(RESULT.names, kinds, strict=True)], names=RESULT.names)

    return photos.select("origin", "width", "height", "channels", "data").mapInArrow(run, RESULT)


def glyph_samples(n: int, side: int = 28, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Drawn digits 0..9, light on dark and centred as cells are: sizes, places and noise vary. For 0 the cell is nearly empty."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((n, side, side), np.uint8), np.arange(n) % 10
    for k in range(n):
        img = np.zeros((40, 40), np.uint8)
        if y[k]:
            draw.put_digit(img, int(y[k]), 8 + rng.integers(0, 4), 5 + rng.integers(0, 4), int(rng.choice([21, 28])), 255)
            img = K.gaussian_blur(img, 5, float(rng.uniform(0.6, 1.4)))
            if rng.random() < 0.4:
                img = K.dilate(img, 3)
        cell = K.centre(K.resize(img, side, side))
        noise = rng.integers(0, 30, cell.shape)
        x[k] = np.clip(cell.astype(int) + noise, 0, 255)
    return x, y


def photo_samples(photos: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Cells as the solver cuts them from drawn photos of random digits, of several sizes and slightly tilted."""
    rng, x, y = np.random.default_rng(seed), [], []
    for _ in range(photos):
        digits = rng.integers(0, 10, 81)
        img = draw.draw_puzzle("".join(map(str, digits)), int(rng.integers(320, 480)), 20)
        h, w = img.shape
        edge = [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]
        tilt = K.homography(edge, [(a + rng.uniform(-1, 1) * 0.02 * w + (0.03 * w if a == 0 else -0.03 * w), b + rng.uniform(-1, 1) * 0.02 * h + (0.03 * h if b == 0 else -0.03 * h)) for a, b in edge])
        if rng.random() < 0.6:
            img = 255 - K.warp(255 - img, tilt, w, h)
        ink, quad = prepare(img)
        grid = K.rectify(ink, quad, GRID) if quad else None
        if grid is not None:
            x += K.split_cells(grid)
            y += digits.tolist()
    return np.stack(x), np.array(y)


def digit_model(photos: int = 30, epochs: int = 8, seed: int = 1) -> nn.Model:
    """A classifier trained here on cells of drawn photos."""
    x, y = photo_samples(photos, seed)
    flat = (x.reshape(len(x), -1) / 255).astype(np.float32)
    n = int(len(x) * 0.8)
    return nn.train_local(nn.Model(seed=seed), flat[:n], y[:n], flat[n:], y[n:], epochs, 32, 0.05, seed=seed)[0]


def digit_files(n: int, seed: int = 1) -> list[tuple[str, bytes, int]]:
    """(name, PNG, label) of drawn digits, named as the loader of folders expects."""
    x, y = glyph_samples(n, seed=seed)
    return [(f"digit_{k:05d}_label_{d}.png", draw.png_encode(img), int(d)) for k, (img, d) in enumerate(zip(x, y, strict=True))]


def solved_share(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
