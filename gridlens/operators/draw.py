"""Drawing on RGB arrays: digits, lines, rectangles, the solved grid; and a PNG codec."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

from gridlens.operators.kernels import homography

#: The common 5 x 7 dot-matrix shapes of the digits 0..9, a row of five bits each.
GLYPHS = (
    (14, 17, 19, 21, 25, 17, 14),
    (4, 12, 4, 4, 4, 4, 14),
    (14, 17, 1, 2, 4, 8, 31),
    (31, 2, 4, 2, 1, 17, 14),
    (2, 6, 10, 18, 31, 2, 2),
    (31, 16, 30, 1, 1, 17, 14),
    (6, 8, 16, 30, 17, 17, 14),
    (31, 1, 2, 4, 8, 8, 8),
    (14, 17, 17, 14, 17, 17, 14),
    (14, 17, 17, 15, 1, 2, 12),
)


def glyph(digit: int, scale: int = 1) -> np.ndarray:
    """Mask of a digit, 7 x 5 times a whole scale."""
    bits = np.array([[row >> (4 - c) & 1 for c in range(5)] for row in GLYPHS[digit]], bool)
    return np.kron(bits, np.ones((scale, scale), bool))


def put_digit(img: np.ndarray, digit: int, x: int, y: int, size: int, colour) -> None:
    """In place, gray or RGB, clipped."""
    mask = glyph(digit, max(1, size // 7))
    h, w = img.shape[:2]
    ys, xs = np.nonzero(mask)
    ok = (ys + y >= 0) & (ys + y < h) & (xs + x >= 0) & (xs + x < w)
    img[ys[ok] + y, xs[ok] + x] = colour


def put_line(img: np.ndarray, a: tuple[int, int], b: tuple[int, int], colour, thick: int = 1) -> None:
    """The pixels nearest to the line, each with a square brush."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1)
    t = np.arange(n + 1) / n
    xs = np.floor(a[0] + t * (b[0] - a[0]) + 0.5).astype(int)
    ys = np.floor(a[1] + t * (b[1] - a[1]) + 0.5).astype(int)
    h, w = img.shape[:2]
    for d in range(-(thick // 2), thick - thick // 2):
        for e in range(-(thick // 2), thick - thick // 2):
            ok = (ys + d >= 0) & (ys + d < h) & (xs + e >= 0) & (xs + e < w)
            img[ys[ok] + d, xs[ok] + e] = colour


def put_rectangle(img: np.ndarray, x: int, y: int, w: int, h: int, colour, thick: int = 1) -> None:
    right, low = x + w - 1, y + h - 1
    for a, b in (((x, y), (right, y)), ((right, y), (right, low)), ((right, low), (x, low)), ((x, low), (x, y))):
        put_line(img, a, b, colour, thick)


def fill_rectangle(img: np.ndarray, x: int, y: int, w: int, h: int, colour) -> None:
    img[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] = colour


@lru_cache(maxsize=4096)
def _spot(cell: int, digit: int, h: int, w: int) -> np.ndarray:
    """Flat indices of the pixels that a digit lights in a cell of a grid h x w; two thirds of the cell high."""
    ch, cw = h / 9, w / 9
    size = int(min(ch, cw) * 2 / 3)
    wide, tall = 5 * max(1, size // 7), 7 * max(1, size // 7)
    lit = np.zeros((h, w), bool)
    put_digit(lit, digit, int(cell % 9 * cw + (cw - wide) / 2), int(cell // 9 * ch + (ch - tall) / 2), size, True)
    return np.flatnonzero(lit)


def _open_spots(clues: str, solution: str, h: int, w: int) -> np.ndarray:
    """Flat indices of the pixels that the digits light which the clues leave open."""
    spots = [_spot(i, int(b), h, w) for i, (a, b) in enumerate(zip(clues, solution, strict=True)) if a in ".0"]
    return np.concatenate(spots) if spots else np.zeros(0, np.intp)


def _coloured(img: np.ndarray, at: np.ndarray, colour) -> np.ndarray:
    """A copy whose pixels at flat indices have the colour."""
    out = img.copy(order="C")
    flat = out.reshape(img.shape[0] * img.shape[1], -1)
    for k, v in enumerate(np.broadcast_to(colour, flat.shape[1]).tolist()):
        flat[at, k] = v
    return out


def solved_grid(img: np.ndarray, clues: str, solution: str, colour=(255, 0, 0)) -> np.ndarray:
    """The digits that the clues leave open, on an image that is the grid; two thirds of a cell high."""
    return _coloured(img, _open_spots(clues, solution, *img.shape[:2]), colour)


class Carrier:
    """Carries pixels of a flat grid of ``size`` to a quadrilateral of photos h x w; one serves all photos of that shape and quadrilateral."""

    def __init__(self, h: int, w: int, quad: list[tuple[float, float]], size: int):
        self.size, edge = size, size - 1
        m = homography(quad, [(0, 0), (edge, 0), (edge, edge), (0, edge)])
        photo, flat = np.zeros(0, np.intp), np.zeros(0, np.intp)
        if m is not None:
            y, x = np.mgrid[0:h, 0:w]
            p = np.einsum("ij,jyx->iyx", m, np.stack([x, y, np.ones_like(x)]).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                u, v = np.round(p[0] / p[2]), np.round(p[1] / p[2])
            ok = (u >= 0) & (u < size) & (v >= 0) & (v < size)
            photo, flat = np.flatnonzero(ok), v[ok].astype(np.intp) * size + u[ok].astype(np.intp)
        order = np.argsort(flat.astype(np.uint16) if size * size <= 1 << 16 else flat, kind="stable")  # linear on 16 bits
        self.photo = photo[order]
        self.n = np.bincount(flat, minlength=size * size)
        self.start = np.cumsum(self.n) - self.n

    def __call__(self, at: np.ndarray) -> np.ndarray:
        """Flat indices of the photo's pixels that fall on the given ones of the grid."""
        n = self.n[at]
        return self.photo[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def solved_photo(img: np.ndarray, quad: list[tuple[float, float]], clues: str, solution: str, size: int = 252, colour=(255, 0, 0), carrier: Carrier | None = None) -> np.ndarray:
    """The same on a photo: digits are drawn on a flat grid and carried to the quadrilateral, by ``carrier`` if one is at hand."""
    carry = carrier or Carrier(*img.shape[:2], quad, size)
    return _coloured(img, carry(_open_spots(clues, solution, carry.size, carry.size)), colour)


def contact_sheet(cells: list[np.ndarray], colour=(255, 0, 0)) -> np.ndarray:
    """81 gray cells in 9 x 9, with lines of one pixel between and around them."""
    s = cells[0].shape[0]
    out = np.zeros((9 * s + 10, 9 * s + 10, 3), np.uint8)
    out[:: s + 1], out[:, :: s + 1] = colour, colour
    for k, c in enumerate(cells):
        y, x = k // 9 * (s + 1) + 1, k % 9 * (s + 1) + 1
        out[y : y + s, x : x + s] = c[..., None]
    return out


def draw_puzzle(grid: str, size: int = 300, border: int = 20) -> np.ndarray:
    """A synthetic photo (gray, dark on white) of a puzzle: lines and the clues."""
    img = np.full((size + 2 * border, size + 2 * border), 255, np.uint8)
    for k in range(10):
        at = border + k * (size - 1) // 9
        thick = 3 if k % 3 == 0 else 1
        put_line(img, (border, at), (border + size - 1, at), 0, thick)
        put_line(img, (at, border), (at, border + size - 1), 0, thick)
    cell = size / 9
    for i, c in enumerate(grid):
        if c in "123456789":
            put_digit(img, int(c), int(border + i % 9 * cell + cell * 0.3), int(border + i // 9 * cell + cell * 0.2), int(cell * 0.65), 0)
    return img


def png_encode(img: np.ndarray) -> bytes:
    """Gray or RGB, 8 bits."""
    h, w = img.shape[:2]
    kind = 0 if img.ndim == 2 else 2
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, -1)], axis=1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")
