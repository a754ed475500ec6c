import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.operators import draw, kernels as K, stencils as X
from gridlens.operators.images import images


@pytest.fixture(scope="module")
def photos():
    rng = np.random.default_rng(1)
    return [rng.integers(0, 256, (h, w), dtype=np.uint8) for h, w in ((8, 8), (5, 13), (1, 9), (30, 22))]


def test_kernels_match_columns(spark, sf):
    df = images(spark, sf).limit(40)
    forms = {"dilate": X.dilate("px", 8, 8), "erode": X.erode("px", 8, 8), "median": X.median("px", 8, 8), "gradient": X.sobel("px", 8, 8), "blur": X.gaussian_blur("px", 8, 8), "small": X.resize("px", 8, 8, 6, 6), "centred": X.centre("px", 8, 8)}
    kernels = {"dilate": K.dilate, "erode": K.erode, "median": K.median, "gradient": K.gradient, "blur": K.gaussian_blur, "small": lambda a: K.resize(a, 6, 6), "centred": K.centre}
    for r in df.select("px", *[c.alias(n) for n, c in forms.items()]).collect():
        img = np.array(r.px, np.uint8).reshape(8, 8)
        for n, k in kernels.items():
            assert np.abs(k(img).ravel().astype(int) - np.array(r[n])).max() <= (1 if n in ("blur", "small") else 0), n


def test_order(photos):
    for img in photos:
        assert (K.dilate(img) >= img).all() and (K.erode(img) <= img).all()
        assert (K.erode(img, 1) == img).all()


def brute_labels(mask):
    h, w = mask.shape
    out = np.full((h, w), -1)
    for s in range(h * w):
        if mask.flat[s] and out.flat[s] < 0:
            stack = [divmod(s, w)]
            while stack:
                y, x = stack.pop()
                if 0 <= y < h and 0 <= x < w and mask[y, x] and out[y, x] < 0:
                    out[y, x] = s
                    stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def test_components():
    rng = np.random.default_rng(2)
    for shape in ((1, 1), (1, 20), (17, 1), (12, 15), (40, 33)):
        for share in (0.3, 0.55, 0.7, 1.0):
            mask = rng.random(shape) < share
            assert (K.label(mask) == brute_labels(mask)).all()


def test_pixels_of_128():
    cell = np.zeros((5, 5), np.uint8)
    cell[0, 0:3] = 128  # belongs, but starts nothing
    assert not K.remove_border_noise(cell).any()
    cell[0, 1] = 200
    assert (K.remove_border_noise(cell)[0, :3] > 0).all()


def test_otsu():
    assert K.otsu(np.full((4, 4), 9, np.uint8)) == 0
    assert 10 <= K.otsu(np.array([[10, 10, 12], [200, 201, 199]], np.uint8)) < 199


def test_empty_cells():
    cell = np.zeros(100, np.uint8)
    cell[:5] = 255
    assert not K.is_empty(cell) and K.is_empty(np.where(np.arange(100) < 4, 255, 0))


def test_geometry():
    quad = [(10.0, 12.0), (90.0, 8.0), (95.0, 88.0), (6.0, 92.0)]
    square = [(0, 0), (50, 0), (50, 50), (0, 50)]
    h = K.homography(quad, square)
    for (x, y), (u, v) in zip(quad, square, strict=True):
        p = h @ [x, y, 1]
        assert np.allclose(p[:2] / p[2], (u, v))
    assert K.homography([(0, 0), (1, 1), (2, 2), (3, 3)], square) is None
    img = np.random.default_rng(0).integers(0, 256, (20, 30), dtype=np.uint8)
    same = K.warp(img, np.eye(3), 30, 20)
    assert (same[:-1, :-1] == img[:-1, :-1]).all() and not same[-1].any()
    assert K.warp(img, np.zeros((3, 3)), 5, 5) is None
    assert K.solve_linear(np.array([[0.0, 2.0], [4.0, 0.0]]), np.array([2.0, 8.0])).tolist() == [2.0, 1.0]


def test_canny():
    img = np.zeros((20, 20), np.uint8)
    img[:, 10:] = 60
    edges = K.canny(img, 100, 200)
    assert set(np.unique(edges)) <= {0, 255} and edges[5, 10] == 255 and edges[5, 3] == 0
    assert not K.canny(img, 300, 400).any()


def test_quad_by_blob_and_by_lines():
    img = 255 - draw.draw_puzzle("." * 81, 300, 20)
    quad = K.find_quad(img)
    for got, want in zip(quad, [(20, 20), (320, 20), (320, 320), (20, 320)], strict=True):
        assert abs(got[0] - want[0]) <= 2 and abs(got[1] - want[1]) <= 2
    lines = np.zeros((200, 200), np.uint8)
    for k in range(20, 181):
        if k % 4:  # broken lines: no blob is large enough
            lines[30, k] = lines[170, k] = lines[k, 40] = lines[k, 160] = 255
    quad = K.find_quad(lines)
    for got, want in zip(quad, [(40, 30), (160, 30), (160, 170), (40, 170)], strict=True):
        assert abs(got[0] - want[0]) <= 2 and abs(got[1] - want[1]) <= 2
    assert K.find_quad(np.zeros((50, 50), np.uint8)) is None


def test_augment_keeps_range():
    img = np.random.default_rng(0).random((28, 28))
    out = K.augment(img, 3)
    assert out.shape == img.shape and out.min() >= 0 and out.max() <= 1
    assert (K.augment(img, 3) == out).all() and (K.augment(img, 4) != out).any()
    assert np.allclose(K.augment(img, 1, 0, 0, 0), img)


def test_drawing():
    img = np.zeros((40, 60, 3), np.uint8)
    draw.put_digit(img, 8, 50, 30, 14, (255, 0, 0))  # clipped
    draw.put_line(img, (0, 0), (59, 39), (0, 255, 0), 3)
    draw.put_rectangle(img, 5, 5, 10, 8, (0, 0, 255))
    draw.fill_rectangle(img, -3, 36, 6, 10, (9, 9, 9))
    assert img[0, 0, 1] == 255 and img[5, 14, 2] == 255 and img[12, 5, 2] == 255 and (img[38, 0] == 9).all()
    wide = draw.solved_grid(np.zeros((90, 180, 3), np.uint8), "1" * 80 + ".", "1" * 80 + "7")
    y, x = np.nonzero(wide[..., 0])
    assert y.min() >= 80 and x.min() >= 160
    sheet = draw.contact_sheet([np.full((28, 28), k, np.uint8) for k in range(81)])
    assert sheet.shape == (262, 262, 3) and (sheet[0] == (255, 0, 0)).all() and sheet[30, 30, 0] == 10


def test_map_images(spark):
    rows = [(k, {"width": 3, "height": 2, "data": bytearray(range(6))}) for k in range(3)] + [(9, None)]
    df = spark.createDataFrame(rows, "id int, image struct<width:int,height:int,data:binary>")
    out = {r.id: r.image for r in K.map_images(df, lambda a: 255 - a).collect()}
    assert out[9] is None and bytes(out[0].data) == bytes(255 - k for k in range(6))
    assert F is not None
