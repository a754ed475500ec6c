import numpy as np
import pytest

from gridlens.operators import draw, kernels as K
from gridlens.plans import solver
from gridlens.plans.catalogue import PUZZLES
from gridlens.sources.files import read_puzzle
from gridlens.sources.png import decode_png
from gridlens.streaming import solve as stream


@pytest.fixture(scope="module")
def model():
    return solver.digit_model()


def tilted(img):
    h, w = img.shape
    quad = [(30, 20), (w - 10, 35), (w - 25, h - 12), (12, h - 30)]
    m = K.homography([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], quad)
    return 255 - K.warp(255 - img, m, w, h)


def test_photos(spark, model):
    flat = draw.draw_puzzle(PUZZLES[1], 400, 20)
    photos = {"flat": flat, "tilted": tilted(flat), "colour": np.repeat(flat[..., None], 3, axis=2), "blank": np.full((300, 300), 255, np.uint8)}
    rows = [(n, a.shape[1], a.shape[0], 1 if a.ndim == 2 else a.shape[2], bytearray(a.tobytes())) for n, a in photos.items()]
    got = {r.origin: r for r in solver.solve_photos(spark.createDataFrame(rows, "origin string, width int, height int, channels int, data binary"), model).collect()}
    want = PUZZLES[4]
    for n in ("flat", "colour", "tilted"):
        assert got[n].status == "solved", n
    assert got["flat"].clues == PUZZLES[1] and got["flat"].solution == want
    assert got["blank"].status == "no grid"
    image = decode_png(bytes(got["flat"].image))
    assert image.shape == (440, 440, 3) and ((image == (255, 0, 0)).all(axis=2)).sum() > 500


def test_stream(spark, model, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(draw.png_encode(draw.draw_puzzle(PUZZLES[1], 400, 20)))
    (tmp_path / "in" / "b.png").write_bytes(b"broken")
    for _ in range(2):  # the second run finds nothing new
        stream.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), model).awaitTermination(120)
    rows = {r.origin.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["a.png"].solution == PUZZLES[4] and rows["b.png"].status == "unreadable"


def test_event_windows(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events"))
    q = stream.stage_log(spark, str(tmp_path / "events")).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg({"n": "sum"}).first()[0] == 1000


def test_puzzle_text(spark, tmp_path):
    lines = ["A title:"] + [" ".join(PUZZLES[2][r * 9 : r * 9 + 9]) + " " for r in range(9)]
    (tmp_path / "p.txt").write_text("\n".join(lines))
    assert read_puzzle(spark, str(tmp_path / "p.txt")) == PUZZLES[2]


def test_drawings_share_their_homography(spark, sf, monkeypatch):
    """The homography of a quadrilateral is fitted once for many photos, and each is coloured pixel by pixel as by hand."""
    fits, size, quad = [], 90, [(3.0, 5.0), (120.0, 9.0), (110.0, 95.0), (8.0, 90.0)]
    monkeypatch.setattr(draw, "homography", lambda *a: fits.append(1) or K.homography(*a))
    carrier = draw.Carrier(100, 130, quad, size)
    m = K.homography(quad, [(0, 0), (size - 1, 0), (size - 1, size - 1), (0, size - 1)])
    for clues in (PUZZLES[1], "." * 81, PUZZLES[4]):
        img = np.random.default_rng(1).integers(0, 200, (100, 130, 3), dtype=np.uint8)
        got = draw.solved_photo(img, quad, clues, PUZZLES[4], size, carrier=carrier)
        flat = draw.solved_grid(np.zeros((size, size), np.uint8), clues, PUZZLES[4], 1)
        for y in range(100):
            for x in range(130):
                u, v, w = m @ (x, y, 1.0)
                u, v = round(u / w), round(v / w)
                lit = 0 <= u < size and 0 <= v < size and flat[v, u]
                assert tuple(got[y, x]) == ((255, 0, 0) if lit else tuple(img[y, x])), (x, y)
    assert len(fits) == 1


def test_drawings_are_dealt(spark, sf):
    """The customers' few splits hold much work each, so rows are dealt out before they are drawn."""
    from gridlens.plans.catalogue import QUERIES

    assert spark.read.parquet(f"{sf}/customer.parquet").rdd.getNumPartitions() == 1
    assert QUERIES["solved_drawings"](spark, sf).rdd.getNumPartitions() == 4
