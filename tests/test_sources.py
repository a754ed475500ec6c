import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.functions import elementwise as E
from gridlens.operators import draw, report, sampling
from gridlens.plans import solver
from gridlens.sources import files, png, records as R


@pytest.fixture(scope="module")
def digits():
    rng = np.random.default_rng(1)
    return rng.integers(0, 256, (50, 5, 4), dtype=np.uint8), np.arange(50) % 10


def test_idx(spark, tmp_path, digits):
    x, y = digits
    (tmp_path / "i").write_bytes(R.idx_bytes(x))
    (tmp_path / "l").write_bytes(R.idx_label_bytes(y))
    rows = R.read_idx(spark, str(tmp_path / "i"), str(tmp_path / "l")).orderBy("sample_id").collect()
    assert [r.label for r in rows] == [d for d in y if d]
    assert np.allclose(rows[0].pixels, x[1].ravel() / 255)
    assert R.read_idx(spark, str(tmp_path / "i"), str(tmp_path / "l"), drop_zero=False).count() == 50
    (tmp_path / "l").write_bytes(R.idx_label_bytes(y[:9]))
    with pytest.raises(ValueError):
        R.read_idx(spark, str(tmp_path / "i"), str(tmp_path / "l"))
    with pytest.raises(Exception, match="magic"):
        R.idx_images(spark, str(tmp_path / "l")).count()


def test_framed(spark, tmp_path, digits):
    x, y = digits
    df = spark.createDataFrame([(int(d), bytearray(img.tobytes())) for d, img in zip(y, x, strict=True)], "label int, pixels binary").coalesce(1)
    assert files.write_files(R.framed_cells(df, 4, 5, per_file=20), str(tmp_path / "out")) == 3
    assert sorted(p.name for p in (tmp_path / "out").glob("part*.bin"))[0] == "part-00000-00000.bin"
    rows = R.read_framed(spark, str(tmp_path / "out"), drop_zero=False).collect()
    assert sorted((r.label, tuple(np.round(np.array(r.pixels) * 255).astype(int))) for r in rows) == sorted((int(d), tuple(img.ravel().tolist())) for d, img in zip(y, x, strict=True))
    assert R.read_framed(spark, str(tmp_path / "out")).count() == 45
    assert R.read_framed(spark, str(tmp_path / "none")).count() == 0
    assert R.framed_bytes(y[:1], x[:1])[:4] == b"\xde\xad\xbe\xef"
    assert R.framed_cells(df.limit(0), 4, 5).count() == 0


def test_big_endian(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\xff\xff\xff\xfe"),)], "b binary")
    r = df.select(E.big_endian_int("b", F.lit(1)).alias("x"), E.big_endian_int("b", F.lit(3)).alias("short")).first()
    assert (r.x, r.short) == (4294967294, 0)


def test_images(spark, tmp_path):
    rgb = np.random.default_rng(0).integers(0, 256, (6, 9, 3), dtype=np.uint8)
    gray = rgb[..., 0]
    (tmp_path / "a_label_3.png").write_bytes(draw.png_encode(rgb))
    (tmp_path / "digit_00012_label_7.png").write_bytes(draw.png_encode(gray))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    rows = {r.origin.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path)).withColumn("label", files.label_of(F.col("origin"))).collect()}
    assert set(rows) == {"a_label_3.png", "digit_00012_label_7.png"}
    assert (files.as_array(rows["a_label_3.png"]) == rgb).all()
    assert (files.as_array(rows["digit_00012_label_7.png"]) == gray).all()
    assert rows["digit_00012_label_7.png"].label == 7 and rows["a_label_3.png"].label is None
    assert (png.decode_png(draw.png_encode(rgb)) == rgb).all() and png.decode_png(b"x") is None


def test_digit_folder(spark, tmp_path):
    made = solver.digit_files(6)
    for name, body, _ in made:
        (tmp_path / name).write_bytes(body)
    (tmp_path / "other.png").write_bytes(made[0][1])
    df = files.read_digit_folder(spark, str(tmp_path))
    rows = {r.origin.rsplit("/", 1)[1]: r for r in df.collect()}
    assert {n: r.label for n, r in rows.items()} == {n: d for n, _, d in made}
    for name, body, _ in made:
        assert np.allclose(rows[name].pixels, png.decode_png(body).ravel() / 255, atol=1e-6)
    assert sorted(r.filename for r in files.digit_metadata(df).collect()) == sorted(rows)


def test_parameters(spark, tmp_path):
    files.write_parameters(spark, str(tmp_path / "p"), {"EPOCHS": 40, "LEARNING_RATE": 0.02}, ["best"])
    (tmp_path / "q.txt").write_text("# note\n\nEPOCHS=40\nLEARNING_RATE=0.0200\nrubbish\nACCURACY=high\n")
    assert files.read_parameters(spark, str(tmp_path / "p")) == {"EPOCHS": 40.0, "LEARNING_RATE": 0.02}
    assert files.read_parameters(spark, str(tmp_path / "q.txt")) == {"EPOCHS": 40.0, "LEARNING_RATE": 0.02}


#: Six made-up configurations: learning rate, momentum, accuracy, F1, seconds.
RESULTS = [(0.02, 0.0, 0.991, 0.99, 100.0), (0.02, 0.9, 0.986, 0.985, 130.5), (0.01, 0.9, 0.981, 0.98, 200.0), (0.01, 0.0, 0.976, 0.972, 210.0), (0.005, 0.9, 0.95, 0.94, 205.0), (0.005, 0.0, 0.9, 0.89, 220.25)]


def test_report(spark, tmp_path):
    names = ["learning_rate", "momentum", "accuracy", "avg_f1_score", "training_time"]
    df = spark.createDataFrame(RESULTS, names).withColumn("epochs", F.lit(20)).withColumn("batch_size", F.lit(32))
    df = df.select("*", *[F.lit(0.5).alias(f"{m}_{d}") for d in range(10) for m in files.METRICS])
    files.write_results(df.coalesce(1), str(tmp_path / "r"))
    back = files.read_results(spark, str(tmp_path / "r"))
    assert len(back.columns) == 38
    scores = [r[3] for r in RESULTS]
    s = {r.metric: r for r in report.summary(back, ["accuracy", "avg_f1_score", "training_time"]).collect()}
    assert (s["accuracy"].min_value, s["accuracy"].max_value) == (0.9, 0.991)
    assert s["avg_f1_score"].mean_value == pytest.approx(np.mean(scores))
    m = {(r.parameter, r.value): r for r in report.marginals(back, ["learning_rate", "momentum", "epochs", "batch_size"], "avg_f1_score").collect()}
    assert m["learning_rate", "0.01"].std_score == pytest.approx(np.std([0.98, 0.972], ddof=1))
    assert m["momentum", "0.9"].mean_score == pytest.approx(np.mean([0.985, 0.98, 0.94])) and m["epochs", "20"].n == 6
    front = report.pareto(back, "training_time", "avg_f1_score", "config_id").collect()
    assert [(r.avg_f1_score, r.speedup) for r in front] == [(0.99, 1.0)]
    best = report.ranking(back, "avg_f1_score", "accuracy", "config_id", 5)
    assert [r.avg_f1_score for r in best.orderBy("rank").collect()] == sorted(scores, reverse=True)[:5]
    line = report.latex_rows(best).orderBy("rank").first().line
    assert line == r"1 & 20.0 & 32.0 & 0.0200 & 0.00 & 0.9910 & 0.9900 \\"
    a = report.advice(back, "avg_f1_score", "training_time", "config_id", 0.975).first()
    assert a.best == a.fastest and a.cost_ratio == 1.0


def test_npy(spark, tmp_path):
    df = spark.createDataFrame([(k, (k * 7) % 10) for k in range(1000)], "id long, label int").repartition(7)
    assert files.write_npy(df, str(tmp_path / "labels.npy"), "label", [F.col("id")]) == 1000
    assert np.load(tmp_path / "labels.npy").tolist() == [(k * 7) % 10 for k in range(1000)]
    back = files.read_npy(spark, str(tmp_path / "labels.npy")).orderBy("position").collect()
    assert [(r.position, r.value) for r in back] == [(k, (k * 7) % 10) for k in range(1000)]
    assert files.write_npy(df.limit(0), str(tmp_path / "none.npy"), "label", [F.col("id")]) == 0
    assert np.load(tmp_path / "none.npy").shape == (0,)


def test_write_files_by_executors_and_driver(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(f"f{k}.bin", bytearray([k] * k)) for k in range(40)], "file string, body binary").repartition(5)
    assert files.write_files(df, str(tmp_path / "a")) == 40

    def unknown(_):
        raise ValueError("no such store")

    monkeypatch.setattr(files, "store", type("S", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(unknown)})}))
    assert files.write_files(df, str(tmp_path / "b")) == 40
    for folder in "ab":
        assert {p.name: p.read_bytes() for p in (tmp_path / folder).glob("*.bin")} == {f"f{k}.bin": bytes([k] * k) for k in range(40)}


def test_pareto_frontier(spark):
    rows = [(k, c, s) for k, (c, s) in enumerate([(5, 1), (3, 2), (3, 2), (9, 9), (4, 2), (7, 5), (8, 5), (10, 9), (1, 0), (3, 1)])]
    df = spark.createDataFrame(rows, "id int, cost int, score int")
    got = sorted((r.cost, r.score, r.id) for r in report.pareto(df, "cost", "score", "id").collect())
    assert got == [(1, 0, 8), (3, 2, 1), (7, 5, 5), (9, 9, 3)]
    assert report.pareto(df.limit(0), "cost", "score", "id").collect() == []


def test_sampling(spark):
    df = spark.range(1000).repartition(7)
    a = [r.id for r in sampling.shuffled(df, "id", 3).collect()]
    assert a == [r.id for r in sampling.shuffled(spark.range(1000), "id", 3).collect()] and a != sorted(a)
    rows = sampling.batches(df, sampling.seeded_order("id", 3), 32).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.position)] == a
    sizes = {}
    for r in rows:
        sizes[r.batch] = sizes.get(r.batch, 0) + 1
    assert [sizes[k] for k in range(32)] == [32] * 31 + [8]
    cells = sampling.empty_samples(spark, 50, 8).collect()
    assert all(len(r.pixels) == 64 and r.label == 0 and 0 <= min(r.pixels) and max(r.pixels) <= 0.31 for r in cells)
    with pytest.raises(ValueError):
        sampling.zip_join(spark.range(3), spark.range(4), "id")
    assert sampling.append(spark.range(2).select("id"), spark.range(3).withColumn("x", F.lit(1))).count() == 5
