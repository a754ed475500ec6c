import numpy as np

from gridlens.operators import nn
from gridlens.plans import programs as P, solver
from gridlens.sources import files, records as R
from test_sources import RESULTS


def test_prepare_train_evaluate(spark, tmp_path):
    (tmp_path / "folder").mkdir()
    made = solver.digit_files(90, seed=3)
    for name, body, _ in made:
        (tmp_path / "folder" / name).write_bytes(body)
    assert P.prepare_digits(spark, str(tmp_path / "folder"), str(tmp_path / "out")) .keys() == {"train", "test"}
    train = R.read_framed(spark, str(tmp_path / "out" / "train"), drop_zero=False)
    test = R.read_framed(spark, str(tmp_path / "out" / "test"), drop_zero=False)
    assert (train.count(), test.count()) == (62, 28)  # int(90 * 0.7)
    x, y = solver.glyph_samples(90, seed=4)
    (tmp_path / "i").write_bytes(R.idx_bytes(x))
    (tmp_path / "l").write_bytes(R.idx_label_bytes(y))
    (tmp_path / "p.txt").write_text("EPOCHS=2\nLEARNING_RATE=0.1\n")
    data = P.samples(spark, str(tmp_path / "i"), str(tmp_path / "l"), [str(tmp_path / "out" / "train"), str(tmp_path / "none")])
    digits = sum(d > 0 for d in y) + train.where("label > 0").count()
    assert data.count() == digits + digits // 9 and data.where("label = 0").count() == digits // 9
    model, history = P.train(spark, data, str(tmp_path / "w"), str(tmp_path / "p.txt"), batches=3)
    assert len(history) == 2
    again = files.read_weights(spark, str(tmp_path / "w" / "weights.bin"))
    assert all((again.weights[k] == model.weights[k]).all() for k in nn.NAMES)
    confusion, classes = P.evaluate(data, again)
    matrix = P.as_matrix(confusion)
    assert matrix.sum() == data.count()
    for r in classes.collect():
        assert r.tp == matrix[r["class"], r["class"]] and r.tp + r.fn == matrix[r["class"]].sum()
        assert r.line.startswith(f"class {r['class']}:")


def test_search(spark, tmp_path):
    x, y = solver.glyph_samples(60, side=12)
    df = spark.createDataFrame([((img.ravel() / 255).tolist(), int(d)) for img, d in zip(x, y, strict=True)], "pixels array<float>, label int")
    found = P.search(spark, df, str(tmp_path / "best"), nn.Model(side=12, kernel=3, maps=(2, 4), hidden=8), epochs=1)
    assert found.count() == 6
    best = files.read_parameters(spark, str(tmp_path / "best"))
    assert best["EPOCHS"] == 1 and best["LEARNING_RATE"] in (0.005, 0.01, 0.02)


def test_analyse(spark, tmp_path):
    head = ["epochs", "batch_size", "learning_rate", "momentum", "accuracy", "avg_f1_score", "training_time", *[f"{m}_{d}" for d in range(10) for m in files.METRICS]]
    lines = [",".join(head)] + [",".join(map(str, [20, 32, lr, m, a, f, t, *[0.9] * 30])) for lr, m, a, f, t in RESULTS]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    out = P.analyse(spark, str(tmp_path / "r.csv"), str(tmp_path / "tex"))
    assert out["top"].count() == 6 and out["frontier"].count() == 1 and out["marginals"].count() == 7
    assert out["advice"].first().best_score == 0.99
    text = [r.value for r in spark.read.text(str(tmp_path / "tex")).collect()]
    assert len(text) == 5 and text[0].startswith("1 & 20.0 & 32.0 & 0.0200")
    assert np.isclose(out["summary"].where("metric = 'accuracy'").first().mean_value, sum(r[2] for r in RESULTS) / len(RESULTS))
