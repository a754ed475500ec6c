import numpy as np
import pytest

from gridlens.operators import nn
from gridlens.operators.images import images
from gridlens.plans import solver
from gridlens.sources import files


def test_shapes():
    m = nn.Model()
    assert m.flat == 256 and m.size() == 34622
    assert len(files.weights_bytes(m)) == 138_492


def test_gradients_of_all_layers():
    m = nn.Model(side=12, kernel=3, maps=(2, 3), hidden=7)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    rng = np.random.default_rng(0)
    x, y = rng.random((4, 144)).astype(np.float32), np.array([1, 0, 3, 9])
    grads, _ = nn.gradients(m, x, y)
    for k in nn.NAMES:
        flat = m.weights[k].reshape(-1)
        for i in rng.choice(flat.size, min(5, flat.size), replace=False):
            old, h = flat[i], 1e-5
            flat[i] = old + h
            up = nn.gradients(m, x, y)[1]
            flat[i] = old - h
            down = nn.gradients(m, x, y)[1]
            flat[i] = old
            assert grads[k].reshape(-1)[i] == pytest.approx((up - down) / (2 * h), abs=2e-3), k


def test_pool_takes_the_first_of_equals():
    out, which = nn.pool(np.ones((1, 1, 2, 2)))
    assert out.item() == 1 and which.item() == 0
    back = nn.unpool(np.full((1, 1, 1, 1), 5.0), which, (1, 1, 2, 3))
    assert back.ravel().tolist() == [5, 0, 0, 0, 0, 0]


def test_weights_round_trip(spark, tmp_path):
    m = nn.Model(seed=5)
    (tmp_path / "w.bin").write_bytes(files.weights_bytes(m))
    again = files.read_weights(spark, str(tmp_path / "w.bin"))
    assert all((again.weights[k] == m.weights[k]).all() for k in nn.NAMES)
    with pytest.raises(ValueError):
        files.weights_from(files.weights_bytes(m)[:-1])
    with pytest.raises(ValueError):
        files.weights_from(b"\0" * 138_492)


def test_training_over_a_cluster(spark):
    x, y = solver.glyph_samples(300, side=28)
    rows = [(k, (img.ravel() / 255).tolist(), int(d)) for k, (img, d) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, pixels array<float>, label int").repartition(4).cache()
    m = nn.Model()
    grads, loss, n = nn.batch_gradients(df, m)
    local, local_loss = nn.gradients(m, np.array([r[1] for r in rows]), y)
    assert n == 300 and loss == pytest.approx(local_loss, rel=1e-4)
    assert all(np.allclose(grads[k], local[k], rtol=1e-3, atol=1e-3) for k in nn.NAMES)
    best, history = nn.train(df, df, m, "id", epochs=3, batches=3, rate=0.1)
    assert max(history) > 0.15 and nn.evaluate(df, best) == pytest.approx(max(history))


def test_predict_keeps_rows(spark, sf):
    df = images(spark, sf).select("vec_id", "px").limit(5)
    m = nn.Model(side=8, kernel=2, maps=(2, 3), hidden=7)
    null = spark.createDataFrame([(-1, None)], "vec_id long, px array<int>")
    rows = nn.predict(df.unionByName(null), m, "px").collect()
    assert len(rows) == 6
    for r in rows:
        assert (r.predicted is None) == (r.px is None)
        if r.px:
            assert sum(r.probabilities) == pytest.approx(1, abs=1e-5) and r.probabilities[r.predicted] == max(r.probabilities)


def test_grid_search(spark):
    x, y = solver.glyph_samples(120, side=12)
    df = spark.createDataFrame([((img.ravel() / 255).tolist(), int(d)) for img, d in zip(x, y, strict=True)], "pixels array<float>, label int")
    configs = spark.createDataFrame([(1, 1, 16, 0.02), (2, 3, 16, 0.05)], "config_id int, epochs int, batch_size int, learning_rate double")
    rows = nn.grid_search(df, configs, nn.Model(side=12, kernel=3, maps=(2, 4), hidden=16)).collect()
    assert {r.config_id for r in rows} == {1, 2} and all(sum(r.confusion) == 36 for r in rows)
