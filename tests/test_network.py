import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import sequence, training
from ledgerline.operators.network import FeedForward, network
from ledgerline.operators.training import Setting

MODELS = [FeedForward(12, (5, 3)), sequence.Recurrent(4, 3, 5), sequence.Attention(4, 3, 8, 2), sequence.Convolution(2, 4, 3)]


def drawn(model, n=9, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 18 if isinstance(model, sequence.Convolution) else 12))
    mask = (rng.random((n, 4)) < 0.7).astype(float)
    p = {k: v + rng.normal(0, 0.1, v.shape) for k, v in model.start(rng).items()}  # no unit at its bend
    return p, x, mask, rng.integers(0, 2, n).astype(float), rng


@pytest.mark.parametrize("model", MODELS, ids=lambda m: type(m).__name__)
def test_gradient_is_that_of_the_loss(model):
    p, x, mask, y, rng = drawn(model)
    if isinstance(model, sequence.Convolution):
        p["mean"], p["square"] = rng.normal(size=4), 2 + rng.random(4)
    scale, keep = np.where(y > 0, 3.0, 1.0), lambda name, units: (np.arange(units) % 3 > 0) * 1.5
    loss = lambda: model.gradient(p, x, mask, y, scale, keep)[1]
    grads, _ = model.gradient(p, x, mask, y, scale, keep)
    assert set(grads) == set(p) - set(getattr(model, "stats", ()))
    for name, g in grads.items():
        places = rng.choice(g.size, min(g.size, 12), replace=False).tolist()
        assert [g.flat[j] for j in places] == pytest.approx(training.differences(loss, p[name], places), rel=1e-4, abs=1e-6), name


@pytest.mark.parametrize("model", MODELS[1:3], ids=lambda m: type(m).__name__)
def test_masked_steps_have_no_influence(model):
    p, x, mask, y, rng = drawn(model)
    other = x.reshape(-1, 4, 3).copy()
    other[mask == 0] = rng.normal(size=(int((mask == 0).sum()), 3)) * 100
    assert np.allclose(model.logits(p, x, mask), model.logits(p, other.reshape(len(x), -1), mask))
    assert np.isfinite(model.logits(p, x, np.zeros_like(mask))).all()
    assert not np.allclose(model.logits(p, x, mask), model.logits(p, -x, mask))


def windows_of(spark, n=240):
    """Positive where the last valid step is above the first valid one."""
    rng, rows = np.random.default_rng(4), []
    for i in range(n):
        m = rng.random(4) < 0.8
        m[rng.integers(4)] = True
        v = rng.normal(size=(4, 2)) * m[:, None]
        at = np.flatnonzero(m)
        rows.append((i, int(v[at[-1], 0] > v[at[0], 0] + 0.2), [float(z) for z in v.ravel()], [bool(z) for z in m]))
    return spark.createDataFrame(rows, "row_id int, y int, x array<float>, mask array<boolean>").repartition(3)


@pytest.mark.parametrize("model", [sequence.Recurrent(4, 2, 8), sequence.Attention(4, 2, 8, 2)], ids=lambda m: type(m).__name__)
def test_sequence_models_learn_an_order(spark, model):
    rows = windows_of(spark)
    p = training.train(model, rows, None, Setting(step=0.05, epochs=40), mask="mask")
    out = training.scored(model, p, rows, mask="mask").collect()
    assert len(out) == 240 and np.mean([(r.score > 0.5) == r.y for r in out]) > 0.8


def test_a_stopped_run_goes_on_as_if_it_had_not(spark, tmp_path):
    model, rows = sequence.Recurrent(4, 2, 4), windows_of(spark, 90)
    val = rows.filter("row_id % 3 = 0")
    setting = {"step": 0.03, "dropout": 0.2, "every": 2, "patience": 9, "save_every": 3}
    straight = training.train(model, rows, val, Setting(epochs=8, **setting), mask="mask")
    path = str(tmp_path / "state")
    training.train(model, rows, val, Setting(epochs=5, **setting), mask="mask", path=path)
    again = training.train(model, rows, val, Setting(epochs=8, **setting), mask="mask", path=path)
    for k in straight:
        assert np.allclose(straight[k], again[k], rtol=1e-6, atol=1e-9)
    stored = {r.row_id: r.score for r in training.rescored(model, path, rows, mask="mask").collect()}
    assert stored == pytest.approx({r.row_id: r.score for r in training.scored(model, again, rows, mask="mask").collect()})


def test_dropout_does_not_depend_on_partitions(spark):
    model, rows = FeedForward(8, (6,)), windows_of(spark, 60)
    a, b = (training.train(model, rows.repartition(k), None, Setting(epochs=3, dropout=0.5)) for k in (1, 4))
    assert all(np.allclose(a[k], b[k], rtol=1e-6, atol=1e-9) for k in a)
    u = training.chances(np.arange(2000), 50, 7, 1)
    assert abs(u.mean() - 0.5) < 0.01 and len(np.unique(u)) == u.size and u.min() >= 0 and u.max() < 1


def test_maps_are_normalised_over_all_tasks(spark):
    model = sequence.Convolution(2, 3, 4)
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, (80, 18)).astype(np.float32)
    rows = spark.createDataFrame([(i, int(v[4] > 3), [float(z) for z in v]) for i, v in enumerate(x)], "row_id int, y int, x array<float>").repartition(4)
    p = training.train(model, rows, None, Setting(epochs=1))
    z = model.patches(x.astype(float)) @ model.start(np.random.default_rng(7))["k"]
    assert np.allclose(p["mean"], z.mean((0, 1))) and np.allclose(p["square"], (z * z).mean((0, 1)))
    p = training.train(model, rows, None, Setting(epochs=60, step=0.05))
    assert np.mean([(r.score > 0.5) == r.y for r in training.scored(model, p, rows).collect()]) > 0.8


def test_learns_a_rule_that_no_line_parts(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (400, 2))
    rows = spark.createDataFrame([(i, int(a * b > 0), [float(a), float(b)]) for i, (a, b) in enumerate(x)], "row_id long, y int, f array<double>").repartition(2, "row_id")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    train, val = rows.filter("row_id % 4 <> 0"), rows.filter("row_id % 4 = 0")
    out = network(train, val, 2, hidden=(16,), val=val, step=0.05, dropout=0.1, epochs=30, every=15).collect()
    assert {r.row_id for r in out} == set(range(0, 400, 4)) and all(0 <= r.score <= 1 for r in out)
    assert np.mean([(r.score > 0.5) == r.y for r in out]) > 0.85


def test_no_training_rows(spark):
    rows = spark.createDataFrame([(1, 1, [1.0])], "row_id long, y int, f array<double>")
    assert [r.score for r in network(rows.filter("y = 0"), rows, 1).collect()] == [0.5]
    assert [0 <= r.score <= 1 for r in network(rows, rows, 1, epochs=2).collect()] == [True]
