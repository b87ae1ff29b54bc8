import numpy as np
import pytest

from ledgerline.operators import graph, sage, training
from ledgerline.operators.training import Setting

EDGE = "snapshot_id int, src string, dst string, weight double"


def drawn(spark, n=14, m=22, width=3, seed=2):
    """Two random graphs, a lone node each, labels of most nodes; the same as dense arrays."""
    rng, edges, nodes, dense = np.random.default_rng(seed), [], [], []
    for k in range(2):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n - 1, (m, 2)) if a != b})
        near = np.zeros((n, n))
        for a, b in pairs:
            near[a, b] = near[b, a] = 1
        x, y = rng.normal(size=(n, width)), np.where(rng.random(n) < 0.7, rng.integers(0, 2, n), np.nan)
        edges += [(k, f"n{a:02d}", f"n{b:02d}", 1.0) for a, b in pairs]
        nodes += [(k, f"n{i:02d}", x[i].tolist(), None if np.isnan(y[i]) else float(y[i])) for i in range(n)]
        dense.append((near / np.maximum(near.sum(1, keepdims=True), 1), x, y))
    x = spark.createDataFrame(nodes, "snapshot_id int, node string, x array<double>, y double").repartition(3)
    return spark.createDataFrame(edges, EDGE).repartition(2), x, dense


def logits(p, near, x, layers):
    a = x
    for i in range(layers):
        a = np.maximum(near @ a @ p[f"near{i}"] + a @ p[f"root{i}"] + p[f"bias{i}"], 0)
    return a @ p["w"] + p["c"][0]


@pytest.mark.parametrize("layers", [1, 2])
def test_gradient_through_the_joins_is_that_of_the_loss(spark, layers):
    edges, x, dense = drawn(spark)
    g = sage.Graph(edges, x, x.filter("y is not null"))
    p = sage.started(3, 4, layers, np.random.default_rng(5))
    p = {k: v + np.random.default_rng(6).normal(0, 0.1, v.shape) for k, v in p.items()}

    def loss():
        return sum(training.log_loss(logits(p, near, v, layers)[said], y[said], np.where(y[said] > 0, 2.0, 1.0))[0] for near, v, y in dense for said in [~np.isnan(y)])

    flat, found = g.gradient(p, layers, 2.0, Setting())
    assert found == pytest.approx(loss())
    grads = training.parts(p, ())[0].unpack(flat)
    for name, own in grads.items():
        assert own.ravel().tolist() == pytest.approx(training.differences(loss, p[name], range(own.size)), rel=1e-4, abs=1e-6), name
    got = {(r.snapshot_id, r.node): r.score for r in g.scores(p, layers).collect()}
    want = {(k, f"n{i:02d}"): s for k, (near, v, _) in enumerate(dense) for i, s in enumerate(training.sigmoid(logits(p, near, v, layers)))}
    assert got == pytest.approx(want)


def test_a_layer_is_the_one_of_the_inference_operator(spark):
    edges, x, _ = drawn(spark)
    p = sage.started(3, 2, 1, np.random.default_rng(1))
    wide = x.select("snapshot_id", "node", *[x.x[i].alias(f"x{i}") for i in range(3)])
    out = graph.sage_layer(edges, wide, ["x0", "x1", "x2"], p["near0"].T.tolist(), p["root0"].T.tolist(), [0.0, 0.0])
    got = {(r.snapshot_id, r.node): [r.h0, r.h1] for r in out.collect()}
    for r in sage.Graph(edges, x, x.filter("y is not null"))._first(p, 2).collect():
        assert r.a == pytest.approx(got[r.snapshot_id, r.node])


def test_a_label_that_only_neighbours_show_is_learned(spark, tmp_path):
    rng, n = np.random.default_rng(3), 120
    x = rng.normal(size=(n, 1))
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (260, 2)) if a != b})
    near = np.zeros((n, n))
    for a, b in pairs:
        near[a, b] = near[b, a] = 1
    y = (near @ x)[:, 0] > 0
    edges = spark.createDataFrame([(0, f"n{a:03d}", f"n{b:03d}", 1.0) for a, b in pairs], EDGE)
    nodes = spark.createDataFrame([(0, f"n{i:03d}", x[i].tolist(), float(y[i])) for i in range(n)], "snapshot_id int, node string, x array<double>, y double")
    held = nodes.filter("substring(node, 4, 1) in ('0', '5')")
    train = nodes.join(held.select("node"), "node", "left_anti")
    out = sage.sage_scores(edges, nodes, train, Setting(step=0.05, epochs=25), hidden=8, layers=1, val=held, path=str(tmp_path / "state"))
    got = {r.node: r.score for r in out.collect()}
    assert len(got) == n and np.mean([(got[r.node] > 0.5) == (r.y > 0) for r in held.collect()]) > 0.8
    assert [r.score for r in sage.sage_scores(edges, nodes, train.limit(0), Setting()).limit(2).collect()] == [0.5, 0.5]


def test_heavy_nodes_go_by_joins_and_others_exchange_nothing(spark, monkeypatch):
    edges, x, _ = drawn(spark)
    p, found = sage.started(3, 4, 2, np.random.default_rng(5)), []
    for around in (2048, 12, 0):
        monkeypatch.setattr(sage, "AROUND", around)
        g = sage.Graph(edges, x, x.filter("y is not null"))
        assert (g.heavy is None) == (around == 2048)  # before: every epoch joined all arcs
        flat, loss = g.gradient(p, 2, 2.0, Setting())
        found.append((flat.tolist(), loss, {(r.snapshot_id, r.node): r.score for r in g.scores(p, 2).collect()}))
    for flat, loss, scores in found[1:]:
        assert flat == pytest.approx(found[0][0], abs=1e-9) and loss == pytest.approx(found[0][1]) and scores == pytest.approx(found[0][2])
