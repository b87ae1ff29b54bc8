"""The registered model queries: what their scores must be, by plain Python or by what they must tell apart."""

from pathlib import Path

import numpy as np
import pytest

from ledgerline import queries as core
from ledgerline.operators import models

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the generated tables are not here")


def ranked(rows):
    """The share of pairs of a positive and a negative in which the positive scores higher."""
    p, n = (np.array([r.score for r in rows if (r.y > 0) == k]) for k in (True, False))
    return np.mean(p[:, None] > n[None, :]) + np.mean(p[:, None] == n[None, :]) / 2


@pytest.mark.parametrize("name", ["logreg_scores", "gbt_scores", "mlp_scores", "network_scores", "boosted_scores"])
def test_classifiers_score_every_row_and_tell_the_label(spark, name):
    rows = core.queries()[name](spark, SF).collect()
    want = {r.row_id: r.y for r in core._training_rows(spark, SF).select("row_id", "y").collect()}
    assert {r.row_id: int(r.y) for r in rows} == want
    assert all(0 <= r.score <= 1 for r in rows) and ranked(rows) > 0.8, ranked(rows)


def test_logistic_scores_are_those_of_the_penalised_optimum(spark):
    rows = core._training_rows(spark, SF).collect()
    x, y = np.array([r.f for r in rows], float), np.array([r.y for r in rows], float)
    w, b, n = np.zeros(x.shape[1]), 0.0, len(y)
    for _ in range(60):  # Newton steps on the mean loss and |w|^2 / (2 n)
        p = 1 / (1 + np.exp(-(x @ w + b)))
        full = np.hstack([x, np.ones((n, 1))])
        grad = full.T @ (p - y) / n + np.append(w / n, 0)
        hess = (full * (p * (1 - p))[:, None]).T @ full / n + np.diag(np.append(np.full(len(w), 1 / n), 0))
        step = np.linalg.solve(hess, grad)
        w, b = w - step[:-1], b - step[-1]
    want = 1 / (1 + np.exp(-(x @ w + b)))
    got = {r.row_id: r.score for r in core.queries()["logreg_scores"](spark, SF).collect()}
    assert np.allclose([got[r.row_id] for r in rows], want, atol=2e-3)


def test_logistic_scores_send_no_model_to_tasks(spark):
    scored = core.queries()["logreg_scores"](spark, SF)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan, plan
    one = models.logistic(spark.createDataFrame([(1, [0.5]), (1, [2.0])], "y int, f array<double>"), spark.createDataFrame([(0, [9.0])], "y int, f array<double>")).first()
    assert one.score == 1.0 and models.logistic(spark.createDataFrame([], "y int, f array<double>"), spark.createDataFrame([(0, [9.0])], "y int, f array<double>")).first().score == 0.5


def test_forest_scores_are_those_of_its_trees(spark):
    rows = core._training_rows(spark, SF)
    got = {r.row_id: r.score for r in core.queries()["iforest_scores"](spark, SF).collect()}
    met, x = models.forest_samples(rows, "f", "row_id", 100, 256, 7).collect(), {r.row_id: np.array(r.f, float) for r in rows.collect()}
    depth, keys = np.zeros(len(x)), sorted(x)
    every = np.array([x[k] for k in keys])
    for t in range(100):
        own = np.array([r.f for r in sorted((r for r in met if r.tree == t), key=lambda r: (r.h, r.k))[:256]], float)
        depth += models._depths(models._tree(own, np.random.default_rng([7, t]), 8), every)
    want = 2.0 ** (-depth / 100 / models._path(256))
    assert np.allclose([got[k] for k in keys], want)


def test_sampled_nodes_are_the_first_by_their_hash(spark):
    labels = core._labels(spark, SF).selectExpr("snapshot_id", "node", "label", "xxhash64(7, node) as h").collect()
    got = core.queries()["sampled_nodes"](spark, SF).collect()
    for y, n in ((1, 20), (0, 40)):
        hashes = sorted((r.h, r.node) for r in labels if r.label == y)[:n]
        assert sorted(r.node for r in got if r.label == y) == sorted(node for _, node in hashes)
    assert {(r.snapshot_id, r.node, r.label) for r in got} <= {(r.snapshot_id, r.node, r.label) for r in labels}


def test_sage_and_convolution_scores_cover_their_rows(spark):
    nodes = {(r.snapshot_id, r.node) for r in core._labels(spark, SF).collect()}
    rows = core.queries()["sage_scores"](spark, SF).collect()
    assert {(r.snapshot_id, r.node) for r in rows} == nodes and len(rows) == len(nodes)
    assert all(0 < r.score < 1 for r in rows) and len({r.score for r in rows}) > len(rows) // 3
