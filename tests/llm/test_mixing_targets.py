import numpy as np
import pytest

from ledgerline.llm import mixing

DOMAINS = ["high", "low", "toxic"]
TARGETS = {"high": 0.80, "low": 0.18, "toxic": 0.02}


def soft(spark, p, t):
    return spark.createDataFrame([(i, i, int(n), [float(x) for x in q]) for i, (n, q) in enumerate(zip(t, p, strict=True))], "doc_id long, key long, tokens long, posterior array<double>").repartition(3)


def drawn(seed, n=1500, shares=(2.0, 1.2, 0.4)):
    rng = np.random.default_rng(seed)
    return rng.dirichlet(shares, n), np.ceil(rng.lognormal(4, 1.2, n))


def plain(a, want, passes):
    """Accelerated projected gradient in one place, in the metric of the Gram matrix: all iterates."""
    metric = np.linalg.inv(a.T @ a + 1e-9 * np.trace(a.T @ a) / a.shape[1] * np.eye(a.shape[1]))
    value = lambda w: (a.T @ w - want) @ metric @ (a.T @ w - want)
    w = last = np.ones(len(a))
    pace, out = 1.0, [w]
    for _ in range(passes):
        onward = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        y = w + (pace - 1) / onward * (w - last)
        last, w = w, np.maximum(0, y - a @ metric @ (a.T @ y - want))
        pace = onward if value(w) < value(last) else 1.0
        out.append(w)
    return out, value


@pytest.mark.parametrize("shares", [(2.0, 1.2, 0.4), (9.0, 0.5, 0.1)])
def test_every_domain_meets_its_target_by_nonnegative_steps(spark, shares):
    p, t = drawn(5, shares=shares)
    rows = soft(spark, p, t)
    fit = mixing.fit_rates(rows, DOMAINS, TARGETS)
    r = np.array([x.rate for x in mixing.with_rates(rows, fit).orderBy("doc_id").collect()])
    got = (r * t) @ p
    assert np.abs(got / fit.goal - 1).max() < 2 * mixing.CLOSE
    assert np.allclose(got / fit.goal - 1, fit.errors, atol=1e-6)
    a = p * (t / fit.mean)[:, None] * fit.scale
    iterates, _ = plain(a, fit.goal / fit.mean * fit.scale, len(fit.steps))
    assert 0 < len(fit.steps) < 60 and np.allclose(iterates[-1], r, atol=1e-5)
    for k, w in enumerate(iterates):
        assert (w >= 0).all() and np.allclose(w, mixing.rates(a, fit.steps[:k]), atol=1e-5)
    assert any((w == 0).any() for w in iterates)  # the projection took part


def test_the_residual_is_the_least_that_rates_can_reach(spark):
    # high needs more than a tenth of what any document gives: the least squares have a residual
    p, t = drawn(7, 400)
    rows = soft(spark, 0.5 * p + 0.5 * np.array([0.1, 0.8, 0.1]), t)
    with pytest.warns(UserWarning, match="targets missed"):
        fit = mixing.fit_rates(rows, DOMAINS, {"high": 0.95, "low": 0.04, "toxic": 0.01})
    q = 0.5 * p + 0.5 * np.array([0.1, 0.8, 0.1])
    a = q * (t / fit.mean)[:, None] * fit.scale
    iterates, value = plain(a, fit.goal / fit.mean * fit.scale, 3000)
    best = min(value(w) for w in iterates)
    assert best <= value(mixing.rates(a, fit.steps)) <= 1.1 * best


def test_a_target_that_cannot_be_met_is_told(spark):
    rows = soft(spark, [[0.5, 0.4, 0.1], [0.6, 0.3, 0.1], [0.55, 0.35, 0.1]], [10, 20, 30])
    with pytest.warns(UserWarning, match="targets missed"):
        fit = mixing.fit_rates(rows, DOMAINS, {"high": 0.1, "low": 0.1, "toxic": 0.8})
    assert np.abs(fit.errors).max() > 0.1
    assert np.isfinite([x.rate for x in mixing.with_rates(rows, fit).collect()]).all()
