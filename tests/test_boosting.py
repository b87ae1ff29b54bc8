import numpy as np
import pytest

from ledgerline.operators import boosting, models, neighbourhood
from ledgerline.operators.boosting import Setting
from ledgerline.operators.training import chances


def rows_of(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    y = (x[:, 0] * x[:, 1] > 0) | (rng.random(n) < 0.05)
    df = spark.createDataFrame([(i, int(t), v.tolist()) for i, (v, t) in enumerate(zip(x, y, strict=True))], "row_id int, y int, f array<double>").repartition(3)
    return df, x, y.astype(float)


def plain(x, y, cuts, s):
    """The same trees, row by row over all nodes; (features, cuts, values) by tree, margins."""
    b = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], 1)
    margin, out = np.zeros(len(y)), []
    for _ in range(s.trees):
        p, w = 1 / (1 + np.exp(-margin)), np.where(y > 0, s.weight, 1.0)
        g, h, nodes, add = w * (p - y), w * p * (1 - p), {}, np.zeros(len(y))

        def grow(at, own, depth):
            score = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.l2)  # noqa: B023, E731
            best = None
            for f in range(x.shape[1]) if depth < s.depth else ():
                for c in range(max(map(len, cuts))):
                    left, right = own & (b[:, f] <= c), own & (b[:, f] > c)
                    if h[left].sum() < s.least or h[right].sum() < s.least:  # noqa: B023
                        continue
                    gain = round(0.5 * (score(left) + score(right) - score(own)) - s.gamma, 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, c, left, right)
            if best is None:
                add[own] = -s.step * g[own].sum() / (h[own].sum() + s.l2) if at else 0.0  # noqa: B023
                return
            nodes[at] = best[1:3]  # noqa: B023
            grow(2 * at + 1, best[3], depth + 1)
            grow(2 * at + 2, best[4], depth + 1)

        grow(0, np.ones(len(y), bool), 0)
        if not nodes:
            break
        out.append(nodes)
        margin = margin + add
    return out, margin


@pytest.mark.parametrize("more", [{}, {"weight": 3.0, "l2": 0.5, "gamma": 0.3, "least": 4.0}])
def test_trees_are_those_of_a_plain_version(spark, more, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)
    df, x, y = rows_of(spark, 160)
    cuts = [np.quantile(x[:, i], np.arange(1, 8) / 8).tolist() for i in range(4)]
    s = Setting(trees=3, depth=3, step=0.3, **more)
    forest = boosting.boost(df, s, cuts=cuts)
    trees, margin = plain(x, y, cuts, s)
    assert [{i: (int(t.feature[i]), int(t.cut[i])) for i in np.flatnonzero(t.feature >= 0)} for t in forest.trees] == trees
    assert np.allclose(forest.margins(forest.binned(x)), margin)
    got = {r.row_id: r.score for r in boosting.scored(forest, df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-margin)))


def test_draws_stop_and_store(spark, tmp_path):
    df, x, y = rows_of(spark)
    val = df.filter("row_id % 4 = 0")
    s = Setting(trees=12, depth=3, step=0.3, bins=8, rows=0.7, columns=0.5, every=3, patience=1)
    forest = boosting.boost(df.filter("row_id % 4 <> 0"), s, val=val)
    assert 0 < len(forest.trees) <= 12 and all(len(c) <= 7 for c in forest.cuts)
    used = [set(t.feature[t.feature >= 0].tolist()) for t in forest.trees]
    assert all(len(u) <= 2 for u in used)
    forest.save(spark, str(tmp_path / "forest.json"))
    again = boosting.load(spark, str(tmp_path / "forest.json"))
    assert np.array_equal(again.margins(again.binned(x)), forest.margins(forest.binned(x)))
    empty = boosting.boost(df.limit(0), s)
    assert [r.score for r in boosting.scored(empty, df.limit(2)).collect()] == [0.5, 0.5]


def test_every_tree_of_the_forest_has_its_own_sample_of_all_rows(spark):
    df, x, _ = rows_of(spark, 500)
    keys = {r.row_id: r.k for r in df.selectExpr("row_id", "xxhash64(7, row_id) as k").collect()}
    u = chances(np.array([keys[i] for i in range(500)]), 5, 7)
    met = models.forest_samples(df, "f", "row_id", 5, 32, 7).collect()
    assert len(met) < 5 * 200
    for t in range(5):
        got = sorted((r.h, r.k) for r in met if r.tree == t)[:32]
        assert got == sorted((u[i, t], keys[i]) for i in range(500))[:32]
    rows = df.unionByName(spark.createDataFrame([(999, 0, [9.0, -9.0, 9.0, 9.0])], df.schema))
    scores = {r.row_id: r.score for r in models.isolation_forest(rows, rows, trees=20, sample=64).collect()}
    assert max(scores, key=scores.get) == 999 and all(0 < s < 1 for s in scores.values())
    assert models.isolation_forest(df.limit(0), df.limit(1)).count() == 1


def test_order_statistics_need_no_block_in_one_row(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (60, 2)) if a != b})
    e = spark.createDataFrame([(0, f"n{a:02d}", f"n{b:02d}", 1.0, float(np.round(rng.normal() * 5, 1)), 1) for a, b in pairs], "snapshot_id int, src string, dst string, weight double, amount_trans double, num_trans long")
    ball = neighbourhood.members(e, e.selectExpr("snapshot_id", "explode(array(src, dst)) as node").distinct())
    role, value = {}, {(r.src, r.dst): r.amount_trans for r in e.collect()}
    for r in ball.collect():
        role.setdefault(r.ego, {})[r.node] = r.role
    out = neighbourhood.block_order_stats(e, ball)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {(r.ego, r.i, r.j): (r.min, r.median, r.iqr) for r in out.collect()}
    want = {}
    for ego, own in role.items():
        for i in range(3):
            for j in range(3):
                rows, cols = ([n for n, k in own.items() if k == t] for t in (i, j))
                cells = [value.get((a, b), 0.0) for a in rows for b in cols]
                if any((a, b) in value for a in rows for b in cols):
                    want[ego, i, j] = (min(cells), np.median(cells), np.percentile(cells, 75) - np.percentile(cells, 25))
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
