import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import metrics, models, windows
from ledgerline.schema import FEATURES, require_features


def rows(spark, seed=1, snapshots=8, nodes=12):
    rng = np.random.default_rng(seed)
    out = [(t, f"n{i}", int(rng.random() < 0.3), float(rng.normal()), float("nan") if rng.random() < 0.05 else float(rng.normal())) for t in range(snapshots) for i in range(nodes) if rng.random() < 0.7 and not (i == 0 and t == 3)]
    out += [(t, "gap", 1, 1.0, 2.0) for t in (2, 4, 6, 7)]
    return windows.store_rows(spark.createDataFrame(out, "snapshot_id int, node string, label int, a double, b double"), ["a", "b"]).cache()


@pytest.mark.parametrize("task", ["nowcast", "forecast"])
@pytest.mark.parametrize("k", [1, 3])
def test_windows_equal_probes(spark, task, k):
    store = rows(spark)
    at = {(r.snapshot_id, r.node): r for r in store.collect()}
    base = k - 1 if task == "nowcast" else k
    want = {(t, n): [at[t - base + s, n].row_id if (t - base + s, n) in at else -1 for s in range(k)] for t, n in at if t >= base}
    assert {(r.anchor, r.node): r.idx for r in windows.windows(store, k, task).collect()} == want
    assert sorted(r.row_id for r in at.values()) == list(range(len(at)))
    assert all(np.isfinite(r.f).all() for r in at.values())


def test_nowcast_and_forecast_share_steps(spark):
    store = rows(spark)
    now = {(r.anchor, r.node): r.idx for r in windows.windows(store, 4, "nowcast").collect()}
    then = {(r.anchor, r.node): r.idx for r in windows.windows(store, 3, "forecast").collect()}
    assert all(now[key][:3] == then[key] for key in now if key in then)
    assert all(v[-1] >= 0 for v in now.values())


def test_last_valid_step(spark):
    m = spark.createDataFrame([([True, False, True],), ([False, True, True],), ([True, True, False],), ([False, False, False],)], "m array<boolean>")
    assert [r[0] for r in m.select(windows.last_valid_step(F.col("m"))).collect()] == [2, 2, 1, 0]


def test_dense_scaled_and_flat(spark):
    store = rows(spark)
    cut = windows.with_history(windows.bands(windows.windows(store, 3, "nowcast"), 1, 2))
    x = windows.dense(cut, store, 2).collect()
    f = {r.row_id: r.f for r in store.collect()}
    idx = {(r.anchor, r.node): r.idx for r in cut.collect()}
    assert all(r.x == [f.get(i, [0.0, 0.0]) for i in idx[r.anchor, r.node]] and r["mask"] == [i >= 0 for i in idx[r.anchor, r.node]] for r in x)
    train = {i for r in cut.filter("band = 'train'").collect() for i in r.idx if i >= 0}
    values = np.array([f[i] for i in train])
    fit = {r.feature: (r.mean, r.std) for r in windows.scaler(cut.filter("band = 'train'"), store, 2).collect()}
    assert np.allclose([fit[i] for i in (0, 1)], [(values[:, i].mean(), values[:, i].std()) for i in (0, 1)])
    assert len(windows.flatten(windows.dense(cut, store, 2), "forecast").first().v) == 6
    with pytest.raises(ValueError):
        windows.flatten(cut, "nowcast", local=True)


def test_guards(spark):
    store = rows(spark)
    w = windows.windows(store, 3, "nowcast")
    for bad in (lambda: windows.windows(store, 3, "other"), lambda: windows.windows(store, 9, "nowcast", 8), lambda: windows.bands(w, 1, 0), lambda: windows.bands(w, 4, 4), lambda: windows.bands(w.withColumn("y", F.lit(0.0)), 1, 1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        require_features(FEATURES[1:])


def test_store_round_trip(spark, tmp_path):
    store = rows(spark)
    with pytest.raises(FileNotFoundError):
        windows.read_store(spark, str(tmp_path / "s"))
    windows.write_store(store, str(tmp_path / "s"), 8)
    back, codes, meta = windows.read_store(spark, str(tmp_path / "s"))
    assert back.select(*store.columns).exceptAll(store).isEmpty() and meta["snapshots"] == 8
    assert [r.node_code for r in codes.orderBy("node").collect()] == list(range(13))


def brute(y, s):
    y, s = np.array(y), np.array(s)
    order = np.unique(s)[::-1]
    ap = sum((y[s == t].sum() / y.sum()) * (y[s >= t].sum() / (s >= t).sum()) for t in order)
    pos, neg = s[y == 1], s[y == 0]
    roc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    return ap, roc


@pytest.mark.parametrize("seed", range(3))
def test_auc(spark, seed):
    rng = np.random.default_rng(seed)
    y, s = rng.integers(0, 2, 60).tolist(), (rng.integers(0, 12, 60) / 12).tolist()
    got = metrics.auc(spark.createDataFrame(list(zip(y, s, strict=True)), "y int, score double")).first()
    assert (got.auc_pr, got.auc_roc) == pytest.approx(brute(y, s))
    assert got.prevalence == pytest.approx(np.mean(y))


def test_precision_at_k_shares_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, score double")
    at = lambda k: metrics.precision_at(df, k).first().precision
    assert (at(2), at(4), at(0.3)) == (0.75, 0.5, 0.75) and at(5) is None and at(0) is None
    best = metrics.best_f1(df).first()
    assert best.best_f1 == pytest.approx(0.8) and best.threshold == 0.5
    assert metrics.f1_at(df, 2.0).first().f1 == 0


def test_search_and_tuning():
    space = models.search_space({"a": [1, 2], "b": {"low": 0.1, "high": 10.0, "num": 3, "log": True}, "c": 5})
    assert len(space) == 6 and space[1]["b"] == pytest.approx(1.0)
    first = models.tune(space, lambda s: -s["b"], most=4)
    again = models.tune(space, lambda s: -s["b"], done=first)
    assert len(first) == 4 and len(again) == 6 and again[0]["setting"]["b"] == 0.1


def test_outliers_score_higher(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(0, 1, 3).tolist()) for i in range(200)] + [(999, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(data, "row_id long, f array<double>")
    assert models.isolation_forest(df, df, trees=30).orderBy(F.desc("score")).first().row_id == 999


def test_unknown_nodes_are_named(spark):
    codes = spark.createDataFrame([("a", 0)], "node string, node_code int")
    assert windows.encode(spark.createDataFrame([("a",)], "node string"), codes).first().node_code == 0
    with pytest.raises(Exception, match="unknown node: b"):
        windows.encode(spark.createDataFrame([("b",)], "node string"), codes).collect()


def test_cached_tables_are_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert windows.cached(spark, str(tmp_path), ("d1_w1", 8, 3, "nowcast"), build).count() == 3
    assert len(calls) == 1


def test_row_ids_are_dense_in_order_and_wide_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("cast(id % 7 as int) as snapshot_id", "cast(id as string) as node", "0 as label", "cast(id as double) as a")
    rows = windows.store_rows(df.mapInArrow(seen, df.schema), ["a"]).collect()
    want = sorted((i % 7, str(i)) for i in range(1000))
    assert [(r.snapshot_id, r.node) for r in sorted(rows, key=lambda r: r.row_id)] == want and sorted(r.row_id for r in rows) == list(range(1000))
    assert made.value == 1000


def test_the_last_steps_of_a_nowcast_are_those_of_dense_windows_and_nothing_is_exchanged(spark):
    store = rows(spark)
    got = windows.last_steps(store, 3)
    want = windows.flatten(windows.dense(windows.windows(store, 3, "nowcast"), store, 2), "nowcast")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan.split("InMemoryRelation")[0] for x in ("Join", "Window", "Aggregate")), plan
