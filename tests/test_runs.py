"""Stored runs: resuming, replacing tables, metric files, models that are reloaded, windows end to end."""

import itertools

import numpy as np
import pytest
import sequential
from pyspark.sql import functions as F

from ledgerline import shared
from ledgerline.config import Settings
from ledgerline.operators import metrics, models, results, windows
from ledgerline.plans import features as plans
from ledgerline.schema import FEATURES
from ledgerline.sources import loaders, tables


def simulated(tmp_path, days=12):
    head = "TX_ID,SENDER_ACCOUNT_ID,RECEIVER_ACCOUNT_ID,TIMESTAMP,TX_AMOUNT,IS_FRAUD\n"
    rows = [f"{i},{i % 5},{(i * 3 + i // 7) % 6},{i % days},{i + 1}.5,{i % 9 == 0}" for i in range(120)]
    (tmp_path / "transactions.csv").write_text(head + "\n".join(rows) + "\n")
    return Settings(dataset="simulator", step=2, width=2, K=2, task="nowcast", n_val=1, n_test=1)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_a_run_that_failed_between_its_writes_is_made_good(spark, tmp_path, monkeypatch):
    settings, folder = simulated(tmp_path), str(tmp_path)
    plans.extract(spark, settings, folder, f"{folder}/whole", "none")
    want = {t: rows_of(spark.read.parquet(f"{folder}/whole/{t}")) for t in ("features", "labels")}
    real = plans.neighbourhood.features

    def broken(*a, **b):
        return real(*a, **b).withColumn("measure_00", F.raise_error(F.lit("lost")).cast("double"))

    monkeypatch.setattr(plans.neighbourhood, "features", broken)
    with pytest.raises(Exception, match="lost"):
        plans.extract(spark, settings, folder, f"{folder}/out", "none")
    assert tables.some(spark, f"{folder}/out/labels/snapshot_id=*") and not tables.some(spark, f"{folder}/out/features/snapshot_id=*")
    monkeypatch.setattr(plans.neighbourhood, "features", real)
    files = None
    for _ in range(2):
        plans.extract(spark, settings, folder, f"{folder}/out", "none")
        before, files = files, sorted(p.name for p in (tmp_path / "out").rglob("*.parquet"))
        assert before in (None, files)  # a second call finds nothing to do
        assert {t: rows_of(spark.read.parquet(f"{folder}/out/{t}")) for t in ("features", "labels")} == want
    # a snapshot that lost its labels is computed again, the others stay
    import shutil

    gone = next((tmp_path / "out/labels").glob("snapshot_id=*"))
    shutil.rmtree(gone)
    plans.extract(spark, settings, folder, f"{folder}/out", "none")
    assert {t: rows_of(spark.read.parquet(f"{folder}/out/{t}")) for t in ("features", "labels")} == want


def test_features_and_windows_end_to_end(spark, tmp_path):
    settings, folder = simulated(tmp_path), str(tmp_path)
    stored = plans.extract(spark, settings, folder, f"{folder}/out", "none")
    tx = loaders.load(spark, "simulator", folder)
    same = plans.daily_features(tx, 2, "days", 2)
    got, want = (sorted(map(tuple, df.select("snapshot_id", "node", *FEATURES).collect())) for df in (stored, same))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    # two plans merge variances in different orders
    assert np.allclose(np.array([r[2:] for r in got], float), np.array([r[2:] for r in want], float), rtol=1e-9, atol=1e-12)
    cut = plans.build_windows(spark, settings, f"{folder}/out").collect()
    have = {(r.snapshot_id, r.node) for r in stored.select("snapshot_id", "node").collect()}
    assert {(r.anchor, r.node) for r in cut} <= have and len(cut) == len({(r.anchor, r.node) for r in cut})
    assert all(len(r.idx) == 2 and (r.idx[0] >= 0) == ((r.anchor - 1, r.node) in have) for r in cut)
    assert {r.band for r in cut} == {"train", "val", "test"}


def test_a_failed_save_leaves_the_old_table(spark, tmp_path):
    stem = str(tmp_path / "t")
    tables.save_table(spark.range(5), stem)
    with pytest.raises(Exception, match="boom"):
        tables.save_table(spark.range(9).withColumn("x", F.raise_error(F.lit("boom"))), stem)
    assert tables.load_table(spark, stem).count() == 5
    tables.save_table(spark.range(7), stem)
    assert tables.load_table(spark, stem).count() == 7
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t.parquet"]
    (tmp_path / "half.parquet").mkdir()
    (tmp_path / "half.csv").write_text("a\n1\n")
    assert tables.find_table(spark, str(tmp_path / "half")).endswith(".csv")


def test_metric_files(spark, tmp_path):
    rows = [(m, int((i * 7 + k) % 3 == 0), float((i * 13 + k) % 50) / 50) for k, m in enumerate(("one", "two")) for i in range(200)]
    scores = spark.createDataFrame(rows, "model string, y int, score double")
    stem = str(tmp_path / "HI_d1_echo3_K7_nowcast_baselines_XGBoost")
    areas = {r.model: r for r in results.write_metrics(scores, stem).collect()}
    read = results.read_metric_files(spark, str(tmp_path)).select("*", *results.name_parts()).collect()
    assert sorted(r.model for r in read) == ["one", "two"]
    for r in read:
        assert (r.dataset, r.run_tag, r.K, r.task, r.kind, r.models) == ("HI", "d1_echo3", 7, "nowcast", "baselines", "XGBoost")
        assert r.auc_pr == pytest.approx(areas[r.model].auc_pr) and r.auc_roc == pytest.approx(areas[r.model].auc_roc)
        assert r.prevalence == pytest.approx(areas[r.model].prevalence, rel=1e-4)
    names = spark.createDataFrame([("a/LI_features_NN.txt",), ("LI_CNN.txt",), ("x/other.txt",)], "path string").select(*results.name_parts()).collect()
    assert [(r.dataset, r.kind, r.models) for r in names] == [("LI", "features", "NN"), ("LI", "cnn", "CNN"), (None, None, None)]


def test_running_sums_are_dealt_by_range(spark):
    """One key: its scores meet in several tasks, and equal what one pass in order gives."""
    rng = np.random.default_rng(2)
    score, y = rng.integers(0, 700, 3000) / 700, rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(int(b), float(a)) for a, b in zip(score, y, strict=True)], "y int, score double")
    got = metrics.by_score(df).orderBy(F.desc("score")).collect()
    values = np.unique(score)[::-1]
    n, tp = np.array([(score == v).sum() for v in values]), np.array([y[score == v].sum() for v in values])
    assert [r.score for r in got] == values.tolist() and [r.n for r in got] == n.tolist() and [r.cum_tp for r in got] == np.cumsum(tp).tolist()
    assert [r.next_n for r in got] == [*n[1:].tolist(), None] and {(r.all_n, r.all_tp) for r in got} == {(3000, int(y.sum()))}
    keyed = df.withColumn("model", F.when(F.col("y") == 0, "a")).withColumn("y", F.lit(1))
    assert {r.model: r.all_n for r in metrics.by_score(keyed, "model").collect()} == {"a": int((y == 0).sum()), None: int((y == 1).sum())}


def test_labels_of_extra_metrics(spark):
    df = spark.createDataFrame([("m", i % 3 == 0, i / 30) for i in range(30)], "model string, y boolean, score double").withColumn("y", F.col("y").cast("int"))
    found = metrics.extra_metrics(df, "model", at=(5, 100), shares=(0.005, 0.01, 0.1), r_precision=True)
    assert found.columns == ["model", "F1@0.5", "P@5", "P@100", "P@0.5%", "P@1%", "P@10%", "P@R", "F1_best", "F1_best_threshold", "F1_best_precision", "F1_best_recall"]
    assert found.first()["P@100"] is None


def test_a_stored_model_scores_alike(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, int(v[0] > 0), [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (200, 3)))]
    df = spark.createDataFrame(rows, "row_id int, y int, f array<double>")
    fit = models.fit_pipeline(df, "logistic", regParam=0.01)
    models.save_model(fit, str(tmp_path / "m"))
    again = {r.row_id: r.score for r in models.rescore(str(tmp_path / "m"), df).collect()}
    now = {r.row_id: r.score for r in models._scored(fit, models._vectors(df, "f", None)).collect()}
    assert again == pytest.approx(now) and np.mean([(again[i] > 0.5) == y for i, y, _ in rows]) > 0.95
    with pytest.raises(ValueError):
        models.fit_pipeline(df, "forest")
    best = models.cross_validated(df, [{"maxIter": 2, "maxDepth": 1}, {"maxIter": 2, "maxDepth": 2}], folds=2)
    assert len(best) == 2 and best[0]["value"] >= best[1]["value"] > 0.8


def best_partition(n, pairs, resolution):
    """The largest modularity of all partitions of a small graph."""
    best = -1.0
    neighbours = [{} for _ in range(n)]
    for a, b, w in pairs:
        neighbours[a][b] = neighbours[b][a] = w
    for labels in itertools.product(range(n), repeat=n):
        if all(labels[i] <= max(labels[:i], default=-1) + 1 for i in range(n)):
            best = max(best, sequential.modularity(neighbours, np.zeros(n), np.array(labels), resolution))
    return best, neighbours


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("resolution", [1.0, 2.0])
def test_louvain_comes_close_to_the_best_partition(seed, resolution):
    rng = np.random.default_rng(seed)
    pairs = [(a, b, float(rng.integers(1, 4))) for a in range(7) for b in range(a) if rng.random() < (0.8 if (a < 4) == (b < 4) else 0.15)]
    best, neighbours = best_partition(7, pairs, resolution)
    a, b, w = (np.array(c) for c in zip(*pairs, strict=True))
    found = sequential.louvain(a, b, w.astype(float), 7, resolution, seed=1)
    assert (found == sequential.louvain(a, b, w.astype(float), 7, resolution, seed=1)).all()
    assert sequential.modularity(neighbours, np.zeros(7), found, resolution) >= best - 0.06
    # a community is connected inside
    for c in set(found.tolist()):
        own = set(np.flatnonzero(found == c).tolist())
        seen, todo = set(), [min(own)]
        while todo:
            v = todo.pop()
            seen.add(v)
            todo += [u for u in neighbours[v] if u in own - seen]
        assert seen == own


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, name, other=None):
            return other

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_folder(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        shared.shared_folder(Session())
    Context.master = "local[2]"
    assert shared.shared_folder(Session()).startswith("file://")


def test_rows_of_one_snapshot_are_numbered_in_several_tasks(spark):
    df = spark.range(1000).select(F.lit(0).alias("snapshot_id"), F.col("id").alias("node"), F.lit(0).alias("label"), F.col("id").alias("a"))
    rows = windows.store_rows(df, ["a"])
    got = rows.orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(1000)) and [r.node for r in got] == sorted(str(i) for i in range(1000))
    with pytest.raises(ValueError):
        loaders.label_table(df)
    assert {r.label for r in loaders.label_table(spark.createDataFrame([(1, "True"), (2, "0")], "x int, `Is Laundering` string")).collect()} == {True, False}
