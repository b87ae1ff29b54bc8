import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import snapshots
from ledgerline.streaming.edges import replayed, streaming_edges, streaming_labels


def test_closed_windows_equal_batch(spark, tmp_path):
    day = lambda d, h: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=d, hours=h)
    rows = [(f"n{i % 4}", f"n{(i + 1) % 4}", day(i // 5, i % 24), float(i), False) for i in range(40)]
    tx = spark.createDataFrame(rows, "src string, dst string, ts timestamp, amount double, label boolean")
    tx.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = streaming_edges(spark.readStream.schema(tx.schema).parquet(str(tmp_path / "in")), late="0 seconds")
    query = stream.writeStream.format("memory").queryName("closed_edges").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.start_ts, r.src, r.dst): (r.amount_trans, r.num_trans) for r in spark.table("closed_edges").collect()}
    batch = tx.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    grid = snapshots.Grid(1704067200000000, 1704067200000000 + 8 * 86_400_000_000, 86_400_000_000, 86_400_000_000)
    ends = {r.snapshot_id: r.start_ts for r in grid.frame(spark).collect()}
    want = {(ends[r.snapshot_id], r.src, r.dst): (r.amount_trans, r.num_trans) for r in snapshots.snapshot_edges(batch, grid).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert {k[0] for k in got} == {t for i, t in ends.items() if i < 7}


DAY = 86_400_000_000


def transactions(spark, n=300):
    rng = np.random.default_rng(6)
    at = sorted(rng.integers(0, 9 * DAY, n).tolist())
    rows = [(f"n{a}", f"n{b}" if b != a else None, dt.datetime(2024, 1, 1, 5) + dt.timedelta(microseconds=int(t)), float(v) if v > 1 else None, bool(v > 8)) for t, (a, b), v in zip(at, rng.integers(0, 6, (n, 2)).tolist(), rng.integers(0, 10, n), strict=True)]
    return spark.createDataFrame(rows, "src string, dst string, ts timestamp_ntz, amount double, label boolean")


@pytest.mark.parametrize("width,echo", [(1.0, None), (0.25, None), (2.5, None), (1.0, 3.0)])
def test_replayed_edges_are_those_of_the_table(spark, width, echo):
    tx = transactions(spark)
    grid = snapshots.make_grid(tx, 1, "days", width)
    got = replayed(tx, grid, lambda s: streaming_edges(s, DAY, int(width * DAY), "0 seconds", grid.first, echo)).drop("start_ts", "end_ts")
    want = snapshots.snapshot_edges(tx, grid, echo)
    rows = lambda df: sorted((r.snapshot_id, r.src, r.dst, round(r.weight, 9), r.amount_trans, r.num_trans) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(want)) > 40


def test_replayed_labels_are_those_of_the_table(spark):
    tx = transactions(spark)
    grid = snapshots.make_grid(tx, 1, "days", 0.5)
    got = replayed(tx, grid, lambda s: streaming_labels(s, DAY, DAY // 2, "0 seconds", grid.first))
    want = snapshots.node_labels(snapshots.assign(tx, grid), "snapshot_id")
    assert sorted((r.snapshot_id, r.node, r.label) for r in got.collect()) == sorted((r.snapshot_id, r.node, r.label) for r in want.collect())


def test_rows_that_come_too_late_change_no_closed_window(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    kind = "src string, dst string, ts timestamp, amount double, label boolean"
    batches = [[("a", "b", at(0, 1), 1.0, False), ("a", "b", at(2, 1), 2.0, False)], [("a", "b", at(0, 2), 50.0, True), ("a", "b", at(1, 2), 4.0, False), ("a", "b", at(4), 8.0, False)], [("a", "b", at(9), 9.0, False)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = streaming_edges(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), late="1 day")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.start_ts.day: r.amount_trans for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 1.0, 2: 4.0, 3: 2.0, 5: 8.0}
