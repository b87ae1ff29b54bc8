import datetime as dt

import pytest

from ledgerline import config
from ledgerline.functions import fx, scalars
from ledgerline.operators import snapshots
from ledgerline.sources import loaders, tables

BANK_HEAD = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"


def write(path, text):
    path.write_text(text)
    return str(path.parent)


def test_bank_file(spark, tmp_path):
    rows = [
        "2022/09/11 00:00,1,A,2,B,1,Euro,8.534,Euro,Wire,1",  # on the last moment: kept
        "2022/09/11 00:01,1,A,2,B,1,Euro,5,Euro,Wire,0",  # a minute later: dropped
        "2022/09/01 10:30,1,A,3,A,1,Euro,5,Euro,Wire,0",  # to itself, at another bank
        "2022/09/01 10:30,1,A,2,C,1,Euro,x,Euro,Wire,0",  # no amount
        "2022/09/02 10:30,1,A,2,C,1,Euro,2,US Dollar,Wire,",  # no label
    ]
    folder = write(tmp_path / "HI-Small_Trans.csv", BANK_HEAD + "\n".join(rows) + "\n")
    got = sorted(tuple(r) for r in loaders.load(spark, "bank", folder).collect())
    assert got == [("A", "B", dt.datetime(2022, 9, 11), pytest.approx(10.0), True), ("A", "C", dt.datetime(2022, 9, 2, 10, 30), 2.0, False)]


def test_unknown_currency_is_named(spark, tmp_path):
    folder = write(tmp_path / "HI-Small_Trans.csv", BANK_HEAD + "2022/09/01 10:30,1,A,2,C,1,Euro,5,Groat,Wire,0\n")
    with pytest.raises(Exception, match="Groat"):
        loaders.load(spark, "bank", folder).collect()
    with pytest.raises(ValueError):
        loaders.load(spark, "nothing", folder)


def test_simulator_file(spark, tmp_path):
    text = "TX_ID,SENDER_ACCOUNT_ID,RECEIVER_ACCOUNT_ID,TIMESTAMP,TX_AMOUNT,IS_FRAUD\n1,7,8,3,5.5,True\n2,7,7,3,1,False\n3,8,9,4,,\n"
    got = sorted(tuple(r) for r in loaders.load(spark, "simulator", write(tmp_path / "transactions.csv", text)).collect())
    assert got == [("7", "8", dt.datetime(1970, 1, 4), 5.5, True), ("8", "9", dt.datetime(1970, 1, 5), None, False)]


def test_mixed_file_and_its_slim_copy(spark, tmp_path):
    text = """src,dest,timestamp,amount,currency,is_fraudulent,edge_type
x,y,2025-05-01T10:00:00.123456,14.261,JPY,1,transaction
x,y,2025-05-01T10:00:00,3,USD,0,ownership
individual_1,y,2025-05-01T10:00:00,3,USD,0,transaction
x,z,2025-12-31T00:00:00,3,USD,0,transaction
"""
    folder = write(tmp_path / "generated_edges_HI.csv", text)
    once = loaders.load(spark, "mixed", folder).collect()
    assert [(r.src, r.dst, r.amount, r.label) for r in once] == [("x", "y", pytest.approx(0.1), True)]
    assert once[0].ts.microsecond == 123456
    raw = spark.read.csv(f"{folder}/generated_edges_HI.csv", header=True)
    tables.convert(loaders.mixed_edges(raw), f"{folder}/generated_edges_HI")
    assert loaders.load(spark, "mixed", folder).collect() == once


def test_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "none"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/t.csv").write_text("a,b\n1,x\n2,y\n")
    assert len(tables.convert_folder(spark, str(tmp_path))) == 1 and not tables.convert_folder(spark, str(tmp_path))
    assert tables.find_table(spark, str(tmp_path / "sub/t")).endswith(".parquet")
    scores = spark.createDataFrame([(1, 0.5), (0, None)], "y_true int, score_a double")
    with pytest.raises(ValueError):
        tables.save_predictions(scores, str(tmp_path / "p"))
    tables.save_predictions(scores.na.fill(0.0), str(tmp_path / "p"))
    assert tables.load_predictions(spark, str(tmp_path / "p"))[1] == ["score_a"]


def test_decay_and_spans(spark):
    from pyspark.sql import functions as F

    lags = [400_000, 1_000_000, 86_400_000_000, 3 * 86_400_000_000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lags], "lag long").select(scalars.decay(F.col("lag"), 3)).collect()]
    assert got == pytest.approx([1.0, 0.9999822332975443, 0.2154434690031884, 0.01])
    assert scalars.span(1, "months") == 30 * scalars.span(1, "days")
    with pytest.raises(ValueError):
        scalars.span(1, "years")
    assert scalars.run_tag(6, "hours", echo_days=1) == "h6_echo1" and scalars.run_tag(1, "days", width=2) == "d1_w2"


def test_binning_example(spark):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    tx = spark.createDataFrame([("a", "b", t(d), 1.0, False) for d in (0, 3, 8, 9)], "src string, dst string, ts timestamp_ntz, amount double, label boolean")
    grid = snapshots.make_grid(tx, 2, "days", 5)
    assert grid.count == 4
    placed = snapshots.assign(tx, grid)
    assert sorted(r.snapshot_id for r in placed.filter(placed.ts == t(3)).collect()) == [1, 2, 3]
    assert placed.filter(placed.ts >= t(8)).count() == 0
    assert [r.end_ts for r in grid.frame(spark).orderBy("snapshot_id").collect()] == [t(2), t(4), t(6), t(8)]


def test_settings():
    s = config.resolve({"step": 6.0, "step_unit": "hours", "echo": True, "days_echo": 1.0}, {"LEDGERLINE_K": "3", "LEDGERLINE_STORE": "off"})
    assert (s.tag, s.K, s.store) == ("h6_echo1", 3, "")
    assert config.resolve({"width": 0.5}, {}).drops_between_windows
    with pytest.raises(ValueError):
        config.truth("perhaps")
    assert set(fx.CODES.values()) == set(fx.BANK_RATES)


def test_transfers_follow_over_empty_hours_and_nulls(spark):
    from datetime import datetime

    from ledgerline.sources import adapters

    at = lambda h, m: datetime(2024, 3, 31, h, m)
    rows = [
        (1, at(1, 0), 10, "a", 1.0), (2, at(1, 59), 11, "a", 300.0), (3, at(5, 0), 12, "a", 2.0), (4, at(5, 1), 12, "a", 3.0), (5, at(6, 0), None, "a", 4.0), (6, at(7, 0), 13, "a", 5.0),
        (7, at(1, 30), 20, None, 6.0), (8, at(9, 0), 21, None, 7.0), (9, at(2, 30), 30, "b", 8.0), (10, at(2, 30), 31, "b", 9.0),
    ]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    got = sorted((r.src, r.dst, r.amount, r.label) for r in adapters.transfers(events).collect())
    assert got == [(10, 11, 1.0, False), (11, 12, 300.0, True), (20, 21, 6.0, False), (30, 31, 8.0, False)]
    assert adapters.transfers(events.limit(0)).count() == 0
