"""Runs a registered query and its SQL on the same tables and compares all rows."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(v):
    return "%.9g" % v if isinstance(v, float) else str(v)


def differences(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(_text(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    heads = [d[0] for d in cur.description]
    assert sorted(heads) == names
    order = [heads.index(c) for c in names]
    want = sorted(tuple(_text(r[i]) for i in order) for r in cur.fetchall())
    return len(got), [p for p in zip(got, want) if p[0] != p[1]][:3] if len(got) == len(want) else [(len(got), len(want))]
