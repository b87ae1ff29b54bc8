"""Queries that take whole tables, against plain Python over the same edges."""

from pathlib import Path

import pytest

from ledgerline import queries as core
from ledgerline.operators import community

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the generated tables are not here")


def union_find(edges):
    """(snapshot, node) -> the smallest node of its component."""
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for s, a, b, *_ in edges:
        lo, hi = sorted([top((s, a)), top((s, b))])
        up[hi] = lo
    return {x: top(x)[1] for x in up}


def test_components_of_all_transfers_of_a_day(spark):
    edges = [(r.snapshot_id, r.src, r.dst) for r in core._edges(spark, SF).collect()]
    got = {(r.snapshot_id, r.node): r.community for r in core.queries()["components"](spark, SF).collect()}
    assert len(edges) > 10 * core._edges(spark, SF, width=0.02).count()
    assert got == union_find(edges)


def test_no_edge_inside_a_component_is_lost(spark):
    want = sorted((r.snapshot_id, r.src, r.dst, r.num_trans) for r in core._edges(spark, SF).collect())
    assert sorted(tuple(r) for r in core.queries()["intra_component_edges"](spark, SF).collect()) == want


def test_edges_inside_communities_are_those_of_equal_communities(spark):
    edges = core._edges(spark, SF)
    home = {(r.snapshot_id, r.node): r.community for r in community.louvain_communities(edges).collect()}
    all_ = [(r.snapshot_id, r.src, r.dst, r.num_trans) for r in edges.collect()]
    want = sorted(e for e in all_ if home[e[0], e[1]] == home[e[0], e[2]])
    assert 0 < len(want) < len(all_)
    assert sorted(tuple(r) for r in core.queries()["intra_community_edges"](spark, SF).collect()) == want


def test_missing_cells_counts_every_event(spark):
    n = {i: 0 for i in range(24)}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("value").collect():
        if r.value is not None and int(r.value // 25) in n:
            n[int(r.value // 25)] += 1
    got = {r.cell: (r.n, r.state) for r in core.queries()["missing_cells"](spark, SF).collect()}
    assert got == {i: (k, "top-up" if k else "missing") for i, k in n.items() if k < 10}
    assert {s for _, s in got.values()} == {"missing", "top-up"}
