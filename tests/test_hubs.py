import numpy as np
import pytest

from ledgerline.operators import graph, hubs, neighbourhood
from ledgerline.schema import FEATURES

EDGE = "snapshot_id int, src string, dst string, weight double, amount_trans double, num_trans long"


def graphs(spark, seed):
    """Random edges beside one to three hubs whose stars overlap; a graph a snapshot."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(3):
        n, pairs = int(rng.integers(8, 16)), set()
        for h in range(int(rng.integers(1, 4))):
            for x in rng.permutation(n)[: int(rng.integers(4, n))]:
                if x != h:
                    pairs |= [{(h, int(x))}, {(int(x), h)}, {(h, int(x)), (int(x), h)}][int(rng.integers(3))]
        pairs |= {(int(a), int(b)) for a, b in rng.integers(0, n, (int(rng.integers(3, 16)), 2)) if a != b}
        rows += [(k, f"n{a:02d}", f"n{b:02d}", float(rng.choice([0.3, 1.0])), float(np.round(rng.normal() * 9, 1)), int(rng.integers(1, 4))) for a, b in sorted(pairs)]
    return spark.createDataFrame(rows, EDGE)


@pytest.mark.parametrize("seed,limit", [(1, 3), (2, 4), (3, 2), (4, 5)])
def test_features_are_those_of_the_self_join(spark, seed, limit):
    e = graphs(spark, seed)
    egos = graph.nodes(e)
    assert hubs.heavy_nodes(graph.arcs(e), limit).count() > 1
    want = {(r.snapshot_id, r.node): r for r in neighbourhood.features(e, egos, limit=10**6).collect()}
    got = {(r.snapshot_id, r.node): r for r in neighbourhood.features(e, egos, limit=limit).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        for c in FEATURES:
            assert got[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-6), (k, c)


def test_a_star_costs_rows_in_proportion(spark):
    rng, n = np.random.default_rng(5), 20_000
    rows = [(0, 0, i, 1.0, float(i % 97), 1) if i % 2 else (0, i, 0, 1.0, float(i % 89), 1) for i in range(1, n)]
    rows += [(0, int(a), int(b), 1.0, float((a + b) % 83), 1) for a, b in {tuple(p) for p in rng.integers(1, n, (3000, 2)).tolist()} if a != b]
    e = spark.createDataFrame(rows, EDGE.replace("string", "int"))
    count, sums = hubs.blocks(e, graph.nodes(e), 64)
    one = count.filter("ego = 1").first()
    assert one.n0 + one.n1 + one.n2 == n and count.count() == n
    own = sums.filter("ego = 1").agg({"nnz": "sum"}).first()[0]
    assert own == len(rows)  # every edge lies in a leaf's ball
