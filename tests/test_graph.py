import numpy as np
import pyarrow as pa
import pytest
import sequential
from pyspark.sql import functions as F

from ledgerline.operators import community, graph, neighbourhood
from ledgerline.operators.pin import Pins
from ledgerline.schema import BLOCKS, FEATURES, STATS, VALUES

EDGE = "snapshot_id int, src string, dst string, weight double, amount_trans double, num_trans long"
G1 = [("a", "b", 100.0), ("b", "c", 50.0), ("d", "b", 30.0), ("d", "c", 7.0), ("c", "e", 9.0)]


def table(spark, edges, weight=1.0):
    return spark.createDataFrame([(0, s, d, weight, float(x), 1) for s, d, x in edges], EDGE)


def features(spark, edges, extra=()):
    e = table(spark, edges)
    egos = graph.nodes(e)
    if extra:
        egos = egos.unionByName(spark.createDataFrame([(0, n) for n in extra], "snapshot_id int, node string"))
    return {r.node: r.asDict() for r in neighbourhood.features(e, egos).collect()}


def test_hand_computed_ego_graph(spark):
    f = features(spark, G1, ["z"])
    amount = lambda n, s, b: f[n][f"transaction_amount_trans_summary_{s}_{b}"]
    assert {b: f["a"][f"measure_{b}"] for b in BLOCKS if f["a"][f"measure_{b}"]} == {"01": 1, "02": 1, "12": 1}
    assert [amount("a", s, "01") for s in STATS] == [130, 65, 100, 35]
    assert [amount("a", s, "02") for s in STATS] == [7, 3.5, 7, 3.5]
    assert f["b"]["measure_10"] == pytest.approx(2 / 3) and f["b"]["measure_11"] == pytest.approx(1 / 6)
    assert amount("b", "std", "10") == pytest.approx(41.899350, abs=1e-6)
    assert amount("b", "std", "11") == pytest.approx(2.199888, abs=1e-6)
    assert f["d"]["measure_01"] == 0.75 and amount("d", "std", "01") == pytest.approx(39.549810, abs=1e-6)
    assert f["e"]["size_22"] == 2 and amount("e", "std", "22") == pytest.approx(12.990381, abs=1e-6)
    assert f["z"]["measure_01"] == 1 and all(f["z"][c] == 0 for c in FEATURES if c != "measure_01")


def dense(edges, nodes):
    """The features from adjacency matrices, ego by ego."""
    at = {n: i for i, n in enumerate(nodes)}
    w, x, c = (np.zeros((len(nodes),) * 2) for _ in range(3))
    for s, d, v in edges:
        w[at[s], at[d]], x[at[s], at[d]], c[at[s], at[d]] = 1, v, 1
    und = (w + w.T) > 0
    out = {}
    for n, e in at.items():
        near = set(np.flatnonzero(und[e])) - {e}
        ball = ({e} | near | {j for k in near for j in np.flatnonzero(und[k])})
        ahead = {j for k in np.flatnonzero(w[e]) for j in np.flatnonzero(w[k])} | {j for k in np.flatnonzero(w[:, e]) for j in np.flatnonzero(w[:, k])}
        two = ball - near - {e}
        groups = [[e, *sorted(two - ahead)], sorted(near), sorted(two & ahead)]
        row = {}
        for i in range(3):
            for j in range(3):
                block = lambda m: m[np.ix_(groups[i], groups[j])]  # noqa: B023, E731
                ni, nj, b = len(groups[i]), len(groups[j]), f"{i}{j}"
                size = {"00": ni * ni - 3 * ni + 2, "01": ni * nj, "02": (ni - 1) * nj, "10": ni * nj, "11": ni * ni - ni, "12": ni * nj, "20": ni * nj - ni, "21": ni * nj, "22": ni * ni - ni}[b]
                row[f"size_{b}"] = size
                row[f"measure_{b}"] = block(w).sum() / size if size > 0 else float(b == "01")
                for name, m in (("amount_trans", x), ("num_trans", c)):
                    v = block(m)
                    for s, f in (("sum", np.sum), ("mean", np.mean), ("max", np.max), ("std", np.std)):
                        row[f"transaction_{name}_summary_{s}_{b}"] = float(f(v)) if v.size else 0.0
        out[n] = row
    return out


@pytest.mark.parametrize("seed", range(4))
def test_features_equal_dense_matrices(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(4, 16))
    pairs = {(a, b) for a, b in rng.integers(0, n, (int(rng.integers(n, 3 * n)), 2)).tolist() if a != b}
    edges = [(f"n{a}", f"n{b}", float(rng.normal(0, 10))) for a, b in sorted(pairs)]
    nodes = sorted({x for s, d, _ in edges for x in (s, d)})
    got, want = features(spark, edges), dense(edges, nodes)
    assert got.keys() == want.keys()
    for node in nodes:
        for c in FEATURES:
            assert got[node][c] == pytest.approx(want[node][c], abs=1e-9), (node, c)


def test_ball_sizes_and_block_sums_agree(spark):
    e = table(spark, G1)
    ball = neighbourhood.members(e, graph.nodes(e))
    total = {r.ego: r["count"] for r in ball.groupBy("ego").count().collect()}
    assert all(r.n0 + r.n1 + r.n2 == total[r.ego] for r in neighbourhood.sizes(ball).collect())
    assert {v for v in VALUES} == {"amount_trans", "num_trans"}


def test_quantile_hubs(spark):
    star = [("h", f"x{i}", 1.0) for i in range(10)] + [("p", "q", 1.0), ("q", "r", 1.0), ("r", "p", 1.0)]
    kept = {(r.src, r.dst) for r in graph.prune_top(table(spark, star), 0.01).collect()}
    assert kept == {("p", "q"), ("q", "r"), ("r", "p")}
    assert graph.prune_hubs(table(spark, star), 3).count() == 3


def test_components_and_louvain_part_two_cliques(spark):
    clique = lambda names: [(a, b, 1.0) for a in names for b in names if a < b]
    e = table(spark, clique("abcd") + clique("wxyz") + [("d", "w", 1.0)])
    assert {r.community for r in community.components(e).collect()} == {"a"}
    found = {r.node: r.community for r in community.louvain_communities(e, resolution=1.0).collect()}
    assert len({found[n] for n in "abcd"}) == 1 and len({found[n] for n in "wxyz"}) == 1 and found["a"] != found["w"]
    assert community.prune(e, "louvain", resolution=1.0).count() == 12
    with pytest.raises(ValueError):
        community.prune(e, "other")


def test_louvain_of_no_edges_is_singletons():
    empty = np.empty(0, int)
    assert sequential.louvain(empty, empty, np.empty(0), 3).tolist() == [0, 1, 2]


def test_long_path_is_one_component(spark):
    path = table(spark, [(f"{i:03d}", f"{i + 1:03d}", 1.0) for i in range(40)])
    assert {r.community for r in community.components(path).collect()} == {"000"}


def test_block_edges_are_the_edges_with_both_ends_in_the_ball(spark):
    rng = np.random.default_rng(5)
    pairs = {(a, b) for a, b in rng.integers(0, 30, (60, 2)).tolist() if a != b} | {(0, b) for b in range(1, 25)} | {(b, 1) for b in range(2, 20)}
    e = table(spark, [(f"n{a:02d}", f"n{b:02d}", float(a * 100 + b)) for a, b in sorted(pairs)])
    ball = neighbourhood.members(e, graph.nodes(e))
    role = {(r.ego, r.node): r.role for r in ball.collect()}
    want = sorted((x, role[x, s], role[x, d], v) for x in {k[0] for k in role} for s, d, v in ((r.src, r.dst, r.amount_trans) for r in e.collect()) if (x, s) in role and (x, d) in role)
    assert sorted((r.ego, r.i, r.j, r.amount_trans) for r in neighbourhood.block_edges(e, ball).collect()) == want


def test_louvain_options(spark):
    e = table(spark, [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])
    with pytest.raises(ValueError):
        community.louvain_communities(e, max_level=0)
    with pytest.raises(ValueError):
        sequential.louvain(np.array([0]), np.array([1]), np.ones(1), 2, max_level=0)
    both = {r.node: r.community for r in community.louvain_communities(e, resolution=1.0, parallel=True).collect()}
    assert both == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert len({r.community for r in community.louvain_communities(e, resolution=1.0, max_level=1).collect()}) <= 3


def test_louvain_tells_of_a_cut_level(caplog):
    ring = np.arange(40)
    sequential.louvain(ring, (ring + 1) % 40, np.ones(40), 40, resolution=1.0, sweeps=1)
    assert "cut off after 1 sweeps" in caplog.text


def planted(rng, groups, size, inside, between, weights=(1.0,)):
    """Pairs of a graph of groups, with more inside than between."""
    n = groups * size
    own = [(g * size + int(a), g * size + int(b)) for g in range(groups) for a, b in rng.integers(0, size, (inside, 2))]
    pairs = {(min(p), max(p)) for p in own + rng.integers(0, n, (between, 2)).tolist() if p[0] != p[1]}
    return [(a, b, float(rng.choice(weights))) for a, b in sorted(pairs)]


@pytest.mark.parametrize("resolution,weights", [(1.0, (1.0,)), (10.0, (1.0,)), (1.0, (0.0123, 0.5, 1.0))])
def test_parallel_moves_come_close_to_moves_one_by_one(spark, resolution, weights):
    rng = np.random.default_rng(int(resolution) + len(weights))
    graphs = [planted(rng, 12, 15, 60, 80, weights), planted(rng, 4, 30, 60, 200, weights), planted(rng, 1, 200, 5, 600, weights)]
    rows = [(i, f"n{a:03d}", f"n{b:03d}", w, 0.0, 1) for i, pairs in enumerate(graphs) for a, b, w in pairs]
    e = spark.createDataFrame(rows, EDGE).repartition(3)
    found = community.louvain_communities(e, resolution=resolution)
    home = {(r.snapshot_id, r.node): r.community for r in found.collect()}
    assert set(home) == {(r[0], x) for r in rows for x in r[1:3]}
    assert all(home[i, c] == c for (i, _), c in home.items()) and all(c <= x for (_, x), c in home.items())
    got = {r.snapshot_id: r.modularity for r in community.modularity(e, found, resolution).collect()}
    for i, pairs in enumerate(graphs):
        a, b, w = (np.array(c) for c in zip(*pairs, strict=True))
        names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = code[: len(a)], code[len(a) :]
        neighbours = [{} for _ in names]
        for x, y, z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            neighbours[x][y] = neighbours[y][x] = z
        own = np.unique([home[i, f"n{x:03d}"] for x in names], return_inverse=True)[1]
        assert sequential.modularity(neighbours, np.zeros(len(names)), own, resolution) == pytest.approx(got[i])
        best = max(sequential.modularity(neighbours, np.zeros(len(names)), sequential.louvain(a, b, w, len(names), resolution, seed), resolution) for seed in (1, 2))
        assert got[i] >= best - 0.02 * max(abs(best), 0.1), (i, got[i], best)


def test_one_snapshot_is_many_tasks(spark):
    pairs = planted(np.random.default_rng(3), 60, 20, 60, 100)
    e = spark.createDataFrame([(0, f"n{a:04d}", f"n{b:04d}", w, 0.0, 1) for a, b, w in pairs], EDGE)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        found = community.louvain_communities(e, resolution=1.0, max_level=1)
        assert found.groupBy(F.spark_partition_id()).count().filter("count > 0").count() > 2  # a snapshot's nodes lie in many tasks
        assert found.select("community").distinct().count() < 300
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_louvain_of_self_loops_and_no_edges(spark):
    e = table(spark, [("a", "a", 1.0), ("b", "c", 1.0)])
    assert {(r.node, r.community) for r in community.louvain_communities(e, resolution=1.0).collect()} == {("a", "a"), ("b", "b"), ("c", "b")}
    assert community.louvain_communities(e.limit(0)).count() == 0


def test_a_balls_tasks_grow_with_its_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pairs = {(a, b) for a, b in rng.integers(0, 60, (240, 2)).tolist() if a != b}
    e = table(spark, [(f"n{a:02d}", f"n{b:02d}", float(a * 3 + b)) for a, b in sorted(pairs)])
    want = {(r.snapshot_id, r.node): r for r in neighbourhood.features(e, graph.nodes(e), limit=0).collect()}
    monkeypatch.setattr(neighbourhood, "ROWS", 100)
    held, tasks = neighbourhood.lists(e, Pins(spark, "test"), "weight")
    rows = neighbourhood.sent(held, tasks, "weight")
    assert tasks > 16 and rows.rdd.getNumPartitions() == tasks >= rows.count() / 100
    ball, dealt = (neighbourhood.members(e, graph.nodes(e), limit) for limit in (512, 3))
    assert ball.rdd.getNumPartitions() > 16 and dealt.rdd.getNumPartitions() > 16
    assert sorted(map(tuple, ball.collect())) == sorted(map(tuple, dealt.collect()))
    for r in neighbourhood.features(e, graph.nodes(e)).collect():
        for c in FEATURES:
            assert r[c] == pytest.approx(want[0, r.node][c], rel=1e-9, abs=1e-6), (r.node, c)


def test_block_features_exchange_lists_not_third_steps(spark):
    rng = np.random.default_rng(2)
    pairs = {(a, b) for a, b in rng.integers(0, 1500, (6000, 2)).tolist() if a != b}
    e = table(spark, [(f"n{a:04d}", f"n{b:04d}", 1.0) for a, b in sorted(pairs)])
    context = spark.sparkContext

    def exchanged():
        none = context._gateway.new_array(context._jvm.double, 0)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = exchanged()
    neighbourhood.features(e, graph.nodes(e)).write.format("noop").mode("overwrite").save()
    own = sum(n for k, n in exchanged().items() if k not in before)
    assert 0 < own < 40 * len(pairs), own  # 66 an edge where edges are looked for from far members


def test_louvain_settles_a_block_in_a_task_and_a_large_snapshot_in_many(spark, monkeypatch):
    rng = np.random.default_rng(9)
    graphs = [planted(rng, 12, 15, 60, 80), planted(rng, 4, 30, 60, 200)]
    e = spark.createDataFrame([(i, f"n{a:03d}", f"n{b:03d}", w, 0.0, 1) for i, pairs in enumerate(graphs) for a, b, w in pairs], EDGE).repartition(3)
    put, made = Pins.put, []
    monkeypatch.setattr(Pins, "put", lambda self, df: made.append(df) or put(self, df))
    community.louvain_communities(e, resolution=1.0, max_level=1)
    assert len(made) < 20, len(made)  # one round a level; rounds of single moves make two tables each
    whole = community.louvain_communities(e, resolution=1.0)
    monkeypatch.setattr(community, "BLOCK", 150)
    parted = community.louvain_communities(e, resolution=1.0)
    a, b = ({r.snapshot_id: r.modularity for r in community.modularity(e, x, 1.0).collect()} for x in (whole, parted))
    assert all(b[i] >= 0.9 * a[i] > 0 for i in a), (a, b)


def test_block_sums_do_not_depend_on_the_tiles_and_exchange_no_edges_with_balls(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = {(a, b) for a, b in rng.integers(0, 200, (700, 2)).tolist() if a != b}
    e = table(spark, [(f"n{a:03d}", f"n{b:03d}", float(a * 3 - b * 2)) for a, b in sorted(pairs)])
    want = {r.node: r for r in neighbourhood.features(e, graph.nodes(e), neighbourhood.members(e, graph.nodes(e))).collect()}
    for ids, edges, looks in ((8_000_000, 1_000_000, 1 << 21), (2000, 150, 50)):
        for name, value in (("IDS", ids), ("EDGES", edges), ("LOOKS", looks)):
            monkeypatch.setattr(neighbourhood, name, value)
        got = {r.node: r for r in neighbourhood.features(e, graph.nodes(e)).collect()}
        assert set(got) == set(want)
        for k, r in want.items():
            for c in FEATURES:
                assert got[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-6), (ids, k, c)
    assert not neighbourhood.crowded(graph.arcs(e), 512) and neighbourhood.crowded(graph.arcs(e), 2)


def test_order_stats_by_tiles_are_those_of_the_members_and_meet_across_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = {(a, b) for a, b in rng.integers(0, 60, (200, 2)).tolist() if a != b}
    e = table(spark, [(f"n{a:03d}", f"n{b:03d}", float(a * 3 - b * 2)) for a, b in sorted(pairs)])
    rows = lambda df: {(r.ego, r.i, r.j): (r.min, r.median, r.iqr) for r in df.collect()}
    want = rows(neighbourhood.block_order_stats(e, neighbourhood.members(e, graph.nodes(e))))
    for edges in (1_000_000, 60):
        monkeypatch.setattr(neighbourhood, "EDGES", edges)
        got = rows(neighbourhood.block_orders(e, graph.nodes(e)))
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    got = rows(neighbourhood.block_orders(e, graph.nodes(e), limit=2))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_members_are_looked_up_in_memory_that_does_not_grow_with_the_names_of_a_snapshot():
    n = 40_000
    names = pa.array([f"n{i}" for i in range(n)])
    turned = pa.array([f"n{(i + 1) % n}" for i in range(n)])
    left = pa.table({"snapshot_id": pa.array([0] * n, pa.int32()), "ego": names, **{f"t{k}": pa.array([[x] for x in c.to_pylist()]) for k, c in enumerate((names, turned))}, "t2": pa.array([[]] * n, pa.list_(pa.string()))})
    right = pa.table({"src": names, "dst": turned, "weight": pa.array(np.ones(n))})
    met = list(neighbourhood._inside(left, right, ["weight"]))
    assert sum(len(block) for _, _, block, _ in met) == n and len(met) <= 10  # before: a pass for each 209 balls


def test_sums_of_several_tiles_merge_to_those_of_all_their_values(spark):
    x = {"amount_trans": ([1.0, 5.0, 9.0], [2.0]), "num_trans": ([1.0, 2.0, 3.0], [7.0])}
    part = lambda k: {"i": 0, "j": 1, "nnz": len(x["num_trans"][k]), "weight": 1.0, **{f"{v}_{n}": float(f(x[v][k])) for v in VALUES for n, f in (("sum", np.sum), ("max", np.max), ("avg", np.mean), ("var", np.var))}}
    entry = "i: int, j: int, nnz: bigint, " + ", ".join(f"{c}: double" for c in neighbourhood.NAMES[1:])
    ball = spark.createDataFrame([(0, "a", 1, 4, 0)], "snapshot_id int, ego string, n0 long, n1 long, n2 long")
    tiles = spark.createDataFrame([(0, "a", [part(k)]) for k in range(2)], f"snapshot_id int, ego string, blocks array<struct<{entry}>>")
    got = neighbourhood._merged(ball, tiles).first().blocks[0].asDict()
    assert got["nnz"] == 4 and got["weight"] == 2.0
    for v in VALUES:
        every = x[v][0] + x[v][1]
        assert [got[f"{v}_{n}"] for n in ("sum", "max", "avg", "var")] == pytest.approx([sum(every), max(every), np.mean(every), np.var(every)])


def test_louvain_takes_a_snapshot_through_its_levels_in_one_task_with_few_tables(spark, monkeypatch):
    rng = np.random.default_rng(11)
    e = spark.createDataFrame([(0, f"n{a:03d}", f"n{b:03d}", w, 0.0, 1) for a, b, w in planted(rng, 12, 15, 60, 80)], EDGE)
    put, made = Pins.put, []
    monkeypatch.setattr(Pins, "put", lambda self, df: made.append(df) or put(self, df))
    four = community.louvain_communities(e, resolution=1.0)
    assert len(made) <= 3, len(made)  # before: eight tables a level and more
    monkeypatch.setattr(community, "MANY", 0)
    a, b = (community.modularity(e, x, 1.0).first().modularity for x in (four, community.louvain_communities(e, resolution=1.0)))
    assert a >= b >= 0.9 * a > 0


def test_thick_balls_are_found_beside_the_edges_and_members_are_not_exchanged(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pairs = {(a, b) for a, b in zip(rng.integers(0, 150, 900).tolist(), rng.integers(0, 12, 900).tolist(), strict=True) if a != b}
    e = table(spark, [(f"n{a:03d}", f"n{b:03d}", float(a * 3 - b * 2)) for a, b in sorted(pairs)])
    egos = graph.nodes(e).unionByName(spark.createDataFrame([(0, "alone"), (1, "elsewhere")], "snapshot_id int, node string"))
    want = {(r.snapshot_id, r.node): r for r in neighbourhood.features(e, egos, neighbourhood.members(e, egos)).collect()}
    monkeypatch.setattr(neighbourhood, "balls", lambda *_: pytest.fail("lists of members were made"))
    monkeypatch.setattr(neighbourhood, "PATHS", 1000)
    for mean, limit, work in ((4, 512, 10**9), (4, 5, 30_000)):
        monkeypatch.setattr(neighbourhood, "MEAN", mean)
        monkeypatch.setattr(neighbourhood, "WORK", work)
        assert neighbourhood.thick(e, limit)
        got = {(r.snapshot_id, r.node): r for r in neighbourhood.features(e, egos, limit=limit).collect()}
        assert set(got) == set(want)
        for k, r in want.items():
            for c in FEATURES:
                assert got[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-6), (k, c)
    star = table(spark, [("hub", f"n{i:03d}", 1.0) for i in range(600)])
    assert not neighbourhood.thick(star, 256)  # one signature: ``hubs`` has less to do
