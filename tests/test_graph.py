"""Golden values on tiny graphs, properties, and edge cases of the graph engine."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from meshspark.functions import ordering
from meshspark.graph import Graph, bucket_count, csr_decode
from meshspark.operators import algorithms as A
from meshspark.operators import gas
from meshspark.operators import partitioning as P
from meshspark.plans.config import RunConfig, mean_seconds, timed_rounds

G8 = [(0, 1, 4), (0, 2, 1), (1, 3, 1), (2, 1, 2), (2, 3, 5), (3, 4, 3), (3, 7, 9), (4, 0, 7), (4, 5, 2), (5, 7, 1)]


def graph(spark, n, edges):
    weighted = bool(edges) and len(edges[0]) == 3
    return Graph(spark.range(n), spark.createDataFrame(edges, "src long, dst long" + (", w long" if weighted else "")))


@pytest.fixture(scope="module")
def g8(spark):
    return graph(spark, 8, G8).saved()


def values(df, column, digits=6):
    return [r[column] if not isinstance(r[column], float) else round(r[column], digits) for r in df.orderBy("id").collect()]


def test_degrees(g8):
    assert values(g8.out_degrees(), "out_degree") == [2, 1, 2, 2, 2, 1, 0, 0]
    assert values(g8.in_degrees(), "in_degree") == values(A.in_degree(g8), "in_degree") == [1, 2, 1, 2, 1, 1, 0, 2]
    assert tuple(g8.hub_concentration().first()) == (0.5, 0.8)


def test_transforms(g8):
    back = g8.transpose().transpose().edges
    assert sorted(map(tuple, back.collect())) == sorted((a, b) for a, b, _ in G8)
    assert sorted(map(tuple, csr_decode(g8.csr_adjacency()).collect())) == sorted((a, b) for a, b, _ in G8)
    assert values(g8.csr_offsets(), "offset") == [0, 2, 3, 5, 7, 9, 10, 10]
    assert g8.symmetrize().edges.count() == 20


@pytest.mark.parametrize("k, want", [
    (1, [0.575, 1.0, 0.575, 1.425, 0.575, 0.575, 0.15, 1.425]),
    (2, [0.394375, 0.63875, 0.394375, 1.244375, 0.755625, 0.394375, 0.15, 1.244375]),
    (20, [0.326173, 0.411299, 0.288626, 0.622305, 0.414505, 0.326173, 0.15, 0.691758]),
])
def test_pagerank(g8, k, want):
    assert values(A.pagerank(g8, k), "rank") == want


@pytest.mark.parametrize("mode, k, want", [
    ("sparse", 2, [0.394375, 1.48875, 0.394375, 0.394375, 0.755625, 0.394375, 0.15, 2.455625]),
    ("dense", 2, [0.394375, 1.48875, 0.394375, 1.244375, 0.755625, 0.394375, 0.15, 2.455625]),
    ("sparse", 3, [0.471141, 0.485219, 0.317609, 1.583047, 0.317609, 0.471141, 0.15, 2.740109]),
    ("dense", 3, [0.471141, 0.485219, 0.317609, 1.583047, 0.678859, 0.471141, 0.15, 3.101359]),
    ("sparse", 20, [0.360271, 0.375138, 0.252359, 0.629287, 0.436099, 0.360271, 0.15, 4.317567]),
])
def test_pagerank_delta(g8, mode, k, want):
    # the fixture lists values scaled back by the out-degree where there is one
    state = A.pagerank_delta(g8, k, mode).state.select("id", (F.col("p") * F.greatest("od", F.lit(1))).alias("p"))
    assert values(state, "p") == want


def test_bfs(g8):
    got = A.bfs(g8)
    assert values(got.state, "level") == [3, 0, 4, 1, 2, 3, None, 2]
    assert values(got.state, "parent") == [4, 1, 0, 1, 3, 4, None, 3]
    assert got.supersteps == 5 and [t[1] for t in got.trace] == [1, 1, 2, 2, 1, 0]
    with pytest.raises(ValueError):
        A.bfs(g8, 99)


def test_sssp(g8):
    assert values(A.sssp(g8, 0).state, "dist") == [0, 3, 1, 4, 7, 9, 2**31, 10]
    assert values(A.sssp(g8, 1).state, "dist") == [11, 0, 12, 1, 4, 6, 2**31, 7]


def test_components(spark, g8):
    assert values(A.connected_components(g8).state, "label") == [0, 0, 0, 0, 0, 0, 6, 0]
    g5 = graph(spark, 5, [(1, 0), (2, 1), (3, 4)])
    assert values(A.connected_components(g5).state, "label") == [0, 1, 2, 3, 3]
    assert values(A.connected_components(g5, weak=True).state, "label") == [0, 0, 0, 3, 3]


@pytest.mark.parametrize("k, theta, want, active", [
    (3, 1e-9, [0.03125, 0.125, 0, 0.375, 0.1875, 0.03125, 0, 0.1875], None),
    (20, 1e-9, [0.007831, 0.009123, 0.005412, 0.016255, 0.011251, 0.007831, 0, 0.022075], None),
    (3, 0.06, [0, 0.125, 0, 0.375, 0.1875, 0, 0, 0.1875], [1, 3, 4, 7]),
    (6, 0.06, [0, 0.03125, 0, 0.078125, 0, 0, 0, 0.117188], [7]),
])
def test_nibble(g8, k, theta, want, active):
    state = A.nibble(g8, 1, k, theta).state
    assert values(state, "p") == want
    assert active is None or [r.id for r in state.where("active").orderBy("id").collect()] == active


@pytest.mark.parametrize("k, want", [(1, [0.5, 0.5]), (2, [0.25, 0.5]), (3, [0.25, 0.25])])
def test_nibble_residual(spark, k, want):
    assert values(A.nibble(graph(spark, 2, [(0, 1)]), 0, k, 0.3).state, "p") == want


def test_eigenvector(g8):
    scaled = A.eigenvector(g8, 20).withColumn("centrality", F.col("centrality") * 8 / 1e-9)
    assert values(scaled, "centrality", 3) == [145, 177, 97, 233, 201, 145, 0, 298]
    assert values(A.eigenvector(g8, 20, normalize=True), "centrality") == [0.280994, 0.343007, 0.187975, 0.451528, 0.389516, 0.280994, 0, 0.577491]


def test_collaborative_filtering(g8):
    one = A.collaborative_filtering(g8, 1).withColumn("latent", (F.col("latent") - 0.5) * 1e9)
    assert values(one, "latent", 3) == [131.075, 262.325, 131.075, 262.325, 131.075, 131.075, -0.175, 262.325]
    assert values(A.collaborative_filtering(g8, 20, step=0.1), "latent") == [0.998255, 1.053155, 0.972589, 0.987679, 0.939878, 0.998255, 0.499001, 1.020615]


def test_hits(g8):
    got = A.hits(g8, 20)
    assert values(got, "auth") == [0.000034, 0.736919, 0.32796, 0.590963, 0.006563, 0.000034, 0, 0.010619]
    assert values(got, "hub") == [0.590972, 0.327965, 0.73693, 0.009535, 0.000037, 0.005893, 0, 0]
    assert values(A.hits_literal(g8, 3), "auth") == [0] * 8


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all edges leave vertex 0; repeated edges and loops among the others."""
    edges = [(0, 1 + i % 99, 1 + i % 5) for i in range(300)] + [(i * 7 % 100, (i * i + 3) % 100, 1 + i % 9) for i in range(600)]
    g = graph(spark, 100, edges).saved()
    return g, g.placed_by_source(buckets=8)


def test_placed_edges(spark, skewed):
    plain, placed = skewed
    light, heavy, ids = placed.placed.light, placed.placed.heavy, placed.placed.ids
    assert [r[0] for r in ids.collect()] == [0] and heavy.where("src <> 0").isEmpty() and light.where("src = 0").isEmpty()
    assert sorted(map(tuple, light.union(heavy).collect())) == sorted(map(tuple, plain.edges.collect()))
    for run, column in [
        (lambda g: A.pagerank(g, 5), "rank"), (lambda g: A.pagerank_delta(g, 4).state, "p"), (lambda g: A.bfs(g, 3).state, "parent"), (lambda g: A.sssp(g, 3).state, "dist"),
        (lambda g: A.nibble(g, 1, 4).state, "p"), (lambda g: A.connected_components(g).state, "label"), (lambda g: A.hits(g, 3), "hub"), (A.in_degree, "in_degree"),
    ]:
        assert values(run(placed), column) == values(run(plain), column)
    even = graph(spark, 8, [(i, (i + 1) % 8) for i in range(8)]).placed_by_source(buckets=1)
    assert even.placed.heavy is None and values(A.in_degree(even), "in_degree") == [1] * 8


def test_placed_edges_are_not_shuffled(spark, skewed, monkeypatch):
    placed = skewed[1]
    p = gas.VertexProgram({"x": F.lit(1.0)}, F.col("x"), {"m": F.sum("msg")}, dense=True)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = gas.messages(gas.start(placed, p), placed.placed.light, p.message)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = plan[plan.index("SortMergeJoin") :]
    right = join[join.index("FileScan parquet spark_catalog") :]
    above = join[: join.index("FileScan parquet spark_catalog")].rsplit("\n", 4)[1:]
    assert "Bucketed: true" in right and not any("Exchange" in line for line in above), plan
    monkeypatch.setattr("meshspark.graph.PLACE_EDGES", 10)
    assert skewed[0].saved().placed is not None


def test_placed_supersteps_shuffle_messages_alone(spark):
    """No table is broadcast, however small, and neither the state nor the edges are shuffled or sorted."""
    g = graph(spark, 40, [(i, i * 7 % 40) for i in range(40)]).placed_by_source(buckets=8)
    p = gas.VertexProgram({"x": F.lit(1.0)}, F.col("x"), {"m": F.sum("msg")}, apply={"x": F.coalesce("m", F.lit(0.0))})
    for dense in (True, False):
        state = gas.written(gas.start(g, p), g.sending())
        plan = gas.superstep(state, g.sending(), replace(p, dense=dense), 1)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Broadcast" not in plan and "Sort" not in plan.replace("SortMerge", "Sort"), plan
        gas.dropped(state)
    assert not [t for t in spark.catalog.listTables() if t.name == state.table] and g.placed_by_source() is g
    before = spark.conf.get("spark.sql.shuffle.partitions")
    A.pagerank(g, 2)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_buckets_follow_the_edges(spark):
    assert [bucket_count(spark, n) for n in (0, 10**6, 10**8)] == [8, 8, 25]


def test_trace_of_partitions_in_one_job(spark, monkeypatch):
    """Active and dense bins come from one aggregation; bins whose active vertices have no edges count as active."""
    monkeypatch.setattr(gas, "active_partitions", None)
    g = graph(spark, 8, [(0, 7, 1), (0, 3, 1)])
    assert A.bfs(g, 0, bins=P.Bins(2, 4)).partitions == [(0, 1, 1), (1, 2, 0)]


def test_partitions(g8):
    bins = P.bin_params(8, 1)
    assert (bins.width, bins.count) == (2, 4)
    assert {tuple(r) for r in P.bin_matrix(g8, bins).collect()} == {(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 0, 1), (2, 2, 1), (2, 3, 1)}
    assert {tuple(r) for r in P.intra_edges(g8, bins).collect()} == {(0, 1), (2, 3), (4, 5)}
    assert [r.is_dense for r in P.density(g8, bins).orderBy("pid").collect()] == [True, True, True, False]
    assert P.png_compression(g8, bins).first().runs == 10


def test_dynamic_split(spark):
    degrees = [6, 6, 5, 4, 1, 0, 1, 0, 1, 1, 0, 1, 2, 0, 1, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0]
    g = graph(spark, 32, [(i, (i + 5 + k) % 32) for i, d in enumerate(degrees) for k in range(d)])
    bins = P.bin_params(32, 2)
    t = P.bin_table(g, bins, True).orderBy("bin").collect()
    assert (bins.width, bins.count) == (4, 8) and [r.edges for r in t] == [21, 2, 3, 3, 1, 1, 1, 1]
    assert [r["div"] for r in t] == [2, 1, 1, 1, 1, 1, 1, 1] and [r.sub_map for r in t] == [0, 2, 3, 4, 5, 6, 7, 8] and [r.sub_offset for r in t] == [1] + [2] * 7
    pid = values(P.locate(g.vertices, g, bins, True), "pid")
    assert pid == [0, 0, 1, 1] + [2 + i // 4 for i in range(28)]
    for r in P.partitions(g, bins, True).collect():
        assert all(pid[v] == r.pid for v in range(r.start_v, r.end_v))


@pytest.mark.parametrize("args, want", [((8, 20, 256), (4, 2)), ((8, 1, 256), (2, 4)), ((16, 2, 256), (2, 8)), ((2000, 20, 256), (16, 125)), ((2000, 4, 256), (64, 32)), ((10_000_000, 20, 256), (65536, 153))])
def test_bin_params(args, want):
    b = P.bin_params(*args)
    assert (b.width, b.count) == want


def test_edge_cases(spark):
    lone = graph(spark, 1, [(0, 0)])
    assert values(A.pagerank(lone, 2), "rank") == [1.0]
    twice = graph(spark, 2, [(0, 1), (0, 1)])
    assert values(twice.in_degrees(), "in_degree") == [0, 2]
    none = Graph(spark.range(3), spark.createDataFrame([], "src long, dst long, w long"))
    assert values(A.connected_components(none).state, "label") == [0, 1, 2]
    assert values(A.sssp(none, 1).state, "dist") == [2**31, 0, 2**31]
    assert [r["div"] for r in P.bin_table(none, P.Bins(1, 3), True).collect()] == [1, 1, 1]
    assert none.hub_concentration().first() is not None


def test_custom_program(g8):
    """A user's program: the largest id that reaches each vertex."""
    p = gas.VertexProgram({"top": F.col("id")}, F.col("top"), {"m": F.max("msg")}, activate=F.col("m") > F.col("top"), gather={"top": F.greatest("top", "m")})
    assert values(gas.run(g8, p).state, "top") == [5 if i == 5 else v for i, v in enumerate([4, 4, 4, 4, 4, 5, 6, 7])]


def test_frontier(spark, g8):
    p = gas.VertexProgram({"x": F.lit(0)}, F.col("x"), {"m": F.sum("msg")})
    state, bins = gas.start(g8, p), P.Bins(2, 4)
    for ids in ([1, 2, 2, 5, 99], spark.createDataFrame([(5,), (1,), (2,)], "v long")):
        loaded = gas.load_frontier(state, ids)
        assert loaded.columns == state.columns and sorted(r.id for r in gas.get_frontier(loaded).collect()) == [1, 2, 5]
    assert sorted(map(tuple, gas.frontier_offsets(loaded, bins).collect())) == [(0, 1, 0), (1, 1, 1), (2, 1, 2)]
    assert sorted(r.pid for r in gas.active_partitions(loaded, bins).collect()) == [0, 1, 2]
    assert gas.get_frontier(gas.reset_frontier(loaded)).isEmpty() and gas.get_frontier(gas.load_frontier(state, [])).isEmpty()


@pytest.mark.parametrize("fused", [1, 2, 5])
def test_fused_supersteps(g8, monkeypatch, fused):
    """However many supersteps share a write: same results, same trace, and no more than the last two states stay."""
    monkeypatch.setattr(gas, "FUSED", fused)
    kept = []
    real = gas.cut
    monkeypatch.setattr(gas, "cut", lambda df, *a: kept.append(real(df, *a)) or kept[-1])
    got = A.bfs(g8)
    assert got.supersteps == 5 and [t[1] for t in got.trace] == [1, 1, 2, 2, 1, 0] and [t[0] for t in got.trace] == list(range(6))
    assert values(got.state, "level") == [3, 0, 4, 1, 2, 3, None, 2]
    assert sum(k.written_to is not None for k in kept) == min(2, len(kept))
    assert A.bfs(g8, iterations=2).supersteps == 2


def hybrid(n, edges, width, k):
    """Delta PageRank where bins whose active edges outweigh their compressed messages send from all vertices, plainly."""
    od = [sum(a == v for a, *_ in edges) for v in range(n)]
    bins = (n - 1) // width + 1
    png = [len({(a, b // width) for a, b, *_ in edges if a // width == i}) for i in range(bins)]
    total = [sum(od[i * width : (i + 1) * width]) for i in range(bins)]
    p, old, act, seen = [1 / max(1, d) for d in od], [0.0] * n, [True] * n, []
    for step in range(k):
        on = [sum(od[v] for v in range(n) if act[v] and v // width == i) for i in range(bins)]
        dense = [28 * on[i] > 10.5 * png[i] + 2.67 * total[i] + 4 * bins for i in range(bins)]
        seen.append((step, len({v // width for v in range(n) if act[v]}), sum(dense)))
        got = {}
        for a, b, *_ in edges:
            if act[a] or dense[a // width]:
                got[b] = got.get(b, 0.0) + p[a]
        for v in range(n):
            front = act[v] or v in got
            before = p[v]
            if act[v]:
                old[v], p[v] = p[v], 0.0
            p[v] += got.get(v, 0.0)
            if front:
                p[v] = (0.15 + 0.85 * p[v]) / max(1, od[v])
            act[v] = front and od[v] > 0 and abs(old[v] - p[v]) > 0.01 / od[v]
    return p, seen


def test_sending_by_density(spark):
    edges = [(i * 5 % 24, (i * i + 2) % 24, 1) for i in range(90)] + [(i, (i + 1) % 24, 1) for i in range(24)]
    g = graph(spark, 24, edges).saved()
    for k in (1, 3, 6):
        want, seen = hybrid(24, edges, 4, k)
        got = A.pagerank_delta(g, k, bins=P.Bins(4, 6))
        assert values(got.state, "p") == [round(v, 6) for v in want] and got.partitions == seen
    assert any(0 < d < a for _, a, d in hybrid(24, edges, 4, 6)[1]) or any(d for *_, d in hybrid(24, edges, 4, 6)[1])


def test_small_frontiers_prune_the_scan(spark, skewed):
    placed = skewed[1]
    some = gas._pruned(placed.placed, gas.load_frontier(gas.start(placed, gas.VertexProgram({}, F.lit(1), {})), [3, 5]))
    plan = some.light._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(src" in plan
    assert {r.src for r in some.light.collect()} <= {3, 5}


def test_hubs_spread(spark):
    """Positions and run changes of a hub equal plain windows; no window is partitioned by the hub's key alone."""
    from pyspark.sql import Window

    edges = [(i % 400, 7) for i in range(400)] + [(9, i * 13 % 401) for i in range(401)] + [(i, i + 1) for i in range(50)]
    g, bins = graph(spark, 402, edges), P.Bins(16, 26)
    w = Window.partitionBy("dst").orderBy("src")
    want = sorted(map(tuple, g.edges.select("src", "dst", (F.row_number().over(w) - 1).alias("pos")).collect()))
    assert sorted(map(tuple, g.adjacency_position().collect())) == want
    w = Window.partitionBy("src").orderBy("dst")
    want = sorted(map(tuple, P.placed_edges(g, bins).select("src", "dst", (F.coalesce(F.lag("pdst").over(w), F.lit(-1)) != F.col("pdst")).alias("new_run")).collect()))
    assert sorted(map(tuple, P.run_changes(g, bins).collect())) == want


def test_release(spark, tmp_path):
    import os

    from meshspark import storage

    df = storage.cut(spark.range(5), "gone")
    path = df.written_to
    assert os.path.exists(path)
    storage.release(df, spark.range(3), None)
    assert not os.path.exists(path) and df.written_to is None
    g = graph(spark, 8, G8).saved().placed_by_source(buckets=2)
    paths = [t.written_to for t in (g.vertices, g.edges, g.placed.light)]
    g.release()
    assert not any(os.path.exists(p) for p in paths) and not [t for t in spark.catalog.listTables() if t.name == g.placed.light.table]


def test_run_config(spark, g8, tmp_path):
    from meshspark.plans.config import ALGORITHMS, execute
    from meshspark.sources import csr

    c = RunConfig.parse("-d x -v 3 -s 4 -i 5 -r 1 -t 2 -y".split())
    assert c == RunConfig("x", 3, 4, 5, 1, 2, True) and RunConfig.parse([]) == RunConfig()
    path = str(tmp_path / "g.bin")
    csr.write_csr(g8.edges, path, 8, "mix")
    result, report = execute(spark, "pagerank", RunConfig(data=path, iterations=2, rounds=2))
    assert values(result, "rank") == values(A.pagerank(g8, 2), "rank") and report.count() == 2
    for name in ("bfs", "pagerank_delta", "in_degree"):
        result, report = execute(spark, name, RunConfig(iterations=1, rounds=1), g8)
        assert result.count() == 8 and report.first().counted
    assert len(ALGORITHMS) == 10


def test_sorts(spark):
    d = spark.createDataFrame([(3, 0), (1, 1), (3, 2), (2, 3)], "x long, pos long")
    assert [r.pos for r in ordering.sort_desc(d, "x", "pos").collect()] == [0, 2, 3, 1]
    assert [r.pos for r in ordering.sort_asc(d, "x", "pos").collect()] == [1, 3, 0, 2]
    assert [r.x for r in ordering.top_values(d, "x", 2).collect()] == [3, 3]
    big = spark.createDataFrame([(2**63 - 1, 2**63 - 3)], "a long, b long")
    assert big.select(ordering.midpoint(F.col("a"), F.col("b")).alias("m")).first().m == 2**63 - 2


def test_harness(spark):
    report = timed_rounds(spark, "x", lambda: spark.range(3), RunConfig(rounds=2))
    assert [r.counted for r in report.orderBy("round").collect()] == [False, True] and mean_seconds(report) > 0
    assert all(r.seconds == r.total and r.supersteps == 0 for r in report.collect())
    g = Graph(spark.range(4), spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    row = timed_rounds(spark, "y", lambda: A.pagerank(g, 3), RunConfig(rounds=1)).first()
    assert 0 < row.seconds < row.total and row.supersteps == 3


def test_command_line(spark, g8, tmp_path, capsys):
    from meshspark import __main__ as command
    from meshspark.sources import csr

    csr.write_csr_folder(g8.edges, str(tmp_path / "g"), 8, "mix")
    assert command.main(["pagerank", "-d", str(tmp_path / "g"), "-i", "2", "-r", "2", "-o", str(tmp_path / "out")], spark) > 0
    assert values(spark.read.parquet(str(tmp_path / "out")), "rank") == values(A.pagerank(g8, 2), "rank")
    said = capsys.readouterr().out
    assert "round 0" in said and "2 supersteps" in said and "(not counted)" in said
    with pytest.raises(SystemExit):
        command.main(["nothing"], spark)
    assert mean_seconds(timed_rounds(spark, "x", lambda: spark.range(3), RunConfig(rounds=1))) > 0
