"""Edges placed by partitions, propagation within blocks, dense bins, messages that see their target, components by contraction."""

import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshspark.graph import Graph
from meshspark.operators import algorithms as A
from meshspark.operators import blocks as K
from meshspark.operators import components as C
from meshspark.operators import gas
from meshspark.operators import layouts as L
from meshspark.operators.partitioning import Bins, png_runs

N = 64


def edges_of(seed=3, n=N, near=0.7):
    """Mostly short hops, a hub, a part that nothing reaches, repeated edges, self-loops, an isolated vertex."""
    r = random.Random(seed)
    out = []
    for v in range(n - 8):
        for _ in range(2):
            to = v + r.randint(0, 2) if r.random() < near else r.randrange(n - 8)
            out.append((v, min(to, n - 9), r.randint(1, 20)))
    out += [(9, t, r.randint(1, 20)) for t in range(0, n - 8)] + [(n - 4, n - 5, 2), (n - 5, 3, 1), out[4]]
    return out


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(spark.range(N), spark.createDataFrame(edges_of(), "src long, dst long, w long"))


def shortest(edges, n, start, step):
    """Plain relaxation until nothing changes; start: vertex -> value."""
    value = dict(start)
    while True:
        new = dict(value)
        for s, d, w in edges:
            if s in value and value[s] + step(w) < new.get(d, 1 << 60):
                new[d] = value[s] + step(w)
        if new == value:
            return value
        value = new


@pytest.mark.parametrize("bins, dynamic", [(Bins(8, 8), False), (Bins(16, 4), True)])
def test_blocks(graph, bins, dynamic, monkeypatch):
    monkeypatch.setattr(K, "CHANGES", 2)
    e = edges_of()
    labels = {r.id: r.value for r in K.components_by_blocks(graph, bins, dynamic).state.collect()}
    assert labels == shortest(e, N, {v: v for v in range(N)}, lambda w: 0)
    dist = {r.id: r.value for r in K.distances_by_blocks(graph, 1, bins, dynamic).state.collect()}
    want = shortest(e, N, {1: 0}, lambda w: w)
    assert dist == {v: want.get(v) for v in range(N)}
    levels = {r.id: r.value for r in K.levels_by_blocks(graph, 1, bins, dynamic).state.collect()}
    want = shortest(e, N, {1: 0}, lambda w: 1)
    assert levels == {v: want.get(v) for v in range(N)}


@pytest.mark.parametrize("most, few", [(1, 64), (10, 0)])
def test_heavy_blocks_are_split(graph, most, few, monkeypatch):
    """Edges beyond a block's bound go with those across blocks; many touched blocks are found by a join."""
    monkeypatch.setattr(K, "FEW_BLOCKS", few)
    b = K.blocks_of(graph, F.when(F.col("id") == 1, F.lit(0)), F.col("w"), Bins(16, 4), False, most)
    distinct = {(s, d) for s, d, _ in edges_of()}
    inner = sum(s // 16 == d // 16 for s, d in distinct)
    assert b.inside.where("not vertex").count() < inner and b.inside.where("not vertex").count() + b.across.edges.count() == len(distinct)
    got = {r.id: r.value for r in K.propagate(b).state.collect()}
    want = shortest(edges_of(), N, {1: 0}, lambda w: w)
    assert got == {v: want.get(v) for v in range(N)}


def test_blocks_need_few_supersteps(spark):
    """A long path with jumps: at most a third of the supersteps, and only touched blocks count."""
    n = 400
    e = [(v, v + 1, 1 + v % 5) for v in range(n - 1)] + [(v, v + 150, 700) for v in range(0, 200, 40)]
    g = Graph(spark.range(n), spark.createDataFrame(e, "src long, dst long, w long")).saved()
    near = K.distances_by_blocks(g, 0, Bins(64, 7), False)
    want = shortest(e, n, {0: 0}, lambda w: w)
    assert {r.id: r.value for r in near.state.collect()} == want
    assert near.supersteps <= 12 and all(touched <= 4 for _, touched, _, _ in near.trace[1:])
    plain = A.sssp(g, 0, 3 * near.supersteps)
    assert plain.state.where(F.col("dist") < A.UNREACHED).count() < n
    g.release()


def test_blocks_of_nothing(spark):
    g = Graph(spark.range(3), spark.createDataFrame([], "src long, dst long, w long"))
    assert sorted(map(tuple, K.components_by_blocks(g, Bins(2, 2)).state.collect())) == [(0, 0), (1, 1), (2, 2)]
    assert {r.value for r in K.distances_by_blocks(g, 7, Bins(2, 2)).state.collect()} == {None}


def test_block_values_are_exact():
    """Ids beyond 2**53, where doubles would round."""
    big = (1 << 60) + 1
    block = pd.DataFrame({"_pid": 0, "vertex": [True, True, False], "src": [big, big + 1, big], "dst": [0, 0, big + 1], "step": [0, 0, 1], "value": [0, 0, 0], "has": [False] * 3})
    got = K.relaxed(pd.DataFrame({"_pid": [0], "id": [big], "value": [big], "fresh": [True]}), block)
    assert got[["id", "value"]].values.tolist() == [[big, big], [big + 1, big + 1]]


def test_block_functions_need_no_package(tmp_path):
    from pyspark import cloudpickle

    (tmp_path / "x").write_bytes(cloudpickle.dumps(K.relaxed))
    code = f"import pickle, sys; f = pickle.loads(open({str(tmp_path / 'x')!r}, 'rb').read()); assert not any(m.startswith('meshspark') for m in sys.modules); print(f.__name__)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split() == ["relaxed"]


@pytest.mark.parametrize("bins", [Bins(64, 1), Bins(16, 4)])
def test_dense_bins_change_no_search(graph, bins):
    """Unvisited vertices of a dense bin don't send."""
    plain, by_bins = A.bfs(graph, 1), A.bfs(graph, 1, bins=bins)
    columns = ("id", "level", "parent")
    assert sorted(plain.state.select(*columns).collect()) == sorted(by_bins.state.select(*columns).collect())
    assert plain.trace == by_bins.trace
    assert any(dense for _, _, dense in by_bins.partitions) or bins.count > 2


def test_messages_see_their_target(graph, spark):
    a = {r.id: r.latent for r in A.collaborative_filtering(graph, 4, step=0.05).collect()}
    b = {r.id: r.latent for r in A.collaborative_filtering_by_edges(graph, 4, step=0.05).collect()}
    assert a == pytest.approx(b)
    values = spark.range(N).select("id", (F.col("id") * 7 % 11).alias("x"))
    got = {r.id: r.x for r in A.farthest_values(graph, values).collect()}
    assert got == {v: max((abs(s * 7 % 11 - v * 7 % 11) for s, d, _ in edges_of() if d == v), default=0) for v in range(N)}
    p = gas.VertexProgram({"x": F.col("id").cast("double")}, F.col("x") - F.col("to_x"), {"m": F.max("msg")}, apply={"x": F.coalesce("m", F.lit(0.0))}, dense=True, sees_target=True)
    once = lambda g: sorted(map(tuple, gas.run(g, p, 2).state.select("id", "x").collect()))
    assert once(graph) == once(graph.placed_by_source(buckets=4)) == once(L.by_source(graph, Bins(8, 8))) == once(L.by_target(graph, Bins(8, 8)))


@pytest.mark.parametrize("place", [lambda g: L.by_source(g, Bins(8, 8), False), lambda g: L.by_source(g, Bins(8, 8)), lambda g: L.by_target(g, Bins(8, 8))])
def test_layouts_agree(graph, place):
    g = place(graph)
    assert {r.id: round(r.rank, 9) for r in A.pagerank(g, 4).collect()} == {r.id: round(r.rank, 9) for r in A.pagerank(graph, 4).collect()}
    assert sorted(A.sssp(g, 1).state.select("id", "dist").collect()) == sorted(A.sssp(graph, 1).state.select("id", "dist").collect())
    g.placed.release()


def exchanged(df):
    """Text of the exchanges in the plan, without what cached tables were made by."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = next((len(x) - len(x.lstrip(" :+-*")) for x in plan if "InMemoryRelation" in x), 1 << 30)
    return [x for x in plan if "Exchange" in x and "Broadcast" not in x and len(x) - len(x.lstrip(" :+-*")) < depth]


def test_unequal_partitions_level_the_tasks(spark):
    """A hub's bin: cut by vertices as far as it goes, then by edges; and edges aren't shuffled in a superstep."""
    r = np.random.default_rng(2)
    rows = [(int(s), int(d)) for s, d in zip(r.integers(0, 256, 3000), r.integers(0, 256, 3000), strict=True)] + [(17, i % 256) for i in range(6000)]
    g = Graph(spark.range(256), spark.createDataFrame(rows, "src long, dst long"))
    equal = L.by_source(g, Bins(32, 8), False)
    most = lambda x: x.placed.edges.groupBy(F.spark_partition_id()).count().agg(F.max("count") / F.avg("count")).first()[0]
    cut = L.by_source(g, Bins(32, 8))
    pids = cut.placed.loads().groupBy("pid").agg(F.sum("edges").alias("n")).collect()
    assert sum(x.n for x in pids) == 9000 and cut.placed.loads().agg(F.sum("edges")).first()[0] == 9000
    held = L.balance(cut).first()
    assert held.most <= 2.6 * held.mean and held.tasks > 8
    whole = equal.placed.loads().groupBy("pid").agg(F.sum("edges").alias("n")).agg(F.max("n")).first()[0]
    assert whole > 3 * held.most and most(cut) < 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = cut.placed.deliver(g.vertices.withColumn("x", F.lit(1)), F.col("x"))
        assert len(exchanged(sent)) == 1 and sent.count() == 9000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    cut.placed.release()
    equal.placed.release()


def test_compressed_messages(graph, spark):
    """A superstep ships one row a sender and partition of its targets."""
    g = L.by_target(graph, Bins(8, 8))
    runs = png_runs(graph, Bins(8, 8)).agg(F.sum("runs")).first()[0]
    senders = spark.range(N).withColumn("x", F.lit(1))
    assert g.placed.sent(senders).count() == runs < len(edges_of())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = g.placed.deliver(senders, F.col("x"))
        assert len(exchanged(sent)) == 1 and "shufflepartitionidpassthrough" in exchanged(sent)[0]  # (senders find their routes further below)
        assert sent.count() == len(edges_of())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    g.placed.release()


def test_contraction_rounds(spark):
    """Chains in ascending, descending and random order, a star, a clique of stars: few rounds."""
    order = list(range(10_000, 11_000))
    random.Random(1).shuffle(order)
    links = [(v, v + 1) for v in range(1000)] + [(5000 - v, 4999 - v) for v in range(1000)] + list(zip(order, order[1:], strict=False)) + [(20_000, v) for v in range(20_001, 20_500)]
    found, rounds = C.contracted(spark.createDataFrame(links, "a long, b long"))
    got = {r.id: r.component for r in found.collect()}
    assert rounds < 25
    assert got == {v: 0 for v in range(1001)} | {v: 4000 for v in range(4000, 5001)} | {v: 10_000 for v in order} | {v: 20_000 for v in range(20_000, 20_500)}
    stars = [(100 * s, 100 * s + i) for s in range(20) for i in range(1, 90)]
    assert C.contracted(spark.createDataFrame(stars, "a long, b long"))[1] == 2
    g = Graph(spark.range(6), spark.createDataFrame([(4, 2), (2, 5), (3, 3)], "src long, dst long"))
    assert sorted(map(tuple, A.weak_components(g).collect())) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 2), (5, 2)]


def test_seconds_of_supersteps(graph):
    r = A.sssp(graph, 1)
    assert r.timed[-1][0] == r.supersteps and r.seconds > 0 and all(s > 0 for _, s in r.timed)


def test_work_follows_the_frontier(spark, graph, monkeypatch):
    """Rows written are those that were active or received; states are those of whole rewrites, however changes are laid over."""
    monkeypatch.setattr(gas, "CHANGES", 1)
    for go in (lambda **x: A.sssp(graph, 1, **x), lambda **x: A.bfs(graph, 1, **x)):
        plain, by = go(), go(by_changes=True)
        assert sorted(plain.state.collect()) == sorted(by.state.select(*plain.state.columns).collect())
        assert (plain.trace, plain.supersteps) == (by.trace, by.supersteps) and by.seconds > 0
    n = 300
    path = Graph(spark.range(n), spark.createDataFrame([(v, v + 1) for v in range(n - 1)], "src long, dst long"))
    r = A.bfs(path, 0, iterations=9, by_changes=True)
    assert r.written == [(k, 2) for k in range(1, 10)] and r.state.where("level is not null").count() == 10
