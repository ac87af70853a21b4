"""The ten algorithms as vertex programs.  Results are DataFrames keyed by ``id``."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, Placed
from .components import contracted
from .gas import Result, VertexProgram, dropped, record, run, run_by_changes, start, superstep, written
from .partitioning import Bins

# Fixed values.
TELEPORT = 0.15
UNREACHED = 2147483648
DELTA_EPS = 0.01
NIBBLE_THETA = 1e-9
CF_LAMBDA, CF_STEP = 0.001, 3.5e-7
ITERATIONS, ROOT = 20, 1

c = F.col


def _or0(name: str) -> Column:
    return F.coalesce(c(name), F.lit(0.0))


def _check_root(g: Graph, root: int) -> None:
    if g.vertices.where(c("id") == root).isEmpty():
        raise ValueError(f"root {root} is not a vertex")


def pagerank(g: Graph, iterations: int = ITERATIONS) -> DataFrame:
    """id, rank: rank' = teleport + (1 - teleport) * sum of rank / out-degree; mass of sinks is dropped."""
    p = VertexProgram({"rank": F.lit(1.0)}, c("rank") / c("od"), {"m": F.sum("msg")}, apply={"rank": TELEPORT + (1 - TELEPORT) * _or0("m")}, dense=True)
    return run(g, p, iterations).state.select("id", "rank")


def pagerank_delta(g: Graph, iterations: int = ITERATIONS, mode: str = "sparse", eps: float = DELTA_EPS, bins: Bins | None = None) -> Result:
    """State p, old: active vertices resend their scaled rank; ``mode='dense'`` lets all vertices send, ``bins`` those of dense bins.

    As defined it isn't a faster PageRank: converged vertices stop contributing.
    """
    scale = F.greatest(c("od"), F.lit(1))
    p = VertexProgram(
        {"p": 1.0 / scale, "old": F.lit(0.0)}, c("p"), {"m": F.sum("msg")},
        on_scatter={"old": c("p"), "p": F.lit(0.0)}, keep=F.lit(True), gather={"p": c("p") + c("m")},
        apply={"p": (TELEPORT + (1 - TELEPORT) * c("p")) / scale},
        stay=(c("od") > 0) & (F.abs(c("old") - c("p")) > eps / c("od")), send_all=mode == "dense",
    )
    return run(g, p, iterations, bins=bins)


def bfs(g: Graph, root: int = ROOT, iterations: int | None = None, bins: Bins | None = None, by_changes: bool = False) -> Result:
    """State level, parent (the least possible one); null where unreached.  ``by_changes``: in work that follows the frontier."""
    _check_root(g, root)
    at_root, none = c("id") == root, F.lit(None).cast("long")
    new = c("level").isNull()
    p = VertexProgram(
        {"level": F.when(at_root, F.lit(0).cast("long")).otherwise(none), "parent": F.when(at_root, c("id")).otherwise(none)}, c("id"), {"m": F.min("msg")},
        active=at_root, activate=new, valid=~new,
        gather=lambda k: {"level": F.coalesce(c("level"), F.lit(k).cast("long")), "parent": F.coalesce(c("parent"), c("m"))},
    )
    return run_by_changes(g, p, iterations) if by_changes else run(g, p, iterations, bins=bins)


def connected_components(g: Graph, weak: bool = False, iterations: int | None = None) -> Result:
    """State label: the least id that reaches the vertex; ``weak`` ignores directions."""
    p = VertexProgram({"label": c("id")}, c("label"), {"m": F.min("msg")}, activate=c("m") < c("label"), gather={"label": F.least(c("label"), c("m"))})
    return run(g.symmetrize().saved() if weak else g, p, iterations)


def weak_components(g: Graph) -> DataFrame:
    """id, label: the least id of the vertex's component, directions ignored, in rounds that grow with the logarithm of the vertices."""
    found, _ = contracted(g.edges.select(c("src").alias("a"), c("dst").alias("b")))
    found = found.withColumnRenamed("id", "_i")
    return g.vertices.join(found, c("id") == c("_i"), "left").select("id", F.coalesce("component", "id").alias("label"))


def sssp(g: Graph, root: int = ROOT, iterations: int | None = None, by_changes: bool = False) -> Result:
    """State dist: least sum of weights from the root.

    UNREACHED (2**31) marks vertices without a path, and those whose every path is as long or longer.
    """
    _check_root(g, root)
    p = VertexProgram(
        {"dist": F.when(c("id") == root, F.lit(0)).otherwise(F.lit(UNREACHED)).cast("long")}, c("dist") + c("w"), {"m": F.min("msg")},
        active=c("id") == root, activate=c("m") < c("dist"), gather={"dist": F.least(c("dist"), c("m"))},
    )
    return run_by_changes(g, p, iterations) if by_changes else run(g, p, iterations)


def nibble(g: Graph, root: int = ROOT, iterations: int = ITERATIONS, theta: float = NIBBLE_THETA) -> Result:
    """State p, ps of a truncated lazy walk; mass of vertices that leave without an apply step stays as it was."""
    _check_root(g, root)
    at_root, ok = c("id") == root, c("p") >= theta * c("od")
    p = VertexProgram(
        {"p": F.when(at_root, 1.0).otherwise(0.0), "ps": F.when(at_root & (c("od") > 0), 1.0 / (2 * c("od"))).otherwise(0.0)}, c("ps"), {"m": F.sum("msg"), "top": F.max("msg")},
        active=at_root, on_scatter={"p": c("p") / 2, "ps": F.lit(0.0)}, keep=ok, activate=c("top") > 0, gather={"p": c("p") + c("m")},
        apply={"ps": F.when(ok & (c("od") > 0), c("p") / (2 * c("od"))).otherwise(0.0), "p": F.when(ok, c("p")).otherwise(0.0)}, stay=ok,
    )
    return run(g, p, iterations)


def in_degree(g: Graph) -> DataFrame:
    """id, in_degree by one superstep that counts messages."""
    p = VertexProgram({"n": F.lit(1).cast("long")}, F.lit(1), {"m": F.sum("msg")}, apply={"n": F.coalesce(c("m"), F.lit(0)).cast("long")}, dense=True)
    return run(g, p, 1).state.select("id", c("n").alias("in_degree"))


def norm(df: DataFrame, value: str) -> float:
    """Square root of the sum of squares."""
    return df.agg(F.sqrt(F.sum(c(value) * c(value)))).first()[0] or 0.0


def _unit(df: DataFrame, *values: str) -> DataFrame:
    for v in values:
        n = norm(df, v)
        df = df.withColumn(v, c(v) / n) if n else df
    return df


def eigenvector(g: Graph, iterations: int = ITERATIONS, normalize: bool = False) -> DataFrame:
    """id, centrality: walk counts from 1e-9 / V; ``normalize`` divides by the length, which scaling between steps doesn't change."""
    v = g.vertices.count()
    p = VertexProgram({"x": F.lit(1e-9 / max(1, v))}, c("x"), {"m": F.sum("msg")}, apply={"x": _or0("m")}, dense=True)
    state = run(g, p, iterations, between=(lambda df: _unit(df, "x")) if normalize else None).state
    return (_unit(state, "x") if normalize else state).select("id", c("x").alias("centrality"))


def collaborative_filtering(g: Graph, iterations: int = ITERATIONS, lam: float = CF_LAMBDA, step: float = CF_STEP) -> DataFrame:
    """id, latent: rank-one factors for implicit ratings of 1, all updated from the values before the step."""
    x = c("x")
    p = VertexProgram({"x": F.lit(0.5)}, x, {"a": F.sum("msg"), "b": F.sum(c("msg") * c("msg"))}, apply={"x": x + step * (-lam * x + _or0("a") - x * _or0("b"))}, dense=True)
    return run(g, p, iterations).state.select("id", x.alias("latent"))


def collaborative_filtering_by_edges(g: Graph, iterations: int = ITERATIONS, lam: float = CF_LAMBDA, step: float = CF_STEP) -> DataFrame:
    """The same, said edge by edge: each message is the gradient of one rating, for which it sees both ends."""
    x, error = c("x"), 1 - c("x") * c("to_x")
    p = VertexProgram({"x": F.lit(0.5)}, error * x, {"m": F.sum("msg")}, apply={"x": x + step * (-lam * x + _or0("m"))}, dense=True, sees_target=True)
    return run(g, p, iterations).state.select("id", x.alias("latent"))


def farthest_values(g: Graph, values: DataFrame, iterations: int = 1) -> DataFrame:
    """id, x: after each superstep the largest difference between a vertex's value and one of its in-neighbours' (0 without one).

    ``values`` has id and x.  No fold of the senders' values alone gives it: each message needs the value at its target.
    """
    known = values.select(c("id").alias("_v"), c("x").cast("double").alias("_x"))
    p = VertexProgram({"x": F.lit(0.0)}, F.abs(c("x") - c("to_x")), {"m": F.max("msg")}, apply={"x": _or0("m")}, dense=True, sees_target=True)
    state = start(g, p).join(known, c("id") == c("_v"), "left").withColumn("x", F.coalesce("_x", F.lit(0.0))).drop("_v", "_x")
    for k in range(1, iterations + 1):
        state = superstep(state, g.sending(), p, k)
    return state.select("id", "x")


def hits(g: Graph, iterations: int = ITERATIONS) -> DataFrame:
    """id, auth, hub: textbook hubs and authorities, each of length 1."""
    edges, turned = g.sending(), g.transpose()
    if isinstance(edges, Placed):
        turned = turned.placed_by_source(buckets=edges.buckets)
    elif g.placed is not None:
        turned = turned.saved()
    back = turned.sending()
    auth = VertexProgram({}, c("hub"), {"m": F.sum("msg")}, apply={"auth": _or0("m")}, dense=True)
    hub = VertexProgram({}, c("auth"), {"m": F.sum("msg")}, apply={"hub": _or0("m")}, dense=True)
    state = g.out_degrees().withColumnRenamed("out_degree", "od").withColumns({"auth": F.lit(1.0), "hub": F.lit(1.0), "active": F.lit(True)})
    placed, states = isinstance(edges, Placed), []

    def keep(df: DataFrame) -> DataFrame:
        states.append(written(df, edges))
        if len(states) > 2:
            dropped(states.pop(0))
        return states[-1]

    state = keep(state) if placed else state
    began = time.perf_counter()
    for k in range(1, iterations + 1):
        state = superstep(state, edges, auth, k)
        state = superstep(keep(state) if placed else state, back, hub, k)
        if placed or k % 2 == 0 or k == iterations:
            state = keep(state)
        if k % 2 == 0 or k == iterations:
            state = _unit(state, "auth", "hub")
            now = time.perf_counter()
            record(k, now - began)
            began = now
    return state.select("id", "auth", "hub")


def hits_literal(g: Graph, iterations: int = ITERATIONS) -> DataFrame:
    """id, auth, hub of the variant that sums hubs over in-neighbours and zeroes authorities after each iteration."""
    from ..storage import cut

    first = VertexProgram({}, c("hub"), {"m": F.sum("msg")}, apply={"auth": c("auth") + _or0("m"), "hub": F.lit(0.0)}, dense=True)
    second = VertexProgram({}, c("auth"), {"m": F.sum("msg")}, apply={"hub": c("hub") + _or0("m"), "auth": F.lit(0.0)}, dense=True)
    state = g.out_degrees().withColumnRenamed("out_degree", "od").withColumns({"auth": F.lit(1e-8), "hub": F.lit(1e-8), "active": F.lit(True)})
    for k in range(1, iterations + 1):
        state = superstep(superstep(state, g.sending(), first, k), g.sending(), second, k)
        if k % 2 == 0 or k == iterations:
            state = cut(state)
    return state.select("id", "auth", "hub")
