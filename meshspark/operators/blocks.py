"""Propagation within blocks of vertices: a task relaxes its block to a local fixpoint, and only what crosses blocks is shuffled.

For programs whose value only falls and whose message is the value plus a step of the edge: least labels
(step 0), shortest distances (the weight), levels (1).  Vertices are cut into blocks, the unequal partitions
of ``partitioning``.  Edges inside a block lie with the block's first values in one table, bucketed by block; those
across blocks lie by source.  A superstep brings each block the least values that reached it, and what changed there before; its task takes the
vertices that improved through a worklist until none improves any more, and returns the rows that changed.
These go out along edges across blocks.

What a superstep costs follows its frontier: blocks that nothing reaches aren't read (their buckets are pruned where few are touched),
and what is written is the rows that changed; a vertex's value is the least of its rows, which are folded every
few supersteps.

A block has at most ``bins.width`` vertices and about ``BLOCK_EDGES`` edges inside: the minimum doesn't mind which edges count as inside, so of a block with more
(a hub's) the rest, chosen by hash, goes with the edges across.  Executors get this module's code with each task.
"""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import bucketed, cut, release
from .gas import messages
from .partitioning import Bins, locate

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges inside a block, about; touched blocks up to which their buckets are named in the scan; tables of changes up to which they aren't folded.
BLOCK_EDGES, FEW_BLOCKS, CHANGES = 1 << 20, 64, 4
c = F.col


@dataclass(frozen=True)
class Blocks:
    """``inside``: vertices (src, value, has) and edges (src, dst, step) of each _pid, bucketed by it; ``across``: a graph of the other edges, with w as step."""

    inside: DataFrame
    across: Graph
    graph: Graph
    bins: Bins
    dynamic: bool
    places: DataFrame

    def release(self) -> None:
        table = getattr(self.inside, "table", None)
        release(self.inside, self.places)
        if table is not None:
            self.inside.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        self.across.release()


@dataclass(frozen=True)
class Propagated:
    """``state``: id, value (null where nothing came); ``trace``: (superstep, blocks touched, rows changed, seconds) of each."""

    state: DataFrame
    supersteps: int
    trace: list[tuple[int, int, int, float]] = field(default_factory=list)


def blocks_of(g: Graph, value: Column, step: Column, bins: Bins, dynamic: bool = True, most: int = BLOCK_EDGES) -> Blocks:
    """The graph in blocks; ``value`` is a vertex's first value, from its ``id`` (null: none yet), ``step`` comes from an edge's columns."""
    places = cut(locate(g.vertices, g, bins, dynamic).select("id", "pid"), "block-places")
    # of edges with the same ends only the least step counts
    e = g.edges.select("src", "dst", step.cast("long").alias("step")).groupBy("src", "dst").agg(F.min("step").alias("step"))
    if dynamic:
        ps, pd_ = (places.select(c("id").alias(f"_{n}"), c("pid").alias(f"_p{n}")) for n in ("s", "d"))
        e = e.join(ps, c("src") == c("_s")).join(pd_, c("dst") == c("_d")).select("src", "dst", "step", c("_ps"), c("_pd"))
    else:
        e = e.select("src", "dst", "step", F.shiftright("src", bins.bits).alias("_ps"), F.shiftright("dst", bins.bits).alias("_pd"))
    e = cut(e, "block-edges")
    # a row a block: as many as the parameters of the run make
    load = e.where("_ps = _pd").groupBy(c("_ps").alias("_b")).agg(F.count(F.lit(1)).alias("_n")).where(c("_n") > most)
    e = e.join(F.broadcast(load), (c("_ps") == c("_b")) & (c("_ps") == c("_pd")), "left")
    share = F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 20)) < F.floor(F.lit(float(most << 20)) / c("_n"))
    own = F.coalesce((c("_ps") == c("_pd")) & (c("_n").isNull() | share), F.lit(False))
    zero, first = F.lit(0).cast("long"), value.cast("long")
    vertices = places.select(c("pid").alias("_pid"), F.lit(True).alias("vertex"), c("id").alias("src"), zero.alias("dst"), zero.alias("step"), F.coalesce(first, zero).alias("value"), first.isNotNull().alias("has"))
    inner = e.where(own).select(c("_ps").alias("_pid"), F.lit(False).alias("vertex"), "src", "dst", "step", zero.alias("value"), F.lit(False).alias("has"))
    spark = g.edges.sparkSession
    inside = bucketed(vertices.union(inner), "_pid", int(spark.conf.get("spark.sql.shuffle.partitions")), "blocks")
    across = Graph(places.select("id"), e.where(~own).select("src", "dst", c("step").alias("w"))).saved()
    release(e)
    return Blocks(inside, across, g, bins, dynamic, places)


def relaxed(news: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """_pid, id, value of a block's vertices that ``news`` (id, value, fresh) improve, at the block's fixpoint.

    Rows of ``news`` that aren't fresh tell values from before.
    """
    is_vertex = block["vertex"].to_numpy(bool)
    v = block[is_vertex].sort_values("src")
    ids = v["src"].to_numpy(np.int64)
    far = np.iinfo(np.int64).max
    # nulls make the whole column floating, where ids beyond 2**53 wouldn't be exact: so values come with a flag instead
    value = np.where(v["has"].to_numpy(bool), v["value"].to_numpy(np.int64), far)
    e = block[~is_vertex]
    src, dst = (np.searchsorted(ids, e[n].to_numpy(np.int64)) for n in ("src", "dst"))
    order = np.argsort(src, kind="stable")
    dst, step = dst[order], e["step"].to_numpy(np.int64)[order]
    first = np.searchsorted(src[order], np.arange(len(ids) + 1))
    at, got, fresh = np.searchsorted(ids, news["id"].to_numpy(np.int64)), news["value"].to_numpy(np.int64), news["fresh"].to_numpy(bool)
    np.minimum.at(value, at[~fresh], got[~fresh])
    before = value.copy()
    np.minimum.at(value, at[fresh], got[fresh])
    # the first superstep has no news: every vertex with a value is fresh
    work = np.nonzero(value < before)[0] if len(news) else np.nonzero(value < far)[0]
    changed = np.zeros(len(ids), bool)
    changed[work] = True
    while len(work):
        many = first[work + 1] - first[work]
        edge = np.repeat(first[work] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        to, reach = dst[edge], np.repeat(value[work], many) + step[edge]
        better = reach < value[to]
        to, reach = to[better], reach[better]
        np.minimum.at(value, to, reach)
        work = np.unique(to)
        changed[work] = True
    return pd.DataFrame({"_pid": block["_pid"].iloc[0], "id": ids[changed], "value": value[changed]}) if changed.any() else pd.DataFrame({"_pid": [], "id": [], "value": []}).astype("int64")


def propagate(b: Blocks, iterations: int | None = None) -> Propagated:
    """Supersteps until no value falls, or ``iterations`` of them."""
    spark = b.places.sparkSession
    edges, trace, k = b.across.sending(), [], 0
    changes: list[DataFrame] = []
    none = spark.createDataFrame([], "_pid long, id long, value long, fresh boolean")
    news, pids = none, None

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame({"_pid": [], "id": [], "value": []}).astype("int64")
        return relaxed(left, right)

    while iterations is None or k < iterations:
        began = time.perf_counter()
        block = b.inside
        if pids is not None:
            block = block.where(c("_pid").isin(pids)) if len(pids) <= FEW_BLOCKS else block
            for old in changes:
                told = old.select("_pid", "id", "value", F.lit(False).alias("fresh"))
                news = news.union(told.where(c("_pid").isin(pids)) if len(pids) <= FEW_BLOCKS else told)
            if len(pids) > FEW_BLOCKS:
                touched = spark.createDataFrame([(p,) for p in pids], "_t long")  # as many as blocks
                block, news = (t.join(F.broadcast(touched), c("_pid") == c("_t"), "left_semi") for t in (block, news))
        made = cut(news.groupBy("_pid").cogroup(block.groupBy("_pid")).applyInPandas(solve, "_pid long, id long, value long"), "block-changes")
        k += 1
        n = made.count()
        trace.append((k, len(pids) if pids is not None else -1, n, time.perf_counter() - began))
        changes.append(made)
        if not n:
            break
        sent = messages(made.select("id", "value"), edges, c("value") + c("w")).groupBy(c("_dst").alias("id")).agg(F.min("msg").alias("value"))
        if b.dynamic:
            sent = sent.join(b.places.select(c("id").alias("_i"), c("pid").alias("_pid")), c("id") == c("_i")).select("_pid", "id", "value")
        else:
            sent = sent.select(F.shiftright("id", b.bins.bits).alias("_pid"), "id", "value")
        sent = cut(sent, "block-news")
        pids = [r[0] for r in sent.select("_pid").distinct().collect()]  # as many as blocks
        if not pids:
            break
        news = sent.withColumn("fresh", F.lit(True))
        if len(changes) > CHANGES:
            folded = cut(_union(changes).groupBy("_pid", "id").agg(F.min("value").alias("value")), "block-changes")
            release(*changes)
            changes = [folded]
    first = b.inside.where("vertex").select(c("src").alias("id"), F.when(c("has"), c("value")).alias("value"))
    last = _union([*[t.select("id", "value") for t in changes], first]).groupBy("id").agg(F.min("value").alias("value"))
    state = cut(last, "block-state")
    release(*changes)
    return Propagated(state, k, trace)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def components_by_blocks(g: Graph, bins: Bins, dynamic: bool = True, weak: bool = False) -> Propagated:
    """value: the least id that reaches the vertex (``weak``: directions ignored)."""
    b = blocks_of(g.symmetrize() if weak else g, c("id"), F.lit(0), bins, dynamic)
    out = propagate(b)
    b.release()
    return out


def distances_by_blocks(g: Graph, root: int, bins: Bins, dynamic: bool = True) -> Propagated:
    """value: least sum of weights from the root, null where there is no path."""
    b = blocks_of(g, F.when(c("id") == root, F.lit(0)), c("w"), bins, dynamic)
    out = propagate(b)
    b.release()
    return out


def levels_by_blocks(g: Graph, root: int, bins: Bins, dynamic: bool = True) -> Propagated:
    """value: fewest edges from the root, null where there is no path."""
    b = blocks_of(g, F.when(c("id") == root, F.lit(0)), F.lit(1), bins, dynamic)
    out = propagate(b)
    b.release()
    return out
