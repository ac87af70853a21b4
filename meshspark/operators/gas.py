"""Gather-apply-scatter supersteps whose hooks are Column expressions.

One superstep, in this order: active vertices (or all, ``send_all``) send ``message`` along their
out-edges; active vertices apply ``on_scatter`` and stay if ``keep``; messages are folded per
destination by ``folds``; receivers apply ``gather`` and join the frontier if ``activate`` held before
it; every vertex of the frontier applies ``apply`` and is active afterwards if ``stay``.  A dense
program (``dense=True``) has no frontier: all vertices send and all apply.

Between the extremes of sending from active vertices and from all (``send_all``) stands the choice by density: with
``run(..., bins=...)`` a bin of vertices all of whose messages cost less in compressed form than the active ones singly
sends from all its vertices in that superstep.

A bin that sends whole sends from vertices that weren't active too, whose values must not change a receiver that has had them, or never
should: ``valid`` says which vertices may send at all (a search's unvisited ones may not).  With it, and with folds for which a message
sent again changes nothing (minima), any program gives the same result with ``bins`` as without; delta PageRank is
defined by what is sent, so there ``bins`` are part of the definition.

The state has ``id``, ``od`` (out-degree), the program's columns and ``active``.  ``message`` may use
the sender's columns and the edge weight ``w``, and with ``sees_target`` the receiver's columns, named ``to_<column>``, which are then joined
to the edges (a shuffle of the edges each superstep, so only where asked for); ``gather``, ``activate`` and ``apply`` may use the folds,
which are null without a message.  Updates of one hook see the values before it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..graph import Graph, Placed, prefix_sum
from ..storage import bucketed, cut, release
from .partitioning import Bins, bin_costs, bin_of, dense_bins

Updates = Mapping[str, Column]


@dataclass(frozen=True)
class VertexProgram:
    init: Updates
    message: Column
    folds: Updates
    active: Column = field(default_factory=lambda: F.lit(True))
    on_scatter: Updates = field(default_factory=dict)
    keep: Column = field(default_factory=lambda: F.lit(False))
    gather: Updates | Callable[[int], Updates] = field(default_factory=dict)
    activate: Column = field(default_factory=lambda: F.lit(True))
    apply: Updates = field(default_factory=dict)
    stay: Column = field(default_factory=lambda: F.lit(True))
    dense: bool = False
    send_all: bool = False
    valid: Column = field(default_factory=lambda: F.lit(True))
    sees_target: bool = False


_laps: list[list[tuple[int, float]]] = []


@contextmanager
def timing() -> Iterator[list[tuple[int, float]]]:
    """Collects (last superstep, seconds) of the supersteps of all runs inside the ``with``."""
    laps: list[tuple[int, float]] = []
    _laps.append(laps)
    try:
        yield laps
    finally:
        _laps.remove(laps)


def record(k: int, seconds: float) -> tuple[int, float]:
    """Tell those who time that supersteps up to ``k`` took so long."""
    for laps in _laps:
        laps.append((k, seconds))
    return k, seconds


#: Supersteps that one write covers while a frontier is watched; each doubles the plan, so they are few.
FUSED = 2
#: Tables of changes up to which they are laid over the state one by one.
CHANGES = 3
#: Frontiers of at most this many vertices of a placed graph prune the scan of its edges.
FEW = 1000


@dataclass(frozen=True)
class Result:
    """Final state, supersteps run, (iteration, active_vertices, active_edges) before each superstep, with ``bins``
    (iteration, active partitions, dense partitions), and the seconds of the supersteps alone, as (last superstep, seconds) of each write;
    ``run_by_changes`` tells rows written, as (superstep, rows)."""

    state: DataFrame
    supersteps: int
    trace: list[tuple[int, int, int]]
    partitions: list[tuple[int, int, int]] = field(default_factory=list)
    timed: list[tuple[int, float]] = field(default_factory=list)
    written: list[tuple[int, int]] = field(default_factory=list)

    @property
    def seconds(self) -> float:
        """Of all supersteps, without what came before the first."""
        return sum(s for _, s in self.timed)


def load_frontier(state: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """The state with exactly the vertices ``ids`` (one column, or a list) active; ids that repeat or don't exist change nothing."""
    if isinstance(ids, list):
        ids = state.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    some = ids.select(F.col(ids.columns[0]).alias("_on")).distinct()
    names = state.columns if "active" in state.columns else [*state.columns, "active"]
    return state.drop("active").join(some, F.col("id") == F.col("_on"), "left").withColumn("active", F.col("_on").isNotNull()).select(*names)


def get_frontier(state: DataFrame) -> DataFrame:
    """id of each active vertex."""
    return state.where("active").select("id")


def reset_frontier(state: DataFrame) -> DataFrame:
    """The state with no active vertex."""
    return state.withColumn("active", F.lit(False))


def active_partitions(state: DataFrame, bins: Bins) -> DataFrame:
    """pid of each partition with an active vertex."""
    return get_frontier(state).select(bin_of(F.col("id"), bins).alias("pid")).distinct()


def frontier_offsets(state: DataFrame, bins: Bins) -> DataFrame:
    """pid, size, offset: where each partition's part of the frontier starts when the parts are laid end to end."""
    parts = get_frontier(state).groupBy(bin_of(F.col("id"), bins).alias("pid")).agg(F.count(F.lit(1)).alias("size"))
    return prefix_sum(parts, [F.col("pid").asc()], "size", "offset")


def start(g: Graph, p: VertexProgram) -> DataFrame:
    """The state before the first superstep."""
    d = g.out_degrees().withColumnRenamed("out_degree", "od")
    return d.withColumns(dict(p.init)).withColumn("active", F.coalesce(p.active, F.lit(False)))


def messages(senders: DataFrame, edges: DataFrame | Placed, message: Column, targets: DataFrame | None = None) -> DataFrame:
    """(_dst, msg) along every out-edge of the senders; ``targets`` (_to_id, to_*) are joined to the edges' ends if given."""
    if hasattr(edges, "deliver"):
        return edges.deliver(senders, message, targets)
    if not isinstance(edges, Placed):
        sent = senders.join(edges, F.col("id") == F.col("src"))
        if targets is not None:
            sent = sent.join(targets, F.col("dst") == F.col("_to_id"))
        return sent.select(F.col("dst").alias("_dst"), message.alias("msg"))
    # a bucket's senders are looked up by its edges, which then needn't be sorted; nothing is broadcast
    sent = messages(senders.hint("shuffle_hash"), edges.light, message, targets)
    if edges.heavy is None:
        return sent
    few = senders.join(F.broadcast(edges.ids), F.col("id") == F.col("_heavy"), "left_semi")  # bounded: see placed_by_source
    return sent.union(messages(F.broadcast(few), edges.heavy, message, targets))


def _updated(updates: Updates, when: Column | None, columns: list[str]) -> list[Column]:
    """One projection: updated columns by their names, the others as they are."""
    return [(updates[c] if when is None else F.when(when, updates[c]).otherwise(F.col(c))).alias(c) if c in updates else F.col(c) for c in columns]


def superstep(state: DataFrame, edges: DataFrame | Placed, p: VertexProgram, k: int, dense: DataFrame | None = None, bins: Bins | None = None) -> DataFrame:
    """The state after superstep ``k`` (from 1), lazily.  Vertices of the bins ``dense`` (_pid) send whether active or not."""
    columns = state.columns
    own = [c for c in columns if c not in ("id", "od", "active")]
    senders = state if p.dense or p.send_all else state.where("active")
    if dense is not None:
        # a row a bin, whose number is a parameter of the run
        senders = state.join(F.broadcast(dense), bin_of(F.col("id"), bins) == F.col("_pid"), "left").where(F.col("active") | F.col("_pid").isNotNull()).drop("_pid")
    targets = state.select(F.col("id").alias("_to_id"), *[F.col(c).alias(f"to_{c}") for c in ("od", *own)]) if p.sees_target else None
    folded = _folded(messages(senders.where(p.valid), edges, p.message, targets), p)
    return applied(state, folded.hint("shuffle_hash") if isinstance(edges, Placed) else folded, p, k)


def _folded(sent: DataFrame, p: VertexProgram) -> DataFrame:
    return sent.groupBy("_dst").agg(*[f.alias(n) for n, f in p.folds.items()])


def applied(state: DataFrame, folded: DataFrame, p: VertexProgram, k: int) -> DataFrame:
    """What the hooks make of ``state`` once its vertices' messages are folded.  Vertices that neither are active nor receive may be left out."""
    own = [c for c in state.columns if c not in ("id", "od", "active")]
    if not p.dense:
        # the keep hook sees what on_scatter made of the state
        if p.on_scatter:
            state = state.select("id", "od", *_updated(p.on_scatter, F.col("active"), own), "active")
        state = state.withColumn("_keep", F.col("active") & p.keep)
    s = state.join(folded, F.col("id") == F.col("_dst"), "left")
    got = F.col("_dst").isNotNull()
    frontier = F.lit(True) if p.dense else F.col("_keep") | (got & F.coalesce(p.activate, F.lit(False)))
    gather = p.gather(k) if callable(p.gather) else p.gather
    s = s.select("id", "od", *_updated(gather, got, own), *p.folds, frontier.alias("_front"))
    s = s.select("id", "od", *_updated(p.apply, None if p.dense else F.col("_front"), own), "_front")
    return s.select("id", "od", *own, (F.col("_front") & F.coalesce(p.stay, F.lit(False))).alias("active"))


def run_by_changes(g: Graph, p: VertexProgram, iterations: int | None = None, frontier: DataFrame | list[int] | None = None) -> Result:
    """Like ``run`` for a program with a frontier, in work that follows it: a superstep writes the folded messages and the rows of vertices
    that were active or received any, no others.

    The first state lies bucketed by id.  A vertex's row is the one of the latest superstep that wrote it: tables of
    changes are laid over the state for the vertices a superstep touches, folded into one when they are more than
    ``CHANGES``, and the state is written anew when they hold more than a quarter of the vertices.
    """
    if p.dense or p.send_all:
        raise ValueError("all vertices change in every superstep of this program")
    spark = g.edges.sparkSession
    buckets, edges, k = int(spark.conf.get("spark.sql.shuffle.partitions")), g.sending(), 0
    first = start(g, p) if frontier is None else load_frontier(start(g, p), frontier)
    base = bucketed(first, "id", buckets, "state")
    total = base.count()
    trace: list[tuple[int, int, int]] = []
    timed: list[tuple[int, float]] = []
    wrote: list[tuple[int, int]] = []
    changes: list[tuple[DataFrame, int]] = []

    def counted(df: DataFrame) -> tuple[int, int]:
        r = df.where("active").agg(F.count(F.lit(1)), F.sum("od")).first()
        return r[0], int(r[1] or 0)

    def latest(rows: DataFrame, over: list[DataFrame], only: DataFrame | None = None) -> DataFrame:
        """``rows`` with those of ``over`` in the place of earlier ones, of the vertices ``only`` (_key) if given."""
        for d in over:
            ids = d.select(F.col("id").alias("_new"))
            rows = rows.join(ids, F.col("id") == F.col("_new"), "left_anti").unionByName(d)
        return rows if only is None else rows.join(only, F.col("id") == F.col("_key"), "left_semi")

    trace.append((0, *counted(base)))
    active = base.where("active")
    while trace[-1][1] and (iterations is None or k < iterations):
        began = time.perf_counter()
        k += 1
        using = _pruned(edges, active) if isinstance(edges, Placed) and trace[-1][1] <= FEW else edges
        targets = None
        if p.sees_target:
            whole = latest(base, [d for d, _ in changes])
            targets = whole.select(F.col("id").alias("_to_id"), *[F.col(c).alias(f"to_{c}") for c in whole.columns if c not in ("id", "active")])
        folded = cut(_folded(messages(active.where(p.valid), using, p.message, targets), p), "messages")
        touched = cut(folded.select(F.col("_dst").alias("_key")).union(active.select("id")).distinct(), "touched")
        held = [d for d, _ in changes]
        now = latest(base.join(touched, F.col("id") == F.col("_key"), "left_semi"), [d.join(touched, F.col("id") == F.col("_key"), "left_semi") for d in held])
        new = cut(applied(now, folded, p, k), "changes")
        rows = new.count()
        release(folded, touched)
        changes.append((new, rows))
        active = new.where("active")
        trace.append((k, *counted(new)))
        wrote.append((k, rows))
        if 4 * sum(n for _, n in changes) > total:
            over = bucketed(latest(base, [d for d, _ in changes]), "id", buckets, "state")
            for d in [base, *[d for d, _ in changes]]:
                dropped(d)
            base, changes, active = over, [], over.where("active")
        elif len(changes) > CHANGES:
            over = cut(latest(changes[0][0], [d for d, _ in changes[1:]]), "changes")
            # what is active is so in the newest rows alone
            for d, _ in changes:
                release(d)
            changes = [(over, over.count())]
            active = over.where("active")
        timed.append(record(k, time.perf_counter() - began))
    state = cut(latest(base, [d for d, _ in changes]))
    for d in [base, *[d for d, _ in changes]]:
        dropped(d)
    return Result(state, k, trace, [], timed, wrote)


def _pruned(edges: Placed, state: DataFrame) -> Placed:
    """Only what the edges of few active sources need: filters on the sorted column skip row groups."""
    ids = [r[0] for r in get_frontier(state).collect()]  # at most FEW
    some = F.col("src").isin(ids)
    return Placed(edges.light.where(some), None if edges.heavy is None else edges.heavy.where(some), edges.ids, edges.buckets)


def written(state: DataFrame, edges: DataFrame | Placed) -> DataFrame:
    """The state in files; beside placed edges it is bucketed like them, so that supersteps shuffle folded messages alone."""
    if not isinstance(edges, Placed):
        return cut(state)
    conf, name = state.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, str(edges.buckets))  # messages are shuffled to as many partitions as there are buckets
    try:
        return bucketed(state, "id", edges.buckets, "state")
    finally:
        conf.set(name, before)


def dropped(state: DataFrame) -> None:
    """Delete the files of a state, and its table if it is one."""
    table = getattr(state, "table", None)
    release(state)
    if table is not None:
        state.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def run(
    g: Graph, p: VertexProgram, iterations: int | None = None, cadence: int = 4, between: Callable[[DataFrame], DataFrame] | None = None,
    frontier: DataFrame | list[int] | None = None, bins: Bins | None = None,
) -> Result:
    """Run ``iterations`` supersteps, or until the frontier is empty (or both, whichever comes first).

    With a frontier to watch the state is written every few supersteps, and their counts come with the write (supersteps
    after the frontier is empty change nothing); large placed graphs write every superstep, and small frontiers
    prune their scans.  Fixed runs are written every ``cadence`` supersteps, which keeps plans short, and those of placed graphs every superstep.  Of the states that were written the
    last two stay.  ``between`` may change the state after each write (rescaling).  ``frontier`` replaces
    the program's first frontier; ``bins`` chooses dense bins by their density in each superstep.
    """
    watch = iterations is None or not p.dense
    edges = g.sending()
    state = start(g, p) if frontier is None else load_frontier(start(g, p), frontier)
    trace: list[tuple[int, int, int]] = []
    partitions: list[tuple[int, int, int]] = []
    timed: list[tuple[int, float]] = []
    states: list[DataFrame] = []
    costs = cut(bin_costs(g, bins), "bin-costs") if bins is not None else None
    k = 0

    def keep(df: DataFrame) -> DataFrame:
        out = written(df, edges)
        states.append(out)
        if len(states) > 2:
            dropped(states.pop(0))
        return out

    def counted(df: DataFrame, steps: list[int]) -> DataFrame:
        """Write the state; bit j of ``_seen`` tells whether a vertex was active after step j."""
        seen = Observation()
        on = {j: F.shiftright("_seen", j).bitwiseAND(F.lit(1)) for j in steps}
        sums = [e for j in steps for e in (F.sum(on[j]).cast("long").alias(f"v{j}"), F.sum(on[j] * F.col("od")).cast("long").alias(f"e{j}"))]
        out = keep(df.observe(seen, *sums).drop("_seen"))
        got = seen.get
        for j in steps:
            trace.append((k + j, int(got[f"v{j}"] or 0), int(got[f"e{j}"] or 0)))
            if not trace[-1][1]:
                break
        return out

    bit = lambda j: F.col("active").cast("long") * F.lit(1 << j)
    state = counted(state.withColumn("_seen", bit(0)), [0]) if watch else keep(state)
    began = time.perf_counter()

    def lap() -> None:
        nonlocal began
        now = time.perf_counter()
        timed.append(record(k, now - began))
        began = now

    while (not watch or trace[-1][1]) and (iterations is None or k < iterations):
        if not watch:
            k += 1
            state = superstep(state, edges, p, k)
            pause = k % cadence == 0 or k == iterations
            if pause or isinstance(edges, Placed):
                state = keep(state)
                if between is not None and pause:
                    state = between(state)
                lap()
            continue
        dense = None
        if bins is not None:
            act = state.where("active").groupBy(bin_of(F.col("id"), bins).alias("_b")).agg(F.sum("od").alias("_on"))
            flags = dense_bins(costs, act, bins)
            got = flags.agg(F.count("_b"), F.sum(F.col("is_dense").cast("long"))).first()
            partitions.append((k, got[0], int(got[1] or 0)))
            dense = flags.where("is_dense").select(F.col("pid").alias("_pid")) if got[1] else None
        single = bins is not None or g.placed is not None
        last = 1 if single else FUSED if iterations is None else min(FUSED, iterations - k)
        using = _pruned(edges, state) if isinstance(edges, Placed) and not p.send_all and dense is None and trace[-1][1] <= FEW else edges
        state = state.withColumn("_seen", F.lit(0).cast("long"))
        for j in range(1, last + 1):
            state = superstep(state, using, p, k + j, dense, bins)
            state = state.withColumn("_seen", F.col("_seen") + bit(j))
        state = counted(state, list(range(1, last + 1)))
        k = trace[-1][0]
        lap()
    if costs is not None:
        release(costs)
    return Result(state, k, trace, partitions, timed)
