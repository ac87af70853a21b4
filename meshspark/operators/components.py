"""Weakly connected components by contraction in rounds whose number doesn't follow the graph's shape.

Each round moves every vertex to the neighbour of least pseudo-random priority, itself included; links
become links between the places moved to, and those inside one place vanish.  A vertex is left only if it or a neighbour chose
it, so whatever the order of ids, a constant share of the vertices that still have links is expected to go in a round with fresh priorities (about four in
ten along a chain): rounds grow with the logarithm of the vertices, not with diameters.  Priorities stay for ``SAME`` rounds: in the
second all of a star moves to the vertex that its centre moved to in the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, release


#: Rounds with the same priorities.
SAME = 3


def contracted(links: DataFrame, name: str = "components") -> tuple[DataFrame, int]:
    """((id, component), rounds) for every end of ``links`` (a, b): component is the smallest id reachable.

    One aggregation and two joins a round, whose tables are deleted after the next, and the number of links never grows.  Links
    with a null end and links of a vertex with itself count for nothing; an empty table gives no rows.
    """
    left = cut(links.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    labels, rounds = None, 0
    while labels is None or not left.isEmpty():
        old = [left, labels]
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        of = lambda v: F.xxhash64(F.lit(rounds // SAME), F.col(v))
        best = both.groupBy("a").agg(F.min(of("b")).alias("_h"), F.min_by("b", of("b")).alias("_b"))
        moves = cut(best.select(F.col("a").alias("_v"), F.when(F.col("_h") < of("a"), F.col("_b")).otherwise(F.col("a")).alias("_to")), f"{name}-moves")
        if labels is None:
            labels = moves.select(F.col("_v").alias("id"), F.col("_to").alias("_at"))
        else:
            labels = labels.join(moves, F.col("_at") == F.col("_v"), "left").select("id", F.coalesce("_to", "_at").alias("_at"))
        first = moves.select(F.col("_v").alias("_va"), F.col("_to").alias("_ta"))
        second = moves.select(F.col("_v").alias("_vb"), F.col("_to").alias("_tb"))
        moved = left.join(first, F.col("a") == F.col("_va")).join(second, F.col("b") == F.col("_vb"))
        left = cut(moved.where("_ta <> _tb").select(F.least("_ta", "_tb").alias("a"), F.greatest("_ta", "_tb").alias("b")).distinct(), f"{name}-links")
        labels = cut(labels, f"{name}-labels")
        release(moves, *old)
        rounds += 1
    # a place is some vertex of its component: the smallest takes its name
    names = labels.groupBy(F.col("_at").alias("_p")).agg(F.min("id").alias("component"))
    out = cut(labels.join(names, F.col("_at") == F.col("_p")).select("id", "component"), f"{name}-ids")
    release(left, labels)
    return out, rounds
