"""Edges placed by partitions of vertices, so that supersteps move senders to edges and never edges.

``by_source``: a task for each partition of sources, unequal ones if asked for: bins with many edges are cut into narrower partitions, and a
partition that is still heavy (a hub can't be cut by vertices) into slices of its edges, to each of which its senders go.

``by_target``: a task for each partition of targets.  A sender goes once to each partition in which it has a target, along
its *route*, and is expanded to its edges there: what is shuffled is one row a (sender, partition), not one an edge.

Partitions are tasks literally (``repartitionById``), kept on the executors' disks and memory; a lost one is made again
from the files in the shared folder.  A superstep's joins find both sides placed alike: that takes
``spark.sql.requireAllClusterKeysForCoPartition=false``, which placing sets for the session (with true, results are the same, but edges move).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import bucketed, cut, release
from .partitioning import Bins, bin_of, bin_table, locate, partitions

#: A partition with more than so many times the mean edges is sliced.
SLICE = 2
c = F.col


def _kept(df: DataFrame, parts: int, by: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    kept = df.repartitionById(parts, c(by)).persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()  # how a kept table lies is known to later plans once it has been made
    return kept


def _sent(joined: DataFrame, message: Column, targets: DataFrame | None) -> DataFrame:
    if targets is not None:
        joined = joined.join(targets, c("dst") == c("_to_id"))
    return joined.select(c("dst").alias("_dst"), message.alias("msg"))


@dataclass(frozen=True)
class BySource:
    """``edges`` (src, dst[, w], _part), a task a part; ``parts``: pid, its first part and slices; ``bins`` and ``table`` locate a vertex."""

    edges: DataFrame
    parts: DataFrame
    table: DataFrame
    graph: Graph
    bins: Bins
    dynamic: bool
    tasks: int
    file: DataFrame

    def deliver(self, senders: DataFrame, message: Column, targets: DataFrame | None = None) -> DataFrame:
        at = locate(senders, self.graph, self.bins, self.dynamic, table=self.table)
        at = at.join(F.broadcast(self.parts), c("pid") == c("_q"))  # a row a partition: parameters of the run bound them
        at = at.withColumn("_at", F.explode(F.sequence(c("_first"), c("_first") + c("_slices") - 1))).drop("pid", "_q", "_first", "_slices")
        at = at.repartitionById(self.tasks, c("_at"))
        return _sent(at.join(self.edges, (c("_at") == c("_part")) & (c("id") == c("src"))), message, targets)

    def loads(self) -> DataFrame:
        """part, pid, edges of each task that has any."""
        held = self.edges.groupBy(F.spark_partition_id().cast("long").alias("part")).agg(F.count(F.lit(1)).alias("edges"))
        on = (c("part") >= c("_first")) & (c("part") < c("_first") + c("_slices"))
        return held.join(F.broadcast(self.parts), on).select("part", c("_q").alias("pid"), "edges")

    def release(self) -> None:
        self.edges.unpersist()
        release(self.file, self.parts, self.table)


@dataclass(frozen=True)
class ByTarget:
    """``edges`` (src, dst[, w], _part), a task a partition of targets; ``routes``: each sender's partitions, bucketed by sender."""

    edges: DataFrame
    routes: DataFrame
    tasks: int
    file: DataFrame

    def sent(self, senders: DataFrame) -> DataFrame:
        """What a superstep ships: the senders, once for each partition in which they have a target."""
        return senders.join(self.routes, c("id") == c("_s")).drop("_s")

    def deliver(self, senders: DataFrame, message: Column, targets: DataFrame | None = None) -> DataFrame:
        at = self.sent(senders).repartitionById(self.tasks, c("_at"))
        return _sent(at.join(self.edges, (c("_at") == c("_part")) & (c("id") == c("src"))), message, targets)

    def release(self) -> None:
        self.edges.unpersist()
        table = getattr(self.routes, "table", None)
        release(self.routes, self.file)
        if table is not None:
            self.edges.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def by_source(g: Graph, bins: Bins, dynamic: bool = True) -> Graph:
    """The graph with its edges placed by their sources' partitions."""
    table = cut(bin_table(g, bins, dynamic), "layout-bins")
    p = cut(partitions(g, bins, dynamic), "layout-partitions")
    total = p.agg(F.sum("total_edges").alias("_all"), F.count(F.lit(1)).alias("_np"))
    # a row a partition
    sliced = p.join(F.broadcast(total)).select("pid", F.greatest(F.lit(1), F.ceil(c("total_edges") / (SLICE * F.ceil(c("_all") / c("_np"))))).cast("int").alias("_slices"))
    before = "sum(_slices) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    parts = cut(sliced.selectExpr("pid AS _q", f"CAST(coalesce({before}, 0) AS INT) AS _first", "_slices"), "layout-parts")
    tasks = parts.agg(F.sum("_slices")).first()[0] or 1
    at = locate(g.edges, g, bins, dynamic, vertex="src", table=table).join(F.broadcast(parts), c("pid") == c("_q"))
    slice_ = F.pmod(F.xxhash64("src", "dst"), c("_slices").cast("long")).cast("int")
    file = cut(at.withColumn("_part", c("_first") + slice_).drop("pid", "_q", "_first", "_slices"), "layout-edges")
    release(p)
    return Graph(g.vertices, g.edges, BySource(_kept(file, int(tasks), "_part"), parts, table, g, bins, dynamic, int(tasks), file))


def by_target(g: Graph, bins: Bins) -> Graph:
    """The graph with its edges placed by their targets' partitions, and the senders' routes to them."""
    file = cut(g.edges.withColumn("_part", bin_of(c("dst"), bins).cast("int")), "layout-edges")
    spark = g.edges.sparkSession
    routes = file.select(c("src").alias("_s"), c("_part").alias("_at")).distinct()
    routes = bucketed(routes, "_s", int(spark.conf.get("spark.sql.shuffle.partitions")), "layout-routes")
    return Graph(g.vertices, g.edges, ByTarget(_kept(file, bins.count, "_part"), routes, bins.count, file))


def balance(g: Graph) -> DataFrame:
    """tasks, most, mean: edges a task of a graph placed by source."""
    return g.placed.loads().agg(F.count(F.lit(1)).alias("tasks"), F.max("edges").alias("most"), F.avg("edges").alias("mean"))
