"""Directed graphs as two DataFrames: ``vertices(id)`` and ``edges(src, dst[, w])``, all LONG."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import bucketed, cut, release

#: Edges from which ``Graph.saved`` places them by source.
PLACE_EDGES = 500_000
#: A source is heavy if it has more than a quarter of a bucket's fair share; so there are at most 4 heavy ones a bucket.
HEAVY = 4
#: Edges a bucket: at least so many where there are buckets for all cores, and never many more than the second.
BUCKET_EDGES, MOST_EDGES = 500_000, 4_000_000


@dataclass(frozen=True)
class Placed:
    """Edges bucketed by source, those of heavy sources (None where there are none), and the heavy sources' ids; how many buckets there are."""

    light: DataFrame
    heavy: DataFrame | None
    ids: DataFrame
    buckets: int


@dataclass(frozen=True)
class Graph:
    """Edges count with multiplicity; self-loops and vertices without edges are allowed."""

    vertices: DataFrame
    edges: DataFrame
    placed: Placed | None = None  # or a layout of ``operators.layouts``

    @staticmethod
    def load(spark: SparkSession, path: str, kind: str = "mix", wide: bool = False) -> Graph:
        """The graph of a binary file (see ``sources.csr``): its vertices and its out-edges."""
        from .sources import csr

        csr.register(spark)
        return Graph(spark.range(csr.vertex_count(path, wide)), spark.read.format("csr").option("format", kind).option("wide", wide).load(path))

    @property
    def weighted(self) -> bool:
        return "w" in self.edges.columns

    def counts(self) -> tuple[int, int]:
        return self.vertices.count(), self.edges.count()

    def saved(self) -> Graph:
        """The same graph read from the shared folder, for many supersteps over it; large ones placed by source."""
        g = Graph(cut(self.vertices, "vertices"), cut(self.edges, "edges"))
        e = g.edges.count()
        return g.placed_by_source(e) if e >= PLACE_EDGES else g

    def release(self) -> None:
        """Delete the files that ``saved`` wrote; the graph can't be used afterwards."""
        spark = self.edges.sparkSession
        if hasattr(self.placed, "deliver"):
            self.placed.release()
        elif self.placed is not None:
            table = getattr(self.placed.light, "table", None)
            release(self.placed.light, self.placed.heavy, self.placed.ids)
            if table is not None:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
        release(self.vertices, self.edges)

    def placed_by_source(self, edges: int | None = None, buckets: int | None = None) -> Graph:
        """The same graph with its edges bucketed by source, so that supersteps join them without a shuffle.

        Sources whose edges would swell one bucket are kept apart: their edges lie spread in plain
        files, and as there are at most HEAVY * buckets such sources, their states are broadcast.
        """
        if isinstance(self.placed, Placed) and buckets in (None, self.placed.buckets):
            return self
        spark = self.edges.sparkSession
        total = self.edges.count() if edges is None else edges
        n = buckets or bucket_count(spark, total)
        many = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * (HEAVY * n) > total)
        ids = cut(many.select(F.col("src").alias("_heavy")), "heavy-ids")
        on = F.col("src") == F.col("_heavy")
        some = not ids.isEmpty()
        light = bucketed(self.edges.join(F.broadcast(ids), on, "left_anti") if some else self.edges, "src", n, "edges-by-source")
        heavy = cut(self.edges.join(F.broadcast(ids), on, "left_semi"), "heavy-edges") if some else None
        return Graph(self.vertices, self.edges, Placed(light, heavy, ids, n))

    def sending(self) -> DataFrame | Placed:
        """Edges for supersteps: as they were placed, or plain."""
        return self.edges if self.placed is None else self.placed

    def out_degrees(self) -> DataFrame:
        return _degree(self, "src", "out_degree")

    def in_degrees(self) -> DataFrame:
        return _degree(self, "dst", "in_degree")

    def degrees(self) -> DataFrame:
        """id, out_degree, in_degree for every vertex, 0 where it has no edge."""
        sides = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.edges.select("dst", F.lit(0), F.lit(1)))
        both = sides.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        got = self.vertices.join(both, "id", "left")
        return got.select("id", F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"))

    def transpose(self) -> Graph:
        """Every edge reversed; weights aren't carried."""
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def symmetrize(self) -> Graph:
        """Both directions of every edge, each once; the smaller weight where there are several."""
        w = [F.col("w")] if self.weighted else []
        both = self.edges.select("src", "dst", *w).union(self.edges.select(F.col("dst"), F.col("src"), *w))
        return Graph(self.vertices, both.groupBy("src", "dst").agg(F.min("w").alias("w")) if w else both.distinct())

    def hub_concentration(self) -> DataFrame:
        """One row: shares of vertices, and of edges they send, with out-degree over the integer average."""
        d = self.out_degrees()
        total = d.agg(F.count(F.lit(1)).alias("v"), F.sum("out_degree").alias("e"))
        hub = F.col("out_degree") > F.floor(F.col("e") / F.col("v"))
        s = d.join(F.broadcast(total)).agg(  # one row
            F.sum(hub.cast("long")).alias("hubs"), F.sum(F.when(hub, F.col("out_degree")).otherwise(0)).alias("sent"), F.first("v").alias("v"), F.first("e").alias("e")
        )
        return s.select((F.col("hubs") / F.col("v")).alias("vertex_share"), F.when(F.col("e") > 0, F.col("sent") / F.col("e")).otherwise(F.lit(0.0)).alias("edge_share"))

    def csr_offsets(self) -> DataFrame:
        """id, out_degree, offset: exclusive running sum of out-degrees in id order."""
        return prefix_sum(self.out_degrees(), [F.col("id").asc()], "out_degree", "offset")

    def csr_adjacency(self) -> DataFrame:
        """id and its targets in ascending order, empty for sinks."""
        lists = self.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("adj"))
        return self.vertices.join(lists, F.col("id") == F.col("src"), "left").select("id", F.coalesce("adj", F.array().cast("array<bigint>")).alias("adj"))

    def adjacency_position(self) -> DataFrame:
        """src, dst, pos: place of the edge among the in-edges of dst, by source; a hub's edges spread over many tasks."""
        return running(self.edges.select("src", "dst"), ["dst"], [F.col("src").asc()], F.lit(0), "positions").select("src", "dst", F.col("_rank").alias("pos"))


def bucket_count(spark: SparkSession, edges: int) -> int:
    """Buckets for so many edges: few for a small graph, whose supersteps write a file a bucket, and more than shuffle partitions for one whose buckets would outgrow a task."""
    cores, parts = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts, max(cores, edges // BUCKET_EDGES)), edges // MOST_EDGES)


def csr_decode(adjacency: DataFrame) -> DataFrame:
    """(src, dst) from (id, adj)."""
    return adjacency.select(F.col("id").alias("src"), F.explode("adj").alias("dst"))


def _degree(g: Graph, side: str, name: str) -> DataFrame:
    count = lambda e: e.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
    if side == "src" and isinstance(g.placed, Placed):  # counted where they lie
        n = count(g.placed.light) if g.placed.heavy is None else count(g.placed.light).union(count(g.placed.heavy))
    else:
        n = count(g.edges)
    return g.vertices.join(n, F.col("id") == F.col(side), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias(name))


def running(df: DataFrame, keys: list[str], order: list[Column], total: Column, name: str) -> DataFrame:
    """Add ``_rank`` (0-based) and ``_before`` (sum of ``total`` over earlier rows) per ``keys`` in ``order``.

    A plain window would gather one key in one task.  Here rows are first range-partitioned by
    keys *and* order, so that a hot key spreads over many partitions; ranks and sums run inside
    each partition and the per-partition totals (at most one row per key and partition) shift them.
    Without keys all rows are one sequence.
    """
    names = df.columns
    by = [F.col(k).asc_nulls_last() for k in keys] + order
    placed = cut(df.withColumn("_total", total.cast("long")).repartitionByRange(*by).withColumn("_pid", F.spark_partition_id()), name)
    inner = Window.partitionBy("_pid", *keys).orderBy(*order)
    rows = placed.withColumns({
        "_rank": F.row_number().over(inner).cast("long") - 1,
        "_before": F.sum("_total").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total"),
    })
    parts = placed.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_total").alias("_t"))
    outer = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(
        F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_dn"), F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_dt"),
    )
    on = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(shift, on).select(*names, (F.col("_rank") + F.col("_dn")).alias("_rank"), (F.col("_before") + F.col("_dt")).alias("_before"))


def previous(df: DataFrame, key: str, order: Column, value: str, name: str) -> DataFrame:
    """Add ``name``: the ``value`` of the row before within ``key`` in ``order``, null at its first row.

    Like ``running`` it spreads a hot key; a partition's first row looks to the last rows of the partitions before it.
    """
    kept = df.columns
    placed = cut(df.repartitionByRange(F.col(key).asc(), order).withColumn("_pid", F.spark_partition_id()), "previous")
    inner = Window.partitionBy("_pid", key).orderBy(order)
    rows = placed.withColumns({"_lag": F.lag(value).over(inner), "_first": F.row_number().over(inner) == 1})
    # a row a partition: its last key and that key's last value there
    ends = rows.withColumn("_next", F.lead(F.lit(1)).over(inner)).where("_next is null").groupBy("_pid").agg(F.max(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).alias("_end"))
    before = ends.select(F.col("_pid").alias("_p"), F.lag("_end").over(Window.orderBy("_pid")).alias("_prior"))
    got = rows.join(F.broadcast(before), F.col("_pid") == F.col("_p"))
    carried = F.when(F.col("_first") & (F.col("_prior")["k"] == F.col(key)), F.col("_prior")["v"]).otherwise(F.col("_lag"))
    return got.select(*kept, carried.alias(name))


def prefix_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add the exclusive running sum of ``value`` over all rows in ``order`` without gathering them in one task."""
    return running(df, [], order, F.col(value), "prefix").select(*df.columns, F.col("_before").alias(name))
