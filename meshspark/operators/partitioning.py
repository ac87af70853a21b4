"""Vertex partitions: equal bins, unequal splits of heavy bins, location of vertices, and message statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import pow2_floor
from ..graph import Graph, previous, running

c = F.col


@dataclass(frozen=True)
class Bins:
    width: int
    count: int

    @property
    def bits(self) -> int:
        return self.width.bit_length() - 1


def bin_params(vertices: int, threads: int = 20, kilobytes: int = 256) -> Bins:
    """Width: power of two up to the smaller of V / (4 T) and the cache's worth of 4-byte values."""
    width = pow2_floor(min(vertices // (4 * threads), kilobytes * 1024 // 4))
    return Bins(width, max(0, vertices - 1) // width + 1)


def bin_of(v: Column, bins: Bins) -> Column:
    return F.shiftright(v, bins.bits)


def bin_table(g: Graph, bins: Bins, dynamic: bool = False) -> DataFrame:
    """bin, edges, div, sub_map, sub_offset: how many parts each bin is cut into and the first part's number.

    A bin with more than twice the mean edges is cut into 2 ** round(log2(edges / threshold)) parts,
    never more than it has vertices.
    """
    spark = g.edges.sparkSession
    per = g.edges.groupBy(bin_of(c("src"), bins).alias("_b")).agg(F.count(F.lit(1)).alias("_e"))
    total = g.edges.agg(F.count(F.lit(1)).alias("_all"))
    t = spark.range(bins.count).withColumnRenamed("id", "bin").join(per, c("bin") == c("_b"), "left").join(F.broadcast(total))  # one row
    threshold = F.floor(c("_all") / bins.count) * 2
    t = t.withColumn("edges", F.coalesce("_e", F.lit(0)).cast("long")).withColumn("_thr", threshold)
    parts = F.pow(F.lit(2.0), F.round(F.log2(F.floor(c("edges") / c("_thr")).cast("double")), 0)).cast("long")
    heavy = F.lit(dynamic) & (c("_thr") > 0) & (c("edges") > c("_thr"))
    t = t.withColumn("div", F.when(heavy, F.least(parts, F.lit(bins.width))).otherwise(F.lit(1)).cast("long"))
    # one row a bin: as many as the bin count, which is a parameter of the run
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("bin", "edges", "div", F.coalesce(F.sum("div").over(before), F.lit(0)).cast("long").alias("sub_map"), (F.lit(bins.bits) - F.log2(c("div").cast("double")).cast("long")).cast("long").alias("sub_offset"))


def partitions(g: Graph, bins: Bins, dynamic: bool = False) -> DataFrame:
    """pid, bin, start_v, end_v (exclusive), total_edges of every partition."""
    v = g.vertices.agg(F.count(F.lit(1)).alias("_v"))
    t = bin_table(g, bins, dynamic).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), c("div") - 1))).join(F.broadcast(v))
    size = F.lit(bins.width) / c("div")
    edge = lambda j: F.least(c("_v"), (c("bin") * bins.width + j * size).cast("long"))
    t = t.select((c("sub_map") + c("_j")).alias("pid"), "bin", edge(c("_j")).alias("start_v"), edge(c("_j") + 1).alias("end_v"))
    per = locate(g.out_degrees(), g, bins, dynamic).groupBy(c("pid").alias("_p")).agg(F.sum("out_degree").alias("_e"))
    return t.join(per, c("pid") == c("_p"), "left").select("pid", "bin", "start_v", "end_v", F.coalesce("_e", F.lit(0)).cast("long").alias("total_edges"))


def locate(df: DataFrame, g: Graph, bins: Bins, dynamic: bool = False, vertex: str = "id", table: DataFrame | None = None) -> DataFrame:
    """Add ``pid``, the partition of the vertex, by shifts and masks on its id; ``table`` is a bin table that was made before (a row a bin, broadcast)."""
    if not dynamic:
        return df.withColumn("pid", bin_of(c(vertex), bins))
    t = (bin_table(g, bins, True) if table is None else F.broadcast(table)).select(c("bin").alias("_bin"), "sub_map", "sub_offset")
    low = F.expr(f"shiftleft(1L, cast({bins.bits} - sub_offset as int)) - 1").bitwiseAND(F.expr(f"shiftright({vertex}, cast(sub_offset as int))"))
    return df.join(t, bin_of(c(vertex), bins) == c("_bin")).withColumn("pid", c("sub_map") + low).drop("_bin", "sub_map", "sub_offset")


def placed_edges(g: Graph, bins: Bins) -> DataFrame:
    return g.edges.select("src", "dst", bin_of(c("src"), bins).alias("psrc"), bin_of(c("dst"), bins).alias("pdst"))


def bin_matrix(g: Graph, bins: Bins) -> DataFrame:
    """psrc, pdst, edges: messages that each bin sends to each."""
    return placed_edges(g, bins).groupBy("psrc", "pdst").agg(F.count(F.lit(1)).alias("edges"))


def run_changes(g: Graph, bins: Bins) -> DataFrame:
    """src, dst, new_run: whether the edge's target bin differs from that of the edge before it in the sorted list."""
    e = previous(placed_edges(g, bins).select("src", "dst", "pdst"), "src", c("dst").asc(), "pdst", "_bin")
    return e.select("src", "dst", (F.coalesce("_bin", F.lit(-1)) != c("pdst")).alias("new_run"))


def png_runs(g: Graph, bins: Bins) -> DataFrame:
    """psrc, pdst, runs: distinct senders per pair of bins, one message each in compressed form."""
    return placed_edges(g, bins).select("psrc", "pdst", "src").distinct().groupBy("psrc", "pdst").agg(F.count(F.lit(1)).alias("runs"))


def png_compression(g: Graph, bins: Bins) -> DataFrame:
    """One row: edges, runs and their ratio."""
    runs = png_runs(g, bins).agg(F.sum("runs").alias("runs"))
    return g.edges.agg(F.count(F.lit(1)).alias("edges")).join(F.broadcast(runs)).select("edges", F.coalesce("runs", F.lit(0)).alias("runs"), (c("runs") / c("edges")).alias("ratio"))


def intra_edges(g: Graph, bins: Bins) -> DataFrame:
    return placed_edges(g, bins).where("psrc = pdst").select("src", "dst")


def png_offsets(g: Graph, bins: Bins) -> DataFrame:
    """psrc, pdst, runs, offset: where each target bin's senders start in the compressed list of a bin."""
    before = Window.partitionBy("psrc").orderBy("pdst").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    return png_runs(g, bins).withColumn("offset", F.coalesce(F.sum("runs").over(before), F.lit(0)).cast("long"))


def ipg_offsets(g: Graph, bins: Bins) -> DataFrame:
    """id, pid, edges, offset: where each vertex's edges within its own bin start in the bin's list of them."""
    own = intra_edges(g, bins).groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    rows = g.vertices.join(own, c("id") == c("src"), "left").select("id", bin_of(c("id"), bins).alias("pid"), F.coalesce("_n", F.lit(0)).cast("long").alias("edges"))
    return running(rows, ["pid"], [c("id").asc()], c("edges"), "ipg").select("id", "pid", "edges", c("_before").alias("offset"))


def bin_costs(g: Graph, bins: Bins) -> DataFrame:
    """pid, png_edges, total_edges of every bin: what doesn't change between supersteps."""
    per = g.out_degrees().groupBy(bin_of(c("id"), bins).alias("_b")).agg(F.sum("out_degree").alias("_t"))
    png = png_runs(g, bins).groupBy(c("psrc").alias("_b3")).agg(F.sum("runs").alias("_png"))
    t = g.edges.sparkSession.range(bins.count).withColumnRenamed("id", "pid").join(per, c("pid") == c("_b"), "left").join(png, c("pid") == c("_b3"), "left")
    return t.select("pid", *[F.coalesce(a, F.lit(0)).cast("long").alias(b) for a, b in (("_png", "png_edges"), ("_t", "total_edges"))])


def dense_bins(costs: DataFrame, active: DataFrame, bins: Bins) -> DataFrame:
    """pid, active_edges, png_edges, total_edges, _b, is_dense per bin, given the edges of active vertices (_b, _on); _b is null where none is active."""
    t = costs.join(active, c("pid") == c("_b"), "left").select("pid", F.coalesce("_on", F.lit(0)).cast("long").alias("active_edges"), "png_edges", "total_edges", "_b")
    # Cost of an edge sent singly; costs of a compressed message, an edge read and a bin.
    return t.withColumn("is_dense", 28.0 * c("active_edges") > 10.5 * c("png_edges") + 2.67 * c("total_edges") + 4.0 * bins.count)


def density(g: Graph, bins: Bins, active: DataFrame | None = None) -> DataFrame:
    """pid, active_edges, png_edges, total_edges, is_dense per bin: whether compressed sending to all is cheaper."""
    act = g.out_degrees()
    if active is not None:
        act = act.join(active.select(c("id").alias("_a")), c("id") == c("_a"), "left_semi")
    return dense_bins(bin_costs(g, bins), act.groupBy(bin_of(c("id"), bins).alias("_b")).agg(F.sum("out_degree").alias("_on")), bins).drop("_b")
