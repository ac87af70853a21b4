"""Named queries over the test tables and the SQL that gives the same rows.

Graph algorithms run on ``g_part`` (one component), ``g_frag`` (many components, deep searches) and
``g_sc`` (few senders with many edges).  Their SQL is one recursive statement that keeps the whole
state of every superstep.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ordering
from .graph import Graph, csr_decode, prefix_sum
from .operators import algorithms as A
from .operators import blocks as K
from .operators import gas
from .operators import layouts as L
from .operators import partitioning as P
from .plans import datasets
from .sources import csr
from .storage import shared_dir

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
THREADS = 4


def _ctes(graph: str) -> str:
    v, e = datasets.SQL[graph]
    return f"v AS ({v}), e AS ({e}), dg AS (SELECT id, coalesce(n, 0)::BIGINT AS od FROM v LEFT JOIN (SELECT src, count(*) n FROM e GROUP BY src) ON id = src)"


def query(name: str, graph: str, sql: str, saved: bool = True):
    """Register ``fn(graph) -> DataFrame`` and the SQL over v, e, dg that gives its rows; ``saved=False`` for one pass over the graph."""

    def wrap(fn: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(datasets.load(spark, sf_dir, graph, saved))
        SQL[name] = sql if sql.startswith("WITH") else f"WITH {_ctes(graph)} {sql}"
        return fn

    return wrap


def steps(graph: str, columns: dict[str, tuple[str, str]], k: int | str, folds: str, out: str, senders: str = "true", edges: str = "e", more: str = "") -> str:
    """Recursive SQL: ``columns`` maps a state column to (initial value, next value); ``p`` is the old state, ``g`` the folds.

    ``k`` is the number of supersteps, or the condition under which a vertex moves: then steps go on while any does.
    """
    first = ", ".join(f"{a} AS {n}" for n, (a, _) in columns.items())
    then = ", ".join(b for _, b in columns.values())
    moved, go = ("true", f"nx.it <= {k}") if isinstance(k, int) else (f"coalesce({k}, false)", "nx.go")
    return f"""WITH RECURSIVE {_ctes(graph)}{more}, s(it, id, od, {", ".join(columns)}, moved) AS (
  SELECT 0, id, od, {first}, true FROM dg
  UNION ALL
  SELECT nx.it, p.id, p.od, {then}, {moved}
  FROM (SELECT max(it) + 1 AS it, bool_or(moved) AS go FROM s) nx CROSS JOIN s p
  LEFT JOIN (SELECT e.dst AS d, {folds} FROM s JOIN {edges} e ON e.src = s.id WHERE {senders} GROUP BY 1) g ON g.d = p.id
  WHERE {go})
SELECT {out} FROM s WHERE it = (SELECT max(it) FROM s)"""


def _round(col: str, digits: int = 6):
    return F.round(c(col), digits).alias(col)


# --- scans, degrees, transforms ---------------------------------------------------------------------------------------

query("edges_scan", "g_part", "SELECT src, dst FROM e", saved=False)(lambda g: g.edges.select("src", "dst"))
query("edges_weighted", "g_part", "SELECT src, dst, w FROM e", saved=False)(lambda g: g.edges.select("src", "dst", "w"))
query("out_degree", "g_sc", "SELECT id, od AS out_degree FROM dg", saved=False)(lambda g: g.out_degrees())
_IN = "SELECT id, coalesce(n, 0)::BIGINT AS in_degree FROM v LEFT JOIN (SELECT dst, count(*) n FROM e GROUP BY dst) ON id = dst"
query("in_degree", "g_sc", _IN, saved=False)(lambda g: g.in_degrees())
query("degrees", "g_frag", f"SELECT i.id, od AS out_degree, in_degree FROM ({_IN}) i JOIN dg ON dg.id = i.id", saved=False)(lambda g: g.degrees())
query("in_degree_gas", "g_part", _IN)(A.in_degree)
query("in_degree_topk", "g_part", f"SELECT in_degree FROM ({_IN}) ORDER BY in_degree DESC LIMIT 1000")(lambda g: ordering.top_values(A.in_degree(g), "in_degree"))
query("hub_concentration", "g_part", """SELECT round(count(*) FILTER (od > avg_od) / count(*), 6) AS vertex_share, round(sum(od) FILTER (od > avg_od) / sum(od), 6) AS edge_share
FROM dg, (SELECT floor(sum(od) / count(*)) AS avg_od FROM dg)""")(lambda g: g.hub_concentration().select(_round("vertex_share"), _round("edge_share")))
query("transpose", "g_frag", "SELECT dst AS src, src AS dst FROM e", saved=False)(lambda g: g.transpose().edges)
_SYM = "SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1, 2"
query("symmetrize", "g_frag", _SYM, saved=False)(lambda g: g.symmetrize().edges)
query("csr_offsets", "g_part", 'SELECT id, od AS out_degree, (coalesce(sum(od) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM dg', saved=False)(lambda g: g.csr_offsets())
query("csr_adjacency", "g_frag", "SELECT id, coalesce(adj, '') AS adj FROM v LEFT JOIN (SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS adj FROM e GROUP BY src) ON id = src", saved=False)(
    lambda g: g.csr_adjacency().select("id", F.array_join(c("adj").cast("array<string>"), ",").alias("adj"))
)
query("csr_decode", "g_frag", "SELECT src, dst FROM e", saved=False)(lambda g: csr_decode(g.csr_adjacency()))
query("adjacency_position", "g_frag", "SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS pos FROM e", saved=False)(lambda g: g.adjacency_position())



def _file(g: Graph) -> str:
    return f"{shared_dir(g.edges.sparkSession)}/meshspark/graph-{uuid.uuid4().hex}"


def _through_csr(g: Graph, kind: str, side: str = "out", wide: bool = False) -> DataFrame:
    """The graph's edges, written to a binary file and scanned again."""
    path, spark = _file(g), g.edges.sparkSession
    csr.write_csr(g.edges, path, g.vertices.agg(F.max("id")).first()[0] + 1, kind, wide)
    return spark.read.format("csr").option("format", kind).option("wide", wide).option("side", side).load(path)


def _through_folder(g: Graph, kind: str, side: str = "out") -> DataFrame:
    path, spark = _file(g), g.edges.sparkSession
    csr.write_csr_folder(g.edges, path, g.vertices.agg(F.max("id")).first()[0] + 1, kind)
    return spark.read.format("csr").option("format", kind).option("side", side).load(path)


query("csr_folder_roundtrip", "g_part", "SELECT src, dst, w FROM e", saved=False)(lambda g: _through_folder(g, "csr_weighted"))
query("csc_folder_roundtrip", "g_part", "SELECT src, dst FROM e", saved=False)(lambda g: _through_folder(g, "mix", "in"))
query("csr_pruned_scan", "g_part", "SELECT src, dst FROM e WHERE src IN (3, 17, 40)", saved=False)(lambda g: _through_csr(g, "mix").where("src IN (3, 17, 40)"))
query("csr_pruned_folder", "g_part", "SELECT src, dst FROM e WHERE dst BETWEEN 20 AND 60", saved=False)(lambda g: _through_folder(g, "mix", "in").where("dst BETWEEN 20 AND 60"))
query("csr_scan_roundtrip", "g_part", "SELECT src, dst FROM e", saved=False)(lambda g: _through_csr(g, "mix"))
query("csc_scan_roundtrip", "g_part", "SELECT src, dst FROM e", saved=False)(lambda g: _through_csr(g, "mix", "in"))
query("csr_weighted_roundtrip", "g_part", "SELECT src, dst, w FROM e", saved=False)(lambda g: _through_csr(g, "csr_weighted", wide=True))


def _loaded_from_file(g: Graph) -> Graph:
    path = _file(g)
    csr.write_csr(g.edges, path, g.vertices.agg(F.max("id")).first()[0] + 1, "mix")
    return Graph.load(g.edges.sparkSession, path)


query("graph_load", "g_part", "SELECT n.id, coalesce(od, 0)::BIGINT AS out_degree FROM (SELECT unnest(range(0, (SELECT max(id) + 1 FROM v)::BIGINT)) AS id) n LEFT JOIN dg ON dg.id = n.id", saved=False)(
    lambda g: _loaded_from_file(g).out_degrees()
)


def _printed(g: Graph) -> DataFrame:
    path = _file(g)
    csr.write_edge_list(g.edges, path)
    return g.edges.sparkSession.read.text(path)


query("edge_list_text", "g_frag", "SELECT src || ', ' || dst AS value FROM e", saved=False)(_printed)

# --- sorts ------------------------------------------------------------------------------------------------------------

_RANK = "SELECT od, id, row_number() OVER (ORDER BY od {0}, id) AS place FROM dg QUALIFY place <= 1000"


def _placed(df: DataFrame) -> DataFrame:
    """The first 1000 rows of a sorted table with their places: a top-k report, numbered where it is small."""
    from pyspark.sql import Window

    top = df.limit(ordering.TOP)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long")).select("od", "id", "place")


query("sort_desc_stable", "g_sc", _RANK.format("DESC"))(lambda g: _placed(ordering.sort_desc(g.out_degrees().withColumnRenamed("out_degree", "od"), "od", "id")))
query("sort_asc_stable", "g_sc", _RANK.format("ASC"))(lambda g: _placed(ordering.sort_asc(g.out_degrees().withColumnRenamed("out_degree", "od"), "od", "id")))
_PLACES = "SELECT od, id, row_number() OVER (ORDER BY od {0}, id) AS place FROM dg"


def _all_placed(g: Graph, order: list) -> DataFrame:
    """Every vertex with its place in a whole sort, which range partitions number."""
    ones = g.out_degrees().select(c("out_degree").alias("od"), "id", F.lit(1).alias("one"))
    return prefix_sum(ones, order, "one", "before").select("od", "id", (c("before") + 1).alias("place"))


query("sort_desc_whole", "g_sc", _PLACES.format("DESC"))(lambda g: _all_placed(g, [c("od").desc(), c("id").asc()]))
query("sort_asc_whole", "g_sc", _PLACES.format("ASC"))(lambda g: _all_placed(g, [c("od").asc(), c("id").asc()]))
query("midpoints", "g_frag", "SELECT src, dst, (src + dst) // 2 AS middle FROM e", saved=False)(lambda g: g.edges.select("src", "dst", ordering.midpoint(c("src"), c("dst")).alias("middle")))
query("topk_values", "g_sc", "SELECT od AS out_degree FROM dg ORDER BY od DESC LIMIT 1000")(lambda g: ordering.top_values(g.out_degrees(), "out_degree"))

# --- dense algorithms -------------------------------------------------------------------------------------------------

_PR = {"r": ("1.0::DOUBLE", "0.15 + 0.85 * coalesce(g.m, 0)")}


def _pr(graph: str, k: int) -> str:
    return steps(graph, _PR, k, "sum(s.r / s.od) AS m", "id, round(r, 6) AS rank")


for _name, _graph, _k in (("pagerank_5", "g_part", 5), ("pagerank_20", "g_part", 20), ("pagerank_sinks", "g_sc", 5)):
    query(_name, _graph, _pr(_graph, _k))(lambda g, k=_k: A.pagerank(g, k).select("id", _round("rank")))
query("pagerank_topk", "g_part", f"SELECT rank FROM ({_pr('g_part', 5)}) ORDER BY rank DESC LIMIT 1000".replace("SELECT rank FROM (WITH", "WITH x AS (WITH").replace(") ORDER BY", ") SELECT rank FROM x ORDER BY"))(
    lambda g: ordering.top_values(A.pagerank(g, 5).select("id", _round("rank")), "rank")
)
_EC = {"x": ("1.0::DOUBLE", "coalesce(g.m, 0)")}
query("ec_5_literal", "g_part", steps("g_part", _EC, 5, "sum(s.x) AS m", "id, round(x, 3) AS centrality"))(
    lambda g: A.eigenvector(g, 5).select("id", F.round(c("centrality") * g.vertices.count() / 1e-9, 3).alias("centrality"))
)
_EC_ALL = steps("g_part", _EC, 5, "sum(s.x) AS m", "id, x")
query("ec_5_normalized", "g_part", f"WITH t AS ({_EC_ALL}) SELECT id, round(x / (SELECT sqrt(sum(x * x)) FROM t), 6) AS centrality FROM t")(
    lambda g: A.eigenvector(g, 5, normalize=True).select("id", _round("centrality"))
)
query("ec_norm", "g_part", f"WITH t AS ({_EC_ALL}) SELECT round(sqrt(sum(x * x)), 3) AS norm FROM t")(
    lambda g: A.eigenvector(g, 5).agg(F.round(F.sqrt(F.sum(c("centrality") * c("centrality"))) * g.vertices.count() / 1e-9, 3).alias("norm"))
)


def _cf(step: float) -> str:
    new = f"p.x + {step}::DOUBLE * (-0.001 * p.x + coalesce(g.a, 0) - p.x * coalesce(g.b, 0))"
    return steps("g_part", {"x": ("0.5::DOUBLE", new)}, 5, "sum(s.x) AS a, sum(s.x * s.x) AS b", "id, round(x, 9) AS latent")


query("cf_5", "g_part", _cf(3.5e-7))(lambda g: A.collaborative_filtering(g, 5).select("id", _round("latent", 9)))
query("cf_5_by_edges", "g_part", _cf(0.01))(lambda g: A.collaborative_filtering_by_edges(g, 5, step=0.01).select("id", _round("latent", 9)))
query("largest_gap", "g_part", """SELECT d.id, coalesce(max(abs(a.od - d.od)), 0)::DOUBLE AS gap FROM dg d LEFT JOIN e ON e.dst = d.id LEFT JOIN dg a ON a.id = e.src GROUP BY d.id""")(
    lambda g: A.farthest_values(g, g.out_degrees().withColumnRenamed("out_degree", "x")).select("id", c("x").alias("gap"))
)
query("cf_5_bigstep", "g_part", _cf(0.01))(lambda g: A.collaborative_filtering(g, 5, step=0.01).select("id", _round("latent", 9)))


def _hits(which: str) -> str:
    """Unscaled iterations in halves (odd: authorities, even: hubs), scaled at the end."""
    both = ", ee AS (SELECT src, dst, 1 AS half FROM e UNION ALL SELECT dst, src, 0 FROM e)"
    columns = {
        "a": ("1.0::DOUBLE", "CASE WHEN nx.it % 2 = 1 THEN coalesce(g.ha, 0) ELSE p.a END"),
        "h": ("1.0::DOUBLE", "CASE WHEN nx.it % 2 = 0 THEN coalesce(g.ah, 0) ELSE p.h END"),
    }
    folds = "sum(CASE WHEN e.half = 1 THEN s.h END) AS ha, sum(CASE WHEN e.half = 0 THEN s.a END) AS ah"
    body = steps("g_part", columns, 10, folds, "id, a, h", edges="ee", more=both)
    col, name = ("a", "auth") if which == "auth" else ("h", "hub")
    return f"WITH t AS ({body}) SELECT id, round({col} / (SELECT sqrt(sum({col} * {col})) FROM t), 6) AS {name} FROM t"


query("hits_5_auth", "g_part", _hits("auth"))(lambda g: A.hits(g, 5).select("id", _round("auth")))
query("hits_5_hub", "g_part", _hits("hub"))(lambda g: A.hits(g, 5).select("id", _round("hub")))


def _hits_literal(k: int) -> str:
    """Halves: odd ones add hubs to authorities and clear hubs, even ones the other way round."""
    columns = {
        "a": ("1e-8::DOUBLE", "CASE WHEN nx.it % 2 = 1 THEN p.a + coalesce(g.h, 0) ELSE 0 END"),
        "h": ("1e-8::DOUBLE", "CASE WHEN nx.it % 2 = 0 THEN p.h + coalesce(g.a, 0) ELSE 0 END"),
    }
    return steps("g_part", columns, 2 * k, "sum(s.h) AS h, sum(s.a) AS a", "id, a AS auth, round(h * 1e8, 3) AS hub")


query("hits_literal", "g_part", _hits_literal(2))(lambda g: A.hits_literal(g, 2).select("id", "auth", F.round(c("hub") * 1e8, 3).alias("hub")))

# --- frontier algorithms ----------------------------------------------------------------------------------------------

_TOP = "(SELECT id FROM dg ORDER BY od DESC, id LIMIT 1)"


def _root(g: Graph) -> int:
    """The least id among the vertices that send most."""
    return g.out_degrees().orderBy(c("out_degree").desc(), "id").first()["id"]


_BFS = {
    "lvl": (f"CASE WHEN id = {_TOP} THEN 0 END", "CASE WHEN p.lvl IS NOT NULL THEN p.lvl WHEN g.m IS NOT NULL THEN nx.it END"),
    "par": (f"CASE WHEN id = {_TOP} THEN id END", "CASE WHEN p.lvl IS NOT NULL THEN p.par ELSE g.m END"),
}


def _bfs(out: str, graph: str = "g_frag") -> str:
    return steps(graph, _BFS, "p.lvl IS NULL AND g.m IS NOT NULL", "min(CASE WHEN s.lvl = s.it THEN s.id END) AS m", out)


query("bfs_levels", "g_frag", _bfs("id, lvl::BIGINT AS level"))(lambda g: A.bfs(g, _root(g)).state.select("id", "level"))
query("bfs_by_changes", "g_next", _bfs("id, lvl::BIGINT AS level, par AS parent", "g_next"))(lambda g: A.bfs(g, _root(g), by_changes=True).state.select("id", "level", "parent"))
query("bfs_parents", "g_frag", _bfs("id, par AS parent"))(lambda g: A.bfs(g, _root(g)).state.select("id", "parent"))


def _trace(result: A.Result, g: Graph) -> DataFrame:
    return g.edges.sparkSession.createDataFrame(result.trace, "iteration long, active_vertices long, active_edges long")


query("bfs_frontier_trace", "g_frag", f"WITH t AS ({_bfs('id, od, lvl')}), n AS (SELECT unnest(range(0, (SELECT max(lvl) + 2 FROM t)::BIGINT)) AS iteration) "
      "SELECT iteration::BIGINT AS iteration, count(id) AS active_vertices, coalesce(sum(od), 0)::BIGINT AS active_edges FROM n LEFT JOIN t ON lvl = iteration GROUP BY 1")(
    lambda g: _trace(A.bfs(g, _root(g)), g)
)
_CC = {"label": ("id", "least(p.label, coalesce(g.m, p.label))")}
def _cc(graph: str) -> str:
    return steps(graph, _CC, "g.m < p.label", "min(s.label) AS m", "id, label")


_CC_WEAK = steps("g_frag", _CC, "g.m < p.label", "min(s.label) AS m", "id, label", edges="sym", more=f", sym AS ({_SYM})")
query("cc_directed", "g_frag", _cc("g_frag"))(lambda g: A.connected_components(g).state.select("id", "label"))
query("cc_weak", "g_frag", _CC_WEAK)(lambda g: A.connected_components(g, weak=True).state.select("id", "label"))
query("cc_contracted", "g_frag", _CC_WEAK, saved=False)(A.weak_components)
query("cc_sizes", "g_frag", f"WITH t AS ({_CC_WEAK}) SELECT label, count(*) AS size FROM t GROUP BY label")(
    lambda g: A.connected_components(g, weak=True).state.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
)
_SSSP = {"dist": (f"CASE WHEN id = {_TOP} THEN 0 ELSE 2147483648 END", "least(p.dist, coalesce(g.m, p.dist))")}
_SSSP_ALL = steps("g_frag", _SSSP, "g.m < p.dist", "min(s.dist + e.w) AS m", "id, dist::BIGINT AS dist", senders="s.dist < 2147483648")
query("sssp", "g_frag", _SSSP_ALL)(lambda g: A.sssp(g, _root(g)).state.select("id", "dist"))
query("sssp_unreached", "g_frag", f"WITH t AS ({_SSSP_ALL}) SELECT count(*) FILTER (dist = 2147483648) AS unreached, (sum(dist) FILTER (dist < 2147483648))::BIGINT AS total FROM t")(
    lambda g: A.sssp(g, _root(g)).state.agg(
        F.sum((c("dist") == A.UNREACHED).cast("long")).alias("unreached"), F.sum(F.when(c("dist") < A.UNREACHED, c("dist"))).alias("total")
    )
)


query("cc_blocks", "g_next", _cc("g_next"))(lambda g: K.components_by_blocks(g, _bins(g)).state.select("id", c("value").alias("label")))
query("cc_blocks_weak", "g_frag", _CC_WEAK)(lambda g: K.components_by_blocks(g, P.bin_params(g.vertices.count(), 1), dynamic=False, weak=True).state.select("id", c("value").alias("label")))
query("sssp_blocks", "g_next", steps("g_next", _SSSP, "g.m < p.dist", "min(s.dist + e.w) AS m", "id, dist::BIGINT AS dist", senders="s.dist < 2147483648"))(
    lambda g: K.distances_by_blocks(g, _root(g), _bins(g)).state.select("id", F.coalesce("value", F.lit(A.UNREACHED)).alias("dist"))
)
query("bfs_blocks", "g_next", _bfs("id, lvl::BIGINT AS level", "g_next"))(lambda g: K.levels_by_blocks(g, _root(g), _bins(g)).state.select("id", c("value").alias("level")))


def _nibble(k: int, theta: str) -> str:
    half = "(CASE WHEN p.act THEN p.p / 2 ELSE p.p END)"
    mass = f"({half} + coalesce(g.m, 0))"
    front = f"((p.act AND {half} >= {theta} * p.od) OR coalesce(g.t, 0) > 0)"
    good = f"({mass} >= {theta} * p.od)"
    columns = {
        "p": ("CASE WHEN id = 1 THEN 1.0::DOUBLE ELSE 0.0 END", f"CASE WHEN {front} AND NOT {good} THEN 0.0 ELSE {mass} END"),
        "ps": ("CASE WHEN id = 1 AND od > 0 THEN 1.0::DOUBLE / (2 * od) ELSE 0.0 END", f"CASE WHEN {front} AND {good} AND p.od > 0 THEN {mass} / (2 * p.od) WHEN {front} OR p.act THEN 0.0 ELSE p.ps END"),
        "act": ("id = 1", f"{front} AND {good}"),
    }
    return steps("g_part", columns, k, "sum(s.ps) AS m, max(s.ps) AS t", "id, round(p, 9) AS p", senders="s.act")


query("nibble_5", "g_part", _nibble(5, "1e-9"))(lambda g: A.nibble(g, 1, 5).state.select("id", _round("p", 9)))
query("nibble_threshold", "g_part", _nibble(5, "1e-4"))(lambda g: A.nibble(g, 1, 5, theta=1e-4).state.select("id", _round("p", 9)))


def _delta(k: int, dense: bool, senders: str | None = None, more: str = "") -> str:
    front = "(p.act OR g.m IS NOT NULL)"
    new = f"(CASE WHEN {front} THEN (0.15 + 0.85 * ((CASE WHEN p.act THEN 0 ELSE p.p END) + coalesce(g.m, 0))) / greatest(p.od, 1) ELSE p.p END)"
    old = "(CASE WHEN p.act THEN p.p ELSE p.old END)"
    columns = {
        "p": ("1.0::DOUBLE / greatest(od, 1)", new),
        "old": ("0.0::DOUBLE", old),
        "act": ("true", f"{front} AND p.od > 0 AND abs({old} - {new}) > 0.01 / p.od"),
    }
    return steps("g_part", columns, k, "sum(s.p) AS m", "id, round(p, 6) AS p", senders=senders or ("true" if dense else "s.act"), more=more)


query("prdelta_sparse_3", "g_part", _delta(3, False))(lambda g: A.pagerank_delta(g, 3).state.select("id", _round("p")))
query("prdelta_dense_3", "g_part", _delta(3, True))(lambda g: A.pagerank_delta(g, 3, mode="dense").state.select("id", _round("p")))


_HUB = "od > (SELECT sum(od) // count(*) FROM dg)"


def _loaded(g: Graph) -> DataFrame:
    """out_degree and active of each vertex, with a frontier loaded from a list of ids: the hubs, which send more than the integer average."""
    average = g.edges.count() // max(g.vertices.count(), 1)
    d = g.out_degrees()
    return gas.load_frontier(d, d.where(c("out_degree") > average).select("id"))


query("frontier_load", "g_part", f"SELECT id FROM dg WHERE {_HUB}")(lambda g: gas.get_frontier(_loaded(g)))
query("frontier_reset", "g_part", "SELECT id, od AS out_degree, false AS active FROM dg")(lambda g: gas.reset_frontier(_loaded(g)))
query("bfs_many_roots", "g_frag", steps("g_frag", {"lvl": ("CASE WHEN id % 100 = 7 THEN 0 END", "CASE WHEN p.lvl IS NOT NULL THEN p.lvl WHEN g.m IS NOT NULL THEN nx.it END")}, "p.lvl IS NULL AND g.m IS NOT NULL", "min(CASE WHEN s.lvl = s.it THEN s.id END) AS m", "id, lvl::BIGINT AS level"))(
    lambda g: gas.run(g, _levels(), frontier=g.vertices.where("id % 100 = 7")).state.select("id", "level")
)


def _levels() -> gas.VertexProgram:
    """Levels from every vertex of the first frontier."""
    return gas.VertexProgram(
        {"level": F.when(c("id") % 100 == 7, F.lit(0)).cast("long")}, c("id"), {"m": F.min("msg")},
        activate=c("level").isNull(), gather=lambda k: {"level": F.coalesce(c("level"), F.lit(k).cast("long"))},
    )


# --- partitions -------------------------------------------------------------------------------------------------------


def _bins(g: Graph) -> P.Bins:
    return P.bin_params(g.vertices.count(), THREADS)


_BIN = f""", n AS (SELECT count(*) AS nv FROM v), q AS (SELECT nv, least(nv // {4 * THREADS}, 65536) AS raw FROM n),
bp AS (SELECT nv, CASE WHEN raw = 0 THEN 4 ELSE pow(2, floor(log2(raw)))::BIGINT END AS bw FROM q), bn AS (SELECT nv, bw, (nv - 1) // bw + 1 AS nb FROM bp)"""
_EE = _BIN + ", pe AS (SELECT src, dst, src // bw AS psrc, dst // bw AS pdst FROM e, bn)"
_SPLIT = _BIN + """, th AS (SELECT (SELECT count(*) FROM e) // nb * 2 AS thr FROM bn),
bt AS (SELECT b AS bin, coalesce(n, 0)::BIGINT AS edges FROM (SELECT unnest(range(0, (SELECT nb FROM bn)::BIGINT)) AS b) LEFT JOIN (SELECT src // bw AS sb, count(*) AS n FROM e, bn GROUP BY 1) ON b = sb),
bd AS (SELECT bin, edges, CASE WHEN {0} AND thr > 0 AND edges > thr THEN least(pow(2, round(log2(edges // thr)))::BIGINT, bw) ELSE 1 END AS div FROM bt, th, bn),
sm AS (SELECT bin, edges, div, (coalesce(sum(div) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS sub_map FROM bd),
pt AS (SELECT sub_map + j AS pid, bin, least(nv, bin * bw + j * (bw // div))::BIGINT AS start_v, least(nv, bin * bw + (j + 1) * (bw // div))::BIGINT AS end_v FROM (SELECT *, unnest(range(0, div::BIGINT)) AS j FROM sm), bn)"""
_PARTS = " SELECT pid, bin, start_v, end_v, coalesce(sum(od), 0)::BIGINT AS total_edges FROM pt LEFT JOIN dg ON id >= start_v AND id < end_v GROUP BY 1, 2, 3, 4"


def _on_bins(name: str, graph: str, ctes: str, select: str):
    return query(name, graph, f"WITH {_ctes(graph)}{ctes} {select}")


_on_bins("bin_params", "g_sc", _BIN, "SELECT bw::BIGINT AS bin_width, nb::BIGINT AS bins FROM bn")(
    lambda g: g.edges.sparkSession.createDataFrame([(_bins(g).width, _bins(g).count)], "bin_width long, bins long")
)
_on_bins("partition_equal", "g_sc", _SPLIT.format("false"), _PARTS)(lambda g: P.partitions(g, _bins(g)))
_on_bins("partition_dynamic", "g_sc", _SPLIT.format("true"), _PARTS)(lambda g: P.partitions(g, _bins(g), dynamic=True))
_on_bins("partition_edges", "g_sc", _EE, "SELECT psrc AS pid, count(*) AS edges FROM pe GROUP BY 1")(
    lambda g: P.placed_edges(g, _bins(g)).groupBy(c("psrc").alias("pid")).agg(F.count(F.lit(1)).alias("edges"))
)
_on_bins("locate_sub", "g_sc", _SPLIT.format("true"), "SELECT id, pid FROM v JOIN pt ON id >= start_v AND id < end_v")(
    lambda g: P.locate(g.vertices, g, _bins(g), dynamic=True).select("id", "pid")
)
_on_bins("bin_matrix", "g_part", _EE, "SELECT psrc, pdst, count(*) AS edges FROM pe GROUP BY 1, 2")(lambda g: P.bin_matrix(g, _bins(g)))
_RUNS = "SELECT psrc, pdst, count(DISTINCT src) AS runs FROM pe GROUP BY 1, 2"
_on_bins("png_runs", "g_part", _EE, _RUNS)(lambda g: P.png_runs(g, _bins(g)))
_on_bins("png_compression", "g_part", _EE, f"SELECT (SELECT count(*) FROM e) AS edges, sum(runs)::BIGINT AS runs, round(sum(runs) / (SELECT count(*) FROM e), 6) AS ratio FROM ({_RUNS})")(
    lambda g: P.png_compression(g, _bins(g)).select("edges", "runs", _round("ratio"))
)
_on_bins("ipg_edges", "g_part", _EE, "SELECT src, dst FROM pe WHERE psrc = pdst")(lambda g: P.intra_edges(g, _bins(g)))
_on_bins("run_change_flags", "g_part", _EE, "SELECT src, dst, coalesce(lag(pdst) OVER (PARTITION BY src ORDER BY dst), -1) <> pdst AS new_run FROM pe")(lambda g: P.run_changes(g, _bins(g)))
_on_bins("frontier_active_edges", "g_part", _BIN, f"SELECT id // bw AS pid, (sum(CASE WHEN {_HUB} THEN od ELSE 0 END))::BIGINT AS active_edges FROM dg, bn GROUP BY 1")(
    lambda g: _loaded(g).groupBy(P.bin_of(c("id"), _bins(g)).alias("pid")).agg(F.sum(F.when(c("active"), c("out_degree")).otherwise(0)).alias("active_edges"))
)
_on_bins("density_check", "g_part", _EE, f"""SELECT pid, active_edges, png_edges, total_edges, 28.0 * active_edges > 10.5 * png_edges + 2.67 * total_edges + 4.0 * nb AS is_dense FROM bn, (
  SELECT id // bw AS pid, (sum(CASE WHEN {_HUB} THEN od ELSE 0 END))::BIGINT AS active_edges, sum(od)::BIGINT AS total_edges FROM dg, bn GROUP BY 1) t,
  (SELECT psrc, count(DISTINCT (src, pdst)) AS png_edges FROM pe GROUP BY 1) r WHERE r.psrc = t.pid""")(
    lambda g: P.density(g, _bins(g), _loaded(g).where("active").select("id"))
)



def _placed_run(place: Callable[[Graph], Graph], go: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
    def run(g: Graph) -> DataFrame:
        placed = place(g)
        out = go(placed)
        placed.placed.release()
        return out

    return run


query("pagerank_placed", "g_part", _pr("g_part", 5))(_placed_run(lambda g: L.by_source(g, _bins(g)), lambda g: A.pagerank(g, 5).select("id", _round("rank"))))


def _bucketed(g: Graph) -> DataFrame:
    """Distances over edges bucketed by source; the saved graph is deleted before the result is read."""
    root, placed = _root(g), g.placed_by_source()
    out = A.sssp(placed, root).state.select("id", "dist")
    placed.release()
    return out


query("sssp_bucketed", "g_frag", _SSSP_ALL)(_bucketed)
query("pagerank_compressed", "g_part", _pr("g_part", 5))(_placed_run(lambda g: L.by_target(g, _bins(g)), lambda g: A.pagerank(g, 5).select("id", _round("rank"))))
query("sssp_compressed", "g_next", SQL["sssp_blocks"])(_placed_run(lambda g: L.by_target(g, _bins(g)), lambda g: A.sssp(g, _root(g)).state.select("id", "dist")))
_on_bins("placed_edges_of_tasks", "g_sc", _SPLIT.format("true"), f"SELECT pid, total_edges AS edges FROM ({_PARTS}) WHERE total_edges > 0")(
    lambda g: L.by_source(g, _bins(g)).placed.loads().groupBy("pid").agg(F.sum("edges").alias("edges"))
)
_on_bins("compressed_messages", "g_part", _EE, f"SELECT sum(runs)::BIGINT AS messages FROM ({_RUNS})")(
    lambda g: L.by_target(g, _bins(g)).placed.sent(g.vertices).agg(F.count(F.lit(1)).alias("messages"))
)


_on_bins("active_partitions", "g_part", _BIN, f"SELECT DISTINCT id // bw AS pid FROM dg, bn WHERE {_HUB}")(lambda g: gas.active_partitions(_loaded(g), _bins(g)))
_on_bins("frontier_offsets", "g_part", _BIN, f"""SELECT pid, size, (coalesce(sum(size) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
FROM (SELECT id // bw AS pid, count(*) AS size FROM dg, bn WHERE {_HUB} GROUP BY 1)""")(lambda g: gas.frontier_offsets(_loaded(g), _bins(g)))
_on_bins("png_offsets", "g_part", _EE, f"""SELECT psrc, pdst, runs, (coalesce(sum(runs) OVER (PARTITION BY psrc ORDER BY pdst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
FROM ({_RUNS})""")(lambda g: P.png_offsets(g, _bins(g)))
_on_bins("ipg_offsets", "g_part", _EE, """SELECT id, pid, edges, (coalesce(sum(edges) OVER (PARTITION BY pid ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
FROM (SELECT id, id // bw AS pid, coalesce(n, 0)::BIGINT AS edges FROM bn, v LEFT JOIN (SELECT src, count(*) AS n FROM pe WHERE psrc = pdst GROUP BY 1) ON src = id)""")(lambda g: P.ipg_offsets(g, _bins(g)))

# what a bin's vertices cost in compressed form, and which bins are dense given the active vertices of a state
_COSTS = _EE + ", costs AS (SELECT id // bw AS cb, sum(od) AS te, coalesce(max(n), 0) AS pe FROM bn, dg LEFT JOIN (SELECT psrc, count(DISTINCT (src, pdst)) AS n FROM pe GROUP BY 1) ON psrc = id // bw GROUP BY 1)"
_DENSE = "28.0 * ae > 10.5 * pe + 2.67 * te + 4.0 * nb"


def _parts_trace(g: Graph) -> DataFrame:
    found = A.bfs(g, _root(g), bins=_bins(g)).partitions
    return g.edges.sparkSession.createDataFrame(found, "iteration long, active_partitions long, dense_partitions long")


_on_bins("bfs_partition_trace", "g_frag", _COSTS + f", t AS (SELECT * FROM ({_bfs('id, od, lvl')}))", f"""SELECT lvl::BIGINT AS iteration, count(*) AS active_partitions, count(*) FILTER ({_DENSE}) AS dense_partitions
FROM (SELECT lvl, id // bw AS ab, sum(od) AS ae FROM t, bn WHERE lvl IS NOT NULL GROUP BY 1, 2), bn, costs WHERE cb = ab GROUP BY 1""")(_parts_trace)


def _hybrid(k: int) -> str:
    sent = f"(s.act OR s.id // (SELECT bw FROM bn) IN (SELECT ab FROM (SELECT y.id // bw AS ab, sum(CASE WHEN y.act THEN y.od ELSE 0 END) AS ae FROM s y, bn GROUP BY 1), bn, costs WHERE cb = ab AND {_DENSE}))"
    return _delta(k, False, sent, _COSTS)


def _four(g: Graph) -> P.Bins:
    """Four bins whose width is a power of two: so wide that most of their vertices are active at once in a search."""
    return P.Bins(ordering.pow2_floor(g.vertices.count() // 4), -(-g.vertices.count() // ordering.pow2_floor(g.vertices.count() // 4)))


_FOUR = """, w4 AS (SELECT count(*) AS nv, pow(2, floor(log2(greatest(1, count(*) // 4))))::BIGINT AS bw FROM v), bn AS (SELECT nv, bw, (nv - 1) // bw + 1 AS nb FROM w4),
pe AS (SELECT src, dst, src // bw AS psrc, dst // bw AS pdst FROM e, bn)""" + _COSTS.removeprefix(_EE)
query("bfs_dense_bins", "g_part", _bfs("id, lvl::BIGINT AS level", "g_part"))(lambda g: A.bfs(g, _root(g), bins=_four(g)).state.select("id", "level"))
_on_bins("bfs_dense_trace", "g_part", _FOUR + f", t AS (SELECT * FROM ({_bfs('id, od, lvl', 'g_part')}))", f"""SELECT lvl::BIGINT AS iteration, count(*) AS active_partitions, count(*) FILTER ({_DENSE}) AS dense_partitions
FROM (SELECT lvl, id // bw AS ab, sum(od) AS ae FROM t, bn WHERE lvl IS NOT NULL GROUP BY 1, 2), bn, costs WHERE cb = ab GROUP BY 1""")(
    lambda g: g.edges.sparkSession.createDataFrame(A.bfs(g, _root(g), bins=_four(g)).partitions, "iteration long, active_partitions long, dense_partitions long")
)
query("prdelta_hybrid_3", "g_part", _hybrid(3))(lambda g: A.pagerank_delta(g, 3, bins=_bins(g)).state.select("id", _round("p")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
