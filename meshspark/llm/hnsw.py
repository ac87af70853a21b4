"""Embedding near-duplicates over hierarchical navigable small-world graphs, one per shard.

Equal vectors collapse first (so a vector that fills a third of the table is one node with a
multiplicity).  Distinct vectors are dealt to shards of bounded bytes by hash; each shard's graph is
built in one task and stored in the shared folder beside its vectors.  Every shard's vectors query every shard: a task
reads the two files, so that no vector is shuffled to its queries.  A query's beam widens fourfold until
the worst vector in it lies under the threshold, so that all neighbours are inside, if need be up to the whole shard.

Before a shard's vectors ask another shard (or their own) the pair is audited: against brute force on
sampled vectors, whose matches with themselves don't count, and on vectors planted beside sampled ones of the
asked shard, just above the threshold.  The base beam doubles until both recalls reach ``AUDIT``; only where not even a beam as wide as
the shard does is the shard scanned for the pair.  ``search`` returns the audits, with recalls and what was scanned.  Every hit is verified by cosine in
double precision.  Query tasks return counts of linked vectors and a spanning forest of the links they
saw, linear in queries and touched nodes, which connected components then unite.

Insertion and search run in numpy over batches of vectors.  Each level's lists come from the
usual diversity rule: a candidate is kept if it is closer to the new vector than to any kept one.

Defined edge cases: vectors that are null, empty, zero or hold null or non-finite components get
0 links and are their own component; vectors of different lengths never link; rows that repeat a vec_id are
rows of their own, each with the links of its own vector; rows without a vec_id count as vectors, but
name no component (one of such rows alone has a null component); an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir
from .common import materialize, meet
from .components import components

THRESHOLD = 0.95
LINKS, BUILD_BEAM, BASE_BEAM, BATCH = 16, 64, 32, 512
#: Recall to reach; sampled vectors at first and at most (more are drawn until AUDIT_LINKS links are seen); planted ones.
AUDIT, AUDIT_QUERIES, AUDIT_MOST, AUDIT_LINKS, PLANTED = 0.99, 128, 2_048, 64, 128
#: Vectors whose neighbours a step of a search looks at: at least, and of each so many in its beam one.
STEP, STEPS = 4, 32
#: Shards for vectors of one length: at least MIN_SHARDS (less where they would hold under SHARD_LEAST vectors), more where one would pass SHARD_BYTES.
MIN_SHARDS, SHARD_LEAST, SHARD_BYTES = 6, 64, 128 << 20
#: Row numbers within a shard take so many bits of a node's number.
ROW_BITS = 32


class Graph:
    """Neighbour lists of one level over the first ``n`` rows of ``x`` (unit vectors), -1 where free."""

    def __init__(self, x: np.ndarray, width: int):
        self.x, self.n, self.width = x, 0, width
        self.near = np.full((len(x), width), -1, np.int32)

    def search(self, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam for each query, best first, -1 and -inf where short; ``entry`` is (queries, e)."""
        b, beam = len(q), min(beam, self.n)
        wide = max(STEP, beam // STEPS)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        done = np.zeros((b, beam), bool)
        seen = np.zeros((b, self.n), bool)
        e = entry[:, :beam]
        k = e.shape[1]
        ids[:, :k] = e
        rows = np.arange(b)
        es = np.einsum("bd,bed->be", q, self.x[np.maximum(e, 0)])
        sims[:, :k] = np.where(e >= 0, es, -np.inf)
        r, c = np.nonzero(e >= 0)
        seen[r, e[r, c]] = True
        live = rows
        while len(live):
            open_ = np.where(done[live] | (ids[live] < 0), -np.inf, sims[live])
            pick = np.argpartition(-open_, min(wide, beam) - 1, axis=1)[:, : min(wide, beam)]
            ok = np.take_along_axis(open_, pick, 1) > -np.inf
            going = ok.any(axis=1)
            live, pick, ok = live[going], pick[going], ok[going]
            if not len(live):
                break
            done[live[:, None], pick] |= ok
            at = np.where(ok, ids[live[:, None], pick], -1)
            cand = np.where((at >= 0)[:, :, None], self.near[np.maximum(at, 0)], -1).reshape(len(live), -1)
            cand = np.sort(cand, axis=1)
            bad = cand < 0
            bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
            safe = np.maximum(cand, 0)
            bad |= seen[live[:, None], safe]
            r, c = np.nonzero(~bad)
            seen[live[r], safe[r, c]] = True
            cs = np.full(cand.shape, -np.inf, np.float32)
            cs[r, c] = np.einsum("id,id->i", q[live[r]], self.x[safe[r, c]])
            alls = np.concatenate([sims[live], cs], axis=1)
            top = np.argpartition(-alls, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], safe], axis=1), top, 1)
            sims[live] = np.take_along_axis(alls, top, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], bad], axis=1), top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        return np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), -1), sims

    def choose(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """The diversity rule over candidates sorted best first; free places are filled with the nearest left out."""
        c = self.x[np.maximum(ids, 0)]
        between = np.matmul(c, c.transpose(0, 2, 1))
        b, k = ids.shape
        kept, count = np.zeros((b, k), bool), np.zeros(b, np.int64)
        closest = np.full((b, k), -np.inf, np.float32)
        for j in range(k):
            take = (ids[:, j] >= 0) & (count < most) & (closest[:, j] < sims[:, j])
            kept[:, j] = take
            count += take
            closest = np.maximum(closest, np.where(take[:, None], between[:, j], -np.inf))
        rank = np.where(kept, 0, np.where(ids >= 0, 1, 2)) * k + np.arange(k)
        order = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(ids, order, 1)

    def insert(self, upto: int, entry) -> None:
        """Insert rows n .. upto - 1 in batches; ``entry(rows)`` gives entry points among inserted rows."""
        while self.n < upto:
            lo, hi = self.n, min(upto, self.n + max(32, min(BATCH, self.n)))
            q = self.x[lo:hi]
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            k = min(BUILD_BEAM // 2, hi - lo)
            mates = np.argpartition(-own, k - 1, axis=1)[:, :k] if k else np.zeros((hi - lo, 0), int)
            ids, sims = mates + lo, np.take_along_axis(own, mates, 1)
            if lo:
                found, fs = self.search(q, entry(np.arange(lo, hi)), BUILD_BEAM)
                ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, fs], axis=1)
            order = np.argsort(-sims, axis=1)[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            ids = np.where(sims > -np.inf, ids, -1)
            mine = self.choose(q, ids, sims, self.width // 2)
            self.near[lo:hi, : mine.shape[1]] = mine
            self.n = hi
            r, c = np.nonzero(mine >= 0)
            self.backlink(mine[r, c], r + lo)

    def backlink(self, of: np.ndarray, to: np.ndarray) -> None:
        """Add to[i] to the list of of[i]; lists that overflow are chosen anew."""
        s = np.einsum("id,id->i", self.x[of], self.x[to])
        order = np.lexsort((-s, of))
        of, to = of[order], to[order]
        nodes, start, many = np.unique(of, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 1024):
            v, st, m = nodes[lo : lo + 1024], start[lo : lo + 1024], np.minimum(many[lo : lo + 1024], self.width)
            w = int(m.max())
            grid = st[:, None] + np.minimum(np.arange(w), m[:, None] - 1)
            new = np.where(np.arange(w) < m[:, None], to[grid], -1)
            cand = np.sort(np.concatenate([self.near[v], new], axis=1), axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sims = np.where(cand >= 0, np.einsum("bd,bed->be", self.x[v], self.x[np.maximum(cand, 0)]), -np.inf).astype(np.float32)
            rank = np.argsort(-sims, axis=1)
            cand, sims = np.take_along_axis(cand, rank, 1), np.take_along_axis(sims, rank, 1)
            self.near[v] = self.choose(self.x[v], cand, sims, self.width)


class Index:
    """A hierarchy of graphs over the vectors of one shard."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        """``vectors``: unit vectors in double precision; ``order`` tells which of them stands at each row."""
        rng = np.random.default_rng(seed)
        level = np.minimum(rng.exponential(1 / np.log(LINKS), len(vectors)).astype(int), 6)
        self.order = np.argsort(-level, kind="stable")
        self.exact = vectors[self.order]
        self.x = self.exact.astype(np.float32)
        sizes = [int((level >= k).sum()) for k in range(level.max(initial=0) + 1)]
        self.levels: list[Graph] = []
        for k in range(len(sizes) - 1, -1, -1):
            if k and sizes[k] <= 2 * LINKS and k < len(sizes) - 1:
                continue
            g = Graph(self.x[: sizes[k]], LINKS * (2 if k == 0 else 1))
            above = list(self.levels)
            g.insert(sizes[k], lambda rows, above=above, g=g: self.entries(self.x[rows], above, g.n))
            self.levels.append(g)

    def state(self) -> list[tuple]:
        """What ``restore`` makes the index from, beside its vectors."""
        return [(g.n, g.width, g.near) for g in self.levels]

    @classmethod
    def restore(cls, exact: np.ndarray, levels: list[tuple]) -> Index:
        self = cls.__new__(cls)
        self.exact, self.x, self.levels = exact, exact.astype(np.float32), []
        for n, width, near in levels:
            g = Graph(self.x[:n], 0)
            g.n, g.width, g.near = n, width, near
            self.levels.append(g)
        return self

    def entries(self, q: np.ndarray, above: list[Graph], n: int) -> np.ndarray:
        """Entry points among the first n rows: the best four that the levels above yield."""
        at = np.zeros((len(q), 1), np.int64)
        for g in above:
            at = g.search(q, at, 16)[0][:, :4]
        return np.where(at < n, at, 0)

    def scan(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs near the threshold or above it, by brute force."""
        got = [np.nonzero(q @ self.exact[lo : lo + 8192].T >= THRESHOLD - 1e-9) for lo in range(0, len(self.exact), 8192)]
        return np.concatenate([r for r, _ in got]), np.concatenate([c + 8192 * k for k, (_, c) in enumerate(got)])

    def verified(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of (query, row) pairs those whose cosine, in double precision, reaches the threshold."""
        ok = np.concatenate([np.einsum("id,id->i", q[i[a : a + 65536]], self.exact[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)]) >= THRESHOLD
        return i[ok], j[ok]

    def query(self, q: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) pairs that reach the threshold and that searches of the graph find, in parts of bounded size."""
        n, left, q32, base = len(self.exact), np.arange(len(q)), q.astype(np.float32), self.levels[-1]
        beam = min(beam, n)
        while len(left):
            rest = []
            step = max(1, min(BATCH, 32_000_000 // n, 8_000_000 // beam))
            for lo in range(0, len(left), step):
                part = left[lo : lo + step]
                ids, sims = base.search(q32[part], self.entries(q32[part], self.levels[:-1], base.n), beam)
                full = (sims[:, -1] >= THRESHOLD - 1e-4) & (ids[:, -1] >= 0) & (beam < n)
                rest.append(part[full])
                i, c = np.nonzero((sims >= THRESHOLD - 1e-4) & (ids >= 0) & ~full[:, None])
                yield self.verified(q, part[i], ids[i, c])
            left, beam = np.concatenate(rest), min(4 * beam, n)

    def scanned(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same pairs by brute force, for pairs of shards whose audit no beam passes."""
        step = max(1, min(BATCH, 4_000_000 // len(self.exact)))
        for lo in range(0, len(q), step):
            i, j = self.scan(q[lo : lo + step])
            yield self.verified(q, i + lo, j)

    def audit(self, asking: np.ndarray, own: bool, rng: np.random.Generator) -> tuple[int, int, float]:
        """(beam, links seen, recall): the base beam with which ``asking`` vectors find AUDIT of their links here, or the shard's size if none does.

        ``own``: the asking vectors are this shard's rows; a row's match with itself counts on neither side.
        """
        n, m = len(self.exact), min(len(asking), AUDIT_QUERIES)
        drawn = rng.permutation(len(asking))[:AUDIT_MOST]
        while True:
            pick = drawn[:m]
            i, j = self.scan(asking[pick])
            true = set(zip(i.tolist(), j.tolist(), strict=True))
            if own:
                true -= {(k, int(p)) for k, p in enumerate(pick)}
            if len(true) >= AUDIT_LINKS or m >= len(drawn):
                break
            m *= 2
        target = rng.choice(n, min(n, PLANTED), replace=False)
        noise = rng.normal(size=(len(target), self.exact.shape[1]))
        x = self.exact[target]
        noise -= np.einsum("id,id->i", noise, x)[:, None] * x
        length = np.sqrt((noise * noise).sum(axis=1))[:, None]
        cos = rng.uniform(THRESHOLD, 1.0, (len(target), 1)) * 0.999 + 0.001
        planted = np.where(length > 1e-9, cos * x + np.sqrt(1 - cos * cos) * noise / np.maximum(length, 1e-9), x)
        beam = BASE_BEAM
        while True:
            found = {(int(a), int(b)) for i, j in self.query(asking[pick], beam) for a, b in zip(i, j, strict=True)} & true
            hit = {(int(a), int(b)) for i, j in self.query(planted, beam) for a, b in zip(i, j, strict=True)}
            real = len(found) / len(true) if true else 1.0
            recall = min(real, sum((k, int(t)) in hit for k, t in enumerate(target)) / max(1, len(target)))
            if recall >= AUDIT or beam >= n:
                return min(beam, n), len(true), recall
            beam *= 2


class Forest:
    """Spanning forest of links between nodes 0 .. n - 1 that come in batches; keeps the ends of the links that joined trees."""

    def __init__(self, n: int):
        self.root, self.a, self.b = np.arange(n), [], []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.root[x], self.root[y]], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if not len(pairs):
            return
        parent: dict[int, int] = {}

        def top(v: int) -> int:
            while (up := parent.get(v, v)) != v:
                parent[v] = v = parent.get(up, up)
            return v

        for s, t in pairs.tolist():
            s, t = top(s), top(t)
            if s != t:
                parent[max(s, t)] = min(s, t)
                self.a.append(s)
                self.b.append(t)
        moved = np.fromiter(parent, np.int64, len(parent))
        to = np.arange(len(self.root))
        to[moved] = [top(v) for v in moved.tolist()]
        self.root = to[self.root]


def unit(v) -> np.ndarray | None:
    """The vector scaled to length 1 in double precision; None if it can't link with anything."""
    if v is None or not len(v):
        return None
    x = np.array([np.nan if c is None else c for c in v], np.float64)
    n = np.abs(x).max() if np.isfinite(x).all() else 0.0
    if not n > 0:
        return None
    x = x / n
    return x / np.sqrt(x @ x)


def _store(path: str, data: bytes) -> None:
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(data)


def _vectors(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(multiplicities, unit vectors) of a shard."""
    fs, at = pafs.FileSystem.from_uri(path + ".vec")
    with fs.open_input_file(at) as f:
        n, d = struct.unpack("<QQ", f.read(16))
        return np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(8 * n * d), "<f8").reshape(n, d)


def _graph(path: str) -> list[tuple]:
    fs, at = pafs.FileSystem.from_uri(path + ".idx")
    with fs.open_input_file(at) as f:
        return pickle.loads(f.read())  # written by our own tasks


@dataclass(frozen=True)
class Near:
    """``rows``: vec_id, n_links, component_id, kept; ``audits``: asking and asked shard, base beam, links seen, recall, and whether the shard was scanned."""

    rows: DataFrame
    audits: DataFrame


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    return search(vectors).rows


def search(vectors: DataFrame) -> Near:
    """Results for every row of ``vectors`` (vec_id, embedding), and the audits behind them."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = [unit(v) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if x is None else xxhash.xxh3_128_digest(x.tobytes()) for x in u], pa.binary()), pa.array([None if x is None else x.tobytes() for x in u], pa.binary())],
                names=["vec_id", "_key", "_raw"],
            )

    rows = materialize(vectors.select("vec_id", "embedding").mapInArrow(keyed, f"vec_id {kind}, _key binary, _raw binary"), "vec-rows")
    nodes = rows.where("_key is not null").groupBy("_key", F.length("_raw").alias("_dim")).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("_raw").alias("_raw")
    )
    nodes = materialize(nodes, "vec-nodes")
    plan, upto = [], 0
    for r in sorted(nodes.groupBy("_dim").count().collect()):  # a row for each vector length
        shards = max(min(MIN_SHARDS, -(-r["count"] // SHARD_LEAST)), -(-r["count"] * r["_dim"] // SHARD_BYTES))
        plan.append((r["_dim"], upto, upto + shards))
        upto += shards
    of_dim = spark.createDataFrame(plan, "_d int, _from long, _to long")
    folder = f"{shared_dir(spark)}/meshspark/hnsw-{uuid.uuid4().hex}"
    placed = nodes.join(F.broadcast(of_dim), F.col("_dim") == F.col("_d")).select(
        "_key", "many", "_raw", (F.col("_from") + F.pmod(F.xxhash64("_key"), F.col("_to") - F.col("_from"))).alias("_shard"), "_from", "_to"
    )

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_key", ignore_index=True)
        index = Index(np.frombuffer(b"".join(pdf["_raw"]), np.float64).reshape(len(pdf), -1))
        # a name of its own for every attempt; only the rows that count tell it
        shard = int(pdf["_shard"].iloc[0])
        path = f"{folder}/{shard}-{uuid.uuid4().hex}"
        many = pdf["many"].to_numpy()[index.order].astype("<i8")
        _store(path + ".vec", struct.pack("<QQ", *index.exact.shape) + many.tobytes() + index.exact.astype("<f8").tobytes())
        _store(path + ".idx", pickle.dumps(index.state(), protocol=5))
        first = [path] + [None] * (len(pdf) - 1)
        return pd.DataFrame({"_n": (shard << ROW_BITS) + np.arange(len(pdf)), "_k": pdf["_key"].to_numpy()[index.order], "path": first, "_s": shard, "_a": pdf["_from"], "_b": pdf["_to"]})

    built = materialize(placed.groupBy("_shard").applyInPandas(build, "_n long, _k binary, path string, _s long, _a long, _b long"), "vec-built")
    files = materialize(built.where("path is not null").select("_s", "path", "_a", "_b"), "vec-shards")  # a row a shard
    # every shard's vectors against every shard of their length: a row for each two shards, whose number bytes bound
    two = files.select("_s", "path", F.explode(F.sequence("_a", F.col("_b") - 1)).alias("_t"))
    two = two.join(files.select(F.col("_s").alias("_t"), F.col("path").alias("_asked")), "_t").select(F.col("_t"), "_asked", F.col("_s"), "path")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    two = two.repartition(tasks, F.xxhash64("_t", "_s")).sortWithinPartitions("_t", "_s")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, None, None]
        for b in batches:
            for t, asked, s, path in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held[0] != asked:
                    held[:] = [None, None, None]
                    weight, exact = _vectors(asked)
                    held[:] = [asked, weight, Index.restore(exact, _graph(asked))]
                _, weight, index = held
                own = path == asked
                q = index.exact if own else _vectors(path)[1]
                beam, links, recall = index.audit(q, own, np.random.default_rng([s, t]))
                base = 0 if own else len(q)
                count, forest = np.zeros(len(q), np.int64), Forest(base + len(index.exact))
                for i, j in index.query(q, beam) if recall >= AUDIT else index.scanned(q):
                    if own:
                        i, j = i[i != j], j[i != j]
                    np.add.at(count, i, weight[j])
                    forest.add(i, j + base)
                some = np.nonzero(count)[0]
                ends = []
                for e in (forest.a, forest.b):
                    e = np.array(e, np.int64)
                    ends.append(np.where(e < base, (s << ROW_BITS) + e, (t << ROW_BITS) + e - base))
                n, m = len(some), len(ends[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([0, 1, 2], np.int32), [n, m, 1])), pa.array(np.concatenate([(s << ROW_BITS) + some, ends[0], [s]])),
                        pa.array(np.concatenate([count[some], ends[1], [t]])), pa.array([None] * (n + m) + [beam], pa.int64()),
                        pa.array([None] * (n + m) + [links], pa.int64()), pa.array([None] * (n + m) + [recall], pa.float64()),
                    ],
                    names=["kind", "a", "b", "beam", "links", "recall"],
                )

    seen = materialize(two.mapInArrow(ask, "kind int, a long, b long, beam long, links long, recall double"), "vec-links")
    counts = seen.where("kind = 0").groupBy("a").agg(F.sum("b").alias("_links")).select(F.col("a").alias("_a"), "_links")
    comp = components(seen.where("kind = 1").select("a", "b"), "vec")
    known = built.select(F.col("_n"), "_k").join(nodes.select("_key", "rep", "many"), F.col("_k") == F.col("_key")).select("_n", "_k", "rep", "many")
    known = known.join(counts, F.col("_n") == F.col("_a"), "left").join(comp, F.col("_n") == F.col("id"), "left")
    known = materialize(known.select("_k", "rep", "many", (F.coalesce("_links", F.lit(0)) + F.col("many") - 1).alias("_links"), F.coalesce("component", "_n").alias("_c")), "vec-known")
    least = known.groupBy(F.col("_c").alias("_c2")).agg(F.min("rep").alias("_comp"))
    facts = materialize(known.join(least, F.col("_c") == F.col("_c2")).select("_k", "_links", "_comp", "many"), "vec-facts")
    out = meet(rows.select("vec_id", "_key"), facts, "_key", "_k", "many", "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_comp", "vec_id").alias("component_id"))
    audits = seen.where("kind = 2").select(F.col("a").alias("asking"), F.col("b").alias("asked"), "beam", "links", "recall", (F.col("recall") < AUDIT).alias("scanned"))
    return Near(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), audits)
