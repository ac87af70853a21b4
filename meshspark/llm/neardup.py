"""Near-duplicates: MinHash bands for candidates, sequential Bayesian pruning, exact verification, components.

1. Each document becomes the set of its hashed word 5-grams, with ``HASHES`` MinHash values.
   Documents with equal sets collapse to one representative, which gets a number.
2. Representatives meet in bands of equal values.  Within a band only *stars* are compared: each
   member with one centre.  Pairs are compared in batches of signature values and dropped once the
   posterior probability that their similarity reaches the threshold (uniform prior) falls under
   ``MISS``; survivors are verified on their full sets; verified links are united.
3. Bands whose members still lie in several components get other centres, for a few rounds; what
   remains after those is compared exhaustively in blocks of bounded rows and bytes, each a file of
   signatures and sets.  A task reads the two files of a pair of blocks that holds two components, the sets
   only of pairs that survive the batches, and returns a spanning forest of links.  A pair that shares several
   bands is compared in the first of them alone.
So no band is capped and no list of all pairs arises: rows out are linear in the members.  Bands with
more than their share of rows join their centres by broadcast, so that none gathers in one task.

``Similarity`` sets the threshold; its bands have as many rows as keep the chance that a pair at the
threshold shares none under ``LOST``: 6 rows at 0.85 (1e-5), 5 at 0.8 (1.5e-5).  Such a pair is pruned with
probability about MISS; linked copies usually have several paths to their component.

Defined edge cases: texts without words (null, blank) have empty sets and link with nothing; texts
of fewer than 5 words are one shingle; rows that repeat a doc_id each count with their own text; rows
without a doc_id link like others but name no component (one that links with such rows alone has a null
component_id); an empty table gives no rows.  Results compare doc_ids in their natural order.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir
from .common import LOWER, UPPER, digest, few, materialize, meet, running, slices, worker_state
from .components import components

SHINGLE, HASHES, BATCH, MISS, LOST = 5, 144, 24, 1e-6, 2e-5
#: Rounds of stars; members of a block, and bytes of their sets (one set may be larger).
STAR_ROUNDS, BLOCK, BLOCK_BYTES = 2, 256, 8 << 20


@dataclass(frozen=True)
class Similarity:
    """Links need ``den`` * intersection >= ``num`` * union."""

    num: int
    den: int = 100

    @property
    def rows(self) -> int:
        t = self.num / self.den
        return max((r for r in range(1, BATCH) if (1 - t**r) ** (HASHES // r) <= LOST), default=1)

    @property
    def bands(self) -> int:
        return HASHES // self.rows

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both) and both > 0


OP4 = Similarity(85)

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_P = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.Generator(np.random.PCG64(20240))
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    if not k:
        return h
    with np.errstate(over="ignore"):
        s = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            s = (s ^ h[i : len(h) - k + 1 + i]) * _P
            s ^= s >> np.uint64(31)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set; long sets in slices, so that memory stays bounded."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            x = s[i : i + 2048]
            np.minimum(out, ((x[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32), out=out)
    return out


def least_matches(threshold: float = OP4.num / OP4.den, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m) per batch: after n values, pairs with fewer than m matches are dropped.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), and the
    probability that it is at least t equals that of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, like: Similarity = OP4) -> np.ndarray:
    """Rows of two signature matrices that survive all batches."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    # kept by the worker: a cached function would reach executors by its name, which they can't import
    known, threshold = worker_state().setdefault("least_matches", {}), like.num / like.den
    if threshold not in known:
        known[threshold] = least_matches(threshold)
    for n, m in known[threshold]:
        matches[alive] += (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
        alive, at = alive[matches[alive] >= m], n
        if not len(alive):
            break
    return alive


def _signatures(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), "<u4").reshape(-1, HASHES)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, _key (the text's digest), n_shingles, set_key, sig for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, keys, sigs = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "_key", "n_shingles", "set_key", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", digest().alias("_key")).mapInArrow(run, f"doc_id {kind}, _key binary, n_shingles long, set_key binary, sig binary")


def band_rows(reps: DataFrame, like: Similarity) -> DataFrame:
    """(band, at, rep) for each representative and band; ``at`` is the band's place in the signature."""
    bands, width = like.bands, 4 * like.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = _signatures(b.column(1))
            keys = np.empty((len(sig), bands), np.int64)
            for i, s in enumerate(sig):
                raw = s.tobytes()
                for k in range(bands):
                    keys[i, k] = np.int64(xxhash.xxh3_64_intdigest(raw[k * width : (k + 1) * width], k) - (1 << 63))
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(sig)), bands)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(sig))), ids], names=["band", "at", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "band long, at int, rep long")


def _on_row(a: DataFrame, doc_id: Column, key: Column) -> Column:
    """Rows of ``a`` (doc_id, text) that hold this id and this text."""
    return a["doc_id"].eqNullSafe(doc_id) & (digest(a["text"]) == key)


def _sets(docs: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, items): the full sets, as bytes, of the representatives ``ids`` (_i), read from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).astype("<u8").tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "items"])

    wanted = few(materialize(reps.join(ids, F.col("rep") == F.col("_i"), "left_semi").select(F.col("rep").alias("node"), "first", "key"), "dup-wanted"), 64)
    found = docs.join(wanted, _on_row(docs, wanted["first"], wanted["key"])).select("node", "text").mapInArrow(run, "node long, items binary")
    return materialize(found.dropDuplicates(["node"]), "dup-items")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b) that survive the batches and whose full sets link."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = pa.array(survivors(_signatures(b.column(2)), _signatures(b.column(3)), like))
                yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep = [i for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)) if like.linked(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"))]
            k = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(k), b.column(1).take(k)], names=["a", "b"])

    sa = reps.select(F.col("rep").alias("_ra"), F.col("sig").alias("_sa"))
    sb = reps.select(F.col("rep").alias("_rb"), F.col("sig").alias("_sb"))
    both = pairs.join(sa, F.col("a") == F.col("_ra")).join(sb, F.col("b") == F.col("_rb")).select("a", "b", "_sa", "_sb")
    left = materialize(both.mapInArrow(prune, "a long, b long"), "dup-survivors")
    items = _sets(docs, reps, left.select(F.col("a").alias("_i")).union(left.select("b")).distinct())
    ia = items.select(F.col("node").alias("_ia"), F.col("items").alias("_xa"))
    ib = items.select(F.col("node").alias("_ib"), F.col("items").alias("_xb"))
    full = left.join(ia, F.col("a") == F.col("_ia")).join(ib, F.col("b") == F.col("_ib")).select("a", "b", "_xa", "_xb")
    return materialize(full.mapInArrow(exact, "a long, b long"), "dup-links")


class Block:
    """Members of a part of a band: numbers, components and signatures; sets are read from the file when asked for."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        n, facts = np.frombuffer(self.file.read_at(16, 0), "<i8")
        with np.load(io.BytesIO(self.file.read_at(int(facts), 16))) as f:
            self.ids, self.comp, self.sig, self.ends = f["ids"], f["comp"], f["sig"], f["ends"]
        self.base, self.sets = 16 + int(facts), {}
        assert len(self.ids) == n

    @staticmethod
    def store(path: str, ids: np.ndarray, comp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray]) -> None:
        head = io.BytesIO()
        np.savez(head, ids=ids, comp=comp, sig=sig, ends=np.cumsum([len(x) for x in sets]))
        facts = head.getvalue()
        fs, at = pafs.FileSystem.from_uri(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(at) as f:
            f.write(np.array([len(ids), len(facts)], "<i8").tobytes() + facts)
            for x in sets:
                f.write(x.astype("<u8").tobytes())

    def set(self, i: int) -> np.ndarray:
        if i not in self.sets:
            lo, hi = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
            self.sets[i] = np.frombuffer(self.file.read_at(8 * (hi - lo), self.base + 8 * lo), "<u8")
        return self.sets[i]


def compared(a: Block, b: Block, place: int, like: Similarity) -> list[tuple[int, int]]:
    """A spanning forest of the links between components of two blocks (or one with itself) of the band at ``place``."""
    own = a is b
    rows, parent, links = like.rows, {}, []

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = c = parent.get(up, up)
        return c

    for i in range(len(a.ids)):
        j = np.arange(i + 1 if own else 0, len(b.ids))
        j = j[b.comp[j] != a.comp[i]]
        if place and len(j):
            earlier = (b.sig[j, : place * rows] == a.sig[i, : place * rows]).reshape(len(j), place, rows).all(axis=2).any(axis=1)
            j = j[~earlier]
        if len(j):
            for k in j[survivors(np.broadcast_to(a.sig[i], (len(j), HASHES)), b.sig[j], like)].tolist():
                x, y = root(int(a.comp[i])), root(int(b.comp[k]))
                if x != y and like.linked(a.set(i), b.set(k)):
                    parent[x] = y
                    links.append((int(a.ids[i]), int(b.ids[k])))
    return links


def _exhaust(rows: DataFrame, reps: DataFrame, docs: DataFrame, like: Similarity) -> DataFrame:
    """Links between components within bands ``rows`` (band, at, rep, comp)."""
    spark = rows.sparkSession
    sized = rows.join(reps.select(F.col("rep").alias("_r"), "n"), F.col("rep") == F.col("_r")).select("band", "at", "rep", "comp", "n")
    cut = running(sized, ["band"], [F.col("comp").asc(), F.col("rep").asc()], F.col("n") * 8, "dup-blocks")
    cut = cut.withColumn("_blk", F.floor(F.col("_rank") / BLOCK) + F.floor(F.col("_before") / BLOCK_BYTES)).select("band", "at", "rep", "comp", "n", "_blk")
    cut = materialize(cut, "dup-cut")
    items = _sets(docs, reps, cut.select(F.col("rep").alias("_i")).distinct()).withColumnRenamed("node", "_t")
    members = cut.join(reps.select(F.col("rep").alias("_r"), "sig"), F.col("rep") == F.col("_r")).join(items, F.col("rep") == F.col("_t")).select("band", "at", "_blk", "rep", "comp", "n", "sig", "items")
    folder = f"{shared_dir(spark)}/meshspark/dup-blocks-{uuid.uuid4().hex}"

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"  # every attempt writes files of its own; only the row that counts tells them
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u4").reshape(-1, HASHES)
        Block.store(path, pdf["rep"].to_numpy(), pdf["comp"].to_numpy(), sig, [np.frombuffer(x, "<u8") for x in pdf["items"]])
        return pd.DataFrame({"b": pdf["band"].iloc[:1], "p": pdf["at"].iloc[:1], "i": pdf["_blk"].iloc[:1], "path": [path], "lo": [pdf["comp"].min()], "hi": [pdf["comp"].max()], "least": [pdf["n"].min()], "most": [pdf["n"].max()]})

    blocks = materialize(members.groupBy("band", "at", "_blk").applyInPandas(write, "b long, p int, i long, path string, lo long, hi long, least long, most long"), "dup-files")
    other = blocks.select(*[F.col(c).alias(f"{c}2") for c in ("b", "i", "path", "lo", "hi", "least", "most")])
    last = blocks.groupBy(F.col("b").alias("_b")).agg(F.max("i").alias("_last"), F.count(F.lit(1)).alias("_n"))
    # each block names those it meets, so that pairs are found by band and block: no task gathers those of a band
    asking = meet(blocks, materialize(last, "dup-last"), "b", "_b", "_n").withColumn("_j", F.explode(F.sequence("i", "_last")))
    two = asking.join(other, (F.col("b") == F.col("b2")) & (F.col("_j") == F.col("i2")))
    # blocks of one component need no comparison with themselves or with others of that component, nor those whose sets' sizes are too far apart
    two = two.where(~((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2"))))
    two = two.where((F.col("most") * like.den >= F.col("least2") * like.num) & (F.col("most2") * like.den >= F.col("least") * like.num))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    two = two.select("path", "path2", "p").repartition(tasks, F.xxhash64("path", "path2")).sortWithinPartitions("path")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, None]
        for b in batches:
            for x, y, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held[0] != x:
                    held[:] = [x, Block(x)]
                links = compared(held[1], held[1] if x == y else Block(y), place, like)
                held[1].sets.clear()
                yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in links], pa.int64()), pa.array([v[1] for v in links], pa.int64())], names=["a", "b"])

    return materialize(two.mapInArrow(compare, "a long, b long"), "dup-rest")


def _grouped(docs: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame]:
    """``describe``'s rows, and (_set, _first, _first_key, many): for each set its component's smallest id, and the row that stands for it."""
    base = docs.select("doc_id", "text")
    seen = materialize(describe(base), "dup-sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_key").alias("key")))
    reps = seen.where("n_shingles > 0").groupBy("set_key").agg(least.alias("_f"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("many"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("rep"), "set_key", F.col("_f")["id"].alias("first"), F.col("_f")["key"].alias("key"), "sig", "n", "many"), "dup-reps")
    bands = materialize(band_rows(reps, like), "dup-bands")
    total = bands.count()

    def stars(rows: DataFrame, salt: int) -> DataFrame:
        centre = rows.groupBy("band").agg(F.min(F.struct(F.xxhash64(F.lit(salt), F.col("rep")).alias("h"), F.col("rep").alias("rep"), F.col("comp").alias("comp"))).alias("_c"), F.count(F.lit(1)).alias("_n"))
        centre = materialize(centre.where("_n > 1").select(F.col("band").alias("_band"), F.col("_c")["rep"].alias("_centre"), F.col("_c")["comp"].alias("_comp"), "_n"), "dup-centres")
        met = meet(rows, centre, "band", "_band", "_n", total=total).where(F.col("comp") != F.col("_comp"))
        return met.select(F.least("rep", "_centre").alias("a"), F.greatest("rep", "_centre").alias("b")).distinct()

    tried = materialize(stars(bands.withColumn("comp", F.col("rep")), 0), "dup-pairs")
    links = verified(tried, reps, base, like)
    wide = None
    for step in range(1, STAR_ROUNDS + 1):
        comp = components(links, "dup")
        if wide is None:
            shared = materialize(bands.groupBy(F.col("band").alias("_band")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 2"), "dup-shared")
            wide = materialize(meet(bands, shared, "band", "_band", "_n", total=total).select("band", "at", "rep"), "dup-wide")
        placed = materialize(wide.join(comp, F.col("rep") == F.col("id"), "left").select("band", "at", "rep", F.coalesce("component", "rep").alias("comp")), "dup-placed")
        open_ = placed.groupBy(F.col("band").alias("_band")).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_lo <> _hi")
        rows = materialize(meet(placed, materialize(open_.select("_band", "_n"), "dup-mixed"), "band", "_band", "_n", total=total).select("band", "at", "rep", "comp"), "dup-open")
        if rows.isEmpty():
            break
        if step == STAR_ROUNDS:
            links = materialize(links.union(_exhaust(rows, reps, base, like)), "dup-all")
            comp = components(links, "dup")
            break
        new = materialize(stars(rows, step).join(tried.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti"), "dup-pairs")
        tried = tried.union(new)
        links = materialize(links.union(verified(new, reps, base, like)), "dup-all")
    owner = materialize(reps.join(comp, F.col("rep") == F.col("id"), "left").select("set_key", "first", "key", "many", F.coalesce("component", "rep").alias("_c")), "dup-owners")
    first = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), F.col("key").alias("key")))
    heads = owner.groupBy(F.col("_c").alias("_h")).agg(first.alias("_f"))
    facts = owner.join(heads, F.col("_c") == F.col("_h")).select(F.col("set_key").alias("_set"), F.col("_f")["id"].alias("_first"), F.col("_f")["key"].alias("_first_key"), "many")
    return seen, materialize(facts, "dup-facts")


def near_duplicates(docs: DataFrame, like: Similarity = OP4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    seen, owner = _grouped(docs, like)
    out = meet(seen.select("doc_id", "n_shingles", "set_key"), owner, "set_key", "_set", "many", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("_set").isNull(), F.col("doc_id")).otherwise(F.col("_first")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, like: Similarity = OP4) -> DataFrame:
    """The rows of ``docs``, all columns, but those of a group's other members.

    The member of smallest id stays (rows without an id come last; of one id the text of smallest digest); of rows
    equal in id and text one stays.
    """
    seen, owner = _grouped(docs, like)
    rows = seen.groupBy("doc_id", "_key").agg(F.first("set_key").alias("set_key"), F.count(F.lit(1)).alias("_n"))
    rows = meet(materialize(rows, "dup-rows"), owner, "set_key", "_set", "many", "left")
    lost = F.col("_set").isNotNull() & ~(F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("_key") == F.col("_first_key")))
    rows = materialize(rows.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_n", lost.alias("_lost")).where("_lost or _n > 1"), "dup-lost")
    rows = few(rows, 64)
    left = docs.join(rows, _on_row(docs, rows["_d"], rows["_k"]), "left_anti")
    again = rows.where("not _lost")
    if again.isEmpty():
        return left
    found = docs.join(again, _on_row(docs, again["_d"], again["_k"]), "left_semi")
    one = found.groupBy("doc_id", "text").agg(F.first(F.struct(*[found[c] for c in docs.columns])).alias("_row")).select("_row.*")
    return left.union(one)
