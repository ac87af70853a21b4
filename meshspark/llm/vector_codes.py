"""Vector codes: product codebooks by exact integer k-means, whose nearest entries an exponion search finds.

Components become integers, vectors are cut into ``PARTS`` equal parts, and each part position has a codebook of up to
``ENTRIES`` entries.  A part that had entry a before starts there: let u be its distance to a.  An entry that
is as near or nearer lies within 2 u of a, by the triangle inequality, so of the other entries, sorted by distance to a, only
those up to 2 u are looked at.  All distances are exact integers (squared: within 4 u²), and equal ones go to
the lower index, so codes are those of a full search.  Before the first round parts start at entry 0.

A round is one pass: tasks read their vectors and former codes, write the new ones, and one row of counts and sums for
each part and entry they met; only these sums (a codebook's size each, whatever the rows) are added up and come to the
driver.  Vectors are written once a round, with their codes; the table of the round before is then deleted.

Defined edge cases: vectors that are null, empty, or hold null or non-finite components are dropped, and so are those whose
length PARTS doesn't divide, and those with components so large that an error wouldn't fit in a long (2**30 / sqrt(length) after scaling);
vectors of different lengths have codebooks of their own; fewer vectors than ENTRIES make as many entries;
vectors without a vec_id come last, and equal vec_ids go by their vectors' digests; equal vectors may make equal entries,
of which the lower index wins; repeated rows have equal codes; null labels are one label; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import release
from .common import materialize, meet

# Fixed values.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors that one step of a task handles.
BATCH = 4_096


def integers(v: list | np.ndarray | None, parts: int = PARTS) -> np.ndarray | None:
    """floor(SCALE * x) of each component; None for a vector that has no code."""
    if v is None or not len(v) or len(v) % parts:
        return None
    x = np.array([np.nan if c is None else c for c in v], np.float64)
    if not np.isfinite(x).all():
        return None
    x = np.floor(x * SCALE)
    return x.astype("<i4") if np.abs(x).max() * np.sqrt(len(x)) < 1 << 30 else None


class Exponion:
    """Nearest entries of one part position."""

    def __init__(self, entries: np.ndarray):
        """``entries``: (k, width) integers."""
        self.entries = entries.astype(np.int64)
        apart = ((self.entries[:, None] - self.entries[None]) ** 2).sum(axis=2)
        # every entry's others by distance; itself comes first in its own row, even where others are equal to it
        np.fill_diagonal(apart, -1)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.looked = 0  # distances to entries, for those who count

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row of ``x``, which had entry ``before``."""
        best, at = before.astype(np.int64), before.astype(np.int64)
        least = ((x - self.entries[at]) ** 2).sum(axis=1)
        start, radius = at.copy(), 4 * least
        rows, k = np.arange(len(x)), 1
        self.looked += len(x)
        while k < len(self.entries):
            rows = rows[self.apart[start[rows], k] <= radius[rows]]  # neighbours are sorted: who leaves has seen all within its radius
            if not len(rows):
                break
            other = self.order[start[rows], k]
            d = ((x[rows] - self.entries[other]) ** 2).sum(axis=1)
            better = (d < least[rows]) | ((d == least[rows]) & (other < best[rows]))
            least[rows[better]], best[rows[better]] = d[better], other[better]
            self.looked += len(rows)
            k += 1
        return best, least


@dataclass(frozen=True)
class Codes:
    """``rows``: vec_id, label, code (one byte a part), error; ``codebooks``: length -> (parts, entries, width) integers."""

    rows: DataFrame
    codebooks: dict[int, np.ndarray]


def _started(base: DataFrame, parts: int, entries: int) -> dict[int, np.ndarray]:
    """Length -> codebooks of the first vectors by vec_id, a query for each length."""
    out = {}
    for (dim,) in sorted(base.select("_dim").distinct().collect()):
        first = base.where(F.col("_dim") == dim).orderBy(F.col("vec_id").asc_nulls_last(), F.sha2("_x", 256)).select("_x").limit(entries)  # the method's start, not a cap
        x = np.stack([np.frombuffer(r[0], "<i4") for r in first.collect()]).astype(np.int64)
        out[dim] = x.reshape(len(x), parts, dim // parts).transpose(1, 0, 2).copy()
    return out


def _assigned(table: DataFrame, books: dict[int, np.ndarray], parts: int, sums: bool, name: str) -> DataFrame:
    """One pass over (vec_id, label, _dim, _x, code): rows with new codes and errors (_part null) and, if ``sums``, rows of sums."""
    shipped = table.sparkSession.sparkContext.broadcast(books)  # codebooks only
    schema = table.select("vec_id", "label", "_dim", "_x", "code").schema
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    names = [*schema.names, "error", "_part", "_entry", "_many", "_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = {d: [Exponion(b) for b in book] for d, book in shipped.value.items()}
        many = {d: np.zeros(b.shape[:2], np.int64) for d, b in shipped.value.items()}
        total = {d: np.zeros(b.shape, np.int64) for d, b in shipped.value.items()}
        kinds = None
        for whole in batches:
            kinds = [whole.schema.field(i).type for i in range(5)]
            for lo in range(0, whole.num_rows, BATCH):
                b = whole.slice(lo, BATCH)
                dims, raw, old = (b.column(i).to_pylist() for i in (2, 3, 4))
                codes, errors = [b""] * b.num_rows, np.zeros(b.num_rows, np.int64)
                for d in set(dims):
                    at = [i for i, e in enumerate(dims) if e == d]
                    x = np.frombuffer(b"".join(raw[i] for i in at), "<i4").astype(np.int64).reshape(len(at), parts, d // parts)
                    before = np.zeros((len(at), parts), np.uint8) if old[at[0]] is None else np.frombuffer(b"".join(old[i] for i in at), np.uint8).reshape(len(at), parts)
                    new, error = np.zeros((len(at), parts), np.uint8), np.zeros(len(at), np.int64)
                    for p in range(parts):
                        got, far = search[d][p].nearest(x[:, p], before[:, p])
                        new[:, p] = got
                        error += far
                        if sums:
                            many[d][p] += np.bincount(got, minlength=many[d].shape[1])
                            np.add.at(total[d][p], got, x[:, p])
                    errors[at] = error
                    for i, code in zip(at, new, strict=True):
                        codes[i] = code.tobytes()
                none = pa.nulls(b.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i) for i in range(4)], pa.array(codes, pa.binary()), pa.array(errors), none, none, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.list_(pa.int64()))], names=names
                )
        met = [(d, p, e) for d, m in many.items() for p, e in zip(*np.nonzero(m), strict=True)] if sums and kinds else []
        if met:
            n = len(met)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, kinds[0]), pa.nulls(n, kinds[1]), pa.array([d for d, _, _ in met], pa.int32()), pa.nulls(n, kinds[3]), pa.nulls(n, kinds[4]), pa.nulls(n, pa.int64()),
                    pa.array([p for _, p, _ in met], pa.int32()), pa.array([e for _, _, e in met], pa.int32()),
                    pa.array([int(many[d][p, e]) for d, p, e in met]), pa.array([total[d][p, e].tolist() for d, p, e in met], pa.list_(pa.int64())),
                ],
                names=names,
            )

    return materialize(table.select(*schema.names).mapInArrow(run, f"{head}, error long, _part int, _entry int, _many long, _sum array<long>"), name)


def _moved(pass_: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Codebooks whose used entries are the floors of their parts' means."""
    each = pass_.where("_part is not null").select("_dim", "_part", "_entry", "_many", F.posexplode("_sum").alias("_at", "_value"))
    # in decimals: sums of all rows may pass a long
    got = each.groupBy("_dim", "_part", "_entry", "_at").agg(F.sum(F.col("_value").cast("decimal(28,0)")).alias("s"), F.sum("_many").alias("n"))
    out = {d: b.copy() for d, b in books.items()}
    for r in got.collect():  # as many as the codebooks have components
        out[r["_dim"]][r["_part"], r["_entry"], r["_at"]] = int(r["s"]) // r["n"]
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of ``vectors`` (vec_id, embedding, label) after ``rounds`` rounds of assigning and moving, and a last assignment."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index takes one byte")
    schema = vectors.select("vec_id", "label").schema
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [integers(v, parts) for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([None if x is None else len(x) for x in got], pa.int32()), pa.array([None if x is None else x.tobytes() for x in got], pa.binary()), pa.nulls(b.num_rows, pa.binary())],
                names=["vec_id", "label", "_dim", "_x", "code"],
            )

    table = vectors.select("vec_id", "label", "embedding").mapInArrow(scaled, f"{kept}, _dim int, _x binary, code binary").where("_x is not null")
    table = materialize(table, "codes-start")
    books = _started(table, parts, entries)
    for k in range(rounds + 1):
        old, table = table, _assigned(table, books, parts, k < rounds, f"codes-{k}")
        release(old)
        if k < rounds:
            books = _moved(table, books)
            whole = table
            table = table.where("_part is null")
            table.written_to = whole.written_to
    return Codes(table.select("vec_id", "label", "_dim", "code", "error"), books)


def decompressed(codes: Codes) -> DataFrame:
    """vec_id and ``vector`` (integers): each part as its entry."""
    books = codes.rows.sparkSession.sparkContext.broadcast(codes.codebooks)  # codebooks only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, code in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                book = books.value[d]
                out.append(book[np.arange(len(book)), np.frombuffer(code, np.uint8)].reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["vec_id", "vector"])

    kind = codes.rows.schema["vec_id"].dataType.simpleString()
    return codes.rows.select("vec_id", "_dim", "code").mapInArrow(run, f"vec_id {kind}, vector array<long>")


def with_label_errors(codes: Codes) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256; a label with many rows isn't gathered."""
    tag = F.when(F.col("label").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("label").cast("string")))
    rows = codes.rows.withColumn("_label", tag)
    labels = materialize(rows.groupBy(F.col("_label").alias("_l")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_many")), "codes-labels")
    digest = {d: hashlib.sha256(",".join(map(str, b.reshape(-1).tolist())).encode()).hexdigest() for d, b in codes.codebooks.items()}
    sha = F.lit(None).cast("string")
    for d, h in digest.items():
        sha = F.when(F.col("_dim") == d, F.lit(h)).otherwise(sha)
    out = meet(rows, labels, "_label", "_l", "_many")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", sha.alias("codebooks_sha256"))
