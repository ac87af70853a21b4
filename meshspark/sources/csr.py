"""The binary CSR format, as a Spark data source and as plain functions, and text output.

Layout, little-endian: vertex count, edge count, out-offsets (one a vertex), targets (one an edge);
``format=mix`` adds in-offsets and in-sources; ``format=csr_weighted`` adds 32-bit weights.  Ids and
offsets have 4 bytes, or 8 with ``wide``.

    register(spark)
    spark.read.format("csr").option("format", "mix").load(path)          # src, dst[, w]; option side=in reads the in-edges of a mix file
    write_csr(edges, path, vertices, "mix")                              # sorted by Spark
    edges.write.format("csr").option("vertices", n).mode("overwrite").save(path)
    write_csr_folder(edges, path, vertices, "mix")                       # a file a range of sources; read like the other

Reading splits a file by its edges, so that a hub's edges are read by many tasks; a task fetches its
offsets and targets in pieces.  Filters on the sorted end (src; with side=in, dst) are located by the offsets, and only the slices of
the vertices they leave are read.

A *folder* holds the same lists as range files: each writing task streams its sorted rows to files of its own
(offsets of its range, targets, weights), and commit writes the manifest, which names them with their ranges; in-lists lie in a
folder ``in`` inside.  No edge passes the driver.  Into a *file* writing tasks check ids, targets and weights against the vertex count and the
width, and leave sorted runs beside the target; commit merges them as a stream into a new file, which takes the target's
place when it is whole.  Of runs that don't overlap (``write_csr`` makes such) one is open at a time, so merging is
copying.  A file that exists is replaced in mode overwrite and left alone, with an error, in mode append.

Executors get this module's code with each task; the package needn't be installed there.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("csr", "mix", "csr_weighted")
#: Bytes of targets in one slice of a file; edges handled at once; offsets read at once; rows of a run that a writing task sorts at once.
SLICE_BYTES, EDGES_AT_ONCE, OFFSETS_AT_ONCE, RUN_ROWS = 64 << 20, 1 << 18, 1 << 18, 1 << 21
#: Values of an IN filter that are located one by one; of more, the range from the least to the largest.
MOST_VALUES = 1_000
MANIFEST = "manifest.json"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _true(option: object) -> bool:
    return str(option).lower() == "true"


class Lists:
    """Adjacency lists of vertices ``first`` .. ``first + v - 1``: subclasses give ``offset``, ``target`` and ``weight`` sections."""

    first, v, e, weighted = 0, 0, 0, False

    def start(self, v: int) -> int:
        """Number of the first edge of vertex v (counted from ``first``)."""
        return int(self.offset(v, 1)[0]) if v < self.v else self.e

    def edges(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """owner, other end, w of edges number lo .. hi - 1, in pieces."""
        first, after = 0, self.v  # the last vertex whose list starts at or before edge lo
        while after - first > 1:
            middle = (first + after) // 2
            first, after = (middle, after) if self.start(middle) <= lo else (first, middle)
        v = first
        while lo < hi:
            starts = self.offset(v, min(OFFSETS_AT_ONCE, self.v - v))
            upto = min(hi, self.start(v + len(starts)))
            while lo < upto:
                end = min(upto, lo + EDGES_AT_ONCE)
                own = self.first + v + np.searchsorted(starts, np.arange(lo, end), side="right") - 1
                yield own, self.target(lo, end - lo), self.weight(lo, end - lo) if self.weighted else None
                lo = end
            v += len(starts)

    def ranges(self, vertices: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
        """Edge ranges of vertex ranges (both ends included), in order; all edges for None."""
        if vertices is None:
            return [(0, self.e)] if self.e else []
        out: list[tuple[int, int]] = []
        for a, b in vertices:
            a, b = max(a - self.first, 0), min(b - self.first + 1, self.v)
            if a < b and (lo := self.start(a)) < (hi := self.start(b)):
                if out and out[-1][1] == lo:
                    out[-1] = (out[-1][0], hi)
                else:
                    out.append((lo, hi))
        return out


def _numbers(file, at: int, count: int, width: int) -> np.ndarray:
    return np.frombuffer(file.read_at(count * width, at), f"<u{width}").astype(np.int64)


class CsrFile(Lists):
    """One file; raises ValueError if it is too short for its counts."""

    def __init__(self, path: str, kind: str = "csr", wide: bool = False, side: str = "out"):
        if kind not in KINDS:
            raise ValueError(f"unknown format {kind}")
        if side == "in" and kind != "mix":
            raise ValueError("only format mix holds in-edges")
        fs, at = _fs(path)
        self.file, self.n = fs.open_input_file(at), 8 if wide else 4
        size = self.file.size()
        if size < 2 * self.n:
            raise ValueError(f"{path} is too short")
        self.v, self.e = struct.unpack("<QQ" if wide else "<II", self.file.read_at(2 * self.n, 0))
        self.weighted = kind == "csr_weighted"
        need = self.n * (2 + (self.v + self.e) * (2 if kind == "mix" else 1)) + (4 * self.e if self.weighted else 0)
        if size < need:
            raise ValueError(f"{path} has {size} bytes; its counts need {need}")
        self.base = self.n * (2 + (self.v + self.e if side == "in" else 0))

    def offset(self, v: int, count: int) -> np.ndarray:
        return _numbers(self.file, self.base + v * self.n, count, self.n)

    def target(self, e: int, count: int) -> np.ndarray:
        return _numbers(self.file, self.base + (self.v + e) * self.n, count, self.n)

    def weight(self, e: int, count: int) -> np.ndarray:
        return _numbers(self.file, self.n * (2 + self.v + self.e) + 4 * e, count, 4)


class CsrPart(Lists):
    """One range of a folder; ``entry`` is its line in the manifest."""

    def __init__(self, folder: str, entry: dict, weighted: bool, wide: bool):
        self.folder, self.name, self.n, self.weighted = folder, entry["name"], 8 if wide else 4, weighted
        self.first, self.v, self.e = entry["first"], entry["last"] - entry["first"] + 1, entry["edges"]
        self.files: dict[str, object] = {}

    def _section(self, suffix: str, at: int, count: int, width: int) -> np.ndarray:
        if suffix not in self.files:
            fs, base = _fs(f"{self.folder}/{self.name}.{suffix}")
            self.files[suffix] = fs.open_input_file(base)
        return _numbers(self.files[suffix], at * width, count, width)

    def offset(self, v: int, count: int) -> np.ndarray:
        return self._section("off", v, count, self.n)

    def target(self, e: int, count: int) -> np.ndarray:
        return self._section("dst", e, count, self.n)

    def weight(self, e: int, count: int) -> np.ndarray:
        return self._section("w", e, count, 4)


def manifest(path: str) -> dict | None:
    """What the manifest of a folder says; None if ``path`` isn't such a folder."""
    fs, at = _fs(f"{path}/{MANIFEST}")
    if fs.get_file_info(at).type != pafs.FileType.File:
        return None
    with fs.open_input_file(at) as f:
        return json.loads(f.read())


def encode(src: np.ndarray, dst: np.ndarray, vertices: int, w: np.ndarray | None = None, kind: str = "csr", wide: bool = False) -> bytes:
    """The bytes of a file; edges of a vertex keep their order."""
    t = "<u8" if wide else "<u4"
    order = np.argsort(src, kind="stable")
    count = lambda x: np.concatenate([[0], np.cumsum(np.bincount(x, minlength=vertices))])[:vertices].astype(t).tobytes()
    out = struct.pack("<QQ" if wide else "<II", vertices, len(src)) + count(src) + dst[order].astype(t).tobytes()
    if kind == "mix":
        back = np.argsort(dst, kind="stable")
        out += count(dst) + src[back].astype(t).tobytes()
    if kind == "csr_weighted":
        out += w[order].astype("<u4").tobytes()
    return out


class _Slice(InputPartition):
    """Edges lo .. hi - 1 of a file, or of a folder's part."""

    def __init__(self, lo: int, hi: int, part: dict | None = None):
        self.lo, self.hi, self.part = lo, hi, part


def vertex_ranges(filters: list[Filter], column: str) -> list[tuple[int, int]] | None:
    """Ranges of ids, both ends included, in order and apart, that filters on ``column`` leave; None where none of them says anything."""
    low, high, some, said = 0, (1 << 63) - 1, None, False
    for f in filters:
        if getattr(f, "attribute", None) != (column,):
            continue
        if isinstance(f, (EqualTo, In)):
            values = {v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
            some = values if some is None else some & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low = max(low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            high = min(high, f.value - isinstance(f, LessThan))
        else:
            continue
        said = True
    if not said:
        return None
    if some is None:
        return [(low, high)] if low <= high else []
    kept = sorted(v for v in some if low <= v <= high)
    return [(kept[0], kept[-1])] if len(kept) > MOST_VALUES else [(v, v) for v in kept]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.wide = options["path"], options.get("format", "csr"), _true(options.get("wide", "false"))
        self.side, self.slices, self.vertices = options.get("side", "out"), options.get("slices"), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters choose what is read; Spark applies them to the rows as well."""
        self.vertices = vertex_ranges(filters, "src" if self.side == "out" else "dst")
        yield from filters

    def _lists(self, part: dict | None) -> Lists:
        if part is None:
            return CsrFile(self.path, self.kind, self.wide, self.side)
        return CsrPart(self.path if self.side == "out" else f"{self.path}/in", part, self.kind == "csr_weighted", self.wide)

    def partitions(self) -> list[InputPartition]:
        whole = manifest(self.path if self.side == "out" else f"{self.path}/in")
        if whole is not None and (whole["format"] != self.kind or whole["wide"] != self.wide):
            raise ValueError(f"{self.path} holds format {whole['format']}, wide {whole['wide']}")
        lists = [None] if whole is None else whole["parts"]  # a part a writing task
        out: list[InputPartition] = []
        for part in lists:
            held = self._lists(part)
            for lo, hi in held.ranges(self.vertices):
                n = int(self.slices or max(8 if part is None and self.vertices is None else 1, -(-(hi - lo) * held.n // SLICE_BYTES)))
                cuts = sorted({lo + (hi - lo) * i // n for i in range(n + 1)})
                out += [_Slice(a, b, part) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out or [_Slice(0, 0)]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        if part.lo == part.hi:
            return
        for own, other, w in self._lists(part.part).edges(part.lo, part.hi):
            src, dst = (own, other) if self.side == "out" else (other, own)
            for i in range(0, len(src), 65_536):
                columns = {"src": src, "dst": dst} | ({} if w is None else {"w": w})
                yield pa.RecordBatch.from_pydict({k: pa.array(x[i : i + 65_536]) for k, x in columns.items()})


class Run:
    """Rows of a file, sorted by their first two columns, read block by block."""

    def __init__(self, path: str, rows: int, width: int, first: tuple[int, int], block: int = EDGES_AT_ONCE):
        self.path, self.rows, self.width, self.first, self.block = path, rows, width, first, block
        self.file, self.at, self.held = None, 0, np.zeros((0, width), np.int64)

    def fill(self) -> None:
        if not len(self.held) and self.at < self.rows:
            if self.file is None:
                fs, at = _fs(self.path)
                self.file = fs.open_input_file(at)
            n = min(self.block, self.rows - self.at)
            self.held = np.frombuffer(self.file.read_at(8 * n * self.width, 8 * self.at * self.width), np.int64).reshape(n, self.width)
            self.at += n
        if not len(self.held) and self.file is not None:
            self.file.close()
            self.file = None


def merged(runs: list[Run]) -> Iterator[np.ndarray]:
    """The rows of all runs in order, in blocks; only runs that overlap are open at once."""
    waiting, open_ = sorted(runs, key=lambda r: r.first, reverse=True), []
    while waiting or open_:
        for r in open_:
            r.fill()
        open_ = [r for r in open_ if len(r.held)]
        # rows up to the least last row in hand are known in full; a waiting run counts as soon as it could hold one of them
        bound = min((tuple(r.held[-1, :2].tolist()) for r in open_), default=None)
        if waiting and (bound is None or waiting[-1].first <= bound):
            open_.append(waiting.pop())
            continue
        if bound is None:
            return
        parts = []
        for r in open_:
            a, b = r.held[:, 0], r.held[:, 1]
            n = int(((a < bound[0]) | ((a == bound[0]) & (b <= bound[1]))).sum())
            parts.append(r.held[:n])
            r.held = r.held[n:]
        rows = np.concatenate(parts)
        yield rows if len(open_) == 1 else rows[np.lexsort((rows[:, 1], rows[:, 0]))]


class _Done(WriterCommitMessage):
    def __init__(self, out: list[tuple], back: list[tuple]):
        self.out, self.back = out, back


class _Checked(DataSourceArrowWriter):
    """Options, and batches as checked rows of numbers."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.wide = options["path"], options.get("format", "csr"), _true(options.get("wide", "false"))
        if self.kind not in KINDS:
            raise ValueError(f"unknown format {self.kind}")
        if "vertices" not in options:
            raise ValueError("option vertices tells how many vertices the graph has")
        self.vertices = int(options["vertices"])
        self.columns = ["src", "dst"] + (["w"] if self.kind == "csr_weighted" else [])
        # the highest bit of an id is kept free
        if not 0 <= self.vertices <= 1 << (63 if self.wide else 31):
            raise ValueError(f"{self.vertices} vertices don't fit the id width; use wide")
        fs, at = _fs(self.path)
        if not overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path} exists, and this format can't be appended to; use mode overwrite")

    def rows(self, batch: pa.RecordBatch) -> np.ndarray:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in self.columns]
        if any(c.null_count for c in columns):
            raise ValueError("an edge holds null")
        got = np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in columns], axis=1)
        if len(got) and (got[:, :2].min() < 0 or got[:, :2].max() >= self.vertices):
            raise ValueError(f"an edge has an end outside 0 .. {self.vertices - 1}")
        if len(got) and self.kind == "csr_weighted" and (got[:, 2].min() < 0 or got[:, 2].max() >= 1 << 32):
            raise ValueError("a weight doesn't fit in 32 bits")
        return got


class _FolderDone(WriterCommitMessage):
    def __init__(self, entry: dict | None):
        self.entry = entry


class _FolderWriter(_Checked):
    """Each task streams its sorted rows to a range of its own; commit writes the manifest."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> _FolderDone:
        fs, at = _fs(self.path)
        fs.create_dir(at, recursive=True)
        t, name = "<u8" if self.wide else "<u4", uuid.uuid4().hex
        files: dict[str, object] = {}
        v = first = last = None
        edges, before = 0, (-1, -1)
        try:
            for b in batches:
                rows = self.rows(b)
                if not len(rows):
                    continue
                src, dst = rows[:, 0], rows[:, 1]
                if (src[0], dst[0]) < before or ((src[1:] < src[:-1]) | ((src[1:] == src[:-1]) & (dst[1:] < dst[:-1]))).any():
                    raise ValueError("a folder's rows must come sorted by src and dst; write_csr_folder sorts them")
                before = (int(src[-1]), int(dst[-1]))
                if not files:
                    v = first = int(src[0])
                    files = {s: fs.open_output_stream(f"{at}/{name}.{s}") for s in ("off", "dst", *(["w"] if self.kind == "csr_weighted" else []))}
                last = int(src[-1])
                while v <= last:  # as in a file: offsets of all vertices up to the batch's last
                    upto = min(last + 1, v + OFFSETS_AT_ONCE)
                    files["off"].write((edges + np.searchsorted(src, np.arange(v, upto))).astype(t).tobytes())
                    v = upto
                files["dst"].write(dst.astype(t).tobytes())
                if "w" in files:
                    files["w"].write(rows[:, 2].astype("<u4").tobytes())
                edges += len(rows)
        finally:
            for f in files.values():
                f.close()
        return _FolderDone({"name": name, "first": first, "last": last, "edges": edges} if files else None)

    def commit(self, messages: list[_FolderDone]) -> None:
        fs, at = _fs(self.path)
        fs.create_dir(at, recursive=True)
        parts = sorted((m.entry for m in messages if m is not None and m.entry), key=lambda p: (p["first"], p["last"]))
        named = {p["name"] for p in parts}
        new = f"{at}/{uuid.uuid4().hex}.new"
        with fs.open_output_stream(new) as f:
            f.write(json.dumps({"format": self.kind, "wide": self.wide, "vertices": self.vertices, "edges": sum(p["edges"] for p in parts), "parts": parts}).encode())
        if fs.get_file_info(f"{at}/{MANIFEST}").type == pafs.FileType.File:
            fs.delete_file(f"{at}/{MANIFEST}")
        fs.move(new, f"{at}/{MANIFEST}")
        # what an earlier write, or an attempt that didn't count, left
        for info in fs.get_file_info(pafs.FileSelector(at)):
            stem, _, suffix = info.base_name.partition(".")
            if suffix in ("off", "dst", "w") and stem not in named:
                fs.delete_file(info.path)

    def abort(self, messages: list[_FolderDone]) -> None:
        fs, at = _fs(self.path)
        for m in messages:
            if m is not None and m.entry:
                for s in ("off", "dst", *(["w"] if self.kind == "csr_weighted" else [])):
                    fs.delete_file(f"{at}/{m.entry['name']}.{s}")


class _Writer(_Checked):
    """Tasks leave checked, sorted runs beside the target; commit merges them into one file."""

    def _run(self, rows: np.ndarray, at: str, fs: pafs.FileSystem) -> tuple:
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        name = f"{at}.{uuid.uuid4().hex}.run"
        with fs.open_output_stream(name) as f:
            f.write(np.ascontiguousarray(rows).tobytes())
        return name, len(rows), rows.shape[1], tuple(rows[0, :2].tolist())

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Done:
        fs, at = _fs(self.path)
        fs.create_dir(os.path.dirname(at), recursive=True)  # of a folder that nothing was written to yet
        out, back, held = [], [], []

        def flush() -> None:
            got = np.concatenate(held) if held else np.zeros((0, len(self.columns)), np.int64)
            held.clear()
            if not len(got):
                return
            out.append(self._run(got, at, fs))
            if self.kind == "mix":
                back.append(self._run(got[:, 1::-1], at, fs))

        many = 0
        for whole in batches:
            for i in range(0, whole.num_rows, RUN_ROWS):
                held.append(self.rows(whole.slice(i, RUN_ROWS)))
                many += len(held[-1])
                if many >= RUN_ROWS:
                    flush()
                    many = 0
        flush()
        return _Done(out, back)

    def commit(self, messages: list[_Done]) -> None:
        fs, at = _fs(self.path)
        done = [m for m in messages if m is not None]
        out, back = [r for m in done for r in m.out], [r for m in done for r in m.back]
        edges, new = sum(r[1] for r in out), f"{at}.{uuid.uuid4().hex}.new"
        if edges >= 1 << (64 if self.wide else 32):
            raise ValueError(f"{edges} edges don't fit the offset width; use wide")
        t = "<u8" if self.wide else "<u4"
        fs.create_dir(os.path.dirname(at), recursive=True)
        with fs.open_output_stream(new) as f:
            f.write(struct.pack("<QQ" if self.wide else "<II", self.vertices, edges))
            for runs, sections in ((out, [1, *([2] if self.kind == "csr_weighted" else [])]), *([(back, [1])] if self.kind == "mix" else [])):
                self._offsets(f, runs, t)
                for k in sections:
                    for rows in merged([Run(*r) for r in runs]):
                        f.write(rows[:, k].astype("<u4" if k == 2 else t).tobytes())
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.File:
            fs.delete_file(at)
        fs.move(new, at)
        self._drop(done)

    def _offsets(self, f, runs: list[tuple], t: str) -> None:
        """For each vertex the number of edges of the vertices before it."""
        v = before = 0
        for rows in merged([Run(*r) for r in runs]):
            src, top = rows[:, 0], int(rows[-1, 0])
            while v <= top:  # vertices up to the block's last: all their predecessors' edges are in this block or before it
                upto = min(top + 1, v + OFFSETS_AT_ONCE)
                f.write((before + np.searchsorted(src, np.arange(v, upto))).astype(t).tobytes())
                v = upto
            before += len(rows)
        while v < self.vertices:
            upto = min(self.vertices, v + OFFSETS_AT_ONCE)
            f.write(np.full(upto - v, before, t).tobytes())
            v = upto

    def _drop(self, messages: list) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            for name, *_ in [*m.out, *m.back] if m is not None else []:
                fs.delete_file(name)

    def abort(self, messages: list[_Done]) -> None:
        self._drop(messages)


class CsrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "src bigint, dst bigint" + (", w bigint" if self.options.get("format") == "csr_weighted" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return (_FolderWriter if self.options.get("layout") == "folder" else _Writer)(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make format ``csr`` known, and let filters reach Python data sources."""
    spark.dataSource.register(CsrSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_csr(edges: DataFrame, path: str, vertices: int, kind: str = "csr", wide: bool = False) -> None:
    """Write ``edges`` to ``path``, which is replaced: ranges of sources are sorted by Spark's tasks, a hub's edges by many."""
    register(edges.sparkSession)
    placed = edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
    placed.write.format("csr").option("format", kind).option("vertices", vertices).option("wide", wide).mode("overwrite").save(path)


def write_csr_folder(edges: DataFrame, path: str, vertices: int, kind: str = "csr", wide: bool = False) -> None:
    """Write ``edges`` as a folder of range files, which is replaced; of format mix the in-lists too."""
    register(edges.sparkSession)
    sides = [("src", "dst", path)] + ([("dst", "src", f"{path}/in")] if kind == "mix" else [])
    for own, other, to in sides:
        rows = edges.selectExpr(f"{own} AS src", f"{other} AS dst", *(["w"] if kind == "csr_weighted" else []))
        placed = rows.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
        placed.write.format("csr").option("layout", "folder").option("format", kind).option("vertices", vertices).option("wide", wide).mode("overwrite").save(to)


def vertex_count(path: str, wide: bool = False) -> int:
    whole = manifest(path)
    return CsrFile(path, "csr", wide).v if whole is None else whole["vertices"]


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Text, a line ``src, dst`` for each edge."""
    from pyspark.sql import functions as F

    edges.select(F.concat_ws(", ", "src", "dst").alias("value")).write.text(path)


def write_top(df: DataFrame, value: str, path: str, n: int = 1000) -> None:
    """Text: the n largest values, largest first, with six decimals (integers as they are)."""
    from pyspark.sql import functions as F

    from ..functions.ordering import top_values

    text = F.format_string("%.6f", F.col(value)) if dict(df.dtypes)[value] in ("double", "float") else F.col(value).cast("string")
    top_values(df, value, n).select(text.alias("value")).coalesce(1).write.text(path)
