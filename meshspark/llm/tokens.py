"""Token-id output: raw id payloads in shard files with a minimal perfect hash index per shard.

Documents are range-partitioned by id, so that shards in order hold them in ascending order.  Each
task encodes its documents as they stream by and writes three files to the shared folder, named after
the shard and the task's attempt, so that a task that runs again never meets files of an earlier
attempt; the manifest names those of the attempt that counted:

``.bin``   8-byte header (magic ``TKID``, version, bytes an id), then the ids of all documents, little-endian;
``.idx``   the index: a minimal perfect hash of keys (id, occurrence) -> slot, and for each slot the
           key's 32-bit fingerprint, first id and number of ids;
``.keys``  the keys in document order, as an Arrow file.

The perfect hash keeps, level by level, a bit for every position that exactly one remaining key
hashes to; keys that collide go on to the next level; a key's slot is the rank of its bit.

Texts are encoded by the tokenizers library.  In a byte-level tokenizer a single space or line feed
before a character other than white space always starts a piece, so texts are cut there and the
encoding of each distinct piece is kept in a bounded cache; a full stop or comma after a letter is a
piece of its own; texts with other runs of white space, or the text of an added token, are encoded whole.

Defined edge cases: null is the empty text; every document ends with the end id, so empty ones
hold one id; repeated doc_ids are told apart by their occurrence; an empty table writes no shard.
"""

from __future__ import annotations

import io
import json
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..storage import shared_dir
from .common import worker_state

MAGIC, VERSION, GAMMA = b"TKID", 1, 1.5
#: Bytes, about, in each of the two generations that one Python worker's encoder keeps; what an entry weighs beside its text and ids;
#: longer pieces aren't kept.
CACHE_BYTES, ENTRY_BYTES, LONG_PIECE = 128 << 20, 150, 128
#: Text that goes to one shard, about; more shards than ``spark.sql.shuffle.partitions`` are made where that asks for it.
SHARD_BYTES = 128 << 20


def key_hash(doc_id, occurrence: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{doc_id}\x00{occurrence}")


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.concatenate([[0], np.cumsum(b, dtype=np.int64)]) for b in levels]
        self.base = np.cumsum([0, *[r[-1] for r in self.ranks]])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(8, int(GAMMA * len(left)))
            at = (_mix(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; keys that were not built in get any slot or -1, so compare fingerprints."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (_mix(keys[open_], level + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.base[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def pack_index(keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    mph = PerfectHash.build(keys)
    slot = mph(keys)
    out = io.BytesIO()
    table = [np.zeros(len(keys), t) for t in ("<u4", "<u8", "<u8")]
    for column, value in zip(table, (keys >> np.uint64(32), starts, lengths), strict=True):
        column[slot] = value
    head = json.dumps({"keys": len(keys), "levels": [len(b) for b in mph.levels]}).encode()
    out.write(struct.pack("<I", len(head)) + head)
    for b in mph.levels:
        out.write(np.packbits(b).tobytes())
    for column in table:
        out.write(column.tobytes())
    return out.getvalue()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Shard:
    """Keyed access to one shard: hash, compare the fingerprint, read the ids."""

    def __init__(self, base: str):
        fs, path = _open(base)
        with fs.open_input_file(path + ".idx") as f:
            raw = f.read()
        n = struct.unpack_from("<I", raw)[0]
        head, at, levels = json.loads(raw[4 : 4 + n]), 4 + n, []
        for size in head["levels"]:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        k = head["keys"]
        self.prints = np.frombuffer(raw, "<u4", k, at)
        self.starts, self.lengths = np.frombuffer(raw, "<u8", k, at + 4 * k), np.frombuffer(raw, "<u8", k, at + 12 * k)
        self.mph = PerfectHash(levels)
        self.data = fs.open_input_file(path + ".bin")
        magic, version, self.width = struct.unpack("<4sHH", self.data.read_at(8, 0))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{base} is not a token shard")
        self.keys_at = (fs, path + ".keys")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for those the shard doesn't hold."""
        slot = self.mph(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == (keys[ok] >> np.uint64(32)).astype(np.uint32)
        return np.where(ok, slot, -1)

    def ids(self, slot: int) -> np.ndarray:
        start, n = int(self.starts[slot]), int(self.lengths[slot])
        return np.frombuffer(self.data.read_at(n * self.width, 8 + start * self.width), f"<u{self.width}")

    def checksums(self, slots: np.ndarray, ahead: int = 1 << 22) -> Iterator[int]:
        """crc32 of the ids of each slot as 32-bit integers; neighbours in the file are read together, ``ahead`` ids at once."""
        lo, held = 0, np.zeros(0, "<u4")
        for s in slots:
            start, n = int(self.starts[s]), int(self.lengths[s])
            if start < lo or start + n > lo + len(held):
                lo = start
                held = np.frombuffer(self.data.read_at(max(n, ahead) * self.width, 8 + start * self.width), f"<u{self.width}").astype("<u4")
            yield zlib.crc32(held[start - lo : start - lo + n])

    def get(self, doc_id, occurrence: int = 0) -> np.ndarray | None:
        slot = int(self.find(np.array([key_hash(doc_id, occurrence)], np.uint64))[0])
        return None if slot < 0 else self.ids(slot)

    def keys(self) -> Iterator[tuple[object, int]]:
        fs, path = self.keys_at
        with fs.open_input_file(path) as f:
            table = pa.ipc.open_file(f).read_all()
        yield from zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)


class Encoder:
    """Ids of whole texts as little-endian bytes, with a cache of pieces."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.width = 2 if self.tok.get_vocab_size(True) <= 1 << 16 else 4
        vocabulary = self.tok.get_vocab(True)
        #: Bytes of text by id: a byte-level vocabulary writes one character a byte.
        self.spans = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.spans[list(vocabulary.values())] = [len(v) for v in vocabulary]
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.marks: dict[str, bytes] = {}
        self.feed = self.whole("\n") if self.cut else b""

    def pack(self, ids: list[int]) -> bytes:
        a = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def learn(self, missing: set[str]) -> bool:
        """Put pieces into the cache; False if one isn't a piece of its own.

        A piece follows a space, which its ids include, or starts with the line feed that it follows.
        """
        cache, old, todo, ends = self.cache, self.old, [], []
        for m in missing:
            if m in old:
                cache[m] = old[m]
                continue
            head = m[1:2] if m[:1] == "\n" else m[:1]
            if not head or head.isspace():
                return False
            # a full stop or comma after a letter is a piece of its own
            if m[-1] in ".," and m[-2:-1].isalpha():
                ends.append(m)
                m = m[:-1]
                if m in cache:
                    continue
                if m in old:
                    cache[m] = old[m]
                    continue
            todo.append(m)
        if todo:
            # encoded as one text; the bytes that each id stands for tell where a piece ends
            parts = [m if m[0] == "\n" else " " + m for m in todo]
            joined = "".join(parts)
            if any(t in joined for t in self.added):
                return False
            ids = self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            want, have = np.cumsum([len(m.encode()) for m in parts]), np.cumsum(self.spans[ids])
            if not len(have) or have[-1] != want[-1]:
                return False
            last = np.searchsorted(have, want)
            if (have[last] != want).any():
                return False
            raw, at = self.pack(ids), 0
            for m, end in zip(todo, ((last + 1) * self.width).tolist(), strict=True):
                cache[m] = raw[at:end]
                at = end
        for m in ends:
            if m[-1] not in self.marks:
                self.marks[m[-1]] = self.whole(m[-1])
            cache[m] = cache[m[:-1]] + self.marks[m[-1]]
        return True

    def __call__(self, text: str) -> bytes:
        if not self.cut or any(t in text for t in self.added):
            return self.whole(text)
        pieces, skip = text.replace("\n", " \n").split(" "), 0
        if pieces[0]:
            # the first piece follows nothing: it is looked up after a line feed, whose ids are cut off again
            pieces[0] = "\n" + pieces[0]
            skip = len(self.feed)
        else:
            del pieces[0]
        missing = set(pieces).difference(self.cache)
        if missing:
            if self.held > CACHE_BYTES:
                self.old, self.cache, self.held = self.cache, {}, 0
                missing = set(pieces)
            if not self.learn(missing):
                return self.whole(text)
            self.held += ENTRY_BYTES * len(missing) + 3 * sum(map(len, missing))
            if max(map(len, missing)) > LONG_PIECE:
                out = b"".join(map(self.cache.__getitem__, pieces))[skip:]
                for m in missing:
                    if len(m) > LONG_PIECE:
                        del self.cache[m]
                        self.held -= ENTRY_BYTES + 3 * len(m)
                return out
        return b"".join(map(self.cache.__getitem__, pieces))[skip:]


def encoder(definition: str) -> Encoder:
    """The worker's encoder for this tokenizer, with what its cache holds from earlier tasks."""
    state, key = worker_state(), f"encoder-{xxhash.xxh3_64_hexdigest(definition)}"
    if key not in state:
        state[key] = Encoder(definition)
    return state[key]


def write_shards(docs: DataFrame, definition: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode and write all ``docs`` (doc_id, text); one manifest row a shard: shard, path, n_docs, n_tokens, first, last.

    ``first`` and ``last`` are the shard's smallest and largest doc_id (null sorts first), so that ``find`` opens the
    shards that can hold a key, and no other.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/meshspark/tokens-{uuid.uuid4().hex}"
    shipped = spark.sparkContext.broadcast(definition)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        name = f"{folder}/{shard:06d}-{task.taskAttemptId()}"
        fs, path = _open(name)
        code = out = None
        keys, order, lengths, occurrence = [], [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    code = encoder(shipped.value)
                    tail = code.pack([end_id])
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path + ".bin")
                    out.write(struct.pack("<4sHH", MAGIC, VERSION, code.width))
                occurrence = occurrence + 1 if order and order[-1][0] == doc_id else 0
                ids = code(text or "") + tail
                out.write(ids)
                keys.append(key_hash(doc_id, occurrence))
                order.append((doc_id, occurrence))
                lengths.append(len(ids) // code.width)
        if out is None:
            return
        out.close()
        n = np.array(lengths, np.uint64)
        index = pack_index(np.array(keys, np.uint64), np.cumsum(n) - n, n)
        table = pa.table([pa.array([k for k, _ in order], kind), pa.array([o for _, o in order], pa.int64())], names=["doc_id", "occurrence"])
        with fs.open_output_stream(path + ".idx") as f:
            f.write(index)
        with fs.open_output_stream(path + ".keys") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([name]), pa.array([len(keys)]), pa.array([int(n.sum())]), pa.array([order[0][0]], kind), pa.array([order[-1][0]], kind)],
            names=["shard", "path", "n_docs", "n_tokens", "first", "last"],
        )

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    by_id = F.col("doc_id").asc_nulls_first()
    rows = docs.select("doc_id", "text").repartitionByRange(shards, by_id).sortWithinPartitions(by_id, F.xxhash64("text"))
    schema = f"shard long, path string, n_docs long, n_tokens long, first {docs.schema['doc_id'].dataType.simpleString()}, last {docs.schema['doc_id'].dataType.simpleString()}"
    made = rows.mapInArrow(run, schema).collect()  # a row a shard
    return spark.createDataFrame(sorted(made, key=lambda r: r["shard"]), schema)


def find(manifest: DataFrame, doc_id, occurrence: int = 0) -> np.ndarray | None:
    """The ids of a document by its key, None if there is none: from the shards whose range holds it (one, as a rule)."""
    at = F.lit(doc_id).cast(manifest.schema["first"].dataType)
    inside = (F.col("first").isNull() if doc_id is None else (F.col("first").isNull() | (F.col("first") <= at)) & (F.col("last") >= at))
    for r in manifest.where(inside).orderBy("shard").collect():
        if (got := Shard(r["path"]).get(doc_id, occurrence)) is not None:
            return got
    return None


def read_shards(manifest: DataFrame, doc_id: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each looked up by its key in the files of the manifest."""
    rows = sorted(tuple(r) for r in manifest.select("shard", "path", "n_tokens").collect())
    before, todo = 0, []
    for _, path, n in rows:
        todo.append((path, before))
        before += n
    spark = manifest.sparkSession
    if not todo:
        return spark.createDataFrame([], f"doc_id {doc_id}, start long, n_tokens long, ids_crc32 long")
    kind = to_arrow_type(DataType.fromDDL(doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                keys = list(shard.keys())
                slots = shard.find(np.array([key_hash(*k) for k in keys], np.uint64))
                if (slots < 0).any():
                    raise ValueError(f"{path}: a key is missing from its index")
                crc = shard.checksums(slots)
                for lo in range(0, len(keys), 10_000):
                    some = slots[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k for k, _ in keys[lo : lo + 10_000]], kind), pa.array(shard.starts[some].astype(np.int64) + base),
                            pa.array(shard.lengths[some].astype(np.int64)), pa.array(list(islice(crc, len(some))), pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = spark.createDataFrame(todo, "path string, base long").repartition(min(len(todo), 2048))
    return parts.mapInArrow(run, f"doc_id {doc_id}, start long, n_tokens long, ids_crc32 long")
