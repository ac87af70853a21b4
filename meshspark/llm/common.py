"""Helpers shared by the operators: durable intermediates, joins on heavy keys, word classes."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import running as running
from ..storage import cut

#: Word classes of the result contracts, as Java/RE2 patterns for what stands *between* words.
BETWEEN_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it back.

    Cuts lineage like ``checkpoint()`` but keeps the columnar layout, and survives lost executors.
    """
    return cut(df, name)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker: later tasks find what earlier ones put in."""
    name = "_meshspark_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that only that many texts are Python strings at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves remainder 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(text: str | Column = "text") -> Column:
    """16 bytes that stand for a whole text, the empty one for null: with the id they tell rows apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


#: Key tables of at most this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def few(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """``df``, which is materialized, to be broadcast if its rows fit in BROADCAST_BYTES: whole texts then stay where they are."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df


#: A key is heavy if it has more than a quarter of a partition's fair share of the rows; so at most 4 a partition are.
HEAVY = 4


def meet(rows: DataFrame, facts: DataFrame, key: str, fact_key: str, many: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined to the one row of ``facts`` for their key; ``many`` tells how many rows share it.

    Heavy keys are few, so their facts are broadcast to rows that stay where they are; the other rows
    are shuffled, and no task gathers a heavy key.  Both tables are read more than once: materialize them.
    """
    most = HEAVY * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.col(many) * most > (rows.count() if total is None else total)  # at most `most` keys
    hot, on = facts.where(heavy), F.col(key) == F.col(fact_key)
    light = rows.join(F.broadcast(hot.select(fact_key)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).union(light.join(facts.where(~heavy), on, how))


def n_space_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t..\\r; null counts none."""
    t = F.coalesce(text, F.lit(""))
    blank = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
    edge = F.substring(t, 1, 1).isin(blank).cast("int") + F.substring(t, -1, 1).isin(blank).cast("int")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, BETWEEN_SPACE, -1)) - edge).cast("long")
