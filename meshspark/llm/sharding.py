"""Sharding by longest-processing-time scheduling: equal texts stay together and shard sizes come out near equal.

Groups of equal texts are sorted by size, the largest first, and each goes to the least loaded
shard, which a heap yields.  Running the heap over single groups would pull all of them to one
place, so it runs over *size classes*: groups of up to ``FINE`` bytes are classed by their exact
size, larger ones by size to one part in ``FINE``; there are at most FINE * (2 + log2(total / FINE))
classes, whatever the input.  The heap hands each class's groups out one by one (whole rounds of
a long class at once), and every group then finds its shard from its rank within the class.

Defined edge cases: null texts count as empty (size 16, crc 0); a group larger than a fair
share fills its shard alone, as groups aren't cut; ties go by digest, slots by doc_id; repeated
rows are members of one group and get a slot each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, materialize, meet, running

FINE = 1024


def size_class(size: Column) -> Column:
    """The size itself up to FINE, above it rounded down to a multiple of 2**k that keeps log2(FINE) bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(size.cast("double"))) - 10)).cast("long")
    return (F.floor(size / step) * step).cast("long")


def schedule(classes: list[tuple[int, int, int]], shards: int) -> dict[int, tuple[list[int], list[int]]]:
    """LPT over ``(class, groups, bytes)``: per class the shards in the order of first use and cumulative group counts."""
    heap = [(0.0, s) for s in range(shards)]
    out = {}
    for cls, groups, total in sorted(classes, reverse=True):
        each, took = total / groups, {}
        left = groups
        if left > 8 * shards:
            # while the loads are level to within one group, each round of the heap serves every shard once:
            # raise all to the common level that keeps 4 groups a shard for the heap itself
            spare, loads = left - 4 * shards, sorted(heap)
            level, low = (sum(x for x, _ in loads) + spare * each) / shards, len(loads)
            while loads[low - 1][0] > level:
                low -= 1
                level = (sum(x for x, _ in loads[:low]) + spare * each) / low
            for x, s in loads[:low]:
                took[s] = min(int((level - x) / each), left)
                left -= took[s]
            heap = [(x + took.get(s, 0) * each, s) for x, s in loads]
            heapq.heapify(heap)
        for _ in range(left):
            x, s = heapq.heappop(heap)
            took[s] = took.get(s, 0) + 1
            heapq.heappush(heap, (x + each, s))
        order = [s for s in sorted(took) if took[s]]
        ends, at = [], 0
        for s in order:
            ends.append(at := at + took[s])
        out[cls] = (order, ends)
    return out


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = materialize(
        docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), digest().alias("_text")), "shard-rows"
    )
    groups = rows.groupBy("_text").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_many")).withColumn("_cls", size_class(F.col("_bytes")))
    ranked = materialize(running(groups, ["_cls"], [F.col("_text").asc()], F.col("_bytes"), "shard-groups").drop("_before"), "shard-ranked")
    classes = ranked.groupBy("_cls").agg(F.count(F.lit(1)), F.sum("_bytes")).collect()  # bounded: see above
    plan = [(c, order, ends) for c, (order, ends) in schedule([tuple(r) for r in classes], shards).items()]
    table = spark.createDataFrame(plan, "_c long, _order array<int>, _ends array<long>")
    # As many rows as classes, with two numbers a shard at most, whatever the input: at 40 shards under 8 MB for texts up to 16 MB.
    placed = ranked.join(F.broadcast(table), F.col("_cls") == F.col("_c")).select(
        F.col("_text").alias("_t"), F.element_at("_order", (F.size(F.filter("_ends", lambda x: x <= F.col("_rank"))) + 1).cast("int")).alias("shard"), "_many"
    )
    out = meet(rows, materialize(placed, "shard-places"), "_text", "_t", "_many").select("doc_id", "size", "text_crc32", "shard")
    slots = running(out, ["shard"], [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()], F.lit(0), "shard-slots")
    return slots.select("doc_id", "size", "text_crc32", "shard", F.col("_rank").alias("slot"))
