"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: each source's share of all words by weight, held to ``most`` times the source's own
size, the excess reshared by weight until no source is above.  The target total is cut into
``blocks`` equal blocks (of at least one word); quotients target / (2 j + 1) are ranked and the
highest win, which gives every source an integer quota.  Words
below one block are apportioned by the same method with blocks of one word, so that sources
smaller than a block get theirs, within about a word.

A quota larger than the source takes whole passes over it first.  The rest is chosen shard by shard: the
source's documents stand in seeded order, which is cut into as many stretches as there are shards; each shard
gets an integer quota of the rest's blocks, shares that differ by one block at most, and takes the first blocks of its
stretch (the last one also the words below a block).  Stretches are as long as their quotas are, so none is asked
for more than it has.  A source gives ``SHARDS`` shards their part, or one for each ``SHARD_DOCS`` of its documents if
that is less: a shard takes whole documents but for one, and rounding shares to whole copies moves
a source by half a document a shard at most.  Everything runs on DataFrame operations: one aggregation, a window
over sources, and a distributed running sum of words within each source.

Defined edge cases: null and blank texts have size 0 and are taken 0 words; the null source is
a source of its own, last in order; sources of size 0 have target 0; repeated rows with one
doc_id are separate documents with equal figures or next to each other in the order; an empty
table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, materialize, n_space_words, running, same

# Weights by position of the source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Shards that a source's blocks are chosen in, at most, and documents of a source for each of them, at least.
SHARDS, SHARD_DOCS = 16, 64


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source_size, weight, target for each row of (source, source_size); one row a source."""
    everything = Window.partitionBy(F.lit(0))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_at", (F.row_number().over(by_name) - 1) % len(WEIGHTS)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_at") + 1).cast("int"))
    )
    # In order of size / weight the sources that are held at `most` sizes come first: source k is held if its
    # share of what is left after those before it would be above its bound.
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    cap = most * F.col("source_size").cast("double")
    lined = weighed.withColumns({
        "_all": F.sum("source_size").over(everything).cast("double"),
        "_w": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "_held": most * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double"),
    }).withColumn("_level", (F.col("_all") - F.col("_held")) / F.col("_w"))
    free = cap > F.col("_level") * F.col("weight")
    level = F.min(F.when(free, F.struct(F.col("source_size") / F.col("weight"), F.col("_level"))).otherwise(None)).over(everything)
    return lined.withColumn("_l", level).select("source", "source_size", "weight", F.when(F.col("_l").isNull(), cap).otherwise(F.least(cap, F.col("_l")["_level"] * F.col("weight"))).alias("target"))


def _apportioned(weighed: DataFrame, blocks: int | None) -> DataFrame:
    """source, source_size, target, block, quota: ``blocks`` blocks (None: one a word) to the highest quotients.

    With n sources and q = target / block the divisor method gives a source between
    q (1 - n / 2N) - 1 and q (1 + n / 2N) + 1 of N blocks, so only that margin of quotients is ranked.
    """
    everything = Window.partitionBy(F.lit(0))
    s = weighed.withColumns({"_t": F.sum("target").over(everything), "_n": F.count(F.lit(1)).over(everything)})
    if blocks is None:
        s = s.withColumn("block", F.lit(1).cast("long"))
    else:
        s = s.withColumn("_N", F.least(F.lit(float(blocks)), F.greatest(F.lit(1.0), F.floor("_t")))).withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("_t") / F.col("_N"))).cast("long"))
    s = s.withColumn("_N", F.round(F.col("_t") / F.col("block")).cast("long")).withColumn("_q", F.col("target") / F.col("block"))
    slack = F.ceil(F.col("_q") * F.col("_n") / (2 * F.greatest(F.col("_N"), F.lit(1)))) + 1
    s = s.withColumns({"_sure": F.greatest(F.lit(0), F.floor("_q") - slack).cast("long"), "_most": (F.ceil("_q") + slack).cast("long")})
    s = s.withColumn("_open", F.col("_N") - F.sum("_sure").over(everything))
    tries = s.withColumn("_j", F.explode(F.sequence(F.col("_sure"), F.col("_most"))))
    highest = Window.orderBy((F.col("target") / (2 * F.col("_j") + 1)).desc(), F.col("source").asc_nulls_last(), F.col("_j"))
    ranked = tries.withColumn("_place", F.row_number().over(highest))
    return ranked.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("block").alias("block"),
        (F.first("_sure") + F.sum((F.col("_place") <= F.col("_open")).cast("long"))).alias("quota"),
    )


def quotas(weighed: DataFrame, blocks: int, most: int = MOST) -> DataFrame:
    """source, source_size, target, ``block`` (words a block), ``quota`` (blocks the source wins) and ``words``.

    ``words`` are exact below a block: the won blocks that fit in the target, and of the words
    left over a share by the same method with blocks of one word.  So small sources, and more
    sources than blocks, come within about a word of their targets.
    """
    won = _apportioned(weighed, blocks)
    whole = won.withColumn("_whole", F.least(F.col("quota"), F.floor(F.col("target") / F.col("block"))).cast("long") * F.col("block"))
    rest = _apportioned(whole.select("source", "source_size", (F.col("target") - F.col("_whole")).alias("target")), None)
    both = whole.join(rest.select(F.col("source").alias("_s"), F.col("quota").alias("_more")), same(F.col("source"), F.col("_s")))
    words = F.when(F.col("target") > 0, F.least(F.col("_whole") + F.col("_more"), most * F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return both.select("source", "source_size", "target", "block", "quota", words.alias("words"))


def shares(quota: Column, shards: Column) -> Column:
    """Array: the blocks of a quota that each shard and those before it take; single shares differ by one block at most."""
    return F.transform(F.sequence(F.lit(1), shards.cast("int")), lambda h: F.floor(h * quota / shards))


def shard_quotas(won: DataFrame, shards: int) -> DataFrame:
    """Integer quotas for each source and shard: consecutive shares that differ by one block at most."""
    up = won.select("source", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), shares(F.col("quota"), F.lit(shards)))).alias("shard", "_up"), "quota")
    up = up.where(F.col("shard") < shards)
    return up.select("source", "shard", (F.floor((F.col("shard") + 1) * F.col("quota") / shards) - F.col("_up")).alias("quota"))


def seeded(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _chosen(won: DataFrame, shards: int) -> DataFrame:
    """_s, _full (passes), _from and _to: arrays of the stretches, by word of the seeded order, that the last pass takes."""
    s = won.where("words > 0").withColumns({"_full": F.floor(F.col("words") / F.col("source_size")), "_rest": F.col("words") % F.col("source_size")})
    s = s.withColumn("_whole", F.floor(F.col("_rest") / F.col("block")))
    n = F.greatest(F.lit(1), F.least(F.lit(shards), F.floor(F.col("docs") / SHARD_DOCS), F.col("_whole")))
    s = s.withColumn("_n", n).withColumn("_ends", shares(F.col("_whole"), F.col("_n")))
    # words that shards up to each take; the last one takes what is below a block too
    s = s.withColumn("_up", F.transform("_ends", lambda e, i: F.when(i == F.size("_ends") - 1, F.col("_rest")).otherwise(e * F.col("block"))))
    # in whole numbers: word u of the rest stands at u * size / rest of the source, rounded down
    at = F.expr("transform(_up, (u, i) -> CASE WHEN i = 0 THEN 0L ELSE (CAST(_up[i - 1] AS DECIMAL(19, 0)) * CAST(source_size AS DECIMAL(18, 0))) div _rest END)")
    took = F.transform("_up", lambda u, i: u - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at("_up", F.greatest(i, F.lit(1)).cast("int"))))
    s = s.withColumns({"_from": at, "_took": took})
    return s.select(F.col("source").alias("_s"), "_full", "_from", F.zip_with("_from", "_took", lambda a, t: a + t).alias("_to"))


def _taken(docs: DataFrame, blocks: int, seed: int, shards: int) -> DataFrame:
    """doc_id, _key, source, size, source_size, target, taken for every row of ``docs``."""
    rows = materialize(docs.select("doc_id", digest().alias("_key"), "source", n_space_words(F.col("text")).alias("size")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sizes = materialize(sizes, "mix-sizes")
    won = quotas(targets(sizes.drop("docs")), blocks)
    won = materialize(won.join(sizes.select(F.col("source").alias("_ds"), "docs"), same(F.col("source"), F.col("_ds"))).drop("_ds"), "mix-quotas")
    order = [F.col("_h").asc(), F.col("doc_id").asc_nulls_first(), F.col("_key").asc()]
    placed = running(rows.withColumn("_h", seeded(seed, F.col("doc_id"))), ["source"], order, F.col("size"), "mix-order")
    # One row a source, with two numbers a shard: bounded by the sources.
    facts = won.join(_chosen(won, shards), same(F.col("source"), F.col("_s")), "left").select(
        F.col("source").alias("_s0"), F.col("source_size").alias("_size0"), F.col("target").alias("_target0"), "_full", "_from", "_to"
    )
    joined = placed.join(facts, same(F.col("source"), F.col("_s0")), "left")
    part = lambda a, b: F.greatest(F.lit(0).cast("long"), F.least(F.col("_before") + F.col("size"), b) - F.greatest(F.col("_before"), a))
    last = F.aggregate(F.zip_with("_from", "_to", part), F.lit(0).cast("long"), lambda x, y: x + y)
    taken = F.when(F.col("size") > 0, F.coalesce(F.col("_full") * F.col("size") + last, F.lit(0))).otherwise(F.lit(0))
    return joined.select("doc_id", "_key", "source", "size", F.col("_size0").alias("source_size"), F.col("_target0").alias("target"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, blocks: int = 10_000, seed: int = 0, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, source, text)."""
    return _taken(docs, blocks, seed, shards).drop("source", "_key")


def mixed(docs: DataFrame, blocks: int = 10_000, seed: int = 0, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as the mix takes it, to the nearest whole time.

    Rows that are equal in id, source and text share what they are taken as evenly as whole times allow.
    """
    spare = "_copy"
    while spare in (c.lower() for c in docs.columns):
        spare += "_"
    key = [F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_key").alias("_k")]
    times = _taken(docs, blocks, seed, shards).groupBy(*key).agg(
        F.sum(F.when(F.col("taken") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)).cast("long").alias("_all"), F.count(F.lit(1)).alias("_rows")
    )
    times = materialize(times.where("_all > 0").select("_d", "_s", "_k", F.floor(F.col("_all") / F.col("_rows")).alias("_each"), (F.col("_all") % F.col("_rows")).alias("_more")), "mix-times")

    def copies(rows: DataFrame, t: DataFrame, n: str) -> DataFrame:
        on = rows["doc_id"].eqNullSafe(t["_d"]) & rows["source"].eqNullSafe(t["_s"]) & (digest(rows["text"]) == t["_k"])
        return rows.join(t, on).select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), t[n])).alias(spare)).drop(spare)

    out = copies(docs, times.where("_each > 0"), "_each")
    # Equal rows that the end of a stretch divides, two groups a stretch at most: one of them stands for the copies left over.
    split = times.where("_more > 0")
    if split.isEmpty():
        return out
    found = docs.join(F.broadcast(split), docs["doc_id"].eqNullSafe(split["_d"]) & docs["source"].eqNullSafe(split["_s"]) & (digest(docs["text"]) == split["_k"]), "left_semi")
    one = materialize(found.groupBy("doc_id", "source", "text").agg(F.first(F.struct(*[found[c] for c in docs.columns])).alias("_row")).select("_row.*"), "mix-split")
    return out.union(copies(one, split, "_more"))
