"""Prefix trie of conversations: mergeable partial tries, then a bottom-up rollup.

*Partial tries.*  Every conversation adds one member to the node of each of its prefixes.  A node's key is 128 bits made from the
sum, over the prefix, of hashes of (place, role, text): sums run along a conversation like any
running sum, so that one of any length spreads over many tasks.  Each task first combines what it has of each node (one row with members,
smallest member, smallest one that ends there); rows of one node then meet in ``MERGES`` rounds of hash-keyed merges, each of which brings
together 1 in ``FAN`` of the tables that are left, so a prefix that a third of all conversations share is never gathered as rows.
End lists merge likewise: range by range of ids, in sorted pieces of at most ``PIECE`` ids.

*Rollup.*  A node's smallest member is also that of its child on that member's way, down to where it ends.  So nodes fall into
one chain for each conversation that owns any, and chains hang on nodes of other chains.  Totals of whole chains are summed
over the tree of chains by doubling: after round i a chain has the sum over chains up to 2**i below it, so rounds grow with the logarithm
of how deep chains hang on each other, not with turns.  Then one running sum up each chain, with what hangs on its nodes, gives every subtree.

``rebuilt`` is the query's own step before: conversations that share beginnings with another one.

Defined edge cases: turns go by ``turn`` (null first), then role, then the text's MD5; null role or text is the empty
string; repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out; conversations may be
without turns, and end at the root then; an empty table gives no nodes, and so no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import release
from .common import materialize, meet, running

#: Merge rounds before the last, how many tables meet in each, and ids in a piece of an end list.
MERGES, FAN, PIECE = 2, 16, 256
#: Fixed values of the rebuilding: conversations in a family, remainders of the hash.
FAMILY, SHARED = 5, 9
LANES = ("_a", "_b", "_c", "_d")


def sums_before(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column], name: str) -> DataFrame:
    """Add ``_rank`` (0-based) and for each of ``totals`` its sum over earlier rows per ``keys``; like ``running``, for several sums at once."""
    kept = df.columns
    by = [F.col(k).asc() for k in keys] + order
    own = {f"_t{i}": t for i, t in enumerate(totals.values())}
    placed = materialize(df.withColumns(own).repartitionByRange(*by).withColumn("_pid", F.spark_partition_id()), name)
    inner = Window.partitionBy("_pid", *keys).orderBy(*order)
    rows = placed.withColumns({"_rank": F.row_number().over(inner).cast("long") - 1} | {n: F.sum(t).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(t) for n, t in zip(totals, own, strict=True)})
    parts = placed.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(t).alias(t) for t in own])
    outer = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition and key
    shift = parts.select(
        F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_dn"),
        *[F.coalesce(F.sum(t).over(outer), F.lit(0)).alias(f"_d{t}") for t in own],
    )
    on = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    return rows.join(shift, on).select(*kept, (F.col("_rank") + F.col("_dn")).alias("_rank"), *[(F.col(n) + F.col(f"_d{t}")).alias(n) for n, t in zip(totals, own, strict=True)])


def ranked(conversations: DataFrame) -> DataFrame:
    """conv_id, rank (from 0), _x and _y (128 bits for role and text) and bytes of the text, for every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text.cast("binary")).alias("_tie"),
        F.xxhash64(role, text).alias("_x"), F.xxhash64(F.lit(1), text, role).alias("_y"), F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = running(t, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("_tie").asc()], F.lit(0), "trie-turns")
    return placed.select("conv_id", F.col("_rank").alias("rank"), "_x", "_y", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of every conv_id c: the first h turns of conversation c - c % FAMILY, then c's own after its first h; h is crc32(c) % SHARED.

    Turns are (conv_id, rank, _x, _y, bytes), conversations (conv_id, n_turns).
    """
    turns = materialize(turns, "trie-ranked")
    n = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own")), "trie-own")
    c = n.select("conv_id", "_own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("_base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("_h"))
    base = n.select(F.col("conv_id").alias("_b"), F.col("_own").alias("_there"))
    # a base has few conversations of its family, so neither join gathers many rows of a key
    c = c.join(base, F.col("_base") == F.col("_b"), "left").withColumn("_from", F.least("_h", F.coalesce("_there", F.lit(0)))).drop("_b", "_there")
    c = materialize(c, "trie-family")
    first = turns.where(F.col("rank") < SHARED - 1).select(F.col("conv_id").alias("_b"), "rank", "_x", "_y", "bytes")
    lent = c.join(first, (F.col("_base") == F.col("_b")) & (F.col("rank") < F.col("_h"))).select("conv_id", "rank", "_x", "_y", "bytes")
    facts = c.select(F.col("conv_id").alias("_v"), "_own", "_h", "_from")
    own = meet(turns, facts, "conv_id", "_v", "_own").where(F.col("rank") >= F.col("_h"))
    own = own.select("conv_id", (F.col("rank") - F.col("_h") + F.col("_from")).alias("rank"), "_x", "_y", "bytes")
    return lent.union(own), c.select("conv_id", (F.col("_from") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).alias("n_turns"))


def _key(lanes: list[Column], depth: Column) -> list[Column]:
    return [F.xxhash64(*lanes, depth), F.xxhash64(F.lit(1), *lanes, depth)]


def partial(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conversation and prefix: node key (k1, k2), the parent's (p1, p2), depth, bytes, conv_id, end (whether the conversation ends there)."""
    x, y = F.xxhash64("rank", "_x", "_y"), F.xxhash64(F.lit(1), "rank", "_y", "_x")
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    lanes = dict(zip(LANES, (low(x), low(F.shiftrightunsigned(x, 32)), low(y), low(F.shiftrightunsigned(y, 32))), strict=True))
    t = sums_before(turns.select("conv_id", "rank", "bytes", "_x", "_y"), ["conv_id"], [F.col("rank").asc()], lanes, "trie-sums")
    before = [F.col(c) for c in LANES]
    after = [F.col(c) + v for c, v in lanes.items()]
    (k1, k2), (p1, p2) = _key(after, F.col("rank") + 1), _key(before, F.col("rank"))
    t = t.select(k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), (F.col("rank") + 1).alias("depth"), "bytes", "conv_id")
    zero = [F.lit(0).cast("long")] * 4
    r1, r2 = _key(zero, F.lit(0).cast("long"))
    none = F.lit(None).cast("long")
    root = conversations.select(r1.alias("k1"), r2.alias("k2"), none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "conv_id")
    n = conversations.select(F.col("conv_id").alias("_v"), "n_turns")
    # n_turns also tells which conversations have most rows
    return meet(materialize(t.union(root), "trie-members"), materialize(n.withColumn("_many", F.col("n_turns") + 1), "trie-lengths"), "conv_id", "_v", "_many").select(
        "k1", "k2", "p1", "p2", "depth", "bytes", "conv_id", (F.col("depth") == F.col("n_turns")).alias("end")
    )


def merged(members: DataFrame) -> DataFrame:
    """One row a node: k1, k2, p1, p2, depth, bytes, conv_id (smallest member), n_convs, and whether its smallest member ends there (last)."""
    own = F.xxhash64(F.col("conv_id"))
    t = members.select("k1", "k2", "p1", "p2", "depth", "bytes", "conv_id", F.lit(1).cast("long").alias("n_convs"), F.when(F.col("end"), F.col("conv_id")).alias("_ends"), F.pmod(own, F.lit(FAN**MERGES)).alias("_table"))
    key = ["k1", "k2"]
    for _ in range(MERGES + 1):
        # by node and table: each task combines its rows before they are sent
        t = t.groupBy(*key, "_table").agg(*[F.max(c).alias(c) for c in ("p1", "p2", "depth", "bytes")], F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("_ends").alias("_ends"))
        t = t.withColumn("_table", F.floor(F.col("_table") / FAN))
    return t.select(*key, "p1", "p2", "depth", "bytes", "conv_id", "n_convs", F.coalesce(F.col("_ends") == F.col("conv_id"), F.lit(False)).alias("last"))


def end_digests(members: DataFrame) -> DataFrame:
    """_e1, _e2, ends_sha256: digest of the ids that end at each node where any does, comma-joined in ascending order.

    Ids merge to sorted pieces.  A node of one piece is hashed where it is; of the others one task reads
    the pieces in order, one after another (SHA-256 can't be split), and never holds more than a batch of them.
    """
    ends = members.where("end").select("k1", "k2", "conv_id")
    placed = running(ends, ["k1", "k2"], [F.col("conv_id").asc()], F.lit(0), "trie-ends")
    pieces = placed.groupBy("k1", "k2", F.floor(F.col("_rank") / PIECE).alias("_piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("_ids"))
    pieces = materialize(pieces, "trie-pieces")
    many = pieces.where("_piece > 0").select(F.col("k1").alias("_m1"), F.col("k2").alias("_m2")).distinct()
    on = (F.col("k1") == F.col("_m1")) & (F.col("k2") == F.col("_m2"))
    few = pieces.where("_piece = 0").join(many, on, "left_anti").select(F.col("k1").alias("_e1"), F.col("k2").alias("_e2"), F.sha2("_ids", 256).alias("ends_sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        out: list[tuple[int, int, str]] = []
        for b in batches:
            for k1, k2, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if at != (k1, k2):
                    out += [(*at, digest.hexdigest())] if at else []
                    at, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([{"_e1": a, "_e2": c, "ends_sha256": h} for a, c, h in out])
                out = []
        if at:
            yield pa.RecordBatch.from_pylist([{"_e1": at[0], "_e2": at[1], "ends_sha256": digest.hexdigest()}])

    lists = pieces.join(many, on, "left_semi").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "_piece").select("k1", "k2", "_ids")
    return few.union(lists.mapInArrow(hashed, "_e1 long, _e2 long, ends_sha256 string"))


def _chain_totals(chains: DataFrame) -> DataFrame:
    """_v, leaves, saved of each chain (conv_id, up, leaves, saved): its own and those of all chains that hang on it, on any level."""
    t = materialize(chains.select(F.col("conv_id").alias("_v"), "up", "leaves", "saved"), "trie-chains")
    while True:
        hung = t.where("up is not null").groupBy(F.col("up").alias("_u")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"), F.count(F.lit(1)).alias("_many"))
        hung = materialize(hung, "trie-hung")
        if hung.isEmpty():
            release(hung)
            return t.drop("up")
        more = t.join(hung, F.col("_v") == F.col("_u"), "left").select(
            "_v", "up", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved")
        )
        # where those go on which others hang on: the root's chain, on which most may hang, goes nowhere
        onward = t.where("up is not null").select(F.col("_v").alias("_w"), F.col("up").alias("_next"))
        onward = materialize(onward.join(hung, F.col("_w") == F.col("_u")).select("_w", "_next", "_many"), "trie-onward")
        hanging = materialize(more.where("up is not null"), "trie-hanging")
        hopped = meet(hanging, onward, "up", "_w", "_many", "left").select("_v", F.col("_next").alias("up"), "leaves", "saved")
        new = materialize(hopped.union(more.where("up is null").select("_v", "up", "leaves", "saved")), "trie-chains")
        release(t, hung, onward, hanging)
        t = new


def nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie of ``turns`` (conv_id, rank, _x, _y, bytes) of ``conversations`` (conv_id, n_turns), as rows of conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members = materialize(partial(turns, conversations), "trie-partial")
    found = materialize(merged(members), "trie-nodes")
    # a chain's top: the node of least depth that a conversation owns; only tops have parents of another owner
    tops = found.groupBy(F.col("conv_id").alias("_o")).agg(F.min("depth").alias("_top"), F.count(F.lit(1)).alias("_long"))
    tops = materialize(tops, "trie-tops")
    top = meet(found, tops, "conv_id", "_o", "_long").where("depth = _top and depth > 0").select("conv_id", "depth", "p1", "p2")
    top = materialize(top, "trie-branches")
    # parents by key: one with many children is found by broadcast
    held = top.groupBy(F.col("p1").alias("_p1"), F.col("p2").alias("_p2")).agg(F.count(F.lit(1)).alias("_many"))
    who = found.join(held, (F.col("k1") == F.col("_p1")) & (F.col("k2") == F.col("_p2"))).select(F.col("k1").alias("_q1"), F.col("k2").alias("_q2"), F.col("conv_id").alias("parent_conv_id"), "_many")
    who = materialize(who.withColumn("_q", F.struct("_q1", "_q2")), "trie-parents")
    hung = meet(top.withColumn("_p", F.struct("p1", "p2")), who, "_p", "_q", "_many").select("conv_id", "depth", "parent_conv_id")
    hung = materialize(hung, "trie-hung-on")
    at = hung.groupBy(F.col("parent_conv_id").alias("_pc"), (F.col("depth") - 1).alias("_pd")).agg(F.count(F.lit(1)).alias("_branches"))
    own = found.join(at, (F.col("conv_id") == F.col("_pc")) & (F.col("depth") == F.col("_pd")), "left").withColumns({
        "n_children": F.coalesce("_branches", F.lit(0)) + F.when(F.col("last"), 0).otherwise(1), "_saved": (F.col("n_convs") - 1) * F.col("bytes"),
    }).withColumn("_leaf", (F.col("n_children") == 0).cast("long"))
    own = materialize(own.select("k1", "k2", "conv_id", "depth", "n_convs", "n_children", "_saved", "_leaf"), "trie-own-sums")
    alone = own.groupBy("conv_id").agg(F.sum("_leaf").alias("leaves"), F.sum("_saved").alias("saved"))
    up = hung.select(F.col("conv_id").alias("_v"), F.col("parent_conv_id").alias("up"))
    totals = _chain_totals(alone.join(up, F.col("conv_id") == F.col("_v"), "left").select("conv_id", "up", "leaves", "saved"))
    below = totals.join(hung, F.col("_v") == F.col("conv_id")).groupBy(F.col("parent_conv_id").alias("_pc"), (F.col("depth") - 1).alias("_pd")).agg(F.sum("leaves").alias("_bl"), F.sum("saved").alias("_bs"))
    own = own.join(below, (F.col("conv_id") == F.col("_pc")) & (F.col("depth") == F.col("_pd")), "left").withColumns({
        "_leaf": F.col("_leaf") + F.coalesce("_bl", F.lit(0)), "_saved": F.col("_saved") + F.coalesce("_bs", F.lit(0)),
    }).drop("_pc", "_pd", "_bl", "_bs")
    up_chain = sums_before(own, ["conv_id"], [F.col("depth").desc()], {"_leaves_below": F.col("_leaf"), "_saved_below": F.col("_saved")}, "trie-rollup")
    parents = hung.select(F.col("conv_id").alias("_hc"), F.col("depth").alias("_hd"), "parent_conv_id")
    out = up_chain.join(parents, (F.col("conv_id") == F.col("_hc")) & (F.col("depth") == F.col("_hd")), "left")
    out = out.join(end_digests(members), (F.col("k1") == F.col("_e1")) & (F.col("k2") == F.col("_e2")), "left")
    within = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    return out.select(
        "conv_id", "depth", within.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), (F.col("_leaf") + F.col("_leaves_below")).alias("n_leaves"),
        (F.col("_saved") + F.col("_saved_below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are."""
    turns = materialize(ranked(conversations), "trie-ranked")
    return nodes(turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that ``rebuilt`` makes of ``conversations``."""
    turns, convs = rebuilt(ranked(conversations))
    return nodes(turns, materialize(convs, "trie-convs"))
