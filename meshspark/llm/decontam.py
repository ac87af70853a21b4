"""Benchmark decontamination by winnowing.

Words are hashed, hashes of k-grams formed, and the minimum of each window of w consecutive
k-grams kept as a fingerprint, so that every shared span of at least w + k - 1 words shares a
fingerprint.  With k = 5 and w = 6 the guarantee is 10 words, the length of a benchmark window;
an item of fewer words (one window of its own length n) uses k = min(5, n) and w = n - k + 1.
Texts of more than ``SEGMENT`` characters are cut between words into segments of at most so many (a longer
word is one by itself), each with the 9 words that follow it, so that arrays of words and hashes stay small however long a text is.
Segments are fingerprinted in one pass; those with a fingerprint of the benchmark are read
again, and only at places whose fingerprint hit are whole windows put together and compared word for
word; places count from the start of the text, by the words of the segments before.  Everything is built-in column functions: no Python runs on the executors.

Fingerprinting folds case by ``lower`` (equal A-Z-folded texts are equal under it, so it loses
nothing); the comparison itself folds A-Z only.

Defined edge cases: null and wordless texts have no words, no window and no hit; an empty
benchmark hits nothing; several items with one window all count; items without an id count as one item,
which the digest of ids leaves out; rows with null or repeated
doc_ids each get the figures of their own text (rows are told apart by id and the text's digest; rows
equal in both are equal in their figures); hits that overlap count each word once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BETWEEN_ALNUM, LOWER, UPPER, digest, materialize

WINDOW, GRAM = 10, 5
#: Characters of a segment.
SEGMENT = 32_768
#: Fingerprints, windows or keys of at most this many bytes are broadcast; more are joined by a shuffle, with equal results.
BROADCAST_BYTES = 32 << 20


def words(text: Column, exact: bool) -> Column:
    """Words of a text, A-Z lower-cased (``exact``) or lower-cased throughout for fingerprints."""
    t = F.coalesce(text, F.lit(""))
    folded = F.translate(t, UPPER, LOWER) if exact else F.lower(F.replace(t, F.lit("Σ"), F.lit("σ")))
    return F.array_remove(F.split(folded, BETWEEN_ALNUM, -1), "")


def segments(df: DataFrame) -> DataFrame:
    """A row for each segment of ``text``: in its place ``_c`` (number), ``_own`` (the segment) and ``_next`` (the words that follow, WINDOW - 1 at most)."""
    gap, word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    # the rest if it is short enough, else up to the last gap within the bound, else one word
    cut = rf"(?s)(?:.{{1,{SEGMENT}}}\z|.{{0,{SEGMENT - 1}}}{gap}|{word}+)(?=((?:{gap}*{word}+){{0,{WINDOW - 1}}}))"
    kept = [c for c in df.columns if c != "text"]
    t = df.select(*kept, F.coalesce("text", F.lit("")).alias("_own"))
    # most texts are one segment: they don't pass through the rows that an explode makes
    short = t.where(F.length("_own") <= SEGMENT).select(*kept, F.lit(0).alias("_c"), "_own", F.lit("").alias("_next"))
    parts = F.arrays_zip(F.regexp_extract_all("_own", F.lit(cut), F.lit(0)).alias("own"), F.regexp_extract_all("_own", F.lit(cut), F.lit(1)).alias("next"))
    long = t.where(F.length("_own") > SEGMENT).select(*kept, F.posexplode(parts).alias("_c", "_x"))
    return short.union(long.select(*kept, "_c", F.col("_x")["own"].alias("_own"), F.col("_x")["next"].alias("_next")))


def _segment_words(exact: bool) -> Column:
    """Words of a segment and of what follows it."""
    return F.concat(words(F.col("_own"), exact), words(F.col("_next"), exact))


def _ahead(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a), F.lit(1)))


def fingerprints(df: DataFrame, length: int, h: str = "_h", out: str = "_f") -> DataFrame:
    """Add ``out``: element i is the fingerprint of the window of ``length`` words that starts at word i.

    Hashes of k-grams and their minima over w of them grow by doubling.  Every step is a column of
    its own: nested in one expression, each step would be evaluated again at each use.  For the same
    reason nothing may filter on the result directly (a plain ``explode`` does): the optimizer
    would push the predicate down and inline all steps into it; ``explode_outer`` stops that.
    """
    k = min(GRAM, length)
    keep = df.columns
    at, span = h, 1
    steps = {1: h}
    while span < k:
        step = max(x for x in steps if x <= k - span)
        df = df.withColumn(f"_g{span + step}", F.zip_with(F.col(at), _ahead(F.col(steps[step]), span), lambda x, y: F.xxhash64(x, y)))
        span += step
        at = steps[span] = f"_g{span}"
    w, wide = length - k + 1, 1
    while wide < w:
        step = min(wide, w - wide)
        df = df.withColumn(f"_m{wide + step}", F.zip_with(F.col(at), _ahead(F.col(at), step), lambda x, y: F.least(x, y)))
        wide += step
        at = f"_m{wide}"
    room = F.size(h) - (length - 1)
    return df.select(*keep, F.when(room > 0, F.slice(at, F.lit(1), room)).otherwise(F.array().cast("array<bigint>")).alias(out))


def _tagged(prints: str, length: int) -> Column:
    """Fingerprints with the window length mixed in, so that lengths don't meet in the join."""
    return F.transform(prints, lambda x: F.xxhash64(F.lit(length), x))


def windows(bench: DataFrame) -> DataFrame:
    """One row for each distinct window: its length, text, fingerprint hash and the ids of the items that hold it."""
    w = bench.select(F.col("item_id"), words(F.col("text"), True).alias("_w")).where(F.size("_w") > 0)
    w = w.withColumn("_len", F.least(F.size("_w"), F.lit(WINDOW)))
    rows = w.select("item_id", "_w", "_len", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_len") + 1)).alias("_i")).select(
        "item_id", "_len", F.array_join(F.slice("_w", F.col("_i"), F.col("_len")), " ").alias("_win")
    )
    # in a struct, because collect_set leaves plain nulls out
    ids = F.collect_set(F.struct(F.col("item_id").cast("string").alias("s")))
    return rows.groupBy("_len", "_win").agg(F.array_sort(F.transform(ids, lambda x: x["s"])).alias("_items"))


def _few(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _on_row(rows: DataFrame, other: DataFrame) -> Column:
    """Rows of one id and text; ``other`` names them _did and _key2."""
    return rows["doc_id"].eqNullSafe(other["_did"]) & (rows["_key"] == other["_key2"])


def _figures(docs: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, _key, n_words) of all different rows, and (_did, _key2, _n_hit, _it) of those with hits."""
    win = materialize(windows(bench), "windows")
    lengths = sorted(r[0] for r in win.select("_len").distinct().collect())  # ten values at most
    base = segments(docs.select("doc_id", "text", digest().alias("_key")))
    # words of the segment are used twice, so that they are a column of their own: nested, they would be split twice
    own = base.select("doc_id", "_key", "_c", words(F.col("_own"), False).alias("_o"), words(F.col("_next"), False).alias("_n"))
    own = own.select("doc_id", "_key", "_c", F.size("_o").cast("long").alias("_many"), F.when(F.size("_n") == 0, F.col("_o")).otherwise(F.concat("_o", "_n")).alias("_w"))
    if not lengths:
        return _words_of(materialize(own.drop("_w"), "decontam")), None
    # A window's text is its own list of words: lower() on it gives the hashes that documents have.
    prints = None
    for n in lengths:
        one = fingerprints(win.where(F.col("_len") == n).withColumn("_h", F.transform(words(F.col("_win"), False), lambda x: F.xxhash64(x))), n)
        one = one.select(F.explode_outer("_f").alias("_x")).select(F.xxhash64(F.lit(n), F.col("_x")).alias("_fp"))  # one each
        prints = one if prints is None else prints.union(one)
    prints = materialize(prints.distinct(), "prints")
    known = _few(prints.select(F.col("_fp").alias("_p")), 32 * prints.count())
    d = own.select("doc_id", "_key", "_c", "_many", F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    made = []
    for n in lengths:
        d = fingerprints(d, n, out=f"_f{n}")
        d = d.withColumn(f"_f{n}", F.array_distinct(f"_f{n}"))
        made.append(f"_f{n}")
    tagged = [_tagged(m, n) for n, m in zip(lengths, made, strict=True)]
    rows = d.select("doc_id", "_key", "_c", "_many", F.explode_outer(F.concat(*tagged)).alias("_fp"))
    hit = rows.join(known, F.col("_fp") == F.col("_p"), "left")
    # equal rows have equal segments, which count once
    seen = materialize(hit.groupBy("doc_id", "_key", "_c", "_many").agg(F.max(F.col("_p").isNotNull()).alias("_hit")), "decontam")
    return _words_of(seen), materialize(_spans(base, seen, win, known, lengths), "spans")


def _words_of(seen: DataFrame) -> DataFrame:
    """doc_id, _key, n_words from segments, each as often as it may be."""
    return seen.groupBy("doc_id", "_key").agg((F.sum("_many") / F.sum(F.when(F.col("_c") == 0, 1))).cast("long").alias("n_words"))


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    seen, found = _figures(docs, bench)
    heads = seen.select(F.col("doc_id").alias("_did"), F.col("_key").alias("_key2"), "n_words")
    rows = docs.select("doc_id", digest().alias("_key"))
    joined = rows.join(heads, _on_row(rows, heads)).drop("_did", "_key2")
    if found is None:
        joined = joined.withColumns({"_n_hit": F.lit(None).cast("long"), "_it": F.lit(None).cast("array<string>")})
    else:
        joined = joined.join(found, _on_row(joined, found), "left")
    n_hit = F.coalesce(F.col("_n_hit"), F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("_it"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.array_join("_it", ","), 256), F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _spans(base: DataFrame, seen: DataFrame, win: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """_did, _key2, _n_hit, _it for rows with verified windows."""
    before = Window.partitionBy("doc_id", "_key").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    some = seen.where("_hit").select(F.col("doc_id").alias("_did"), F.col("_key").alias("_key2")).distinct()
    with_hits = seen.join(_few(some, 64 * seen.where("_hit").count()), _on_row(seen, some), "left_semi")
    at = with_hits.withColumn("_start", F.coalesce(F.sum("_many").over(before), F.lit(0))).where("_hit")
    ids = materialize(at.select(F.col("doc_id").alias("_did"), F.col("_key").alias("_key2"), F.col("_c").alias("_c2"), "_start"), "hit-segments")
    same_segment = _on_row(base, ids) & (F.col("_c") == F.col("_c2"))
    picked = materialize(base.join(_few(ids, 64 * ids.count()), same_segment).select("doc_id", "_key", "_c", "_start", _segment_words(True).alias("_w"), F.transform(_segment_words(False), lambda x: F.xxhash64(x)).alias("_h")), "hit-words")
    places = None
    for n in lengths:
        one = fingerprints(picked.select("doc_id", "_key", "_c", "_h"), n)
        one = one.select("doc_id", "_key", "_c", F.posexplode_outer("_f").alias("_at", "_x")).select("doc_id", "_key", "_c", F.lit(n).alias("_n"), "_at", F.xxhash64(F.lit(n), "_x").alias("_fp"))
        one = one.join(known, F.col("_fp") == F.col("_p"), "left_semi").drop("_fp")
        places = one if places is None else places.union(one)
    # by segment: at most as many places as it has words and windows have lengths
    lists = places.groupBy(F.col("doc_id").alias("_did"), F.col("_key").alias("_key2"), F.col("_c").alias("_c2")).agg(F.collect_set(F.struct(F.col("_n").alias("n"), F.col("_at").alias("at"))).alias("_l"))
    whole = picked.join(lists, _on_row(picked, lists) & (F.col("_c") == F.col("_c2"))).select("doc_id", "_key", "_start", F.explode(F.transform(
        "_l", lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), F.array_join(F.slice("_w", x["at"] + 1, x["n"]), " ").alias("text"))
    )).alias("_x"))
    places = whole.select("doc_id", "_key", F.col("_x")["n"].alias("_n"), (F.col("_start") + F.col("_x")["at"]).alias("_at"), F.col("_x")["text"].alias("_text"))
    # what a window row weighs: its text and the ids of all items that hold it
    weight = win.agg(F.sum(F.octet_length("_win") + F.octet_length(F.array_join("_items", ",")) + 16 * F.size("_items") + 64)).first()[0]
    found = places.join(_few(win, weight), (F.col("_n") == F.col("_len")) & (F.col("_text") == F.col("_win")))
    found = found.select("doc_id", "_key", "_at", (F.col("_at") + F.col("_n")).alias("_end"), "_items")
    earlier = Window.partitionBy("doc_id", "_key").orderBy("_at", "_end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("_end").over(earlier), F.lit(0))
    new = found.withColumn("_new", F.greatest(F.lit(0), F.col("_end") - F.greatest(F.col("_at"), reach)))
    return new.groupBy(F.col("doc_id").alias("_did"), F.col("_key").alias("_key2")).agg(
        F.sum("_new").alias("_n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_it")
    )


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark window: each by its own text, with or without an id."""
    found = _figures(docs.select("doc_id", "text"), bench)[1]
    if found is None:
        return docs
    bad = found.select("_did", "_key2")  # only rows with at least one verified window are there
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_did"]) & (digest(docs["text"]) == bad["_key2"]), "left_anti")
