"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, hnsw, langid, license_scan, mixing, neardup, quality, sharding, tokens, trie, vector_codes
from .common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = langid.learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return langid.identify(docs, content).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op8_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    docs = table(spark, sf_dir, "documents")
    return tokens.read_shards(tokens.write_shards(docs, definition), docs.schema["doc_id"].dataType.simpleString())


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.with_label_errors(vector_codes.compress(table(spark, sf_dir, "embeddings")))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    if ranks is None or pattern is None:
        import public_tokenizers

        ranks, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, pattern)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_quality_classifier, op2_language_id, op3_license_scan, op4_near_duplicates, op5_sharding,
        op6_decontamination, op7_chat_formatting, op8_token_output, op9_embedding_duplicates, op10_source_mixing,
        op11_conversation_trie, op12_vector_codes, op13_bpe_round_trip,
    ]
    return {f.__name__: f for f in found}


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_SPACED = _WORDS.replace(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+")

#: Exact sets in place of signatures: pairs meet in the rarest shingles of their sets, of which linked ones share one.
NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
    {_SPACED} AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM (SELECT rid, w, least(len(w), 5) AS n, unnest(range(1, (len(w) - least(len(w), 5) + 2)::BIGINT)) AS i FROM d WHERE len(w) > 0)),
num AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY count(*), s) AS k FROM sh GROUP BY s),
sets AS MATERIALIZED (SELECT rid, list_sort(list(k)) AS ks FROM sh JOIN num USING (s) GROUP BY rid),
reps AS MATERIALIZED (SELECT min(rid) AS rep, ks, len(ks) AS n FROM sets GROUP BY ks),
-- the rarest shingles of a set: sets that share 85 % of their union share one of these
rare AS MATERIALIZED (SELECT rep, n, unnest(ks[1 : n - (85 * n + 99) // 100 + 1]) AS k FROM reps),
pairs AS (SELECT DISTINCT a.rep AS x, b.rep AS y FROM rare a JOIN rare b ON a.k = b.k AND a.rep < b.rep WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
common AS (SELECT x, y, a.n + b.n AS total, len(list_intersect(a.ks, b.ks)) AS shared FROM pairs JOIN reps a ON a.rep = x JOIN reps b ON b.rep = y),
link AS MATERIALIZED (SELECT x, y FROM common WHERE 100 * shared >= 85 * (total - shared)),
edge AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT rep, rep AS far FROM reps UNION SELECT reach.rep, edge.y FROM reach JOIN edge ON edge.x = reach.far),
least_id AS (SELECT reps.rep, min(doc_id) AS least FROM reps JOIN sets USING (ks) JOIN d USING (rid) GROUP BY reps.rep),
comp AS (SELECT reach.rep, min(least) AS component_id FROM reach JOIN least_id ON least_id.rep = reach.far GROUP BY reach.rep),
facts AS (SELECT rid, reps.n, component_id FROM sets JOIN reps USING (ks) JOIN comp USING (rep))
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
       doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS kept
FROM d LEFT JOIN facts USING (rid)
"""

#: Every two vectors, which SQL can afford on the test tables only.
EMBEDDING_DUPLICATES_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
usable AS MATERIALIZED (SELECT rid, vec_id, e, len(e) AS n FROM v
    WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
link AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y FROM usable a JOIN usable b ON a.n = b.n AND a.rid <> b.rid WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT rid, rid AS far FROM v UNION SELECT reach.rid, link.y FROM reach JOIN link ON link.x = reach.far),
comp AS (SELECT reach.rid, min(vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.far GROUP BY reach.rid),
many AS (SELECT x AS rid, count(*) AS n_links FROM link GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN comp USING (rid) LEFT JOIN many USING (rid)
"""

DECONTAMINATION_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, (len(w) - least(len(w), 10) + 2)::BIGINT)) AS i FROM b WHERE len(w) > 0)),
ln AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT rid, n, w, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM d, ln WHERE len(w) >= n)),
hit AS (SELECT dw.rid, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
          FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.rid = d.rid LEFT JOIN items ON items.rid = d.rid
"""

CHAT_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS r, coalesce(text, '') AS txt FROM conversations),
people AS (SELECT DISTINCT conv_id, r AS speaker FROM t WHERE r <> 'system'),
v AS (SELECT t.conv_id, speaker, turn, r,
        CASE WHEN r = 'system' THEN 'system' WHEN r = speaker THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN r <> speaker AND r <> 'system' THEN r END AS name, txt
      FROM t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, '<|im_start|>' || role || CASE WHEN name IS NULL THEN '' ELSE ' name=' || name END || chr(10) AS head FROM v),
g AS (SELECT *, head || txt || '<|im_end|>' || chr(10) AS segment FROM s),
o AS (SELECT *, row_number() OVER w - 1 AS seq, (sum(length(segment)) OVER w)::BIGINT - length(segment) AS start_at FROM g
      WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, r, segment ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, seq, turn, role, name, segment, start_at AS "start", start_at + length(segment) AS "end",
       CASE WHEN r = speaker THEN start_at + length(head) ELSE start_at + length(segment) END AS mask_start, start_at + length(segment) AS mask_end
FROM o
"""


#: Nodes are whole lists of turns; the hash of an id is CRC-32, bit by bit (fixed value: its polynomial).
CONVERSATION_TRIE_SQL = """
WITH t AS MATERIALIZED (SELECT conv_id::BIGINT AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT c, list({'r': r, 'x': x} ORDER BY k) AS turns,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(ch)::BIGINT FOR ch IN string_split(c::VARCHAR, '')]),
        lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 9 AS h FROM t GROUP BY c),
conv AS MATERIALIZED (SELECT a.c, list_concat(coalesce(b.turns, [])[1 : a.h], a.turns[a.h + 1 :]) AS turns FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 5),
member AS (SELECT c, d, turns[1 : d] AS p, d = len(turns) AS ended FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM conv)),
node AS MATERIALIZED (SELECT p, d, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * coalesce(strlen(p[d].x), 0) AS own,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS h FROM member GROUP BY p, d),
kids AS (SELECT p[1 : d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
shaped AS MATERIALIZED (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids ON kids.d = node.d AND kids.p = node.p),
up AS (SELECT p, d, unnest(range(0, d + 1)) AS j, own, kids FROM shaped),
below AS (SELECT p[1 : j] AS p, j AS d, count(*) FILTER (kids = 0) AS leaves, sum(own) AS saved FROM up GROUP BY 1, 2)
SELECT s.conv_id, s.d::BIGINT AS depth, par.conv_id AS parent_conv_id, s.n AS n_convs, s.kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, s.h AS ends_sha256
FROM shaped s JOIN below ON below.d = s.d AND below.p = s.p LEFT JOIN node par ON par.d = s.d - 1 AND par.p = s.p[1 : s.d - 1]
"""


def _vector_codes_sql() -> str:
    """Full searches: distances to all entries, as inner products of whole numbers."""
    ctes, book = [], "b0"
    for k in range(3):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT rid, n, p, min({{'d': xx - 2 * list_inner_product(x, y) + yy, 'k': k}}) AS got FROM part JOIN {book} USING (n, p) GROUP BY rid, n, p)""")
        if k < 2:
            ctes.append(f"""m{k} AS (SELECT n, p, got.k AS k, j, sum(x[j])::HUGEINT AS s, count(*)::HUGEINT AS c FROM (SELECT n, p, got, x, unnest(range(1, len(x) + 1)) AS j FROM a{k} JOIN part USING (rid, n, p)) GROUP BY ALL),
u{k} AS (SELECT n, p, k, list(((s - ((s % c) + c) % c) // c)::DOUBLE ORDER BY j) AS y FROM m{k} GROUP BY n, p, k),
b{k + 1} AS MATERIALIZED (SELECT n, p, k, coalesce(u.y, b.y) AS y, list_inner_product(coalesce(u.y, b.y), coalesce(u.y, b.y)) AS yy FROM {book} b LEFT JOIN u{k} u USING (n, p, k))""")
            book = f"b{k + 1}"
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (PARTITION BY len(embedding) ORDER BY vec_id NULLS LAST) AS nth, row_number() OVER () AS rid, vec_id, label, len(embedding) AS n, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(embedding) % 16 = 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
part AS MATERIALIZED (SELECT rid, nth, n, p, x, list_inner_product(x, x) AS xx FROM (SELECT rid, nth, n, p, e[p * (n // 16) + 1 : (p + 1) * (n // 16)] AS x FROM v, (SELECT unnest(range(0, 16)) AS p))),
b0 AS MATERIALIZED (SELECT n, p, nth - 1 AS k, x AS y, xx AS yy FROM part WHERE nth <= 64),
{", ".join(ctes)},
h AS (SELECT n, sha256(string_agg(y[j]::BIGINT::VARCHAR, ',' ORDER BY p, k, j)) AS h FROM (SELECT n, p, k, y, unnest(range(1, len(y) + 1)) AS j FROM {book}) GROUP BY n),
r AS (SELECT rid, string_agg(printf('%02x', got.k), '' ORDER BY p) AS code, sum(got.d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN r USING (rid) JOIN h USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_near_duplicates": NEAR_DUPLICATES_SQL, "op6_decontamination": DECONTAMINATION_SQL,
        "op7_chat_formatting": CHAT_SQL, "op9_embedding_duplicates": EMBEDDING_DUPLICATES_SQL,
        "op11_conversation_trie": CONVERSATION_TRIE_SQL, "op12_vector_codes": _vector_codes_sql(),
    }
