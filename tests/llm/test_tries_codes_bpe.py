"""Conversation tries, vector codes and byte-level BPE against brute force: small cases, odd rows, hot keys."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from meshspark.llm import bpe, queries, trie, vector_codes

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute_trie(rows, rebuild):
    """Nodes as lists of turns, from rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(k[2], k[4]) for k in sorted(v)] for c, v in own.items()}
    conv = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        conv[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in conv.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], digest(ends[n])) for n, m in members.items())


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def nodes_of(df):
    assert df.columns == COLUMNS and {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(5)
    rows = [(c, r.choice([t, t, t, None]), r.choice(["user", "ann", None]), r.choice(["x", "é", None])) for c in range(-6, 40) for t in range(r.randint(0, 14))]
    rows += [(7, 99, "user", "z")] * 3 + [(None, 1, "user", "of nobody")]
    rows += [(1000, i, "user", "long " * (i % 3)) for i in range(400)]  # one conversation with most of the turns
    rows += [(2000 + i, 0, "system", "the same") for i in range(600)]  # a node with more ends than a piece holds, and one with as many children
    rows += [(3000 + i, 0, "user", f"only {i}") for i in range(300)]
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie(spark, conversations, rebuild):
    df = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "rank": F.lit(1), "bytes": F.lit(2), "k1": F.lit(3)})
    got = (trie.rebuilt_trie if rebuild else trie.conversation_trie)(df)
    assert nodes_of(got) == brute_trie(conversations, rebuild)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.rebuilt_trie(df).collect() == trie.conversation_trie(df).collect() == []


def test_trie_without_turns_left(spark):
    """Conversations that the rebuilding leaves nothing of end at the root."""
    rows = [(c, 0, "user", "hi") for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = nodes_of(trie.rebuilt_trie(df))
    assert got == brute_trie(rows, True) and list(got) == [(min(c for c, *_ in rows), 0, None, len(rows), 0, 1, 0, next(iter(got))[-1])]


def test_chains_on_chains(spark, monkeypatch):
    """Conversation i leaves the one before at its turn i: chains hang 40 deep, and rounds are few."""
    rows = [(i, t, "user", "a" * 9 if t < i else f"own {i}") for i in range(1, 41) for t in range(i + 2)]
    rounds, count = [], trie.materialize
    monkeypatch.setattr(trie, "materialize", lambda df, name: (rounds.append(name), count(df, name))[1])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes_of(trie.conversation_trie(df)) == brute_trie(rows, False)
    assert rounds.count("trie-hung") <= 8


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_vector_codes"])
def test_whole_tables_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert Counter(tuple(r) for r in df.select(*[d[0] for d in cur.description]).collect()) == Counter(cur.fetchall())


def brute_codes(rows):
    """(vec_id, code, error, label_error, sha) of (vec_id, embedding, label), every part held against every entry."""
    ok = [r for r in rows if r[1] is not None and len(r[1]) and len(r[1]) % 16 == 0 and all(c is not None and math.isfinite(c) for c in r[1])]
    out = []
    for dim in sorted({len(r[1]) for r in ok}):
        mine = [(i, np.floor(np.array(e, np.float64) * 256).astype(np.int64), lab) for i, e, lab in ok if len(e) == dim]
        mine.sort(key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].astype("<i4").tobytes()).hexdigest()))
        x = np.stack([r[1] for r in mine]).reshape(len(mine), 16, -1)
        book = x[:64].transpose(1, 0, 2).copy()
        for k in range(3):
            d = ((x[:, :, None] - book[None]) ** 2).sum(-1)
            at = d.argmin(2)
            if k < 2:
                for p in range(16):
                    for j in range(book.shape[1]):
                        if (m := at[:, p] == j).any():
                            book[p, j] = x[m, p].sum(0) // m.sum()
        sha = hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
        out += [(r[0], bytes(a.tolist()).hex(), int(e), r[2], sha) for r, a, e in zip(mine, at, d.min(2).sum(1), strict=True)]
    total = Counter()
    for _, _, e, lab, _ in out:
        total[lab] += e
    return Counter((i, code, e, total[lab], sha) for i, code, e, lab, sha in out)


def test_vector_codes(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(32)], r.choice([1, 2, None])) for i in range(0, 300, 2)]
    rows += [(1000 + i, rows[3][1], 7) for i in range(400)]  # one vector, and one label, with most of the rows
    rows += [(1, [0.25] * 32, None), (3, [0.25] * 32, 1), (3, [-0.25] * 32, 1), (3, [0.25] * 32, 1), (None, [1.0] * 32, 2)]  # ties, repeated ids and rows, no id
    rows += [(5, None, 1), (7, [], 1), (9, [float("nan")] + [0.0] * 31, 1), (11, [None] + [0.0] * 31, 1), (13, [float("inf")] * 32, 1), (15, [1.0] * 20, 1)]
    rows += [(2000 + i, [float(i % 4)] * 16, 2) for i in range(30)]  # another length, with fewer vectors than entries
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit(1), "error": F.lit("x"), "_x": F.lit(0)})
    codes = vector_codes.compress(df)
    got = vector_codes.with_label_errors(codes)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and dict(got.dtypes)["error"] == dict(got.dtypes)["label_error"] == "bigint"
    narrow = [(i, None if e is None else [None if c is None else float(np.float32(c)) for c in e], lab) for i, e, lab in rows]
    assert Counter(tuple(x) for x in got.collect()) == brute_codes(narrow)
    back = {x.vec_id: x.vector for x in vector_codes.decompressed(codes).where("vec_id >= 2000").collect()}
    error = {x.vec_id: x.error for x in got.collect()}
    assert all(sum((256 * (i % 4) - c) ** 2 for c in back[2000 + i]) == error[2000 + i] for i in range(30))
    assert vector_codes.with_label_errors(vector_codes.compress(df.limit(0))).collect() == []
    huge = spark.createDataFrame([(1, [3e38] * 16, 1), (2, [1.0] * 16, 1)], "vec_id long, embedding array<float>, label int")
    assert [x.vec_id for x in vector_codes.with_label_errors(vector_codes.compress(huge)).collect()] == [2]


def test_exponion_equals_full_search():
    """Whatever the start, with ties and equal entries; and it looks at fewer entries."""
    r = np.random.default_rng(4)
    for width, spread in ((1, 3), (2, 4), (4, 400)):
        entries = r.integers(-spread, spread, (64, width))
        x, start = r.integers(-spread, spread, (3000, width)), r.integers(0, 64, 3000)
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        search = vector_codes.Exponion(entries)
        at, least = search.nearest(x, start)
        assert (at == d.argmin(1)).all() and (least == d.min(1)).all()
        search.looked = 0
        again = search.nearest(x, at)
        assert (again[0] == at).all() and search.looked < 0.7 * d.size


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


SYLLABLES = ["a", "b", "'l", "l", "'", " ", "  ", "\n", "\t", "x" * 30, "é", "日本", "1", "23", "!", "..", "'re", "e", "s", "the", "http://", " ", "  \n  ", "😀", "ll", "v", "\x1c", "\x85", " ", "\r\n", "​", "<|endoftext|>"]


@pytest.mark.parametrize("segment, leaf, kept", [(1, 1, 0), (3, 2, 128), (7, 3, 0), (50, 1, 128), (16_384, 2, 128), (65_536, 16, 128)])
def test_bpe_equals_library(library, monkeypatch, segment, leaf, kept):
    """Wherever texts and pieces are halved."""
    monkeypatch.setattr(bpe, "SEGMENT", segment)
    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "LONG_PIECE", kept)
    monkeypatch.setattr(bpe, "SHORT", 4 * leaf)
    codec, r = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), random.Random(segment)
    for _ in range(700):
        text = "".join(r.choice(SYLLABLES) for _ in range(r.randint(0, 60)))
        ids = codec.encode(text)
        assert list(ids) == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_joins_anywhere(library):
    """The join of two encodings is the encoding of all bytes, wherever they are cut; grouping doesn't matter."""
    m, r = bpe.Merges(bpe.read_ranks(RANKS)), random.Random(2)
    for _ in range(300):
        raw = "".join(r.choice(["a", "an", "the", "x", "xx", "ing", "é", "日本", "tion"]) for _ in range(r.randint(1, 30))).encode()
        i, j = sorted(r.randint(0, len(raw)) for _ in range(2))
        a, b, c = (m.greedy(p) for p in (raw[:i], raw[i:j], raw[j:]))
        assert m.join(m.join(a, b), c) == m.join(a, m.join(b, c)) == m.greedy(raw) == m.short(raw)


def test_bpe_long_texts(library, monkeypatch):
    codec, r = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), random.Random(3)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1 << 16)
    small = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    prose = " ".join("".join(r.choice("abcdeé,.") for _ in range(r.randint(1, 9))) for _ in range(60_000))
    for text in (prose, prose[:65_537], "x" * 20_000, "ab" * 90_000, " " * 150_000 + "a", "日本" * 40_000, "ACGT" * 40_000):
        want = library.encode_ordinary(text)
        assert list(codec.encode(text)) == want == list(small.encode(text)) and codec.decode(want) == text.encode()
    assert small.words.held <= small.words.most + bpe.ENTRY_BYTES + 10 * bpe.LONG_PIECE


def test_bpe_rows(spark, library):
    texts = [None, "", " ", "one", "one", "a\x00b", "naïve 日本 😀", "y" * 3000, "word " * 40_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit("x"), "decoded": F.lit(0)})
    df = df.union(df.where("doc_id = 4"))
    got = Counter(tuple(r) for r in bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t in [*((i if i != 3 else None, t) for i, t in enumerate(texts)), (4, texts[4])]:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts) if i != 3)
    assert bpe.digests(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_query(spark, library):
    got = {r.doc_id: r for r in queries.op13_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
