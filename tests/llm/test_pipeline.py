"""The pipeline's stages against brute force over a small table, and the registration of all queries."""

import hashlib
import heapq
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.llm import quality
from tests.llm.test_operators import SPACE, brute_components, brute_targets, brute_windows, shingle_sets

SF = "/root/testdata/sf0.001"


def brute_quality(rows, labels):
    """Positions of the rows whose text has the higher Gaussian log density under class 1, or an equal one."""
    x = {k: [] for k in (0, 1)}
    for i, t, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            for q in labels.get(i, []):
                x[q].append(quality.statistics(t))
    x = {k: np.array(v) for k, v in x.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    both = sum(len(x[k]) * cov[k] for k in x) / sum(map(len, x.values()))
    sides = []
    for k in (0, 1):
        a = 0.9 * cov[k] + 0.1 * both
        a = 0.95 * a + 0.05 * np.diag(np.diag(a)) + 1e-4 * np.eye(len(a))
        u = np.array([quality.statistics(t) for _, t, _ in rows]) - x[k].mean(axis=0)
        sides.append(np.log(len(x[k])) - 0.5 * np.linalg.slogdet(a)[1] - 0.5 * np.einsum("id,id->i", u, np.linalg.solve(a, u.T).T))
    return [n for n in range(len(rows)) if sides[1][n] >= sides[0][n]]


def won(targets, blocks):
    """Plain Sainte-Lague: ``blocks`` blocks, one by one, to the highest quotient."""
    names = sorted(targets, key=lambda s: (s is None, s or ""))
    heap = [(-targets[s], n) for n, s in enumerate(names)]
    heapq.heapify(heap)
    out = Counter()
    for _ in range(blocks):
        _, n = heap[0]
        out[names[n]] += 1
        heapq.heapreplace(heap, (-targets[names[n]] / (2 * out[names[n]] + 1), n))
    return out


def brute_mix(rows, hashes, blocks=10_000, shards=16):
    """Words taken of each row (ids differ)."""
    size = [len(SPACE.findall(t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        sizes[s] += n
    target = brute_targets(sizes)
    total = sum(target.values())
    block = max(1, int(-(-total // min(blocks, total // 1))))
    quota = won(target, round(total / block))
    whole = {s: min(quota[s], int(target[s] // block)) * block for s in target}
    more = won({s: target[s] - whole[s] for s in target}, round(sum(target[s] - whole[s] for s in target)))
    taken = [0] * len(rows)
    for s in target:
        order = sorted((n for n in range(len(rows)) if rows[n][2] == s), key=lambda n: hashes[rows[n][0]])
        words = min(whole[s] + more[s], 3 * sizes[s])
        if not words:
            continue
        rest = words % sizes[s]
        n = max(1, min(shards, len(order) // 64, rest // block))
        up = [h * (rest // block) // n * block for h in range(n)] + [rest]
        spans = [(a * sizes[s] // rest, a * sizes[s] // rest + b - a) for a, b in zip(up, up[1:])] if rest else []
        at = 0
        for k in order:
            taken[k] = words // sizes[s] * size[k] + sum(max(0, min(at + size[k], b) - max(at, a)) for a, b in spans)
            at += size[k]
    return [int(t / n + 0.5) if n else 0 for t, n in zip(taken, size, strict=True)]


def expected(name, spark, before):
    """doc_ids that the stage shall return, with their numbers of rows, by brute force."""
    if name == "quality":
        labels = {}
        for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality in (0, 1)").collect():
            labels.setdefault(r.doc_id, []).append(r.quality)
        return Counter(before[n][0] for n in brute_quality(before, labels))
    if name == "near_duplicates":
        return Counter({i for i, root in brute_components(shingle_sets(before), 80).items() if i == root})
    if name == "decontamination":
        bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        return Counter(i for i, v in brute_windows(before, bench).items() if not v[4])
    if name == "mixing":
        h = {r.i: r.h for r in spark.createDataFrame([(i,) for i, *_ in before], "i long").select("i", F.xxhash64(F.lit(0), "i").alias("h")).collect()}
        return Counter({before[n][0]: k for n, k in enumerate(brute_mix(before, h)) if k})
    return Counter(i for i, *_ in before)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, got = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in got.select("doc_id", "text", "source").collect()]
        stage(spark, got, SF).write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        after = Counter(r.doc_id for r in got.collect())
        assert after == expected(name, spark, before), name
        assert name == "sharding" or got.columns == columns
    rows = got.collect()
    text = {i: t or "" for i, t, _ in before}
    at, loads = {}, Counter()
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 40
        assert at.setdefault(raw, r.shard) == r.shard
        loads[r.shard] += r.size
    for s in loads:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    groups, heap = Counter(), [0] * 40
    for r in rows:
        groups[text[r.doc_id]] += r.size
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert all(abs(a - b) <= 0.01 * b + 16 for a, b in zip(sorted(loads.values()), sorted(heap)[-len(loads):], strict=True))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, ids that repeat, texts without words, a very long one, and columns that operators use themselves."""
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    fine = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(20).collect() if r.text]
    rows = [(None, None, None, None, None), (None, item, None, "a", 1), (5, item, "en", "a", 1), (5, "clean words that stand alone", "en", None, 1), (6, "", "en", "b", 0), (6, " \t", "en", "b", 2)]
    rows += [(7, fine[0], "en", "b", 3)] * 3 + [(None, fine[0], "en", "b", 3), (8, fine[1] * 40, "de", "a", 4)] + [(10 + i, t, "en", "c", 5) for i, t in enumerate(fine)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit(1) for c in ("_key", "score", "rep", "_set", "shard", "size", "_copy", "_times", "taken", "_did", "_bad", "kept", "_n")}), rows


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, odd, name):
    docs, rows = odd
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, SF)
    assert stage(spark, docs.limit(0), SF).collect() == []
    if name == "sharding":
        assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows)
        return
    assert got.columns == docs.columns
    out = Counter((r.doc_id, r.text) for r in got.collect())
    have = Counter((r[0], r[1]) for r in rows)
    if name == "quality":
        labels = {}
        for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality in (0, 1)").collect():
            labels.setdefault(r.doc_id, []).append(r.quality)
        plain = [(r[0], r[1], r[3]) for r in rows]
        assert out == Counter(plain[n][:2] for n in brute_quality(plain, labels))
    elif name == "near_duplicates":
        sets = [shingle_sets([(0, r[1])])[0] for r in rows]
        root, want = brute_components(dict(enumerate(sets)), 80), Counter()
        for n in range(len(rows)):
            group = [rows[k] for k in range(len(rows)) if root[k] == root[n]] if sets[n] else [rows[n]]
            head = min(group, key=lambda g: (g[0] is None, g[0] or 0, hashlib.md5((g[1] or "").encode()).digest()))
            want[head[:2]] = 1
        assert out == want
    elif name == "decontamination":
        bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        assert out == Counter({k: n for k, n in have.items() if not brute_windows([k], bench)[k[0]][4]})
    else:
        assert set(out) <= {k for k in have if SPACE.findall(k[1] or "")}
        words, want = Counter(), Counter()
        for r in rows:
            want[r[3]] += len(SPACE.findall(r[1] or ""))
        for r in got.collect():
            words[r.source] += len(SPACE.findall(r.text))
        longest = max(len(SPACE.findall(r[1] or "")) for r in rows)
        assert all(abs(words[s] - t) <= longest for s, t in brute_targets(want).items())


def test_run_equals_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_registered():
    import __spark_entry__ as e

    names = {n.split("_")[0] for n in e.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in e.queries()
