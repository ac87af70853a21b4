"""The binary format: round trips, slices, and files that are too short."""

import subprocess
import sys

import numpy as np
import pytest

from meshspark.graph import Graph
from meshspark.operators import algorithms as A
from meshspark.sources import csr

EDGES = [(0, 1, 4), (0, 2, 1), (1, 3, 1), (2, 1, 2), (2, 3, 5), (3, 4, 3), (3, 7, 9), (4, 0, 7), (4, 5, 2), (5, 7, 1), (5, 7, 8)]


@pytest.mark.parametrize("kind, wide", [("csr", False), ("mix", False), ("csr_weighted", False), ("csr", True), ("mix", True)])
def test_round_trip(spark, tmp_path, kind, wide):
    csr.register(spark)
    path, columns = str(tmp_path / "g.bin"), ["src", "dst"] + (["w"] if kind == "csr_weighted" else [])
    df = spark.createDataFrame(EDGES, "src long, dst long, w long").select(*columns).repartition(3)
    df.write.format("csr").option("format", kind).option("vertices", 8).option("wide", wide).mode("append").save(path)
    got = spark.read.format("csr").option("format", kind).option("wide", wide).option("slices", 3).load(path)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(e[: len(columns)]) for e in EDGES)
    assert csr.vertex_count(path, wide) == 8


@pytest.mark.parametrize("kind, wide", [("csr", False), ("mix", False), ("csr_weighted", True), ("mix", True)])
def test_many_edges(spark, tmp_path, monkeypatch, kind, wide):
    """Small pieces everywhere: a hub, vertices without edges, repeated edges, runs that overlap and runs that don't."""
    r = np.random.default_rng(6)
    for name, value in (("EDGES_AT_ONCE", 37), ("OFFSETS_AT_ONCE", 11), ("RUN_ROWS", 50), ("SLICE_BYTES", 256)):
        monkeypatch.setattr(csr, name, value)
    monkeypatch.setattr(csr.Run.__init__, "__defaults__", (37,))
    src = np.where(r.random(1500) < 0.4, 70, r.integers(0, 120, 1500) * 2)
    rows = list(zip(src.tolist(), r.integers(0, 300, 1500).tolist(), r.integers(0, 2**32, 1500).tolist(), strict=True))
    columns = ["src", "dst"] + (["w"] if kind == "csr_weighted" else [])
    df = spark.createDataFrame(rows, "src long, dst long, w long").select(*columns).repartition(4)
    want = sorted(t[: len(columns)] for t in rows)
    by_spark, by_runs = str(tmp_path / "a"), str(tmp_path / "b")
    csr.write_csr(df, by_spark, 300, kind, wide)
    df.write.format("csr").option("format", kind).option("vertices", 300).option("wide", wide).mode("overwrite").save(by_runs)
    for path in (by_spark, by_runs):
        f = csr.CsrFile(path, kind, wide)
        assert (f.v, f.e) == (300, 1500) and f.offset(0, 300).tolist() == np.searchsorted(np.sort(src), np.arange(300)).tolist()
        for slices in (None, 1, 7):
            scan = spark.read.format("csr").option("format", kind).option("wide", wide)
            scan = scan.option("slices", slices) if slices else scan
            got = scan.load(path)
            assert sorted(map(tuple, got.collect())) == want
            if kind == "mix":
                assert sorted(map(tuple, scan.option("side", "in").load(path).collect())) == want
    assert len(list(tmp_path.iterdir())) == 2
    if kind != "csr_weighted":
        raw = open(by_spark, "rb").read()
        a = np.array(want)
        assert raw == csr.encode(a[:, 0], a[:, 1], 300, None, kind, wide)


@pytest.mark.parametrize("kind, wide", [("mix", False), ("csr_weighted", True)])
@pytest.mark.parametrize("rows", [EDGES, []])
def test_file_in_a_folder_that_is_missing(spark, tmp_path, kind, wide, rows):
    path = str(tmp_path / "shared" / "meshspark" / "g.bin")
    csr.write_csr(spark.createDataFrame(rows, "src long, dst long, w long"), path, 8, kind, wide)
    got = spark.read.format("csr").option("format", kind).option("wide", wide).load(path)
    assert sorted(r[:2] for r in map(tuple, got.collect())) == sorted(e[:2] for e in rows)


@pytest.mark.parametrize("kind, wide", [("csr", False), ("mix", True), ("csr_weighted", False)])
def test_folder(spark, tmp_path, monkeypatch, kind, wide):
    """Range files: the same edges back from both sides, a hub's split over parts, whatever was there before replaced."""
    r = np.random.default_rng(9)
    for name, value in (("EDGES_AT_ONCE", 37), ("OFFSETS_AT_ONCE", 11), ("SLICE_BYTES", 256)):
        monkeypatch.setattr(csr, name, value)
    src = np.where(r.random(1500) < 0.4, 70, r.integers(0, 120, 1500) * 2)
    rows = list(zip(src.tolist(), r.integers(0, 300, 1500).tolist(), r.integers(0, 2**32, 1500).tolist(), strict=True))
    columns = ["src", "dst"] + (["w"] if kind == "csr_weighted" else [])
    df = spark.createDataFrame(rows, "src long, dst long, w long").select(*columns).repartition(4)
    path = str(tmp_path / "g")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    csr.write_csr_folder(df.limit(10), path, 300, kind, wide)
    csr.write_csr_folder(df, path, 300, kind, wide)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    said = csr.manifest(path)
    assert said["edges"] == 1500 and len(said["parts"]) > 1 and csr.vertex_count(path, wide) == 300
    assert {p.name.partition(".")[0] for p in (tmp_path / "g").iterdir()} == {"manifest", *(["in"] if kind == "mix" else []), *(p["name"] for p in said["parts"])}
    read = spark.read.format("csr").option("format", kind).option("wide", wide)
    want = sorted(t[: len(columns)] for t in rows)
    assert sorted(map(tuple, read.load(path).collect())) == want
    if kind == "mix":
        assert sorted(map(tuple, read.option("side", "in").load(path).collect())) == want
        assert sorted(map(tuple, read.option("side", "in").load(path).where("dst in (5, 200)").collect())) == [t for t in want if t[1] in (5, 200)]
    assert Graph.load(spark, path, kind, wide).counts() == (300, 1500)
    with pytest.raises(Exception, match="holds format"):
        spark.read.format("csr").option("format", "csr" if kind != "csr" else "mix").option("wide", wide).load(path).collect()
    csr.write_csr_folder(df.limit(0), path, 300, kind, wide)
    assert csr.manifest(path)["parts"] == [] and read.load(path).count() == 0


def test_folder_refuses_unsorted_rows(spark, tmp_path):
    csr.register(spark)
    df = spark.createDataFrame([(2, 0), (1, 0)], "src long, dst long").coalesce(1)
    with pytest.raises(Exception, match="sorted"):
        df.write.format("csr").option("layout", "folder").option("vertices", 3).mode("overwrite").save(str(tmp_path / "g"))


CONDITIONS = [
    ("src = 70", lambda s, d: s == 70), ("src in (3, 70, 8, 999)", lambda s, d: s in (70, 8)), ("src > 100 and src <= 140", lambda s, d: 100 < s <= 140), ("src < 10", lambda s, d: s < 10),
    ("src >= 230 and dst > 100", lambda s, d: s >= 230 and d > 100), ("src in (8, 10) and src > 8", lambda s, d: s == 10), ("src > 5 and src < 3", lambda s, d: False), ("dst = 4", lambda s, d: d == 4),
    ("src is null", lambda s, d: False), ("src = 8 or src = 10", lambda s, d: s in (8, 10)),
]


@pytest.mark.parametrize("folder", [False, True])
def test_filters_choose_slices(spark, tmp_path, folder):
    r = np.random.default_rng(6)
    rows = list(zip((r.integers(0, 120, 1500) * 2).tolist(), r.integers(0, 300, 1500).tolist(), strict=True))
    path = str(tmp_path / "g")
    (csr.write_csr_folder if folder else csr.write_csr)(spark.createDataFrame(rows, "src long, dst long"), path, 300)
    read = spark.read.format("csr").load(path)
    for text, keeps in CONDITIONS:
        assert sorted(map(tuple, read.where(text).collect())) == sorted(t for t in rows if keeps(*t)), text
    for filters, keeps in (
        ([csr.In(("src",), (8, 70, 999))], lambda s: s in (8, 70)), ([csr.GreaterThan(("src",), 100), csr.LessThanOrEqual(("src",), 140)], lambda s: 100 < s <= 140),
        ([csr.EqualTo(("dst",), 4)], lambda s: True), ([csr.EqualTo(("src",), 8), csr.EqualTo(("src",), 9)], lambda s: False),
    ):
        reader = csr._Reader({"path": path})
        assert list(reader.pushFilters(filters)) == filters
        held = reader.partitions()
        assert sum(p.hi - p.lo for p in held) == sum(keeps(s) for s, _ in rows)
        got = [t for p in held for b in reader.read(p) for t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted(got) == sorted(t for t in rows if keeps(t[0]))


def test_merge_of_runs(tmp_path):
    r, runs, rows = np.random.default_rng(7), [], []
    for k in range(9):
        x = np.stack([r.integers(5 * k, 5 * k + 15, 40), r.integers(0, 4, 40)], axis=1)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        (tmp_path / str(k)).write_bytes(x.tobytes())
        runs.append(csr.Run(str(tmp_path / str(k)), 40, 2, tuple(x[0].tolist()), 7))
        rows += x.tolist()
    assert np.concatenate(list(csr.merged(runs))).tolist() == sorted(rows)


@pytest.mark.parametrize("edges, options", [
    ([(7, 0)], {"vertices": 3}), ([(0, 2**32 + 5)], {"vertices": 2**31}), ([(-1, 0)], {"vertices": 3}), ([(0, None)], {"vertices": 3}),
    ([(0, 1)], {"vertices": 2**31 + 1}), ([(0, 1)], {}), ([(0, 1)], {"vertices": 2, "format": "other"}),
])
def test_what_does_not_fit_is_refused(spark, tmp_path, edges, options):
    csr.register(spark)
    path = tmp_path / "g.bin"
    path.write_bytes(b"before")
    w = spark.createDataFrame(edges, "src long, dst long").write.format("csr")
    for k, v in options.items():
        w = w.option(k, v)
    with pytest.raises(Exception):
        w.mode("overwrite").save(str(path))
    assert path.read_bytes() == b"before"


def test_append_is_refused(spark, tmp_path):
    path = str(tmp_path / "g.bin")
    one = spark.createDataFrame([(0, 1)], "src long, dst long")
    csr.write_csr(one, path, 2)
    with pytest.raises(Exception, match="append"):
        one.write.format("csr").option("vertices", 2).mode("append").save(path)
    assert spark.read.format("csr").load(path).count() == 1
    with pytest.raises(ValueError, match="in-edges"):
        csr.CsrFile(path, side="in")
    none = one.limit(0)
    csr.write_csr(none, path, 2, "mix")
    assert csr.CsrFile(path, "mix").e == 0 and spark.read.format("csr").option("format", "mix").load(path).count() == 0


def test_graph_from_file(spark, tmp_path):
    path = str(tmp_path / "g.bin")
    df = spark.createDataFrame(EDGES, "src long, dst long, w long")
    csr.write_csr(df, path, 9, "csr_weighted")
    g = Graph.load(spark, path, "csr_weighted").saved()
    assert g.weighted and g.counts() == (9, len(EDGES))
    assert {r.id: r.level for r in A.bfs(g, 0).state.collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: None, 7: 3, 8: None}
    g.release()


def test_executors_need_no_package(tmp_path):
    """What tasks are sent can be read where the package isn't on the path."""
    from pyspark import cloudpickle

    (tmp_path / "x").write_bytes(cloudpickle.dumps((csr.CsrSource, csr._Reader({"path": "p"}))))
    code = f"import pickle, sys; c, r = pickle.loads(open({str(tmp_path / 'x')!r}, 'rb').read()); assert not any(m.startswith('meshspark') for m in sys.modules); print(c.name(), r.path)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split() == ["csr", "p"]


def test_layout():
    raw = csr.encode(np.array([1, 0]), np.array([0, 1]), 3)
    assert np.frombuffer(raw, "<u4").tolist() == [3, 2, 0, 1, 2, 1, 0]


def test_short_file(tmp_path):
    p = tmp_path / "bad.bin"
    p.write_bytes(csr.encode(np.array([0, 1]), np.array([1, 0]), 2)[:-1])
    with pytest.raises(ValueError):
        csr.CsrFile(str(p))


def test_text(spark, tmp_path):
    csr.write_edge_list(spark.createDataFrame([(1, 2)], "src long, dst long"), str(tmp_path / "e"))
    csr.write_top(spark.createDataFrame([(0.5,), (2.25,)], "x double"), "x", str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()] == ["1, 2"]
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["2.250000", "0.500000"]
