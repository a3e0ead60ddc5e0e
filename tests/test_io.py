"""Files, streams, and results of experiments."""

import struct

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import access, results
from loomgraph.operators.graph import Graph
from loomgraph.plans import workspace
from loomgraph.sources import binary, convert, generate
from loomgraph.streaming.ingest import ConcurrentChange, EdgeStore, visible_prefix

PAIRS = [(0, 1), (5, 2), (2, 2), (9, 0), (5, 1)]


def edges(spark, pairs=PAIRS):
    return spark.createDataFrame(pairs, "src long, dst long")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("bits", [32, 64])
def test_binary_round_trip(spark, tmp_path, bits):
    path = str(tmp_path / "e")
    binary.write_edges(edges(spark), path, bits)
    assert rows(binary.read_edges(spark, path, bits)) == sorted(PAIRS)
    binary.write_edges(edges(spark, [(1, 1)]), path, bits)  # replaces
    assert rows(binary.read_edges(spark, path, bits)) == [(1, 1)]
    binary.write_edges(edges(spark, [(2, 2)]), path, bits, mode="append")
    assert rows(binary.read_edges(spark, path, bits)) == [(1, 1), (2, 2)]


def test_binary_segments(spark, tmp_path):
    f = tmp_path / "one.bin"
    f.write_bytes(b"".join(struct.pack("<2I", *p) for p in PAIRS) + b"\1\2\3")  # with an incomplete record
    path = str(f)
    assert rows(binary.read_edges(spark, path, 32)) == sorted(PAIRS)
    assert rows(binary.read_edges(spark, path, 32, records=2)) == sorted(PAIRS[:2])
    assert rows(binary.read_edges(spark, path, 32, offset=16, records=2)) == sorted(PAIRS[2:4])
    assert rows(binary.read_edges(spark, path, 32, offset=8, records=99)) == sorted(PAIRS[1:])
    assert rows(binary.read_edges(spark, path, 32, offset=4000)) == []


def test_binary_weights_and_limits(spark, tmp_path):
    f = tmp_path / "w.bin"
    f.write_bytes(struct.pack("<6Q", 1, 2, 30, 4, 5, 60))
    assert rows(binary.read_edges(spark, str(f), 64, weighted=True)) == [(1, 2, 30), (4, 5, 60)]
    f.write_bytes(struct.pack("<2Q", 1 << 63, 0))
    with pytest.raises(Exception, match="2\\*\\*63"):
        binary.read_edges(spark, str(f)).collect()


def test_text(spark, tmp_path):
    f = tmp_path / "e.txt"
    f.write_text("# c\n1 2 9\nbad\n3\t4\n")
    assert rows(convert.read_text(spark, str(f), skip_header=1)) == [(1, 2), (3, 4)]
    f.write_text("7 7\n1 2\n")
    assert rows(convert.read_text(spark, str(f), skip_header=1)) == [(1, 2)]
    out = str(tmp_path / "out")
    convert.write_text(edges(spark), out)
    assert rows(convert.read_text(spark, out)) == sorted(PAIRS)


def test_converters(spark):
    big = edges(spark, [((1 << 32) + 5, 7)])
    assert rows(convert.truncated(big)) == [(5, 7)]
    assert [tuple(r) for r in convert.sorted_edges(edges(spark)).collect()] == sorted(PAIRS)
    assert rows(convert.shuffled_edges(edges(spark), 3)) == sorted(PAIRS)
    g = Graph(edges(spark))
    offsets = {r["v"]: (r["degree"], r["first"]) for r in convert.csr_offsets(g).collect()}
    assert offsets[0] == (1, 0) and offsets[5] == (2, 2) and offsets[9] == (1, 4) and len(offsets) == 10
    assert [r["dst"] for r in convert.csr_adjacency(edges(spark)).orderBy("place").collect()] == [1, 2, 1, 2, 0]
    index = convert.csr_index_bytes([offsets[v][0] for v in range(10)], 5)
    assert index[:32] == struct.pack("<4Q", 0, 0, 10, 5) and len(index) == 64 + 64
    assert len(convert.adjacency_bytes([1, 2])) == 4096


def test_generators(spark):
    r = generate.random_edges(spark, 50, 1000)
    assert r.count() == 1000 and r.where("src < 0 or src > 49 or dst < 0 or dst > 49").isEmpty()
    assert sorted(x["v"] for x in generate.permutation(spark, 3, 30).collect()) == list(range(3, 30))


@pytest.mark.parametrize("n", [1, 16, 2500])
def test_csr_files(spark, tmp_path, n):
    pairs = [(i * 7 % n, i * 13 % n) for i in range(3 * n)]
    g = Graph(edges(spark, pairs).repartition(3), n)
    convert.write_csr(g, str(tmp_path / "csr"))
    whole = lambda name: b"".join(p.read_bytes() for p in sorted((tmp_path / "csr" / name).glob("part-*")))
    degrees = [0] * n
    for s, _ in pairs:
        degrees[s] += 1
    assert whole("index") == convert.csr_index_bytes(degrees, len(pairs))
    assert whole("adj") == convert.adjacency_bytes([d for _, d in sorted(pairs)])


def test_placed_neighbors(spark):
    pairs = [(5, i % 7) for i in range(300)] + [(i, 1) for i in range(10)]
    got = sorted(map(tuple, access.placed_neighbors(Graph(edges(spark, pairs).repartition(5))).collect()))
    want = []
    for v in range(10):
        want += [(v, k, d) for k, d in enumerate(sorted(d for s, d in pairs if s == v))]
    assert got == want


def three_versions(spark, path):
    store = EdgeStore(spark, path, width=64)
    for v in range(3):
        store.append(edges(spark, [(100 * v + j, j) for j in range(10)]), v)
    return store


def test_stream(spark, tmp_path):
    for i in range(3):
        edges(spark, [(100 * i + j, j) for j in range(10)]).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    store = EdgeStore(spark, str(tmp_path / "table"), width=64)
    stream = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    store.ingest(stream, str(tmp_path / "offsets")).awaitTermination()
    assert rows(store.versions()) == [(0, 10), (1, 10), (2, 10)]
    assert store.snapshot(1).edge_count == 20 and store.snapshot().edge_count == 30
    assert rows(store.scan(100, 103)) == [(100, 0), (101, 1), (102, 2)]
    store.append(edges(spark, [(1, 1)]), 2)  # delivered again: replaces its version
    assert store.snapshot().edge_count == 21
    assert store.compact(1) and store.snapshot().edge_count == 21
    assert rows(store.versions()) == [(0, 10), (1, 10), (2, 1)] and store.snapshot(0).edge_count == 10
    assert not store.compact(2, alpha=0.5)
    assert rows(store.scan(100, 103, version=1)) == [(100, 0), (101, 1), (102, 2)] and store.scan(100, 103, version=0).isEmpty()


def test_redelivery_after_compaction(spark, tmp_path):
    store = three_versions(spark, str(tmp_path / "table"))
    assert store.compact(2)
    for v in (2, 0):
        store.append(edges(spark, [(100 * v + j, j) for j in range(10)]), v)  # the newest and an older batch come again
    assert rows(store.snapshot().edges) == sorted((100 * v + j, j) for v in range(3) for j in range(10))
    assert rows(store.versions()) == [(0, 10), (1, 10), (2, 10)]


def test_failures_between_the_steps(spark, tmp_path, monkeypatch):
    store = three_versions(spark, str(tmp_path / "table"))
    before = store.snapshot()

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:  # the merged run is written, its manifest is not
        m.setattr(EdgeStore, "_publish", fail)
        with pytest.raises(OSError):
            store.compact(2)
        with pytest.raises(OSError):
            store.append(edges(spark, [(1, 1)]), 3)
    assert store.snapshot().edge_count == 30
    assert store.vacuum() == 2 and store.snapshot().edge_count == 30
    assert store.compact(2) and store.snapshot().edge_count == 30
    assert before.edges.count() == 30  # a reader of the manifest before
    store.append(edges(spark, [(1, 1)]), 3)
    assert store.vacuum(1) == 3 and store.snapshot().edge_count == 31
    with monkeypatch.context() as m:  # two writers that saw the same manifest
        m.setattr(EdgeStore, "_numbers", lambda self, n=store._numbers()[-1:]: n)
        store.append(edges(spark, [(2, 2)]), 4)
        with pytest.raises(ConcurrentChange):
            store.append(edges(spark, [(3, 3)]), 5)
    assert store.snapshot().edge_count == 32
    empty = EdgeStore(spark, str(tmp_path / "none"))
    assert empty.snapshot().edges.isEmpty() and empty.versions().isEmpty() and not empty.compact(3)
    empty.append(edges(spark, []), 0)
    assert empty.snapshot().edges.isEmpty()


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError):
        workspace.checkpoint_root(Session())


def test_visible_prefix(spark):
    w = spark.createDataFrame([(0, 300), (1, 140)], "writer int, edges long")
    assert visible_prefix(w, 128).first()[0] == 256


def test_results(spark):
    lines = spark.createDataFrame([("x [EXPOUT]Key name: 12.345s",), ("[EXPOUT]partitions: [16,32]",), ("none",), ("[EXPOUT]who: me",)], "value string")
    got = {r["key"]: r for r in results.parse_results(lines).collect()}
    assert got["key_name"]["num"] == 12.345 and got["partitions"]["list"] == [16.0, 32.0] and got["who"]["str"] == "me" and got["who"]["num"] is None
    data = [("a", float(x)) for x in (1, 1, 1, 1, 100)] + [("b", 1.0), ("b", 2.0), ("b", 100.0), ("c", float("nan"))]
    means = {r["k"]: r["mean"] for r in results.trimmed_means(spark.createDataFrame(data, "k string, x double"), ["k"], "x").collect()}
    assert means["a"] == 1.0 and abs(means["b"] - 103 / 3) < 1e-9 and means["c"] != means["c"]
    frame = spark.createDataFrame([("d", "s", 10, 2.0), ("d", "t", 10, 4.0)], "dataset string, system string, edges long, seconds double")
    assert {r["system"]: r["relative"] for r in results.normalise(frame, "system", "seconds", "s", ["dataset"]).collect()} == {"s": 1.0, "t": 2.0}
    assert results.throughput(frame).first()["meps"] == 10 / 2.0 / 1e6
    assert results.memory_table(frame, "dataset", "system", "seconds", ["s", "t"]).first()["least"] == "s"
    assert results.pivot(frame, "dataset", "system", "seconds", ["s", "t"], "mean").first()["t"] == 4.0


def test_latest_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.log").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert results.latest_files(files, 2).count() == 2
