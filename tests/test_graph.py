"""Operators on graphs with known answers, and properties on a random one."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import access, components, dispatch, keyed, ranking, statistics, traversal, triangles
from loomgraph.operators.graph import Graph, reverse, symmetrize, undirected
from loomgraph.plans.workspace import Workspace
from loomgraph.sources import generate


def graph(spark, pairs, n=None):
    return Graph(spark.createDataFrame(pairs, "src long, dst long"), n)


def as_dict(df, key="v"):
    return {r[key]: r[[c for c in df.columns if c != key][0]] for r in df.collect()}


@pytest.fixture(scope="module")
def random_pairs():
    rng = random.Random(5)
    return [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]


def test_multigraph_degrees(spark):
    g = graph(spark, [(0, 1), (0, 1), (1, 2)])
    assert as_dict(access.out_degrees(g)) == {0: 2, 1: 1, 2: 0}
    assert as_dict(access.all_degrees(g)) == {0: 2, 1: 3, 2: 1}
    assert g.edge_count == 3 and g.vertex_count == 3


def test_isolated_ids(spark):
    g = graph(spark, [(0, 5)])
    assert g.vertex_count == 6
    assert as_dict(components.connected_components(g)) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0}
    assert as_dict(traversal.bfs(g, 0)) == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 2}


def test_chain(spark):
    g = Graph(generate.chain(spark, 40))
    assert as_dict(traversal.bfs(g, 0)) == {i: i + 1 for i in range(41)}
    assert set(as_dict(components.connected_components(g)).values()) == {0}


def test_long_chain_of_shuffled_ids(spark):
    ids = list(range(400))
    random.Random(1).shuffle(ids)
    g = graph(spark, list(zip(ids, ids[1:])))
    assert set(as_dict(components.connected_components(g)).values()) == {0}


def test_clique(spark):
    g = Graph(generate.cliques(spark, 20))
    assert g.edge_count == 380
    assert triangles.triangle_count(g).first()[0] == triangles.triangle_count_by_lists(g).first()[0] == 1140
    assert all(abs(r["score"] - 0.05) < 1e-12 for r in ranking.pagerank(g, 10).collect())


def test_disjoint_cliques(spark):
    g = Graph(generate.cliques(spark, 5, copies=7))
    labels = as_dict(components.connected_components(g))
    assert labels == {v: v // 5 * 5 for v in range(35)}
    report = components.component_report(components.connected_components(g)).collect()
    assert [r["component"] for r in report] == [30, 25, 20, 15, 10] and {r["components"] for r in report} == {7}


def test_acyclic_clique(spark):
    g = Graph(generate.cliques(spark, 20, acyclic=True))
    assert g.edge_count == 190
    assert as_dict(traversal.bfs(g, 19))[19] == 1 and sum(as_dict(traversal.bfs(g, 19)).values()) == 1


def test_binary_tree(spark):
    g = Graph(generate.binary_tree(spark, 63))
    counts = as_dict(traversal.frontier_counts(traversal.bfs(g, 1)), "level")
    assert counts == {i + 1: 2**i for i in range(6)} | {7: 62}  # 63 has no children, and 2 * 63 is no vertex
    assert symmetrize(g.edges).where("src = dst").isEmpty()


def test_batch_circle(spark):
    g = Graph(generate.batch_circle(spark, 4, 5))
    assert g.edge_count == 5 * (4 * 3 + 16)
    assert as_dict(traversal.frontier_counts(traversal.bfs(g, 0)), "level") == {1: 1, 2: 7, 3: 4, 4: 4, 5: 4}


def test_self_loops(spark):
    g = Graph(generate.self_loops(spark, 16, 3))
    assert set(as_dict(access.out_degrees(g)).values()) == {3}
    assert symmetrize(g.edges).isEmpty()
    assert all(abs(r["score"] - 1 / 16) < 1e-12 for r in ranking.pagerank(g, 10).collect())
    assert components.component_report(components.connected_components(g)).first()["components"] == 16


def test_empty_graph(spark):
    g = graph(spark, [])
    assert g.vertex_count == 0
    assert components.connected_components(g).isEmpty() and triangles.triangle_count(g).first()[0] == 0
    assert triangles.triangle_count_by_lists(g).first()[0] == 0


def test_bfs_properties(spark, random_pairs):
    g = graph(spark, random_pairs)
    down, up = as_dict(traversal.bfs(g, 3)), as_dict(traversal.bfs(g, 3, bottom_up=False))
    assert down == up
    assert as_dict(traversal.bfs_reverse(g, 3)) == as_dict(traversal.bfs(graph(spark, [(b, a) for a, b in random_pairs], g.vertex_count), 3))
    many = traversal.bfs_many(g, [3, 4])
    assert {r["v"]: r["level"] for r in many.where("root = 3").collect()} == {v: n for v, n in down.items() if n}


def test_long_chain_writes_few_tables(spark, monkeypatch):
    saved = []
    save = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, *a: saved.append(1) or save(self, *a))
    ids = list(range(150))
    random.Random(2).shuffle(ids)
    g = graph(spark, [(b, a) for a, b in zip(ids, ids[1:])])
    assert as_dict(traversal.bfs_reverse(g, ids[0])) == {v: i + 1 for i, v in enumerate(ids)}
    assert len(saved) <= 2


@pytest.mark.parametrize("narrow, ahead, kept", [(0, 0, 0), (3, 4, 2), (6, 100, 10), (1000, 10_000, 100_000)])
def test_bfs_by_driver_and_joins(spark, monkeypatch, narrow, ahead, kept):
    """A tail, a clique-like middle and a tail: the ways of expanding a level change in both directions."""
    for name, value in (("NARROW", narrow), ("AHEAD", ahead), ("KEPT", kept)):
        monkeypatch.setattr(traversal, name, value)
    rng = random.Random(7)
    middle = [(rng.randrange(8, 40), rng.randrange(8, 40)) for _ in range(100)]
    pairs = [(i, i + 1) for i in range(8)] + middle + [(20, 40)] + [(i, i + 1) for i in range(40, 47)] + [(44, 2), (9, 9)]
    levels, front = {0: 1}, [0]
    while front:
        front = sorted({b for a, b in pairs if a in front} - levels.keys())
        levels |= {v: max(levels.values()) + 1 for v in front}
    g = graph(spark, pairs, 50)
    assert as_dict(traversal.bfs(g, 0)) == {v: levels.get(v, 0) for v in range(50)}
    assert as_dict(traversal.bfs(g, 0, bottom_up=False, max_levels=9)) == {v: n if (n := levels.get(v, 0)) <= 9 else 0 for v in range(50)}
    assert set(as_dict(traversal.bfs(g, 77)).values()) == {0}


def test_components_against_union_find(spark, random_pairs):
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in random_pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    g = graph(spark, random_pairs, 60)
    assert as_dict(components.connected_components(g)) == {v: find(v) for v in range(60)}


def test_pagerank_against_loop(spark, random_pairs):
    n, out = 60, {}
    for a, b in random_pairs:
        out.setdefault(a, []).append(b)
    s = [1 / n] * n
    for _ in range(10):
        t = [0.15 / n] * n
        for a, bs in out.items():
            for b in bs:
                t[b] += 0.85 * s[a] / len(bs)
        s = t
    got = as_dict(ranking.pagerank(graph(spark, random_pairs, n), 10))
    assert all(abs(got[v] - s[v]) < 1e-12 for v in range(n))
    p = [0.15 if v in out else 0.0 for v in range(n)]
    for i in range(4):
        r = [0.0] * n
        for a, bs in out.items():
            for b in bs:
                r[b] += p[a]
        last = [0.15 + 0.85 * x for x in r]
        p = [last[v] / len(out[v]) if v in out else 0.0 for v in range(n)]
    got = as_dict(ranking.pagerank_push(graph(spark, random_pairs, n), 4))
    assert all(abs(got[v] - last[v]) < 1e-9 for v in range(n))


def test_hot_sources_in_parts(spark, random_pairs, monkeypatch):
    pairs = random_pairs + [(7, i) for i in range(60)] * 2
    g = graph(spark, pairs, 60)
    want = [as_dict(f(g)) for f in (lambda g: traversal.bfs(g, 3), lambda g: traversal.bfs(g, 7), ranking.pagerank)]
    many = sorted(map(tuple, traversal.bfs_many(g, [3, 7]).collect()))
    monkeypatch.setattr(keyed, "HOT_EDGES", 10)
    assert keyed.KeyedEdges(g.edges, g.edge_count).hot is not None
    got = [as_dict(f(g)) for f in (lambda g: traversal.bfs(g, 3), lambda g: traversal.bfs(g, 7), ranking.pagerank)]
    assert got[:2] == want[:2] and all(abs(got[2][v] - want[2][v]) < 1e-12 for v in range(60))
    assert sorted(map(tuple, traversal.bfs_many(g, [3, 7]).collect())) == many


def test_pagerank_stops(spark):
    g = Graph(generate.cliques(spark, 5))
    assert len(as_dict(ranking.pagerank(g, 50, epsilon=1e-6))) == 5
    report = ranking.rank_report(ranking.pagerank(g, 2)).collect()
    assert len(report) == 6 and report[-1]["what"] == "max" and report[-1]["v"] == 0


def test_access(spark, random_pairs):
    g = graph(spark, random_pairs, 60)
    ordered = {r["v"]: r["neighbors"] for r in access.ordered_neighbors(g).collect()}
    assert all(v == sorted(v) for v in ordered.values()) and sum(map(len, ordered.values())) == 90
    sample = access.sample_neighbors(g, 2).collect()
    assert {(r["v"], r["place"]): r["neighbor"] for r in sample} == {(v, i): x for v, n in ordered.items() for i, x in enumerate(n[:2])}
    assert access.range_scan(g, 10, 20).count() == sum(10 <= a < 20 for a, _ in random_pairs)
    frontier = spark.createDataFrame([(3,), (4,)], "v long")
    assert sorted(map(tuple, access.neighbors_out(g, frontier).collect())) == sorted((a, b) for a, b in random_pairs if a in (3, 4))
    assert sorted(map(tuple, access.neighbors_in(g, frontier).collect())) == sorted((b, a) for a, b in random_pairs if b in (3, 4))
    assert {r["v"] for r in access.with_neighbor_in(g, g.vertices(), frontier).collect()} == {b for a, b in random_pairs if a in (3, 4)}
    both = {r["v"]: r for r in access.adjacency(g, both=True).collect()}
    assert len(both) == 60 and both[3]["in_list"] == sorted(a for a, b in random_pairs if b == 3)
    assert {r["v"] for r in access.nonempty(g).collect()} == set(ordered)


def test_views(spark):
    g = graph(spark, [(0, 1), (2, 2)])
    assert sorted(map(tuple, reverse(g.edges).collect())) == [(1, 0), (2, 2)]
    assert undirected(g.edges).count() == 4
    assert g.add(spark.createDataFrame([(7, 1)], "src long, dst long")).vertex_count == 8
    assert g.add_undirected(spark.createDataFrame([(7, 1)], "src long, dst long")).edge_count == 4


def test_labels(spark):
    g = graph(spark, [(0, 1), (1, 2), (3, 4)])
    start = g.vertices().select("v", F.col("v").alias("component"))
    linked = components.link(start, g.edges)
    assert as_dict(linked) == {0: 0, 1: 0, 2: 1, 3: 3, 4: 3}
    assert as_dict(components.compress(linked)) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert tuple(components.most_frequent(components.compress(linked)).first()) == (0, 3)
    pairs = spark.createDataFrame([(0, 3), (1, 5), (2, 3)], "k int, x int")
    assert [tuple(r) for r in components.top_pairs(pairs, "k", "x", 2).collect()] == [(1, 5), (2, 3)]


def test_orders_and_prefixes(spark):
    keys = spark.createDataFrame([(k,) for k in [1, 1, 2, 2, 2, 4, 4, 4, 4]], "k long")
    assert [r["end"] for r in dispatch.group_index(keys, "k", 5).orderBy("k").collect()] == [0, 2, 5, 5, 9]
    values = spark.createDataFrame([(0, 3), (1, 1), (2, 2)], "v long, x long")
    assert [r["sum_before"] for r in dispatch.prefix_sums(values, "v", "x", blocks=2).orderBy("v").collect()] == [0, 3, 4]
    g = graph(spark, [(0, 1), (0, 2), (3, 1)], 5)
    assert as_dict(triangles.degree_relabel(g)) == {1: 0, 0: 1, 3: 2, 2: 3, 4: 4}


def test_greedy_schedule(spark):
    rng = random.Random(2)
    for sizes, workers in [([5, 3, 2, 4], 2), ([rng.randrange(50) for _ in range(30)], 4)]:
        heap = [(0, i) for i in range(workers)]
        for n in sizes:
            load, i = heapq.heappop(heap)
            heapq.heappush(heap, (load + n, i))
        row = spark.createDataFrame([(sizes,)], "s array<long>").select(dispatch.greedy_loads(F.col("s"), workers).alias("l")).first()
        assert row["l"] == [x for x, _ in sorted(heap, key=lambda h: h[1])]
    g = graph(spark, [(p, 0) for p, n in enumerate([5, 3, 2, 4]) for _ in range(n)])
    row = dispatch.work_imbalance(g.edges.withColumn("batch", F.lit(0)), 1, 4, 2).first()
    assert abs(row["ratio"] - 9 / 7) < 1e-12 and abs(row["utilisation"] - (1 + 5 / 9) / 2) < 1e-12


def test_partitions(spark):
    assert dispatch.bucket_shift(100, 8) == 4 and dispatch.bucket_shift(1, 8) == 0
    g = graph(spark, [(0, 9), (17, 3)])
    assert {r["partition"]: r["edges"] for r in dispatch.dispatch_by_shift(g.edges, 8, 2).collect()} == {0: 3, 1: 1}
    rows = dispatch.sorted_batches(g.edges.withColumn("batch", F.lit(0))).where("side = 'in'").orderBy("place").collect()
    assert [(r["src"], r["dst"]) for r in rows] == [(3, 17), (9, 0)]


def test_statistics(spark, random_pairs):
    g = graph(spark, random_pairs, 60)
    for side in ("out", "in", "all"):
        assert statistics.degree_histogram(g, side).agg(F.sum("vertices")).first()[0] == 60
        assert abs(statistics.degree_histogram_log(g, side).agg(F.sum("percent")).first()[0] - 100) < 1e-9
    split = statistics.degree_histogram_split(g, exact_below=2).collect()
    assert sum(r["vertices"] for r in split) == 60 and {r["kind"] for r in split} == {"exact", "log"}
    blocks = statistics.unit_blocks(g, 8)
    assert blocks.agg(F.sum("edges")).first()[0] == 90
    last = statistics.unit_cumulative(blocks).orderBy(F.desc("edges")).first()
    assert abs(last["blocks_percent"] - 100) < 1e-9 and abs(last["edges_percent"] - 100) < 1e-9
    degrees = sorted((sum(a == v for a, _ in random_pairs) for v in range(60)), reverse=True)
    top = max(a for a, _ in random_pairs)
    rows = {r["percent"]: r for r in statistics.skewness(g).collect()}
    assert rows[10]["vertices"] == top * 10 // 100 and rows[10]["edges"] == sum(degrees[: top * 10 // 100])
    assert tuple(statistics.density(graph(spark, [(0, 3)])).first()) == (4, 1, 0.25)


@pytest.mark.parametrize("small", [0, 40, components.SMALL])
def test_components_of_small_graphs(spark, monkeypatch, small):
    """Rounds, one task, and rounds that end in one task agree; one task writes two tables and no round."""
    monkeypatch.setattr(components, "SMALL", small)
    rng = random.Random(3)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3), (-5, 2), (-5, 2)]
    work = Workspace(spark, "small")
    found = {r["v"]: r["component"] for r in components.star_components(spark.createDataFrame(pairs, "u long, v long"), work).collect()}
    label = {v: v for p in pairs if None not in p and p[0] != p[1] for v in p}
    for _ in label:
        for u, v in pairs:
            if u in label and v in label:
                label[u] = label[v] = min(label[u], label[v])
    assert found == label
    if small == components.SMALL and small > len(pairs):
        assert work.count == 2
    assert components.star_components(spark.createDataFrame([], "u long, v long"), work).isEmpty()
