"""The registered graph queries, with equivalent DuckDB SQL where there is one.

The driver's tables hold no edge list; four graphs are derived from them, merging id spaces on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomgraph.functions.scalar import bit_width, div_up, round_up
from loomgraph.operators import access, components, dispatch, ranking, results, statistics, traversal, triangles
from loomgraph.operators.graph import Graph, reverse, symmetrize, undirected
from loomgraph.plans.workspace import Workspace
from loomgraph.sources import binary, convert, generate
from loomgraph.streaming.ingest import EdgeStore, visible_prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Each derived graph: its table, its columns, and its edges in SQL.
GRAPHS = {
    "order_part": ("lineitem", "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem"),
    "part_supp": ("lineitem", "SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem"),
    "cust_order": ("orders", "SELECT o_custkey AS src, o_orderkey AS dst FROM orders"),
    "user_next": (
        "events",
        "SELECT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY 1 ORDER BY ts, event_id) AS dst FROM events) AS n WHERE dst IS NOT NULL",
    ),
}


def edges_of(spark: SparkSession, sf_dir: str, name: str = "order_part") -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{GRAPHS[name][0]}.parquet")
    if name == "order_part":
        return table.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    if name == "part_supp":
        return table.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    if name == "cust_order":
        return table.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return _next_users(table)


def _next_users(events: DataFrame) -> DataFrame:
    """From each event's user to the next event's. Days are ordered apart; a day's last event is followed by the next day's first."""
    day = events.select(F.to_date("ts").alias("day"), "ts", "event_id", "user_id")
    inside = F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    rows = day.withColumn("dst", inside)
    first = day.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    following = first.select("day", F.lead("first").over(Window.orderBy("day")).alias("next_first"))  # one row a day
    full = rows.join(F.broadcast(following), "day")
    return full.select(F.col("user_id").alias("src"), F.coalesce("dst", "next_first").alias("dst")).where("dst IS NOT NULL")


def graph_of(spark: SparkSession, sf_dir: str, name: str = "order_part") -> Graph:
    return Graph(edges_of(spark, sf_dir, name))


def _with(name: str = "order_part", body: str = "", undirected_edges: bool = False, recursive: bool = False) -> str:
    """SQL with e (edges) and v (all vertices) of a graph."""
    return (
        f"WITH {'RECURSIVE ' if recursive else ''}e AS ({GRAPHS[name][1]}), top AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e), "
        f"v AS (SELECT unnest(range((SELECT n FROM top))) AS v){body}"
    )


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _deg(side: str, name: str = "order_part") -> str:
    ends = {"out": "SELECT src AS v FROM e", "in": "SELECT dst AS v FROM e", "all": "SELECT src AS v FROM e UNION ALL SELECT dst FROM e"}[side]
    return _with(name, f", c AS (SELECT v, count(*) AS n FROM ({ends}) AS x GROUP BY v), d AS (SELECT v.v, coalesce(c.n, 0) AS degree FROM v LEFT JOIN c USING (v))")


# ---- the graph and its versions


@query("vertex_count", _with() + " SELECT n AS vertices FROM top")
def vertex_count(spark, sf_dir):
    return edges_of(spark, sf_dir).agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("vertices"))


@query("edge_count", _with() + " SELECT count(*) AS edges FROM e")
def edge_count(spark, sf_dir):
    return edges_of(spark, sf_dir).agg(F.count("*").alias("edges"))


@query("reverse_edges", _with() + " SELECT dst AS src, src AS dst FROM e")
def reverse_edges(spark, sf_dir):
    return reverse(edges_of(spark, sf_dir))


@query("undirected_view", _with("part_supp") + " SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def undirected_view(spark, sf_dir):
    return undirected(edges_of(spark, sf_dir, "part_supp"))


@query("add_batch_directed", _with("cust_order") + " SELECT src, dst FROM e UNION ALL SELECT l_partkey, l_suppkey FROM lineitem")
def add_batch_directed(spark, sf_dir):
    return graph_of(spark, sf_dir, "cust_order").add(edges_of(spark, sf_dir, "part_supp")).edges


@query("add_batch_undirected", _with("cust_order") + " SELECT src, dst FROM e UNION ALL SELECT l_partkey, l_suppkey FROM lineitem UNION ALL SELECT l_suppkey, l_partkey FROM lineitem")
def add_batch_undirected(spark, sf_dir):
    return graph_of(spark, sf_dir, "cust_order").add_undirected(edges_of(spark, sf_dir, "part_supp")).edges


def _store(spark: SparkSession, sf_dir: str) -> EdgeStore:
    """The order-part graph ingested as a stream of four files, with a micro-batch for each."""
    root = Workspace(spark, "stream").root
    for i in range(4):
        edges_of(spark, sf_dir).where(F.col("src") % 4 == i).coalesce(1).write.parquet(f"{root}/in/{i}")
    store = EdgeStore(spark, f"{root}/table", width=1024)
    stream = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    store.ingest(stream, f"{root}/offsets").awaitTermination()
    return store


def _versions(spark: SparkSession, sf_dir: str) -> EdgeStore:
    """The order-part graph in four versions, each of the sources of one remainder."""
    store = EdgeStore(spark, f"{Workspace(spark, 'versions').root}/table", width=1024)
    for i in range(4):
        store.append(edges_of(spark, sf_dir).where(F.col("src") % 4 == i), i)
    return store


@query("snapshot_degrees", _deg("out") + " SELECT v, degree FROM d")
def snapshot_degrees(spark, sf_dir):
    """Degrees on the snapshot after a stream has been taken in."""
    return access.out_degrees(_store(spark, sf_dir).snapshot())


@query("snapshot_versions", _with() + " SELECT count(DISTINCT src % 4) AS versions, count(*) AS edges FROM e")
def snapshot_versions(spark, sf_dir):
    return _store(spark, sf_dir).versions().agg(F.count("*").alias("versions"), F.sum("edges").alias("edges"))


@query("stream_range_scan", _with() + " SELECT src, dst FROM e WHERE src >= 100 AND src < 400")
def stream_range_scan(spark, sf_dir):
    return _store(spark, sf_dir).scan(100, 400)


@query("range_scan_level", _with() + " SELECT src, dst FROM e WHERE src >= 100 AND src < 400 AND src % 4 = 2")
def range_scan_level(spark, sf_dir):
    """A scan of one version; each holds the sources of one remainder."""
    return _versions(spark, sf_dir).scan(100, 400, version=2)


@query("sample_k_level", _with("order_part", ", r AS (SELECT src AS v, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place, dst AS neighbor FROM e WHERE src % 4 = 1)") + " SELECT v, place, neighbor FROM r WHERE place < 2")
def sample_k_level(spark, sf_dir):
    """Two neighbours of each vertex in one of four versions."""
    return access.sample_neighbors(Graph(_versions(spark, sf_dir).scan(0, 1 << 40, version=1)), 2)


@query("visibility_prefix", _with() + ", w AS (SELECT src % 4 AS writer, count(*) AS n FROM e GROUP BY 1) SELECT CAST(min(n // 128) * 128 * count(*) AS BIGINT) AS visible FROM w")
def visibility_prefix(spark, sf_dir):
    written = edges_of(spark, sf_dir).groupBy((F.col("src") % 4).alias("writer")).agg(F.count("*").alias("edges"))
    return visible_prefix(written, 128)


# ---- access


@query("degree_out", _deg("out") + " SELECT v, degree FROM d")
def degree_out(spark, sf_dir):
    return access.out_degrees(graph_of(spark, sf_dir))


@query("degree_in", _deg("in") + " SELECT v, degree FROM d")
def degree_in(spark, sf_dir):
    return access.in_degrees(graph_of(spark, sf_dir))


@query("degree_all", _deg("all", "part_supp") + " SELECT v, degree FROM d")
def degree_all(spark, sf_dir):
    return access.all_degrees(graph_of(spark, sf_dir, "part_supp"))


@query("nonempty_vertices", _with() + " SELECT DISTINCT src AS v FROM e")
def nonempty_vertices(spark, sf_dir):
    return access.nonempty(graph_of(spark, sf_dir))


@query("neighbors_vector", _with("part_supp") + " SELECT src, dst FROM e WHERE src = 7")
def neighbors_vector(spark, sf_dir):
    return access.range_scan(graph_of(spark, sf_dir, "part_supp"), 7, 8)


def _frontier(g: Graph) -> DataFrame:
    """The stated set of query vertices: every one whose id is divisible by 20."""
    return g.vertices().where("v % 20 = 0")


@query("neighbors_out", _with() + " SELECT src AS v, dst AS neighbor FROM e WHERE src % 20 = 0")
def neighbors_out(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return access.neighbors_out(g, _frontier(g))


@query("neighbors_in", _with() + " SELECT dst AS v, src AS neighbor FROM e WHERE dst % 20 = 0")
def neighbors_in(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return access.neighbors_in(g, _frontier(g))


@query("neighbors_exists", _with() + " SELECT v FROM v WHERE v IN (SELECT dst FROM e WHERE src % 20 = 0)")
def neighbors_exists(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return access.with_neighbor_in(g, g.vertices(), _frontier(g))


@query("range_scan", _with() + " SELECT src, dst FROM e WHERE src >= 500 AND src < 900")
def range_scan(spark, sf_dir):
    return access.range_scan(graph_of(spark, sf_dir), 500, 900)


@query("ordered_neighbors", _with() + " SELECT src AS v, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM e GROUP BY src")
def ordered_neighbors(spark, sf_dir):
    return access.ordered_neighbors(graph_of(spark, sf_dir)).select("v", F.size("neighbors").alias("n"), F.array_join("neighbors", ",").alias("neighbors"))


@query("sample_k", _with("part_supp", ", r AS (SELECT src AS v, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place, dst AS neighbor FROM e)") + " SELECT v, place, neighbor FROM r WHERE place < 3")
def sample_k(spark, sf_dir):
    return access.sample_neighbors(graph_of(spark, sf_dir, "part_supp"), 3)


@query("placed_neighbors", _with() + " SELECT src AS v, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place, dst AS neighbor FROM e")
def placed_neighbors(spark, sf_dir):
    return access.placed_neighbors(graph_of(spark, sf_dir))


@query("weighted_neighbors", "SELECT l_orderkey AS v, l_partkey AS neighbor, CAST(l_quantity AS BIGINT) AS weight FROM lineitem WHERE l_orderkey % 20 = 0")
def weighted_neighbors(spark, sf_dir):
    """Neighbours with their weights, through a binary file of weighted records."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    path = Workspace(spark, "weighted").root
    rows = table.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"))
    binary.write_edges(rows, path, weighted=True)
    g = Graph(binary.read_edges(spark, path, weighted=True))
    return access.neighbors_out(g, _frontier(g))


@query("compacted_versions", "WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT src, dst FROM e WHERE src % 4 < 3")
def compacted_versions(spark, sf_dir):
    """A snapshot of three of four versions after compaction has merged them all."""
    store = _versions(spark, sf_dir)
    store.compact(3, alpha=100.0)
    return store.snapshot(2).edges


_LISTS = ", o AS (SELECT src AS v, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS l FROM e GROUP BY src), i AS (SELECT dst AS v, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS l FROM e GROUP BY dst)"


@query("adjacency_oneway", _with("order_part", _LISTS) + " SELECT v.v, coalesce(o.l, '') AS out_list FROM v LEFT JOIN o USING (v)")
def adjacency_oneway(spark, sf_dir):
    return access.adjacency(graph_of(spark, sf_dir)).select("v", F.array_join("out_list", ",").alias("out_list"))


@query("adjacency_twoway", _with("order_part", _LISTS) + " SELECT v.v, coalesce(o.l, '') AS out_list, coalesce(i.l, '') AS in_list FROM v LEFT JOIN o USING (v) LEFT JOIN i USING (v)")
def adjacency_twoway(spark, sf_dir):
    return access.adjacency(graph_of(spark, sf_dir), both=True).select("v", F.array_join("out_list", ",").alias("out_list"), F.array_join("in_list", ",").alias("in_list"))


# ---- sources, sinks, converters


def _file(spark: SparkSession, sf_dir: str, bits: int = 64, name: str = "order_part") -> str:
    path = Workspace(spark, "edges").root
    binary.write_edges(edges_of(spark, sf_dir, name), path, bits)
    return path


@query("load_dataset", _with() + " SELECT n AS vertices, (SELECT count(*) FROM e) AS edges, (SELECT CAST(sum(src * 3 + dst) AS BIGINT) FROM e) AS checksum FROM top")
def load_dataset(spark, sf_dir):
    """Through a binary file of 32-bit records and back."""
    rows = binary.read_edges(spark, _file(spark, sf_dir, 32), 32)
    return rows.agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("vertices"), F.count("*").alias("edges"), F.sum(F.col("src") * 3 + F.col("dst")).alias("checksum"))


def _sorted_file(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A single file of sorted 64-bit records; returns the folder and the file."""
    path = Workspace(spark, "edges").root
    binary.write_edges(edges_of(spark, sf_dir, "cust_order").coalesce(1).sortWithinPartitions("src", "dst"), path)
    return path, path


@query("scan_head", _with("cust_order") + " SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY src, dst) AS n FROM e) AS r WHERE n <= 100")
def scan_head(spark, sf_dir):
    """The first hundred records of a file."""
    return binary.read_edges(spark, _sorted_file(spark, sf_dir)[0], records=100)


@query("scan_segment", _with("cust_order") + " SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY src, dst) AS n FROM e) AS r WHERE n > 250 AND n <= 450")
def scan_segment(spark, sf_dir):
    """Two hundred records from a byte offset."""
    return binary.read_edges(spark, _sorted_file(spark, sf_dir)[0], offset=250 * 16, records=200)


@query("edges_to_text", _with() + " SELECT CAST(src AS VARCHAR) || ' ' || CAST(dst AS VARCHAR) AS value FROM e")
def edges_to_text(spark, sf_dir):
    return convert.edge_lines(edges_of(spark, sf_dir))


@query("text_to_edges", _with() + " SELECT src, dst FROM e")
def text_to_edges(spark, sf_dir):
    """Through text with a trailing column, and lines that are no edges."""
    lines = convert.edge_lines(edges_of(spark, sf_dir)).select(F.concat("value", F.lit(" x")).alias("value"))
    return convert.parse_edges(lines.unionByName(spark.createDataFrame([("# c",), ("bad 1",), ("",)], "value string")))


@query("edges_to_b32", _with() + " SELECT (src + 4294967290) % 4294967296 AS src, dst FROM e")
def edges_to_b32(spark, sf_dir):
    return convert.truncated(edges_of(spark, sf_dir).select((F.col("src") + 4294967290).alias("src"), "dst"))


_SYMMETRIC = ", s AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst)"


@query("symmetrize", _with("part_supp", _SYMMETRIC) + " SELECT src, dst FROM s")
def symmetrized(spark, sf_dir):
    return symmetrize(edges_of(spark, sf_dir, "part_supp"))


@query("sort_edges", _with() + " SELECT src, dst FROM e ORDER BY src, dst")
def sort_edges(spark, sf_dir):
    return convert.sorted_edges(edges_of(spark, sf_dir))


@query("shuffle_edges", _with() + " SELECT src, dst FROM e")
def shuffle_edges(spark, sf_dir):
    """The same edges in random order."""
    return convert.shuffled_edges(edges_of(spark, sf_dir), 0)


_OFFSETS = ", f AS (SELECT v, degree, sum(degree) OVER (ORDER BY v) - degree AS first FROM d)"


@query("csr_degrees", _deg("out", "part_supp") + " SELECT v, degree FROM d")
def csr_degrees(spark, sf_dir):
    return access.out_degrees(graph_of(spark, sf_dir, "part_supp"))


@query("csr_offsets", _deg("out") + _OFFSETS + " SELECT v, degree, CAST(first AS BIGINT) AS first FROM f WHERE v % 16 = 0")
def csr_offsets(spark, sf_dir):
    return convert.csr_offsets(graph_of(spark, sf_dir), 16)


@query("csr_adjacency", _with() + " SELECT src AS v, row_number() OVER (ORDER BY src, dst) - 1 AS place, dst FROM e")
def csr_adjacency(spark, sf_dir):
    return convert.csr_adjacency(edges_of(spark, sf_dir))


@query("out_degree_dump", _deg("out", "cust_order") + " SELECT v, degree FROM d")
def out_degree_dump(spark, sf_dir):
    return access.out_degrees(graph_of(spark, sf_dir, "cust_order"))


@query("gen_toy_chain", "SELECT range AS src, range + 1 AS dst FROM range(1000)")
def gen_toy_chain(spark, sf_dir):
    return generate.chain(spark, 1000)


@query("gen_toy_k20", "SELECT a.range AS src, b.range AS dst FROM range(20) AS a, range(20) AS b WHERE a.range <> b.range")
def gen_toy_k20(spark, sf_dir):
    return generate.cliques(spark, 20)


@query("gen_toy_tree", "SELECT range AS src, 2 * range AS dst FROM range(16383) UNION ALL SELECT range, 2 * range + 1 FROM range(16383)")
def gen_toy_tree(spark, sf_dir):
    return generate.binary_tree(spark, 16383)


@query("gen_toy_k50", "SELECT c * 50 + a AS src, c * 50 + b AS dst FROM range(1000) AS x(c), range(50) AS y(a), range(50) AS z(b) WHERE a <> b")
def gen_toy_k50(spark, sf_dir):
    return generate.cliques(spark, 50, copies=1000)


@query("gen_toy_k20d", "SELECT a.range AS src, b.range AS dst FROM range(20) AS a, range(20) AS b WHERE a.range < b.range")
def gen_toy_k20d(spark, sf_dir):
    return generate.cliques(spark, 20, acyclic=True)


@query(
    "gen_toy_circle",
    "SELECT c * 128 + a AS src, c * 128 + b AS dst FROM range(64) AS x(c), range(128) AS y(a), range(128) AS z(b) WHERE a <> b "
    "UNION ALL SELECT c * 128 + a, (c + 1) % 64 * 128 + b FROM range(64) AS x(c), range(128) AS y(a), range(128) AS z(b)",
)
def gen_toy_circle(spark, sf_dir):
    return generate.batch_circle(spark, 128, 64)


@query("gen_toy_selfloop", "SELECT v AS src, v AS dst FROM range(64) AS x(v), range(32) AS y(k)")
def gen_toy_selfloop(spark, sf_dir):
    return generate.self_loops(spark, 64, 32)


@query("gen_toy_selfloop_large", "SELECT v AS src, v AS dst FROM range(1024) AS x(v), range(32) AS y(k)")
def gen_toy_selfloop_large(spark, sf_dir):
    return generate.self_loops(spark, 1024, 32)


@query(
    "gen_random_edges",
    "SELECT " + ", ".join(f"CAST('0x' || substr(md5('0:' || range || ':{k}'), 1, 15) AS BIGINT) % 1048576 AS {n}" for k, n in enumerate(("src", "dst"))) + " FROM range(65536)",
)
def gen_random_edges(spark, sf_dir):
    return generate.random_edges(spark, 1 << 20, 1 << 16)


@query("gen_permutation", "SELECT range AS v FROM range(100, 5000)")
def gen_permutation(spark, sf_dir):
    return generate.permutation(spark, 100, 5000)


# ---- traversal


def _bfs_sql(name: str, turned: bool = False, cap: int = 60) -> str:
    a, b = ("dst", "src") if turned else ("src", "dst")
    body = f", r(v, lvl) AS (SELECT 0, 1 UNION SELECT e.{b}, lvl + 1 FROM r JOIN e ON e.{a} = r.v WHERE lvl < {cap}), m AS (SELECT v, min(lvl) AS level FROM r GROUP BY v)"
    return _with(name, body, recursive=True)


@query("bfs", _bfs_sql("order_part") + " SELECT v.v, CAST(coalesce(m.level, 0) AS INTEGER) AS level FROM v LEFT JOIN m USING (v)")
def bfs(spark, sf_dir):
    return traversal.bfs(graph_of(spark, sf_dir), 0)


@query("bfs_oneway", _bfs_sql("user_next") + " SELECT v.v, CAST(coalesce(m.level, 0) AS INTEGER) AS level FROM v LEFT JOIN m USING (v)")
def bfs_oneway(spark, sf_dir):
    """Expanded from the frontier only."""
    return traversal.bfs(graph_of(spark, sf_dir, "user_next"), 0, bottom_up=False)


@query("bfs_frontier_counts", _bfs_sql("order_part") + " SELECT CAST(level AS INTEGER) AS level, count(*) AS vertices FROM m GROUP BY level")
def bfs_frontier_counts(spark, sf_dir):
    return traversal.frontier_counts(bfs(spark, sf_dir))


@query("bfs_reverse", _bfs_sql("cust_order", turned=True) + " SELECT v.v, CAST(coalesce(m.level, 0) AS INTEGER) AS level FROM v LEFT JOIN m USING (v)")
def bfs_reverse(spark, sf_dir):
    return traversal.bfs_reverse(graph_of(spark, sf_dir, "cust_order"), 0)


@query(
    "bfs_multi20",
    _with("part_supp", ", r(root, v, lvl) AS (SELECT v, v, 1 FROM v WHERE v < 20 UNION SELECT r.root, e.dst, lvl + 1 FROM r JOIN e ON e.src = r.v WHERE lvl < 12)", recursive=True)
    + " SELECT root, v, CAST(min(lvl) AS INTEGER) AS level FROM r GROUP BY root, v",
)
def bfs_multi20(spark, sf_dir):
    return traversal.bfs_many(graph_of(spark, sf_dir, "part_supp"), list(range(20)))


# ---- ranking


def _rank_sql(name: str, steps: int, push: bool) -> str:
    body = ", w AS (SELECT src, dst, count(*) AS k FROM e GROUP BY src, dst), g AS (SELECT src, count(*) AS k FROM e GROUP BY src)"
    body += ", p0 AS (SELECT v.v, CASE WHEN g.src IS NULL THEN 0.0 ELSE 0.15 END AS s FROM v LEFT JOIN g ON g.src = v.v)" if push else ", p0 AS (SELECT v.v, 1.0 / n AS s FROM v, top)"
    base = "0.15" if push else "0.15 / (SELECT n FROM top)"
    for i in range(steps):
        part = "p.s * w.k" if push and i == 0 else "p.s * w.k / g.k"
        body += f", q{i} AS (SELECT w.dst AS v, sum({part}) AS x FROM w JOIN g ON g.src = w.src JOIN p{i} AS p ON p.v = w.src GROUP BY w.dst)"
        body += f", p{i + 1} AS (SELECT v.v, {base} + 0.85 * coalesce(q.x, 0) AS s FROM v LEFT JOIN q{i} AS q ON q.v = v.v)"
    return _with(name, body)


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", 9))


@query("pagerank_gap", _rank_sql("order_part", 10, False) + " SELECT v, round(CAST(s AS DOUBLE), 9) AS score FROM p10")
def pagerank_gap(spark, sf_dir):
    return _rounded(ranking.pagerank(graph_of(spark, sf_dir), 10))


def _converge_sql(name: str, steps: int, epsilon: float) -> str:
    """The first of so many scores whose total change is small enough."""
    body = _rank_sql(name, steps, False)
    for i in range(steps):
        body += f", c{i} AS (SELECT {i + 1} AS i, sum(abs(CAST(a.s AS DOUBLE) - b.s)) AS c FROM p{i + 1} AS a JOIN p{i} AS b USING (v))"
    changes = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(steps))
    scores = " UNION ALL ".join(f"SELECT {i + 1} AS i, v, s FROM p{i + 1}" for i in range(steps))
    return body + f", c AS ({changes}) SELECT v, round(CAST(s AS DOUBLE), 9) AS score FROM ({scores}) AS p WHERE i = (SELECT min(i) FROM c WHERE c < {epsilon})"


@query("pagerank_converge", _converge_sql("part_supp", 24, 1e-4))
def pagerank_converge(spark, sf_dir):
    """Until the total change is below 1e-4."""
    return _rounded(ranking.pagerank(graph_of(spark, sf_dir, "part_supp"), 100, epsilon=1e-4))


@query(
    "pr_report",
    _rank_sql("order_part", 10, False)
    + " SELECT 'first' AS what, v, round(CAST(s AS DOUBLE), 9) AS score FROM p10 WHERE v < 5 UNION ALL SELECT * FROM (SELECT 'max', v, round(CAST(s AS DOUBLE), 9) FROM p10 ORDER BY s DESC, v LIMIT 1) AS m",
)
def pr_report(spark, sf_dir):
    return _rounded(ranking.rank_report(ranking.pagerank(graph_of(spark, sf_dir), 10)))


@query("pagerank_push", _rank_sql("user_next", 10, True) + " SELECT v, round(CAST(s AS DOUBLE), 6) AS score FROM p10")
def pagerank_push(spark, sf_dir):
    return ranking.pagerank_push(graph_of(spark, sf_dir, "user_next"), 10).withColumn("score", F.round("score", 6))


@query("pagerank_pull", _rank_sql("part_supp", 10, True) + " SELECT v, round(CAST(s AS DOUBLE), 6) AS score FROM p10")
def pagerank_pull(spark, sf_dir):
    """The same recurrence, read by the targets."""
    return ranking.pagerank_pull(graph_of(spark, sf_dir, "part_supp"), 10).withColumn("score", F.round("score", 6))


# ---- components


def _wcc_sql(name: str, rounds: int = 48) -> str:
    """Labels fall to the least of the neighbourhood, then jump to their label's label, a fixed number of times."""
    body = ", b AS (SELECT DISTINCT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT v, v FROM v), l0 AS (SELECT v, v AS c FROM v)"
    for i in range(rounds):
        body += f", h{i} AS MATERIALIZED (SELECT b.src AS v, min(l.c) AS c FROM b JOIN l{i} AS l ON l.v = b.dst GROUP BY b.src)"
        body += f", l{i + 1} AS MATERIALIZED (SELECT h.v, least(h.c, g.c) AS c FROM h{i} AS h JOIN h{i} AS g ON g.v = h.c)"
    return _with(name, body + f", labels AS (SELECT v, c AS component FROM l{rounds})")


@query("connected_components", _wcc_sql("order_part") + " SELECT v, component FROM labels")
def connected_components(spark, sf_dir):
    return components.connected_components(graph_of(spark, sf_dir))


@query("cc_stats", _wcc_sql("cust_order", 90) + ", s AS (SELECT component, count(*) AS size FROM labels GROUP BY component) SELECT component, size, (SELECT count(*) FROM s) AS components FROM s ORDER BY size DESC, component DESC LIMIT 5")
def cc_stats(spark, sf_dir):
    return components.component_report(components.connected_components(graph_of(spark, sf_dir, "cust_order")))


@query("cc_frequent", _wcc_sql("order_part") + " SELECT component, count(*) AS size FROM labels GROUP BY component ORDER BY size DESC, component LIMIT 1")
def cc_frequent(spark, sf_dir):
    return components.most_frequent(components.connected_components(graph_of(spark, sf_dir)))


@query(
    "cc_link",
    _with("order_part", ", x AS (SELECT src AS v, dst AS c FROM e UNION ALL SELECT dst, src FROM e UNION ALL SELECT v, v FROM v)") + " SELECT v, min(c) AS component FROM x GROUP BY v",
)
def cc_link(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return components.link(g.vertices().select("v", F.col("v").alias("component")), g.edges)


@query(
    "cc_compress",
    _with("order_part", ", x AS (SELECT src AS v, dst AS c FROM e UNION ALL SELECT dst, src FROM e UNION ALL SELECT v, v FROM v), l AS (SELECT v, min(c) AS c FROM x GROUP BY v)")
    + " SELECT a.v, b.c AS component FROM l AS a JOIN l AS b ON b.v = a.c",
)
def cc_compress(spark, sf_dir):
    return components.compress(cc_link(spark, sf_dir))


@query("topk", _deg("out", "part_supp") + " SELECT v, degree FROM d ORDER BY degree DESC, v DESC LIMIT 10")
def topk(spark, sf_dir):
    return components.top_pairs(access.out_degrees(graph_of(spark, sf_dir, "part_supp")), "v", "degree", 10)


# ---- triangles and orders


def _triangles(name: str) -> str:
    return _with(name, _SYMMETRIC) + " SELECT count(*) AS triangles FROM s AS x JOIN s AS y ON x.dst = y.src JOIN s AS z ON z.dst = y.dst AND z.src = x.src"


@query("triangle_count", _triangles("order_part"))
def triangle_count(spark, sf_dir):
    return triangles.triangle_count(graph_of(spark, sf_dir))


@query("triangle_count_direct", _triangles("user_next"))
def triangle_count_direct(spark, sf_dir):
    return triangles.triangle_count(graph_of(spark, sf_dir, "user_next"))


@query("triangle_count_merge", _triangles("part_supp"))
def triangle_count_merge(spark, sf_dir):
    return triangles.triangle_count_by_lists(graph_of(spark, sf_dir, "part_supp"))


@query("degree_relabel", _deg("all") + " SELECT v, row_number() OVER (ORDER BY degree DESC, v DESC) - 1 AS new_id FROM d")
def degree_relabel(spark, sf_dir):
    return triangles.degree_relabel(graph_of(spark, sf_dir))


@query("prefix_sum", _deg("out", "part_supp") + " SELECT v, CAST(sum(degree) OVER (ORDER BY v) - degree AS BIGINT) AS sum_before FROM d")
def prefix_sum(spark, sf_dir):
    g = graph_of(spark, sf_dir, "part_supp")
    return dispatch.prefix_sums(access.out_degrees(g), "v", "degree", top=g.vertex_count).select("v", "sum_before")


@query("group_index", _deg("out", "part_supp") + " SELECT v, CAST(sum(degree) OVER (ORDER BY v) AS BIGINT) AS \"end\" FROM d")
def group_index(spark, sf_dir):
    g = graph_of(spark, sf_dir, "part_supp")
    return dispatch.group_index(g.edges.select(F.col("src").alias("v")), "v", g.vertex_count)


# ---- partitions and batches


@query("range_partition_id", _with() + " SELECT src // 1000 AS part, count(*) AS edges FROM e GROUP BY 1")
def range_partition_id(spark, sf_dir):
    return edges_of(spark, sf_dir).groupBy(dispatch.range_partition(F.col("src"), 1000).alias("part")).agg(F.count("*").alias("edges"))


@query("bucket_id", _with() + " SELECT src >> CAST(length(bin(CAST(ceil((n + 0.0) / 64) AS BIGINT) - 1)) AS INTEGER) AS bucket, count(*) AS edges FROM e, top GROUP BY 1")
def bucket_id(spark, sf_dir):
    g = graph_of(spark, sf_dir)
    return g.edges.groupBy(dispatch.bucket(F.col("src"), 0, g.vertex_count, 64).alias("bucket")).agg(F.count("*").alias("edges"))


@query("dispatch_shift", _with() + ", x AS (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) SELECT (v >> 9) % 8 AS partition, count(*) AS edges FROM x GROUP BY 1")
def dispatch_shift(spark, sf_dir):
    return dispatch.dispatch_by_shift(edges_of(spark, sf_dir), 1000, 8)


#: Edges of a batch; they arrive in the order of the tables' keys.
BATCH = 1 << 16


def _batches(spark, sf_dir, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{GRAPHS[name][0]}.parquet")
    if name == "cust_order":
        return dispatch.arrival_batches(table.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), ["dst"], BATCH)
    arrival = ["src", "l_linenumber"]
    return dispatch.arrival_batches(table.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber"), arrival, BATCH)


@query(
    "dispatch_sort",
    _with("cust_order", f", n AS (SELECT src, dst, (row_number() OVER (ORDER BY dst) - 1) // {BATCH} AS batch FROM e), s AS (SELECT batch, 'out' AS side, src, dst FROM n UNION ALL SELECT batch, 'in', dst, src FROM n)")
    + " SELECT batch, side, row_number() OVER (PARTITION BY batch, side ORDER BY src, dst) - 1 AS place, src, dst FROM s",
)
def dispatch_sort(spark, sf_dir):
    return dispatch.sorted_batches(_batches(spark, sf_dir, "cust_order"))


_GREEDY = f"""WITH RECURSIVE n AS (SELECT l_orderkey AS src, l_partkey AS dst, (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // {BATCH} AS batch FROM lineitem),
  w AS (SELECT CAST(ceil((max(greatest(src, dst)) + 1) / 64.0) AS BIGINT) AS width FROM n),
  c AS (SELECT batch, src // width AS p, count(*) AS n FROM n, w GROUP BY 1, 2),
  a AS (SELECT b.batch, r.range AS p, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT batch FROM c) AS b CROSS JOIN range(64) AS r LEFT JOIN c ON c.batch = b.batch AND c.p = r.range),
  g(batch, p, loads) AS (
    SELECT DISTINCT batch, CAST(0 AS BIGINT), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FROM a
    UNION ALL
    SELECT g.batch, g.p + 1, list_transform(g.loads, lambda x, i: CASE WHEN i = list_position(g.loads, list_min(g.loads)) THEN x + a.n ELSE x END)
    FROM g JOIN a ON a.batch = g.batch AND a.p = g.p
  ), l AS (SELECT CAST(list_max(loads) AS DOUBLE) AS top, CAST(list_sum(loads) AS DOUBLE) AS total FROM g WHERE p = 64)
  SELECT round(avg(top / (total / 8)), 9) AS ratio, round(avg(total / top / 8), 9) AS utilisation FROM l"""


@query("work_imbalance", _GREEDY)
def work_imbalance(spark, sf_dir):
    """Mean over batches of the greedy schedule."""
    g = graph_of(spark, sf_dir)
    rows = dispatch.work_imbalance(_batches(spark, sf_dir, "order_part"), max(1, -(-g.vertex_count // 64)), 64, 8)
    return rows.agg(F.round(F.avg("ratio"), 9).alias("ratio"), F.round(F.avg("utilisation"), 9).alias("utilisation"))


@query("scalar_math", _with("cust_order") + " SELECT src, (src + 6) // 7 AS up, (src + 6) // 7 * 7 AS rounded, CASE WHEN src = 0 THEN 0 ELSE length(bin(src)) END AS width FROM e")
def scalar_math(spark, sf_dir):
    s = F.col("src")
    return edges_of(spark, sf_dir, "cust_order").select(s, div_up(s, 7).alias("up"), round_up(s, 7).alias("rounded"), bit_width(s).cast("long").alias("width"))


# ---- statistics

_WIDTH = "CASE WHEN degree = 0 THEN 0 ELSE length(bin(degree)) END"


def _percent(of: str) -> str:
    return f"round(count(*) * 100.0 / (SELECT n FROM top), 9) AS {of}"


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _histogram(side: str):
    @query(f"degree_histogram_{side}", _deg(side) + f" SELECT degree, count(*) AS vertices, CAST({_percent('p')[:-5]} AS DOUBLE) AS percent FROM d WHERE degree < 1024 GROUP BY degree")
    def exact(spark, sf_dir):
        return _round(statistics.degree_histogram(graph_of(spark, sf_dir), side), "percent")

    @query(f"degree_histogram_log_{side}", _deg(side, "part_supp") + f" SELECT CAST({_WIDTH} AS INTEGER) AS width, count(*) AS vertices, CAST({_percent('p')[:-5]} AS DOUBLE) AS percent FROM d GROUP BY 1")
    def log(spark, sf_dir):
        return _round(statistics.degree_histogram_log(graph_of(spark, sf_dir, "part_supp"), side), "percent")


for _side in ("out", "in", "all"):
    _histogram(_side)


@query("degree_histogram_split", _deg("all", "part_supp") + f" SELECT CASE WHEN degree < 64 THEN 'exact' ELSE 'log' END AS kind, CASE WHEN degree < 64 THEN degree ELSE {_WIDTH} END AS bucket, count(*) AS vertices FROM d GROUP BY 1, 2")
def degree_histogram_split(spark, sf_dir):
    return statistics.degree_histogram_split(graph_of(spark, sf_dir, "part_supp"), "all", exact_below=64)


_UNITS = ", u AS (SELECT v // 16 AS block, CAST(sum(degree) AS BIGINT) AS edges, CAST(sum(CASE WHEN degree > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active, max(degree) AS max_degree FROM d GROUP BY 1)"
_POWERS = "(1, 2, 4, 8, 16, 32, 64)"


def _units(spark, sf_dir) -> DataFrame:
    return statistics.unit_blocks(graph_of(spark, sf_dir), 16)


@query("unit_distribution", _deg("out") + _UNITS + " SELECT block, edges, active, max_degree FROM u")
def unit_distribution(spark, sf_dir):
    return _units(spark, sf_dir)


@query("unit_edges_hist", _deg("out") + _UNITS + " SELECT edges, count(*) AS blocks FROM u GROUP BY edges")
def unit_edges_hist(spark, sf_dir):
    return statistics.unit_histogram(_units(spark, sf_dir), "edges")


@query("unit_active_hist", _deg("out") + _UNITS + " SELECT active, count(*) AS blocks FROM u GROUP BY active")
def unit_active_hist(spark, sf_dir):
    return statistics.unit_histogram(_units(spark, sf_dir), "active")


@query("unit_small_active_hist", _deg("out") + _UNITS + " SELECT edges, active, count(*) AS blocks FROM u WHERE edges < 128 GROUP BY edges, active")
def unit_small_active_hist(spark, sf_dir):
    return statistics.small_unit_histogram(_units(spark, sf_dir), "active")


@query("unit_maxdeg_hist", _deg("out") + _UNITS + " SELECT edges, max_degree, count(*) AS blocks FROM u WHERE edges < 128 GROUP BY edges, max_degree")
def unit_maxdeg_hist(spark, sf_dir):
    return statistics.small_unit_histogram(_units(spark, sf_dir), "max_degree")


@query(
    "unit_cumulative",
    _deg("out") + _UNITS + """, b AS (SELECT edges, count(*) AS n FROM u GROUP BY edges),
    t AS (SELECT sum(n) AS un, sum(n * edges) AS en FROM b), r AS (SELECT edges, sum(n) OVER (ORDER BY edges) AS ac, sum(n * edges) OVER (ORDER BY edges) AS ae FROM b)
    SELECT edges, round(CAST(ac AS DOUBLE) * 100 / un, 9) AS blocks_percent, round(CAST(ae AS DOUBLE) * 100 / en, 9) AS edges_percent,
    CASE WHEN edges > 0 THEN round(CAST(ae + (un - ac) * edges AS DOUBLE) / (un * edges), 9) END AS utilisation, round(CAST(un * edges AS DOUBLE) / en, 9) AS space_ratio FROM r, t""",
)
def unit_cumulative(spark, sf_dir):
    return _round(statistics.unit_cumulative(_units(spark, sf_dir)), "blocks_percent", "edges_percent", "utilisation", "space_ratio")


@query(
    "active_hist_percent",
    _deg("out") + _UNITS + f", h AS (SELECT edges, active, count(*) AS n FROM u WHERE edges IN {_POWERS} GROUP BY edges, active) SELECT edges, active, round(CAST(n AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY edges), 9) AS percent FROM h",
)
def active_hist_percent(spark, sf_dir):
    return _round(statistics.active_percent(_units(spark, sf_dir)), "percent")


@query(
    "maxdeg_cumulative",
    _deg("out") + _UNITS + f", h AS (SELECT edges, max_degree, count(*) AS n FROM u WHERE edges IN {_POWERS} GROUP BY edges, max_degree) SELECT edges, max_degree, round(CAST(sum(n) OVER (PARTITION BY edges ORDER BY max_degree) AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY edges), 9) AS percent FROM h",
)
def maxdeg_cumulative(spark, sf_dir):
    return _round(statistics.max_degree_cumulative(_units(spark, sf_dir)), "percent")


@query(
    "segment_hist",
    _with("order_part", ", c AS (SELECT dst % 3 AS segment, src // 16 AS block, count(*) AS n FROM e GROUP BY 1, 2)")
    + " SELECT segment, CAST(length(bin(n)) AS INTEGER) AS width, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS edges FROM c GROUP BY 1, 2",
)
def segment_hist(spark, sf_dir):
    return statistics.segment_units(edges_of(spark, sf_dir).withColumn("segment", F.col("dst") % 3), "segment", 16)


@query(
    "skewness_top_pct",
    _deg("out", "user_next") + ", r AS (SELECT degree, row_number() OVER (ORDER BY degree DESC) AS n FROM d), w AS (SELECT p AS percent, (SELECT max(src) FROM e) * p // 100 AS vertices FROM (VALUES (1), (10)) AS x(p)) "
    "SELECT percent, vertices, CAST(coalesce(sum(degree), 0) AS BIGINT) AS edges, round(CAST(coalesce(sum(degree), 0) AS DOUBLE) / (SELECT count(*) FROM e), 9) AS share FROM w LEFT JOIN r ON r.n <= w.vertices GROUP BY percent, vertices",
)
def skewness_top_pct(spark, sf_dir):
    return _round(statistics.skewness(graph_of(spark, sf_dir, "user_next")), "share")


@query("density", _with() + " SELECT n AS vertices, (SELECT count(*) FROM e) AS edges, round(CAST((SELECT count(*) FROM e) AS DOUBLE) / n, 9) AS density FROM top")
def density(spark, sf_dir):
    return _round(statistics.density(graph_of(spark, sf_dir)), "density")


# ---- results of experiments; runs are stood in for by orders: row = priority, column = status, value = price


def _runs(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@query("parse_expout", "SELECT 'order_key_time' AS key, CAST(o_orderkey AS DOUBLE) AS num, CAST(o_orderkey AS VARCHAR) || 's' AS str FROM orders")
def parse_expout(spark, sf_dir):
    lines = _runs(spark, sf_dir).select(F.concat(F.lit("[EXPOUT]Order key-time: "), F.col("o_orderkey").cast("string"), F.lit("s")).alias("value"))
    return results.parse_results(lines.unionByName(spark.createDataFrame([("no tag: 1",)], "value string"))).select("key", "num", "str")


@query(
    "pivot_results",
    "SELECT o_orderpriority, " + ", ".join(f"min(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY o_orderpriority",
)
def pivot_results(spark, sf_dir):
    return results.pivot(_runs(spark, sf_dir), "o_orderpriority", "o_orderstatus", "o_totalprice", list("FOP"))


@query(
    "pivot_mean",
    "SELECT o_orderpriority, " + ", ".join(f"round(avg(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 4) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY o_orderpriority",
)
def pivot_mean(spark, sf_dir):
    rows = results.pivot(_runs(spark, sf_dir), "o_orderpriority", "o_orderstatus", "o_totalprice", list("FOP"), "mean")
    return rows.withColumns({s: F.round(s, 4) for s in "FOP"})


@query(
    "pivot_list",
    "SELECT o_custkey, " + ", ".join(f"coalesce(string_agg(CAST(CASE WHEN o_orderstatus = '{s}' THEN o_orderkey END AS VARCHAR), ',' ORDER BY o_orderkey), '') AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY o_custkey",
)
def pivot_list(spark, sf_dir):
    rows = results.pivot(_runs(spark, sf_dir), "o_custkey", "o_orderstatus", "o_orderkey", list("FOP"), "list")
    return rows.select("o_custkey", *(F.array_join(s, ",").alias(s) for s in "FOP"))


@query(
    "mean_box",
    """WITH q AS (SELECT o_custkey, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY o_custkey)
    SELECT o_custkey, round(avg(o_totalprice), 7) AS mean FROM orders JOIN q USING (o_custkey)
    WHERE n < 4 OR o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY o_custkey""",
)
def mean_box(spark, sf_dir):
    return results.trimmed_means(_runs(spark, sf_dir), ["o_custkey"], "o_totalprice").withColumn("mean", F.round("mean", 7))


_SYSTEMS = "SELECT o_orderpriority AS dataset, o_orderstatus AS system, count(*) AS edges, sum(o_totalprice) AS seconds FROM orders GROUP BY 1, 2"


def _systems(spark, sf_dir) -> DataFrame:
    return _runs(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("system")).agg(F.count("*").alias("edges"), F.sum("o_totalprice").alias("seconds"))


@query("throughput", f"SELECT dataset, system, edges, round(edges / seconds / 1e6, 15) AS meps FROM ({_SYSTEMS}) AS s")
def throughput(spark, sf_dir):
    return results.throughput(_systems(spark, sf_dir)).select("dataset", "system", "edges", F.round("meps", 15).alias("meps"))


@query("normalise", f"WITH s AS ({_SYSTEMS}) SELECT s.dataset, s.system, round(s.seconds / b.seconds, 9) AS relative FROM s LEFT JOIN s AS b ON b.dataset = s.dataset AND b.system = 'F'")
def normalise(spark, sf_dir):
    return results.normalise(_systems(spark, sf_dir), "system", "seconds", "F", ["dataset"]).select("dataset", "system", F.round("relative", 9).alias("relative"))


@query(
    "mem_table",
    f"WITH s AS ({_SYSTEMS}), w AS (SELECT dataset, " + ", ".join(f"min(CASE WHEN system = '{s}' THEN seconds END) AS {s.lower()}" for s in "FOP") + " FROM s GROUP BY dataset) "
    "SELECT dataset, round(f / 1e9, 9) AS \"F\", round(o / 1e9, 9) AS \"O\", round(p / 1e9, 9) AS \"P\", CASE WHEN f <= o AND f <= p THEN 'F' WHEN o <= p THEN 'O' ELSE 'P' END AS least FROM w",
)
def mem_table(spark, sf_dir):
    return _round(results.memory_table(_systems(spark, sf_dir), "dataset", "system", "seconds", list("FOP")), "F", "O", "P")


@query(
    "perf_ratios",
    "SELECT l_returnflag, round(sum(l_discount) / sum(l_quantity), 9) AS l2_ratio, round(sum(l_tax) / sum(l_quantity), 9) AS llc_ratio FROM lineitem GROUP BY l_returnflag",
)
def perf_ratios(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(
        F.sum("l_discount").alias("l2_misses"), F.sum("l_quantity").alias("l2_references"), F.sum("l_tax").alias("llc_misses"), F.sum("l_quantity").alias("llc_references")
    )
    return _round(results.miss_ratios(rows), "l2_ratio", "llc_ratio").select("l_returnflag", "l2_ratio", "llc_ratio")


@query(
    "agg_frames",
    "WITH f AS (SELECT o_orderpriority, o_orderstatus, o_totalprice AS price FROM orders) SELECT o_orderpriority, max(price) AS price FROM f WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority",
)
def agg_frames(spark, sf_dir):
    """The frames of two systems, value by value."""
    frames = [_runs(spark, sf_dir).where(F.col("o_orderstatus") == s).select("o_orderpriority", F.col("o_totalprice").alias("price")) for s in "FO"]
    return results.aggregate_frames(frames, ["o_orderpriority"], F.max)


@query("latest_files")
def latest_files(spark, sf_dir):
    """Which of the tables' files are newest; the names only, as times differ from machine to machine."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(sf_dir)
    return results.latest_files(files, 5).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))


@query("ingest_throughput", _with() + " SELECT range AS version, (SELECT count(*) FROM e) AS edges FROM range(4)")
def ingest_throughput(spark, sf_dir):
    """Edges of four versions that were written one after another."""
    work = Workspace(spark, "ingest")
    store = EdgeStore(spark, f"{work.root}/table", width=1024)
    for version in range(4):
        store.append(edges_of(spark, sf_dir), version)
    return store.versions()
