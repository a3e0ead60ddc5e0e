"""Near-duplicate embeddings through an inverted multi-index.

The two halves of the unit vectors have codebooks of their own (k-means on a bounded sample); the pair
of nearest codewords is a vector's home cell in the product grid. A query visits cells by rising sum of
its halves' distances (the multi-sequence order), as long as the sum exceeds that of its home by no more
than a margin: one deep inside its cell visits it alone, one between cells several. The margin is fitted on
the sample, so that of partners at the threshold (made for this) and of the sample's own pairs at least the
target share is met from one side or the other. All vectors are indexed and all are queries; what is met in
a cell is compared by cosine in double precision, so nothing below the threshold is ever linked.

The grid grows with the rows: about ``MEMBERS_A_CELL`` vectors a cell, ``MOST_CODEWORDS`` codewords a half at
most. Vectors of each dimension have an index of their own if there are ``OWN_INDEX`` of them or more; those of
a rarer dimension share one cell, compared in blocks, without loss.

Equal vectors form one class, compared once and counted by its size. Cells are compared in blocks of
bounded size, so a hot cell is many tasks. Tasks return counts and spanning forests, not pairs. A pair
that is met from both sides counts in the cell with the lower number only.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Repeated rows are
links of each other, rows with equal ids too. A row without an id links and counts like others, but represents
none: its component is null if no row in it has an id, and it is kept only then. An empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.arrow import bound_batches, map_rows
from loomgraph.operators.components import star_components
from loomgraph.plans.workspace import Workspace

SAMPLE = 8000
MEMBERS_A_CELL = 100
MOST_CODEWORDS = 512
OWN_INDEX = 64
BLOCK = 2048
#: Bytes of vectors in a block at most.
BLOCK_BYTES = 32_000_000
TARGET = 0.985
SAMPLE_TARGET = 0.995
#: Numbers from here on stand for classes without an id.
NO_ID = 1 << 62


def unit_rows(raw: list[bytes] | pd.Series, dtype: str) -> np.ndarray:
    x = np.stack([np.frombuffer(v, dtype) for v in raw]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _squares(x, centres).argmin(axis=1)
        size = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=c, minlength=k) for c in x.T], axis=1) if x.shape[1] else centres
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :], 0)


class MultiIndex:
    def __init__(self, left: np.ndarray, right: np.ndarray, margin: float = np.inf):
        self.left, self.right, self.margin = left, right, margin

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to their codewords."""
        h = self.left.shape[1]
        return _squares(x[:, :h], self.left), _squares(x[:, h:], self.right)

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        """The cells of each row within the margin of the nearest one, nearest first; that is the home."""
        dl, dr = self.distances(x)
        out = []
        for a, b in zip(dl - dl.min(axis=1, keepdims=True), dr - dr.min(axis=1, keepdims=True)):
            # A cell is within the margin only if both its halves are.
            i, j = np.flatnonzero(a <= self.margin), np.flatnonzero(b <= self.margin)
            total = a[i][:, None] + b[j][None, :]
            p, q = np.nonzero(total <= self.margin)
            order = np.argsort(total[p, q], kind="stable")
            out.append((i[p] * len(b) + j[q])[order])
        return out

    def excess(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """By how much the home of p is further from q than q's own, row by row."""
        (ql, qr), (pl, pr) = self.distances(q), self.distances(p)
        at = np.arange(len(q))
        return ql[at, pl.argmin(axis=1)] - ql.min(axis=1) + qr[at, pr.argmin(axis=1)] - qr.min(axis=1)


def partners(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector another one at the given cosine, in a random direction."""
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    return cosine * x + np.sqrt(1 - cosine**2) * noise


def fit(x: np.ndarray, rows: int, threshold: float, seed: int = 1) -> MultiIndex:
    """Codebooks for ``rows`` vectors from the sample ``x``, and the margin; memory is the sample times codewords."""
    rng = np.random.default_rng(seed)
    k = int(np.clip(np.ceil(np.sqrt(rows / MEMBERS_A_CELL)), 1, min(MOST_CODEWORDS, len(x))))
    h = max(1, x.shape[1] // 2)
    index = MultiIndex(k_means(x[:, :h], k, rng), k_means(x[:, h:], k, rng) if x.shape[1] > h else np.zeros((1, 0)))
    if index.cells == 1:
        return index
    some = x[rng.permutation(len(x))[:1000]]
    made = partners(some, threshold, rng)
    either = lambda q, p: np.minimum(index.excess(q, p), index.excess(p, q))
    need = [np.quantile(either(some, made), TARGET)]
    close = some @ x.T
    a, b = np.nonzero((close >= threshold) & (close < 1 - 1e-9))
    if len(a):
        pick = rng.permutation(len(a))[:2000]
        need.append(np.quantile(either(some[a[pick]], x[b[pick]]), SAMPLE_TARGET))
    index.margin = float(max(need)) + 1e-12
    return index


def _compare(threshold: float, dtype: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        role = pdf["member"].to_numpy()
        m, q = pdf[role], pdf[~role]
        rows: list[tuple] = []
        if len(m) and len(q):
            cell = int(m["cell"].iloc[0])
            mid, qid = m["rep"].to_numpy(), q["rep"].to_numpy()
            mw, qw = m["weight"].to_numpy(), q["weight"].to_numpy()
            sim = unit_rows(q["vector"], dtype) @ unit_rows(m["vector"], dtype).T
            i, j = np.nonzero(sim >= threshold)
            home = q["home"].to_numpy()[i]
            of_member = [set(v) for v in m["visits"]]
            back = np.fromiter((h in of_member[k] for h, k in zip(home.tolist(), j.tolist())), bool, len(i))
            counts = np.where(home == cell, qid[i] > mid[j], ~back | (cell < home)) & (qid[i] != mid[j])
            i, j = i[counts], j[counts]
            ids, at = np.unique(np.concatenate([qid, mid]), return_inverse=True)
            qa, ma = at[: len(qid)], at[len(qid) :]
            links = np.bincount(qa[i], weights=mw[j], minlength=len(ids)) + np.bincount(ma[j], weights=qw[i], minlength=len(ids))
            # A spanning forest: labels fall to the least of what is linked.
            label = np.arange(len(ids))
            while len(i):
                low = np.minimum(label[qa[i]], label[ma[j]])
                before = label.copy()
                np.minimum.at(label, qa[i], low)
                np.minimum.at(label, ma[j], low)
                label = label[label]
                if (before == label).all():
                    break
            rows = [(int(v), int(ids[k]), int(n)) for v, k, n in zip(ids, label, links) if n]
        return pd.DataFrame(rows, columns=["rep", "low", "links"], dtype="int64")

    return run


def near_duplicate_vectors(table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: id, n_links, component_id (smallest id reachable by links), kept."""
    spark = table.sparkSession
    work = Workspace(spark, "multi-index")
    single = "float" in table.schema[vector_col].dataType.simpleString()
    dtype = "<f4" if single else "<f8"

    def read():
        def one(key, values):
            if not values or any(v is None for v in values):
                yield key, None, 0
            else:
                x = np.array(values, dtype) + np.array(0, dtype)  # -0.0 becomes 0.0
                fine = np.isfinite(x).all() and x.any()
                yield (key, x.tobytes(), len(x)) if fine else (key, None, 0)

        return one

    vectors = work.save(
        map_rows(
            table.select(F.col(id_col).cast("long"), F.col(vector_col)), read, "id long, vector binary, size int",
            pa.schema([("id", pa.int64()), ("vector", pa.binary()), ("size", pa.int32())]),
        )
    )
    vectors = vectors.withColumn("digest", F.when(F.col("size") > 0, F.sha2("vector", 256)))
    classes = vectors.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"), F.first("size").alias("size")
    )
    # An id with several vectors stands for one of them only; the others have numbers of their own, like those without an id.
    number = F.lit(NO_ID) + F.pmod(F.xxhash64("digest"), F.lit(NO_ID))
    classes = work.save(classes)
    shared = work.save(classes.where("rep is not null").groupBy("rep").agg(F.min("digest").alias("first"), F.count("*").alias("n")).where("n > 1"))
    named = classes.join(shared, "rep", "left")
    classes = named.withColumn("own", F.when(F.col("rep").isNull() | (F.col("digest") != F.coalesce("first", "digest")), number).otherwise(F.col("rep")))
    same_id = classes.where("own <> rep").select(F.col("own").alias("u"), F.col("rep").alias("v"))
    classes = classes.select("digest", F.col("own").alias("rep"), "weight", "vector", "size")

    frequent = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n") >= OWN_INDEX).collect()}
    indexes: dict[int, MultiIndex] = {}
    for size, rows in sorted(frequent.items()):
        limit = max(1, round(min(1.0, SAMPLE / rows) * (1 << 20)))
        some = classes.where((F.col("size") == size) & (F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < limit)).orderBy("digest")
        raw = [bytes(r["vector"]) for r in some.select("vector").collect()]
        if raw:
            indexes[size] = fit(unit_rows(raw, dtype), rows, threshold)
    starts = dict(zip(indexes, np.cumsum([0, *(x.cells for x in indexes.values())]).tolist()))
    grid = spark.sparkContext.broadcast((indexes, starts))

    def assign(batches):
        indexes, starts = grid.value
        for pdf in batches:
            for size, part in pdf.groupby("size"):
                if size in indexes:
                    cells = [c + starts[size] for c in indexes[size].visits(unit_rows(part["vector"], dtype))]
                else:
                    cells = [np.array([-size])] * len(part)  # one cell for all of a rare dimension
                yield part.drop(columns="size").assign(home=[int(c[0]) for c in cells], visits=[c.astype(np.int64) for c in cells])

    bound_batches(spark)
    placed = work.save(classes.drop("digest").mapInPandas(assign, "rep long, weight long, vector binary, home long, visits array<long>"))
    # Cells with more than one block of members or visitors; all others have one of each.
    sized = lambda df: df.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    members = sized(placed.select(F.col("home").alias("cell"), F.length("vector").alias("bytes"))).withColumnRenamed("blocks", "members")
    visitors = sized(placed.select(F.explode("visits").alias("cell"), F.length("vector").alias("bytes"))).withColumnRenamed("blocks", "visitors")
    # At most one cell for a BLOCK of visits is large: their blocks fit a broadcast on all but the largest tables.
    large = work.save(members.join(visitors, "cell", "full").na.fill(1).where("members > 1 or visitors > 1"))
    few = large.count() <= BROADCAST_CELLS
    blocks = lambda df: df.join(F.broadcast(large) if few else large, "cell", "left").na.fill(1, ["members", "visitors"])
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("long"))
    seated = blocks(placed.withColumn("cell", F.col("home"))).select(
        "cell", block("members").alias("mb"), F.explode(upto("visitors")).alias("vb"), F.lit(True).alias("member"), "rep", "weight", "home", "visits", "vector"
    )
    calling = blocks(placed.select("rep", "weight", "home", "vector", F.explode("visits").alias("cell"))).select(
        "cell", F.explode(upto("members")).alias("mb"), block("visitors").alias("vb"), F.lit(False).alias("member"), "rep", "weight", "home", F.lit(None).cast("array<long>").alias("visits"), "vector"
    )
    units = seated.unionByName(calling)
    found = work.save(units.groupBy("cell", "mb", "vb").applyInPandas(_compare(threshold, dtype), "rep long, low long, links long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("u"), F.col("low").alias("v")).unionByName(same_id)
    parts = star_components(edges, work).withColumnRenamed("v", "rep")
    labels = (
        classes.select("digest", "rep", "weight").join(links, "rep", "left").join(parts, "rep", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = vectors.select("id", "digest").join(labels, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.when(F.col("component_id") < NO_ID, F.col("component_id")))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


#: Blocks of large cells go to every task up to this number of cells; beyond it they are joined by shuffling.
BROADCAST_CELLS = 200_000
