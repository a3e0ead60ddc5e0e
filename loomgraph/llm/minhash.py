"""Near-duplicate documents by min-max hashing of word shingles.

Every permutation of the shingle hashes gives two values, its minimum and its maximum, so a signature of
320 values costs 160 hash evaluations. Bands of values are bucket keys; the number of values in a band
follows from the threshold, so that a pair just at it is missed with probability ``MISS`` or less.

1. One pass over the texts gives each row the size of its shingle set, a 128-bit digest of that set and
   the band keys. Rows with equal sets form a class, represented by its smallest id.
2. In each bucket all are compared in full with its pivot, the smallest representative: one pair for each
   member, and one for pairs that meet in several buckets. A pivot's members are dealt to parts, which are read in order.
3. What is linked forms components. Buckets that lie in one component are done; in the others, what is
   far from the pivot is compared block by block, as far as the distances to the pivot leave a link possible,
   once for all open buckets of a pivot.
   Nothing is joined by buckets alone, so chains of half-similar texts stay apart.
4. Components of all links, spread to the classes' members, are the result.

Words are what white space (ASCII) separates; A-Z count as lower case. A text with fewer words than a
shingle has one shingle, all of it. Null and empty texts have none and link with nothing. Repeated rows are
copies of each other. Rows with equal ids are one document, linked with whatever one of its texts is. A row without an id takes part,
but never represents others: its component is null if no row in it has an id, and it is kept only then.
An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.arrow import bound_batches, map_rows
from loomgraph.operators.components import star_components
from loomgraph.plans.workspace import Workspace

PERMUTATIONS = 160
MISS = 1e-4
#: Members of a bucket that one task compares with as many others, and their shingles.
BLOCK = 256
BLOCK_SHINGLES = 2_000_000
#: Members of a hot pivot in one part.
PART = 250
#: Rows of open buckets go to every task up to this number; beyond it they are joined by shuffling.
BROADCAST_BUCKETS = 20_000
#: Numbers from here on stand for classes without an id.
NO_ID = 1 << 62
#: Hashes of words are kept up to this number of bytes of words.
_WORD_BYTES = 8_000_000
_U64 = np.uint64


def band_rows(similarity: float, values: int = 2 * PERMUTATIONS, miss: float = MISS) -> int:
    """The most values in a band with which a pair of this similarity is missed no more often than ``miss``."""
    return max(r for r in range(1, 17) if (1 - similarity**r) ** (values // r) <= miss or r == 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


class _Words(dict):
    size = 0

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        if len(word) < 256:
            self.size += len(word) + 50
            if self.size > _WORD_BYTES:
                self.clear()
                self.size = 0
            self[word] = found
        return found


_words = _Words()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, _U64)
    h = np.fromiter(map(_words.__getitem__, words), np.int64, n).view(_U64)
    width = min(k, n)
    total = np.full(n - width + 1, width, _U64)
    for i in range(width):
        total = total * _U64(0x9E3779B97F4A7C15) + _mixed(h[i : n - width + 1 + i])
    return np.unique(_mixed(total))


class MinMax:
    """Band keys of shingle sets."""

    def __init__(self, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
        self.bands = 2 * PERMUTATIONS // rows
        self.rows = rows
        self.weights = rng.integers(0, 1 << 64, (self.bands, rows), _U64, endpoint=False) | _U64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> _U64(32)).astype(np.uint32)
        low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
        high = np.zeros(PERMUTATIONS, np.uint32)
        for at in range(0, len(x), 256):
            h = x[at : at + 256, None] * self.a + self.b
            np.minimum(low, h.min(axis=0), out=low)
            np.maximum(high, h.max(axis=0), out=high)
        return np.concatenate([low, high])  # the two values of a permutation are in different bands

    def keys(self, shingles: np.ndarray) -> list[int]:
        values = self.signature(shingles)[: self.bands * self.rows].reshape(self.bands, self.rows)
        total = (_mixed(values.astype(_U64)) * self.weights).sum(axis=1, dtype=_U64)
        return _mixed(total + np.arange(self.bands, dtype=_U64)).view(np.int64).tolist()


def _signed(docs: DataFrame, k: int, least: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    def make():
        hasher = MinMax(rows)

        def one(key, text):
            s = shingle_set(text, k)
            digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            yield key, len(s), digest, hasher.keys(s) if len(s) >= least else None

        return one

    rows_in = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_rows(
        rows_in, make, "id long, n long, digest binary, bands array<long>",
        pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))]),
    )


def intersections(sets: list[np.ndarray], chunk: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float64)
    for at in range(0, int(shared.sum()), chunk):
        lo, hi = np.searchsorted(column, [at, at + chunk])
        grid = np.zeros((m, min(chunk, int(shared.sum()) - at)), np.float32)
        grid[owner[lo:hi], column[lo:hi] - at] = 1
        out += grid @ grid.T
    return out.astype(np.int64)


def linked_forest(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], numerator: int, denominator: int) -> list[tuple[int, int]]:
    """(id, smallest id of its local component) of what is linked; with two sides, only across them."""
    n = np.array([len(s) for s in sets])
    both = intersections(sets)
    hit = denominator * both >= numerator * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(hit, False)
    if len(set(sides.tolist())) > 1:
        hit &= sides[:, None] != sides[None, :]
    seen, out = np.zeros(len(ids), bool), []
    for i in np.argsort(ids, kind="stable"):
        if seen[i]:
            continue
        seen[i] = True
        front = np.array([i])
        while len(front):
            reached = hit[front].any(axis=0) & ~seen
            seen |= reached
            front = np.flatnonzero(reached)
            out += [(int(ids[j]), int(ids[i])) for j in front]
    return out


def _measured(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(u, v, near, distance) of distinct pairs: whether they are linked, and their Jaccard distance.

    The members of a pivot v are dealt to parts of ``PART`` rows about, the pivot to each of them, and each part is read
    in order with the pivot first, so a task holds one set and a batch, however many members a pivot has.
    """
    limit = max(PART, pairs.count() // 10_000)  # so at most 10,000 pivots are hot
    hot = pairs.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("v", F.ceil(F.col("n") / PART).alias("parts"))
    one = F.lit(1).cast("long")
    spread = lambda df: df.join(F.broadcast(hot), "v", "left").withColumn("parts", F.coalesce("parts", one))
    members = spread(pairs).select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part"))
    members = members.join(sets.select(F.col("rep").alias("u"), "shingles"), "u").select("v", "part", "u", "shingles")
    pivots = spread(pairs.select("v").distinct()).select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    pivots = pivots.join(sets.select(F.col("rep").alias("v"), "shingles"), "v").select("v", "part", F.lit(None).cast("long").alias("u"), "shingles")
    dealt = pivots.unionByName(members).repartition("v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())

    def measure():
        pivot: dict = {"of": None, "sets": []}

        def one(v, part, u, shingles):
            b = np.frombuffer(shingles, _U64)
            if u is None:
                if pivot["of"] != (v, part):
                    pivot["of"], pivot["sets"] = (v, part), []
                pivot["sets"].append(b)
                return
            for a in pivot["sets"]:
                both = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - both
                yield u, v, denominator * both >= numerator * union, 1 - both / union

        return one

    found = map_rows(
        dealt, measure, "u long, v long, near boolean, distance double", pa.schema([("u", pa.int64()), ("v", pa.int64()), ("near", pa.bool_()), ("distance", pa.float64())])
    )
    return found.groupBy("u", "v").agg(F.bool_or("near").alias("near"), F.min("distance").alias("distance"))


def _sets(docs: DataFrame, classes: DataFrame, suspects: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, shingles) of the suspects; several rows for an id with several texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])
    named = map_rows(
        rows.join(suspects, "rep"), lambda: lambda v, t: [(v, s.tobytes())] if len(s := shingle_set(t, words)) else [], "rep long, shingles binary", schema
    )
    unnamed = suspects.where(F.col("rep") >= NO_ID)
    if unnamed.isEmpty():
        return named

    def make():
        def one(text):
            s = shingle_set(text, words).tobytes()
            yield xxhash.xxh3_128_digest(s), s

        return one

    again = map_rows(rows.where("rep is null and text is not null").select("text"), make, "digest binary, shingles binary", pa.schema([("digest", pa.binary()), ("shingles", pa.binary())]))
    of = classes.join(unnamed, "rep", "left_semi").select("rep", "digest")
    return named.unionByName(again.join(of, "digest").groupBy("rep").agg(F.first("shingles").alias("shingles")))


def _open(keys: DataFrame, measured: DataFrame, parts: DataFrame, sizes: DataFrame, reach: float, work: Workspace) -> tuple[DataFrame, bool]:
    """(pivot, rep, near, n, crossing) of the members, but the pivot, of buckets that are not settled, and whether few are.

    A bucket is open if its members, of which there are three or more, are not all connected yet. The open buckets
    of one pivot (mostly the same texts in several bands) count as one. A crossing member is far from the pivot, in another component, and within reach of
    what is near the pivot: the distance is a metric, so beyond twice the threshold's there is no link to it.
    """
    of = parts.select(F.col("v").alias("rep"), "component")
    labelled = keys.join(of, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    state = labelled.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = work.save(state.where("members > 2 and low < high").select("key", "pivot"))
    few = open_.count() <= BROADCAST_BUCKETS
    members = labelled.join(F.broadcast(open_) if few else open_, "key").where("rep <> pivot").select("pivot", "rep", "component").distinct()
    members = members.join(measured.select(F.col("u").alias("rep"), F.col("v").alias("pivot"), "near", "distance"), ["rep", "pivot"])
    home = of.select(F.col("rep").alias("pivot"), F.col("component").alias("home"))
    members = members.join(home, "pivot", "left").withColumn("other", F.col("component") != F.coalesce("home", "pivot")).join(sizes, "rep")
    crossing = ~F.col("near") & F.col("other") & (F.col("distance") <= reach)
    return work.save(members.select("pivot", "rep", "near", "n", crossing.alias("crossing"))), few


def _in_blocks(members: DataFrame, few: bool, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Spanning forests (u, v) of what is linked inside open buckets besides their pivots: what is far from the pivot
    is compared with each other, and what is crossing with what is near the pivot."""
    blocks_of = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("long")
    counts = members.groupBy("pivot").agg(blocks_of(F.col("near")).alias("nears"), blocks_of(~F.col("near")).alias("fars"), blocks_of(F.col("crossing")).alias("crossings"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    unit = lambda kind, first, second, side: F.struct(F.lit(kind).alias("kind"), first.alias("first"), second.alias("second"), side.cast("long").alias("side"))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(F.col(n), F.lit(1)))
    none = F.array().cast("array<struct<kind: string, first: long, second: long, side: long>>")
    for_near = F.transform(upto(F.col("crossings")), lambda j: unit("mixed", j, block("nears"), F.lit(1)))
    among = F.transform(upto(F.col("fars")), lambda j: unit("far", F.least(block("fars"), j), F.greatest(block("fars"), j), block("fars")))
    among = F.when(F.col("far") > 1, among).otherwise(none)
    crossing = F.when(F.col("crossing"), F.transform(upto(F.col("nears")), lambda j: unit("mixed", block("crossings"), j, F.lit(0)))).otherwise(none)
    counts = counts.join(members.groupBy("pivot").agg(F.count_if(~F.col("near")).alias("far")), "pivot")
    units = members.join(F.broadcast(counts) if few else counts, "pivot").select("pivot", "rep", F.explode(F.when(F.col("near"), for_near).otherwise(F.concat(among, crossing))).alias("unit"))
    units = units.select("pivot", "rep", "unit.*").join(sets, "rep")

    def compare(pdf):
        import pandas as pd  # here, so that the workers that hash do without

        pdf = pdf.drop_duplicates(["rep", "shingles"])
        forest = linked_forest(
            pdf["rep"].to_numpy(), pdf["side"].to_numpy(), [np.frombuffer(s, _U64) for s in pdf["shingles"]], numerator, denominator
        )
        return pd.DataFrame(forest, columns=["u", "v"], dtype="int64")

    bound_batches(members.sparkSession)
    return units.groupBy("pivot", "kind", "first", "second").applyInPandas(compare, "u long, v long").where("u <> v")


def near_duplicates(
    docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: id, n_shingles, component_id (smallest id reachable by links), kept.

    Two documents are linked if denominator * |A and B| >= numerator * |A or B| for their shingle sets.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    least = -(-numerator // (denominator - numerator))  # smaller sets link with equal ones only
    rows = band_rows(numerator / denominator)
    signed = work.save(_signed(docs, words, least, rows, id_col, text_col))
    # Equal sets have equal bands. A class without any id has a number beyond all ids.
    unnamed = F.lit(NO_ID) + F.pmod(F.xxhash64("digest"), F.lit(NO_ID))
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = work.save(classes.withColumn("rep", F.coalesce("rep", unnamed)))

    # Rows of equal ids and different texts are different classes with one representative; it has the keys of all.
    keys = classes.where("bands is not null").select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    shared = work.save(keys.join(buckets, "key").select("key", "rep", "low").distinct(), "uncompressed")
    pairs = work.save(shared.where("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v")).distinct(), "uncompressed")
    suspects = pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
    sets = work.save(_sets(docs, classes, work.save(suspects), words, id_col, text_col).distinct())
    measured = work.save(_measured(pairs, sets, numerator, denominator), "uncompressed")
    parts = star_components(measured.where("near").select("u", "v"), work)
    sizes = work.save(sets.groupBy("rep").agg(F.count("*").alias("sets"), F.sum(F.floor(F.length("shingles") / 8)).alias("n")))
    # Ids with several texts have no single distance.
    reach = 2 * (1 - numerator / denominator) + 1e-9 if sizes.where("sets > 1").isEmpty() else 2.0
    members, few = _open(shared.select("key", "rep"), measured, parts, sizes, reach, work)
    if not members.isEmpty():
        more = _in_blocks(members, few, sets, numerator, denominator)
        parts = star_components(parts.select(F.col("v").alias("u"), F.col("component").alias("v")).unionByName(more), work)

    labels = classes.join(parts.withColumnRenamed("v", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("id", "n", "digest").join(labels, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.when(F.col("component_id") < NO_ID, F.col("component_id")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
