"""Best-fit packing of token sequences, planned on the histogram of lengths.

1. Every document is tokenized whole, closed by an end id and, if it is longer than a sequence, cut so
   that all pieces but the first are full.
2. The counts of pieces by length (at most ``capacity`` numbers, whatever the corpus) reach the driver.
3. Patterns of up to three length bins that fill a sequence are enumerated; non-negative least squares
   fits how often each is used to the histogram, and the counts are rounded.
4. What the patterns leave over, and short pieces, which fit anywhere, go best-fit first into the room that is left,
   longest pieces first. All of this handles groups of equal sequences, never single ones.
5. The plan says, for each length, which sequence and offset its r-th piece takes. Pieces are numbered
   within their length by two-level counting over salted buckets and look their place up in the plan.

Null texts count as empty; an empty text is one piece holding just the end id. Repeated rows are packed
once each. Extra columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from loomgraph.llm.arrow import map_rows
from loomgraph.llm.bpe import ODD, PLAIN, Known
from loomgraph.plans.workspace import Workspace

BINS = 256
PATTERN_DOCS = 3
#: Pieces shorter than this part of a sequence are left for filling gaps.
FILLER_PART = 16
_RANK_BITS = 44


def visible_bytes() -> dict[int, int]:
    """The characters that byte-level vocabularies show bytes as: printable ones as they are, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


@functools.lru_cache(2)
def _tokenizer(path: str):
    """text -> ids as little-endian unsigned 32-bit integers."""
    tok = Tokenizer.from_file(path)
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]
    as_bytes = lambda ids: array("I", ids).tobytes()
    assert array("I").itemsize == 4 and sys.byteorder == "little"
    # Byte-level pieces are independent of each other, so their ids can be kept.
    piecewise = type(tok.pre_tokenizer).__name__ == "ByteLevel" and tok.normalizer is None and not tok.pre_tokenizer.add_prefix_space
    merge, visible = tok.model.tokenize, visible_bytes()

    known = Known(lambda piece: as_bytes([t.id for t in merge(piece.encode().decode("latin-1").translate(visible))]))
    split, odd = PLAIN.findall, ODD.search

    def ids_of(text: str) -> bytes:
        if piecewise and not odd(text) and not any(s in text for s in specials):
            return b"".join(map(known.__getitem__, split(text)))
        return as_bytes(tok.encode(text, add_special_tokens=False).ids)

    return ids_of


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    def make():
        ids_of = _tokenizer(path)
        end = int(end_id).to_bytes(4, "little")

        def one(key, text):
            ids = ids_of(text or "") + end
            n = len(ids) // 4
            start, piece = 0, 0
            stop = n % capacity or min(n, capacity)
            while start < n:
                part = ids[4 * start : 4 * stop]
                row = (key, piece, start, stop - start, zlib.crc32(part))
                yield (*row, part) if keep_ids else row
                start, stop, piece = stop, stop + capacity, piece + 1

        return one

    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_rows(rows, make, schema, pa.schema(list(zip(names, types))))


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = tolerance * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= scale:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            passive[at[x[at] <= 1e-12 * max(1.0, x.max())]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def length_patterns(bins: int, lowest: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most three bins, each ``lowest`` or more, that sum to ``bins``."""
    found: list[tuple[int, ...]] = [(bins,)]
    found += [(a, bins - a) for a in range((bins + 1) // 2, bins - lowest + 1)]
    for a in range((bins + 2) // 3, bins - 2 * lowest + 1):
        rest = bins - a
        found += [(a, b, rest - b) for b in range((rest + 1) // 2, min(a, rest - lowest) + 1)]
    return found


class Plan:
    """Groups of equal sequences: (number of sequences, ((length, how many of it), ...))."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple[int, tuple]]] = {}
        self.mask = 0  # bit f: some group has room f
        self.done: list[tuple[int, tuple]] = []

    def add(self, count: int, runs: tuple) -> None:
        room = self.capacity - sum(n * k for n, k in runs)
        if room == 0:
            self.done.append((count, runs))
        else:
            self.open.setdefault(room, []).append((count, runs))
            self.mask |= 1 << room

    def take(self, least: int) -> tuple[int, int, tuple] | None:
        """The group with the least room that is enough."""
        above = self.mask >> least
        if not above:
            return None
        room = least + ((above & -above).bit_length() - 1)
        count, runs = self.open[room].pop()
        if not self.open[room]:
            del self.open[room]
            self.mask &= ~(1 << room)
        return room, count, runs

    def best_fit(self, length: int, count: int) -> None:
        while count:
            room, sequences, runs = self.take(length) or (self.capacity, -1, ())
            each = room // length
            if sequences < 0:
                sequences = -(-count // each)
            full = min(sequences, count // each)
            if full:
                self.add(full, (*runs, (length, each)))
                count -= full * each
                sequences -= full
            if sequences and count and count < each:
                self.add(1, (*runs, (length, count)))
                count, sequences = 0, sequences - 1
            if sequences and runs:
                self.add(sequences, runs)

    def groups(self) -> list[tuple[int, tuple]]:
        return self.done + [g for room in sorted(self.open) for g in self.open[room]]


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """counts[n]: pieces of length n, for n up to capacity. Returns groups of equal sequences."""
    left = counts.astype(np.int64).copy()
    width = max(1, -(-capacity // BINS))
    bins = capacity // width
    plan = Plan(capacity)
    bin_of = -(-np.arange(capacity + 1) // width)  # a length counts as the upper end of its bin
    bin_of[bin_of > bins] = 0  # lengths above the last whole bin are packed as residuals
    lowest = max(1, bins // FILLER_PART)
    histogram = np.bincount(bin_of, weights=left, minlength=bins + 1)[1 : bins + 1]
    histogram[: lowest - 1] = 0
    patterns = [p for p in length_patterns(bins, lowest) if all(histogram[b - 1] for b in p)]
    if patterns:
        a = np.zeros((bins, len(patterns)))
        for j, p in enumerate(patterns):
            for b in p:
                a[b - 1, j] += 1
        x = nonnegative_least_squares(a, histogram)
        lengths = [np.flatnonzero(bin_of == b)[::-1] for b in range(bins + 1)]
        for j in np.argsort(-x, kind="stable"):
            repeats = int(np.rint(x[j]))
            if repeats <= 0:
                break
            p = patterns[j]
            for b in set(p):
                repeats = min(repeats, int(left[lengths[b]].sum()) // p.count(b))
            while repeats:
                # The longest of each bin go together for as long as they last; the last slot takes
                # the length that fills the sequence best, from its bin or just above.
                chosen: list[int] = []
                for b in p[:-1]:
                    chosen.append(next((int(n) for n in lengths[b] if left[n] > chosen.count(n)), 0))
                room = capacity - sum(chosen)
                chosen.append(next((n for n in range(room, (p[-1] - 1) * width, -1) if left[n] > chosen.count(n)), 0))
                if not all(chosen):
                    break
                times = min(repeats, *(int(left[n]) // chosen.count(n) for n in set(chosen)))
                for n in chosen:
                    left[n] -= times
                plan.add(times, tuple((n, 1) for n in chosen))
                repeats -= times
    for n in range(capacity, 0, -1):
        if left[n]:
            plan.best_fit(n, int(left[n]))
    return plan.groups()


def place_table(groups: list[tuple[int, tuple]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank) and rows (first rank, each, first sequence, offset)."""
    rank: dict[int, int] = {}
    keys, rows, sequence = [], [], 0
    for count, runs in groups:
        offset = 0
        for length, each in runs:
            r = rank.get(length, 0)
            keys.append((length << _RANK_BITS) + r)
            rows.append((r, each, sequence, offset))
            rank[length] = r + count * each
            offset += length * each
        sequence += count
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(rows, np.int64).reshape(-1, 4)[order]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    The plan that tasks receive has at most a few rows for each of the ``capacity`` lengths.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    pieces = work.save(
        tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids).withColumn(
            "_row", F.monotonically_increasing_id()
        )
    )
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():
        counts[n] = c
    keys, rows = place_table(plan_sequences(counts, capacity)) if counts.any() else (np.zeros(1, np.int64), np.zeros((1, 4), np.int64))

    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    per_bucket = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = per_bucket.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row")) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_at") + F.col("_before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        n, r = length.to_numpy(), rank.to_numpy()
        first, each, sequence, offset = rows[np.searchsorted(keys, (n << _RANK_BITS) + r, side="right") - 1].T
        t = r - first
        return pd.DataFrame({"sequence_id": sequence + t // each, "offset": offset + t % each * n})

    out = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    return ranked.withColumn("_place", place("length", "_rank")).select(*out, "_place.sequence_id", "_place.offset")
