"""Language of whole texts by averaged hashed subword embeddings and a linear softmax.

Subwords are the character 2- to 4-grams of the lower-cased text, with anything below "A" as a space.
Each hashes to a bucket with an embedding; a text is the average of its subwords' embeddings, and a
linear softmax scores the languages. Embeddings and weights are trained in numpy by stochastic gradient
descent on a bounded sample of labelled rows: ``SAMPLE_ROWS`` distinct texts and ``SAMPLE_CHARS``
characters in expectation, shared out evenly among the languages. A fifth of the sample is left out of
training and calibrates the result: a temperature for the scores, and two limits for rejection (a score,
and a share of known subwords), each passed by all but ``FALSE_REJECTS`` of that fifth. Known are the 3-
and 4-grams of the training texts, by 32-bit hashes and not by buckets, which other languages hit as well. The
share of a short text varies more, so it must lie below the limit by twice its standard error at the limit, which
vanishes with length; one unknown character makes up to seven subwords unknown at once.

As the model is linear, prediction adds up one row of class scores for each subword of the whole text.
The table that tasks receive has ``BUCKETS`` rows, and the known hashes are at most two for each character
of the sample, however large the corpus.

Null texts and texts without a letter get ``und``, score 0, rejected. If nothing is labelled, all others get
``und``, score 0, not rejected.
Equal texts get equal results, so repeated rows do; an empty table gives no rows. Ties go to the first language by
name. Other columns are never inputs of a prediction, whatever their names.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.arrow import bound_batches, map_rows

BUCKETS = 1 << 16
DIMENSIONS = 16
EPOCHS = 8
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 20_000_000
FALSE_REJECTS = 0.0005
MAX_LANGUAGES = 500
_PART = 1 << 17
#: The 3- and 4-grams that hold one character.
_TOUCHED = 7
_LETTER = re.compile(r"[^\W\d_]")
_STEP = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    if not text or not (m := _LETTER.search(text)):
        return False
    return m.group().isalpha() or any(map(str.isalpha, text))


def _hashes(text: str) -> list[np.ndarray]:
    """The 32-bit hashes of all subwords of the whole text, by length."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 65, np.uint32(32), c)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    h = c * _STEP
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
    out, grams = [], h
    for n in range(2, 5):
        if len(c) < n:
            break
        grams = (grams[:-1] * np.uint32(31)) ^ h[n - 1 :]
        out.append((grams ^ (grams >> np.uint32(13))) * _STEP)
    return out


def _buckets(hashes: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(hashes) >> np.uint32(16) if hashes else np.empty(0, np.uint32)


def subwords(text: str) -> np.ndarray:
    """The bucket of every subword of the whole text."""
    return _buckets(_hashes(text))


class Model:
    """languages, a table of class scores, the sorted hashes of known subwords, temperature and limits."""

    def __init__(self, languages: list[str], table: np.ndarray, known: np.ndarray, temperature: float = 1.0, least_score: float = 0.0, least_known: float = 0.0):
        self.languages, self.table, self.known = languages, table, known
        self.temperature, self.least_score, self.least_known = temperature, least_score, least_known

    def sums(self, text: str) -> tuple[np.ndarray, float, int]:
        """The averaged class scores, the share of known subwords (1 if none is long enough) and their number."""
        hashes = _hashes(text)
        ids = _buckets(hashes)
        total = np.zeros(self.table.shape[1])
        for at in range(0, len(ids), _PART):
            total += self.table[ids[at : at + _PART]].sum(axis=0, dtype=np.float64)
        size = sum(map(len, hashes[1:]))
        known = sum(int((self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h).sum()) for h in hashes[1:]) if len(self.known) else 0
        return total / max(1, len(ids)), known / size if size else 1.0, size

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not has_letter(text):
            return "und", 0.0, True
        if not self.languages:
            return "und", 0.0, False
        mean, known, size = self.sums(text)
        error = (self.least_known * (1 - self.least_known) * _TOUCHED / max(1, size)) ** 0.5
        z = mean / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        score = float(p[best] / p.sum())
        return self.languages[best], score, score < self.least_score or known < self.least_known - 2 * error


def train(texts: list[str], labels: list[str], seed: int = 1) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.empty(0, np.uint32))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    held = rng.random(len(texts)) < 0.2
    if held.all() or not held.any() or len(set(y[~held])) < len(languages):
        held[:] = False
    seen = np.zeros(BUCKETS, np.int64)
    known = np.empty(0, np.uint32)
    fresh: list[np.ndarray] = []
    # In two long arrays, whose memory goes back to the system at the end, unlike that of thousands of short ones.
    docs, all_ids, all_parts = {}, array("I"), array("f")
    for i in np.flatnonzero(~held):
        hashes = _hashes(texts[i])
        fresh += [np.unique(h) for h in hashes[1:]]
        if sum(map(len, fresh)) > 1 << 20:
            known, fresh = np.unique(np.concatenate([known, *fresh])), []
        ids, times = np.unique(_buckets(hashes), return_counts=True)
        if len(ids):
            docs[i] = (len(all_ids), len(all_ids) + len(ids))
            all_ids.frombytes(ids.tobytes())
            all_parts.frombytes((times / times.sum()).astype(np.float32).tobytes())
            seen[ids] += times
    e = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w = np.zeros((DIMENSIONS, len(languages)), np.float32)
    # Each language weighs the same in all.
    weight = len(docs) / (len(languages) * np.maximum(1, np.bincount(y[list(docs)], minlength=len(languages))))
    all_ids, all_parts = np.asarray(all_ids), np.asarray(all_parts)
    steps, done = max(1, EPOCHS * len(docs)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(list(docs)):
            ids, part = all_ids[slice(*docs[i])], all_parts[slice(*docs[i])]
            rate = 1.0 * (1 - done / steps)
            done += 1
            v = part @ e[ids]
            z = v @ w
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[i]] -= 1
            g *= min(4.0, weight[y[i]]) * rate
            back = w @ g
            w -= np.outer(v, g)
            e[ids] -= 20 * part[:, None] * back
    table = (e @ w).astype(np.float32)
    table[seen == 0] = 0  # untrained embeddings say nothing
    model = Model(languages, table, np.unique(np.concatenate([known, *fresh])))
    rows = [i for i in (np.flatnonzero(held) if held.any() else np.arange(len(texts))) if has_letter(texts[i])]
    if not rows:
        return model
    sums, shares, _ = map(np.array, zip(*(model.sums(texts[i]) for i in rows)))
    truth = y[rows]

    def scores(t: float) -> np.ndarray:
        z = sums / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(scores(t)[np.arange(len(rows)), truth], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.005, 50, 120), key=loss))
    p = scores(model.temperature)
    right = p.argmax(axis=1) == truth
    # A limit at the given quantile of the right ones; with few of them, at the lowest.
    low = lambda x: float(np.sort(x)[int(FALSE_REJECTS * len(x))]) if len(x) else 0.0
    model.least_score = low(p.max(axis=1)[right])
    model.least_known = low(shares[right])
    return model


def hash_fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(id_column.cast("string").cast("binary")) % 3


def sample_labelled(docs: DataFrame, may_learn: Column, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """Distinct labelled texts, chosen by the hash of the text, as many of each language as the bounds allow."""
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("h")
    )
    stats = (
        rows.select("lang", "h", F.length("text").alias("size")).distinct()
        .groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    )
    if len(stats) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    if not stats:
        return [], []
    scale = 1 << 20
    share = {r["lang"]: min(1.0, SAMPLE_ROWS / len(stats) / r["n"], SAMPLE_CHARS / len(stats) / max(1, r["size"])) for r in stats}
    limit = F.element_at(F.create_map(*(F.lit(x) for k, s in share.items() for x in (k, max(1, round(s * scale))))), F.col("lang"))
    chosen = (
        rows.where(F.pmod("h", F.lit(scale)) < limit)
        .groupBy("lang", "h").agg(F.max("text").alias("text")).select("lang", "h", "text").collect()
    )
    chosen.sort(key=lambda r: (r["lang"], r["h"]))
    return [r["text"] for r in chosen], [r["lang"] for r in chosen]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predict
        return lambda key, text: [(key, *predict(text))]

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_rows(
        rows, make, f"{id_col} long, lang_pred string, score double, rejected boolean",
        pa.schema([(id_col, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]),
    )


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is not rejected."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(texts):
        predict = shared.value.predict
        return texts.map(lambda t: predict(t)[2])

    return docs.where(~rejected(F.col(text_col).cast("string")))
