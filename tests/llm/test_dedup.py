"""Near-duplicates of texts and vectors against brute force."""

import random

import numpy as np
import pytest

from loomgraph.llm import minhash, multi_index

SCHEMA = "doc_id long, text string, digest string, n int, v int, component string, blocks int"


def brute(rows, k, num, den):
    """id -> (set size, component) by comparing all with all."""
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(seed, families=12, members=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randrange(20, 200))]
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["", None, "one", "One", "one two", "a b c", "A  b\nc", "x " * 30000, "x " * 20000, "É b c", "é b c"]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, "c", 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, num):
    rows = texts(k)
    found = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, rows), k, num, 100).collect()}
    want = brute(rows, k, num, 100)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_large_groups_in_blocks(spark, monkeypatch, broadcast):
    """Groups that are linked only through chains, in parts and blocks much smaller than they are."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "PART", 10)
    monkeypatch.setattr(minhash, "BROADCAST_BUCKETS", broadcast)
    rows = texts(9, families=2, members=60)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    for j in range(60):  # each differs a little from the one before, and much from the first
        base[rng.randrange(120)] = f"c{j}"
        rows.append((1000 + (j * 37) % 60, " ".join(base)))
    found = minhash.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: c for i, (_, c) in brute(rows, 3, 85, 100).items()}


def test_half_similar_texts_stay_cheap(spark, monkeypatch):
    """A chain of texts that share half of their shingles with the next: few pairs are measured, none is closed over."""
    measured = []
    real = minhash._measured
    monkeypatch.setattr(minhash, "_measured", lambda pairs, *rest: measured.append(pairs.count()) or real(pairs, *rest))
    for n in (200, 800):
        rows = [(i, " ".join(f"w{i * 40 + j}" for j in range(140))) for i in range(n)]
        found = minhash.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
        assert all(r["kept"] for r in found)
    assert measured[1] <= 5 * max(measured[0], 40) and measured[1] < 3 * 800


def test_ids_missing_or_with_several_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, text + " end"), (None, text + " end"), (7, text), (7, other), (9, other + " end"), (None, "q " + " ".join(f"u{i}" for i in range(60))), (None, " ".join(f"u{i}" for i in range(60)))]
    out = minhash.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in out) == [
        ("7", "7", True), ("7", "7", True), ("9", "7", False), ("None", "7", False), ("None", "7", False), ("None", "None", True), ("None", "None", True),
    ]


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "other words only here"), (2, None)]
    out = minhash.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in out) == [
        ("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True),
    ]
    assert minhash.near_duplicates(frame(spark, []), 3, 85, 100).isEmpty()


def test_band_rows():
    for s in (0.5, 0.8, 0.85):
        r, values = minhash.band_rows(s), 2 * minhash.PERMUTATIONS
        assert (1 - s**r) ** (values // r) <= minhash.MISS < (1 - s ** (r + 1)) ** (values // (r + 1))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    m = minhash.MinMax(8)
    for share in (0.9, 0.6):
        b = np.concatenate([a[: int(share * len(a))], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((m.signature(a) == m.signature(b)).mean() - true) < 0.12


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (5, 80, 200, 1)]
    got = minhash.intersections(sets, chunk=64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


def vectors(seed, n=1200, size=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    for i in range(0, n, 6):
        x[i + 1] = x[i] + rng.normal(size=size) * 0.15
        x[i + 2] = x[i] * 3
        x[i + 3] = x[i]
    x[:40] = x[0] + rng.normal(size=(40, size)) * 0.1
    return x.astype(np.float32)


def brute_links(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    return hit


def vector_frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], f"vec_id long, embedding array<{kind}>, digest string, rep int")


@pytest.mark.parametrize("kind,members", [("float", 400), ("double", 20)])
def test_vectors(spark, monkeypatch, kind, members):
    monkeypatch.setattr(multi_index, "MEMBERS_A_CELL", members)
    monkeypatch.setattr(multi_index, "BLOCK", 32)
    monkeypatch.setattr(multi_index, "BROADCAST_CELLS", 0 if members == 20 else 1000)
    x = vectors(3)
    rows = {r["vec_id"]: r for r in multi_index.near_duplicate_vectors(vector_frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], kind)).collect()}
    hit = brute_links(x)
    got = np.array([rows[i]["n_links"] for i in range(len(x))])
    assert (got <= hit.sum(1)).all() and got.sum() >= 0.97 * hit.sum()
    assert all(r["component_id"] <= i and rows[r["component_id"]]["kept"] for i, r in rows.items())


def test_small_tables_use_the_grid():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert multi_index.fit(x, 300, 0.9).cells > 1
    assert multi_index.fit(x, 10**12, 0.9).left.shape[0] <= multi_index.MOST_CODEWORDS


@pytest.mark.parametrize("cosine", [0.901, 0.93, 0.97])
def test_recall_by_cosine(cosine):
    """Pairs made at a cosine meet in a cell, from one side or the other."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = multi_index.fit(x[:2000], 20000, 0.9)
    q = x[2000:]
    p = multi_index.partners(q, cosine, rng)
    a, b = index.visits(q), index.visits(p)
    met = [b[i][0] in a[i] or a[i][0] in b[i] for i in range(len(q))]
    assert np.mean(met) >= 0.95 and np.mean([len(v) for v in a]) < 0.5 * index.cells


def test_every_dimension_and_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "OWN_INDEX", 30)
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for size, n in ((3, 100), (4, 60), (5, 4), (7, 2)):
        x = rng.normal(size=(n // 2, size)).astype(np.float32)
        for v in x:
            rows += [(at, v.tolist()), (at + 1, (v * 2).tolist())]
            at += 2
    out = {r["vec_id"]: r for r in multi_index.near_duplicate_vectors(vector_frame(spark, rows)).collect()}
    want = {}
    for i, v in rows:
        same = [(j, np.array(w)) for j, w in rows if len(w) == len(v)]
        want[i] = sum(j != i and np.dot(w, v) / np.linalg.norm(w) / np.linalg.norm(v) >= 0.9 for j, w in same)
    got = {i: r["n_links"] for i, r in out.items()}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.95 * sum(want.values())
    assert got[160] == want[160] and got[164] == want[164] == 1
    rows = [(3, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 2.0]), (8, [-1.0, 0.0]), (8, [0.0, -1.0]), (9, [0.0, -2.0])]
    out = multi_index.near_duplicate_vectors(vector_frame(spark, rows)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in out) == [
        ("3", 2, "3", True), ("8", 0, "8", True), ("8", 1, "8", True), ("9", 1, "8", False),
        ("None", 1, "None", True), ("None", 1, "None", True), ("None", 2, "3", False), ("None", 2, "3", False),
    ]


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []),
        (10, [-1.0, 0.0]), (11, [1e30, 1e28]), (None, [0.0, 5.0]),
    ]
    out = multi_index.near_duplicate_vectors(vector_frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[11] == (3, 1, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert by[None] == (0, None, True)
    assert multi_index.near_duplicate_vectors(vector_frame(spark, [])).isEmpty()


def test_multi_sequence_order():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 8))
    index = multi_index.MultiIndex(rng.normal(size=(6, 4)), rng.normal(size=(5, 4)))
    total = (((x[:, None, :4] - index.left) ** 2).sum(2)[:, :, None] + ((x[:, None, 4:] - index.right) ** 2).sum(2)[:, None, :]).reshape(50, -1)
    for margin in (0.0, 1.0, 4.0, np.inf):
        index.margin = margin
        for row, got in zip(total, index.visits(x)):
            want = np.argsort(row, kind="stable")
            assert got.tolist() == want[row[want] <= row.min() + margin].tolist()
