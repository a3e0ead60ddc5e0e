"""Byte-level BPE and packing."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from loomgraph.llm import bpe, packing

RANKS_FILE, JSON_FILE = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PIECES = ["a", "b", "e", "r", "th", "ing", " ", "  ", "\n", "é", "ß", "0", "12", "!!", "--", "'s", "\U0001f600", "中", "zzzzz", "\x1c", "²", "_", "\t", "\xa0", "<|endoftext|>"]
SCHEMA = "doc_id long, text string, piece string, sequence_id string, start string, length double, ids string, n_tokens string"
EDGE = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "no id"), (4, "word " * 30000), (5, "x" * 50000), (6, "<|endoftext|> ²³ \x1c"), (7, "é\n\n  \U0001f600")]


@pytest.fixture(scope="module")
def official():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS_FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def documents(spark, rows):
    return spark.createDataFrame([(*r, "p", "s", "t", 1.0, "i", "n") for r in rows], SCHEMA)


def test_encoding_is_the_librarys(official):
    codec, rng = bpe.load(RANKS_FILE, P.PATTERN), random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice(PIECES) for _ in range(rng.randrange(40)))
        assert codec.encode(s) == official.encode_ordinary(s)
        assert codec.decode(codec.encode(s)) == s.encode()


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(s):
    codec = bpe.load(RANKS_FILE, P.PATTERN)
    ids = codec.encode(s)
    assert codec.decode(ids) == s.encode()


def test_small_vocabulary_backtracks():
    # "abc" merges as ab + c, so the longest token bc after a is wrong.
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"ab": 4, b"cd": 5, b"bc": 6, b"abcd": 7, b"bcd": 8}
    codec = bpe.ByteBPE(ranks, r"[a-d]+")
    e = tiktoken.Encoding("t", pat_str=r"[a-d]+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    rng = random.Random(1)
    for _ in range(2000):
        s = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
        assert codec.encode(s) == e.encode_ordinary(s), s


def test_long_runs_are_linear(official):
    codec = bpe.load(RANKS_FILE, P.PATTERN)
    for s in ("e" * 3999 + "r", "ab" * 2000):
        assert codec.encode(s) == official.encode_ordinary(s)
    assert codec.decode(codec.encode("th" * 200000)) == b"th" * 200000


def test_missing_byte():
    with pytest.raises(ValueError):
        bpe.ByteBPE({b"a": 0}, r"\w+").encode("b")


def test_encode_documents(spark, official):
    rows = bpe.encode_digests(documents(spark, EDGE), RANKS_FILE, P.PATTERN).collect()
    assert len(rows) == len(EDGE)
    want = sorted(
        (str(i), len(ids := official.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in EDGE
    )
    assert sorted((str(r["doc_id"]), *r[1:]) for r in rows) == want
    plain = bpe.encode_documents(documents(spark, EDGE[:3]), RANKS_FILE, P.PATTERN).collect()
    assert all(bytes(r["decoded"]).decode() == (t or "") for r, (_, t) in zip(plain, EDGE))
    assert bpe.encode_digests(documents(spark, []), RANKS_FILE, P.PATTERN).isEmpty()


def check_packing(rows, texts, capacity):
    tok = Tokenizer.from_file(JSON_FILE)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for key, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[key], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // capacity)))
        assert all(r["length"] == capacity for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(sequences)


def test_pack_documents(spark):
    rows = packing.pack_documents(documents(spark, EDGE), JSON_FILE, capacity=512).collect()
    check_packing(rows, {i: t for i, t in EDGE if i != 3}, 512)
    assert sum(r["doc_id"] == 3 for r in rows) == 2
    assert packing.pack_documents(documents(spark, []), JSON_FILE).isEmpty()
    kept = packing.pack_documents(documents(spark, EDGE[:3]), JSON_FILE, keep_ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in kept)


def test_plans_are_whole_and_as_tight_as_best_fit():
    rng = np.random.default_rng(4)
    for capacity in (1, 7, 100, 2048):
        for size in (0, 1, 50, 4000):
            counts = np.bincount(np.minimum(capacity, 1 + rng.geometric(8 / (capacity + 8), size)), minlength=capacity + 1) if size else np.zeros(capacity + 1, int)
            used = np.zeros(capacity + 1, int)
            total = 0
            for n, runs in packing.plan_sequences(counts, capacity):
                assert n > 0 and sum(a * k for a, k in runs) <= capacity
                total += n
                for a, k in runs:
                    used[a] += n * k
            assert (used == counts).all()
            plain = packing.Plan(capacity)
            for n in range(capacity, 0, -1):
                if counts[n]:
                    plain.best_fit(n, int(counts[n]))
            assert total <= 1.005 * sum(n for n, _ in plain.groups()) + 1


def test_least_squares_and_patterns():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 30)), np.zeros(30)
    x[[2, 7, 20]] = 3, 1, 5
    assert np.abs(a @ packing.nonnegative_least_squares(a, a @ x) - a @ x).max() < 1e-6
    bad = packing.nonnegative_least_squares(np.eye(3), np.array([1.0, -2.0, 3.0]))
    assert np.allclose(bad, [1, 0, 3])
    patterns = packing.length_patterns(12, 2)
    assert all(sum(p) == 12 and min(p) >= 2 and list(p) == sorted(p, reverse=True) for p in patterns)
    brute = {tuple(sorted(p, reverse=True)) for n in (1, 2, 3) for p in np.ndindex(*[13] * n) if sum(p) == 12 and min(p) >= 2}
    assert set(patterns) == brute and len(patterns) == len(brute)
