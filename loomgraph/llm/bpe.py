"""Byte-level BPE: exact merges in linear time, encoding and decoding.

A piece of text becomes bytes, the bytes become Latin-1 characters, and an Aho-Corasick automaton over
the vocabulary (in the same form) gives the longest token at every position. Tokens are laid from the
left. A token may follow another only if merging by rank would leave the boundary between them alone;
that test depends on the two tokens only and is memoised. Where the longest token does not fit, its
shorter prefixes are tried, and where none fits the last token is taken back and its end is barred.
Every end is barred at most once, hence linear time.

Null and empty texts have no tokens. Texts may be of any length; nothing is cut. Repeated rows get equal
results, a null id stays, an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.arrow import map_rows

#: Bytes that a worker's table of pieces and their ids may take, as counted by Known; beyond it the table starts anew.
KNOWN_BYTES = 80_000_000
#: Longer pieces are not kept.
LONGEST_KNOWN = 128
_ENTRY = 160

# The tokenizer's splitting rule in the syntax of the standard library. The two agree where no character
# is of a class that they see differently: see ODD.
PLAIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN_OF = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ–-…€]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """text -> the pattern's matches, by the faster of two engines that agree on the text."""
    exact = regex.compile(pattern).findall
    if pattern != PLAIN_OF:
        return exact
    plain, odd = PLAIN.findall, ODD.search
    return lambda text: exact(text) if odd(text) else plain(text)


class Known(dict):
    """piece -> its ids as bytes, made by ``encode`` on demand and kept within ``KNOWN_BYTES``."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.size = encode, 0

    def __missing__(self, piece: str) -> bytes:
        found = self.encode(piece)
        if len(piece) <= LONGEST_KNOWN:
            self.size += _ENTRY + 4 * len(piece) + len(found)
            if self.size > KNOWN_BYTES:
                self.clear()
                self.size = _ENTRY + 4 * len(piece) + len(found)
            self[piece] = found
        return found


class ByteBPE:
    """The codec of one vocabulary; ``ranks`` maps token bytes to ids, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.ranks = {b.decode("latin-1"): i for b, i in ranks.items()}
        self.text = {i: s for s, i in self.ranks.items()}
        self.split_text = splitter(pattern)
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ranks.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.length = {i: len(t) for i, t in self.text.items()}
        self.unusable = {i for i in self.text if not self.usable(i)}
        self._table: dict[str, bytes] | None = None

    def shorter(self, token: int) -> int:
        """The longest usable token that is a proper prefix of ``token``, or -1."""
        found = self._shorter.get(token)
        if found is None:
            s, found = self.text[token], -1
            for n in range(len(s) - 1, 0, -1):
                t = self.ranks.get(s[:n])
                if t is not None and self.usable(t):
                    found = t
                    break
            self._shorter[token] = found
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte, or if no merging makes it."""
        if token not in self._halves:
            s, found = self.text[token], None
            for n in range(len(s) - 1, 0, -1):
                a, b = self.ranks.get(s[:n]), self.ranks.get(s[n:])
                if a is not None and b is not None and a < token and b < token and self.usable(a) and self.usable(b) and self._apart(a, b, token):
                    found = (a, b)
                    break
            self._halves[token] = found
        return self._halves[token]

    def usable(self, token: int) -> bool:
        return len(self.text[token]) == 1 or self.halves(token) is not None

    def _apart(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Undo the merges inside ``a`` and ``b`` from the last; does any merge across come before?"""
        ranks, text = self.ranks, self.text
        while True:
            across = ranks.get(text[a] + text[b])
            if across is not None and across < limit:
                return False
            left = self.halves(a) if len(text[a]) > 1 else None
            right = self.halves(b) if len(text[b]) > 1 else None
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                limit, a = a, left[1]
            else:  # of equal ranks the left one merges first
                limit, b = b + 1, right[0]

    def fits(self, a: int, b: int) -> bool:
        key = (a, b)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            found = self._fits[key] = self._apart(a, b)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        s = piece.decode("latin-1")
        whole = self.ranks.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        longest = [-1] * n
        length, unusable = self.length, self.unusable
        for end, token in self.automaton.iter(s):  # ends rise, so later means longer
            if token not in unusable:
                longest[end + 1 - length[token]] = token
        barred = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if not barred[end] and (last < 0 or self.fits(last, token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte of this text")
                barred[at] = 1
                out.pop()
                at -= length[last]
                token = self.shorter(last)
        return out

    def table(self) -> dict[str, bytes]:
        """piece -> its ids as little-endian unsigned 32-bit integers, filled on demand; one a process."""
        if self._table is not None:
            return self._table
        self._table = Known(lambda piece: np.array(self.encode_piece(piece.encode()), "<u4").tobytes())
        return self._table

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.split_text(text or "") for i in self.encode_piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@functools.lru_cache(2)
def load(path: str, pattern: str) -> ByteBPE:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ByteBPE(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded binary) of every row: the ids as unsigned 32-bit, and their decoding."""
    return _encoded(docs, path, pattern, id_col, text_col, False)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, but digests made where the ids are: n_tokens, ids_sha256, decoded_sha256."""
    return _encoded(docs, path, pattern, id_col, text_col, True)


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    def make():
        codec = load(path, pattern)
        table, split, vocabulary = codec.table(), codec.split_text, codec.vocabulary

        def one(key, text):
            ids = b"".join(map(table.__getitem__, split(text or "")))
            decoded = b"".join(map(vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))
            if digests:
                yield key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
            else:
                yield key, ids, decoded

        return one

    if digests:
        names, spark_type = ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string"
        types = [pa.int64(), pa.string(), pa.string()]
    else:
        names, spark_type, types = ["ids", "decoded"], "ids binary, decoded binary", [pa.binary(), pa.binary()]
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_rows(rows, make, f"{id_col} long, {spark_type}", pa.schema(list(zip([id_col, *names], [pa.int64(), *types]))))
