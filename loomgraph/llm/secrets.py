"""Secret scan through nested encodings.

Each text starts a worklist of layers. A layer is scanned for secrets, then unwrapped in every way that
applies: percent escapes and Unicode escapes over the whole layer, base64 runs one by one and joined over
line ends, each at all four alignments (a run may begin with a path or a name), and zlib or gzip data
wherever it begins in decoded bytes. Bytes that are not UTF-8 are read as Latin-1. What comes out are new layers, unless their content has been seen (this ends
cycles). The worklist runs until no layer is left. Every finding is mapped back, layer by layer, to the
code points of the original text that carry it.

Null text counts as empty and has no findings. Texts are scanned whole. Compressed data that unpacks to more
than ``MAX_LAYER`` bytes is unpacked in a stream and scanned in windows that overlap by ``OVERLAP`` bytes, so
memory stays bounded; a finding or a nested layer of more than that which crosses windows is seen in parts.
Repeated rows get equal results, an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.arrow import map_rows

KINDS = ("assign", "access", "hex")
MAX_LAYER = 1 << 26
WINDOW = 1 << 24
OVERLAP = 1 << 20

# The three kinds of secrets, with the least length of what must be long.
_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ASSIGN_LEAST = 12
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_ACCESS_LEAST = 18
_HEX = re.compile("[0-9a-f]+")
_HEX_LEAST = 16
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: The shortest base64 run that can hold the shortest secret, 16 hex digits.
_BASE64_LEAST = 22
_BASE64 = re.compile("[A-Za-z0-9+/_-]{%d,}={0,2}" % _BASE64_LEAST)
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]++(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)++={0,2}")
_BREAK = re.compile(r"\s+")
#: First bytes of gzip and of zlib without a preset dictionary.
_HEAD = re.compile(b"\x1f\x8b\x08|" + b"|".join(re.escape(bytes((a, b))) for a in range(8, 128, 16) for b in range(256) if (a << 8 | b) % 31 == 0 and not b & 32))
_PERCENT = re.compile("(?:%[0-9A-Fa-f]{2})+")
_ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)")

_HEX_CLASS = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_BASE64_CLASS = bytes(1 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 0 for c in range(256))

Span = tuple[int, int, int]  # start, kind, end


def scan_layer(text: str, raw: bytes | None = None) -> list[Span]:
    """Findings in one layer, in order of start, then kind."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    found: list[Span] = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    if b"\x01" * _HEX_LEAST in raw.translate(_HEX_CLASS):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= _HEX_LEAST]
    return sorted(found)


class _Replaced:
    """A layer in which some stretches were decoded; maps its spans to the layer it came from."""

    def __init__(self, text: str, pattern: re.Pattern, decode: Callable[[str], list[tuple[str, int, int]]]):
        self.at: list[int] = []  # starts of the new layer's segments
        self.of: list[tuple[int, int, bool]] = []  # source start, source end, kept as it is
        out, size, last = [], 0, 0
        for m in pattern.finditer(text):
            parts = [(text[last : m.start()], last - m.start(), 0)] if m.start() > last else []
            for piece, start, end in parts + decode(m.group()):
                self.at.append(size)
                self.of.append((m.start() + start, m.start() + end, start < 0))
                out.append(piece)
                size += len(piece)
            last = m.end()
        if last < len(text):
            self.at.append(size)
            self.of.append((last, len(text), True))
            out.append(text[last:])
        self.text = "".join(out)

    def span(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first, last = self.of[i], self.of[j]
        return (first[0] + start - self.at[i] if first[2] else first[0], last[0] + end - self.at[j] if last[2] else last[1])


def _percent(run: str) -> list[tuple[str, int, int]]:
    raw, out, at = bytes.fromhex(run.replace("%", "")), [], 0
    while at < len(raw):
        n = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        try:
            piece = raw[at : at + n].decode()
        except UnicodeDecodeError:
            n, piece = 1, chr(raw[at])
        out.append((piece, 3 * at, 3 * min(at + n, len(raw))))
        at += n
    return out


def _percent_bytes(run: str) -> list[tuple[str, int, int]]:
    return [(chr(c), 3 * i, 3 * i + 3) for i, c in enumerate(bytes.fromhex(run.replace("%", "")))]


def _escapes(run: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for m in _ESCAPE.finditer(run):
        code = int(m[1] or m[2], 16)
        if 0xDC00 <= code < 0xE000 and out and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, start, _ = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), start, m.end()))
        else:
            out.append((chr(code) if code < 0x110000 else "�", m.start(), m.end()))
    return out


def _inflate(raw: bytes, start: int) -> tuple[bytes | None, int] | None:
    """What the data at ``start`` unpacks to, None if that is large, and where it ends."""
    worker = zlib.decompressobj(47)
    try:
        out = worker.decompress(memoryview(raw)[start:], MAX_LAYER)
    except zlib.error:
        return None
    if worker.eof:
        return out, len(raw) - len(worker.unused_data)
    if len(out) < MAX_LAYER:
        return None  # cut off
    end = -1
    for _, end in _windows(raw, start):
        pass
    return (None, end) if end >= 0 else None


def _windows(raw: bytes, start: int) -> Iterator[tuple[bytes, int]]:
    """Overlapping windows of what the data at ``start`` unpacks to, and with the last one, where the data ends (else -1)."""
    worker, feed, tail = zlib.decompressobj(47), memoryview(raw)[start:], b""
    while not worker.eof:
        try:
            out = worker.decompress(feed, WINDOW)
        except zlib.error:
            return
        feed = worker.unconsumed_tail
        if not out and not feed and not worker.eof:
            return
        window = tail + out
        yield window, len(raw) - len(worker.unused_data) if worker.eof else -1
        tail = window[-OVERLAP:]


def _packed(raw: bytes) -> list[tuple[int, int, bytes | None]]:
    """start, end and content of all compressed data, None where it is large; what follows without a gap belongs together."""
    found: list[tuple[int, int, list[bytes], int]] = []
    at = 0
    while m := _HEAD.search(raw, at):
        start, at = m.start(), m.start() + 1
        if (inflated := _inflate(raw, start)) is None:
            continue
        out, at = inflated
        if out is None:
            found.append((start, at, [], MAX_LAYER))
            continue
        if found and found[-1][1] == start and found[-1][3] + len(out) <= MAX_LAYER:
            first, _, parts, size = found.pop()
            parts.append(out)
            found.append((first, at, parts, size + len(out)))
        else:
            found.append((start, at, [out], len(out)))
    return [(a, b, b"".join(parts) if parts else None) for a, b, parts, _ in found]


Mapping = Callable[[int, int], tuple[int, int]]


def _unpacked(raw: bytes, place: Mapping) -> Iterator[tuple[str, Mapping]]:
    """The texts of all compressed data in ``raw``, also inside each other."""
    work, known = [(raw, place)], set()
    while work:
        raw, place = work.pop()
        for a, b, inner in _packed(raw):
            at = place(a, b)
            if inner is None:
                whole = lambda a, b, at=at: at
                for window, _ in _windows(raw, a):
                    yield _text(window)[0], whole
                    yield from _unpacked(window, whole)
                continue
            key = (at, hashlib.blake2b(inner, digest_size=16).digest())
            if key not in known:  # data that unpacks to itself ends here
                known.add(key)
                whole = lambda a, b, at=at: at
                work.append((inner, whole))
                yield _text(inner)[0], whole


def _text(raw: bytes) -> tuple[str, bool]:
    """The bytes as text, and whether each character is one byte."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1"), True
    return text, len(text) == len(raw)


def _runs(text: str, raw: bytes) -> Iterator[tuple[str, list[int] | range, int]]:
    """Base64 runs without padding, the place of each character, and the end with the padding."""
    if b"\x01" * _BASE64_LEAST in raw.translate(_BASE64_CLASS):
        for m in _BASE64.finditer(text):
            run = m.group().rstrip("=")
            yield run, range(m.start(), m.start() + len(run)), m.end()
    if b"\n" in raw:
        for m in _WRAPPED.finditer(text):
            if m.end() - m.start() <= _BASE64_LEAST:
                continue
            body = m.group().rstrip("=")
            run = _BREAK.sub("", body)
            if len(run) >= _BASE64_LEAST:
                yield run, [m.start() + i for i, c in enumerate(body) if c not in " \t\r\n"], m.end()


def _unwrapped(text: str, raw: bytes) -> Iterator[tuple[str, Mapping]]:
    """The layers directly inside ``text``, each with the mapping of its spans."""
    if b"%" in raw and _PERCENT.search(text):
        layer = _Replaced(text, _PERCENT, _percent)
        yield layer.text, layer.span
        layer = _Replaced(text, _PERCENT, _percent_bytes)
        yield from _unpacked(layer.text.encode("latin-1", "replace"), layer.span)
    if b"\\" in raw and _ESCAPES.search(text):
        layer = _Replaced(text, _ESCAPES, _escapes)
        yield layer.text, layer.span
        yield from _unpacked(layer.text.encode("latin-1", "replace"), layer.span)
    for run, places, full in _runs(text, raw):
        run = run.replace("-", "+").replace("_", "/")
        for skip in range(4):
            if len(run) - skip < _BASE64_LEAST:
                break
            part = run[skip:-1] if (len(run) - skip) % 4 == 1 else run[skip:]
            data = base64.b64decode(part + "=" * (-len(part) % 4))

            def place(a, b, p=places, k=skip):
                return p[k + a * 8 // 6], p[min(len(p), k - (-b * 8 // 6)) - 1] + 1

            def whole(a, b, place=place, size=len(data), e=full):
                start, end = place(a, b)
                return start, e if b == size else end

            inner, narrow = _text(data)
            if narrow:
                yield inner, place
            else:
                yield inner, lambda a, b, place=place, wide=inner: place(len(wide[:a].encode()), len(wide[:b].encode()))
            yield from _unpacked(data, whole)


def find_secrets(text: str | None) -> tuple[list[Span], list[Span]]:
    """(findings in the text itself, those and the ones of all layers), each by start, kind, end."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    base = scan_layer(text, raw)
    spans = set(base)
    seen: set[bytes] = set()
    # The innermost open layer's layers come next, one at a time.
    work: list[tuple[Iterator[tuple[str, Mapping]], tuple[Mapping, ...]]] = [(_unwrapped(text, raw), ())]
    while work:
        layers, mappings = work[-1]
        following = next(layers, None)
        if following is None:
            work.pop()
            continue
        layer, mappings = following[0], (*mappings, following[1])
        raw = layer.encode("utf-8", "surrogatepass")
        # Equal content at another place is another finding, but inside its own chain it is a cycle.
        start, end = 0, len(layer)
        for mapping in reversed(mappings):
            start, end = mapping(start, end) if layer else (0, 0)
        key = hashlib.blake2b(raw + b"\0%d:%d" % (start, end), digest_size=16).digest()
        if not layer or key in seen:
            continue
        seen.add(key)
        for a, kind, b in scan_layer(layer, raw):
            for mapping in reversed(mappings):
                a, b = mapping(a, b)
            spans.add((a, kind, b))
        work.append((_unwrapped(layer, raw), mappings))
    return base, sorted(spans)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans of every row: arrays of (kind, start, end), code points, end exclusive."""

    def make():
        def one(key, text):
            base, spans = find_secrets(text)
            yield key, *([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in (base, spans))

        return one

    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = "array<struct<kind: string, start: long, end: long>>"
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_rows(rows, make, f"{id_col} long, base {schema}, spans {schema}", pa.schema([(id_col, pa.int64()), ("base", item), ("spans", item)]))
