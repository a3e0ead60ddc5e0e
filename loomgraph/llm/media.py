"""Media columns: what stored bytes really are, by their signatures, and what is embedded in them.

An Aho-Corasick automaton (over Latin-1 characters) locates every magic number in one pass. At each hit
the validator of that format walks the structure and returns the length, or nothing. A valid structure
at offset 0 that spans all bytes gives the type, whatever was declared; valid structures further in are
carved, outermost first.

Null bytes count as empty, of type application/octet-stream, with an empty payload. Equal bytes get equal results; repeated
rows stay, an empty table gives no rows, other columns are ignored. A PDF ends with its last %%EOF before another PDF begins. The formats
written here, 8-bit mono WAV and 8-bit greyscale PNM, hold the payload as samples without loss.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.arrow import map_rows

UNKNOWN = "application/octet-stream"
BLOCK = 64


# ---- validators: (data, offset) -> length of the valid structure there, 0 if none


def _riff(form: bytes, least: int) -> Callable[[bytes, int], int]:
    def check(d: bytes, at: int) -> int:
        if d[at + 8 : at + 12] != form:
            return 0
        size = int.from_bytes(d[at + 4 : at + 8], "little") + 8
        if size < least or at + size > len(d):
            return 0
        p, names = at + 12, set()
        while p + 8 <= at + size:
            names.add(d[p : p + 4])
            n = int.from_bytes(d[p + 4 : p + 8], "little")
            p += 8 + n + (n & 1)
        if p < at + size or p > at + size + 1:
            return 0
        return size if form != b"WAVE" or {b"fmt ", b"data"} <= names else 0

    return check


def _png(d: bytes, at: int) -> int:
    p = at + 8
    first = True
    while p + 12 <= len(d):
        n, name = int.from_bytes(d[p : p + 4], "big"), d[p + 4 : p + 8]
        if p + 12 + n > len(d) or first != (name == b"IHDR") or first and n != 13:
            return 0
        if zlib.crc32(d[p + 4 : p + 8 + n]) != int.from_bytes(d[p + 8 + n : p + 12 + n], "big"):
            return 0
        first, p = False, p + 12 + n
        if name == b"IEND":
            return p - at
    return 0


def _jpeg(d: bytes, at: int) -> int:
    p, scanned = at + 2, False
    while p + 4 <= len(d) and d[p] == 0xFF:
        marker = d[p + 1]
        if marker == 0xD9:
            return p + 2 - at if scanned else 0
        if marker in (0x00, 0x01) or 0xD0 <= marker <= 0xD8:
            return 0
        n = int.from_bytes(d[p + 2 : p + 4], "big")
        if n < 2:
            return 0
        p += 2 + n
        if marker == 0xDA:
            scanned = True
            while True:  # entropy-coded data, to the next marker
                p = d.find(b"\xff", p)
                if p < 0 or p + 1 >= len(d):
                    return 0
                if d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
            if d[p + 1] == 0xD9:
                return p + 2 - at
    return 0


def _gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    flags, p = d[at + 10], at + 13
    p += 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += d[p] + 1
        return p + 1

    while p < len(d):
        kind = d[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21:
            p = blocks(p + 2)
        elif kind == 0x2C and p + 10 < len(d):
            flags = d[p + 9]
            p += 10 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
            p = blocks(p + 1)
        else:
            return 0
    return 0


def _bmp(d: bytes, at: int) -> int:
    if at + 54 > len(d):
        return 0
    size, spare, start, header = struct.unpack_from("<IIII", d, at + 2)
    planes, bits = struct.unpack_from("<HH", d, at + 26)
    fine = not spare and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return size if fine and 14 + header <= start <= size <= len(d) - at else 0


def _gzip(d: bytes, at: int) -> int:
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return 0
    worker, p = zlib.decompressobj(31), at
    try:
        while p < len(d) and not worker.eof:
            part = d[p : p + 65536]
            worker.decompress(part, 1 << 20)
            while worker.unconsumed_tail:
                worker.decompress(worker.unconsumed_tail, 1 << 20)
            p += len(part)
    except zlib.error:
        return 0
    return p - len(worker.unused_data) - at if worker.eof else 0


def _pdf(d: bytes, at: int) -> int:
    if not d[at + 5 : at + 6].isdigit():
        return 0
    following = d.find(b"%PDF-", at + 5)
    end = d.rfind(b"%%EOF", at, following if following >= 0 else len(d))
    if end < 0 or d.rfind(b"startxref", at, end) < 0:
        return 0
    end += 5
    return end + (2 if d[end : end + 2] == b"\r\n" else d[end : end + 1] in (b"\r", b"\n")) - at


@functools.lru_cache(1)
def _zip_ends(d: bytes) -> list[int]:
    """Where end records begin, found once for all entries."""
    return [m.start() for m in re.finditer(rb"PK\x05\x06", d)]


def _zip(d: bytes, at: int) -> int:
    ends = _zip_ends(d)
    i = bisect.bisect_left(ends, at)
    if i == len(ends) or ends[i] + 22 > len(d):
        return 0
    end = ends[i]
    entries, size, start, note = struct.unpack_from("<HIIH", d, end + 10)
    if at + start + size != end or entries and d[at + start : at + start + 4] != b"PK\x01\x02":
        return 0
    return end + 22 + note - at if end + 22 + note <= len(d) else 0


def _ogg(d: bytes, at: int) -> int:
    p, serial = at, d[at + 14 : at + 18]
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d) and d[p + 14 : p + 18] == serial:
        table = d[p + 27 : p + 27 + d[p + 26]]
        size = 27 + len(table) + sum(table)
        if d[p + 4] or len(table) != d[p + 26] or p + size > len(d):
            return 0
        last, p = d[p + 5] & 4, p + size
        if last:
            break
    return p - at


def _crc_table(polynomial: int, bits: int) -> list[int]:
    table = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = x << 1 ^ polynomial if x >> bits - 1 else x << 1
        table.append(x & (1 << bits) - 1)
    return table


# The polynomials of frame headers and of whole frames.
_CRC8, _CRC16 = _crc_table(0x107, 8), _crc_table(0x18005, 16)


def _flac_header(d: bytes, p: int) -> tuple[int, int]:
    """(length, samples) of the frame header at ``p``, zeros if there is none."""
    if p + 6 > len(d) or d[p] != 0xFF or d[p + 1] & 0xFE != 0xF8 or d[p + 3] & 1:
        return 0, 0
    block, rate, ones = d[p + 2] >> 4, d[p + 2] & 15, 8 - (~d[p + 4] & 0xFF).bit_length()
    if block == 0 or rate == 15 or d[p + 3] >> 4 > 10 or ones in (1, 8):
        return 0, 0
    q = p + 4 + max(1, ones)
    wide, samples = (block == 6) + 2 * (block == 7), 192 if block == 1 else 576 << block - 2 if block < 6 else 256 << max(0, block - 8)
    if wide:
        samples = int.from_bytes(d[q : q + wide], "big") + 1
    q += wide + (rate == 12) + 2 * (rate in (13, 14))
    crc = 0
    for x in d[p:q]:
        crc = _CRC8[crc ^ x]
    return (q + 1 - p, samples) if q < len(d) and d[q] == crc else (0, 0)


def _flac(d: bytes, at: int) -> int:
    """Frame by frame, each confirmed by its checksum; the last ends at the end of the bytes, or where its checksum is right first."""
    if at + 42 > len(d) or d[at + 4] & 0x7F or d[at + 5 : at + 8] != b"\0\0\x22":
        return 0
    facts = int.from_bytes(d[at + 18 : at + 26], "big")
    channels, bits, total = (facts >> 41 & 7) + 1, (facts >> 36 & 31) + 1, facts & (1 << 36) - 1
    p, last = at + 4, 0
    while not last:
        if p + 4 > len(d) or d[p] & 0x7F == 127:
            return 0
        last, p = d[p] & 0x80, p + 4 + int.from_bytes(d[p + 1 : p + 4], "big")
    done = 0
    while p < len(d):
        head, samples = _flac_header(d, p)
        if not head:
            return 0
        done += samples
        final = 0 < total <= done
        crc, first, following = 0, 0, 0
        # No frame is longer than its samples as they are, with room for the headers of its channels.
        for q in range(p, min(len(d), p + head + 2 + channels * (16 + samples * (bits + 1) // 8))):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ d[q]]
            if not crc and q >= p + head + 2:
                first = first or q + 1
                if q + 1 == len(d):
                    return q + 1 - at if final or not total else 0
                if not final and _flac_header(d, q + 1)[0]:
                    following = q + 1
                    break
        if not following:
            return first - at if first and (final or not total) else 0
        p = following
    return p - at if p == len(d) and not total else 0


def _mp4(d: bytes, at: int) -> int:
    p = at
    while p + 8 <= len(d) and d[p + 4 : p + 8].isalnum():
        n, least = int.from_bytes(d[p : p + 4], "big"), 8
        if n == 1:  # the size stands behind the type
            n, least = int.from_bytes(d[p + 8 : p + 16], "big"), 16
        elif n == 0:  # up to the end
            n = len(d) - p
        if n < least or p + n > len(d):
            return 0
        p += n
    return p - at


def _pnm(d: bytes, at: int) -> int:
    head = d[at : at + 40].split(None, 4)
    if len(head) < 4 or not all(x.isdigit() for x in head[1:4]) or head[3] != b"255":
        return 0
    width, height = int(head[1]), int(head[2])
    written = b"P5\n%d %d\n255\n" % (width, height)
    size = len(written) + width * height
    return size if d[at : at + len(written)] == written and at + size <= len(d) and width and height else 0


# Magic number, where it stands in the structure, type, validator.
FORMATS: list[tuple[bytes, int, str, Callable[[bytes, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"BM", 0, "image/bmp", _bmp),
    (b"P5\n", 0, "image/x-portable-graymap", _pnm),
    (b"WEBP", 8, "image/webp", _riff(b"WEBP", 20)),
    (b"WAVE", 8, "audio/wav", _riff(b"WAVE", 44)),
    (b"AVI ", 8, "video/x-msvideo", _riff(b"AVI ", 20)),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
]


@functools.lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, (magic, _, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


def structures(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all valid structures, outermost first and none inside another."""
    found, reach = [], 0
    for end, i in _automaton().iter(data.decode("latin-1")):
        magic, place, kind, check = FORMATS[i]
        at = end + 1 - len(magic) - place
        if at >= reach and (place != 8 or data[at : at + 4] == b"RIFF") and (n := check(data, at)):
            found.append((at, n, kind))
            if (at, n) != (0, len(data)):
                reach = at + n  # what is inside of what is carved need not be looked at
    return sorted(found, key=lambda x: (x[0], -x[1]))


def sniff(data: bytes | None, declared: str | None) -> tuple[str, bool, list[tuple[int, int, str]]]:
    """(type, whether the declaration was wrong, what is embedded, outermost only)."""
    found = structures(data or b"")
    kind = next((k for at, n, k in found if at == 0 and n == len(data)), None)
    carved, reach = [], 0
    for at, n, k in found:
        if (at, n, k) != (0, len(data), kind) and at >= reach:
            carved.append((at, n, k))
            reach = at + n
    kind = kind or UNKNOWN
    return kind, kind != (declared or UNKNOWN), carved


# ---- storing bytes as samples


def wav_bytes(payload: bytes, rate: int = 8000) -> bytes:
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def wav_samples(stored: bytes) -> bytes:
    """The samples of an 8-bit mono WAV, found by walking its chunks."""
    if not _riff(b"WAVE", 44)(stored, 0):
        raise ValueError("no WAV")
    p = 12
    while stored[p : p + 4] != b"data":
        n = int.from_bytes(stored[p + 4 : p + 8], "little")
        p += 8 + n + (n & 1)
    return stored[p + 8 : p + 8 + int.from_bytes(stored[p + 4 : p + 8], "little")]


def pgm_bytes(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (BLOCK, len(payload) // BLOCK) + payload


def pgm_samples(stored: bytes) -> bytes:
    if not _pnm(stored, 0):
        raise ValueError("no PGM")
    return stored[stored.index(b"255\n") + 4 :]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return len(raw), raw.ljust(size, b"\0")


STORE = {"audio/wav": (wav_bytes, wav_samples), "image/x-portable-graymap": (pgm_bytes, pgm_samples)}


def store_texts(docs: DataFrame, kind: str = "audio/wav", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text, padded to whole blocks, as the samples of one media file."""

    def make():
        write = STORE[kind][0]

        def one(key, text):
            n, payload = padded(text)
            yield key, n, write(payload)

        return one

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_rows(rows, make, f"{id_col} long, n_bytes long, media binary", pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())]))


def sniff_media(media: DataFrame, id_col: str, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """id, media_type, corrected, embedded array of (start, length, type, bytes) of every row."""

    def make():
        def one(key, data, declared):
            kind, corrected, carved = sniff(data, declared)
            yield key, kind, corrected, [{"start": a, "length": n, "type": k, "data": data[a : a + n]} for a, n, k in carved]

        return one

    item = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("data", pa.binary())]))
    rows = media.select(F.col(id_col).cast("long"), media_col, declared_col)
    return map_rows(
        rows, make, f"{id_col} long, media_type string, corrected boolean, embedded array<struct<start: long, length: long, type: string, data: binary>>",
        pa.schema([(id_col, pa.int64()), ("media_type", pa.string()), ("corrected", pa.bool_()), ("embedded", item)]),
    )


def media_digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads stored media (id, n_bytes, media, declared) back: digests of payload and file, and what sniffing finds."""

    def make():
        def one(key, n, media, declared):
            media = media or b""
            kind, corrected, carved = sniff(media, declared)
            payload = STORE[kind][1](media) if kind in STORE else b""
            feature = f"{kind};corrected={int(corrected)};embedded=" + "+".join(f"{k}@{a}:{m}" for a, m, k in carved)
            yield key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature

        return one

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    of = {"string": "string", "int64": "long"}
    rows = stored.select(F.col(id_col).cast("long"), F.col("n_bytes"), F.col("media"), F.col("declared"))
    return map_rows(rows, make, ", ".join(f"{n} {of[str(t)]}" for n, t in zip(names, types)), pa.schema(list(zip(names, types))))
