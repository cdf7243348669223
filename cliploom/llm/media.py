"""Media columns: signatures found by an automaton, confirmed by structure.

An Aho-Corasick automaton over the magic bytes of all formats passes over the
stored bytes once (bytes mapped to Latin-1). Each place it reports goes to the
format's validator, which reads the structure - chunk lengths, checksums, end
markers - and says where the item ends, or that it isn't one. A confirmed item at
the start of the column corrects the declared type; confirmed items further in are
embedded media, carved by their confirmed lengths.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, worker

RATE, UNIT = 8000, 64


class Scan(bytes):
    """Some bytes, with what validators have found out about them, so that nothing is looked for twice."""

    def __new__(cls, data: bytes):
        out = super().__new__(cls, data)
        out.places, out.chains = {}, {}
        return out

    def next(self, pattern: bytes, at: int) -> int:
        """Where a pattern matches next; -1: nowhere. All its places are found in one pass."""
        if pattern not in self.places:
            self.places[pattern] = [m.start() for m in re.finditer(pattern, self, re.S)]
        found = self.places[pattern]
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1


Validator = Callable[[Scan, int], int]


def _u(b: bytes, at: int, form: str) -> int:
    size = struct.calcsize(form)
    if at < 0 or at + size > len(b):
        raise ValueError("short")
    return struct.unpack_from(form, b, at)[0]


#: Of a chain of blocks the first place in each window of so many bytes is remembered.
WINDOW = 64
Step = Callable[["Scan", int], tuple[int | None, int, bool]]


def fate(b: Scan, kind: object, at: int, step: Step) -> tuple[int, int]:
    """What the chain of blocks from a place on comes to: its result, and the place of its last marked block (-1: none).

    A step reads the block at a place: (next place, _, marked), or (None, result, marked) at the chain's end; a block that can't be read
    gives the result -1. Chains that meet have one fate, so however many signatures lead into a chain its blocks are read about once.
    """
    seen, window, last = [], -1, -1
    while (found := b.chains.get((kind, at))) is None:
        if at // WINDOW != window:
            seen.append(at)
            window = at // WINDOW
        try:
            after, end, marked = step(b, at)
        except (ValueError, struct.error):
            after, end, marked = None, -1, False
        last = at if marked else last
        if after is None:
            found = end, -1
            break
        at = after
    found = found[0], max(found[1], last)
    b.chains.update(dict.fromkeys([(kind, x) for x in seen], found))
    return found


class Chunks:
    """Chains of RIFF chunks, which forms of any length cut off where they end. Each path of places is walked once; a later one ends where it meets it."""

    NAMED = (b"fmt ", b"data", b"VP8 ", b"VP8L", b"VP8X")

    def __init__(self, b: bytes):
        self.b, self.paths, self.where = b, [], {}

    def _path(self, at: int) -> tuple[int, int]:
        if at in self.where:
            return self.where[at]
        places, named, window, b, pos = array("q"), {name: array("q") for name in self.NAMED}, -1, self.b, at
        number = len(self.paths)
        while pos not in self.where and pos + 8 <= len(b):
            if pos // WINDOW != window:
                self.where[pos] = number, len(places)
                window = pos // WINDOW
            places.append(pos)
            if (name := b[pos : pos + 4]) in named:
                named[name].append(pos)
            size = _u(b, pos + 4, "<I")
            pos += 8 + size + size % 2
        self.paths.append((places, named, self.where.get(pos)))
        return number, 0

    def until(self, at: int, end: int) -> dict[bytes, tuple[int, int]]:
        """The first chunk of each name in NAMED: (start, length). An error if a chunk reaches beyond the end."""
        found, spot, b = {}, self._path(at), self.b
        while spot:
            number, i = spot
            places, named, spot = self.paths[number]
            k = bisect_left(places, end - 7, i)
            for name, own in named.items():
                j = bisect_left(own, places[i]) if k > i else len(own)
                if name not in found and j < len(own) and own[j] <= places[k - 1]:
                    found[name] = own[j] + 8, _u(b, own[j] + 4, "<I")
            if k > i and places[k - 1] + 8 + _u(b, places[k - 1] + 4, "<I") > end:
                raise ValueError("chunk")
            if k < len(places):
                break
        return found


def riff(b: bytes, at: int) -> dict[bytes, tuple[int, int]]:
    """Chunks of a RIFF form: name -> (start, length) of the first of that name."""
    end = at + 8 + _u(b, at + 4, "<I")
    if end > len(b) or end < at + 12:
        raise ValueError("length")
    if not isinstance(b, Scan):
        return Chunks(b).until(at + 12, end)
    if "riff" not in b.chains:
        b.chains["riff"] = Chunks(b)
    return b.chains["riff"].until(at + 12, end)


def _wav(b, at):
    found = riff(b, at)
    start, size = found[b"fmt "]
    channels, rate, _, align, bits = _u(b, start + 2, "<H"), _u(b, start + 4, "<I"), 0, _u(b, start + 12, "<H"), _u(b, start + 14, "<H")
    if size < 16 or not channels or not rate or align != channels * ((bits + 7) // 8) or found[b"data"][1] % align:
        raise ValueError("format")
    return at + 8 + _u(b, at + 4, "<I")


def _webp(b, at):
    if not {b"VP8 ", b"VP8L", b"VP8X"} & set(riff(b, at)):
        raise ValueError("no image")
    return at + 8 + _u(b, at + 4, "<I")


#: Bytes between remembered checksums.
CRC_STEP = 4096


@lru_cache(maxsize=64)
def _zeros(k: int) -> list[list[int]]:
    """What 2**k bytes 0 do to a CRC-32 (a linear map), for each value of each of its bytes."""
    if not k:
        table = [zlib.crc32(bytes([v ^ 0xFF])) ^ zlib.crc32(b"\xff") for v in range(256)]
        return [table, *[[v << (8 * j - 8) for v in range(256)] for j in (1, 2, 3)]]
    half = _zeros(k - 1)
    return [[_through(half, _through(half, v << (8 * j))) for v in range(256)] for j in range(4)]


def _through(map_: list[list[int]], x: int) -> int:
    return map_[0][x & 255] ^ map_[1][x >> 8 & 255] ^ map_[2][x >> 16 & 255] ^ map_[3][x >> 24]


def crc_of(b: Scan, start: int, end: int) -> int:
    """CRC-32 of a range. Of a long one by the checksums of what is before its start and its end, so that ranges that overlap aren't read again and again."""
    if end - start <= CRC_STEP or not isinstance(b, Scan):
        return zlib.crc32(memoryview(b)[start:end])
    if "crc" not in b.chains:
        sums = [0]
        for at in range(0, len(b), CRC_STEP):
            sums.append(zlib.crc32(memoryview(b)[at : at + CRC_STEP], sums[-1]))
        b.chains["crc"] = sums
    upto = lambda at: zlib.crc32(memoryview(b)[at // CRC_STEP * CRC_STEP : at], b.chains["crc"][at // CRC_STEP])
    before, n = upto(start), end - start
    for k in range(n.bit_length()):
        if n >> k & 1:
            before = _through(_zeros(k), before)
    return upto(end) ^ before


def _png_chunk(b, pos):
    size, name = _u(b, pos, ">I"), b[pos + 4 : pos + 8]
    if _u(b, pos + 8 + size, ">I") != crc_of(b, pos + 4, pos + 8 + size):
        raise ValueError("chunk")
    after = pos + 12 + size
    return (None if name == b"IEND" else after), after, False


def _png(b, at):
    if b[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        raise ValueError("header")
    return fate(b, "png", at + 8, _png_chunk)[0]


def _gif_data(b, pos):
    size = _u(b, pos, "B")
    return (pos + 1 + size if size else None), pos + 1, False


def _gif_block(b, pos):
    kind = _u(b, pos, "B")
    if kind == 0x3B:
        return None, pos + 1, False
    if kind == 0x21:
        pos += 2
    elif kind == 0x2C:
        flags = _u(b, pos + 9, "B")
        pos += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    else:
        raise ValueError("block")
    after = fate(b, "gif data", pos, _gif_data)[0]
    return (None if after < 0 else after), -1, False


def _gif(b, at):
    flags, pos = _u(b, at + 10, "B"), at + 13
    if not _u(b, at + 6, "<H") or not _u(b, at + 8, "<H"):
        raise ValueError("size")
    return fate(b, "gif", pos + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), _gif_block)[0]


def _jpeg_segment(b, pos):
    """Marked are scans, whose entropy-coded bytes run to the next real marker."""
    if _u(b, pos, "B") != 0xFF:
        raise ValueError("marker")
    kind = _u(b, pos + 1, "B")
    if kind == 0xD9:
        return None, pos + 2, False
    if kind == 0xFF:
        return pos + 1, -1, False
    size = _u(b, pos + 2, ">H")
    if kind < 0xC0 or kind == 0xD8 or size < 2:
        raise ValueError("marker")
    pos += 2 + size
    if kind != 0xDA:
        return pos, -1, False
    pos = b.next(rb"\xff[^\x00\xd0-\xd7]", pos)
    return (None if pos < 0 else pos), -1, True


def _jpeg(b, at):
    end, scan = fate(b, "jpeg", at + 2, _jpeg_segment)
    if scan < at:
        raise ValueError("no scan")
    return end


def _bmp(b, at):
    size, start, head = _u(b, at + 2, "<I"), _u(b, at + 10, "<I"), _u(b, at + 14, "<I")
    width, height, planes, bits = _u(b, at + 18, "<i"), abs(_u(b, at + 22, "<i")), _u(b, at + 26, "<H"), _u(b, at + 28, "<H")
    if head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or start < 14 + head or at + size > len(b):
        raise ValueError("header")
    if _u(b, at + 30, "<I") == 0 and start + (width * bits + 31) // 32 * 4 * height > size:
        raise ValueError("rows")
    return at + size


#: FLAC: samples of a block and bits of a sample by their codes in a frame's header (0: given elsewhere).
FLAC_BLOCKS = {1: 192} | {k: 144 << k for k in range(2, 6)} | {k: 1 << k for k in range(8, 16)}
FLAC_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc(data: bytes, poly: int, bits: int) -> int:
    out = 0
    table = _crc_table(poly, bits)
    if bits == 8:
        for x in data:
            out = table[out ^ x]
        return out
    for x in data:
        out = (out << 8 & 0xFFFF) ^ table[out >> 8 ^ x]
    return out


@lru_cache(maxsize=4)
def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        v = x << (bits - 8)
        for _ in range(8):
            v = v << 1 ^ (poly if v >> (bits - 1) & 1 else 0)
        out.append(v & ((1 << bits) - 1))
    return out


def _flac(b, at):
    """Metadata blocks, then frames, each read bit by bit to its end, up to the stream's number of samples or the last whole frame."""
    if _u(b, at + 4, "B") & 127 or _u(b, at + 4, ">I") & 0xFFFFFF != 34:
        raise ValueError("block")
    packed = _u(b, at + 18, ">Q")  # 20 bits rate, 3 channels, 5 bits a sample, 36 samples
    wanted, depth = packed & ((1 << 36) - 1), (packed >> 36 & 31) + 1
    pos = fate(b, "flac blocks", at + 4, _flac_block)[0]
    if pos < 0:
        raise ValueError("block")
    frames = b.chains.setdefault(("flac frames", depth), {})
    end, samples = pos, 0
    while not wanted or samples < wanted:
        if end not in frames:
            try:
                frames[end] = _flac_frame(b, end, depth)
            except ValueError:
                frames[end] = None
        if frames[end] is None:
            break
        end, more = frames[end]
        samples += more
    if not samples:
        raise ValueError("frame")
    return end


def _flac_block(b, pos):
    head, size = _u(b, pos, "B"), _u(b, pos, ">I") & 0xFFFFFF
    if head & 127 == 127 or pos + 4 + size > len(b):
        raise ValueError("block")
    return (None if head & 128 else pos + 4 + size), pos + 4 + size, False


def _flac_frame(b, at, depth):
    """Where the frame at a place ends, and its number of samples."""
    if _u(b, at, ">H") & 0xFFFE != 0xFFF8:
        raise ValueError("frame")
    codes, kinds = _u(b, at + 2, "B"), _u(b, at + 3, "B")
    lead = _u(b, at + 4, "B")
    pos = at + 5 + max(0, 8 - (lead ^ 0xFF).bit_length() - 1)  # the frame's number, as UTF-8 writes numbers
    block = codes >> 4
    n = FLAC_BLOCKS.get(block, 0)
    if block in (6, 7):
        n = _u(b, pos, "B" if block == 6 else ">H") + 1
        pos += block - 5
    rate = codes & 15
    pos += 1 if rate == 12 else 2 if rate in (13, 14) else 0
    channels, bits = kinds >> 4, FLAC_BITS.get(kinds >> 1 & 7, depth if not kinds >> 1 & 7 else 0)
    if not n or not bits or kinds & 1 or channels > 10 or rate == 15 or _u(b, pos, "B") != _crc(b[at:pos], 0x07, 8):
        raise ValueError("frame")
    pos += 1
    count = channels + 1 if channels < 8 else 2
    room = b[pos : pos + count * (n * (bits + 2) + 2048) // 8 + 64]
    line = bin(int.from_bytes(b"\1" + room, "big"))[3:]
    i = 0
    for c in range(count):
        side = channels == 8 and c == 1 or channels == 9 and c == 0 or channels == 10 and c == 1
        i = _flac_subframe(line, i, n, bits + side)
    end = pos + -(-i // 8)
    if _u(b, end, ">H") != _crc(b[at:end], 0x8005, 16):
        raise ValueError("checksum")
    return end + 2, n


def _flac_subframe(line: str, i: int, n: int, bits: int) -> int:
    """Bit at which a subframe ends."""
    kind, i = int(line[i : i + 7] or "1000000", 2), i + 8
    if line[i - 1 : i] == "1":  # bits that all samples waste, in unary
        one = line.index("1", i)
        bits, i = bits - (one - i + 1), one + 1
    if kind == 0:
        return i + bits
    if kind == 1:
        return i + n * bits
    if 8 <= kind <= 12:
        order = kind - 8
        i += order * bits
    elif 32 <= kind < 64:
        order = kind - 31
        i += order * bits
        precision = int(line[i : i + 4], 2) + 1
        i += 9 + order * precision
    else:
        raise ValueError("subframe")
    method, parts = int(line[i : i + 2], 2), int(line[i + 2 : i + 6], 2)
    if method > 1 or n & ((1 << parts) - 1) or n >> parts < order:
        raise ValueError("residual")
    i, wide = i + 6, 4 + method
    find = line.index
    for p in range(1 << parts):
        size = (n >> parts) - (order if p == 0 else 0)
        rice = int(line[i : i + wide], 2)
        i += wide
        if rice == (1 << wide) - 1:
            raw = int(line[i : i + 5], 2)
            i += 5 + raw * size
            continue
        rice += 1
        for _ in range(size):
            i = find("1", i) + rice
    return i


def _ogg_page(b, pos):
    n = _u(b, pos + 26, "B")
    after = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
    if b[pos : pos + 4] != b"OggS" or pos + 27 + n > len(b) or b[pos + 4] or after > len(b):
        raise ValueError("page")
    return (None if b[pos + 5] & 4 else after), after, False


def _ogg(b, at):
    """Pages up to the one that ends the stream."""
    return fate(b, "ogg", at, _ogg_page)[0]


def _mp4_box(b, pos):
    """The chain ends before what is no whole box. Marked are boxes of media."""
    size, name = (_u(b, pos, ">I"), b[pos + 4 : pos + 8]) if pos + 8 <= len(b) else (0, b"")
    if not name.isalnum() or not (size >= 8 or size == 1):
        return None, pos, False
    size = _u(b, pos + 8, ">Q") if size == 1 else size
    if size < 8 or pos + size > len(b):
        return None, pos, False
    return pos + size, -1, name in (b"moov", b"mdat", b"meta")


def _mp4(b, at):
    end, media = fate(b, "mp4", at - 4, _mp4_box)
    if media < at - 4:
        raise ValueError("no media box")
    return end


def _au(b, at):
    start, size, form, rate, channels = struct.unpack(">5I", b[at + 4 : at + 24].ljust(20, b"\0"))
    if start < 24 or not 1 <= form <= 27 or not rate or not channels or size == 0xFFFFFFFF or at + start + size > len(b):
        raise ValueError("header")
    return at + start + size


def _pdf(b, at):
    end, table = b.next(b"%%EOF", at), b.next(b"startxref", at)
    if end < 0 or not b[at + 5 : at + 6].isdigit() or not 0 <= table < end:
        raise ValueError("trailer")
    return end + 5


def _gzip(b, at):
    """Header, raw stream and trailer. Names in headers may be long, so streams are remembered by where they begin."""
    flags, pos = _u(b, at + 3, "B"), at + 10
    if flags & 0xE0:
        raise ValueError("flags")
    if flags & 4:
        pos += 2 + _u(b, pos, "<H")
    for bit in (8, 16):
        if flags & bit:
            pos = b.next(b"\0", pos) + 1
            if not pos:
                raise ValueError("name")
    pos += 2 if flags & 2 else 0
    key = "deflate", pos
    if key not in b.chains:
        b.chains[key] = _deflated(b, pos)
    if b.chains[key] < 0:
        raise ValueError("stream")
    return b.chains[key]


def _deflated(b, at) -> int:
    """Where a raw stream and its checksum and length end; -1: it isn't one."""
    plain, pos, crc, size = zlib.decompressobj(-15), at, 0, 0
    step = 1 << 8
    while not plain.eof:
        piece = b[pos : pos + step]
        if not piece:
            return -1
        pos, step = pos + len(piece), min(step * 2, 1 << 16)
        while piece and not plain.eof:
            try:
                out = plain.decompress(piece, 1 << 20)
            except zlib.error:
                return -1
            crc, size, piece = zlib.crc32(out, crc), size + len(out), plain.unconsumed_tail
    end = pos - len(plain.unused_data)
    return end + 8 if b[end : end + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else -1


def _zip(b, at):
    end = b.next(rb"PK\x05\x06", at)
    if end < 0:
        raise ValueError("no directory")
    size, start = _u(b, end + 12, "<I"), _u(b, end + 16, "<I")
    if start + size != end - at or b[at + start : at + start + 4] != b"PK\1\2":
        raise ValueError("directory")
    return end + 22 + _u(b, end + 20, "<H")


#: Magic bytes, type and validator. The place reported is where the magic begins.
FORMATS: list[tuple[bytes, str, Validator]] = [
    (b"RIFF", "audio/wav", _wav),
    (b"RIFF", "image/webp", _webp),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "application/ogg", _ogg),
    (b"ftyp", "video/mp4", _mp4),
    (b".snd", "audio/basic", _au),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\3\4", "application/zip", _zip),
]
FORM = {"audio/wav": b"WAVE", "image/webp": b"WEBP"}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found: dict[bytes, list[int]] = {}
    for i, (magic, _, _) in enumerate(FORMATS):
        found.setdefault(magic, []).append(i)
    out = ahocorasick.Automaton()
    for magic, which in found.items():
        out.add_word(magic.decode("latin-1"), (len(magic), which))
    out.make_automaton()
    return out


def confirmed(data: bytes) -> Iterator[tuple[str, int, int]]:
    """Confirmed items (type, start, end), but for those that begin inside an embedded item; of several at one place the first format's."""
    view, edge, done = Scan(data), 0, -1
    for last, (size, which) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - size
        for i in which:
            magic, kind, validator = FORMATS[i]
            start = at - 4 if magic == b"ftyp" else at
            if start < edge or start == done or kind in FORM and data[at + 8 : at + 12] != FORM[kind]:
                continue
            try:
                end = validator(view, at)
            except (ValueError, KeyError, zlib.error, struct.error):
                continue
            if start < end <= len(data):
                done = start
                edge = end if start else edge
                yield kind, start, end


def sniff(data: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The type of the item that begins the bytes, and embedded items (none inside another embedded one)."""
    found = list(confirmed(data))
    return next((kind for kind, start, _ in found if not start), None), [item for item in found if item[1]]


def sniff_media(rows: DataFrame, id_col: str, content_col: str, declared_col: str | None = None, carve: bool = False) -> DataFrame:
    """Returns id_col, declared, detected, corrected, embedded array<struct<type,start,end[,content]>>.

    ``detected`` is the confirmed type, or null; ``corrected`` is true where a confirmed type
    differs from the declared one. Null content counts as no bytes. With ``carve``
    embedded items carry their bytes. Repeated rows give repeated rows.
    """
    declared = F.col(f"`{declared_col}`").cast("string") if declared_col else F.lit(None).cast("string")
    source = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{content_col}`").alias("content"), declared.alias("declared"))
    fields = [("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())] + [("content", pa.binary())] * carve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            detected, embedded = [], []
            for data in batch.column("content"):
                data = data.as_py() or b""
                kind, items = sniff(data)
                detected.append(kind)
                embedded.append([{"type": k, "start": a, "end": b} | ({"content": data[a:b]} if carve else {}) for k, a, b in items])
            said = batch.column("declared").to_pylist()
            corrected = [k is not None and k != s for k, s in zip(detected, said, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("declared"), pa.array(detected, pa.string()), pa.array(corrected), pa.array(embedded, pa.list_(pa.struct(fields)))],
                ["id", "declared", "detected", "corrected", "embedded"],
            )

    item = "struct<type:string,start:bigint,end:bigint" + ",content:binary" * carve + ">"
    return source.mapInArrow(worker(run), f"id {dict(source.dtypes)['id']}, declared string, detected string, corrected boolean, embedded array<{item}>").withColumnRenamed("id", id_col)


# ------------------------------------------------------------ texts as samples
def wav_of(payload: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def payload_of(media: bytes) -> bytes:
    """The samples that a stored WAV file holds."""
    start, size = riff(media, 0)[b"data"]
    return media[start : start + size]


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_bytes and media: each whole text as 8-bit samples of a WAV file.

    The UTF-8 bytes get bytes 0 up to a positive multiple of 64; null and empty texts
    are 64 bytes 0.
    """
    source = narrow(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                media = [wav_of(x.ljust(max(UNIT, -(-len(x) // UNIT) * UNIT), b"\0")) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return source.mapInArrow(worker(run), f"id {dict(source.dtypes)['id']}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared: str = "application/octet-stream") -> DataFrame:
    """Sniff stored media, read the samples back and describe them.

    Returns id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    detected, corrected, n_embedded. The feature names the confirmed type, the samples' number, mean, root
    mean square and sign changes around 128, and the embedded items. Bytes that aren't a confirmed WAV file
    have null for what needs the samples; null media counts as no bytes.
    """
    source = narrow(rows, "n_bytes", id=id_col, media=media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "detected", "corrected", "n_embedded")}
            for media in batch.column("media"):
                data = media.as_py() or b""
                kind, items = sniff(data)
                payload = payload_of(data) if kind == "audio/wav" else None
                out["payload_bytes"].append(None if payload is None else len(payload))
                out["payload_sha256"].append(None if payload is None else hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(None if payload is None else zlib.crc32(payload[-UNIT:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(f"{kind or 'unknown'};{_sound(payload or b'')};" + ",".join(f"{k}@{a}-{b}" for k, a, b in items))
                out["detected"].append(kind)
                out["corrected"].append(kind is not None and kind != declared)
                out["n_embedded"].append(len(items))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
            arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *arrays], ["id", "n_bytes", *out])

    schema = f"id {dict(source.dtypes)['id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, detected string, corrected boolean, n_embedded long"
    return source.mapInArrow(worker(run), schema).withColumnRenamed("id", id_col)


def _sound(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return "n=0"
    count = np.bincount(x, minlength=256)
    level = np.arange(256) - 128
    mean, power = int(count @ level) / len(x), int(count @ (level * level)) / len(x)
    turns = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    return f"n={len(x)} mean={mean:.4f} rms={power**0.5:.4f} turns={turns}"


def op3_media(spark, sf_dir: str) -> DataFrame:
    return media_features(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
