"""Media sniffing: every validator accepts its format and refuses look-alikes; texts round-trip."""

import gzip
import hashlib
import io
import random
import struct
import time
import zipfile
import zlib

import pytest

from cliploom.llm import media as m


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "text")
    return out.getvalue()


def flac_crc(data, poly, bits):
    """Bit by bit."""
    out = 0
    for x in data:
        for k in range(8):
            top = out >> (bits - 1) & 1 ^ x >> (7 - k) & 1
            out = (out << 1 & (1 << bits) - 1) ^ (poly if top else 0)
    return out


def flac_frame(number, subframes, kinds=0x08, codes=0x10):
    """A frame of 192 samples from the bits of its subframes."""
    head = bytes([0xFF, 0xF8, codes, kinds, number])
    head += bytes([flac_crc(head, 0x07, 8)])
    bits = "".join(subframes)
    bits += "0" * (-len(bits) % 8)
    body = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    return body + struct.pack(">H", flac_crc(body, 0x8005, 16))


def rice(value, k):
    u = value * 2 if value >= 0 else -value * 2 - 1
    return "0" * (u >> k) + "1" + (format(u & ((1 << k) - 1), f"0{k}b") if k else "")


def flac(samples=192 * 4):
    constant = "0" + "000000" + "0" + format(5, "016b")
    verbatim = "0" + "000001" + "0" + "".join(format(i, "016b") for i in range(192))
    fixed = "0" + "001001" + "0" + format(7, "016b") + "00" + "0001" + format(3, "04b") + "".join(rice(i % 9 - 4, 3) for i in range(95)) + format(15, "04b") + format(6, "05b") + format(0, "06b") * 96
    lpc = "0" + "100001" + "1" + "01" + format(1, "014b") * 2 + format(4, "04b") + format(2, "05b") + format(1, "05b") * 2 + "01" + "0000" + format(2, "05b") + "".join(rice(i % 30 - 9, 2) for i in range(190))
    info = struct.pack(">HH", 192, 192) + bytes(6) + struct.pack(">Q", 44100 << 44 | 15 << 36 | samples) + bytes(16)
    return b"fLaC" + struct.pack(">I", 0x80 << 24 | 34) + info + b"".join(flac_frame(i, [f]) for i, f in enumerate((constant, verbatim, fixed, lpc)))


SAMPLES = {
    "audio/wav": m.wav_of(bytes(64)),
    "image/webp": b"RIFF" + struct.pack("<I", 4 + 8 + 4) + b"WEBPVP8 " + struct.pack("<I", 4) + bytes(4),
    "image/png": png(),
    "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2\x4c\1\0\x3b",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4ab\1\2\xff\0\3\xff\xd9",
    "image/bmp": b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4),
    "audio/flac": flac(),
    "application/ogg": b"OggS\0\4" + bytes(20) + b"\1\5hello",
    "video/mp4": struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 12) + b"mdatabcd",
    "audio/basic": b".snd" + struct.pack(">5I", 24, 4, 1, 8000, 1) + bytes(4),
    "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF",
    "application/gzip": gzip.compress(b"text" * 100),
    "application/zip": zipped(),
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_confirmed_and_carved(kind):
    data = SAMPLES[kind]
    assert m.sniff(data) == (kind, [])
    inside = b"some words " + data + b" and more RIFF BM PK\3\4 GIF89a"
    assert m.sniff(inside) == (None, [(kind, 11, 11 + len(data))])
    cut = data[: len(data) * 2 // 3]
    assert m.sniff(cut)[0] is None or kind in ("audio/flac", "video/mp4")


def test_nested_media_in_a_container():
    inner = SAMPLES["image/png"]
    outer = m.wav_of(b"x" * 10 + inner + b"y" * 5)
    assert m.sniff(outer) == ("audio/wav", [("image/png", 54, 54 + len(inner))])


def test_sniff_rows(spark):
    rows = [(1, SAMPLES["image/png"], "image/jpeg"), (2, None, "x"), (3, b"", None), (4, SAMPLES["image/gif"], "image/gif"), (5, b"ab" + SAMPLES["application/zip"], None), (5, b"", None)]
    frame = spark.createDataFrame(rows, "id long, content binary, declared string")
    got = sorted((r.id, r.detected, r.corrected, [(e.type, bytes(e.content)) for e in r.embedded]) for r in m.sniff_media(frame, "id", "content", "declared", carve=True).collect())
    assert got == [(1, "image/png", True, []), (2, None, False, []), (3, None, False, []), (4, "image/gif", False, []), (5, None, False, []), (5, None, False, [("application/zip", SAMPLES["application/zip"])])]


def check(r, text):
    raw = (text or "").encode()
    padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
    assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    media = m.wav_of(padded)
    assert r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest() and r.detected == "audio/wav" and r.corrected


def test_query_reads_back_what_it_stored(spark, sf):
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = m.op3_media(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        check(r, want[r.doc_id])


def test_edges(spark, docs):
    texts = {1: None, 2: "", 3: "x" * 64, 4: "é" * 33, 5: "GIF89a BM RIFFxxxxWAVE PK\3\4 " * 3000}
    rows = {r.doc_id: r for r in m.media_features(m.store_texts(docs(texts))).collect()}
    for i, t in texts.items():
        check(rows[i], t)
    assert rows[1].feature == rows[2].feature and m.store_texts(docs({})).collect() == []


def test_media_after_a_flac_are_carved():
    """Frames are walked to the stream's number of samples; where that isn't known, to the last whole frame."""
    for samples in (192 * 4, 0):
        one = flac(samples)
        data = b"xx" + one + png() + b"tail" + SAMPLES["audio/wav"]
        assert m.sniff(data)[1] == [("audio/flac", 2, 2 + len(one)), ("image/png", 2 + len(one), 2 + len(one + png())), ("audio/wav", len(data) - len(SAMPLES["audio/wav"]), len(data))]
    stereo = flac_frame(9, ["0" + "000000" + "0" + format(5, "016b"), "0" + "000000" + "0" + format(5, "017b")], kinds=0x88)
    two = flac(0) + stereo
    assert m.sniff(two + png()) == ("audio/flac", [("image/png", len(two), len(two + png()))])
    broken = bytearray(flac(0))
    broken[-1] ^= 1
    assert m.sniff(bytes(broken) + png()) == ("audio/flac", [("image/png", len(broken), len(broken) + len(png()))])


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


IHDR = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0)
#: Signatures by themselves, and nested: each unit's chain of blocks skips the next unit's signature and goes on through all that follow.
UNITS = {
    "pdf": b"%PDF-1", "zip": b"PK\3\4", "gzip": b"\x1f\x8b\x08", "ogg": b"OggS\0\0" + bytes(20) + b"\0", "jpeg": b"\xff\xd8\xff\xda\0\4ab", "gif": b"GIF89a", "riff": b"RIFF\1\0\0\0WAVE", "flac": b"fLaC",
    "mp4": b"\0\0\0\x08ftyp", "nested mp4": b"\0\0\0\x10ftypabcdabcd", "nested wav": b"junk\x0c\0\0\0RIFF\0\0\x1f\0WAVE", "nested webp": b"junk\x0c\0\0\0RIFF\0\0\x1f\0WEBP",
    "nested gif": b"\x21\xfe" + bytes([len(GIF)]) + GIF + b"\0", "gif data": bytes([len(GIF)]) + GIF,
    "nested png": b"\x89PNG\r\n\x1a\n" + IHDR + chunk(b"skip", b"\x89PNG\r\n\x1a\n"), "png lengths": b"\x89PNG\r\n\x1a\n" + IHDR + struct.pack(">I", 1 << 21) + b"long",
    "nested jpeg": b"\xff\xd8\xff\xe0\0\4", "jpeg fill": b"\xff\xd8" + b"\xff" * 6, "nested flac": b"\1\0\0\x2afLaC" + struct.pack(">I", 34) + bytes(34),
}


@pytest.mark.parametrize("unit", UNITS.values(), ids=UNITS)
def test_long_texts_of_signatures_take_linear_time(unit):
    data = unit * (4_000_000 // len(unit))
    start = time.process_time()
    m.sniff(data)
    assert time.process_time() - start < 20


@pytest.mark.parametrize("seed", range(40))
def test_chains_remembered_equal_chains_walked(seed):
    """Bytes with many crossing chains: what is found doesn't depend on what was walked before."""
    rng = random.Random(seed)
    parts = [*SAMPLES.values(), *UNITS.values(), b"\0\0\0\x08moov", b"\0\0\0\x0cmdatabcd", b"\0", b"\xff\xd9", b"\x3b", b"ab", b"data\4\0\0\0abcd", b"fmt \x10\0\0\0" + SAMPLES["audio/wav"][20:36]]
    data = b"".join(rng.choice(parts) for _ in range(60))
    shared = m.Scan(data)
    for at in range(len(data)):
        for magic, kind, validator in m.FORMATS:
            if data[at : at + len(magic)] == magic:
                found = []
                for view in (m.Scan(data), shared):
                    try:
                        found.append(validator(view, at))
                    except (ValueError, KeyError, zlib.error, struct.error):
                        found.append(-1)
                assert found[0] == found[1] or max(found) < 0, (kind, at)


def test_checksums_of_ranges():
    rng = random.Random(1)
    data = rng.randbytes(100_000)
    view = m.Scan(data)
    for _ in range(200):
        a, b = sorted(rng.randrange(len(data) + 1) for _ in range(2))
        assert m.crc_of(view, a, b) == zlib.crc32(data[a:b])


def slow_feature(text):
    """The feature by its definition: one sample after the other."""
    raw = (text or "").encode()
    x = [b - 128 for b in raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))]
    turns = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
    return f"audio/wav;n={len(x)} mean={sum(x) / len(x):.4f} rms={(sum(v * v for v in x) / len(x)) ** 0.5:.4f} turns={turns};"


def test_feature_equals_brute_force(spark, docs):
    texts = {1: None, 2: "", 3: "x" * 64, 4: "é\U0001f600 mixed" * 33, 5: "plain words " * 5000}
    rows = {r.doc_id: r.feature for r in m.media_features(m.store_texts(docs(texts))).collect()}
    assert rows == {i: slow_feature(t) for i, t in texts.items()}
    holding = "some words and a picture GIF89a\1\0\1\0\0\0\0;"
    (row,) = m.media_features(m.store_texts(docs({1: holding}))).collect()
    at = 44 + holding.index("GIF")
    assert row.feature == slow_feature(holding) + f"image/gif@{at}-{at + 14}" and row.n_embedded == 1
