"""FLAC against streams made bit by bit here: all kinds of subframes, stereo forms, block sizes, wasted bits and escapes."""

import io
import struct

import numpy as np
import pytest

from cliploom.sources import decode, flac


def crc(data, poly, width):
    out = 0
    for byte in data:
        for k in range(8):
            top = out >> (width - 1) & 1 ^ byte >> (7 - k) & 1
            out = (out << 1 & (1 << width) - 1) ^ (poly if top else 0)
    return out


def bits(x, n):
    return format(int(x) & ((1 << n) - 1), f"0{n}b") if n else ""


def rice(x, k):
    u = 2 * x if x >= 0 else -2 * x - 1
    return "0" * (u >> k) + "1" + bits(u, k)


def residual(values, n, order, rng):
    """Partitions with Rice parameters or escapes, by either coding method."""
    parts = max(p for p in (0, 1, 2, 3) if n % (1 << p) == 0 and n >> p >= order)
    method = rng.integers(2)
    out, at = bits(method, 2) + bits(parts, 4), 0
    for p in range(1 << parts):
        count = (n >> parts) - (order if p == 0 else 0)
        part = [int(v) for v in values[at : at + count]]
        at += count
        need = max([2, *(v.bit_length() + 1 for v in part)])
        if (rng.integers(3) == 0 or need > 16) and need < 32:
            out += "1" * (4 + method) + bits(need, 5) + "".join(bits(v, need) for v in part)
        else:
            k = min(max(need - 2, 0), 14)
            out += bits(k, 4 + method) + "".join(rice(v, k) for v in part)
    return out


def subframe(x, depth, kind, rng):
    wasted = 0
    while wasted < depth - 2 and not (x & ((1 << (wasted + 1)) - 1)).any():
        wasted += 1
    if not x.any() or kind == "constant" and (x != x[0]).any():
        wasted, kind = 0, "constant" if not x.any() else "verbatim"
    x, depth = x >> wasted, depth - wasted
    flag = "1" + "0" * (wasted - 1) + "1" if wasted else "0"
    if kind == "constant":
        return "0" + bits(0, 6) + flag + bits(x[0], depth)
    if kind == "verbatim":
        return "0" + bits(1, 6) + flag + "".join(bits(v, depth) for v in x)
    order = int(rng.integers(0, 5)) if kind == "fixed" else int(rng.integers(1, 13))
    order = min(order, len(x))
    if kind == "fixed":
        d = np.diff(x, order) if order else x
        return "0" + bits(8 + order, 6) + flag + "".join(bits(v, depth) for v in x[:order]) + residual(d, len(x), order, rng)
    precision, shift = 9, int(rng.integers(0, 9))
    factors = [int(v) for v in rng.integers(-200, 200, order)]
    d = [int(x[i]) - (sum(f * int(x[i - 1 - j]) for j, f in enumerate(factors)) >> shift) for i in range(order, len(x))]
    return "0" + bits(31 + order, 6) + flag + "".join(bits(v, depth) for v in x[:order]) + bits(precision - 1, 4) + bits(shift, 5) + "".join(bits(f, precision) for f in factors) + residual(d, len(x), order, rng)


def stream(x, depth, rng, block=192, variable=False, known=True, rate=44100):
    """A stream of channels x samples; every frame has kinds and a stereo form of its own."""
    channels, n = x.shape
    frames, at, number = [], 0, 0
    while at < n:
        size = min(int(rng.integers(30, 700)) if variable else block, n - at)
        part = x[:, at : at + size]
        form = int(rng.choice([1, 8, 9, 10])) if channels == 2 else channels - 1
        lines = [(row, 0) for row in part]
        if channels == 2:
            mid, side = (part[0] + part[1]) >> 1, part[0] - part[1]
            lines = {8: [(part[0], 0), (side, 1)], 9: [(side, 1), (part[1], 0)], 10: [(mid, 0), (side, 1)]}.get(form, lines)
        code = {192: 1, 576: 2, 256: 8}.get(size, 7)
        head = bytes([0xFF, 0xF9 if variable else 0xF8, code << 4, form << 4 | {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[depth] << 1]) + flac._number(at if variable else number)
        head += struct.pack(">H", size - 1) if code == 7 else b""
        head += bytes([crc(head, 7, 8)])
        body = "".join(subframe(line, depth + more, rng.choice(["constant", "verbatim", "fixed", "lpc"]), rng) for line, more in lines)
        body += "0" * (-len(body) % 8)
        frame = head + int(body, 2).to_bytes(len(body) // 8, "big")
        frames.append(frame + struct.pack(">H", crc(frame, 0x8005, 16)))
        at, number = at + size, number + 1
    info = struct.pack(">HH", 30 if variable else block, 700 if variable else block) + bytes(6) + (rate << 44 | (channels - 1) << 41 | (depth - 1) << 36 | (n if known else 0)).to_bytes(8, "big") + bytes(16)
    padding = b"\x81" + (40).to_bytes(3, "big") + bytes(39) + b"\xff"
    return b"fLaC" + b"\0" + (34).to_bytes(3, "big") + info + padding + b"".join(frames)


def signal(channels, n, depth, rng):
    t = np.arange(n)
    top = 1 << (depth - 1)
    x = np.stack([top * 0.4 * np.sin(t * (0.01 + 0.02 * c)) + rng.normal(0, top / 200, n) for c in range(channels)])
    x[:, n // 3 : n // 2] = np.round(x[:, n // 3 : n // 2] / 8) * 8  # wasted bits
    x[:, n // 2 : n // 2 + 400] = 5
    x[0, :3] = -top, top - 1, -top
    return np.clip(np.rint(x), -top, top - 1).astype(np.int64)


@pytest.mark.parametrize("variable", [False, True])
@pytest.mark.parametrize("depth", [8, 12, 16, 24])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_sample_exact(channels, depth, variable):
    rng = np.random.default_rng(depth * 10 + channels)
    x = signal(channels, 2503, depth, rng)
    data = stream(x, depth, rng, variable=variable)
    file = io.BytesIO(data)
    h = flac.probe(file)
    assert (h.channels, h.sample_rate, h.bits, h.frames, h.duration) == (channels, 44100, depth, 2503, 2503 / 44100)
    assert np.array_equal(flac.integers_of(file, h, 0, 2503), x)
    for first, n in ((0, 1), (191, 2), (192, 192), (1500, 900), (2502, 1), (2490, 13), (17, 0)):
        assert np.array_equal(flac.integers_of(file, h, first, n), x[:, first : first + n])
    audio, rate = decode.decode(data, 0.04, 0.01)
    assert rate == 44100 and np.array_equal(audio, x[:, 1764:2205] / float(1 << (depth - 1)))


@pytest.mark.parametrize("variable", [False, True])
def test_a_stream_of_unknown_length(variable):
    rng = np.random.default_rng(5)
    x = signal(2, 4001, 16, rng)
    data = stream(x, 16, rng, variable=variable, known=False)
    assert flac.probe(io.BytesIO(data)).frames == 4001
    assert np.array_equal(decode.decode(data)[0], x / 32768)
    cut = data[: len(data) * 2 // 3]  # whole frames of what is left
    got, _ = decode.decode(cut)
    assert 0 < got.shape[1] < 4001 and np.array_equal(got, x[:, : got.shape[1]] / 32768)


def test_broken_streams():
    rng = np.random.default_rng(6)
    data = bytearray(stream(signal(1, 3000, 16, rng), 16, rng))
    data[-40] ^= 4
    with pytest.raises(ValueError):
        decode.decode(bytes(data))
    assert decode.decode(bytes(data), 0.0, 0.02)[0].shape == (1, 882)  # frames before it are whole
    for bad in (b"fLaC", b"fLaC\x84\0\0\1x", bytes(data[:30])):
        with pytest.raises(ValueError):
            decode.decode(bad)


def test_seeking_reads_little():
    """Of a long stream only the frames that halving tries, and those asked for."""
    rng = np.random.default_rng(7)
    x = np.clip(rng.normal(0, 3000, (1, 1_500_000)), -32768, 32767).astype(np.int64)
    data = flac.encode(x / 32768, 44100)

    class Noted(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            Noted.total += len(out)
            return out

    file = Noted(data)
    h = flac.probe(file)
    for first in (1_200_000, 3, 1_499_990):
        Noted.total = 0
        assert np.array_equal(flac.integers_of(file, h, first, 5000), x[:, first : first + 5000]) and Noted.total < len(data) / 2


@pytest.mark.parametrize("bits_", [8, 16, 24])
@pytest.mark.parametrize("channels", [1, 2])
def test_encoder_round_trip(bits_, channels):
    rng = np.random.default_rng(8)
    x = signal(channels, 9000, bits_, rng)
    data = flac.encode(x / float(1 << (bits_ - 1)), 48000, bits_)
    audio, rate = decode.decode(data)
    assert rate == 48000 and np.array_equal(np.rint(audio * (1 << (bits_ - 1))), x) and len(data) < x.size * bits_ // 8
    assert decode.decode(flac.encode(np.zeros((1, 0)), 8000))[0].shape == (1, 0)
