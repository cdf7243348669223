"""FLAC files: stream information, decoding of all subframe types, seeking by frame search, and a small encoder.

Bits of a frame are unpacked once; Rice-coded residuals are found by looking for their unary stop bits, and their low bits are
gathered for a whole partition at once. Fixed predictors are repeated sums.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import lru_cache
from typing import BinaryIO

import numpy as np

#: Samples of a block, bits of a sample and rates by their codes in a frame's header. Fixed values of the format.
BLOCKS = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10
#: Bytes read at once while frames are looked for; the most bytes of a frame's header.
WINDOW, HEAD = 1 << 16, 16


@dataclass(frozen=True)
class Header:
    channels: int
    sample_rate: int
    bits: int
    frames: int
    start: int  # of the first frame, in bytes
    size: int  # of the file, in bytes
    block: int  # samples of a frame, where all have as many
    longest: int  # bytes of a frame, 0 if unknown

    @property
    def duration(self) -> float:
        return self.frames / self.sample_rate


@dataclass(frozen=True)
class Frame:
    at: int  # place in the file
    first: int  # its first sample
    samples: int
    assignment: int
    bits: int
    length: int  # of its header


class Broken(ValueError):
    """No frame at a place, or one whose checksum is wrong."""


class Short(Broken):
    """The bytes end before the frame does."""


@lru_cache(maxsize=2)
def _table(poly: int, bits: int) -> list[int]:
    out, most = [], (1 << bits) - 1
    for value in range(256):
        value <<= bits - 8
        for _ in range(8):
            value = (value << 1 & most) ^ (poly if value >> (bits - 1) else 0)
        out.append(value)
    return out


def checksum(data: bytes, bits: int) -> int:
    """CRC-8 of headers, CRC-16 of frames."""
    table, out = _table(0x07 if bits == 8 else 0x8005, bits), 0
    shift, most = bits - 8, (1 << bits) - 1
    for byte in data:
        out = ((out << 8) & most) ^ table[(out >> shift) ^ byte]
    return out


def probe(file: BinaryIO) -> Header:
    """Read the metadata blocks' headers and the stream information. A stream that doesn't tell its length is searched for its last frame."""
    if file.read(4) != b"fLaC":
        raise ValueError("not a FLAC file")
    info = None
    while True:
        head = file.read(4)
        if len(head) < 4:
            raise ValueError("a FLAC file without frames")
        size = int.from_bytes(head[1:], "big")
        if head[0] & 127 == 0 and info is None:
            info = file.read(size)
        else:
            file.seek(size, 1)
        if head[0] & 128:
            break
    if info is None or len(info) < 34:
        raise ValueError("a FLAC file without stream information")
    least, most = struct.unpack(">HH", info[:4])
    longest = int.from_bytes(info[7:10], "big")
    packed = int.from_bytes(info[10:18], "big")
    start = file.tell()
    h = Header((packed >> 41 & 7) + 1, packed >> 44, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), start, file.seek(0, 2), most if least == most else 0, longest)
    if not h.sample_rate:
        raise ValueError("a FLAC file without a rate")
    return h if h.frames else _measured(file, h)


def _measured(file: BinaryIO, h: Header) -> Header:
    step, to = WINDOW, h.size
    while to > h.start:
        at = max(h.start, to - step)
        last = None
        while (found := next_frame(file, h, at, to)) is not None:
            last, at = found, found.at + 1
        if last is not None:
            return Header(h.channels, h.sample_rate, h.bits, last.first + last.samples, h.start, h.size, h.block, h.longest)
        to = max(h.start, to - step)
    return h


def header_at(data: bytes, i: int, h: Header, base: int) -> Frame:
    """The frame header at place i of some bytes that stand at ``base`` in the file."""
    head = data[i : i + HEAD]
    if len(head) < 6:
        raise Short("frame header")
    if head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 1:
        raise Broken("frame header")
    size = 8 - (head[4] ^ 0xFF).bit_length()  # leading one bits
    if size in (1, 8):
        raise Broken("frame number")
    number = head[4] & (0x7F >> size)
    for byte in head[5 : 4 + max(size, 1)]:
        if byte >> 6 != 2:
            raise Broken("frame number")
        number = number << 6 | byte & 0x3F
    at = 4 + max(size, 1)
    code, rate = head[2] >> 4, head[2] & 15
    samples = BLOCKS.get(code, 0)
    if code in (6, 7):
        samples = int.from_bytes(head[at : at + code - 5], "big") + 1
        at += code - 5
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if len(head) <= at:
        raise Short("frame header")
    assignment, depth = head[3] >> 4, head[3] >> 1 & 7
    bits = BITS.get(depth, 0) if depth else h.bits
    channels = assignment + 1 if assignment < LEFT_SIDE else 2
    if not samples or not bits or rate == 15 or assignment > MID_SIDE or channels != h.channels or head[at] != checksum(head[:at], 8):
        raise Broken("frame header")
    first = number if head[1] & 1 else number * (h.block or samples)
    return Frame(base + i, first, samples, assignment, bits, at + 1)


def next_frame(file: BinaryIO, h: Header, at: int, to: int) -> Frame | None:
    """The first frame that begins in a range of places; its header's and its own checksum hold."""
    while at < to:
        file.seek(at)
        data = file.read(min(WINDOW, to - at) + HEAD)
        i = data.find(b"\xff")
        while 0 <= i < min(WINDOW, to - at):
            try:
                frame = header_at(data, i, h, at)
                decode(file, h, frame)
                return frame
            except Broken:
                i = data.find(b"\xff", i + 1)
        at += min(WINDOW, to - at)
    return None


class _Bits:
    """The bits of some bytes, as a string of digits for reading and as an array for gathering."""

    def __init__(self, data: bytes):
        self.array = np.unpackbits(np.frombuffer(data, np.uint8))
        self.text = (self.array + 48).tobytes()
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.text):
            raise Short("frame")
        self.at += n
        return int(self.text[self.at - n : self.at], 2) if n else 0

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        stop = self.text.find(b"1", self.at)
        if stop < 0:
            raise Short("frame")
        n, self.at = stop - self.at, stop + 1
        return n

    def gather(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Numbers of n bits that begin at some places."""
        out = np.zeros(len(starts), np.int64)
        for k in range(n):
            out = out << 1 | self.array[starts + k]
        return out

    def numbers(self, count: int, n: int) -> np.ndarray:
        """So many signed numbers of n bits."""
        if self.at + count * n > len(self.text):
            raise Short("frame")
        out = self.gather(self.at + n * np.arange(count), n)
        self.at += count * n
        return out - ((out >> (n - 1)) << n) if n else out

    def rice(self, count: int, k: int) -> np.ndarray:
        """So many Rice-coded numbers with k low bits."""
        find, at, stops = self.text.find, self.at, []
        add = stops.append
        for _ in range(count):
            stop = find(b"1", at)
            if stop < 0:
                raise Short("frame")
            add(stop)
            at = stop + 1 + k
        if at > len(self.text):
            raise Short("frame")
        stop = np.array(stops, np.int64)
        high = np.diff(stop, prepend=self.at - 1 - k) - 1 - k
        self.at = at
        value = high << k | self.gather(stop + 1, k)
        return value >> 1 ^ -(value & 1)


def _residual(bits: _Bits, n: int, order: int) -> np.ndarray:
    method, parts = bits.take(2), bits.take(4)
    if method > 1 or n & ((1 << parts) - 1) or n >> parts < order:
        raise Broken("residual")
    out, wide = [], 4 + method
    for p in range(1 << parts):
        count = (n >> parts) - (order if p == 0 else 0)
        k = bits.take(wide)
        out.append(bits.numbers(count, bits.take(5)) if k == (1 << wide) - 1 else bits.rice(count, k))
    return np.concatenate(out)


def _subframe(bits: _Bits, n: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise Broken("subframe")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if depth <= 0:
        raise Broken("subframe")
    if kind == 0:
        out = np.full(n, bits.signed(depth), np.int64)
    elif kind == 1:
        out = bits.numbers(n, depth)
    elif 8 <= kind <= 12:
        order = kind - 8
        if order > n:
            raise Broken("subframe")
        warm = bits.numbers(order, depth)
        out = _summed(warm, _residual(bits, n, order))
    elif kind >= 32:
        order = kind - 31
        if order > n:
            raise Broken("subframe")
        warm = bits.numbers(order, depth)
        precision = bits.take(4) + 1
        shift = bits.signed(5)
        if precision == 16 or shift < 0:
            raise Broken("subframe")
        factors = bits.numbers(order, precision)
        out = _predicted(warm, factors, shift, _residual(bits, n, order))
    else:
        raise Broken("subframe")
    return out << wasted


def _summed(warm: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Undo a fixed predictor: the residual is the difference of the signal of as many orders as there are warm-up samples."""
    for order in range(len(warm) - 1, -1, -1):
        # Sums of the differences of the next order, from the first difference of this order that the warm-up samples don't hold.
        known = np.diff(warm, order)
        residual = known[-1] + np.cumsum(residual)
    return np.concatenate([warm, residual])


def _predicted(warm: np.ndarray, factors: np.ndarray, shift: int, residual: np.ndarray) -> np.ndarray:
    """Undo a linear predictor; each sample needs the ones before it."""
    order, back = len(warm), factors[::-1].tolist()
    out = warm.tolist()
    for i, r in enumerate(residual.tolist()):
        total = 0
        for f, x in zip(back, out[i : i + order], strict=True):
            total += f * x
        out.append(r + (total >> shift))
    return np.array(out, np.int64)


def decode(file: BinaryIO, h: Header, frame: Frame) -> tuple[np.ndarray, int]:
    """channels x samples of a frame, as integers, and where the next frame begins."""
    room = h.longest or 2 * HEAD + frame.samples * h.channels * (frame.bits + 1) // 8 // 2
    file.seek(frame.at)
    data = file.read(room)
    while True:
        try:
            return _decoded(data, h, frame)
        except Short:
            more = file.read(max(len(data), WINDOW))
            if not more:
                raise Broken("frame") from None
            data += more


def _decoded(data: bytes, h: Header, frame: Frame) -> tuple[np.ndarray, int]:
    bits = _Bits(data[frame.length :])
    channels = []
    for c in range(h.channels):
        side = (frame.assignment, c) in ((LEFT_SIDE, 1), (SIDE_RIGHT, 0), (MID_SIDE, 1))
        channels.append(_subframe(bits, frame.samples, frame.bits + side))
    end = frame.length + -(-bits.at // 8)
    if len(data) < end + 2:
        raise Short("frame")
    if int.from_bytes(data[end : end + 2], "big") != checksum(data[:end], 16):
        raise Broken("checksum")
    if frame.assignment == LEFT_SIDE:
        channels[1] = channels[0] - channels[1]
    elif frame.assignment == SIDE_RIGHT:
        channels[0] = channels[0] + channels[1]
    elif frame.assignment == MID_SIDE:
        mid, side = channels[0] << 1 | channels[1] & 1, channels[1]
        channels = [(mid + side) >> 1, (mid - side) >> 1]
    return np.stack(channels), frame.at + end + 2


def frame_of(file: BinaryIO, h: Header, sample: int) -> Frame:
    """The frame that holds a sample, by halving the range of places that it can begin in."""
    low = next_frame(file, h, h.start, h.size)
    if low is None:
        raise ValueError("a FLAC file without frames")
    high = h.size
    while not low.first <= sample < low.first + low.samples:
        # A frame that begins before the middle and ends after it is the last of the lower half.
        middle = (low.at + 1 + high) // 2 if high - low.at > WINDOW else low.at + 1
        found = next_frame(file, h, middle, high)
        if found is None or found.first > sample:
            if middle == low.at + 1:
                raise ValueError(f"no frame holds sample {sample}")
            high = middle
        else:
            low = found
    return low


def integers_of(file: BinaryIO, h: Header, first: int, n: int) -> np.ndarray:
    """channels x n samples, as integers, from the sample ``first`` on."""
    if not n:
        return np.zeros((h.channels, 0), np.int64)
    frame, found, have = frame_of(file, h, first), [], 0
    skip = first - frame.first
    while True:
        samples, after = decode(file, h, frame)
        found.append(samples[:, skip:])
        have += found[-1].shape[1]
        skip = 0
        if have >= n or after >= h.size:
            return np.concatenate(found, axis=1)[:, :n]
        file.seek(after)
        frame = header_at(file.read(HEAD), 0, h, after)


def frames_of(file: BinaryIO, h: Header, first: int, n: int) -> np.ndarray:
    """The same as float64 in [-1, 1]."""
    return integers_of(file, h, first, n) / float(1 << (h.bits - 1))


def encode(audio: np.ndarray, sample_rate: int, bits: int = 16, block: int = 4096) -> bytes:
    """A FLAC file of channels x samples in [-1, 1]; of the fixed predictors and Rice parameters those that take fewest bits."""
    top = 1 << (bits - 1)
    value = np.clip(np.rint(np.asarray(audio, np.float64) * top), -top, top - 1).astype(np.int64)
    channels, n = value.shape
    depth = {v: k for k, v in BITS.items()}[bits]
    frames = []
    for number, at in enumerate(range(0, n, block)):
        part = value[:, at : at + block]
        size = part.shape[1]
        head = bytes([0xFF, 0xF8, 0x70, (channels - 1) << 4 | depth << 1]) + _number(number) + struct.pack(">H", size - 1)
        body = "".join(_packed_subframe(row, bits) for row in part)
        body += "0" * (-len(body) % 8)
        frame = head + bytes([checksum(head, 8)]) + int(body, 2).to_bytes(len(body) // 8, "big")
        frames.append(frame + struct.pack(">H", checksum(frame, 16)))
    width = (bits + 7) // 8
    raw = value.T.astype("<i8").tobytes()
    plain = b"".join(raw[i : i + width] for i in range(0, len(raw), 8)) if n else b""
    lengths = [len(f) for f in frames] or [0]
    packed = sample_rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | n
    info = struct.pack(">HH", block, block) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(plain).digest()
    return b"fLaC" + struct.pack(">I", 0x80 << 24 | len(info)) + info + b"".join(frames)


def _number(n: int) -> bytes:
    """A frame's number, as UTF-8 writes numbers."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >> (5 * size + 1):
        size += 1
    return bytes([(0xFF << (8 - size) & 0xFF) | n >> (6 * (size - 1))] + [0x80 | n >> (6 * i) & 0x3F for i in range(size - 2, -1, -1)])


def _packed_subframe(row: np.ndarray, bits: int) -> str:
    plain = lambda x, n: format(int(x) & ((1 << n) - 1), f"0{n}b")
    if (row == row[0]).all():
        return "00000000" + plain(row[0], bits)
    orders = [np.diff(row, o) if o else row for o in range(min(5, len(row)))]
    order = int(np.argmin([np.abs(d).sum() for d in orders]))
    folded = orders[order] << 1 ^ orders[order] >> 63
    costs = [int((folded >> k).sum()) + (k + 1) * len(folded) for k in range(15)]
    k = int(np.argmin(costs))
    if costs[k] >= bits * len(row):
        return "00000010" + "".join(plain(x, bits) for x in row)
    coded = "".join("0" * (x >> k) + "1" + (plain(x, k) if k else "") for x in folded.tolist())
    return "0" + plain(8 + order, 6) + "0" + "".join(plain(x, bits) for x in row[:order]) + "00" + "0000" + plain(k, 4) + coded
