"""WAV files: header probe, seeking reads and a writer."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Header:
    form: int
    channels: int
    sample_rate: int
    bits: int
    start: int  # of the samples, in bytes
    frames: int

    @property
    def duration(self) -> float:
        return self.frames / self.sample_rate


def probe(file: BinaryIO) -> Header:
    """Read the chunk headers up to the samples; no sample is read."""
    if file.read(4) != b"RIFF" or not file.read(4) or file.read(4) != b"WAVE":
        raise ValueError("not a WAV file")
    form = None
    while True:
        head = file.read(8)
        if len(head) < 8:
            raise ValueError("a WAV file without samples")
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            body = file.read(size + size % 2)
            form, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if form == EXTENSIBLE and size >= 26:
                form = struct.unpack("<H", body[24:26])[0]
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            start = file.tell()
            left = file.seek(0, 2) - start
            size = left if size in (0, 0xFFFFFFFF) else min(size, left)
            return Header(form, channels, rate, bits, start, size // (channels * (bits // 8)))
        else:
            file.seek(size + size % 2, 1)


def frames_of(file: BinaryIO, h: Header, first: int, n: int) -> np.ndarray:
    """channels x samples (float64 in [-1, 1]) of n frames from ``first`` on; only these are read."""
    width = h.channels * (h.bits // 8)
    file.seek(h.start + first * width)
    return samples(file.read(n * width), h).reshape(-1, h.channels).T


def samples(raw: bytes, h: Header) -> np.ndarray:
    if h.form == FLOAT and h.bits in (32, 64):
        return np.frombuffer(raw, f"<f{h.bits // 8}").astype(np.float64)
    if h.form != PCM:
        raise ValueError(f"WAV format {h.form} can't be read")
    if h.bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if h.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        value = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return (value - ((value & 0x800000) << 1)) / float(1 << 23)
    if h.bits in (16, 32):
        return np.frombuffer(raw, f"<i{h.bits // 8}").astype(np.float64) / float(1 << (h.bits - 1))
    raise ValueError(f"{h.bits}-bit samples can't be read")


def encode(audio: np.ndarray, sample_rate: int, bits: int = 16) -> bytes:
    """A WAV file of channels x samples; 8, 16, 24 or 32 bits of PCM, or -32 for float."""
    flat = np.asarray(audio, np.float64).T.reshape(-1)
    form, width = (FLOAT, 4) if bits == -32 else (PCM, bits // 8)
    if form == FLOAT:
        data = flat.astype("<f4").tobytes()
    else:
        top = (1 << (bits - 1)) - 1
        value = np.clip(np.rint(flat * (top + 1)), -top - 1, top).astype(np.int64)
        if bits == 8:
            data = (value + 128).astype(np.uint8).tobytes()
        elif bits == 24:
            data = value.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        else:
            data = value.astype(f"<i{width}").tobytes()
    channels = len(audio)
    head = struct.pack("<HHIIHH", form, channels, sample_rate, sample_rate * channels * width, channels * width, width * 8)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data
