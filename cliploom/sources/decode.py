"""Clip files of either format: headers, and the frames of an excerpt, from anything that can seek."""

from __future__ import annotations

import io
from typing import BinaryIO

import numpy as np

from . import flac, wav


def probe(file: BinaryIO) -> wav.Header | flac.Header:
    """Read what is before the samples."""
    magic = file.read(4)
    file.seek(0)
    return flac.probe(file) if magic == b"fLaC" else wav.probe(file)


def frames_of(file: BinaryIO, h: wav.Header | flac.Header, first: int, n: int) -> np.ndarray:
    """channels x n samples from the frame ``first`` on, fewer where the file ends; nothing else is read but, for FLAC, what leads to them."""
    first = min(max(first, 0), h.frames)
    n = min(max(n, 0), h.frames - first)
    return flac.frames_of(file, h, first, n) if isinstance(h, flac.Header) else wav.frames_of(file, h, first, n)


def excerpt(file: BinaryIO, h: wav.Header | flac.Header, offset: float, duration: float | None) -> np.ndarray:
    """The samples of some seconds; all from the offset on without a duration."""
    first = max(int(offset * h.sample_rate), 0)
    return frames_of(file, h, first, h.frames - first if duration is None else int(round(duration * h.sample_rate)))


def decode(content: bytes, offset: float = 0.0, duration: float | None = None) -> tuple[np.ndarray, int]:
    """The samples of an excerpt of a file's bytes, and their rate."""
    file = io.BytesIO(content)
    h = probe(file)
    return excerpt(file, h, offset, duration), h.sample_rate
