"""NumPy kernels for what expressions can't do well: resampling, spectra and loudness. No Spark here.

All take and give float64, channels x samples.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

SILENCE = -200.0


# ------------------------------------------------------------------- resampling
@lru_cache(maxsize=64)
def resample_kernel(old: int, new: int, zeros: int, rolloff: float) -> tuple[np.ndarray, int]:
    """One windowed-sinc filter for each output phase (rows), and the half width in input samples.

    ``old`` and ``new`` have no common divisor. Each filter sums to 1.
    """
    band = min(old, new) * rolloff
    half = math.ceil(zeros * old / band)
    taps = np.arange(-half, half + old)
    phase = np.arange(new)[:, None]
    t = np.clip((taps[None, :] / old - phase / new) * band, -zeros, zeros) * math.pi
    window = np.cos(t / zeros / 2) ** 2
    rows = np.sinc(t / math.pi) * window
    return rows / rows.sum(axis=1, keepdims=True), half


def resampled_length(length: int, old: int, new: int, output_length: int | None = None, full: bool = False) -> int:
    """Whole outputs of the input; one more, if there is a rest, with ``full``."""
    most = -(-new * length // old)
    if output_length is not None:
        if full:
            raise ValueError("give output_length or full, not both")
        if not 0 <= output_length <= most:
            raise ValueError(f"output_length must lie between 0 and {most}")
        return output_length
    return most if full else new * length // old


def resample(x: np.ndarray, old: int, new: int, zeros: int = 24, rolloff: float = 0.945, output_length: int | None = None, full: bool = False) -> np.ndarray:
    """Sinc resampling of every channel from rate ``old`` to ``new``."""
    if not (isinstance(old, (int, np.integer)) and isinstance(new, (int, np.integer))):
        raise ValueError("rates must be integers")
    if old < 1 or new < 1:
        raise ValueError("rates must be positive")
    divisor = math.gcd(int(old), int(new))
    old, new = int(old) // divisor, int(new) // divisor
    length = x.shape[-1]
    n = resampled_length(length, old, new, output_length, full)
    if old == new or not length:
        return x[..., :n]
    rows, half = resample_kernel(old, new, zeros, rolloff)
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(half, half + old)])
    steps = np.lib.stride_tricks.sliding_window_view(padded, rows.shape[1], axis=-1)[..., ::old, :]
    return (steps @ rows.T).reshape(*x.shape[:-1], -1)[..., :n]


# ---------------------------------------------------------------------- spectra
@lru_cache(maxsize=16)
def window_of(name: str, n: int) -> np.ndarray:
    """Periodic windows."""
    k = np.arange(n)
    if name == "hann":
        return 0.5 - 0.5 * np.cos(2 * math.pi * k / n)
    if name == "hamming":
        return 0.54 - 0.46 * np.cos(2 * math.pi * k / n)
    if name in ("boxcar", "ones"):
        return np.ones(n)
    raise ValueError(f"unknown window {name!r}")


def stft(x: np.ndarray, frame: int = 2048, hop_factor: float = 0.25, window: str = "hann") -> np.ndarray:
    """Spectrum (..., frequencies, frames): half a frame of zeros on both sides, the tail filled to a whole hop.

    It is scaled by the window's sum. Signals shorter than a frame are filled up to one first.
    """
    if frame % 2:
        raise ValueError("frame length must be even")
    hop, w = int(frame * hop_factor), window_of(window, frame)
    length = max(x.shape[-1], frame)
    tail = -length % hop if hop else 0
    sides = [(0, 0)] * (x.ndim - 1) + [(frame // 2, length - x.shape[-1] + frame // 2 + tail)]
    cut = np.lib.stride_tricks.sliding_window_view(np.pad(x, sides), frame, axis=-1)[..., ::hop, :]
    return np.moveaxis(np.fft.rfft(cut * w, axis=-1), -1, -2) / w.sum()


def istft(z: np.ndarray, frame: int, hop: int, window: str = "hann", length: int | None = None) -> np.ndarray:
    """The signal of a spectrum, by windowed overlap-add; cut or filled to ``length``."""
    w = window_of(window, frame)
    pieces = np.fft.irfft(np.moveaxis(z, -1, -2) * w.sum(), n=frame, axis=-1) * w
    n = pieces.shape[-2]
    out, weight = np.zeros((*z.shape[:-2], frame + hop * (n - 1))), np.zeros(frame + hop * (n - 1))
    for k in range(n):
        out[..., k * hop : k * hop + frame] += pieces[..., k, :]
        weight[k * hop : k * hop + frame] += w * w
    out = (out / np.where(weight > 1e-10, weight, 1.0))[..., frame // 2 : out.shape[-1] - frame // 2]
    if length is None:
        return out
    return out[..., :length] if out.shape[-1] >= length else np.pad(out, [(0, 0)] * (out.ndim - 1) + [(0, length - out.shape[-1])])


def rotate(x: np.ndarray, phase: np.ndarray, frame: int, hop_factor: float, window: str) -> np.ndarray:
    """Turn the phases of a spectrum; ``phase`` is channels x frequencies or channels x 1."""
    z = stft(x, frame, hop_factor, window) * np.exp(1j * phase)[..., None]
    return istft(z, frame, int(frame * hop_factor), window, x.shape[-1])


def n_frequencies(frame: int) -> int:
    return frame // 2 + 1


# --------------------------------------------------------------------- loudness
#: Filters of ITU-R BS.1770 in analog form: gain in dB, quality and corner frequency. Fixed values.
SHELF = (3.999843853973347, 0.7071752369554196, 1681.974450955533)
HIGH_PASS = (0.5003270373238773, 38.13547087602444)
CHANNEL_GAINS = (1.0, 1.0, 1.0, 1.41, 1.41)
BLOCK, OVERLAP, ABSOLUTE_GATE, RELATIVE_GATE = 0.4, 0.75, -70.0, -10.0


def k_weighting(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(b, a) of the shelf and the high pass at a rate, by the bilinear transform."""
    gain, q, corner = SHELF
    k, v = math.tan(math.pi * corner / rate), 10 ** (gain / 20)
    vb = v**0.499666774155
    a0 = 1 + k / q + k * k
    shelf = (np.array([v + vb * k / q + k * k, 2 * (k * k - v), v - vb * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]))
    q, corner = HIGH_PASS
    k = math.tan(math.pi * corner / rate)
    a0 = 1 + k / q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]))]


def impulse_response(b: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    out = [0.0] * n
    x1 = x2 = y1 = y2 = 0.0
    for i in range(n):
        x = 1.0 if i == 0 else 0.0
        y = b[0] * x + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
        x1, x2, y1, y2 = x, x1, y, y1
        out[i] = y
    return np.array(out)


@lru_cache(maxsize=32)
def k_taps(rate: int, taps: int) -> np.ndarray:
    """Both filters as one finite filter, each cut to ``taps``."""
    one, two = (impulse_response(b, a, taps) for b, a in k_weighting(rate))
    return np.convolve(one, two)


def _convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    size = 1 << (n + len(h) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[..., :n]


def integrated_loudness(x: np.ndarray, rate: int, zeros: int = 512, kind: str = "fir") -> float:
    """Gated loudness (LUFS) of channels x samples after BS.1770; -200 where it isn't defined (silence).

    ``fir`` cuts each filter's impulse response to ``zeros`` samples; ``iir`` runs it over the whole clip.
    """
    n = x.shape[-1]
    if n < BLOCK * rate:
        x = np.pad(x, ((0, 0), (0, int(BLOCK * rate) - n)))
        n = x.shape[-1]
    y = _convolve(x, k_taps(rate, zeros if kind == "fir" else n))
    step = BLOCK * (1 - OVERLAP)
    blocks = max(int(round((n / rate - BLOCK) / step)) + 1, 1)
    power = np.concatenate([np.zeros((len(x), 1)), np.cumsum(y * y, axis=-1)], axis=-1)
    start = np.array([int(step * k * rate) for k in range(blocks)])
    stop = np.minimum([int((step * k + BLOCK) * rate) for k in range(blocks)], n)
    z = (power[:, stop] - power[:, np.minimum(start, n)]) / (BLOCK * rate)
    gains = np.array([CHANNEL_GAINS[min(c, 4)] for c in range(len(x))])
    with np.errstate(divide="ignore", invalid="ignore"):
        each = -0.691 + 10 * np.log10(gains @ z)
        loud = each >= ABSOLUTE_GATE
        gate = -0.691 + 10 * np.log10(gains @ z[:, loud].mean(axis=1)) + RELATIVE_GATE if loud.any() else math.nan
        loud &= each > gate
        value = -0.691 + 10 * np.log10(gains @ z[:, loud].mean(axis=1)) if loud.any() else math.nan
    return SILENCE if not np.isfinite(value) else float(value)
