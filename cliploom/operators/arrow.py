"""Arrow kernels over clip columns: NumPy views on the samples, results back as one Arrow list.

Samples are read without copies from the column's buffers; each clip is processed on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import kernels as k
from ..rng import SCALE

AUDIO = "array<array<float>>"


def clip_arrays(audio: pa.Array) -> Iterator[np.ndarray | None]:
    """channels x samples (float64) of each value of a list<list<float>>; None for null.

    Channels that are shorter than the longest are filled with zeros; null samples are NaN.
    """
    channels = audio.values
    outer = audio.offsets.to_numpy()
    inner = channels.offsets.to_numpy()
    values = channels.values.to_numpy(zero_copy_only=False)
    for i in range(len(audio)):
        if not audio[i].is_valid:
            yield None
            continue
        rows = [values[inner[c] : inner[c + 1]] for c in range(outer[i], outer[i + 1])]
        n = max(map(len, rows), default=0)
        yield np.array([np.pad(r.astype(np.float64), (0, n - len(r))) for r in rows]).reshape(len(rows), n)


def audio_array(clips: list[np.ndarray | None], kind: pa.DataType | None = None) -> pa.Array:
    """The inverse of :func:`clip_arrays`, in float."""
    kind = kind or pa.float32()
    valid = [c for c in clips if c is not None]
    outer, last = [], 0
    for c in clips:
        outer.append(None if c is None else last)
        last += 0 if c is None else len(c)
    sizes = [row.shape[-1] for c in valid for row in c]
    flat = np.concatenate([row for c in valid for row in c]) if sizes else np.zeros(0)
    dtype = np.float32 if kind == pa.float32() else np.int32
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat.astype(dtype), kind))
    return pa.ListArray.from_arrays(pa.array([*outer, last], pa.int32()), inner)


def _nested(one: Callable, result: str):
    """Arrow UDFs of a kernel for a leaf, and for an array of leaves.

    ``one`` maps (audio arrays, argument arrays...) of equal length to an Arrow array. For arrays of
    leaves, ``first`` is the list and the other arguments are repeated for its elements, followed by
    the element's index.
    """

    def leaf(audio: pa.Array, *rest: pa.Array) -> pa.Array:
        return one(audio, *rest, pa.array([""] * len(audio)))

    def listed(audios: pa.Array, *rest: pa.Array) -> pa.Array:
        sizes = [len(x) if x.is_valid else 0 for x in audios]
        take = pa.array(np.repeat(np.arange(len(audios)), sizes))
        index = pa.array([str(j) for n in sizes for j in range(n)], pa.string())
        wide = [r.take(take) if not pa.types.is_list(r.type) or not lists[j] else r.flatten() for j, r in enumerate(rest)]
        lists_out = one(audios.flatten(), *wide, index)
        at = np.append(0, np.cumsum(sizes)).tolist()
        offsets = pa.array([a if x.is_valid else None for a, x in zip(at, audios, strict=False)] + [at[-1]], pa.int32())
        return pa.ListArray.from_arrays(offsets, lists_out)

    lists: dict[int, bool] = {}

    def run_leaf(value: Column, *rest: Column) -> Column:
        return _udf(leaf, result, 1 + len(rest))(value, *rest)

    def run_list(values: Column, *rest: Column, from_list: tuple[int, ...] = ()) -> Column:
        lists.update({j: j in from_list for j in range(len(rest))})
        return _udf(listed, f"array<{result}>", 1 + len(rest))(values, *rest)

    return run_leaf, run_list


def _udf(function: Callable, result: str, n: int):
    """Arrow UDFs take no variable arguments, so each number of them gets a function of its own."""
    fixed = {
        1: lambda a: function(a),
        2: lambda a, b: function(a, b),
        3: lambda a, b, c: function(a, b, c),
        4: lambda a, b, c, d: function(a, b, c, d),
    }[n]
    fixed.__annotations__ = {name: pa.Array for name in "abcd"[:n]} | {"return": pa.Array}
    return F.arrow_udf(fixed, result)


def loudness_kernel(zeros: int = 512, kind: str = "fir"):
    """(audio, sample_rate) -> LUFS; null for null."""

    def one(audio: pa.Array, rate: pa.Array, index: pa.Array) -> pa.Array:
        out = [None if x is None or r is None or not len(x) else k.integrated_loudness(x, r, zeros, kind) for x, r in zip(clip_arrays(audio), rate.to_pylist(), strict=True)]
        return pa.array(out, pa.float64())

    return _nested(one, "double")


def excerpt_loudness_kernel(zeros: int = 512, kind: str = "fir"):
    """(audio, sample_rate, offsets, duration) -> LUFS of each excerpt, filled with silence to its duration; null for null."""

    def run(audio: pa.Array, rate: pa.Array, offsets: pa.Array, duration: pa.Array) -> pa.Array:
        out = []
        for x, r, at, d in zip(clip_arrays(audio), rate.to_pylist(), offsets.to_pylist(), duration.to_pylist(), strict=True):
            if x is None or r is None or not len(x):
                out.append([None] * len(at))
                continue
            n = round(d * r)
            pieces = [x[:, int(o * r) :][:, :n] for o in at]
            out.append([k.integrated_loudness(np.pad(p, ((0, 0), (0, n - p.shape[1]))), r, zeros, kind) for p in pieces])
        return pa.array(out, pa.list_(pa.float64()))

    return _udf(run, "array<double>", 4)


def resample_kernel(new_rate: int, zeros: int, rolloff: float, output_length: int | None, full: bool):
    """(audio, sample_rate) -> audio at the new rate."""

    def one(audio: pa.Array, rate: pa.Array, index: pa.Array) -> pa.Array:
        return audio_array([None if x is None else x if r == new_rate else k.resample(x, r, new_rate, zeros, rolloff, output_length, full) for x, r in zip(clip_arrays(audio), rate.to_pylist(), strict=True)])

    return _nested(one, AUDIO)


def phase_kernel(amount: float, hop_factor: float, frame: int, window: str, per_frequency: bool):
    """(audio, random prefix) -> audio with turned phases."""
    n_freq = k.n_frequencies(frame) if per_frequency else 1

    def one(audio: pa.Array, prefix: pa.Array, index: pa.Array) -> pa.Array:
        out = []
        for x, p, i in zip(clip_arrays(audio), prefix.to_pylist(), index.to_pylist(), strict=True):
            if x is None or not x.size:
                out.append(x)
                continue
            # The prefix ends with the (empty) list index; a leaf of a list fills it in unless seeds are shared.
            start = p + (i if p.split("|")[3] else "") + "|phase|"
            u = [int(hashlib.md5(f"{start}{j}".encode()).hexdigest()[:13], 16) / SCALE for j in range(len(x) * n_freq)]
            phase = (np.array(u).reshape(len(x), n_freq) * 2 - 1) * np.pi * amount
            out.append(k.rotate(x, phase, frame, hop_factor, window))
        return audio_array(out)

    return _nested(one, AUDIO)


def codec_kernel(encode: Callable[[np.ndarray, int], np.ndarray]):
    """(audio, sample_rate) -> tokens.

    ``encode`` maps (channels x samples, rate) to channels x codebooks x steps; rows of the result go codebook by
    codebook, channels varying fastest.
    """

    def one(audio: pa.Array, rate: pa.Array, index: pa.Array) -> pa.Array:
        out = []
        for x, r in zip(clip_arrays(audio), rate.to_pylist(), strict=True):
            tokens = None if x is None else np.asarray(encode(x, r))
            out.append(None if tokens is None else np.swapaxes(tokens, 0, 1).reshape(tokens.shape[0] * tokens.shape[1], tokens.shape[2]))
        return audio_array(out, pa.int32())

    return _nested(one, "array<array<int>>")


def user_kernel(function: Callable, result: str | None, options: dict, bare: bool):
    """A NumPy function of a leaf as Arrow UDFs: (audio, sample_rate, random prefix), or (numbers, random prefix) of bare arrays.

    ``function(values, sample_rate, rng, **options)`` gives what ``result`` (a type's DDL) says, or audio. The generator is seeded by the
    record and the leaf, so it gives the same numbers wherever and however often a record is computed. Null leaves are skipped.
    """
    kind = to_arrow_type(T.DataType.fromDDL(result)) if result else None

    def made(values, rates, prefixes, indexes) -> pa.Array:
        out = []
        for x, rate, prefix, i in zip(values, rates, prefixes, indexes, strict=True):
            if x is None:
                out.append(None)
                continue
            key = f"{prefix}{i if prefix.split('|')[3] else ''}|kernel"
            out.append(function(x, rate, np.random.Generator(np.random.Philox(int(hashlib.md5(key.encode()).hexdigest(), 16))), **options))
        if kind is None:
            return audio_array([None if x is None else np.atleast_2d(x) for x in out])
        return pa.array([x.tolist() if isinstance(x, (np.ndarray, np.generic)) else x for x in out], kind)

    def numbers(values: pa.Array, prefix: pa.Array, index: pa.Array) -> pa.Array:
        return made([None if v is None else np.array(v, np.float64) for v in values.to_pylist()], [None] * len(values), prefix.to_pylist(), index.to_pylist())

    def audio(values: pa.Array, rate: pa.Array, prefix: pa.Array, index: pa.Array) -> pa.Array:
        return made(list(clip_arrays(values)), rate.to_pylist(), prefix.to_pylist(), index.to_pylist())

    return _nested(numbers if bare else audio, result or AUDIO)


SPECTRUM = "array<struct<channel:int,frequency:int,frame:int,re:double,im:double>>"


def stft(audio: Column, frame: int = 2048, hop_factor: float = 0.25, window: str = "hann") -> Column:
    """The spectrum of a clip's audio, a struct for each channel, frequency and frame."""

    def run(a: pa.Array) -> pa.Array:
        out, sizes = [], []
        for x in clip_arrays(a):
            z = None if x is None else k.stft(x, frame, hop_factor, window)
            sizes.append(None if z is None else z.size)
            if z is not None:
                c, f, t = np.indices(z.shape).reshape(3, -1)
                out.append((c, f, t, z.real.ravel(), z.imag.ravel()))
        columns = [np.concatenate(v) for v in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        flat = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["channel", "frequency", "frame", "re", "im"])
        at = np.append(0, np.cumsum([n or 0 for n in sizes])).tolist()
        return pa.ListArray.from_arrays(pa.array([None if n is None else b for n, b in zip(sizes, at, strict=False)] + [at[-1]], pa.int32()), flat)

    return _udf(run, SPECTRUM, 1)(audio)


def istft(spectrum: Column, length: Column, frame: int = 2048, hop_factor: float = 0.25, window: str = "hann") -> Column:
    """The audio of a spectrum, cut or filled to a length."""

    def run(s: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for items, size in zip(s, n.to_pylist(), strict=True):
            if not items.is_valid:
                out.append(None)
                continue
            c, f, t, re, im = (items.values.field(name).to_numpy() for name in ("channel", "frequency", "frame", "re", "im"))
            z = np.zeros((c.max(initial=0) + 1, frame // 2 + 1, t.max(initial=0) + 1), complex)
            z[c, f, t] = re + 1j * im
            out.append(k.istft(z, frame, int(frame * hop_factor), window, size))
        return audio_array(out)

    return _udf(run, AUDIO, 2)(spectrum, length)
