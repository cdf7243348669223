"""Kernels over recordings that are cut into rows of chunks, however long they are and wherever they are cut.

A chunk is a row (record_key, start, audio, sample_rate): ``start`` is the place of its first sample in the recording. Chunks of a recording
follow each other without gaps or overlaps; they may have any lengths and come in any order. Work is done by tiles of
a fixed grid. A chunk sends each tile the samples that lie in it and in a halo on its sides, so a tile's kernel sees all it needs, and what it gives is
what the kernel gives for the whole clip. Only slices move; no task sees more than a tile and its halos, and one
recording of any length is spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..operators.arrow import AUDIO, SPECTRUM, audio_array, clip_arrays

#: Seconds of a tile.
TILE_SECONDS = 10
#: Samples of a tile of spectra, about.
TILE = 1 << 17


def cut_clips(clips: DataFrame, samples: int, clip_col: str = "clip") -> DataFrame:
    """Chunks of so many samples of each clip, from rows (record_key, clip). A clip without samples gives none."""
    audio, rate = F.col(clip_col)["audio_data"], F.col(clip_col)["sample_rate"]
    n = F.coalesce(F.array_max(F.transform(audio, lambda ch: F.size(ch))), F.lit(0))
    starts = F.sequence(F.lit(0), n - 1, F.lit(samples))
    parts = F.transform(starts, lambda s: F.struct(s.cast("long").alias("start"), F.transform(audio, lambda ch: F.slice(ch, s + 1, F.lit(samples))).alias("audio")))
    return clips.where(n > 0).select("record_key", F.explode(parts).alias("c"), rate.alias("sample_rate")).select("record_key", "c.start", "c.audio", "sample_rate")


def join_chunks(chunks: DataFrame) -> DataFrame:
    """Rows (record_key, audio, sample_rate): chunks end to end. For recordings that fit into a row."""
    whole = chunks.groupBy("record_key").agg(F.array_sort(F.collect_list(F.struct("start", "audio"))).alias("c"), F.first("sample_rate").alias("sample_rate"))
    channels = F.sequence(F.lit(0), F.size(F.col("c")[0]["audio"]) - 1)
    return whole.select("record_key", F.transform(channels, lambda i: F.flatten(F.transform("c", lambda x: F.get(x["audio"], i)))).alias("audio"), "sample_rate")


def tiles(chunks: DataFrame, width: Column, halo: Column) -> DataFrame:
    """Rows (record_key, tile, width, halo, sample_rate, at, audio): what each chunk sends to each tile; at is a piece's place in the recording."""
    n = F.coalesce(F.array_max(F.transform("audio", lambda ch: F.size(ch))), F.lit(0)).cast("long")
    rows = chunks.select("record_key", F.col("start").cast("long").alias("start"), "audio", "sample_rate", width.cast("long").alias("width"), halo.cast("long").alias("halo"), n.alias("n")).where("n > 0")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start") - F.col("halo")) / F.col("width")))
    last = F.floor((F.col("start") + F.col("n") - 1 + F.col("halo")) / F.col("width"))

    def piece(t: Column) -> Column:
        low = F.greatest(F.col("start"), t * F.col("width") - F.col("halo"))
        high = F.least(F.col("start") + F.col("n"), (t + 1) * F.col("width") + F.col("halo"))
        own = F.transform("audio", lambda ch: F.slice(ch, (low - F.col("start") + 1).cast("int"), (high - low).cast("int")))
        return F.struct(t.alias("tile"), low.alias("at"), own.alias("audio"))

    # All pieces of a chunk as one array first: the chunk itself is not copied for each of its tiles.
    cut = rows.select("record_key", "width", "halo", "sample_rate", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return cut.select("record_key", "p.tile", "width", "halo", "sample_rate", "p.at", "p.audio")


#: Spark's names of the kinds of columns that tiles give, and how a list of values becomes a column.
KINDS: dict[str, Callable] = {
    "long": lambda v: pa.array(v, pa.int64()), "int": lambda v: pa.array(v, pa.int32()), "double": lambda v: pa.array(v, pa.float64()), AUDIO: lambda v: audio_array(list(v)),
    SPECTRUM: lambda v: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in v])).astype(np.int32)), pa.concat_arrays(v)),
}


def tiled(chunks: DataFrame, width: Column, halo: Column, one: Callable, fields: dict[str, str]) -> DataFrame:
    """Apply ``one`` to each tile: rows (record_key, *fields), whose kinds are among KINDS.

    ``one(x, tile, width, halo, rate, end)`` gives a list of tuples. x is channels x (width + 2 halo) samples from ``halo`` before the tile on, zeros where
    the recording has none; ``end`` is the recording's length if the tile can see it, else None.
    """
    pieces = tiles(chunks, width, halo)
    met = pieces.groupBy("record_key", "tile").agg(F.first("width").alias("width"), F.first("halo").alias("halo"), F.first("sample_rate").alias("sample_rate"), F.collect_list("at").alias("at"), F.collect_list("audio").alias("audio"))
    key = dict(chunks.dtypes)["record_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("tile", "width", "halo", "sample_rate", "at")]
            audio = batch.column("audio")
            for i, (tile, wide, side, rate, places) in enumerate(zip(*plain, strict=True)):
                parts = list(clip_arrays(audio[i].values))
                low = tile * wide - side
                x = np.zeros((max(len(p) for p in parts), wide + 2 * side))
                for at, p in zip(places, parts, strict=True):
                    x[: len(p), at - low : at - low + p.shape[1]] = p
                end = max(at + p.shape[1] for at, p in zip(places, parts, strict=True))
                rows = one(x, tile, wide, side, rate, end if end < (tile + 1) * wide + side else None)
                if rows:
                    keys = batch.column("record_key").take(pa.array([i] * len(rows)))
                    columns = [KINDS[kind](v) for kind, v in zip(fields.values(), zip(*rows, strict=True), strict=True)]
                    yield pa.RecordBatch.from_arrays([keys, *columns], ["record_key", *fields])

    return met.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in {"record_key": key, **fields}.items()))


def resample_chunks(chunks: DataFrame, new_rate: int, zeros: int = 24, rolloff: float = 0.945, tile_seconds: int = TILE_SECONDS) -> DataFrame:
    """The chunks at another rate: rows (record_key, start, audio, sample_rate), a chunk for each tile; together what the clip's resampling gives."""

    def one(x, tile, width, side, rate, end):
        divisor = math.gcd(rate, new_rate)
        old, new = rate // divisor, new_rate // divisor
        first, n = tile * width // old * new, width // old * new
        if end is not None:
            n = min(n, new * end // old - first)
        if n <= 0:
            return []
        if old == new:
            return [(first, x[:, side : side + n], rate)]
        rows, half = k.resample_kernel(old, new, zeros, rolloff)
        windows = np.lib.stride_tricks.sliding_window_view(x[:, side - half : side + width + half], rows.shape[1], axis=-1)[:, ::old]
        return [(first, (windows @ rows.T).reshape(len(x), -1)[:, :n], new_rate)]

    # A width of whole seconds is a multiple of the rate without common divisors, so tiles begin at a whole output.
    halo = F.ceil(F.lit(zeros / rolloff) * F.greatest(F.lit(1.0), F.col("sample_rate") / float(new_rate))) + 1
    return tiled(chunks, F.col("sample_rate") * tile_seconds, halo, one, {"start": "long", "audio": AUDIO, "sample_rate": "int"})


def chunk_loudness(chunks: DataFrame, zeros: int = 512, tile_seconds: int = TILE_SECONDS) -> DataFrame:
    """Rows (record_key, loudness): gated loudness of each recording, as of the whole clip.

    Tiles filter their samples with what comes before as their halo, and give each gating block their part of its power. Parts
    are summed up by Spark, and both gates are aggregates, so a recording's state is a number for each tenth of a second.
    """
    step, block = k.BLOCK * (1 - k.OVERLAP), k.BLOCK

    def one(x, tile, width, side, rate, end):
        low, high = tile * width, (tile + 1) * width
        last = end is not None and end <= high
        if last:
            # A short recording is filled up to a block, with the filters' tails.
            high = max(end, int(block * rate)) if end < block * rate else end
        if high <= low:
            return []
        y = k._convolve(x[:, : side + high - low], k.k_taps(rate, zeros))[:, side:]
        power = np.concatenate([np.zeros((len(y), 1)), np.cumsum(y * y, axis=1)], axis=1)
        gains = np.array([k.CHANNEL_GAINS[min(c, 4)] for c in range(len(y))])
        out = []
        for b in range(max(0, int((low / rate - block) / step) - 1), int(high / rate / step) + 2):
            a, z = max(int(step * b * rate), low), min(int((step * b + block) * rate), high)
            if a < z:
                out.append((b, float(gains @ (power[:, z - low] - power[:, a - low])) / (block * rate), high if last else None, rate))
        return out

    parts = tiled(chunks, F.col("sample_rate") * tile_seconds, F.lit(2 * zeros), one, {"block": "long", "power": "double", "length": "long", "rate": "int"})
    blocks = parts.groupBy("record_key", "block").agg(F.sum("power").alias("power"), F.max("length").alias("length"), F.max("rate").alias("rate"))
    sizes = blocks.groupBy("record_key").agg(F.max("length").alias("n"), F.max("rate").alias("rate"))
    count = F.greatest(F.rint((F.col("n") / F.col("rate") - block) / step).cast("long") + 1, F.lit(1))
    db = lambda z: F.lit(-0.691) + 10 * F.log10(z)
    loud = blocks.join(sizes.select("record_key", count.alias("count")), "record_key").where((F.col("block") < F.col("count")) & (F.col("power") > 0)).where(db(F.col("power")) >= k.ABSOLUTE_GATE)
    gates = loud.groupBy("record_key").agg((db(F.avg("power")) + k.RELATIVE_GATE).alias("gate"))
    heard = loud.join(gates, "record_key").where(db(F.col("power")) > F.col("gate")).groupBy("record_key").agg(db(F.avg("power")).alias("l"))
    return sizes.select("record_key").join(heard, "record_key", "left").select("record_key", F.coalesce("l", F.lit(k.SILENCE)).alias("loudness"))


def _spectral(frame: int, hop_factor: float) -> tuple[int, int]:
    """Hop, and samples of a tile: whole hops, and more than two frames."""
    if frame % 2:
        raise ValueError("frame length must be even")
    hop = int(frame * hop_factor)
    if not 0 < hop <= frame // 2:
        raise ValueError("hops can be half a frame at most")
    return hop, max(TILE, 3 * frame) // hop * hop


def stft_chunks(chunks: DataFrame, frame: int = 2048, hop_factor: float = 0.25, window: str = "hann") -> DataFrame:
    """Rows (record_key, spectrum, length): the spectrum of each tile, with the frames' numbers in the recording; length where the tile sees the recording's end."""
    hop, width = _spectral(frame, hop_factor)

    def one(x, tile, wide, side, rate, end):
        first, n = tile * wide // hop, wide // hop
        if end is not None:
            n = min(n, -(-max(end, frame) // hop) + 1 - first)
        if n <= 0:
            return []
        cut = np.lib.stride_tricks.sliding_window_view(x, frame, axis=-1)[:, ::hop][:, :n]
        w = k.window_of(window, frame)
        z = np.moveaxis(np.fft.rfft(cut * w, axis=-1), -1, -2) / w.sum()
        c, f, t = np.indices(z.shape).reshape(3, -1)
        items = pa.StructArray.from_arrays([pa.array(v, kind) for v, kind in ((c, pa.int32()), (f, pa.int32()), (t + first, pa.int32()), (z.real.ravel(), pa.float64()), (z.imag.ravel(), pa.float64()))], ["channel", "frequency", "frame", "re", "im"])
        return [(items, end)]

    return tiled(chunks, F.lit(width), F.lit(frame // 2), one, {"spectrum": SPECTRUM, "length": "long"})


def istft_chunks(spectra: DataFrame, frame: int = 2048, hop_factor: float = 0.25, window: str = "hann", sample_rate: int | None = None) -> DataFrame:
    """Chunks (record_key, start, audio, sample_rate) of spectra (record_key, spectrum, length), whose frames may be dealt over rows in any way.

    Each row adds up its own frames' windowed signals and their weights, cut by tiles; a tile adds up what rows send it, and divides.
    """
    hop, width = _spectral(frame, hop_factor)
    key = dict(spectra.dtypes)["record_key"]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = k.window_of(window, frame)
        for batch in batches:
            for i, (items, length) in enumerate(zip(batch.column("spectrum"), batch.column("length").to_pylist(), strict=True)):
                if not items.is_valid or not len(items.values):
                    continue
                c, f, t, re, im = (items.values.field(name).to_numpy() for name in ("channel", "frequency", "frame", "re", "im"))
                first, channels = int(t.min()), int(c.max()) + 1
                z = np.zeros((channels, int(t.max()) + 1 - first, frame // 2 + 1), complex)
                z[c, t - first, f] = re + 1j * im
                pieces = np.fft.irfft(z * w.sum(), n=frame, axis=-1) * w
                held = np.unique(t) - first
                out = np.zeros((channels + 1, (z.shape[1] - 1) * hop + frame))  # the last row has the weights
                for j in held:
                    out[:-1, j * hop : j * hop + frame] += pieces[:, j]
                    out[-1, j * hop : j * hop + frame] += w * w
                start = first * hop - frame // 2
                for tile in range(max(start, 0) // width, (start + out.shape[1] - 1) // width + 1):
                    a, b = max(start, tile * width, 0), min(start + out.shape[1], (tile + 1) * width)
                    own = out[:, a - start : b - start]
                    lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), pa.array(own.ravel())))
                    columns = [pa.array([tile], pa.int64()), pa.array([a], pa.int64()), lists, pa.array([length], pa.int64())]
                    yield pa.RecordBatch.from_arrays([batch.column("record_key").slice(i, 1), *columns], ["record_key", "tile", "at", "sums", "length"])

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (tile, places, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "at", "length")), strict=True)):
                parts = list(clip_arrays(batch.column("sums")[i].values))
                total = np.zeros((max(map(len, parts)), width))
                for at, p in zip(places, parts, strict=True):
                    here = slice(at - tile * width, at - tile * width + p.shape[1])
                    total[: len(p) - 1, here] += p[:-1]
                    total[-1, here] += p[-1]
                n = width if length is None else min(width, length - tile * width)
                n = min(n, max(at + p.shape[1] for at, p in zip(places, parts, strict=True)) - tile * width)
                if n > 0:
                    audio = (total[:-1] / np.where(total[-1] > 1e-10, total[-1], 1.0))[:, :n]
                    yield pa.RecordBatch.from_arrays([batch.column("record_key").slice(i, 1), pa.array([tile * width], pa.int64()), audio_array([audio]), pa.array([sample_rate], pa.int32())], ["record_key", "start", "audio", "sample_rate"])

    sums = spectra.select("record_key", "spectrum", "length").mapInArrow(added, f"record_key {key}, tile long, at long, sums array<array<double>>, length long")
    met = sums.groupBy("record_key", "tile").agg(F.collect_list("at").alias("at"), F.collect_list("sums").alias("sums"), F.max("length").alias("length"))
    return met.mapInArrow(divided, f"record_key {key}, start long, audio {AUDIO}, sample_rate int")
