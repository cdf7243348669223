"""Searching for a loud enough excerpt.

Tries are made one after the other until one is louder than the cutoff; otherwise the loudest counts, of
equals the first. As a set: the first try over the cutoff, else the loudest, ties to the earliest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as e
from ..functions import kernels as k
from ..operators import arrow
from ..rng import Stream, uniform_key
from ..schema import CLIP, with_fields

Draw = Callable[..., object]


def _uniform(u, offset, duration, total, attempt, tries, low, high):
    return offset, high(total - duration, offset)


def _early(u, offset, duration, total, attempt, tries, low, high):
    most = high(total - duration, offset)
    share = attempt / (tries - 1) if not isinstance(tries, int) or tries > 1 else attempt * 0.0
    return offset, most * (1 - share) + low(most, offset + duration) * share


#: Searches by name: (u, offset, duration, total, attempt, tries, least, greatest) -> the range that a try's offset is drawn from, for
#: numbers and columns alike. ``early`` moves towards the beginning. A search may also be given as such a function.
SEARCHES: dict[str, Draw] = {"uniform": _uniform, "early": _early}


def register_search(name: str, search: Draw) -> None:
    """Make a search known by name."""
    SEARCHES[name] = search


def _found(search: str | Draw) -> Draw:
    return search if callable(search) else SEARCHES[search]


def offset_value(search: str | Draw, u: float, offset: float, duration: float, total: float, attempt: int, tries: int) -> float:
    low, high = _found(search)(u, max(0.0, offset), duration, total, attempt, tries, min, max)
    return low + u * (high - low)


def offset_column(search: str | Draw, u: Column, offset: Column | float, duration: float, total: Column, attempt: Column, tries: int) -> Column:
    """The same as a column."""
    start = F.greatest(F.lit(0.0), F.lit(float(offset)) if isinstance(offset, (int, float)) else offset)
    low, high = _found(search)(u, start, F.lit(float(duration)), total, attempt.cast("double"), tries, F.least, F.greatest)
    return low + u * (high - low)


@dataclass(frozen=True)
class SaliencyParams:
    """How to search: off unless ``enabled``; no cutoff, or a cutoff of NaN, also turns it off."""

    enabled: bool = False
    num_tries: int = 8
    loudness_cutoff: float | None = -40.0
    search_function: str | Draw = "uniform"

    def __post_init__(self):
        if not isinstance(self.num_tries, int) or self.num_tries < 1:
            raise ValueError("num_tries must be 1 or more")
        if not callable(self.search_function) and self.search_function not in SEARCHES:
            raise ValueError(f"unknown search {self.search_function!r}; known are {', '.join(SEARCHES)}")

    @property
    def active(self) -> bool:
        return self.enabled and self.loudness_cutoff is not None and not np.isnan(self.loudness_cutoff)


def searched(heard: Callable[[float], float], total: float, duration: float, params: SaliencyParams, seed: int, record: object) -> float:
    """The offset of the excerpt, in seconds, of a clip of ``total`` seconds; ``heard`` gives the loudness at an offset. Tries end early where one is loud enough."""
    best, at = -np.inf, 0.0
    for attempt in range(params.num_tries):
        u = uniform_key(seed, record, "saliency", "", "", "offset", attempt)
        offset = offset_value(params.search_function, u, 0.0, duration, total, attempt, params.num_tries)
        loudness = heard(offset)
        if attempt == 0 or loudness > best:
            best, at = loudness, offset
        if best > params.loudness_cutoff:
            break
    return at


def salient(audio: np.ndarray, rate: int, duration: float, params: SaliencyParams, seed: int, record: object) -> float:
    """The offset of the excerpt of some samples."""

    def heard(offset: float) -> float:
        piece = audio[..., int(offset * rate) :][..., : round(duration * rate)]
        return k.integrated_loudness(np.pad(piece, ((0, 0), (0, round(duration * rate) - piece.shape[-1]))), rate)

    return searched(heard, audio.shape[-1] / rate, duration, params, seed, record)


def attempts(clips: DataFrame, duration: float, params: SaliencyParams, seed: int = 0, clip_col: str = "clip") -> DataFrame:
    """Rows (record_key, attempt, offset): all tries of each record, drawn by its key."""
    clip = F.col(clip_col)
    total = F.size(F.get(clip["audio_data"], 0)) / clip["sample_rate"]
    tries = clips.select("record_key", total.alias("total"), F.explode(F.sequence(F.lit(0), F.lit(params.num_tries - 1))).alias("attempt"))
    u = Stream(seed, F.col("record_key"), "saliency").uniform("offset", F.col("attempt"))
    return tries.select("record_key", "attempt", offset_column(params.search_function, u, 0.0, duration, F.col("total"), F.col("attempt"), params.num_tries).alias("offset"))


def random_excerpts(clips: DataFrame, duration: float, search: str = "uniform", offset: float = 0.0, seed: int = 0, clip_col: str = "clip") -> DataFrame:
    """Each record's clip cut to a random excerpt, whatever its loudness: rows (record_key, clip).

    The offset is drawn once (try 0 of 1) and noted in the metadata; the loudness becomes unknown.
    """
    if duration <= 0:
        raise ValueError("an excerpt needs a duration")
    clip = F.col(clip_col)
    total = F.size(F.get(clip["audio_data"], 0)) / clip["sample_rate"]
    u = Stream(seed, F.col("record_key"), "excerpt").uniform("offset")
    at = offset_column(search, u, offset, duration, total, F.lit(0), 1)
    drawn = clips.select("record_key", clip.alias("clip"), at.alias("at"))
    meta = F.struct(F.col("clip.metadata.filepath").alias("filepath"), F.col("at").alias("offset"), F.lit(float(duration)).alias("duration"), F.col("clip.metadata.extra").alias("extra"))
    audio = e.excerpt(F.col("clip.audio_data"), F.col("clip.sample_rate"), F.col("at"), duration)
    return drawn.select("record_key", with_fields(F.col("clip"), CLIP, audio_data=audio, loudness=F.lit(None).cast("double"), metadata=meta).alias("clip"))


def pick(tries: DataFrame, cutoff: float) -> DataFrame:
    """From rows (record_key, attempt, loudness, ...) the attempt of each record."""
    first = F.expr(f"min(attempt) filter (where loudness > {float(cutoff)!r})")
    return tries.groupBy("record_key").agg(F.coalesce(first, F.max_by("attempt", F.struct("loudness", -F.col("attempt")))).alias("attempt"))


def salient_excerpts(clips: DataFrame, duration: float, params: SaliencyParams, seed: int = 0, clip_col: str = "clip") -> DataFrame:
    """Relational form: rows (record_key, attempt, offset, loudness) of the chosen excerpts."""
    if duration <= 0:
        raise ValueError("an excerpt needs a duration")
    hear = arrow.excerpt_loudness_kernel()
    clip = F.col(clip_col)
    total = F.size(F.get(clip["audio_data"], 0)) / clip["sample_rate"]
    u = lambda i: Stream(seed, F.col("record_key"), "saliency").uniform("offset", i)
    offsets = F.array(*[offset_column(params.search_function, u(F.lit(i)), 0.0, duration, total, F.lit(i), params.num_tries) for i in range(params.num_tries)])
    # All tries of a clip are heard where the clip is, so no audio is shuffled.
    drawn = clips.select("record_key", clip.alias("__clip"), offsets.alias("offsets"))
    heard = drawn.select("record_key", "offsets", hear(F.col("__clip.audio_data"), F.col("__clip.sample_rate"), F.col("offsets"), F.lit(float(duration))).alias("loudness"))
    tries = heard.select("record_key", F.transform(F.arrays_zip("offsets", "loudness"), lambda x, i: F.struct(i.alias("attempt"), x["offsets"].alias("offset"), x["loudness"].alias("loudness"))).alias("tries"))
    over = F.get(F.filter("tries", lambda x: x["loudness"] > float(params.loudness_cutoff)), 0)
    by_loudness = F.array_max(F.transform("tries", lambda x: F.struct(x["loudness"].alias("loudness"), (-x["attempt"]).alias("back"), x.alias("t"))))
    chosen = tries.select("record_key", F.coalesce(over, by_loudness["t"]).alias("t"))
    return chosen.select("record_key", "t.*")
