"""The named transforms."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, ClassVar

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import expr as e
from ..schema import is_clip, with_fields
from . import arrow
from .base import MapTransform, RandomTransform, Spot


def field_of(values: Column, name: str) -> Column:
    """A field of every clip of an array."""
    return F.transform(values, lambda v: v[name])


class Identity(MapTransform):
    """Leaves everything as it is; no expression is made."""

    def changes(self, df, taken=None):
        return {} if self.output_key is None else super().changes(df, taken)

    def apply(self, value: Column, spot: Spot) -> Column:
        return value


class VolumeChange(RandomTransform):
    """Change the gain by U(min_db, max_db); a known loudness moves with it."""

    defaults: ClassVar = {"min_db": 0.0, "max_db": 0.0}

    def apply(self, value: Column, spot: Spot) -> Column:
        db = spot.stream.between(spot.options["min_db"], spot.options["max_db"], "gain")
        return with_fields(value, spot.leaf.kind, audio_data=e.gain(value["audio_data"], db), loudness=value["loudness"] + db)


class _Measured:
    """Loudness by the Arrow meter, on a leaf or an array of leaves."""

    zeros, filter = 512, "fir"
    kernel_result: ClassVar[bool] = True

    def measured(self, value: Column, spot: Spot) -> Column:
        one, _ = arrow.loudness_kernel(self.zeros, self.filter)
        return with_fields(value, spot.leaf.kind, loudness=one(value["audio_data"], value["sample_rate"]))

    def measured_list(self, values: Column, spot: Spot) -> Column:
        _, many = arrow.loudness_kernel(self.zeros, self.filter)
        found = many(field_of(values, "audio_data"), field_of(values, "sample_rate"), from_list=(0,))
        return F.zip_with(values, found, lambda v, x: with_fields(v, spot.leaf.kind, loudness=x))


class ReplaceLoudness(_Measured, MapTransform):
    """Measure each clip and store its loudness."""

    def apply(self, value: Column, spot: Spot) -> Column:
        return self.measured(value, spot)

    def apply_list(self, values: Column, spot: Spot) -> Column:
        return self.measured_list(values, spot)


class VolumeNorm(_Measured, RandomTransform):
    """Bring the loudness to U(min_db, max_db). It is measured anew in any case, also where the coin says no."""

    defaults: ClassVar = {"min_db": 0.0, "max_db": 0.0}

    def before(self, value: Column, spot: Spot) -> Column:
        return self.measured(value, spot)

    def before_list(self, values: Column, spot: Spot) -> Column:
        return self.measured_list(values, spot)

    def apply(self, value: Column, spot: Spot) -> Column:
        target = spot.stream.between(spot.options["min_db"], spot.options["max_db"], "target")
        return with_fields(value, spot.leaf.kind, audio_data=e.gain(value["audio_data"], target - value["loudness"]), loudness=target)


class RescaleAudio(MapTransform):
    """Divide by the peak where it is over 1; the loudness becomes unknown."""

    def apply(self, value: Column, spot: Spot) -> Column:
        return with_fields(value, spot.leaf.kind, audio_data=e.rescale(value["audio_data"]), loudness=F.lit(None).cast("double"))


class InvertPhase(MapTransform):
    """Negate all samples; the loudness stays."""

    def apply(self, value: Column, spot: Spot) -> Column:
        return with_fields(value, spot.leaf.kind, audio_data=e.invert(value["audio_data"]))


class SwapStereo(MapTransform):
    """Reverse the channels; the loudness stays."""

    def apply(self, value: Column, spot: Spot) -> Column:
        return with_fields(value, spot.leaf.kind, audio_data=e.swap_channels(value["audio_data"]))


class ToMono(MapTransform):
    """Mean over channels; the loudness becomes unknown."""

    def apply(self, value: Column, spot: Spot) -> Column:
        return with_fields(value, spot.leaf.kind, audio_data=e.to_mono(value["audio_data"]), loudness=F.lit(None).cast("double"))


class Resample(MapTransform):
    """Sinc resampling to one rate; a clip that has it stays as it is, others lose their loudness."""

    kernel_result: ClassVar[bool] = True

    def __init__(self, sample_rate: int, zeros: int = 24, rolloff: float = 0.945, output_length: int | None = None, full: bool = False, **options: Any):
        super().__init__(**options)
        if not isinstance(sample_rate, int):
            raise ValueError("rates must be integers")
        if full and output_length is not None:
            raise ValueError("give output_length or full, not both")
        self.sample_rate, self.kernel = sample_rate, arrow.resample_kernel(sample_rate, zeros, rolloff, output_length, full)

    def _stored(self, value: Column, audio: Column, spot: Spot) -> Column:
        loudness = F.when(value["sample_rate"] == self.sample_rate, value["loudness"])
        return with_fields(value, spot.leaf.kind, audio_data=audio, sample_rate=F.lit(self.sample_rate), loudness=loudness)

    def apply(self, value: Column, spot: Spot) -> Column:
        return self._stored(value, self.kernel[0](value["audio_data"], value["sample_rate"]), spot)

    def apply_list(self, values: Column, spot: Spot) -> Column:
        audio = self.kernel[1](field_of(values, "audio_data"), field_of(values, "sample_rate"), from_list=(0,))
        return F.zip_with(values, audio, lambda v, a: self._stored(v, a, spot))


class _Phase(RandomTransform):
    per_frequency: ClassVar[bool]
    kernel_result: ClassVar[bool] = True

    def _kernel(self, spot: Spot):
        o = self.defaults | spot.options
        return arrow.phase_kernel(float(o["amount"]), float(o.get("hop_factor", 0.5)), int(o.get("frame_length", 2048)), o.get("window", "hann"), self.per_frequency)

    def apply(self, value: Column, spot: Spot) -> Column:
        audio = self._kernel(spot)[0](value["audio_data"], spot.stream.prefix())
        return with_fields(value, spot.leaf.kind, audio_data=audio)

    def apply_list(self, values: Column, spot: Spot) -> Column:
        audio = self._kernel(spot)[1](field_of(values, "audio_data"), spot.stream.prefix())
        return F.zip_with(values, audio, lambda v, a: with_fields(v, spot.leaf.kind, audio_data=a))


class CorruptPhase(_Phase):
    """Turn the phase of every frequency of every channel by its own U(-pi amount, pi amount), the same at all times."""

    defaults: ClassVar = {"amount": 1.0, "hop_factor": 0.5, "frame_length": 2048, "window": "hann"}
    per_frequency: ClassVar[bool] = True


class ShiftPhase(_Phase):
    """Turn all phases of a channel by one U(-pi amount, pi amount).

    The frame (2048), hop (a half) and window (hann) are no options here; a subclass may set them.
    """

    defaults: ClassVar = {"amount": 1.0}
    frame_length: ClassVar[int] = 2048
    per_frequency: ClassVar[bool] = False

    def _kernel(self, spot: Spot):
        return arrow.phase_kernel(float(spot.options["amount"]), 0.5, self.frame_length, "hann", False)


class CodecEncode(MapTransform):
    """Tokens of every clip by a given NumPy function, into ``codes``; options, scope and coin don't apply.

    ``encode`` maps (channels x samples, rate) to channels x codebooks x steps.
    """

    kernel_result: ClassVar[bool] = True

    def __init__(self, encode: Callable[[np.ndarray, int], np.ndarray], n_codebooks: int):
        super().__init__()
        self.kernel, self.n_codebooks = arrow.codec_kernel(_counted(encode, n_codebooks)), n_codebooks

    def apply(self, value: Column, spot: Spot) -> Column:
        return with_fields(value, spot.leaf.kind, codes=self.kernel[0](value["audio_data"], value["sample_rate"]))

    def apply_list(self, values: Column, spot: Spot) -> Column:
        codes = self.kernel[1](field_of(values, "audio_data"), field_of(values, "sample_rate"), from_list=(0,))
        return F.zip_with(values, codes, lambda v, c: with_fields(v, spot.leaf.kind, codes=c))


def _counted(encode: Callable, n_codebooks: int) -> Callable:
    def run(audio: np.ndarray, rate: int) -> np.ndarray:
        tokens = np.asarray(encode(audio, rate))
        if tokens.ndim != 3 or tokens.shape[:2] != (len(audio), n_codebooks):
            raise ValueError(f"encode gave shape {tokens.shape}, not ({len(audio)}, {n_codebooks}, steps)")
        return tokens

    return run


class NumpyTransform(RandomTransform):
    """A transform whose body is NumPy, planned like the built-in ones: options, scope, coin, output keys and lists work alike.

    Subclasses write ``kernel(values, sample_rate, rng, **options)``, a static method. Of a clip it gets channels x samples and gives audio, which
    becomes the clip's ``audio_data`` (the loudness becomes unknown); with ``on_arrays`` bare arrays of numbers are leaves, too, whose rate is None.
    ``result`` declares another type, by its DDL: what the kernel gives then takes the leaf's place. ``rng`` is a NumPy generator of the record
    and leaf; with ``split_seed=False`` all leaves of a record get the same. Kernels run on whole Arrow batches of leaves, and only where the coin says so.
    """

    result: ClassVar[str | None] = None
    kernel_result: ClassVar[bool] = True

    @staticmethod
    def kernel(values: np.ndarray, sample_rate: int | None, rng: np.random.Generator, **options: Any) -> Any:
        raise NotImplementedError

    def _made(self, spot: Spot, bare: bool):
        kind = self.result or (spot.leaf.kind.simpleString() if bare else None)
        return arrow.user_kernel(type(self).kernel, kind, dict(spot.options), bare)

    def _stored(self, value: Column, made: Column, spot: Spot) -> Column:
        return made if self.result else with_fields(value, spot.leaf.kind, audio_data=made, loudness=F.lit(None).cast("double"))

    def apply(self, value: Column, spot: Spot) -> Column:
        if not is_clip(spot.leaf.kind):
            return self._made(spot, True)[0](value, spot.stream.prefix())
        return self._stored(value, self._made(spot, False)[0](value["audio_data"], value["sample_rate"], spot.stream.prefix()), spot)

    def apply_list(self, values: Column, spot: Spot) -> Column:
        made = self._made(spot, False)[1](field_of(values, "audio_data"), field_of(values, "sample_rate"), spot.stream.prefix(), from_list=(0,))
        return made if self.result else F.zip_with(values, made, lambda v, m: self._stored(v, m, spot))
