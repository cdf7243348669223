"""Element-wise clip functions as Catalyst expressions; samples are computed in double and stored in float."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CODE_LENGTH = 256


def each_sample(audio: Column, f) -> Column:
    """Apply f to every sample (as double) of channels x samples."""
    return F.transform(audio, lambda ch: F.transform(ch, lambda x: f(x.cast("double")).cast("float")))


def each_scaled(audio: Column, number: Column, f) -> Column:
    """Apply f to every sample and a number of the row.

    The number is an argument of the array function, not part of its body, so it is computed once a row and may
    come from a kernel.
    """
    per_channel = F.array_repeat(number, F.size(audio))
    return F.zip_with(audio, per_channel, lambda ch, g: F.transform(ch, lambda x: f(x.cast("double"), g).cast("float")))


def db_to_linear(db: Column | float) -> Column:
    return F.pow(F.lit(10.0), (F.lit(db) if isinstance(db, (int, float)) else db) / F.lit(20.0))


def gain(audio: Column, db: Column) -> Column:
    return each_scaled(audio, db_to_linear(db), lambda x, g: x * g)


def peak(audio: Column) -> Column:
    """Largest magnitude over all channels and samples; NaN counts as largest; null without samples."""
    return F.array_max(F.transform(F.flatten(audio), lambda x: F.abs(x.cast("double"))))


def rescale(audio: Column) -> Column:
    """Divide by the peak where it is over 1."""
    top = F.coalesce(F.greatest(peak(audio), F.lit(1.0)), F.lit(1.0))
    return each_scaled(audio, top, lambda x, p: x / p)


def invert(audio: Column) -> Column:
    return each_sample(audio, lambda x: -x)


def swap_channels(audio: Column) -> Column:
    """Reverse the channels, however many."""
    return F.reverse(audio)


def to_mono(audio: Column) -> Column:
    """Mean over channels, as one channel. Channels are as long as the longest; what is missing is null."""
    first = F.transform(F.get(audio, 0), lambda x: x.cast("double"))
    rest = F.slice(audio, 2, F.greatest(F.size(audio) - 1, F.lit(0)))
    total = F.aggregate(rest, first, lambda acc, ch: F.zip_with(acc, ch, lambda a, b: a + b.cast("double")))
    n = F.size(audio).cast("double")
    return F.when(F.size(audio) > 0, F.array(F.transform(total, lambda x: (x / n).cast("float")))).otherwise(audio)


def pad(audio: Column, samples: Column | int, trim: bool = True) -> Column:
    """Zeros at the end up to ``samples``; longer channels are cut if ``trim``."""
    n = F.lit(samples) if isinstance(samples, int) else samples

    def one(ch: Column) -> Column:
        full = F.concat(ch, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(n - F.size(ch), F.lit(0)).cast("int")))
        return F.slice(full, F.lit(1), n.cast("int")) if trim else full

    return F.transform(audio, one)


def sample_count(duration: Column | float, sample_rate: Column | int) -> Column:
    """Number of samples of a duration; halves go to the even number."""
    d = F.lit(float(duration)) if isinstance(duration, (int, float)) else duration
    return F.rint(d * (F.lit(sample_rate) if isinstance(sample_rate, int) else sample_rate)).cast("int")


def excerpt(audio: Column, sample_rate: Column, offset: Column, duration: float) -> Column:
    """``duration`` seconds from ``offset`` (seconds), padded with zeros."""
    n = sample_count(duration, sample_rate)
    at = F.floor(offset * sample_rate).cast("int")
    return pad(F.transform(audio, lambda ch: F.slice(ch, at + 1, n)), n)


def from_array(values: Column, depth: int) -> Column:
    """channels x samples from a sample array (depth 1) or a channel array (depth 2)."""
    if depth not in (1, 2):
        raise ValueError("explode arrays of three levels into rows first (see operators.compose.ReduceBatch)")
    audio = F.array(values) if depth == 1 else values
    return audio.cast("array<array<float>>")


def sinc(x: Column) -> Column:
    """sin(x)/x, 1 at 0."""
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(x) / F.when(x == 0, F.lit(1.0)).otherwise(x))


def encode_path(text: Column, length: int = CODE_LENGTH) -> Column:
    """Code points of a string, filled with zeros to ``length``; longer strings stay whole."""
    codes = F.filter(F.transform(F.split(text, ""), lambda c: F.ascii(c)), lambda c: c > 0)
    return F.concat(codes, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(codes), F.lit(0))))


def decode_path(codes: Column) -> Column:
    """The string of non-zero code points."""
    units = F.transform(F.filter(codes, lambda c: c != 0), lambda c: F.lpad(F.hex(c.cast("bigint")), 8, "0"))
    return F.decode(F.unhex(F.concat_ws("", units)), "UTF-32")


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    """Whether a path ends in one of the extensions, whatever the case."""
    out = F.lit(False)
    for e in extensions:
        out = out | F.endswith(F.lower(path), F.lit(e.lower()))
    return out


def frames(samples: Column, frame: int, hop: int) -> Column:
    """All whole frames of a sample array, hop apart."""
    last = F.size(samples) - frame
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(hop)), lambda s: F.slice(samples, s + 1, frame))).otherwise(F.array().cast("array<array<float>>"))


#: SQL bodies of the element-wise functions, over ``array<array<float>>``. Numbers of a row are arguments, so that they are computed once.
SQL_FUNCTIONS = {
    "clip_gain": ("a array<array<float>>, db double", "array<array<float>>", "zip_with(a, array_repeat(pow(10.0D, db / 20.0D), size(a)), (c, g) -> transform(c, x -> cast(x * g as float)))"),
    "clip_invert": ("a array<array<float>>", "array<array<float>>", "transform(a, c -> transform(c, x -> cast(-x as float)))"),
    "clip_swap": ("a array<array<float>>", "array<array<float>>", "reverse(a)"),
    "clip_peak": ("a array<array<float>>", "double", "array_max(transform(flatten(a), x -> cast(abs(x) as double)))"),
    "clip_rescale": ("a array<array<float>>", "array<array<float>>", "zip_with(a, array_repeat(coalesce(greatest(array_max(transform(flatten(a), y -> cast(abs(y) as double))), 1.0D), 1.0D), size(a)), (c, p) -> transform(c, x -> cast(x / p as float)))"),
}


def register_sql(spark: SparkSession) -> list[str]:
    """Make the element-wise functions callable from SQL in this session; they are inlined, not UDFs."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)


#: Table functions for SQL, by name: their arguments, columns and bodies. In a body ``f.x`` is the argument x.
TABLE_FUNCTIONS = {
    "clip_frames": (
        "samples ARRAY<FLOAT>, width INT, hop INT",
        "frame INT, samples ARRAY<FLOAT>",
        "SELECT i, slice(clip_frames.samples, i * clip_frames.hop + 1, clip_frames.width) FROM (SELECT explode(if(size(clip_frames.samples) >= clip_frames.width,"
        " sequence(0, cast((size(clip_frames.samples) - clip_frames.width) div clip_frames.hop as int)), cast(array() as array<int>))) AS i)",
    ),
    "clip_tries": (
        "record_key STRING, total DOUBLE, duration DOUBLE, tries INT, seed INT",
        "attempt INT, offset DOUBLE",
        "SELECT i, greatest(clip_tries.total - clip_tries.duration, 0D) * cast(conv(substring(md5(concat_ws('|', cast(clip_tries.seed AS STRING), coalesce(clip_tries.record_key, ''), 'saliency', '', '', 'offset',"
        " cast(i AS STRING))), 1, 13), 16, 10) AS BIGINT) / 4503599627370496D FROM (SELECT explode(sequence(0, clip_tries.tries - 1)) AS i)",
    ),
    "clip_excerpts": (
        "samples ARRAY<FLOAT>, sample_rate INT, seconds DOUBLE",
        "start INT, samples ARRAY<FLOAT>",
        "SELECT i, slice(clip_excerpts.samples, i + 1, cast(round(clip_excerpts.seconds * clip_excerpts.sample_rate) as int)) FROM (SELECT explode(if(size(clip_excerpts.samples) > 0,"
        " sequence(0, size(clip_excerpts.samples) - 1, greatest(1, cast(round(clip_excerpts.seconds * clip_excerpts.sample_rate) as int))), cast(array() as array<int>))) AS i)",
    ),
}


def register_table_functions(spark: SparkSession) -> None:
    """Table functions for SQL text, as ``SELECT ... FROM clips, LATERAL clip_frames(samples, 512, 256)``. Spark inlines them, so they cost a Generate and no Python.

    clip_frames(samples, width, hop): frame, samples of whole frames. clip_tries(record_key, total, duration, tries, seed): attempt, offset (seconds) of
    a uniform search, as drawn by :func:`cliploom.plans.saliency.attempts`. clip_excerpts(samples, sample_rate, seconds): start, samples of pieces of so many seconds,
    the last one as long as it is.
    """
    for name, (arguments, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {body}")
