"""The row type of a clip, and the walk over nested records.

A clip is a struct; a record is a row whose columns nest clips in structs and arrays.
The walk happens once, on the driver, over ``df.schema``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIO = T.ArrayType(T.ArrayType(T.FloatType()))
METADATA = T.StructType([T.StructField("filepath", T.StringType()), T.StructField("offset", T.DoubleType()), T.StructField("duration", T.DoubleType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])
CLIP = T.StructType(
    [
        T.StructField("audio_data", AUDIO),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("loudness", T.DoubleType()),
        T.StructField("pitch", T.DoubleType()),
        T.StructField("velocity", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("codes", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("metadata", METADATA),
    ]
)
#: Columns of a record that are no part of its tree.
KEYS = ("record_key", "batch_id")


def is_clip(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {"audio_data", "sample_rate"} <= set(kind.names)


def is_number_array(kind: T.DataType) -> bool:
    """A bare array leaf: numbers, in one or more array levels."""
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
        if isinstance(kind, T.NumericType):
            return True
    return False


def clip(audio: Column, sample_rate: Column | int, **fields: Column) -> Column:
    """A clip struct; fields that aren't given are null."""
    values = {"audio_data": audio, "sample_rate": F.lit(sample_rate) if isinstance(sample_rate, int) else sample_rate} | fields
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CLIP.fields])


def with_fields(value: Column, kind: T.StructType, **new: Column) -> Column:
    """The clip with some fields replaced; a null clip stays null."""
    fields = [new[f.name].alias(f.name) if f.name in new else value[f.name].alias(f.name) for f in kind.fields]
    return F.when(value.isNotNull(), F.struct(*fields))


@dataclass(frozen=True)
class Leaf:
    """Where a leaf lies: struct keys from the root, and how many array levels are above it."""

    path: tuple[str, ...]
    kind: T.DataType
    lists: int = 0


def check_names(kind: T.StructType, path: tuple[str, ...] = ()) -> None:
    """Sibling names must differ even where case doesn't count, or Spark can't tell them apart."""
    low = [n.lower() for n in kind.names]
    for name in kind.names:
        if low.count(name.lower()) > 1:
            raise ValueError(f"sibling keys under {'/'.join(path) or 'the root'} differ only in case: {name}")
    for f in kind.fields:
        below = f.dataType
        while isinstance(below, T.ArrayType):
            below = below.elementType
        if isinstance(below, T.StructType) and not is_clip(below):
            check_names(below, (*path, f.name))


#: Names that begin so are helpers of this package, no part of the tree either.
HELPER = "__cliploom"


def tree_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS and not c.startswith(HELPER)]


def leaves(kind: T.DataType, is_leaf: Callable[[T.DataType], bool], path: tuple[str, ...] = (), lists: int = 0) -> list[Leaf]:
    """All leaves below a type, in schema order. What is neither a leaf nor contains one is left alone."""
    if is_leaf(kind):
        return [Leaf(path, kind, lists)]
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in leaves(f.dataType, is_leaf, (*path, f.name), lists)]
    if isinstance(kind, T.ArrayType):
        return leaves(kind.elementType, is_leaf, path, lists + 1)
    return []
