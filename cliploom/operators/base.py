"""How a transform becomes columns.

A transform is planned once against ``df.schema``: for each leaf its path, options and
scope are resolved on the driver, and one expression per top-level column comes out. What a
transform does to a leaf is either a Catalyst expression or an Arrow kernel; kernels run as
Arrow UDFs on the leaf column, so Spark evaluates adjacent ones in one pass over Python.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Entries, flatten, in_scope, output_names, resolve
from ..rng import Stream
from ..schema import HELPER, Leaf, check_names, is_clip, is_number_array, leaves, tree_columns

Changed = dict[str, Column]
ONE = f"{HELPER}_one"


def apart(df: DataFrame) -> DataFrame:
    """Keep a projection with kernels from being merged into another one, or pushed below a union.

    Merged, a kernel would stand inside an array function in another kernel's argument, which Spark
    can't evaluate. Exploding an array of one element is a border that the optimizer leaves alone.
    """
    return df.select("*", F.explode(F.array(F.lit(1))).alias(ONE)).drop(ONE)


@dataclass
class Spot:
    """A leaf while its expression is built."""

    leaf: Leaf
    options: dict[str, Any]
    stream: Stream | None


class Transform:
    """Base of all transforms. Subclasses say what happens to a leaf.

    ``defaults`` names the options and their defaults. ``before`` runs on leaves in scope
    whatever the coin says; ``apply`` is the transform itself; both take the leaf's column and a
    Spot, and return a column, which may be of another type than the leaf. ``on_arrays`` makes bare number arrays leaves, besides clips; ``kernel_result`` says that Arrow
    kernels take part.
    """

    defaults: ClassVar[Mapping[str, Any]] = {}
    on_arrays: ClassVar[bool] = False
    random: ClassVar[bool] = False
    kernel_result: ClassVar[bool] = False
    _taken: Column | None = None

    def __init__(self, config: Mapping | None = None, scope: Mapping | None = None, output_key: str | Callable[[list[str]], str] | None = None, name: str | None = None):
        self.config, self.scope, self.output_key = flatten(config), flatten(scope), output_key
        self.name = name or type(self).__name__

    # ------------------------------------------------------------------- hooks
    def before(self, value: Column, spot: Spot) -> Column:
        return value

    def apply(self, value: Column, spot: Spot) -> Column:
        raise NotImplementedError

    def before_list(self, values: Column, spot: Spot) -> Column:
        """On an array of leaves; kernels override it, as UDFs can't run inside an expression over an array."""
        return F.transform(values, lambda v, i: self.before(v, self._at(spot, i)))

    def apply_list(self, values: Column, spot: Spot) -> Column:
        return F.transform(values, lambda v, i: self.apply(v, self._at(spot, i)))

    def _at(self, spot: Spot, index: Column) -> Spot:
        stream = spot.stream
        if stream is not None and stream.leaf:
            stream = Stream(stream.seed, stream.record, stream.transform, stream.leaf, index)
        return Spot(spot.leaf, spot.options, stream)

    def is_leaf(self, kind: T.DataType) -> bool:
        return is_clip(kind) or self.on_arrays and is_number_array(kind)

    # --------------------------------------------------------------------- plan
    def stream(self, path: tuple[str, ...]) -> Stream | None:
        return None

    def coin(self) -> Column | None:
        """Whether the transform applies to a record; None: always."""
        return None

    def changes(self, df: DataFrame, taken: Column | None = None) -> Changed:
        """New and replaced top-level columns, by name.

        Where ``taken`` isn't true nobody will look at them: kernels get null there, and so do nothing.
        """
        self._taken = taken if self.kernel_result else None
        check_names(T.StructType([f for f in df.schema.fields if f.name in tree_columns(df)]))
        fields = {f.name: f.dataType for f in df.schema.fields if f.name in tree_columns(df)}
        found = [x for name, kind in fields.items() for x in leaves(kind, self.is_leaf, (name,))]
        inside = [x for x in found if in_scope(self.scope, x.path)]
        names = self._output_names(inside, fields)
        out: Changed = {}
        for name, kind in fields.items():
            mine = {x.path for x in inside if x.path[0] == name}
            if not mine:
                continue
            col = F.col(f"`{name}`")
            if self.output_key is None:
                out[name] = self._rebuilt(col, kind, (name,), 0, mine, names)
                continue
            if (name,) in mine:  # a leaf (or list of leaves) at the root gets a sibling column
                if names[(name,)] is not None:
                    out[names[(name,)]] = self._new(col, kind, (name,), 0, gone=F.lit(None))
                continue
            out[name] = self._rebuilt(col, kind, (name,), 0, mine, names)
        return out

    def __call__(self, df: DataFrame) -> DataFrame:
        changed = self.changes(df)
        if not changed:
            return df
        return apart(apart(df).withColumns(changed)) if self.kernel_result else df.withColumns(changed)

    def _output_names(self, inside: list[Leaf], fields: Mapping[str, T.DataType]) -> dict:
        if self.output_key is None:
            return {}
        present: dict[tuple[str, ...], list[str]] = {(): list(fields)}

        def walk(kind: T.DataType, path: tuple[str, ...]) -> None:
            while isinstance(kind, T.ArrayType):
                kind = kind.elementType
            if isinstance(kind, T.StructType) and not self.is_leaf(kind):
                present[path] = list(kind.names)
                for f in kind.fields:
                    walk(f.dataType, (*path, f.name))

        for name, kind in fields.items():
            walk(kind, (name,))
        return output_names([x.path for x in inside], present, self.output_key)

    def _spot(self, path: tuple[str, ...], kind: T.DataType, lists: int) -> Spot:
        return Spot(Leaf(path, kind, lists), resolve(self.config, path, self.defaults), self.stream(path))

    def _new(self, col: Column, kind: T.DataType, path: tuple[str, ...], lists: int, gone: Column | None = None) -> Column:
        """The transformed leaf, or array of leaves. ``gone`` is what an idle coin leaves; None: the leaf itself."""
        coin = self.coin()
        if self.is_leaf(kind):
            spot = self._spot(path, kind, lists)
            before, apply = self.before, self.apply
        elif isinstance(kind, T.ArrayType) and self.is_leaf(kind.elementType):
            spot = self._spot(path, kind.elementType, lists + 1)
            before, apply = self.before_list, self.apply_list
        else:
            return F.transform(col, lambda v: self._new(v, kind.elementType, path, lists + 1, gone))
        # Kernels see null where neither the coin nor a choice will use what they give, and skip it.
        idle = before(col if self._taken is None else F.when(self._taken, col), spot)
        done = apply(F.when(coin, idle) if coin is not None and self.kernel_result else idle, spot)
        if coin is None:
            return done
        return F.when(coin, done).otherwise(idle if gone is None else gone)

    def _rebuilt(self, col: Column, kind: T.DataType, path: tuple[str, ...], lists: int, mine: set, names: dict) -> Column:
        if path in mine:
            return self._new(col, kind, path, lists)
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda v: self._rebuilt(v, kind.elementType, path, lists + 1, mine, names))
        if not isinstance(kind, T.StructType) or not any(p[: len(path)] == path for p in mine):
            return col
        fields, added = [], []
        for f in kind.fields:
            at, value = (*path, f.name), col[f.name]
            if at in mine and self.output_key is not None:
                fields.append(value.alias(f.name))
                if names[at] is not None:
                    added.append(self._new(value, f.dataType, at, lists, gone=F.lit(None)).alias(names[at]))
            else:
                fields.append(self._rebuilt(value, f.dataType, at, lists, mine, names).alias(f.name))
        return F.when(col.isNotNull(), F.struct(*fields, *added))


class MapTransform(Transform):
    """A deterministic transform."""


class RandomTransform(Transform):
    """A transform with a probability and random options.

    One coin is tossed for a whole record: per ``batch_id`` where the records have that column and
    ``coin_by`` names it, else per ``record_key``. With ``split_seed`` each leaf has its own random
    numbers, without it all leaves share them.
    """

    random: ClassVar[bool] = True

    def __init__(
        self, config: Mapping | None = None, split_seed: bool = True, prob: float = 1.0, scope: Mapping | None = None, output_key: str | Callable[[list[str]], str] | None = None,
        seed: int = 0, name: str | None = None, coin_by: str = "record_key",
    ):
        super().__init__(config, scope, output_key, name)
        if not 0 <= prob <= 1:
            raise ValueError("prob must lie between 0 and 1")
        if prob < 1 and output_key is not None:
            warnings.warn("with prob < 1 a sibling is null where the transform doesn't apply", stacklevel=2)
        self.split_seed, self.prob, self.seed, self.coin_by = split_seed, prob, seed, coin_by

    def stream(self, path: tuple[str, ...]) -> Stream:
        return Stream(self.seed, F.col("record_key"), self.name, "/".join(path) if self.split_seed else "")

    def coin(self) -> Column | None:
        if self.prob == 1:
            return None
        return Stream(self.seed, F.col(self.coin_by), self.name).uniform("prob") < self.prob


__all__ = ["Changed", "Entries", "MapTransform", "RandomTransform", "Spot", "Transform"]
