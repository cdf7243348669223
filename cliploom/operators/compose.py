"""Choosing among transforms, chains of them, and flattening of batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rng import TINY, Stream
from ..schema import HELPER, tree_columns
from .base import MapTransform, Transform, apart

CHOSEN = f"{HELPER}_chosen"
N, I, E = (f"{HELPER}_{c}" for c in "nie")


class LeafFunction(MapTransform):
    """A bare function of (leaf column, leaf's random stream) as a transform."""

    def __init__(self, function: Callable[[Column, Stream], Column], seed: int = 0, name: str | None = None):
        super().__init__(name=name or getattr(function, "__name__", "function"))
        self.function, self.seed = function, seed

    def stream(self, path: tuple[str, ...]) -> Stream:
        return Stream(self.seed, F.col("record_key"), self.name, "/".join(path))

    def apply(self, value: Column, spot) -> Column:
        return self.function(value, spot.stream)


class Choose:
    """Apply ``c`` different transforms to each record, drawn by weight, one after the other.

    Each record draws keys -ln(u)/weight and takes the c least, which is weighted drawing
    without replacement. Transforms of weight 0 are never drawn. Where a branch adds siblings,
    records that took another have null there. A branch may be a chain or another Choose: it then sees null for
    records that took another branch, and these get their tree back. So kernels run only on the records that took their branch.
    """

    def __init__(self, *transforms: Transform | Callable, c: int = 1, weights: Sequence[float] | None = None, prob: float = 1.0, seed: int = 0, name: str = "Choose"):
        weights = [1.0] * len(transforms) if weights is None else [float(w) for w in weights]
        if len(weights) != len(transforms):
            raise ValueError("there must be a weight for each transform")
        if not 0 <= prob <= 1:
            raise ValueError("prob must lie between 0 and 1")
        if min(weights, default=0) < 0:
            raise ValueError("weights can't be negative")
        self.drawn = [i for i, w in enumerate(weights) if w > 0]
        if c > len(self.drawn):
            raise ValueError("c is larger than the number of transforms that can be drawn")
        self.transforms = [t if isinstance(t, (Transform, Choose, Pipeline)) else LeafFunction(t, seed, f"{name}[{i}]") for i, t in enumerate(transforms)]
        self.c, self.weights, self.prob, self.seed, self.name = c, weights, prob, seed, name

    def chosen(self) -> Column:
        """Indices of the record's transforms in the order they apply; empty where the coin says no."""
        stream = Stream(self.seed, F.col("record_key"), self.name)
        keys = [F.struct((-F.ln(F.greatest(stream.uniform("choose", i), F.lit(TINY))) / F.lit(self.weights[i])).alias("k"), F.lit(i).alias("i")) for i in self.drawn]
        drawn = F.transform(F.slice(F.array_sort(F.array(*keys)), 1, self.c), lambda s: s["i"])
        if self.prob == 1:
            return drawn
        return F.when(stream.uniform("prob") < self.prob, drawn).otherwise(F.array().cast("array<int>"))

    def __call__(self, df: DataFrame) -> DataFrame:
        helper = f"{CHOSEN}_{len([c for c in df.columns if c.startswith(CHOSEN)])}_{self.name}"
        now = df.withColumn(helper, self.chosen())
        kernels = any(getattr(t, "kernel_result", False) for t in self.transforms)
        for stage in range(self.c):
            now = self._stage(apart(now) if kernels else now, F.get(F.col(f"`{helper}`"), stage), helper)
        return (apart(now) if kernels else now).drop(helper)

    def _stage(self, df: DataFrame, which: Column, helper: str) -> DataFrame:
        plain = df.drop(*[c for c in df.columns if c.startswith(HELPER)])
        whole = [i for i in self.drawn if not isinstance(self.transforms[i], Transform)]
        branches = {i: self.transforms[i].changes(plain, which == i) for i in self.drawn if i not in whole}
        kinds = {i: df.select(*[c.alias(n) for n, c in b.items()]).schema if b else T.StructType() for i, b in branches.items()}
        names = [f.name for f in plain.schema.fields] + [n for b in branches.values() for n in b]
        out = {}
        for name in dict.fromkeys(names):
            touched = [i for i, b in branches.items() if name in b]
            if not touched:
                continue
            own = plain.schema[name].dataType if name in plain.columns else None
            merged = own
            for i in touched:
                merged = _union(merged, kinds[i][name].dataType)
            value = _widened(F.col(f"`{name}`"), own, merged) if own is not None else F.lit(None).cast(merged)
            for i in touched:
                value = F.when(which == i, _widened(branches[i][name], kinds[i][name].dataType, merged)).otherwise(value)
            out[name] = value
        now = df.withColumns(out) if out else df
        for i in whole:
            now = self._gated(now, self.transforms[i], which == i, helper)
        return now

    @staticmethod
    def _gated(df: DataFrame, branch, taken: Column, helper: str) -> DataFrame:
        """A branch that is no single transform: its outcome where it was taken, else the tree as it was."""
        held, flag = f"{helper}_held", f"{helper}_taken"
        before = {c: df.schema[c].dataType for c in tree_columns(df)}
        ready = df.withColumn(flag, F.coalesce(taken, F.lit(False))).withColumn(held, F.struct(*[F.col(f"`{c}`") for c in before]))
        done = branch(ready.withColumns({c: F.when(F.col(f"`{flag}`"), F.col(f"`{c}`")) for c in before}))
        done = apart(done)
        out = {}
        for c in tree_columns(done):
            now, was = done.schema[c].dataType, before.get(c)
            merged = _union(was, now)
            old = F.lit(None).cast(merged) if was is None else _widened(F.col(f"`{held}`")[c], was, merged)
            out[c] = F.when(F.col(f"`{flag}`"), _widened(F.col(f"`{c}`"), now, merged)).otherwise(old)
        return done.withColumns(out).drop(held, flag)


def _union(a: T.DataType | None, b: T.DataType) -> T.DataType:
    """The type with the fields of both; fields that only one has are null in the other."""
    if a is None or a == b:
        return b
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_union(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = _union(fields.get(f.name), f.dataType)
        return T.StructType([T.StructField(n, k) for n, k in fields.items()])
    if type(a) is type(b):
        return a
    raise TypeError(f"branches give {a.simpleString()} and {b.simpleString()} for one key")


def _widened(col: Column, kind: T.DataType, to: T.DataType) -> Column:
    if isinstance(to, T.StructType):
        have = {f.name: f.dataType for f in kind.fields}
        fields = [(_widened(col[f.name], have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
        return F.when(col.isNotNull(), F.struct(*fields)) if kind.simpleString() != to.simpleString() else col
    if isinstance(to, T.ArrayType) and kind.simpleString() != to.simpleString():
        return F.transform(col, lambda v: _widened(v, kind.elementType, to.elementType))
    return col


class Pipeline:
    """Transforms one after the other. Kernels of neighbours share one pass over Python."""

    def __init__(self, *transforms: Transform | Choose | Pipeline | Callable):
        self.transforms = [t if isinstance(t, (Transform, Choose, Pipeline)) or not callable(t) or isinstance(t, ReduceBatch) else LeafFunction(t, name=f"Pipeline[{i}]") for i, t in enumerate(transforms)]

    def __call__(self, df: DataFrame) -> DataFrame:
        for t in self.transforms:
            df = t(df)
        return df


class ReduceBatch:
    """Rows of the elements of an outer batch: each tree column is an array, and every element becomes a record.

    The new record_key is outer * n + inner for batches of n. ``sample_rate`` is accepted and not used.
    """

    def __init__(self, sample_rate: int | None = None):
        self.sample_rate = sample_rate

    def __call__(self, df: DataFrame) -> DataFrame:
        tree = tree_columns(df)
        if not all(isinstance(df.schema[c].dataType, T.ArrayType) for c in tree):
            raise TypeError("every tree column must be an array of batch elements")
        kept = [c for c in df.columns if c not in tree]
        zipped = F.arrays_zip(*[F.col(f"`{c}`") for c in tree])
        rows = df.select(*kept, F.size(zipped).alias(N), F.posexplode(zipped).alias(I, E))
        out = rows.withColumn("record_key", F.col("record_key") * F.col(N) + F.col(I)) if "record_key" in kept else rows
        return out.select(*kept, *[F.col(E)[c].alias(c) for c in tree])


def batch(df: DataFrame, size: int) -> DataFrame:
    """The inverse: blocks of ``size`` consecutive record keys as one record of arrays, in key order.

    Blocks are bounded by size, so no group grows with the table.
    """
    tree = tree_columns(df)
    block = F.floor(F.col("record_key") / size).cast("bigint")
    each = F.struct("record_key", *tree)
    rows = df.groupBy(block.alias("record_key")).agg(F.array_sort(F.collect_list(each), _by_key).alias("__b"))
    return rows.select("record_key", *[F.col("__b")[c].alias(c) for c in tree])


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["record_key"] < b["record_key"], -1).when(a["record_key"] > b["record_key"], 1).otherwise(0)


__all__ = ["Choose", "LeafFunction", "Pipeline", "ReduceBatch", "batch"]
