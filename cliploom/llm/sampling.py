"""A bounded, even sample of labelled rows: of each class the rows of the least hashes.

The hash of a row's id and text orders the rows of its class. An approximate number of distinct
rows gives a bound that about twice as many hashes as wanted are under; only those, a few numbers each, are
ranked, so no task sees more than a small multiple of the sample. The sample has at most
so many distinct rows and bytes of a class, however many rows, copies or classes there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of texts of a class, and of one text, that a sample takes at most.
CLASS_BYTES, TEXT_BYTES = 32 << 20, 2 << 20
#: So many classes at most are broadcast; more are joined by a shuffle.
BROADCAST_CLASSES = 50_000


def place(id_col: str, text_col: str) -> Column:
    """The place of a row among its class: 63 even bits of its id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")), 1)


def small(classes: DataFrame) -> DataFrame:
    """A table of a row for each class, broadcast if there are few."""
    return F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes


def least(rows: DataFrame, per_class: int, class_bytes: int = CLASS_BYTES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """From rows (c, at, size) the sample's (c, at): the first places of each class, within the bounds.

    Rows of a null class, and of more than ``text_bytes`` bytes, don't count; rows of one place count once.
    """
    rows = rows.where(F.col("c").isNotNull() & (F.col("size") <= text_bytes))
    sizes = rows.groupBy("c").agg(F.approx_count_distinct("at", 0.02).alias("d"))
    under = F.when(F.col("d") <= 2 * per_class, F.lit((1 << 63) - 1)).otherwise((F.lit(2.0**63) * (2 * per_class) / F.col("d")).cast("long"))
    bounds = materialize(sizes.select("c", under.alias("under")), "bounds")
    near = rows.join(small(bounds), "c").where("at < under").groupBy("c", "at").agg(F.max("size").alias("size"))
    order = Window.partitionBy("c").orderBy("at")
    ranked = near.withColumn("r", F.row_number().over(order)).withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return materialize(ranked.where((F.col("r") <= per_class) & (F.col("sum") <= class_bytes)).select("c", "at"), "sample")
