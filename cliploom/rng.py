"""Counter-based randomness: a number depends only on what it is for.

u = first 52 bits of md5("seed|record|transform|leaf|list index|purpose|i") / 2**52. The Spark column and
the Python function give the same numbers, and so does any SQL engine with md5; the results don't depend on
partitions, order or retries.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(1 << 52)
TINY = 2.0**-53


def uniform_key(*parts: object) -> float:
    """The uniform number in [0, 1) of these parts, joined by bars."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / SCALE


def uniform_column(key: Column) -> Column:
    """As :func:`uniform_key`, of a column that holds the joined parts."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(SCALE)


@dataclass(frozen=True)
class Stream:
    """The numbers of one transform at one leaf. ``record`` and ``index`` are columns."""

    seed: int
    record: Column
    transform: str
    leaf: str = ""
    index: Column | None = None

    def prefix(self) -> Column:
        index = self.index.cast("string") if self.index is not None else F.lit("")
        return F.concat_ws("|", F.lit(str(self.seed)), F.coalesce(self.record.cast("string"), F.lit("")), F.lit(self.transform), F.lit(self.leaf), index)

    def uniform(self, purpose: str, i: int | Column = 0) -> Column:
        i = F.lit(str(i)) if isinstance(i, int) else i.cast("string")
        return uniform_column(F.concat_ws("|", self.prefix(), F.lit(purpose), i))

    def between(self, low: float | Column, high: float | Column, purpose: str, i: int | Column = 0) -> Column:
        low, high = (F.lit(float(x)) if isinstance(x, (int, float)) else x for x in (low, high))
        return low + self.uniform(purpose, i) * (high - low)

    def shared(self) -> Stream:
        """The same numbers at all leaves."""
        return replace(self, leaf="", index=None)
