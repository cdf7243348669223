"""What the operators share: shared-folder tables, hashing and word scans.

The word scan works on whole Arrow batches: it never makes a Python object per
word, so its cost is a few nanoseconds a byte.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Base of the polynomial hashes modulo 2**64; odd, so it has an inverse.
BASE = 0x9E6C63D0876A9A47
MASK = (1 << 64) - 1


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a local session has none (tests) a temporary folder is used. On a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cliploom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: its allocator is left alone
    _libc = None

_written: dict[str, DataFrame] = {}


def materialize(df: DataFrame, name: str, codec: str = "snappy", **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor
    without computing ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cliploom/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **options).parquet(path)
    _written[path] = out = spark.read.schema(df.schema).parquet(path)
    return out


def drop(table: DataFrame) -> None:
    """Empty a table that :func:`materialize` wrote, once nothing will read it again."""
    for path in [p for p, written in _written.items() if written is table]:
        del _written[path]
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def drop_materialized() -> None:
    """Empty all tables that :func:`materialize` wrote and nobody dropped."""
    for table in list(_written.values()):
        try:
            drop(table)
        except Exception:  # the session has ended: the folder goes with the cluster's clean-up
            return


atexit.register(drop_materialized)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def narrow(docs: DataFrame, *columns: str, **renamed: str) -> DataFrame:
    """Only the columns an operator needs, so that others never clash or move.

    ``renamed`` maps the name an operator uses to the caller's column name.
    """
    picked = [F.col(f"`{c}`") for c in columns]
    picked += [F.col(f"`{theirs}`").alias(ours) for ours, theirs in renamed.items()]
    return docs.select(*picked)


def carried(docs: DataFrame, text_col: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Whole rows as one column ``__row`` beside ``__text``, and what turns ``__row`` into the columns again.

    An operator takes ``__row`` for the id, so a filter on its result keeps or drops rows
    without a join, whatever the columns are called and however often an id occurs.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    names = list(docs.columns)
    return docs.select(row.alias("__row"), F.col(f"`{text_col}`").alias("__text")), lambda out: out.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)])


def worker(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back at its end.

    Python workers outlive their tasks; what their allocators keep would add up over stages.
    """

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send fewer rows to Python at once, unless the session says otherwise than Spark's default.

    Texts are long rows: at 10,000 a batch takes tens of MB, twice in the JVM and again in Python, for every task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def meet(rows: DataFrame, each: DataFrame, hot: list, key: str = "key", kind: str = "long", how: str = "inner") -> DataFrame:
    """Join rows (inner or left) with ``each``, a row for each key (of the type ``kind``). The rows of the ``hot`` keys, of which there must be few, stay where they are."""
    if not hot:
        return rows.join(each, key, how)
    named = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in hot], f"`{key}` {kind}"))
    rest = rows.join(named, key, "left_anti").join(each, key, how)
    return rest.unionByName(rows.join(named, key, "left_semi").join(F.broadcast(each.join(named, key, "left_semi")), key, how))


def hot_keys(sizes: DataFrame, share: int, key: str = "key", least: int = 400) -> list:
    """Keys of more than 1/``share`` of the rows, and of more than ``least``: at most ``share`` of them. ``sizes`` has a row (key, rows) for each."""
    limit = max(least, (sizes.agg(F.sum("rows")).first()[0] or 0) // share)
    return [r[0] for r in sizes.where(F.col("rows") > limit).select(key).collect()]


# ---------------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n + n // 8, 1 << 20)
            self.up, self.down = (self._table(b, n) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.ones(n, U64)
        done, step = 1, U64(base)
        power = base
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * U64(power)
            done, power = done + k, power * power & MASK
        return out


POWERS = Powers(BASE)


def prefix_hash(codes: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """``h`` with ``h[j] - h[i]`` = hash of codes[i:j] times ``base**i``."""
    up, _ = powers.upto(len(codes) + 1)
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


# ------------------------------------------------------------------------ texts
@dataclass
class Chunk:
    """Some whole documents: their ids and their UTF-8 bytes end to end."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20, max_docs: int = 4000) -> Iterator[Chunk]:
    """Whole documents in chunks of about ``max_bytes``; a longer one is a chunk of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        raw, at = text_buffers(batch.column(text))
        i = 0
        while i < n:
            j = int(np.searchsorted(at, at[i] + max_bytes, side="right")) - 1
            j = min(max(j, i + 1), n, i + max_docs)
            yield Chunk(batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j


def _word_codes() -> np.ndarray:
    """Byte -> lower-cased byte if it belongs to a word, else 0."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 0x41 <= b <= 0x5A else b
        if 0x30 <= low <= 0x39 or 0x61 <= low <= 0x7A or low >= 0x80:
            table[b] = low
    return table


WORD_CODES = _word_codes()
#: Places of a word that have a column of their own in the table of random numbers below.
PLACES = 64


def _word_table() -> np.ndarray:
    """A random number for each place and byte; 0 for the byte 0."""
    out = mix(mix(np.arange(PLACES * 256, dtype=np.int64).astype(U64) + U64(0x1F83D9ABFB41BD6B)))
    out[::256] = 0
    return out


_WORD_TABLE = _word_table()


@dataclass
class Words:
    """The words of a chunk, document after document.

    ``hash`` has 64 bits for each word; ``first[d]`` is the index of the first
    word of document d (one more entry ends the last). ``codes`` are the lower-cased bytes, 0 where
    there is no word; word i is ``codes[begin[i]:end[i]]``. Hashes only find candidates; what has to be equal is
    compared by :meth:`spelled` or by exact numbers (:func:`numbered`).
    """

    hash: np.ndarray
    first: np.ndarray
    codes: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def spelled(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where each begins (one more entry ends the last)."""
        used = self.codes != 0
        keep = used.copy()
        keep[1:] |= used[:-1]
        flat = self.codes[keep]
        flat[flat == 0] = 0x20
        return flat.tobytes(), np.append(0, np.cumsum(self.end - self.begin + 1))

    def as_array(self) -> pa.Array:
        """The words as an Arrow array."""
        used = self.codes[self.codes != 0]
        at = np.append(0, np.cumsum(self.end - self.begin)).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.begin), [None, pa.py_buffer(at), pa.py_buffer(used)])


def words(chunk: Chunk) -> Words:
    """Words are maximal runs of digits, letters a-z (A-Z lower-cased) and non-ASCII bytes."""
    n = len(chunk)
    lengths = np.diff(chunk.offsets)
    starts = chunk.offsets[:-1] + np.arange(n)  # a byte 0 follows each document
    codes = np.zeros(len(chunk.data) + n + 1, np.uint8)
    if n == 1:
        np.take(WORD_CODES, chunk.data, out=codes[: len(chunk.data)])
    else:
        mapped = WORD_CODES[chunk.data]
        at = chunk.offsets.tolist()
        for k, (to, size) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
            codes[to : to + size] = mapped[at[k] : at[k] + size]
    inside = (codes != 0).view(np.int8)
    edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
    begin, end = edge[0::2], edge[1::2]
    hashed = mix(_word_sums(codes, begin, end) + (end - begin).astype(U64))
    first = np.searchsorted(begin, np.append(starts, len(codes)))
    return Words(hashed, first, codes, begin, end)


def _word_sums(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word the sum of the random numbers of its (place, byte) pairs.

    Places beyond the table's get numbers of their own by mixing, so no place repeats another's.
    """
    if not len(begin):
        return np.zeros(0, U64)
    size = end - begin
    flat = codes[codes != 0]
    at = np.cumsum(size) - size
    place = np.arange(len(flat), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
    value = _WORD_TABLE[((place & (PLACES - 1)) << 8) | flat]
    if int(size.max()) > PLACES:
        far = np.flatnonzero(place >= PLACES)
        value[far] = mix(value[far] + (place[far] // PLACES).astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15))
    total = np.cumsum(value)
    return total[at + size - 1] - total[at] + value[at]


def numbered(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values, by an exact dictionary: values are compared, not only their hashes."""
    coded = values.dictionary_encode()
    parts = coded.chunks if isinstance(coded, pa.ChunkedArray) else [coded]
    return np.concatenate([np.zeros(0, np.int64), *[p.indices.to_numpy(zero_copy_only=False).astype(np.int64) for p in parts]])


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, at every position that has k words left."""
    if len(w) < k:
        return np.zeros(0, U64)
    out = np.zeros(len(w) - k + 1, U64)
    for i in range(k):
        out = out * U64(0xD1342543DE82EF95) + w[i : len(w) - k + 1 + i]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    out = np.arange(total)
    out += np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return out
