"""Compression of vectors into codes of a byte a part, by Exponion search.

Vectors are cut into equal parts; each part position has a codebook, fitted by rounds of nearest-entry
assignment and floored means. The search for a part x starts at its entry of the round before, a.
An entry c can be as near as a only if d(a, c) <= 2 d(x, a), by the triangle inequality; so of a's list of
entries, sorted by their distance from a, the beginning up to that radius is scanned, and no entry beyond
it can win or tie. Both sides are compared as squares of integers, so the bound is exact, too.

A round is one pass: each task writes its rows with their new entries, and at its end a row of sums for each part and entry,
into one table of the shared folder. Reading the sums touches their columns only. The codebooks
(parts * entries * width numbers, whatever the input) go through the driver; no vector does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, hot_keys, materialize, meet, worker
from .vectors import integers, kept, limbs_of, long_or_null, matrix, rebatched, split, squares, summed, total

PARTS, ENTRIES, ROUNDS, DIM = 4, 256, 4, 64
#: Rows that a task searches at once, and list entries scanned at once.
ROWS, STEP = 16_384, 32
#: A label of more than this share of the rows gets its sum by broadcast.
SHARE = 4096


class Book:
    """The entries of one part position, and for each entry all entries by their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = squares(entries, entries)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x, ties to the lower index, and its squared distance."""
        index, distance = start.copy(), np.zeros(len(x), x.dtype)
        by = np.argsort(start, kind="stable")
        edges = np.flatnonzero(np.diff(start[by], prepend=-1))
        for lo, hi in zip(edges, np.append(edges[1:], len(by)), strict=True):
            rows = by[lo:hi]
            a = int(start[rows[0]])
            best = squares(x[rows], self.entries[a : a + 1])[:, 0]
            reach = np.searchsorted(self.apart[a], 4 * best, side="right")
            order = np.argsort(-reach, kind="stable")  # rows of the widest reach first
            rows, best, reach = rows[order], best[order], reach[order]
            won = np.full(len(rows), a)
            for j in range(0, int(reach[0]), STEP):
                live = int(np.searchsorted(-reach, -j, side="left"))
                entries = np.sort(self.order[a, j : min(j + STEP, int(reach[0]))])  # argmin takes the first: the lowest index
                found = squares(x[rows[:live]], self.entries[entries])
                pick = found.argmin(axis=1)
                near, who = found[np.arange(live), pick], entries[pick]
                better = (near < best[:live]) | (near == best[:live]) & (who < won[:live])
                best[:live][better], won[:live][better] = near[better], who[better]
            index[rows], distance[rows] = won, best
        return index, distance


def _search(tables: Iterator[pa.Table], books: list[Book], dim: int, wide: bool):
    """For each table: its integers, and the entries and distances of its parts."""
    width = dim // len(books)
    for t in tables:
        x = integers(t.column("v").combine_chunks(), dim, wide)
        codes = t.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(x), len(books))
        pairs = [book.nearest(x[:, p * width : (p + 1) * width], codes[:, p]) for p, book in enumerate(books)]
        yield t, x, np.stack([i for i, _ in pairs], axis=1), [d for _, d in pairs]


def _round(state: DataFrame, books: list[Book], dim: int, limbs: int) -> DataFrame:
    """The rows with their new entries, and each task's sums."""
    k, width, wide = len(books[0].entries), dim // len(books), limbs > 1
    schema = f"row struct<id:long,label:string>, v {dict(state.dtypes)['v']}, codes array<int>, part int, entry int, n long, s array<array<long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(books), k), np.int64)
        sums = np.zeros((len(books), k, width), object if wide else np.int64)
        target = None
        for t, x, codes, _ in _search(rebatched(batches, ROWS), books, dim, wide):
            for p in range(len(books)):
                count[p] += np.bincount(codes[:, p], minlength=k)
                by = np.argsort(codes[:, p], kind="stable")
                at = np.flatnonzero(np.diff(codes[by, p], prepend=-1))
                sums[p][codes[by[at], p]] += np.add.reduceat(x[by, p * width : (p + 1) * width], at, axis=0)
            target = t.schema
            new = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * len(books)), pa.array(codes.ravel(), pa.int32()))
            yield from t.set_column(t.schema.get_field_index("codes"), target.field("codes"), new.cast(target.field("codes").type)).to_batches()
        if target is not None:
            p, e = np.nonzero(count)
            made = {"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e]), "s": pa.array([split(sums[i, j], limbs) for i, j in zip(p, e, strict=True)], pa.list_(pa.list_(pa.int64())))}
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(len(p), f.type) for f in target], schema=target)

    return state.where("part is null").mapInArrow(worker(run), schema)


def _final(state: DataFrame, books: list[Book], dim: int, limbs: int) -> DataFrame:
    """Rows (row, code, error): hex codes, and squared distances summed over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, codes, distances in _search(rebatched(batches, ROWS), books, dim, limbs > 1):
            hexes = [bytes(c).hex() for c in codes.astype(np.uint8)]
            row = t.column("row").combine_chunks()
            yield pa.RecordBatch.from_arrays([row, pa.array(hexes), long_or_null(sum(distances))], ["row", "code", "error"])

    return state.where("part is null").select("row", "v", "codes").mapInArrow(worker(run), "row struct<id:long,label:string>, code string, error long")


def digest(books: list[Book]) -> str:
    return hashlib.sha256(",".join(str(int(n)) for b in books for n in b.entries.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dim: int = DIM,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Returns id_col, code, error, label_error, codebooks_sha256 for each row that is kept.

    Kept are vectors of ``dim`` components, none null or not finite. A codebook starts as that part of the first
    ``entries`` rows (at most 256, as a code has a byte for each part) by id, nulls last, rows of one id by their vectors; equal entries may occur, of which the lowest index wins.
    With fewer rows the codebooks are shorter. An entry that no part took stays as it is. Rows that repeat are coded one by one. ``label_error`` is summed over
    equal labels, nulls together. Components may have any finite size; an error or sum beyond long is null.
    A table without a kept row gives an empty table.
    """
    if not 1 <= entries <= 256 or dim % parts:
        raise ValueError("there can be 1 to 256 entries, and parts must divide the components")
    spark = vectors.sparkSession
    picked = vectors.where(kept(vectors, vector_col, dim))
    rows = picked.select(F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label")).alias("row"), F.col(f"`{vector_col}`").alias("v"))
    limbs, width = limbs_of(rows), dim // parts
    first = [r.v for r in rows.orderBy(F.col("row.id").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return spark.createDataFrame([], "row struct<id:long,label:string>, code string, error long, label_error long, codebooks_sha256 string").select(
            F.col("row.id").alias(id_col), "code", "error", "label_error", "codebooks_sha256"
        )
    whole = integers(pa.array(first, pa.list_(pa.float64())), dim, limbs > 1)
    books = [Book(whole[:, p * width : (p + 1) * width]) for p in range(parts)]
    none = {"part": "int", "entry": "int", "n": "long", "s": "array<array<long>>"}
    state = rows.withColumn("codes", F.array_repeat(F.lit(0), parts)).select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    for number in range(rounds):
        before, state = state, materialize(_round(state, books, dim, limbs), "codes")
        if number:
            drop(before)
        means = summed(state.where("part is not null"), ["part", "entry"], width, limbs)
        lists = [[[s // means[p, e][0] for s in means[p, e][1]] if (p, e) in means else list(book.entries[e]) for e in range(len(first))] for p, book in enumerate(books)]
        books = [Book(matrix(part, width, limbs > 1)) for part in lists]
    coded = materialize(_final(state, books, dim, limbs), "coded")
    if rounds:
        drop(state)
    return _with_sums(coded, id_col).withColumn("codebooks_sha256", F.lit(digest(books)))


def _with_sums(coded: DataFrame, id_col: str) -> DataFrame:
    """Add the error of each row's label. Labels of many rows get it by broadcast, others meet it by a shuffle."""
    # A text that is null for no label and the same for equal labels only.
    name = F.coalesce(F.concat(F.lit("="), F.col("row.label")), F.lit(""))
    rows = coded.withColumn("key", name)
    sums = materialize(rows.groupBy("key").agg(total("error").alias("label_error"), F.count("*").alias("rows")), "labels")
    hot = hot_keys(sums, SHARE)
    return meet(rows, sums.select("key", "label_error"), hot, kind="string").select(F.col("row.id").alias(id_col), "code", "error", "label_error")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
