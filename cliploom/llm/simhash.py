"""SimHash fingerprints, linked by pigeonring filtering.

A fingerprint's 64 bits are cut into a ring of five segments. If two fingerprints differ in at most four bits, then from some
segment on every chain of l consecutive segments holds at most l * 4/5 of the differences, rounded down: none in the
first, one in the first two, two in three, three in four. So fingerprints that are equal in a segment meet in that segment's cell, and the
chains prune the pairs of a cell before the full count of differing bits.

There are 5 * 2**13 cells at most, whatever the input. First each cell is compared in chunks of bounded size, which
have some centres in common, so that even a cell of a third of all fingerprints falls into few classes. What is
left, in cells of several chunks, are fingerprints outside of the cell's largest class. These probe the
chain's second segment: keys of two segments (26 bits), one for each single bit that the second may differ in, join with the cell's
members under the chain conditions. A pair of a cell is therefore in one class already, or compared.

Equal fingerprints are one node, so copies cost a row of counting. A task emits a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, hot_keys, materialize, meet, narrow, partitions, ragged, worker
from .components import components

SHINGLE, SEED, BITS = 4, 42, 64
THRESHOLD, SEGMENTS = 4, 5
#: Members of a chunk of a cell, about, and centres that all its chunks share.
CHUNK, CENTERS = 1024, 4
#: Shingles counted at once, rows and pairs compared at once.
BLOCK, ROWS, PAIRS = 1 << 16, 1 << 16, 1 << 21
#: Keys of more than this share of the rows are hot.
SHARE = 4096


def fingerprint(text: bytes) -> int:
    """The SimHash of a text: bit i is set where over half of its shingles' hashes have it."""
    found = text.lower().split()  # of bytes: A-Z only, and at bytes 9 to 13 and 32
    if not found:
        return 0
    line = b" ".join(found)
    end = np.fromiter(accumulate((len(w) + 1 for w in found)), np.int64, len(found)) - 1
    begin = np.append(0, end[:-1] + 1)
    size = min(SHINGLE, len(found))
    begin, end = begin[: len(found) - size + 1], end[size - 1 :]
    count, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begin), BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(begin[at : at + BLOCK].tolist(), end[at : at + BLOCK].tolist(), strict=True)], U64)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(begin), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (id, fp) from rows (id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py() or b"") for t in texts], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], ["id", "fp"])

    return docs.mapInArrow(worker(run), "id long, fp long")


class Ring:
    """Segments of the bits, and for each start the chains' masks and budgets."""

    def __init__(self, segments: int, threshold: int):
        if not threshold < segments <= BITS:
            raise ValueError("there must be more segments than bits that may differ, and at most 64")
        edge = [-(-BITS * k // segments) for k in range(segments + 1)]
        self.low, self.width = edge[:-1], [b - a for a, b in zip(edge, edge[1:], strict=False)]
        own = [((1 << w) - 1) << a for a, w in zip(self.low, self.width, strict=True)]
        #: chains[i]: (mask, most differing bits) of the chains of two and more segments from i on.
        self.chains = [[(sum(own[(i + k) % segments] for k in range(n)), n * threshold // segments) for n in range(2, segments + 1)] for i in range(segments)]

    def segment(self, fp: Column, i: int) -> Column:
        return F.shiftrightunsigned(fp, self.low[i]).bitwiseAND((1 << self.width[i]) - 1).cast("int")

    def after(self, i: int) -> int:
        return (i + 1) % len(self.low)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least row of each class) after links between rows a and b."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (nearer := label[label]).tobytes() != label.tobytes():
            label = nearer


def linked(fp: np.ndarray, start: np.ndarray, group: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Row and least row of its class, for the rows of sorted groups that pairs within their groups link; start is each row's first segment."""
    n = len(fp)
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, n)
    later = ends[np.searchsorted(ends, np.arange(n), side="right")] - np.arange(n) - 1
    masks = [np.array([c[k][0] for c in ring.chains], U64) for k in range(len(ring.chains[0]))]
    budgets = [np.array([c[k][1] for c in ring.chains]) for k in range(len(ring.chains[0]))]
    label, upto, at = np.arange(n), np.cumsum(later), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - later[at] + PAIRS, side="right")))
        a = np.repeat(np.arange(at, to), later[at:to])
        b = ragged(np.arange(at, to) + 1, later[at:to])
        differ = fp[a] ^ fp[b]
        for mask, budget in zip(masks, budgets, strict=True):
            ok = np.bitwise_count(differ & mask[start[a]]) <= budget[start[a]]
            a, b, differ = a[ok], b[ok], differ[ok]
        label = _join(label, a, b)
        at = to
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _chunk_links(members: DataFrame, ring: Ring) -> DataFrame:
    """Links (a, b) that hold the classes of each chunk together, from rows (cell, chunk, fp)."""
    dealt = members.repartition(partitions(members.sparkSession), "cell", "chunk").sortWithinPartitions("cell", "chunk", "fp")

    def links(table: pa.Table) -> pa.RecordBatch:
        cell, chunk, fp = (table.column(c).to_numpy() for c in ("cell", "chunk", "fp"))
        group = np.cumsum(np.append(False, (np.diff(cell) != 0) | (np.diff(chunk) != 0)))
        row, least = linked(fp.view(U64), (cell >> 16).astype(np.int64), group, ring)
        return pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(fp[least])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                table = pa.Table.from_batches(held)
                cell, chunk = table.column("cell").to_numpy(), table.column("chunk").to_numpy()
                last = int(np.flatnonzero((cell != cell[-1]) | (chunk != chunk[-1])).max(initial=-1)) + 1  # the last group may go on
                held = table.slice(last).to_batches()
                if last:
                    yield links(table.slice(0, last).combine_chunks())
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(worker(run), "a long, b long").where("a <> b").distinct()


def _cells(nodes: DataFrame, ring: Ring) -> DataFrame:
    """Rows (cell, fp, rows): each fingerprint in the cells of all its segments."""
    fp = F.col("fp")
    cells = F.array(*[F.lit(i << 16).bitwiseOR(ring.segment(fp, i)) for i in range(len(ring.low))])
    return nodes.select(F.explode(cells).alias("cell"), "fp", "rows")


def _open_links(members: DataFrame, classes: DataFrame, ring: Ring) -> DataFrame:
    """Links between classes that pairs of a cell add, from rows (cell, fp) of the cells of several chunks."""
    named = members.join(classes.select(F.col("id").alias("fp"), "component"), "fp", "left").select("cell", "fp", F.coalesce("component", "fp").alias("class"))
    named = materialize(named, "members")
    counts = named.groupBy("cell", "class").agg(F.count("*").alias("n"))
    main = counts.groupBy("cell").agg(F.max(F.struct("n", "class")).alias("m")).select("cell", F.col("m.class").alias("main"))
    outside = named.join(F.broadcast(main), "cell").where(F.col("class") != F.col("main")).drop("main")
    fp, start = F.col("fp"), F.shiftright("cell", 16)
    pick = lambda make: F.element_at(F.array(*[make(i) for i in range(len(ring.low))]), start + 1)
    second = pick(lambda i: ring.segment(fp, ring.after(i)))
    flips = pick(lambda i: F.array(F.lit(0), *[F.lit(1 << j) for j in range(ring.width[ring.after(i)])]))
    index = named.select("cell", second.alias("second"), F.col("fp").alias("b"), F.col("class").alias("d"))
    probes = outside.select("cell", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(second))).alias("second"), F.col("fp").alias("a"), F.col("class").alias("c"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    ok = F.col("c") != F.col("d")
    for k in range(len(ring.chains[0])):
        mask = pick(lambda i, k=k: F.lit(_signed(ring.chains[i][k][0])))
        ok = ok & (F.bit_count(differ.bitwiseAND(mask)) <= pick(lambda i, k=k: F.lit(ring.chains[i][k][1])))
    return probes.join(index, ["cell", "second"]).where(ok).select(F.greatest("c", "d").alias("a"), F.least("c", "d").alias("b")).distinct()


def link(nodes: DataFrame, threshold: int = THRESHOLD, segments: int = SEGMENTS) -> DataFrame:
    """Rows (fp, class) for rows (fp, rows) of distinct fingerprints; the class is the least fingerprint that links reach."""
    ring = Ring(segments, threshold)
    members = _cells(nodes, ring)
    centers = F.array(F.max(F.struct("rows", "fp"))["fp"], *[F.min(F.struct(F.xxhash64("fp", F.lit(k)), "fp"))["fp"] for k in range(1, CENTERS)])
    # A row for each cell: at most segments * 2**(widest segment).
    sizes = materialize(members.groupBy("cell").agg(F.count("*").alias("size"), centers.alias("centers")).select("*", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "cells")
    own = members.join(F.broadcast(sizes.select("cell", "chunks")), "cell").select("cell", F.pmod(F.xxhash64("fp", "cell"), F.col("chunks")).cast("int").alias("chunk"), "fp")
    dealt = sizes.where("chunks > 1").select("cell", "centers", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    shared = dealt.select("cell", "chunk", F.explode("centers").alias("fp"))
    links = materialize(_chunk_links(own.unionByName(shared), ring), "links")
    classes = materialize(components(links), "classes")
    large = sizes.where("chunks > 1").select("cell")
    if not large.isEmpty():
        more = materialize(_open_links(members.join(F.broadcast(large), "cell").select("cell", "fp"), classes, ring), "links")
        if not more.isEmpty():
            classes = materialize(components(links.unionByName(more)), "classes")
    return nodes.join(classes.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("class"))


def near_copies(docs: DataFrame, threshold: int = THRESHOLD, segments: int = SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, fingerprint, component_id: one row for each row of docs.

    Words are runs of bytes other than space and control characters 9 to 13, A-Z lower-cased; shingles are
    four words. A text of fewer words has one shingle, of all its words; a text without words, and null, has fingerprint zero, which links like any other.
    Fingerprints link at ``threshold`` or fewer differing bits; ``component_id`` is the least id that links reach, null if none of these rows
    has an id. Rows that repeat, or share an id, get a row each, by their own text. An empty table gives an empty table.
    """
    source = narrow(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    each = materialize(fingerprints(source), "fingerprints")
    nodes = materialize(each.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "nodes")
    classes = materialize(link(nodes.select("fp", "rows"), threshold, segments), "linked")
    # Classes of many fingerprints, then fingerprints of many rows, go by broadcast of their few rows.
    placed = classes.join(nodes, "fp")
    least = materialize(placed.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("rows")), "least")
    placed = materialize(meet(placed, least.select("class", "component_id"), hot_keys(least, SHARE, "class"), "class").select("fp", "rows", "component_id"), "placed")
    met = meet(each, placed.select("fp", "component_id"), hot_keys(placed, SHARE, "fp"), "fp")
    return met.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
