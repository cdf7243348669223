"""Exact removal of repeated byte strings by a distributed, hash-compared suffix sort.

Which suffixes meet: a string of ``length`` bytes has a minimiser, the least hashed gram
among its grams of ``GRAM`` bytes; equal strings have equal minimisers. Neighbouring
strings of a document that share a minimiser form a segment, and a segment travels to
the bucket of its minimiser, so all occurrences of a string meet in one bucket. Two
things keep that small: first only minimisers travel (5 bytes each), and only segments
whose minimiser occurs in a second document go on; and a pack of documents sends equal segments
once, with the least id. A minimiser of very many segments, such as that of a line which everyone copies, has them
cut into single strings, which are aggregated by their own bytes, within tasks first.

How they are found equal: in a bucket the suffixes of all distinct segments are
sorted. Runs of equal leading 16 bytes come from a key sort; within a run a merge sort
compares two suffixes by prefix polynomial hashes, finding their common extension by
binary search, in a logarithmic number of steps. Neighbours that agree over ``length`` are one
string; each such agreement is verified byte by byte, and a collision restarts the
sort with another base. The least id of each string goes back to the packs as one bit
for each suffix: does the string start in a document of a smaller id?

Packs are tables in the shared folder; every step reads them again from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, POWERS, U64, Powers, chunks, give_back, hot_keys, materialize, meet, mix, partitions, prefix_hash, ragged, worker

#: In grams of 16 bytes ever more strings of a growing corpus share their minimiser by chance alone.
LENGTH, GRAM = 50, 24
#: Text bytes of a pack (a longer document is a pack of its own), at least and at most, and of a bucket, on average.
PACK_BYTES, MOST_PACK_BYTES, BUCKET_BYTES, MOST_BUCKET_BYTES = 1 << 20, 4 << 20, 4 << 20, 16 << 20
#: From so many buckets on they grow, and packs with their number: a row goes from each pack to each bucket, and what
#: rows cost would grow with the square of the input. A row stands for about so many bytes of text.
MANY_BUCKETS, BYTES_A_ROW = 256, 3400
#: Text bytes of a task, which takes its buckets one after the other; packs whose minimisers meet in one group.
TASK_BYTES, GROUP_PACKS = 16 << 20, 50_000
#: Bytes of a bucket's segments that are sorted together. A bucket of more is sorted in up to 256 parts, by minimisers.
PART_BYTES = 1 << 20
#: A minimiser of more segments (equal ones of a pack count once) has them cut into single strings.
HOT_SEGMENTS = 20_000
#: A single string of more than this share of all packs' strings (and of over 400 packs) is hot.
HOT_STRINGS = 4096
#: Suffixes that are sorted together, and strings whose minimisers are found together.
SORT_BLOCK, WINDOWS = 400_000, 1 << 14
FP_BYTES, LOW = 5, 24  # of a minimiser's hash: its upper bytes travel, the lower bits choose the bucket


# ------------------------------------------------------------------------ packs
def make_packs(docs: DataFrame, pack_bytes: int) -> DataFrame:
    """Rows (pack, ids, sizes, z, nbytes): whole documents, in their order, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId() << 32
        for c in chunks(batches, "text", pack_bytes, 1 << 16):
            ids = np.array(c.batch.column("id").to_pylist(), np.int64)
            row = [pack, ids.tobytes(), np.diff(c.offsets).astype(np.int64).tobytes(), zstandard.compress(c.data.tobytes(), 1), len(c.data)]
            pack += 1
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["pack", "ids", "sizes", "z", "nbytes"])

    return docs.mapInArrow(worker(run), "pack long, ids binary, sizes binary, z binary, nbytes long")


@dataclass
class Pack:
    """A pack's documents and their segments, by place in ``data``."""

    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    start: np.ndarray  # of each segment, the first suffix
    count: np.ndarray  # how many suffixes
    doc: np.ndarray
    fp: np.ndarray  # hash of its minimiser
    content: np.ndarray  # hash of its bytes


@dataclass
class Segments:
    """The segments of a pack that travel: first suffix, number of suffixes, document and the hash that chooses the bucket."""

    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    fp: np.ndarray


def sizes_for(total: int, n_partitions: int) -> tuple[int, int, int]:
    """For so many bytes of text: the numbers of buckets and of their tasks, and the bytes of a pack."""
    n_buckets = max(min(n_partitions, MANY_BUCKETS), total // min(max(total // MANY_BUCKETS, BUCKET_BYTES), MOST_BUCKET_BYTES), 1)
    return n_buckets, max(n_partitions, total // TASK_BYTES), min(MOST_PACK_BYTES, max(PACK_BYTES, BYTES_A_ROW * n_buckets))


def open_pack(ids: bytes, sizes: bytes, z: bytes, length: int) -> Pack:
    data = np.frombuffer(zstandard.decompress(z) if z else b"", np.uint8)
    offsets = np.append(0, np.cumsum(np.frombuffer(sizes, np.int64)))
    return Pack(np.frombuffer(ids, np.int64), offsets, data, *segments(data, offsets, length))


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Start, number of suffixes, document, minimiser hash and content hash of all segments."""
    n, gram = len(data), min(GRAM, length)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U64), np.zeros(0, U64)
    h = prefix_hash(data)
    _, down = POWERS.upto(n + 1)
    place = least_grams(h, down, n - length + 1, gram, length)
    # A suffix counts if its string ends in its own document.
    room = np.maximum(np.diff(offsets) - length + 1, 0)
    last = offsets[:-1] + room
    fresh = np.append(True, place[1:] != place[:-1])
    fresh[offsets[:-1][room > 0]] = True
    start = np.flatnonzero(fresh)
    doc = np.searchsorted(offsets, start, side="right") - 1
    inside = start < last[doc]
    start, doc = start[inside], doc[inside]
    stop = np.minimum(np.append(start[1:], n), last[doc])
    content = mix((h[stop + length - 1] - h[start]) * down[start])
    return start, stop - start, doc, gram_hash(h, down, place[start], gram), content


def gram_hash(h: np.ndarray, down: np.ndarray, at: np.ndarray | slice, gram: int) -> np.ndarray:
    """Hashes of the grams at some places, or at a slice of them."""
    to = slice(at.start + gram, at.stop + gram) if isinstance(at, slice) else at + gram
    return mix((h[to] - h[at]) * down[at])


def least_grams(h: np.ndarray, down: np.ndarray, n: int, gram: int, length: int) -> np.ndarray:
    """Where the least hashed gram of each of the first n strings of ``length`` bytes begins; the leftmost of equal ones.

    Places are taken in blocks that stay in the processor's cache. Hashes lose as many bits in every pack, those that hold a
    place in a block, so equal strings have equal minimisers whatever they are packed with.
    """
    want = length - gram + 1
    bits = U64((WINDOWS + want).bit_length())
    low = (U64(1) << bits) - U64(1)
    local = np.arange(WINDOWS + want, dtype=U64)
    out = np.zeros(n, np.int64)
    for lo in range(0, n, WINDOWS):
        hi = min(lo + WINDOWS, n)
        least = gram_hash(h, down, slice(lo, hi + want - 1), gram)
        least &= ~low
        least |= local[: len(least)]
        have = 1
        while have * 2 <= want:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < want:
            least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
        np.add((least & low).view(np.int64), lo, out=out[lo:hi])
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return edge, np.append(edge[1:], len(x))[: len(edge)]


def bucket_of(fp: np.ndarray, n_buckets: int) -> np.ndarray:
    return (fp & U64((1 << LOW) - 1)).astype(np.int64) % n_buckets


def _rows(**columns) -> pa.RecordBatch:
    kinds = {"pack": pa.int64(), "bucket": pa.int64(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()], list(columns))


# ------------------------------------------------- first: which minimisers are shared
def distinct_fps(p: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pack's distinct minimisers, sorted, whether documents of two ids have them, and of how many segments."""
    order = np.argsort(p.fp)
    fp, ids = p.fp[order], p.ids[p.doc[order]]
    at, ends = runs(fp)
    if not len(at):
        return fp, np.zeros(0, bool), np.zeros(0, np.int64)
    kinds, several = np.ones(len(at), np.int64), np.flatnonzero(ends - at > 1)
    if len(several):  # most minimisers have one segment
        sizes = (ends - at)[several]
        content, group = p.content[order[ragged(at[several], sizes)]], np.repeat(several, sizes)
        by = np.lexsort((content, group))
        other = np.append(True, (np.diff(group) != 0) | (content[by][1:] != content[by][:-1]))
        kinds[several] = np.bincount(group, weights=other, minlength=len(at))[several]
    return fp[at], np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at), kinds


def _small_first(counts: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 and more as 255, and their own 4 bytes at the end."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u4").tobytes()


def _counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u4", offset=n) if len(raw) > n else []
    return out


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Row by row, so that only one pack at a time is a Python object."""
    columns = [batch.column(n) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def send_minimisers(packs: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Rows (bucket, pack, fps, many, kinds): a pack's minimisers of a bucket, 5 bytes each, in order, and what is known of them."""

    def run(batches):
        for batch in batches:
            for ids, sizes, z, pack in rows_of(batch, "ids", "sizes", "z", "pack"):
                fp, many, kinds = distinct_fps(open_pack(ids, sizes, z, length))
                b = bucket_of(fp, n_buckets)
                order = np.argsort(b, kind="stable")
                raw = (fp[order] >> U64(LOW)).view(np.uint8).reshape(-1, 8)[:, :FP_BYTES]
                many, kinds, b = many[order], kinds[order], b[order]
                at, ends = runs(b)
                yield _rows(
                    bucket=b[at], pack=[pack] * len(at), fps=[raw[i:j].tobytes() for i, j in zip(at.tolist(), ends.tolist(), strict=True)],
                    many=[np.packbits(many[i:j]).tobytes() for i, j in zip(at.tolist(), ends.tolist(), strict=True)],
                    kinds=[_small_first(kinds[i:j]) for i, j in zip(at.tolist(), ends.tolist(), strict=True)],
                )

    return packs.mapInArrow(worker(run), "bucket long, pack long, fps binary, many binary, kinds binary")


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers of some rows end to end, and the number of each row's."""
    sizes = np.array([len(x) // FP_BYTES for x in blobs], np.int64)
    fp = np.zeros((int(sizes.sum()), 8), np.uint8)
    fp[:, :FP_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, FP_BYTES)
    return fp.view(U64).ravel(), sizes


def _marks(flags: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    return [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]


def _answer(table: pa.Table, shared: np.ndarray, hot: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    out = _rows(pack=table.column("pack").to_pylist(), bucket=table.column("bucket").to_pylist(), bits=_marks(shared, sizes), hot=_marks(hot, sizes))
    return out.append_column("any", pa.array([bool(x.any()) for x in np.split(hot, np.cumsum(sizes)[:-1])]))


ANSWER = "pack long, bucket long, bits binary, hot binary, any boolean"


def shared_minimisers(sent: DataFrame, hot_segments: int, n_parts: int, n_groups: int) -> DataFrame:
    """Rows (pack, bucket, bits, hot, any): which of a pack's minimisers of a bucket a second document has, and which come in over ``hot_segments`` segments.

    The rows of a bucket are as many as there are packs. With ``n_groups`` groups of packs, each
    group's minimisers are made distinct first, a bucket's groups are joined next, and the outcome goes back to the rows.
    """

    def counted(table: pa.Table) -> tuple[np.ndarray, ...]:
        fp, sizes = _unpacked(table.column("fps").to_pylist())
        distinct, inverse, count = np.unique(fp, return_inverse=True, return_counts=True)
        many = np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(table.column("many").to_pylist(), sizes.tolist(), strict=True)]])
        kinds = np.concatenate([np.zeros(0, np.int64), *[_counts(c, n) for c, n in zip(table.column("kinds").to_pylist(), sizes.tolist(), strict=True)]])
        total = np.bincount(inverse, weights=kinds, minlength=len(distinct))
        return distinct, inverse, (count > 1) | (np.bincount(inverse, weights=many, minlength=len(distinct)) > 0), total, sizes

    def judge(table: pa.Table) -> pa.Table:
        _, inverse, shared, total, sizes = counted(table)
        return pa.Table.from_batches([_answer(table, shared[inverse], total[inverse] > hot_segments, sizes)])

    def combine(table: pa.Table) -> pa.Table:
        fp, _, shared, total, _ = counted(table)
        raw = fp.view(np.uint8).reshape(-1, 8)[:, :FP_BYTES].tobytes()
        return pa.Table.from_batches([_rows(bucket=[table.column("bucket")[0].as_py()], fps=[raw], many=[np.packbits(shared).tobytes()], kinds=[_small_first(np.minimum(total, hot_segments + 1).astype(np.int64))])])

    def decide(table: pa.Table) -> pa.Table:
        fp, _, shared, total, _ = counted(table)
        lists = [fp[x].view(np.uint8).reshape(-1, 8)[:, :FP_BYTES].tobytes() for x in (shared, total > hot_segments)]
        return pa.Table.from_batches([_rows(bucket=[table.column("bucket")[0].as_py()], shared=[lists[0]], busy=[lists[1]])])

    def mark(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                fp, sizes = _unpacked(row.column("fps").to_pylist())
                flags = [np.isin(fp, _unpacked(row.column(c).to_pylist())[0]) for c in ("shared", "busy")]
                yield _answer(row, *flags, sizes)

    if n_groups < 2:
        return sent.repartition(n_parts, "bucket").groupBy("bucket").applyInArrow(judge, ANSWER)
    sent = materialize(sent, "minimisers")
    grouped = sent.withColumn("group", F.pmod(F.xxhash64("pack"), F.lit(n_groups))).groupBy("bucket", "group").applyInArrow(combine, "bucket long, fps binary, many binary, kinds binary")
    decided = materialize(grouped.repartition(n_parts, "bucket").groupBy("bucket").applyInArrow(decide, "bucket long, shared binary, busy binary"), "decided")
    return sent.join(decided, "bucket").mapInArrow(worker(mark), ANSWER)


def candidates(p: Pack, answers: list[dict], length: int, n_buckets: int) -> tuple[Segments, np.ndarray, np.ndarray]:
    """The segments whose minimiser is shared; for those of hot minimisers instead the first bytes and documents of their single strings."""
    fp = np.unique(p.fp)
    b = bucket_of(fp, n_buckets)
    order = np.argsort(b, kind="stable")
    flags = {"bits": np.zeros(len(fp), bool), "hot": np.zeros(len(fp), bool)}
    buckets = np.array([a["bucket"] for a in answers], np.int64)
    low, high = np.searchsorted(b[order], buckets), np.searchsorted(b[order], buckets, side="right")
    for a, lo, hi in zip(answers, low.tolist(), high.tolist(), strict=True):
        for name, to in flags.items():
            to[order[lo:hi]] = np.unpackbits(np.frombuffer(a[name], np.uint8), count=hi - lo) > 0
    of = np.searchsorted(fp, p.fp)
    shared, hot = flags["bits"][of], flags["hot"][of]
    plain, busy = np.flatnonzero(shared & ~hot), np.flatnonzero(shared & hot)
    return Segments(p.start[plain], p.count[plain], p.doc[plain], p.fp[plain]), ragged(p.start[busy], p.count[busy]), np.repeat(p.doc[busy], p.count[busy])


class Strings:
    """The distinct strings at some places of a pack, in order of appearance: their bytes, least ids, and each place's string."""

    def __init__(self, p: Pack, start: np.ndarray, doc: np.ndarray, length: int):
        raw = p.data.tobytes()
        known: dict[bytes, int] = {}
        self.of = np.array([known.setdefault(raw[a : a + length], len(known)) for a in start.tolist()], np.int64)
        self.text = list(known)
        self.least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.of, p.ids[doc])


def send_strings(rows: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Rows (string, pack, k, least): the single strings of a pack's hot minimisers."""

    def run(batches):
        for batch in batches:
            for ids, sizes, z, pack, answers in rows_of(batch, "ids", "sizes", "z", "pack", "answers"):
                p = open_pack(ids, sizes, z, length)
                _, start, doc = candidates(p, answers, length, n_buckets)
                d = Strings(p, start, doc, length)
                n = len(d.text)
                for lo in range(0, n, 10_000):
                    part = d.text[lo : lo + 10_000]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([pack] * m, pa.int64()), pa.array(range(lo, lo + m), pa.int32()), pa.array(d.least[lo : lo + m])], ["string", "pack", "k", "least"])

    return rows.mapInArrow(worker(run), "string binary, pack long, k int, least long")


def judge_strings(sent: DataFrame) -> DataFrame:
    """Rows (pack, known): the numbers of a pack's single strings that start under a smaller id elsewhere.

    A string that very many packs have, such as a licence line, gets its least id by broadcast.
    """
    sent = materialize(sent, "strings")
    least = materialize(sent.groupBy("string").agg(F.min("least").alias("m"), F.max("least").alias("x"), F.count("*").alias("rows")).where("m < x").drop("x"), "least")
    return meet(sent, least.drop("rows"), hot_keys(least, HOT_STRINGS, "string"), "string", kind="binary").where("m < least").groupBy("pack").agg(F.collect_list("k").alias("known"))


class Distinct:
    """The distinct segments among a pack's candidates, by bucket in order of appearance."""

    def __init__(self, p: Pack, some: Segments, length: int, n_buckets: int):
        raw = p.data.tobytes()
        start, count = some.start, some.count
        ids = p.ids[some.doc]
        known: dict[bytes, int] = {}
        text = [raw[a:b] for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)]
        self.of = np.array([known.setdefault(t, len(known)) for t in text], np.int64)
        self.text = list(known)
        n = len(self.text)
        self.least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.of, ids)
        self.count = np.zeros(n, np.int64)
        self.count[self.of] = count
        bucket = np.zeros(n, np.int64)
        bucket[self.of] = bucket_of(some.fp, n_buckets)
        self.part = np.zeros(n, np.uint8)
        self.part[self.of] = (some.fp >> U64(LOW)).astype(np.uint8)  # bits that don't choose the bucket
        self.order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[self.order]
        self.at, self.ends = runs(sorted_)
        self.buckets = sorted_[self.at]


def send_segments(rows: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Rows (bucket, pack, sizes, least, part, z): a pack's distinct candidate segments of a bucket."""

    def run(batches):
        pressed = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for ids, sizes, z, pack, answers in rows_of(batch, "ids", "sizes", "z", "pack", "answers"):
                p = open_pack(ids, sizes, z, length)
                d = Distinct(p, candidates(p, answers, length, n_buckets)[0], length, n_buckets)
                groups = [d.order[a:b].tolist() for a, b in zip(d.at.tolist(), d.ends.tolist(), strict=True)]
                yield _rows(
                    bucket=d.buckets, pack=[pack] * len(groups), sizes=[np.array([len(d.text[k]) for k in g], np.int32).tobytes() for g in groups],
                    least=[d.least[g].tobytes() for g in groups], part=[d.part[g].tobytes() for g in groups], z=[pressed(b"".join([d.text[k] for k in g])) for g in groups],
                )

    return rows.mapInArrow(worker(run), "bucket long, pack long, sizes binary, least binary, part binary, z binary")


# ---------------------------------------------------------------- the suffix sort
class Collision(Exception):
    """Two different strings had one hash."""


def leading(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a big-endian number (zeros after the end)."""
    wide = np.append(data, np.zeros(8, np.uint8))
    out = np.zeros(len(data), U64)
    for i in range(8):
        out = (out << U64(8)) | wide[i : i + len(data)]
    return out


def common_extension(h: np.ndarray, down: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, up to ``length``, the suffixes at x and y share; by binary search over prefix hashes."""
    got = np.zeros(len(x), np.int64)
    step = 1 << (length.bit_length() - 1)
    while step:
        fits = got + step <= length
        a, b = x + got, y + got
        a, b = np.where(fits, a, x), np.where(fits, b, y)
        same = fits & ((h[a + step] - h[a]) * down[a] == (h[b + step] - h[b]) * down[b])
        got += np.where(same, step, 0)
        step >>= 1
    return got


def suffix_groups(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """For each place a number of its string of ``length`` bytes: equal numbers for equal strings.

    Suffixes are sorted in blocks of about SORT_BLOCK, by a hash of their leading bytes, so that memory
    is bounded and equal strings share a block; within a block numbers follow the strings' order.
    """
    rng = np.random.default_rng(1)
    base = BASE
    while True:
        try:
            return _suffix_groups(data, places, length, POWERS if base == BASE else Powers(base))
        except Collision:
            base = int(rng.integers(1 << 62)) * 2 + 1


def _suffix_groups(data, places, length, powers):
    out = np.zeros(len(places), np.int64)
    h = prefix_hash(data, powers)
    _, down = powers.upto(len(data) + 1)
    eight = leading(data)
    parts = -(-len(places) // SORT_BLOCK)
    if parts < 2 or length < 8:
        blocks = [np.arange(len(places))] if len(places) else []
    else:
        part = (mix(eight[places]) % U64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        blocks = np.split(order, np.cumsum(np.bincount(part, minlength=parts))[:-1])
    last = 0
    for block in blocks:
        if len(block):
            out[block] = _sorted_block(data, h, down, eight, places[block], length) + last
            last = int(out[block].max()) + 1
    return out


def _sorted_block(data, h, down, eight, places, length):
    """Numbers of the strings at some places, in the strings' order."""
    # Runs of equal leading bytes, then merge sort inside each run, all runs at once.
    keys = [np.minimum(places + at, len(data) - 1) for at in ((8, 0) if length >= 16 else ())]
    order = np.lexsort([eight[k] for k in keys]) if keys else np.arange(len(places))
    pos = places[order]
    new = np.zeros(len(pos), bool)
    new[:1] = True
    for k in keys:
        v = eight[k[order]]
        new[1:] |= v[1:] != v[:-1]
    edge = np.flatnonzero(new)
    sizes = np.diff(np.append(edge, len(pos)))
    whole = (h[pos + length] - h[pos]) * down[pos]
    width = 1
    largest = int(sizes.max(initial=0))
    while width < largest:
        some = sizes > width
        member = ragged(edge[some], sizes[some])
        begin, size = np.repeat(edge[some], sizes[some]), np.repeat(sizes[some], sizes[some])
        local = member - begin
        other = (local // width) ^ 1
        lo, hi = np.minimum(other * width, size), np.minimum(other * width + width, size)
        right = other * width < local  # equal suffixes of the left run come first
        rank_lo, rank_hi = lo.copy(), hi.copy()
        for _ in range(width.bit_length()):
            todo = np.flatnonzero(rank_lo < rank_hi)
            if not len(todo):
                break
            mid = (rank_lo[todo] + rank_hi[todo]) >> 1
            x, y = member[todo], begin[todo] + mid
            before = _less(data, h, down, pos, whole, y, x, right[todo], length)
            rank_lo[todo] = np.where(before, mid + 1, rank_lo[todo])
            rank_hi[todo] = np.where(before, rank_hi[todo], mid)
        # Its place: its own rank, the other run's smaller members, from the pair's start.
        pair = local // (2 * width) * (2 * width)
        target = begin + pair + (local - (local // width) * width) + (rank_lo - lo)
        pos[target], whole[target], order[target] = pos[member], whole[member], order[member]
        width *= 2
    same = np.append(False, whole[1:] == whole[:-1])
    a, b = pos[np.flatnonzero(same)], pos[np.flatnonzero(same) - 1]
    steps = [*range(0, length - 7, 8), length - 8] if length >= 8 else range(length)
    source = eight if length >= 8 else data
    for at in steps:
        if not np.array_equal(source[a + at], source[b + at]):
            raise Collision
    out = np.zeros(len(pos), np.int64)
    out[order] = np.cumsum(~same) - 1
    return out


def _less(data, h, down, pos, whole, y, x, or_equal, length) -> np.ndarray:
    """Whether suffix y goes before suffix x (or is equal, where that counts)."""
    out = or_equal.copy()
    differ = np.flatnonzero(whole[y] != whole[x])
    py, px = pos[y[differ]], pos[x[differ]]
    k = common_extension(h, down, py, px, length - 1)
    out[differ] = data[py + k] < data[px + k]
    return out


def start_elsewhere(raw: bytes, at: np.ndarray, size: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of some segments, whether its string starts in a segment of a smaller id."""
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)], np.int64)
    texts = list(known)
    lowest = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(lowest, number, least)
    sizes = np.array([len(t) for t in texts], np.int64)
    n = sizes - length + 1
    places, owner = ragged(np.cumsum(sizes) - sizes, n), np.repeat(np.arange(len(texts)), n)
    group = suffix_groups(np.frombuffer(b"".join(texts), np.uint8), places, length)
    best = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, group, lowest[owner])
    string = best[group]  # of each suffix of each distinct segment
    count = size - length + 1
    return string[ragged((np.cumsum(n) - n)[number], count)] < np.repeat(least, count)


def judge_segments(sent: DataFrame, length: int, n_parts: int) -> DataFrame:
    """Rows (pack, bucket, bits): for each suffix of a pack's segments, whether its string starts under a smaller id."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        opened = zstandard.ZstdDecompressor().decompress
        raw = b"".join([opened(z.as_py()) for z in table.column("z")])
        sizes = [np.frombuffer(x.as_py(), np.int32) for x in table.column("sizes")]
        size = np.concatenate(sizes).astype(np.int64)
        least = np.frombuffer(b"".join(table.column("least").to_pylist()), np.int64)
        part = np.frombuffer(b"".join(table.column("part").to_pylist()), np.uint8).astype(np.int16)
        at, count = np.cumsum(size) - size, size - length + 1
        first = np.cumsum(count) - count
        goes = np.zeros(int(count.sum()), bool)
        parts = min(-(-len(raw) // PART_BYTES), 256)
        for k in range(parts):
            own = np.flatnonzero(part % parts == k)
            if len(own):
                goes[ragged(first[own], count[own])] = start_elsewhere(raw, at[own], size[own], least[own], length)
        return pa.Table.from_batches([_rows(pack=table.column("pack").to_pylist(), bucket=table.column("bucket").to_pylist(), bits=_marks(goes, np.array([int(x.sum()) - len(x) * (length - 1) for x in sizes])))])

    return sent.repartition(n_parts, "bucket").groupBy("bucket").applyInArrow(run, "pack long, bucket long, bits binary")


# ------------------------------------------------------------------- what is removed
def removed_mask(p: Pack, answers: list[dict], verdicts: list[dict], known: list[int], length: int, n_buckets: int) -> np.ndarray:
    """Which bytes of a pack go."""
    some, start, doc = candidates(p, answers, length, n_buckets)
    d = Distinct(p, some, length, n_buckets)
    first = np.cumsum(d.count) - d.count
    bit = np.zeros(int(d.count.sum()), bool)
    place = {b: k for k, b in enumerate(d.buckets.tolist())}
    for v in verdicts:
        k = place[v["bucket"]]
        own = d.order[d.at[k] : d.ends[k]]
        bit[ragged(first[own], d.count[own])] = np.unpackbits(np.frombuffer(v["bits"], np.uint8), count=int(d.count[own].sum())) > 0
    count = some.count
    suffix = ragged(some.start, count)
    goes = bit[ragged(first[d.of], count)] | np.repeat(p.ids[some.doc] > d.least[d.of], count)
    gone = suffix[goes]
    if len(start):
        single = Strings(p, start, doc, length)
        elsewhere = np.zeros(len(single.text), bool)
        elsewhere[known] = True
        gone = np.append(gone, start[elsewhere[single.of] | (p.ids[doc] > single.least[single.of])])
    change = np.zeros(len(p.data) + 1, np.int64)
    np.add.at(change, gone, 1)
    np.add.at(change, gone + length, -1)
    return np.cumsum(change)[:-1] > 0


def apply_verdicts(rows: DataFrame, length: int, n_buckets: int, with_text: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for ids, sizes, z, answers, verdicts, known in rows_of(batch, "ids", "sizes", "z", "answers", "verdicts", "known"):
                p = open_pack(ids, sizes, z, length)
                gone = removed_mask(p, answers or [], verdicts or [], known or [], length, n_buckets)
                kept = p.data[~gone].tobytes()
                total = np.append(0, np.cumsum(gone))
                at = p.offsets - total[p.offsets]
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[p.offsets[:-1][np.diff(p.offsets) > 0]] |= gone[p.offsets[:-1][np.diff(p.offsets) > 0]]
                spans = np.append(0, np.cumsum(begins))
                texts = [kept[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                out = {
                    "id": pa.array(p.ids), "n_bytes": pa.array(np.diff(p.offsets)), "n_removed": pa.array(np.diff(total[p.offsets])), "n_spans": pa.array(np.diff(spans[p.offsets])),
                    "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                }
                if with_text:
                    out["kept"] = pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return rows.mapInArrow(worker(run), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, pack_bytes: int | None = None, hot_segments: int = HOT_SEGMENTS, group_packs: int = GROUP_PACKS
) -> DataFrame:
    """Returns id_col, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary): one row for each row of docs.

    A byte goes if a string of ``length`` bytes covers it that also starts in a document with a
    smaller id; all strings are judged on the input. Ids are integers; rows that share an
    id don't make each other's bytes go. A row without an id keeps all its bytes and makes
    none go. Null and empty texts have no bytes. Kept bytes need not be whole characters.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    total = source.where("id is not null").agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_buckets, n_parts, bytes_a_pack = sizes_for(total, partitions(spark))
    packs = materialize(make_packs(source.where("id is not null"), pack_bytes or bytes_a_pack), "packs")
    n_groups = -(-packs.count() // group_packs)
    gather = lambda rows, name: rows.groupBy("pack").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "pack"])).alias(name))
    found = shared_minimisers(send_minimisers(packs, length, n_buckets), hot_segments, n_parts, n_groups)
    answers = materialize(found.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits", "hot")).alias("answers"), F.max("any").alias("any")), "answers")
    verdicts = materialize(gather(judge_segments(send_segments(packs.join(answers, "pack"), length, n_buckets), length, n_parts), "verdicts"), "verdicts")
    known = materialize(judge_strings(send_strings(packs.join(answers.where("any"), "pack"), length, n_buckets)), "known")
    out = apply_verdicts(packs.join(answers.drop("any"), "pack", "left").join(verdicts, "pack", "left").join(known, "pack", "left"), length, n_buckets, with_text)
    text = F.coalesce(F.col("text"), F.lit(""))
    alone = source.where("id is null").select("id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *[F.encode(text, "UTF-8").alias("kept")] * with_text)
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH b AS (SELECT doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS h FROM documents),
pos AS (SELECT doc_id, unnest(generate_series(0, CAST(octet_length(raw) AS BIGINT) - 50)) AS i, h FROM b),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM pos),
least_ AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT w.doc_id, w.i FROM win w JOIN least_ l USING (s) WHERE l.m < w.doc_id),
cov AS (SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit),
isl AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM cov),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM isl GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM span),
agg AS (
  SELECT c.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(b.h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a) AS head, max(z) AS last
  FROM cut c JOIN b USING (doc_id) GROUP BY c.doc_id)
SELECT b.doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head || substr(h, CAST(2 * last + 1 AS BIGINT)), h))) AS kept_sha256
FROM b LEFT JOIN agg USING (doc_id)
"""
