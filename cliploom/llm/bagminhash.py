"""Near duplicates by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its five-word shingles. Each shingle owns Poisson
processes over its weight axis, which is cut at the powers of two: (0,1], (1,2],
(2,4], ... A process has the width of its interval as its rate; a point carries a
register and a leaf (the unit cell of the interval it falls into), found by going
down the interval's binary tree with hashed bits. A shingle that occurs c times
keeps the points whose leaf is at most c. A register's value is the least point
that reached it, so two texts agree in a register with a probability equal to their
weighted Jaccard similarity. Points come in ascending order, and a process ends
at the first beyond the text's largest register, so a text of n shingles takes
about n + m log m points for m registers.

Texts that agree in a band of registers are candidates. A band's bucket is split by
length, and all its members are compared with one centre, by exact multiset overlap; members that no link puts into its class
are compared with the members of other classes (see :func:`classify`): all of them in a bucket of bounded size, by matrix products; in a larger one those that share
a rare shingle. For there the texts are ordered by how rare their shingles are, and pairs can only be alike if a
shingle among the first fifth of the longer text is among the first ninth of the shorter (at 0.8), with enough shingles behind it in both. So texts
that have a template in common, but not enough to be alike, don't meet: their own shingles come first.

Hashes choose candidates only. What is compared are exact numbers: words are numbered by an
exact dictionary, then pairs of numbers, up to five words. Equal texts are found by a 256-bit digest of their words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Chunk, Words, chunks, grams, hot_keys, materialize, meet, mix, narrow, numbered, partitions, ragged, words, worker
from .components import HUB, SHARE, components

SHINGLE, THRESHOLD = 5, 0.8
#: 26 bands of 5: texts of similarity 0.8 share a band but for 3 pairs in 100,000.
BANDS, ROWS = 26, 5
#: Members and shingles of a small bucket at most; members of a centre that are compared at once, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Compressed bytes of texts that are compared with their centre at once, about.
SLICE_BYTES = 1 << 19
GOLD = 0x9E3779B97F4A7C15


def shingles(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words]:
    """Document, hashed shingle (52 bits) and count of each distinct shingle of a chunk; shingles per document; words.

    A text of fewer than five words, but not none, has one shingle: all its words.
    """
    w = words(c)
    n = np.diff(w.first)
    g = grams(w.hash, SHINGLE)
    own = np.maximum(n - SHINGLE + 1, 0)
    doc_at = np.repeat(np.arange(len(n)), n)[: len(g)]
    # Positions whose five words lie in one document.
    ok = np.arange(len(g)) + SHINGLE <= w.first[1:][doc_at]
    keys = [(doc_at[ok].astype(U64) << U64(52)) | (g[ok] >> U64(12))]
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
        part = grams(w.hash[w.first[d] : w.first[d + 1]], int(n[d]))
        keys.append((U64(d) << U64(52)) | (part >> U64(12)))
        own[d] = 1
    key = np.sort(np.concatenate(keys))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> U64(52)).astype(np.int64), key & U64((1 << 52) - 1), count, own, w


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash registers, n_docs x m; infinite for documents without shingles."""
    registers = np.full(n_docs * m, np.inf)
    # One process for each interval (2**(k-1), 2**k] of the weight axis that count reaches into.
    top = np.ceil(np.log2(count)).astype(np.int64) if len(count) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(count)), top + 1)
    level = np.arange(len(which)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low)
    room = np.minimum(count[which] - low, width)  # leaves of the interval that belong to the text
    doc, x = doc[which], np.zeros(len(which))
    seed = mix(shingle[which] * U64(GOLD) + level.astype(U64))
    limit = np.full(n_docs, np.inf)
    t = 0
    while len(doc):
        j = 1 if len(doc) > 4000 else min(64, max(2, 8000 // len(doc)))
        steps = (np.arange(t, t + j, dtype=np.int64).astype(U64) + U64(1)) * U64(GOLD)
        r = mix(seed[:, None] + steps[None, :])
        gap = -np.log(((r >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / width[:, None]
        points = x[:, None] + np.cumsum(gap, axis=1)
        r = mix(r ^ U64(0x5851F42D4C957F2D))
        register = ((r >> U64(32)) * U64(m)) >> U64(32)
        leaf = ((r & U64(0xFFFFFFFF)) * width.astype(U64)[:, None]) >> U64(32)
        good = (leaf < room.astype(U64)[:, None]) & (points < limit[doc][:, None])
        np.minimum.at(registers, ((doc * m)[:, None] + register.astype(np.int64))[good], points[good])
        x, t = points[:, -1], t + j
        limit = registers.reshape(n_docs, m).max(axis=1)
        go = x < limit[doc]
        doc, x, seed, width, room = doc[go], x[go], seed[go], width[go], room[go]
    return registers.reshape(n_docs, m)


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = registers[:, : bands * rows].copy().view(U64).reshape(len(registers), bands, rows)
    out = np.arange(bands, dtype=np.int64).astype(U64)[None, :] * U64(GOLD) * np.ones((len(registers), 1), U64)
    for i in range(rows):
        out = mix(out * U64(0xD1342543DE82EF95) + bits[:, :, i])
    return out.view(np.int64)


def text_keys(c: Chunk, w: Words) -> list[bytes]:
    """256-bit digests of the words of each text; of the bytes of a text without words."""
    flat, at = w.spelled()
    edge = at[w.first].tolist()
    out = []
    for d, (x, y) in enumerate(zip(edge, edge[1:], strict=False)):
        plain = flat[x:y] if y > x else c.data[c.offsets[d] : c.offsets[d + 1]].tobytes()
        out.append(hashlib.blake2b(plain, digest_size=32, person=b"words" if y > x else b"nowords").digest())
    return out


def sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Rows (id, sha, key, n, bands, z): text digest, number of shingles, band hashes (none without shingles), the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for c in chunks(batches, "text"):
            doc, shingle, count, own, w = shingles(c)
            found = band_hashes(signatures(doc, shingle, count, len(c), bands * rows), bands, rows)
            offsets = np.append(0, np.cumsum(np.where(own > 0, bands, 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[own > 0].ravel()))
            raw, at = c.data.tobytes(), c.offsets.tolist()
            z = [press.compress(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
            out = {"id": c.batch.column("id"), "sha": c.batch.column("sha"), "key": pa.array(text_keys(c, w), pa.binary()), "n": pa.array(own, pa.int64()), "bands": lists, "z": pa.array(z, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return docs.mapInArrow(worker(run), "id long, sha string, key binary, n long, bands array<long>, z binary")


def exact_bags(packed: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingle multisets (sorted numbers, counts) of compressed texts; equal numbers, within one call, for equal shingles only."""
    plain = zstandard.ZstdDecompressor()
    batch = pa.RecordBatch.from_arrays([pa.array([plain.decompress(z) for z in packed], pa.large_binary())], ["text"])
    arrays, sizes = [], []
    for c in chunks(iter([batch]), "text"):
        w = words(c)
        arrays.append(w.as_array())
        sizes.append(np.diff(w.first))
    size = np.concatenate(sizes)
    word = numbered(pa.chunked_array(arrays))
    # A text of fewer than five words is filled up with a number that no word has.
    room = np.where(size > 0, np.maximum(size, SHINGLE), 0)
    line = np.zeros(int(room.sum()), np.int64)
    line[ragged(np.cumsum(room) - room, size)] = word + 1
    gram = line
    for i in range(1, SHINGLE):
        gram = numbered(pa.array((gram[:-1] << 32) | line[i : i + len(gram) - 1])) if len(gram) else gram
    own = np.maximum(room - SHINGLE + 1, 0)
    key = np.repeat(np.arange(len(size)) << 32, own) | gram[ragged(np.cumsum(room) - room, own)]
    key, count = np.unique(key, return_counts=True)
    edge = np.searchsorted(key >> 32, np.arange(len(size) + 1))
    key &= (1 << 32) - 1
    return [(key[a:b], count[a:b]) for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted values, counts)."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return both / (total - both)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (center, member) whose multisets overlap by the threshold at least.

    A centre's members are dealt out in blocks, and its text goes once to each block, so a
    centre of very many members is neither one task nor copied to each of them.
    """
    sizes = materialize(pairs.groupBy("center").agg(F.count("*").alias("rows")), "sizes")
    blocks = sizes.select("center", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    spot = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    members = meet(pairs, blocks, hot_keys(sizes, SHARE, "center"), "center").select("center", spot.alias("block"), F.lit(False).alias("head"), F.col("member").alias("id"))
    heads = blocks.select("center", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("head"), F.col("center").alias("id"))
    both = members.unionByName(heads).join(texts, "id").select("center", "block", "head", "id", "z")
    dealt = both.repartition(partitions(pairs.sparkSession), "center", "block").sortWithinPartitions("center", "block", F.desc("head"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list[bytes] = []  # the centre's text
        for batch in batches:
            heads, centers, ids = (batch.column(c).to_pylist() for c in ("head", "center", "id"))
            at = 0
            while at < len(heads):
                packed, of, member = list(current), [], []
                last = len(packed) - 1
                size = 0
                while at < len(heads) and (not size or len(packed) < 256 and size < SLICE_BYTES):
                    z = batch.column("z")[at].as_py()
                    if heads[at]:
                        last, current = len(packed), [z]
                    else:
                        of.append((last, len(packed)))
                        member.append((centers[at], ids[at]))
                    packed.append(z)
                    size += len(z)
                    at += 1
                if of:
                    bags = exact_bags(packed)
                    good = [m for m, (x, y) in zip(member, of, strict=True) if overlap(bags[x], bags[y]) >= threshold]
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in good], pa.int64()), pa.array([m for _, m in good], pa.int64())], ["center", "member"])

    return dealt.mapInArrow(worker(run), "center long, member long")


def _rank(band: Column) -> Column:
    """The order in which a bucket's members become its centre.

    For most bands texts that share most with others come first: the original of many copies
    is like all of them, its copies need not be like each other. For the other bands ids count, from the largest.
    """
    return F.when(band % 3 == 0, -F.col("id")).otherwise(-F.col("shares"))


def _shared(members: DataFrame) -> DataFrame:
    """Only members whose bucket has another member. Counts are combined before they move."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(sizes.select("key"), "key", "left_semi")


def _by_length(members: DataFrame, threshold: float) -> DataFrame:
    """Split buckets by length: alike texts differ in their number of shingles by the threshold at most.

    Length classes are twice as wide as that and lie in two grids, half a class apart, so
    any two texts that can be alike share a class.
    """
    place = F.log(F.col("n").cast("double")) / (-2 * math.log(threshold))
    classes = F.array(F.floor(place) * 2, F.floor(place + 0.5) * 2 + 1)
    return members.withColumn("class", F.explode(classes)).select(F.xxhash64("key", "class").alias("key"), "band", "id", "n")


def _centers(rows: DataFrame) -> DataFrame:
    """(key, center): the first row of each bucket; ties go to the least id."""
    return rows.groupBy("key").agg(F.min(F.struct(_rank(F.col("band")).alias("rank"), "id")).alias("first")).select("key", F.col("first.id").alias("center"))


def _labelled(rows: DataFrame, id_col: str, classes: DataFrame, name: str) -> DataFrame:
    """Add the class of an id: its own id where it has no link."""
    return rows.join(classes.select(F.col("id").alias(id_col), F.col("component").alias("__c")), id_col, "left").withColumn(name, F.coalesce("__c", id_col)).drop("__c")


def _unary(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of multisets as sets: the i-th copy of a shingle has a key of its own."""
    count = np.concatenate([c for _, c in bags])
    key = np.repeat(np.concatenate([s for s, _ in bags]).astype(np.int64), count) << 32 | ragged(np.zeros(len(count), np.int64), count)
    return np.repeat(np.arange(len(bags)), [int(c.sum()) for _, c in bags]), key


def overlaps(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs, as :func:`overlap` gives them.

    Frequent keys go through matrix products, rare ones through the pairs that have them.
    """
    (lr, lk), (rr, rk) = _unary(left), _unary(right)
    size = np.bincount(lr, minlength=len(left))[:, None] + np.bincount(rr, minlength=len(right))[None, :]
    columns = np.intersect1d(lk, rk)
    both = np.zeros((len(left), len(right)), np.int64)
    if len(columns):
        lr, lc = _placed(lr, lk, columns)
        rr, rc = _placed(rr, rk, columns)
        nl, nr = np.bincount(lc, minlength=len(columns)), np.bincount(rc, minlength=len(columns))
        dense = nl * nr * 50 > both.size
        at, many = np.cumsum(dense) - 1, int(dense.sum())
        li, ri = dense[lc], dense[rc]
        lrow, lcol, rrow, rcol = lr[li], at[lc[li]], rr[ri], at[rc[ri]]
        step = max(64, (1 << 22) // (len(left) + len(right)))
        for lo in range(0, many, step):
            hi = min(lo + step, many)
            x, y = np.zeros((len(left), hi - lo), np.float32), np.zeros((len(right), hi - lo), np.float32)
            for m, row, col in ((x, lrow, lcol), (y, rrow, rcol)):
                a, b = np.searchsorted(col, (lo, hi))
                m[row[a:b], col[a:b] - lo] = 1
            both += np.rint(x @ y.T).astype(np.int64)
        lr, lc = lr[~li], lc[~li]
        first, pairs = np.searchsorted(rc, lc), nr[lc]
        ends = np.cumsum(pairs)
        lo = 0
        while lo < len(lr):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - pairs[lo] + (1 << 21), side="right")))
            spot = np.repeat(lr[lo:hi], pairs[lo:hi]) * len(right) + rr[ragged(first[lo:hi], pairs[lo:hi])]
            both += np.bincount(spot, minlength=both.size).reshape(both.shape)
            lo = hi
    return both / np.maximum(size - both, 1)


def _placed(row: np.ndarray, key: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places among ``columns`` of the keys that occur there, by place."""
    at = np.minimum(np.searchsorted(columns, key), len(columns) - 1)
    ok = columns[at] == key
    row, at = row[ok], at[ok]
    order = np.argsort(at, kind="stable")
    return row[order], at[order]


def _open(rows: DataFrame, classes: DataFrame, hot: list[int]) -> tuple[DataFrame, DataFrame, list[int]]:
    """Rows (key, id, n, class, out) of all buckets, and (key, small) of those with pairs still to be compared.

    A pair of a bucket is open if its classes differ, so one of the two is not in the centre's class: out.
    Buckets of the same members are taken once; in one of two members the centre has met the other. A small bucket has
    BLOCK members and BLOCK_SHINGLES shingles at most.
    """
    of = _labelled(rows.select("key", "center").distinct(), "center", classes, "of").select("key", "of")
    named = meet(_labelled(rows.select("key", "id", "n"), "id", classes, "class"), of, hot).select("key", "id", "n", "class", (F.col("class") != F.col("of")).alias("out"))
    named = materialize(named, "named")
    sizes = named.groupBy("key").agg(
        F.count("*").alias("size"), F.sum("n").alias("long"), F.sum(F.col("out").cast("long")).alias("rest"), F.bit_xor(F.xxhash64("id")).alias("f1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("f2")
    )
    open_ = sizes.where("rest > 0 and size > 2").groupBy("size", "f1", "f2").agg(F.min(F.struct("key", "long")).alias("b")).select("b.*", "size")
    return named, materialize(open_.select("key", ((F.col("size") <= BLOCK) & (F.col("long") <= BLOCK_SHINGLES)).alias("small")), "open")


def _rare_pairs(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(center, member): pairs of texts of different classes that may be alike, from rows (id, class), by prefixes of rare shingles.

    The i-th copy of a shingle is a token of its own, so multisets are sets of tokens. Tokens of one text only come first
    in its order and meet nobody, so they count but don't move; the others follow by their number of texts. The first token that two
    alike texts have in common stands among the first n - t n + 1 of the longer and the first n - 2 t n / (1 + t) + 1 of the shorter, and what is
    left from there on must allow for the overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = [plain.decompress(z) for z in batch.column("z").to_pylist()]
            named = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("class"), pa.array(raw, pa.large_binary())], ["id", "class", "text"])
            for c in chunks(iter([named]), "text"):
                doc, shingle, count, own, _ = shingles(c)
                row = np.repeat(np.arange(len(doc)), count)
                copy = ragged(np.zeros(len(count), np.int64), count)
                token = mix(shingle[row] * U64(GOLD) + copy.astype(U64)).view(np.int64)
                at = pa.array(doc[row])
                yield pa.RecordBatch.from_arrays([c.batch.column("id").take(at), c.batch.column("class").take(at), pa.array(own[doc[row]], pa.int64()), pa.array(token)], ["id", "class", "n", "token"])

    tokens = materialize(members.join(texts, "id").select("id", "class", "z").mapInArrow(worker(run), "id long, class long, n long, token long"), "tokens")
    counts = materialize(tokens.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1"), "counts")
    met = meet(tokens, counts, hot_keys(counts, SHARE, "token"), "token")
    texts_order = Window.partitionBy("id").orderBy("rows", "token")
    met = met.withColumn("at", F.col("n") - F.count("*").over(Window.partitionBy("id")) + F.row_number().over(texts_order) - 1)
    t = float(threshold)
    met = materialize(met.where(F.col("at") < F.col("n") - F.ceil(F.col("n") * (t - 1e-9)) + 1).drop("rows"), "prefixes")
    long_ = met.select("token", F.col("id").alias("x"), F.col("class").alias("xc"), F.col("n").alias("xn"), F.col("at").alias("xa"))
    short = met.where(F.col("at") < F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t) - 1e-9)) + 1).select("token", F.col("id").alias("y"), F.col("class").alias("yc"), F.col("n").alias("yn"), F.col("at").alias("ya"))
    left = F.least(F.col("xn") - F.col("xa"), F.col("yn") - F.col("ya"))
    fits = (F.col("xc") != F.col("yc")) & (F.struct("yn", "y") < F.struct("xn", "x")) & (left >= (t - 1e-9) / (1 + t) * (F.col("xn") + F.col("yn")))
    return long_.join(short, "token").where(fits).select(F.least("x", "y").alias("center"), F.greatest("x", "y").alias("member")).distinct()


def _rest_links(cells: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(center, member): pairs of classes that a link of the threshold at least joins in a small bucket, from rows (key, id, class, out)."""

    def run(table: pa.Table) -> pa.Table:
        left, of = np.array(table.column("out").to_pylist(), bool), np.array(table.column("class").to_pylist(), np.int64)
        bags = exact_bags(table.column("z").to_pylist())
        a, b = np.flatnonzero(left), np.arange(len(bags))
        pairs: list[tuple[int, int]] = []
        if len(a) and len(b):
            alike = overlaps([bags[k] for k in a], [bags[k] for k in b]) >= threshold
            x, y = np.nonzero(alike & (of[a][:, None] != of[b][None, :]))
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while c in root:
                    c = root[c]
                return c

            for p, q in set(zip(of[a][x].tolist(), of[b][y].tolist(), strict=True)):
                p, q = sorted((find(p), find(q)))
                if p != q:
                    root[q] = p
                    pairs.append((p, q))
        return pa.table({"center": pa.array([p for p, _ in pairs], pa.int64()), "member": pa.array([q for _, q in pairs], pa.int64())})

    return cells.join(texts, "id").groupBy("key").applyInArrow(run, "center long, member long").distinct()


def classify(signed: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """Rows (id, component) of all texts that have a link, from rows (id, n, bands) and (id, z), one for each text.

    First each bucket's members are compared with its centre. The links so far make
    classes; two members of one class need no comparison. Then the pairs of a bucket whose
    classes differ are compared: all in a small bucket; in a large one those that rare shingles leave possible. So every pair of a bucket is in one class, has been compared or can't be alike.
    """
    each = signed.select("id", "n", F.posexplode("bands").alias("band", "key")).select("key", "band", "id", "n")
    rows = materialize(_shared(_by_length(_shared(each), threshold)), "buckets")
    texts = materialize(packed.join(rows.select("id").distinct(), "id", "left_semi"), "texts")
    sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    limit = max(HUB, (sizes.agg(F.sum("size")).first()[0] or 0) // SHARE)
    hot = [r.key for r in sizes.where(F.col("size") > limit).select("key").collect()]  # SHARE buckets at most
    shares = meet(rows, sizes, hot).groupBy("id").agg(F.sum("size").alias("shares"))
    rows = rows.join(shares, "id")
    rows = materialize(meet(rows, _centers(rows), hot).drop("shares"), "centers")
    pairs = rows.where("id <> center").select(F.least("center", "id").alias("center"), F.greatest("center", "id").alias("member")).distinct()
    good = materialize(verify(pairs, texts, threshold), "links")
    classes = components(good.select(F.col("center").alias("a"), F.col("member").alias("b")))
    named, open_ = _open(rows, classes, hot)
    cells = named.join(open_.where("small").select("key"), "key").select("key", "id", "class", "out")
    more = materialize(_rest_links(cells, texts, threshold), "links")
    large = open_.where("not small").select("key")
    if not large.isEmpty():
        members = materialize(meet(named, large, hot).select("id", "class").distinct(), "members")
        more = materialize(more.unionByName(verify(_rare_pairs(members, texts, threshold), texts, threshold)), "links")
    return classes if more.isEmpty() else _merged(classes, more)


def _merged(classes: DataFrame, good: DataFrame) -> DataFrame:
    """Classes after more links: only the classes that they join are worked on."""
    edges = _labelled(_labelled(good, "center", classes, "a"), "member", classes, "b").select("a", "b")
    joined = components(edges).withColumnRenamed("component", "to")
    nodes = classes.unionByName(good.select(F.explode(F.array("center", "member")).alias("id")).distinct().join(classes.select("id"), "id", "left_anti").withColumn("component", F.col("id")))
    hot = hot_keys(classes.groupBy("component").agg(F.count("*").alias("rows")), SHARE, "component")
    moved = meet(nodes, joined.select(F.col("id").alias("component"), "to"), hot, "component", how="left")
    return materialize(moved.select("id", F.coalesce("to", "component").alias("component")), "classes")


def _classified(docs: DataFrame, threshold: float, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, sha, class_id, text_id, n_shingles); ``sha`` is the digest of the text as it stands."""
    source = narrow(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    signed = materialize(sign(source, bands, rows), "signatures")
    known = signed.where("id is not null")
    # One node for each distinct text: what rows of one text have besides ids is equal, so any of them will do.
    distinct = known.groupBy("key").agg(F.min("id").alias("text_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("z").alias("z"), F.count("*").alias("rows"))
    texts = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    classes = classify(texts.select(F.col("node").alias("id"), "n", "bands"), texts.select(F.col("node").alias("id"), "z"), threshold)
    placed = materialize(texts.select("key", "text_id", F.col("node").alias("id")).join(classes, "id"), "placed")
    least = materialize(placed.groupBy("component").agg(F.min("text_id").alias("class_id"), F.count("*").alias("rows")), "least")
    placed = meet(placed, least.drop("rows"), hot_keys(least, SHARE, "component"), "component").select("key", "class_id")
    named = texts.select("key", "text_id", "rows").join(placed, "key", "left").select("key", "text_id", "rows", F.coalesce("class_id", "text_id").alias("class_id"))
    named = materialize(named, "named")
    # A text of more than this share of the rows goes to them by broadcast: SHARE texts at most.
    limit = max(HUB, (named.agg(F.sum("rows")).first()[0] or 0) // SHARE)
    busy = F.broadcast(named.where(F.col("rows") > limit))
    each = known.select("id", "sha", "key", "n")
    met = each.join(busy, "key").unionByName(each.join(busy.select("key"), "key", "left_anti").join(named.where(F.col("rows") <= limit), "key"))
    out = met.select("id", "sha", "class_id", "text_id", F.col("n").alias("n_shingles"))
    none = F.lit(None).cast("long")
    return out.unionByName(signed.where("id is null").select("id", "sha", none.alias("class_id"), none.alias("text_id"), F.col("n").alias("n_shingles")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, class_id, text_id, n_shingles: one row for each row of docs.

    ``class_id`` is the least id among the texts that links of weighted Jaccard
    similarity >= threshold connect; ``text_id`` the least id of the same words.
    Ids are integers. Every distinct text is a node of its own, whatever its ids: rows that share an id and
    have different texts are classed by their texts, in any order of rows; rows of one id and
    text get a row each. A text without words is alike only
    to texts of the same bytes; null counts as the empty text. A row whose id is
    null has class_id and text_id null. An empty table gives an empty table.
    """
    return _classified(docs, threshold, bands, rows, id_col, text_col).drop("sha").withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that name their class: of each group the rows of its least id stay.

    Rows without an id stay. A row goes for its own text only: another text under the same id is judged by itself.
    All columns stay, whatever their names.
    """
    found = _classified(docs, threshold, bands, rows, id_col, text_col)
    gone = found.where("class_id <> id").select("id", "sha").distinct()
    held = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("sha"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    )
    return held.join(gone, ["id", "sha"], "left_anti").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
keyed AS (SELECT r, doc_id, w, len(w) > 0 AS worded, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE t END AS key FROM docs),
texts AS (SELECT min(doc_id) AS text_id, row_number() OVER () AS node, worded, key, any_value(w) AS w FROM keyed WHERE doc_id IS NOT NULL GROUP BY worded, key),
bags AS (
  SELECT node, n, array_to_string(w[i:i + least(n, 5) - 1], ' ') AS k, n < 5 AS short, count(*) AS c
  FROM (SELECT node, w, len(w) AS n, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM texts WHERE worded) GROUP BY ALL),
sized AS (SELECT *, sum(c) OVER (PARTITION BY node) AS size FROM bags),
links AS (
  SELECT a.node AS x, b.node AS y FROM sized a JOIN sized b ON a.k = b.k AND a.short = b.short AND a.node < b.node
  GROUP BY a.node, b.node, a.size, b.size
  HAVING CAST(sum(least(a.c, b.c)) AS DOUBLE) / (a.size + b.size - sum(least(a.c, b.c))) >= 0.8),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT node AS x, node AS y FROM texts UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x),
classes AS (SELECT reach.x AS node, min(o.text_id) AS class_id FROM reach JOIN texts o ON o.node = reach.y GROUP BY reach.x)
SELECT d.doc_id, c.class_id, t.text_id, CASE WHEN d.worded THEN greatest(len(d.w) - 4, 1) ELSE 0 END AS n_shingles
FROM keyed d LEFT JOIN texts t ON d.doc_id IS NOT NULL AND d.worded = t.worded AND d.key = t.key LEFT JOIN classes c USING (node)
"""
