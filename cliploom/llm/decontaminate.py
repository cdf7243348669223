"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an
item of fewer words is one window). A window is the set of its positioned word
shingles; a document contains the window only if it contains the window's rarest
shingle, so that one shingle is the whole prefix that the join needs for a
containment of 1. Rarity is the number of occurrences over all documents. A match of
the prefix fixes where the window would have to lie (positional bound) and whether
it fits into the document (length bound); what passes is compared with the window's
own words, byte by byte, so hashes only ever propose.

The join has two forms with one result. Windows whose number and bytes are under a limit are
broadcast as an index, and documents are never shuffled. Beyond it, prefixes are joined by a
shuffle: a bit table, as large as the prefixes need up to a bound, lets only words through that may be a prefix, each with the
words around it, and a frequent prefix is salted. Beyond the bound the tokens are taken in rounds, a table for each, so the share of words that pass
stays the same. Which items a window is of is joined after the hits. Both forms count rarity first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Chunk, Words, carried, chunks, grams, materialize, narrow, ragged, words, worker

#: Words of a prefix shingle (fewer in shorter windows); windows and bytes that are broadcast at most.
SHINGLE, MAX_BLOCK_WINDOWS, MAX_BLOCK_BYTES = 3, 200_000, 32 << 20
SPANS = "array<struct<start:int,end:int>>"
#: Bits of the table of tokens, as powers of two, at least and at most, and bits for each token. A token that occurs in more than this share of the corpus's candidates is salted.
LEAST_BITS, MOST_BITS, TOKEN_BITS, HOT_SHARE = 16, 27, 16, 1024


def text_chunk(texts: list[bytes]) -> Chunk:
    """Some texts as one chunk."""
    return Chunk(None, np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64))


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Rows (item, window): the windows of every item, as words with a space between."""
    source = narrow(benchmark, item=item_col, text=text_col).withColumn("item", F.coalesce(F.col("item").cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "text"):
            w = words(c)
            flat, at = w.spelled()
            for d, name in enumerate(c.batch.column("item").to_pylist()):
                a, b = int(w.first[d]), int(w.first[d + 1])
                size = min(window, b - a)
                if size:
                    found = {flat[at[k] : at[k + size] - 1] for k in range(a, b - size + 1)}
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string())], ["item", "window"])

    return source.mapInArrow(worker(run), "item string, window string")


def gram_rows(m: np.ndarray, k: int) -> np.ndarray:
    """As :func:`grams`, for every row of a matrix of word hashes."""
    flat = grams(m.ravel(), k)
    return flat[(np.arange(len(m)) * m.shape[1])[:, None] + np.arange(m.shape[1] - k + 1)[None, :]]


class Sieve:
    """A bit table of tokens of one round: no token is missed, some others pass. A token's round is its remainder by the number of rounds, a power of two."""

    def __init__(self, bits: int, rounds: int = 1, number: int = 0):
        self.size, self.rounds, self.number, self.bits = bits, rounds, number, np.zeros(1 << (bits - 3), np.uint8)

    def passing(self, g: np.ndarray) -> np.ndarray:
        place = g >> U64(64 - self.size)
        found = np.flatnonzero(self.bits[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8) & 1)
        return found[g[found] & U64(self.rounds - 1) == U64(self.number)] if self.rounds > 1 else found


class Index:
    """The windows of a benchmark, by their rarest shingle."""

    def __init__(self, windows: list[bytes], items: list[list[str]]):
        self.windows, self.items = windows, items
        w = words(text_chunk(windows))
        self.length = np.diff(w.first)
        self.sizes = sorted({min(SHINGLE, n) for n in self.length.tolist()})
        self.groups = []  # windows of one length, and the shingles of each
        for n in sorted(set(self.length.tolist())):
            which = np.flatnonzero(self.length == n)
            self.groups.append((which, gram_rows(w.hash[w.first[which][:, None] + np.arange(n)[None, :]], min(SHINGLE, n))))

    def shingles(self) -> np.ndarray:
        """All shingles of the windows, sorted."""
        return np.unique(np.concatenate([g.ravel() for _, g in self.groups]))

    def order(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle; ties go to the first."""
        keys, offset = np.zeros(len(self.windows), U64), np.zeros(len(self.windows), np.int64)
        for which, g in self.groups:
            k = np.argmin(counts[np.searchsorted(tokens, g)], axis=1)
            keys[which], offset[which] = g[np.arange(len(k)), k], k
        self.groups = []
        self.by = np.argsort(keys, kind="stable")
        self.offset = offset[self.by]
        self.keys, at = np.unique(keys[self.by], return_index=True)
        self.bounds = np.append(at, len(keys))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.keys >> U64(44)] = True

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and window numbers of all occurrences."""
        starts, found = [], []
        for size in self.sizes:
            g = grams(w.hash, size)
            at = np.flatnonzero(self.sieve[g >> U64(44)])
            k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
            same = self.keys[k] == g[at]
            at, k = at[same], k[same]
            n = self.bounds[k + 1] - self.bounds[k]
            entry = ragged(self.bounds[k], n)
            begin = np.repeat(at, n) - self.offset[entry]
            win = self.by[entry]
            d = np.searchsorted(w.first, np.repeat(at, n), side="right") - 1
            fits = (begin >= w.first[d]) & (begin + self.length[win] <= w.first[d + 1])
            starts.append(begin[fits])
            found.append(win[fits])
        begin, win = np.concatenate(starts), np.concatenate(found)
        if not len(begin):
            return begin, win
        flat, at = w.spelled()
        ok = [flat[a : b - 1] == self.windows[k] for a, b, k in zip(at[begin].tolist(), at[begin + self.length[win]].tolist(), win.tolist(), strict=True)]
        return begin[ok], win[ok]


def _count_shingles(texts: DataFrame, tokens) -> DataFrame:
    """How often each of the broadcast shingles occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = tokens.value
        sieve = np.zeros(1 << 20, bool)
        sieve[keys >> U64(44)] = True
        counts = np.zeros(len(keys), np.int64)
        for c in chunks(batches, "text"):
            w = words(c).hash
            for size in sizes:
                g = grams(w, size)
                g = g[sieve[g >> U64(44)]]
                k = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                counts += np.bincount(k[keys[k] == g], minlength=len(keys))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["token", "n"])

    return texts.mapInArrow(worker(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _by_index(rows: DataFrame, index) -> DataFrame:
    """Documents against a broadcast index, or None for an empty one."""
    kind = dict(rows.dtypes)["row_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for c in chunks(batches, "text"):
            w = words(c)
            begin, win = ix.matches(w) if ix else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            of = np.searchsorted(w.first, begin, side="right") - 1
            spans: list[list] = [[] for _ in range(len(c))]
            items: list[set] = [set() for _ in range(len(c))]
            if ix:
                order = np.argsort(begin, kind="stable")
                for d, a, n in zip(of[order].tolist(), (begin - w.first[of])[order].tolist(), ix.length[win[order]].tolist(), strict=True):
                    add_span(spans[d], a, a + n)
                for p in np.unique(of * len(ix.windows) + win).tolist():
                    items[p // len(ix.windows)].update(ix.items[p % len(ix.windows)])
            out = {"row_id": c.batch.column("row_id"), "n_words": pa.array(np.diff(w.first), pa.int64()), "spans": _span_lists(spans), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return rows.mapInArrow(worker(run), f"row_id {kind}, n_words long, spans {SPANS}, items array<string>")


def add_span(spans: list[dict], start: int, end: int) -> None:
    """Add a run of words to runs in order; runs that touch are one."""
    if spans and start <= spans[-1]["end"]:
        spans[-1]["end"] = max(spans[-1]["end"], end)
    else:
        spans.append({"start": start, "end": end})


def _span_lists(spans: list[list[dict]]) -> pa.Array:
    return pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


# ------------------------------------------------------- beyond what can be broadcast
def _window_tokens(windows: DataFrame) -> DataFrame:
    """Rows (win, window, items, length, offset, size, token): the shingles of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "window"):
            w = words(c)
            length = np.diff(w.first)
            for size in range(1, SHINGLE + 1):
                own = np.flatnonzero(np.minimum(length, SHINGLE) == size)
                n = length[own] - size + 1
                at, offset = ragged(w.first[own], n), ragged(np.zeros(len(n), np.int64), n)
                out = {"win": c.batch.column("win").take(pa.array(np.repeat(own, n))), "offset": pa.array(offset.astype(np.int32)), "size": pa.array(np.full(len(at), size, np.int32))}
                out["length"] = pa.array(np.repeat(length[own], n).astype(np.int32))
                out["token"] = pa.array(grams(w.hash, size)[at].view(np.int64))
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return windows.select("win", "window").mapInArrow(worker(run), "win long, offset int, size int, length int, token long")


def _sieves(tokens: DataFrame) -> Iterator[Sieve]:
    """Bit tables of a column ``token``, one for each round. Each has at most 2 ** MOST_BITS bits, of which a TOKEN_BITS-th are set at most."""
    n = tokens.agg(F.approx_count_distinct("token", 0.02)).first()[0]
    bits = min(max(LEAST_BITS, (n * TOKEN_BITS).bit_length()), MOST_BITS)
    rounds = 1 << max(0, (n * TOKEN_BITS - 1).bit_length() - MOST_BITS)
    place = F.shiftrightunsigned("token", 64 - bits)
    for number in range(rounds):
        own = tokens.where(F.col("token").bitwiseAND(rounds - 1) == number) if rounds > 1 else tokens
        cells = own.select(F.shiftright(place, 5).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - bits}) & 31 as int))").alias("bit"))
        table = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** (MOST_BITS - 5) rows at most
        out = Sieve(bits, rounds, number)
        out.bits.view(np.uint32)[table.column("cell").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
        yield out


def _tokens_of(rows: DataFrame, shipped, window: int, counting: bool, salts=None) -> DataFrame:
    """The tokens of documents that pass the sieve: their counts, or each with its row, place and the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, sizes = shipped.value
        hot = salts.value if salts is not None else {}
        for c in chunks(batches, "text"):
            w = words(c)
            if not counting:
                flat, at = w.spelled()
                numbers = c.batch.column("row").to_pylist()
            for size in sizes:
                g = grams(w.hash, size)
                k = sieve.passing(g)
                if counting:
                    token, n = np.unique(g[k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])
                    continue
                d = np.searchsorted(w.first, k, side="right") - 1
                low, high = np.maximum(k - window + size, w.first[d]), np.minimum(k + window, w.first[d + 1])
                token = g[k].view(np.int64)
                salt = [p % hot.get(t, 1) for t, p in zip(token.tolist(), k.tolist(), strict=True)]
                around = [flat[a : b - 1] for a, b in zip(at[low].tolist(), at[high].tolist(), strict=True)]
                out = {"token": pa.array(token), "salt": pa.array(salt, pa.int32()), "size": pa.array(np.full(len(k), size, np.int32)), "row": pa.array([numbers[x] for x in d.tolist()], pa.int64())}
                out |= {"place": pa.array((k - w.first[d]).astype(np.int32)), "low": pa.array((k - low).astype(np.int32)), "around": pa.array(around, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    schema = "token long, n long" if counting else "token long, salt int, size int, row long, place int, low int, around string"
    found = rows.mapInArrow(worker(run), schema)
    return found.groupBy("token").agg(F.sum("n").alias("n")) if counting else found


def _by_shuffle(rows: DataFrame, pairs: DataFrame, window: int) -> DataFrame:
    """Documents against any number of windows (window, item): rarest shingles are joined, then the words around them are compared, then items come in."""
    context = rows.sparkSession.sparkContext
    kind = dict(rows.dtypes)["row_id"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for c in chunks(batches, "text"):
            n = np.diff(words(c).first)
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(c)), pa.int64()), c.batch.column("row_id"), pa.array(n, pa.int64()), c.batch.column("text")], ["row", "row_id", "n_words", "text"])
            row += len(c)

    docs = materialize(rows.mapInArrow(worker(number), f"row long, row_id {kind}, n_words long, text string"), "numbered")
    windows = materialize(pairs.select("window").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    tokens = materialize(_window_tokens(windows), "tokens")
    sizes = list(range(1, SHINGLE + 1))

    def passed(wanted: DataFrame, name: str, **options) -> DataFrame:
        """What passes the bit tables, of all rounds."""
        parts = [materialize(_tokens_of(docs, context.broadcast((sieve, sizes)), window, **options), name) for sieve in _sieves(wanted)]
        return reduce(DataFrame.unionByName, parts)

    counted = passed(tokens, "counts", counting=True)
    rarity = tokens.join(counted, "token", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    prefix = materialize(rarity.groupBy("win").agg(F.min(F.struct("n", "offset", "token", "size", "length")).alias("p")).select("win", "p.*"), "prefixes")
    each = prefix.groupBy("token").agg(F.max("n").alias("n"))
    limit = (each.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE + 1
    salts = {r.token: r.salts for r in each.where(F.col("n") > limit).select("token", F.ceil(F.col("n") / limit).cast("int").alias("salts")).collect()}  # HOT_SHARE tokens at most
    candidates = passed(prefix, "candidates", counting=False, salts=context.broadcast(salts))
    salted = prefix.join(windows, "win").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > limit, F.ceil(F.col("n") / limit)).otherwise(1).cast("int") - 1)))
    met = candidates.join(salted.select("token", "salt", "size", "offset", "length", "window", "win"), ["token", "salt", "size"]).where("offset <= low")
    said = F.array_join(F.slice(F.split("around", " "), F.col("low") - F.col("offset") + 1, F.col("length")), " ")
    hits = met.where(said == F.col("window")).select("row", (F.col("place") - F.col("offset")).alias("start"), "length", "win")
    # Words, then items, are made distinct before a row's are put together. Only windows that were hit meet their items.
    found = materialize(hits, "hits")
    runs = found.select("row", "start", "length").distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("runs"))
    seen = materialize(found.select("row", "win").distinct(), "seen")
    hit = seen.select("win").distinct().join(windows, "win").join(pairs, "window").select("win", "item")
    names = seen.join(hit, "win").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    joined = docs.select("row", "row_id", "n_words").join(runs.join(names, "row"), "row", "left")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged: list[list] = []
            for runs_ in batch.column("runs").to_pylist():
                merged.append([])
                for r in runs_ or []:
                    add_span(merged[-1], r["start"], r["start"] + r["length"])
            items = [x or [] for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("n_words"), _span_lists(merged), pa.array(items, pa.list_(pa.string()))], ["row_id", "n_words", "spans", "items"])

    return joined.mapInArrow(worker(spans), f"row_id {kind}, n_words long, spans {SPANS}, items array<string>")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    max_block_windows: int = MAX_BLOCK_WINDOWS, max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """Returns id_col, n_words long, spans, items array<string>: one row for each row of docs.

    ``spans`` are the maximal runs of words (end exclusive) that lie inside an
    occurrence of a benchmark window; ``items`` are the sorted ids, as strings, of
    the items with occurring windows. Null and empty texts have no words; an item
    without words has no window; an item id of null counts as the empty string;
    an empty benchmark hits nothing. Repeated rows give repeated rows. Up to ``max_block_windows``
    distinct windows of ``max_block_bytes`` bytes, item ids included, are broadcast; more are joined by a shuffle.
    """
    context = docs.sparkSession.sparkContext
    rows = narrow(docs, row_id=id_col, text=text_col)
    pairs = materialize(item_windows(benchmark, window, item_col, item_text_col).distinct(), "windows")
    # What the broadcast form would hold: each window once, and its items.
    n, size = pairs.groupBy("window").agg((F.octet_length("window") + F.sum(F.octet_length("item") + 8)).alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n > max_block_windows or size > max_block_bytes:
        return _by_shuffle(rows, pairs, window).withColumnRenamed("row_id", id_col)
    index = None
    if n:
        table = pairs.orderBy("window", "item").toArrow()  # within the bounds
        items: dict[str, list[str]] = {}
        for win, item in zip(table.column("window").to_pylist(), table.column("item").to_pylist(), strict=True):
            items.setdefault(win, []).append(item)
        index = Index([x.encode() for x in items], list(items.values()))
        tokens = index.shingles()
        counts = np.zeros(len(tokens), np.int64)
        counted = _count_shingles(rows.select("text"), context.broadcast((tokens, index.sizes))).toArrow()  # a row for each token at most
        counts[counted.column("token").to_numpy()] = counted.column("n").to_numpy()
        index.order(tokens, counts)
    return _by_index(rows, context.broadcast(index)).withColumnRenamed("row_id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no benchmark window occurs. All columns stay."""
    rows, restored = carried(docs, text_col)
    return restored(find_contamination(rows, benchmark, id_col="__row", text_col="__text", **options).where("size(spans) = 0"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM sized)),
docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT p.doc_id, p.i, p.n, v.item FROM pos p JOIN wins v ON p.n = v.n AND p.k = v.k),
words AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
