"""Language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1, drawn from its code point; all
that isn't a letter is one boundary symbol. A letter's vector is permuted (rotated) by its place
in the n-gram and bound (multiplied) with the others into the n-gram's vector. A
text is the bundle (sum) of its n-gram vectors; a language's prototype is the bundle of its
training texts. The nearest prototype by cosine names the language.

As bundling is a sum, a chunk of texts is counted into a matrix of texts by distinct
n-grams, and one matrix product makes all bundles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, carried, materialize, mix, worker
from .sampling import TEXT_BYTES, least, place, small

DIM, N = 1024, 3
#: Training texts of a language at most. Every language is learnt.
PER_LANGUAGE = 3000
#: Languages whose prototypes (4 KB each) are broadcast at once; further ones go round by round.
BLOCK_LANGUAGES = 4096
UNKNOWN = "und"
#: Below this cosine a text is about as far from every prototype as random vectors are from each other. So are
#: clean texts of a few n-grams, so no text goes for it unless a caller asks for that.
MIN_SCORE = 0.05


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_vectors(code_points: np.ndarray, dim: int) -> np.ndarray:
    """+1/-1 rows, one for each code point, the same on every machine."""
    words = np.arange(dim // 64, dtype=np.int64).astype(U64)
    bits = mix(mix(code_points.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))[:, None] + words[None, :] * U64(0xD1342543DE82EF95))
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1).reshape(len(code_points), dim)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts end to end (letters' code points, 0 for a run of others), each symbol's text, and letters per text."""
    padded = ["\n" + (t or "").lower() + "\n" for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(p) for p in padded], np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = _is_letter()[code]
    code = np.where(letter, code, 0)
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1] | (doc[1:] != doc[:-1])
    letters = np.bincount(doc[letter], minlength=len(texts))
    return code[keep], doc[keep], letters


def bundles(texts: list[str | None], dim: int = DIM, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text (float32 rows) and its number of letters."""
    code, doc, letters = symbols(texts)
    out = np.zeros((len(texts), dim), np.float32)
    if len(code) < n:
        return out, letters
    alphabet, index = _indexed(code)
    k = len(alphabet)
    gram = index[: len(index) - n + 1].astype(np.int64)
    for i in range(1, n):
        gram = gram * k + index[i : len(index) - n + 1 + i]
    ok = doc[: len(gram)] == doc[n - 1 :]
    gram, doc = gram[ok], doc[: len(ok)][ok]
    if k**n <= 1 << 22:
        seen = np.bincount(gram, minlength=k**n) > 0
        used = np.flatnonzero(seen)
        column = (np.cumsum(seen) - 1)[gram]
    else:
        used, column = np.unique(gram, return_inverse=True)
    places = [np.roll(letter_vectors(alphabet, dim), n - 1 - i, axis=1) for i in range(n)]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    step = 4096
    for lo in range(0, len(used), step):  # columns in blocks, so that memory stays bounded for any alphabet
        part = used[lo : lo + step]
        bound = np.ones((len(part), dim), np.int8)
        for i in range(n):
            bound *= places[i][part // k ** (n - 1 - i) % k]
        bound = bound.astype(np.float32)
        for a in range(0, len(texts), 128):
            b = min(a + 128, len(texts))
            c, d = column[first[a] : first[b]], doc[first[a] : first[b]]
            if len(used) > step:
                own = (c >= lo) & (c < lo + step)
                c, d = c[own], d[own]
            counts = np.bincount((d - a).astype(np.int64) * len(part) + (c - lo), minlength=(b - a) * len(part)).reshape(b - a, len(part))
            out[a:b] += counts.astype(np.float32) @ bound
    return out, letters


def _indexed(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    present = np.zeros(int(code.max()) + 1, bool)
    present[code] = True
    alphabet = np.flatnonzero(present)
    lookup = np.zeros(len(present), np.int32)
    lookup[alphabet] = np.arange(len(alphabet), dtype=np.int32)
    return alphabet, lookup[code]


def _batched(batch: pa.RecordBatch, rows: int = 256, max_chars: int = 1 << 20) -> Iterator[tuple[int, int, list]]:
    """Texts of a batch in pieces; a piece ends after so many rows or characters."""
    texts: list = []
    lo = size = 0
    for i, value in enumerate(batch.column("text")):
        t = value.as_py()
        if texts and (len(texts) == rows or size + len(t or "") > max_chars):
            yield lo, i, texts
            texts, lo, size = [], i, 0
        texts.append(t)
        size += len(t or "")
    if texts:
        yield lo, lo + len(texts), texts


class Profiles:
    """Languages and their prototypes, as unit vectors."""

    def __init__(self, languages: list[str], sums: np.ndarray):
        order = np.argsort(np.array(languages, object)) if languages else np.zeros(0, int)
        self.languages = [languages[i] for i in order]
        self.unit = _unit(sums[order]) if languages else np.zeros((0, DIM), np.float32)

    def blocks(self, size: int) -> list[Profiles]:
        """The languages in blocks of so many, in order; one empty block where there are none."""
        return [self._part(slice(lo, lo + size)) for lo in range(0, max(1, len(self.languages)), size)]

    def _part(self, which: slice) -> Profiles:
        out = Profiles([], self.unit)
        out.languages, out.unit = self.languages[which], self.unit[which]
        return out

    def nearest(self, found: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language (ties: the first in order) and cosine of each bundle; ``und`` and -2 for texts without letters."""
        if not self.languages:
            return [UNKNOWN] * len(found), np.full(len(found), -2.0)
        cosine = _unit(found) @ self.unit.T
        best = np.argmax(cosine, axis=1)
        known = letters > 0
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, cosine[np.arange(len(found)), best].astype(np.float64), -2.0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and cosine, 0 to 1, of each text."""
        names, cosine = self.nearest(*bundles(texts))
        return names, np.clip(cosine, 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (x / np.where(size > 0, size, 1)).astype(np.float32)


def learn(train: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> Profiles:
    """Prototypes of all languages, from at most ``per_language`` distinct texts of each, chosen by a hash of id and text.

    Rows without a language or a text teach nothing; nor do texts of more than ``sampling.TEXT_BYTES`` bytes. The
    sample of a language has ``sampling.CLASS_BYTES`` bytes at most. Prototypes come to the driver, 4 KB for each language.
    """
    text = F.col(f"`{text_col}`")
    rows = train.select(F.col(f"`{lang_col}`").cast("string").alias("c"), place(id_col, text_col).alias("at"), text.alias("text")).where("c is not null and text is not null")
    sample = least(rows.select("c", "at", F.octet_length("text").alias("size")), per_language)
    tops = materialize(sample.groupBy("c").agg(F.max("at").alias("top")), "tops")
    if tops.isEmpty():
        return Profiles([], np.zeros((0, DIM)))
    taken = rows.join(small(tops), "c").where((F.col("at") <= F.col("top")) & (F.octet_length("text") <= TEXT_BYTES)).groupBy("c", "at").agg(F.first("text").alias("text")).select(F.col("c").alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def sums() -> pa.RecordBatch:
            values = [np.rint(v).astype(np.int64) for v in total.values()]
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(values, pa.list_(pa.int64()))], ["lang", "v"])
            total.clear()
            return out

        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi, texts in _batched(batch):
                found, _ = bundles(texts)
                for name in set(names[lo:hi]):
                    total[name] = total.get(name, 0) + found[names[lo:hi] == name].astype(np.float64).sum(axis=0)
                if len(total) > 1000:
                    yield sums()
        yield sums()

    each = taken.mapInArrow(worker(run), "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    table = each.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v")).toArrow()
    sums = table.column("v").combine_chunks()
    flat = sums.flatten() if isinstance(sums, pa.ListArray) else pa.concat_arrays([c.flatten() for c in sums.chunks])
    return Profiles(table.column("lang").to_pylist(), flat.to_numpy().astype(np.float64).reshape(-1, DIM))


def predict(docs: DataFrame, profiles: Profiles, extra: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_LANGUAGES) -> DataFrame:
    """Returns id_col, lang_pred and score, and the columns in ``extra``, for each row of docs.

    ``und`` and 0 for texts that are null or have no letter, and for all where nothing was learnt.
    Repeated rows give repeated rows. Of more than ``block`` languages each block meets the texts in a round of its own.
    """
    extra = extra or {}
    now = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *[c.alias(k) for k, c in extra.items()])
    parts = profiles.blocks(block)
    for i, part in enumerate(parts):
        now = _round(now, part, list(extra), first=i == 0, last=i == len(parts) - 1)
        if i < len(parts) - 1:
            now = materialize(now, "languages")
    return now.withColumnRenamed("id", id_col)


def _round(rows: DataFrame, part: Profiles, names: list[str], first: bool, last: bool) -> DataFrame:
    """Compare texts with a block of languages, and with the best of the blocks before."""
    shipped = rows.sparkSession.sparkContext.broadcast(part)  # BLOCK_LANGUAGES x DIM numbers at most
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _batched(batch):
                found, score = shipped.value.nearest(*bundles(texts))
                piece = batch.slice(lo, hi - lo)
                if not first:
                    old, had = piece.column("lang_pred").to_pylist(), piece.column("score").to_numpy()
                    found = [a if x >= y else b for a, b, x, y in zip(old, found, had, score, strict=True)]
                    score = np.maximum(had, score)
                out = {"id": piece.column("id"), "lang_pred": pa.array(found, pa.string()), "score": pa.array(np.clip(score, 0, 1) if last else score)} | {k: piece.column(k) for k in names}
                if not last:
                    out["text"] = piece.column("text")
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    fields = [("id", kinds["id"]), ("lang_pred", "string"), ("score", "double"), *[(k, kinds[k]) for k in names]] + [("text", "string")] * (not last)
    return rows.mapInArrow(worker(run), ", ".join(f"`{k}` {v}" for k, v in fields))


def keep_known(docs: DataFrame, profiles: Profiles, min_score: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is not ``und``; with ``min_score``, only those whose cosine is that at least.

    Where nothing was learnt all rows go. All columns stay.
    """
    rows, restored = carried(docs, text_col)
    found = predict(rows, profiles, id_col="__row", text_col="__text").where(F.col("lang_pred") != UNKNOWN)
    return restored(found if min_score is None else found.where(F.col("score") >= min_score))


def held_out(id_col: str, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this rest; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % parts == rest


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out("doc_id", 3, 1)
    profiles = learn(docs.where(~out), "doc_id", "text", "lang")
    return predict(docs, profiles, {"held_out": out}).select("doc_id", "held_out", "lang_pred", "score")
