"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the embeddings of its character n-grams and of itself,
hashed into buckets; so an unseen misspelling shares most of its vector with the word it
stands for. A passage is the average of its words, and a linear layer with a softmax
gives its two class probabilities; embeddings and layer are trained jointly. Texts are
read as overlapping passages, and a text is as toxic as its most toxic passage, so
a long text doesn't dilute it.

Training starts with all passages under their text's label, then goes on with
each text's most toxic passage.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CODES, Chunk, chunks, words, worker
from .language import held_out
from .sampling import least, place

BUCKETS, DIM, NGRAMS = 1 << 17, 16, (3, 4, 5)
#: Words of half a passage; passages overlap by half. Passages of eight words keep one toxic word in a
#: long text from vanishing; shorter ones are surer of single words, longer ones dilute (figures in the README).
HALF = 4
#: Distinct labelled texts of a class that training takes at most; ``sampling`` bounds their bytes too.
PER_CLASS = 2500
WARM, STEPS = 30, 130
CACHED_WORDS = 300_000


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams with borders."""
    edged = f"<{word}>"
    parts = [edged, *(edged[i : i + n] for n in NGRAMS for i in range(len(edged) - n + 1))]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


class Bag:
    """Words of texts as indices into a vocabulary, cut into half passages."""

    def __init__(self):
        self.vocabulary: dict[str, int] = {}
        self.index: list[np.ndarray] = []

    def add(self, text: str) -> None:
        known = self.vocabulary
        self.index.append(np.array([known.setdefault(w, len(known)) for w in split(text)], np.int32))


def split(text: str) -> list[str]:
    """Words as the scoring scan sees them: runs of digits, letters (A-Z lower-cased) and non-ASCII characters."""
    return [w for w in text.encode().translate(_TABLE).decode().split("\0") if w]


_TABLE = WORD_CODES.tobytes()


class Passages:
    """The passages of texts of so many words: two half passages side by side, or the only half."""

    def __init__(self, n_words: np.ndarray):
        halves = -(-n_words // HALF)
        doc = np.repeat(np.arange(len(n_words), dtype=np.int32), halves)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(halves) - halves, halves)
        self.starts = (np.cumsum(n_words) - n_words)[doc] + place * HALF
        self.sizes = np.diff(np.append(self.starts, n_words.sum())).astype(np.int32)
        joined = doc[1:] == doc[:-1]
        self.at = np.flatnonzero(np.append(joined, False) | ~np.append(False, joined)).astype(np.int32)  # first half of each passage
        self.wide = np.append(joined, False)[self.at]
        self.right = self.at[self.wide] + 1
        self.n = self.sizes[self.at].astype(np.float32)
        self.n[self.wide] += self.sizes[self.right]
        self.doc = doc[self.at]
        self.edge = np.flatnonzero(np.append(True, self.doc[1:] != self.doc[:-1])) if len(doc) else np.zeros(0, np.int64)

    def means(self, value: np.ndarray) -> np.ndarray:
        """Mean of a number per word over each passage."""
        if not len(self.at):
            return np.zeros(0)
        sums = np.add.reduceat(value, self.starts)
        out = sums[self.at]
        out[self.wide] += sums[self.right]
        return out / self.n

    def spread(self, g: np.ndarray) -> np.ndarray:
        """A number per passage, summed over the passages that each half belongs to."""
        out = np.zeros(len(self.starts), g.dtype)
        out[self.at] = g
        out[self.right] += g[self.wide]
        return out


class Model:
    """Embeddings and softmax layer."""

    def __init__(self, embedding: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.embedding, self.layer, self.bias = embedding, layer, bias
        # The layer is linear, so a word adds one number to the difference of the two logits.
        self.part = (embedding @ (layer[1] - layer[0])).astype(np.float64)
        self.offset = float(bias[1] - bias[0])
        self.known: dict[bytes, float] = {}

    def __reduce__(self):
        return Model, (self.embedding, self.layer, self.bias)

    def word(self, word: str) -> float:
        return float(self.part[subwords(word)].mean())

    def scores(self, c: Chunk) -> np.ndarray:
        """Probability of label 1 of each text of a chunk."""
        w = words(c)
        coded = w.as_array().dictionary_encode()
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        distinct = coded.dictionary.to_pylist()
        values = np.zeros(len(distinct))
        for i, word in enumerate(distinct):
            v = known.get(word)
            if v is None:
                v = self.word(word.decode("utf-8", "replace"))
                if len(word) <= 64:
                    known[word] = v
            values[i] = v
        p = Passages(np.diff(w.first))
        out = np.zeros(len(c))
        if len(p.edge):
            logit = np.maximum.reduceat(p.means(values[coded.indices.to_numpy()]), p.edge) + self.offset
            out[p.doc[p.edge]] = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
        return out


def train(texts: Iterator[tuple[str, int]], seed: int = 7) -> Model:
    """Fit on (text, label) pairs; without both labels the model says 0 for all."""
    bag, labels = Bag(), []
    for text, label in texts:
        bag.add(text)
        labels.append(label)
    rng = np.random.default_rng(seed)
    embedding, layer, bias = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), rng.normal(0, 1, (2, DIM)), np.zeros(2)
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max() or not bag.vocabulary:
        return Model(np.zeros((BUCKETS, DIM), np.float32), layer.astype(np.float32), np.array([1.0, 0.0]))
    grams_of = [np.array(subwords(w), np.int32) for w in bag.vocabulary]
    size = np.array([len(g) for g in grams_of])
    flat, owner = np.concatenate(grams_of), np.repeat(np.arange(len(size), dtype=np.int32), size)
    starts = np.cumsum(size) - size
    n_words = np.array([len(x) for x in bag.index])
    word_at = np.concatenate(bag.index)
    parts = Passages(n_words)
    half_of = np.repeat(np.arange(len(parts.starts), dtype=np.int32), parts.sizes)
    bag.vocabulary.clear()
    bag.index.clear()
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    counts = np.diff(np.append(parts.edge, len(parts.doc)))
    truth, balanced = y[parts.doc].astype(np.float32), balance[parts.doc].astype(np.float32)
    evenly = balanced / np.repeat(counts, counts).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (embedding, layer, bias)]
    for step in range(1, WARM + STEPS + 1):
        d = layer[1] - layer[0]
        vectors = (np.add.reduceat((embedding @ d)[flat], starts) / size).astype(np.float32)
        mean = parts.means(vectors[word_at])
        p = 1 / (1 + np.exp(-np.clip(mean + (bias[1] - bias[0]), -80, 80)))
        if step <= WARM:
            weight = evenly
        else:
            best = np.repeat(np.maximum.reduceat(mean, parts.edge), counts)
            weight = np.where(mean == best, balanced, 0)
        g = (p - truth) * weight  # gradient of the logit difference of each passage
        per_half = parts.spread(g / parts.n)
        per_word = np.bincount(word_at, weights=per_half[half_of], minlength=len(size))
        per_bucket = np.bincount(flat, weights=(per_word / size)[owner], minlength=BUCKETS)
        grad_d = per_bucket @ embedding
        grads = (per_bucket[:, None] * d[None, :] + 1e-7 * embedding, np.stack([-grad_d, grad_d]), np.array([-g.sum(), g.sum()]))
        for p_, grad, (m1, m2) in zip((embedding, layer, bias), grads, moments, strict=True):
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            p_ -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-10)
    return Model(embedding.astype(np.float32), layer.astype(np.float32), bias)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Train on at most ``per_class`` distinct texts of each label, chosen by a hash of id and text.

    Only rows of docs with ``learnable`` count. Labels that are null teach nothing; of several labels of an id the largest counts.
    A text of more than ``sampling.TEXT_BYTES`` bytes teaches nothing; those of a label have ``sampling.CLASS_BYTES`` bytes at most. So the
    one task that trains holds a bounded number of bytes.
    """
    marked = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("i")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("c"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.where(learnable).select(F.col(f"`{id_col}`").alias("i"), text.alias("t")).withColumn("at", place("i", "t"))
    # Only ids, places and sizes meet the labels; then at most 2 x per_class places go to the texts.
    labelled = source.select("i", "at", F.octet_length("t").alias("size")).join(marked, "i").select("c", "at", "size")
    wanted = least(labelled, per_class)
    rows = source.select("at", "t").join(F.broadcast(wanted), "at").groupBy("at", "c").agg(F.first("t").alias("t")).repartition(1).sortWithinPartitions("c", "at").select(F.col("t").alias("text"), F.col("c").alias("label"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((t, y) for batch in batches for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True))
        m = train(pairs)
        parts = [np.ascontiguousarray(x, np.float32).tobytes() for x in (m.embedding, m.layer, m.bias)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["embedding", "layer", "bias"])

    r = rows.mapInArrow(worker(fit), "embedding binary, layer binary, bias binary").first()
    return Model(*(np.frombuffer(r[k], np.float32).reshape(shape) for k, shape in (("embedding", (BUCKETS, DIM)), ("layer", (2, DIM)), ("bias", 2))))


def score(docs: DataFrame, model: Model, extra: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col and score, and the columns in ``extra``, for each row of docs.

    Texts without words, null ones too, have no passage and score 0. Repeated rows give repeated rows.
    """
    extra = extra or {}
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *[c.alias(k) for k, c in extra.items()])
    kinds, names = dict(source.dtypes), list(extra)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([c.batch.column("id"), pa.array(shipped.value.scores(c)), *[c.batch.column(k) for k in names]], ["id", "score", *names])

    schema = ", ".join(f"`{k}` {v}" for k, v in [("id", kinds["id"]), ("score", "double"), *[(k, kinds[k]) for k in names]])
    return source.mapInArrow(worker(run), schema).withColumnRenamed("id", id_col)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = held_out("doc_id", 5, 0)
    model = learn(docs, labels, ~out)
    return score(docs, model, {"held_out": out}).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
