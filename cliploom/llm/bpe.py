"""Byte-level BPE encoding and decoding by longest matches and backtracking.

The ranks define, for every token, the one pair of tokens whose merge makes it.
Two tokens may stand side by side in an encoding exactly if merging their bytes
by rank would never have joined them across the border; that test walks down
both merge trees and is memoised. An automaton over all tokens (bytes mapped to
Latin-1 characters) cuts a piece into longest matches, each beginning where the
one before ends. The encoder takes them and, where a border is not allowed, falls
back to the next shorter prefix token; the longest token of a position that only
this leads to is looked up when it is reached. A position that turned out to be a
dead end is never tried again, so the work is linear in the length of the piece.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import narrow, worker

#: Pieces of up to so many characters are remembered, up to so many pieces; and so many borders.
CACHED_LENGTH, CACHED_PIECES, CACHED_BORDERS = 32, 240_000, 250_000
#: A rank file of more bytes is refused: it is sent to every Python worker.
MAX_RANK_BYTES = 64 << 20


class Borders(dict):
    """Whether token b may follow token a, by a << 32 | b; a border that isn't known is tested, and all are forgotten at CACHED_BORDERS."""

    def __init__(self, test):
        super().__init__()
        self.test = test

    def __missing__(self, border: int) -> bool:
        known = self.test(border >> 32, border & 0xFFFFFFFF)
        if len(self) >= CACHED_BORDERS:
            self.clear()
        self[border] = known
        return known


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.size = {r: len(t) for t, r in self.rank.items()}
        self.most = max(self.size.values(), default=0)
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.split: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}
        self.border = Borders(self.may_follow)

    # -------------------------------------------------------------- merge trees
    def parts(self, r: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token ``r``; None for a token that no merge makes."""
        if r not in self.split:
            self.split[r] = self._merge_all_but(r)
        return self.split[r]

    def _merge_all_but(self, r: int) -> tuple[int, int] | None:
        """What is left of the token's bytes when only merges of lower rank are done."""
        t = self.token[r]
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            found = [(self.rank.get(a + b, r), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            low, i = min(found)
            if low >= r:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together gives these two tokens again."""
        limit = 1 << 62
        while True:
            joined = self.rank.get(self.token[a] + self.token[b])
            if joined is not None and joined < limit:
                return False
            # Undo the later of the two merges; its rank bounds what may happen before it.
            if a > b:
                limit = a
                pair = self.parts(a)
                if pair is None:
                    limit, pair = b + 1, self.parts(b)
                    if pair is None:
                        return True
                    limit, b = b + 1, pair[0]
                    continue
                a = pair[1]
            else:
                limit = b + 1
                pair = self.parts(b)
                if pair is None:
                    limit, pair = a, self.parts(a)
                    if pair is None:
                        return True
                    a = pair[1]
                    continue
                b = pair[0]

    def next_shorter(self, r: int) -> int:
        """The longest token that is a proper prefix of token ``r``; -1 if there is none."""
        if r not in self.shorter:
            t = self.token[r]
            self.shorter[r] = next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1)
        return self.shorter[r]

    # ----------------------------------------------------------------- encoding
    def longest(self, text: str, at: int) -> int:
        """The longest token that starts at a position of a piece (as Latin-1); -1 if there is none."""
        for n in range(self.automaton.longest_prefix(text[at : at + self.most]), 0, -1):
            r = self.automaton.get(text[at : at + n], -1)
            if r >= 0:
                return r
        return -1

    def encode_piece(self, data: bytes) -> list[int]:
        n, text = len(data), data.decode("latin-1")
        size, border = self.size, self.border
        best = {end + 1 - size[r]: r for end, r in self.automaton.iter_long(text)}
        dead: set[int] = set()
        ids: list[int] = []
        at, last, candidate = 0, -1, best.get(0, -1)
        while True:
            while candidate >= 0:
                end = at + size[candidate]
                if end not in dead and (last < 0 or border[last << 32 | candidate]):
                    break
                candidate = self.next_shorter(candidate)
            if candidate >= 0:
                ids.append(candidate)
                if end == n:
                    return ids
                at, last = end, candidate
                candidate = best.get(at)
                if candidate is None:
                    candidate = best[at] = self.longest(text, at)
            else:
                if not ids:
                    raise ValueError("the ranks lack a byte of this text")
                dead.add(at)
                candidate = self.next_shorter(ids[-1])
                at -= size[ids.pop()]
                last = ids[-1] if ids else -1

    def _pack(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_LENGTH:
            if len(self.pieces) >= CACHED_PIECES:
                self.pieces.clear()
            self.pieces[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        known, pack = self.pieces.get, self._pack
        return b"".join([known(piece) or pack(piece) for piece in self.find(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(rank_file, pattern)


def rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has over {MAX_RANK_BYTES} bytes")
    return data


def default_tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the installed 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col and ids, array<int>: the tokens of every whole text.

    Null and empty texts give an empty array; other columns don't matter and
    repeated rows give repeated rows.
    """
    return _mapped(docs, ranks, pattern, id_col, text_col, digest=False)


def encode_digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    The ids are decoded again, and what is hashed is what decoding gave. Null
    and empty texts have no token and the hash of nothing.
    """
    return _mapped(docs, ranks, pattern, id_col, text_col, digest=True)


def _mapped(docs, ranks, pattern, id_col, text_col, digest):
    source = narrow(docs, row_id=id_col, text=text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(rank_bytes(ranks))
    kind = dict(source.dtypes)["row_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shipped.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                packed = [c.encode_packed(t or "") for t in part.column("text").to_pylist()]
                if not digest:
                    ids = pa.array([np.frombuffer(p, "<u4").astype("<i4") for p in packed], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column("row_id"), ids], ["row_id", "ids"])
                    continue
                back = [hashlib.sha256(c.decode(np.frombuffer(p, "<u4").tolist())).hexdigest() for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array(back)],
                    ["row_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = f"row_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    return source.mapInArrow(worker(run), schema).withColumnRenamed("row_id", id_col)


def decode_tokens(rows: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Returns id_col and decoded, binary: the bytes of array<int> ids_col; null gives no bytes.

    An id outside the vocabulary is an error.
    """
    source = narrow(rows, row_id=id_col, ids=ids_col)
    shipped = rows.sparkSession.sparkContext.broadcast(rank_bytes(ranks))
    pattern = default_tokenizer()[1]

    def run(batches):
        c = codec(shipped.value, pattern)
        for batch in batches:
            out = [c.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(out, pa.binary())], ["row_id", "decoded"])

    return source.mapInArrow(worker(run), f"row_id {dict(source.dtypes)['row_id']}, decoded binary").withColumnRenamed("row_id", id_col)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, *default_tokenizer())
