"""Byte-level BPE against the public library, and token counts of flat files against a plain scan."""

import hashlib
import random

import numpy as np
import pytest

from cliploom.llm import bpe, tokencounts as t

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    path, pattern = bpe.default_tokenizer()
    return bpe.Codec(bpe.rank_bytes(path), pattern)


@pytest.fixture(scope="module")
def public(codec):
    return tiktoken.Encoding("own", pat_str=bpe.default_tokenizer()[1], mergeable_ranks=codec.rank, special_tokens={})


def test_equals_public_library_on_random_texts(codec, public):
    rng = random.Random(5)
    letters = [chr(x) for x in [*range(1, 600), 0x2028, 0x3000, 0x1F600, 0x4E2D, 0x200D, 0x85, 0xA0, 0xFEFF, 0x1C]]
    for _ in range(3000):
        pool = rng.choice((letters, "abcdethinos .\n", "aA1 '", "ab"))
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        ids = codec.encode(text)
        assert ids == public.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, "aaab" * 5_000, " " * 3_000 + "x", "theing" * 4_000, "<|endoftext|>", "é" * 4_000, "0" * 5_000])
def test_long_pieces(codec, public, text):
    assert codec.encode(text) == public.encode_ordinary(text)


class Looks:
    """An automaton that counts the matches and answers it gives."""

    def __init__(self, automaton):
        self.automaton, self.seen = automaton, 0

    def __getattr__(self, name):
        def counted(*args):
            out = getattr(self.automaton, name)(*args)
            out = list(out) if name.startswith("iter") else out
            self.seen += len(out) if isinstance(out, list) else 1
            return out

        return counted


def test_few_matches_are_looked_at(public):
    """Words of syllables, whose longest matches are often refused, take less than one look a byte."""
    path, pattern = bpe.default_tokenizer()
    own, rng = bpe.Codec(bpe.rank_bytes(path), pattern), random.Random(3)
    own.automaton = looks = Looks(own.automaton)
    syllables = ["th", "on", "er", "ing", "tion", "ble", "wh", "nd", "ou", "sh", "ción", "pf", "lich", "eau", "ç", "é"]
    words = [" " + "".join(rng.choices(syllables, k=rng.randrange(1, 9))) for _ in range(3000)]
    for word in words:
        assert own.encode_piece(word.encode()) == public.encode_ordinary(word)
    assert looks.seen < sum(len(word.encode()) for word in words)


def test_different_pieces_are_remembered(codec):
    """200,000 different pieces asked for a second time are not encoded again."""
    own, text = bpe.Codec(b"\n".join(bpe.base64.b64encode(bytes([x])) + b" %d" % x for x in range(256)), r"\d+"), " ".join(map(str, range(200_000)))
    first, own.encode_piece = own.encode(text), None
    assert own.encode(text) == first and len(first) == sum(len(str(x)) for x in range(200_000))


def test_query_digests(spark, sf, public):
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op4_byte_bpe(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = public.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_edges_and_round_trip(spark, docs):
    path, pattern = bpe.default_tokenizer()
    rows = [(1, None), (2, ""), (3, "Zwölf \U0001f600 \n\n x"), (3, "Zwölf \U0001f600 \n\n x"), (None, "n")]
    ids = bpe.encode_documents(docs(rows), path, pattern)
    back = bpe.decode_tokens(ids, path)
    assert sorted((bytes(r.decoded).decode() for r in back.collect())) == sorted((x or "") for _, x in rows)
    assert bpe.encode_digests(docs({}), path, pattern).collect() == []


def flat(docs_tokens, eod, cut, tail=()):
    stream = [x for d in docs_tokens for x in (*d, eod)] + list(tail)
    data = np.array(stream, "<u2").tobytes()
    return [data[i : i + 2 * cut] for i in range(0, len(data), 2 * cut)]


@pytest.mark.parametrize("cut", [1, 3, 7, 1000])
@pytest.mark.parametrize("super_blocks", [1, 2, 1024])
def test_counts_equal_plain_scan(spark, cut, super_blocks):
    rng = random.Random(cut)
    files = {f: [[rng.randrange(1, 50) for _ in range(rng.choice([0, 0, 1, 5, 20]))] for _ in range(rng.randrange(0, 8))] for f in range(5)}
    tails = {0: (5, 6, 7), 3: (1,)}
    rows = [(f, b, x) for f, d in files.items() for b, x in enumerate(flat(d, 0, cut, tails.get(f, ())))]
    got = t.document_counts(spark.createDataFrame(rows, "file long, block long, data binary"), 0, super_blocks=super_blocks)
    want = [(f, k, len(x), True) for f, d in files.items() for k, x in enumerate(d)] + [(f, len(files[f]), len(x), False) for f, x in tails.items()]
    assert sorted((r.file, r.ordinal, r.n_tokens, r.terminated) for r in got.collect()) == sorted(want)


def test_stream_and_files(spark, docs, tmp_path, codec):
    path, pattern = bpe.default_tokenizer()
    rows = {i: "word " * (i % 7) + "x" * (i % 3) for i in range(60)} | {100: None, 101: ""}
    stream = t.materialize(t.token_stream(docs(rows), path, pattern, 50256, block_tokens=5), "tokens")
    got = {r.doc_id: r.n_tokens for r in t.named_counts(stream, t.document_counts(stream, 50256)).collect()}
    assert got == {i: len(codec.encode(x or "")) for i, x in rows.items()}
    (tmp_path / "a.bin").write_bytes(np.array([3, 4, 0, 0, 9], "<u2").tobytes())
    found = t.document_counts(t.read_token_files(spark, str(tmp_path), block_tokens=2), 0)
    assert sorted((r.ordinal, r.n_tokens, r.terminated) for r in found.collect()) == [(0, 2, True), (1, 0, True), (2, 1, False)]
    empty = t.document_counts(spark.createDataFrame([], "file long, block long, data binary"), 0)
    assert empty.collect() == []


def test_separators_of_the_vocabulary_are_refused(spark, docs):
    path, pattern = bpe.default_tokenizer()
    for eod, width in ((50255, 2), (0, 2), (70_000, 2), (-1, 4)):
        with pytest.raises(ValueError):
            t.token_stream(docs({1: "a"}), path, pattern, eod, width)


def test_files_are_read_by_ranges(spark, tmp_path):
    """Files with any name and number of blocks; a sparse file of over 2 GB has its last blocks read alone."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.bin").write_bytes(np.arange(1, 1001, dtype="<u2").tobytes())
    blocks = t.read_token_files(spark, str(tmp_path / "in"), block_tokens=64)
    whole = b"".join(bytes(r.data) for r in sorted(blocks.collect(), key=lambda r: r.block))
    assert whole == np.arange(1, 1001, dtype="<u2").tobytes()
    (tmp_path / "large").mkdir()
    with open(tmp_path / "large" / "x.bin", "wb") as f:
        f.truncate((1 << 31) + 1000)
        f.seek((1 << 31) + 900)
        f.write(np.array([7, 9], "<u2").tobytes())
    step = 1 << 22
    last = t.read_token_files(spark, str(tmp_path / "large"), block_tokens=step).where("block = 256").collect()
    assert [len(r.data) for r in last] == [1000] and bytes(last[0].data[900:904]) == np.array([7, 9], "<u2").tobytes()


def test_query_counts_equal_encoding(spark, sf):
    counts = {r.doc_id: r.n_tokens for r in t.op8_token_counts(spark, sf).collect()}
    assert counts == {r.doc_id: r.n_tokens for r in bpe.op4_byte_bpe(spark, sf).select("doc_id", "n_tokens").collect()}
