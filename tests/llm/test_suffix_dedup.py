"""Removal of repeated strings against judging every string by hand."""

import hashlib
import random

import numpy as np
import pytest

from cliploom.llm import suffixdedup as s


def brute(rows, length):
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - length + 1):
                w = raw[k : k + length]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for k in range(len(raw) - length + 1):
                if least[raw[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in frame.collect()), key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcé \n") for _ in range(rng.choice([30, 49, 50, 51, 70, 200]))) for _ in range(12)] + ["ab" * 60, "a" * 130, " " * 60]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6)))) for i in range(n)]
    rng.shuffle(rows)
    return rows + [(1000, None), (1001, ""), (None, parts[5] * 2), (7, parts[5]), (7, parts[5])]


@pytest.mark.parametrize(("length", "pack"), [(50, 2 << 20), (50, 300), (16, 500), (8, 400), (5, 1000)])
def test_equals_brute_force(spark, docs, length, pack):
    rows = corpus(length + pack)
    assert got(s.remove_repeats(docs(rows), length, pack_bytes=pack)) == brute(rows, length)


def test_hot_minimisers_are_cut_into_strings(spark, docs):
    rng = random.Random(9)
    line = "the line that everyone copies, word for word, everywhere!"
    rows = [(i, "".join(rng.choice("abc ") for _ in range(40)) + line + "".join(rng.choice("abc ") for _ in range(rng.choice([3, 40])))) for i in range(60)]
    p = s.open_pack(np.arange(60).tobytes(), np.array([len(t) for _, t in rows]).tobytes(), s.zstandard.compress("".join(t for _, t in rows).encode()), 50)
    fp, many, kinds = s.distinct_fps(p)
    assert kinds.max() > 20
    b = s.bucket_of(fp, 3)
    answer = [{"bucket": k, "bits": np.packbits(many[b == k]).tobytes(), "hot": np.packbits(many[b == k]).tobytes()} for k in range(3)]
    some, start, doc = s.candidates(p, answer, 50, 3)
    assert not len(some.start) and len(start) == len(doc) == p.count[np.isin(p.fp, fp[many])].sum()
    text = [p.data[a : a + 50].tobytes() for a in start]
    single = s.Strings(p, start, doc, 50)
    assert [single.text[k] for k in single.of] == text and len(single.text) == len(set(text))
    want = brute(rows, 50)
    assert got(s.remove_repeats(docs(rows), pack_bytes=100)) == want
    for groups in (50_000, 7):  # packs in one group, and in several
        assert got(s.remove_repeats(docs(rows), pack_bytes=100, hot_segments=5, group_packs=groups)) == want


def test_long_text_and_kept_bytes(spark, docs):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    rows = [(1, long), (2, "start " + long[1000:150_000] + " end"), (3, "none of it")]
    out = {r.doc_id: bytes(r.kept) for r in s.remove_repeats(docs(rows), with_text=True).collect()}
    assert out[1] == long.encode() and out[3] == b"none of it"
    assert len(out[2]) <= 10 and b"start  end".startswith(out[2][:5]) and out[2].endswith(b"end")
    assert s.remove_repeats(docs({})).collect() == []


@pytest.mark.parametrize("length", [3, 8, 16, 50])
def test_suffix_sort_orders_and_groups(length):
    rng = np.random.default_rng(length)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    places = np.arange(len(data) - length + 1)
    rng.shuffle(places)
    number = s.suffix_groups(data, places, length)
    strings = [data[p : p + length].tobytes() for p in places]
    rank = {t: k for k, t in enumerate(sorted(set(strings)))}
    assert number.tolist() == [rank[t] for t in strings]


def test_blocks_keep_equal_strings_together(monkeypatch):
    monkeypatch.setattr(s, "SORT_BLOCK", 100)
    data = np.random.default_rng(0).integers(0, 2, 3000).astype(np.uint8)
    places = np.arange(len(data) - 15)
    strings = [data[p : p + 16].tobytes() for p in places]
    pairs = set(zip(s.suffix_groups(data, places, 16).tolist(), strings, strict=True))
    assert len(pairs) == len({n for n, _ in pairs}) == len(set(strings))


def test_collisions_are_noticed(monkeypatch):
    """Under a base of 1 the hash is a sum, so permuted strings collide; the sort starts again with another base."""
    from cliploom.llm.common import Powers

    data = np.frombuffer(b"abcdefgh12345678" * 2 + b"12345678abcdefgh" * 2 + b"bacdefgh12345678", np.uint8)
    places = np.arange(len(data) - 15)
    with pytest.raises(s.Collision):
        s._suffix_groups(data, places, 8, Powers(1))
    monkeypatch.setattr(s, "POWERS", Powers(1))
    number = s.suffix_groups(data, places, 8)
    strings = [data[p : p + 8].tobytes() for p in places]
    assert number.tolist() == [sorted(set(strings)).index(t) for t in strings]


def test_counts_of_segments_are_true():
    counts = np.array([0, 1, 254, 255, 256, 100_000, 3])
    packed = s._small_first(counts)
    assert s._counts(packed, len(counts)).tolist() == counts.tolist() and len(packed) == 7 + 12
    assert s._counts(s._small_first(counts[:3]), 3).tolist() == [0, 1, 254]


def test_a_string_of_very_many_packs(spark):
    """A licence line that every pack has gets its verdict by broadcast; each pack's own strings by a join."""
    rows = [(b"line", p, 0, 10 + p) for p in range(900)] + [(b"own%d" % p, p, 1, p) for p in range(900)] + [(b"pair", 3, 2, 5), (b"pair", 4, 2, 4)]
    sent = spark.createDataFrame(rows, "string binary, pack long, k int, least long")
    got = {r.pack: sorted(r.known) for r in s.judge_strings(sent).collect()}
    assert got == {p: [0, 2] if p == 3 else [0] for p in range(1, 900)}


def test_rows_grow_with_the_input():
    """A row goes from each pack to each bucket; at 250 bytes of text a row, rows took more time than the sort."""
    for gigabytes in (0.2, 1, 11, 50):
        total = int(gigabytes * 1e9)
        for partitions in (12, 200, round(60 * gigabytes), 5000):
            buckets, tasks, pack = s.sizes_for(total, partitions)
            assert total / buckets < 2 * s.MOST_BUCKET_BYTES and pack <= s.MOST_PACK_BYTES and tasks >= partitions
            assert pack / buckets >= 1200, (total, partitions)
    assert s.sizes_for(0, 1) == (1, 1, s.PACK_BYTES)


def test_strings_alike_by_chance_stay_at_home(spark, docs):
    """Texts that have only grams of 16 bytes in common share no minimiser."""
    rng = random.Random(4)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(16)) for _ in range(40)]
    packs = [s.open_pack(np.arange(20).tobytes(), np.array([len(t) for t in texts]).tobytes(), s.zstandard.compress("".join(texts).encode()), 50) for texts in [["".join(rng.choice(parts) + rng.choice("uvwxyz") for _ in range(60)) for _ in range(20)] for _ in range(2)]]
    shared = np.isin(packs[0].fp, packs[1].fp).mean()
    assert len(packs[0].fp) > 500 and shared < 0.5, shared


@pytest.mark.parametrize("part_bytes", [1, 200, 2000])
def test_a_bucket_is_sorted_in_parts(spark, docs, monkeypatch, part_bytes):
    """Parts of any size give the same verdicts, with segments of several parts in a row of a pack."""
    rows = corpus(11)
    least = {}
    for i, t in rows:
        for k in range(len((t or "").encode()) - 49):
            if i is not None:
                w = t.encode()[k : k + 50]
                least[w] = min(least.get(w, i), i)
    sent = []
    for p in range(3):
        some = [(i, t.encode()) for i, t in rows[p::3] if i is not None and t]
        pack = s.open_pack(np.array([i for i, _ in some]).tobytes(), np.array([len(t) for _, t in some]).tobytes(), s.zstandard.compress(b"".join(t for _, t in some)), 50)
        d = s.Distinct(pack, s.Segments(pack.start, pack.count, pack.doc, pack.fp), 50, 1)
        sent.append((p, [d.text[k] for k in d.order], d.least[d.order], d.part[d.order]))
    frame = spark.createDataFrame([(0, p, np.array([len(t) for t in texts], np.int32).tobytes(), ids.tobytes(), part.tobytes(), s.zstandard.compress(b"".join(texts))) for p, texts, ids, part in sent], "bucket long, pack long, sizes binary, least binary, part binary, z binary")
    monkeypatch.setattr(s, "PART_BYTES", part_bytes)
    assert len({x for *_, part in sent for x in part.tolist()}) > 20
    got = {r["pack"]: r["bits"] for r in s.judge_segments(frame, 50, 2).collect()}
    for p, texts, ids, _ in sent:
        want = [least[t[k : k + 50]] < i for t, i in zip(texts, ids.tolist(), strict=True) for k in range(len(t) - 49)]
        assert np.unpackbits(np.frombuffer(got[p], np.uint8), count=len(want)).tolist() == want
