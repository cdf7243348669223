"""Benchmark decontamination against marking every window by hand."""

import random
import re

import numpy as np
import pytest

from cliploom.llm import decontaminate as d


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, text in items:
        w = split(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w = split(text)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    found |= wins[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        spans, k = [], 0
        while k < len(w):
            e = k
            while e < len(w) and hit[e]:
                e += 1
            if e > k:
                spans.append((k, e))
            k = max(e, k + 1)
        out.append((i, len(w), spans, sorted(found)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("block", [200_000, 7])
def test_equals_brute_force(spark, docs, block):
    rng = random.Random(block)
    vocabulary = ["the", "of"] * 6 + [f"w{k}" for k in range(30)] + ["Ünï", "x-y"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 3, 9, 10, 11, 40]))) for k in range(14)] + [(3, "dup " * 12), (None, say(10)), (90, None), (91, ""), (92, "..."), (93, items_text := say(12)), (94, items_text)]
    rows = [(k, " ".join([say(rng.randrange(20)), rng.choice(items)[1] or "", say(rng.randrange(9)), "dup " * rng.randrange(15)])) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "!?"), (None, say(30)), (5, rows[5][1]), (103, "the of " * 5000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(d.find_contamination(docs(rows), bench, max_block_windows=block)) == brute(rows, items)


def test_empty_sides(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(d.find_contamination(docs({1: "a b"}), none)) == [(1, 2, [], [])]
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert got(d.find_contamination(docs({}), some)) == []


def test_windows_never_cross_documents(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert got(d.find_contamination(docs([(1, "x a b"), (2, "c d"), (3, "A, b; C-d")]), bench)) == [(1, 3, [], []), (2, 2, [], []), (3, 4, [(0, 4)], ["1"])]


@pytest.mark.parametrize("block", [200_000, 0])
def test_words_of_equal_polynomial_hash(spark, docs, block):
    """A long word that differs is not the item's word."""
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    say = lambda word: " ".join([f"u{k}" for k in range(5)] + [word] + [f"v{k}" for k in range(5)])
    bench = spark.createDataFrame([("i1", say(x)), ("i2", x), ("i3", f"{x} {y}")], "item_id string, text string")
    rows = [(1, say(x)), (2, say(y)), (3, f"q {y}"), (4, f"{y} {x}"), (5, f"{x} {y}")]
    assert got(d.find_contamination(docs(rows), bench, max_block_windows=block)) == brute(rows, [("i1", say(x)), ("i2", x), ("i3", f"{x} {y}")])


def test_frequent_prefixes_by_shuffle(spark, docs):
    """A frequent prefix is salted; both forms give the same."""
    rows = [(k, "the same few words in every document " * 3 + f"and a tail {k} one two three four five six seven eight nine {k % 4}") for k in range(200)]
    items = [(k, f"in every document the same few words in every {k % 2}") for k in range(3)] + [(9, "the same few words in every document the same few"), (10, "same"), (11, "one two three four five six seven eight nine 3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    large = d.find_contamination(docs(rows), bench, max_block_bytes=10)
    assert got(large) == got(d.find_contamination(docs(rows), bench)) == brute(rows, items)


def test_rounds_of_bit_tables(spark, docs, monkeypatch):
    """More tokens than one table may hold are taken in rounds, with the same result."""
    monkeypatch.setattr(d, "MOST_BITS", 10)
    monkeypatch.setattr(d, "LEAST_BITS", 8)
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 11, 20]))) for k in range(40)]
    rows = [(k, f"{say(9)} {rng.choice(items)[1]} {say(9)}") for k in range(40)]
    tokens = spark.createDataFrame([(rng.getrandbits(63) * rng.choice((1, -1)),) for _ in range(500)], "token long")
    made = list(d._sieves(tokens))
    assert len(made) > 4 and all(s.size == 10 for s in made)
    g = np.array([r.token for r in tokens.collect()], np.int64).view(np.uint64)
    passed = np.concatenate([s.passing(g) for s in made])
    assert sorted(passed.tolist()) == list(range(500))  # each token in its own round, once
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(d.find_contamination(docs(rows), bench, max_block_windows=0)) == brute(rows, items)


@pytest.mark.parametrize("block", [200_000, 0])
def test_one_window_in_very_many_items(spark, docs, block):
    shared = " ".join(f"s{k}" for k in range(10))
    items = [(k, shared if k % 10 else f"{shared} own{k}") for k in range(10_000)]
    rows = [(1, f"x {shared} y"), (2, f"{shared} own20"), (3, "s0 s1")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_words, [tuple(x) for x in r.spans], r["items"]) for r in d.find_contamination(docs(rows), bench, max_block_windows=block).collect()}
    every = sorted(str(k) for k in range(10_000))
    assert found == {1: (12, [(1, 11)], every), 2: (11, [(0, 11)], every), 3: (2, [], [])}
