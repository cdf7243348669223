"""Near duplicates against brute force, and the defined edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cliploom.llm import bagminhash as b
from cliploom.llm import components as c
from cliploom.llm.components import components


def bag(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(x, y):
    both = sum((x & y).values())
    return both / max(1, sum((x | y).values()))


def brute(rows, threshold=0.8):
    """Classes by comparing all pairs."""
    ids = sorted(rows)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = {i: bag(rows[i]) for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            alike = jaccard(bags[i], bags[j]) >= threshold if bags[i] or bags[j] else (rows[i] or "") == (rows[j] or "")
            if alike:
                a, c = sorted((find(i), find(j)))
                root[c] = a
    return {i: find(i) for i in ids}


def corpus(seed=1, groups=12):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, n = {}, 0
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 150, 600]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 60)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows[n] = " ".join(own)
            n += 1
        rows[n] = (" ".join(base[:20]) + " ") * rng.randrange(1, 9)
        n += 1
    return rows


def test_classes_equal_brute_force(spark, docs):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in b.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_edge_cases(spark, docs):
    rows = [(5, None), (1, ""), (7, "!!"), (8, "!!"), (9, "??"), (2, "one two"), (3, "One, two."), (4, "one three"), (None, "one two"), (2, "one two")]
    got = sorted(((r.doc_id, r.class_id) for r in b.near_duplicates(docs(rows)).collect()), key=str)
    assert got == sorted([(5, 1), (1, 1), (7, 7), (8, 7), (9, 9), (2, 2), (3, 2), (4, 4), (None, None), (2, 2)], key=str)
    kept = b.keep_one(docs(rows))
    assert kept.columns == docs({}).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 7, 9, 2, 2, 4, None], key=str)


def test_empty_table_and_long_text(spark, docs):
    assert b.near_duplicates(docs({})).collect() == []
    long = " ".join(f"v{k % 9001}" for k in range(120_000))
    got = {r.doc_id: r.class_id for r in b.near_duplicates(docs({1: long, 2: long + " end", 3: "other words that stand alone here"})).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("hub", [400, 20])
def test_hot_group_of_near_copies_and_failures(spark, docs, monkeypatch, hub):
    """Members that are not like their centre are compared with the others; hot buckets and hubs go another way."""
    monkeypatch.setattr(b, "HUB", hub)
    monkeypatch.setattr(c, "HUB", hub)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    rows = {}
    for i in range(120):
        own = list(base)
        own[rng.randrange(300)] = f"x{i}"
        if i % 3 == 0:
            own[100:140] = [f"y{i % 2}{k}" for k in range(40)]
        rows[i] = " ".join(own)
    rows |= {i: "one text that has many exact copies" for i in range(130, 170)}
    got = {r.doc_id: r.class_id for r in b.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_links_out_of_the_centers_class(spark):
    """A bucket whose centre is like none, and one whose rest is like members of the centre's class only."""
    base = [f"w{k}" for k in range(100)]
    edit = lambda *at: " ".join(f"x{k}" if k in at else w for k, w in enumerate(base))
    other = " ".join(f"z{k}" for k in range(100))
    far = {9: edit(), 8: edit(20), 1: edit(20, 50, 80)}
    plain = {19: other, 12: edit(20), 11: edit(20, 50)}
    rows = {**far, **plain}
    texts = spark.createDataFrame([(i, zstandard.compress(t.encode())) for i, t in rows.items()], "id long, z binary")
    key = F.when(F.col("id") < 10, 1).otherwise(2).cast("long")
    signed = texts.select("id", F.lit(96).cast("long").alias("n"), F.array(key).alias("bands"))
    got = {r.id: r.component for r in b.classify(signed, texts, 0.8).collect()}
    want = brute(far) | brute(plain)
    assert {i: got.get(i, i) for i in rows} == want and len(set(want.values())) == 3


def test_overlaps_equal_overlap():
    rng = np.random.default_rng(2)
    bags = []
    for size in (3, 40, 400, 1, 400, 400):
        found, count = np.unique(rng.zipf(1.3, size) % 300, return_counts=True)
        bags.append((found.astype(np.uint64), count))
    assert np.array_equal(b.overlaps(bags[:4], bags), [[b.overlap(x, y) for y in bags] for x in bags[:4]])


def test_repeated_ids_in_any_order(spark, docs):
    """Rows of one id and different texts are classed by their texts."""
    a, c = " ".join(f"a{k}" for k in range(60)), " ".join(f"c{k}" for k in range(60))
    rows = [(5, a), (5, c), (7, c + " end"), (9, a), (9, "a text of its own that stays"), (2, "other words that are alone")]
    want = sorted([(5, 5), (5, 5), (7, 5), (9, 5), (9, 9), (2, 2)])
    for order in (rows, rows[::-1]):
        frame = docs(order).repartition(3)
        assert sorted((r.doc_id, r.class_id) for r in b.near_duplicates(frame).collect()) == want
        assert sorted((r.doc_id, r.text[:6]) for r in b.keep_one(frame).collect()) == sorted([(5, "a0 a1 "), (5, "c0 c1 "), (9, "a text"), (2, "other ")])


def thue_morse(order, x="a", y="b"):
    """Two words that any polynomial hash modulo 2**64 takes for one."""
    for _ in range(order):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("order", [10, 11])
def test_different_texts_of_like_words_stay_apart(spark, docs, order):
    x, y = thue_morse(order)
    rows = {1: x, 2: y, 3: f"{x} b c d e f", 4: f"{y} b c d e f", 5: f"{x}  b c d e f", 6: f"{y} {x} q r s t", 7: f"{x} {y} q r s t"}
    got = {r.doc_id: r.class_id for r in b.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 6, 7: 7}


def test_recall_of_links(spark, docs):
    """Pairs of a similarity around 0.8, each planted alone: those of 0.8 and more are found, no others."""
    rng = random.Random(8)
    rows = {}
    for i in range(0, 600, 2):
        base = [f"p{i}w{k}" for k in range(120)]
        other = list(base)
        for k in rng.sample(range(0, 120, 6), rng.randrange(1, 4)):
            other[k] = f"n{i}{k}"
        rows[i], rows[i + 1] = " ".join(base), " ".join(other)
    got = {r.doc_id: r.class_id for r in b.near_duplicates(docs(rows)).collect()}
    want = brute_pairs(rows)
    assert 50 < len(want) < 300
    linked = {i for i in rows if i % 2 and got[i] != i}
    assert linked <= want and len(linked) >= 0.99 * len(want)


def brute_pairs(rows):
    return {i for i in rows if i % 2 and jaccard(bag(rows[i]), bag(rows[i - 1])) >= 0.8}


def test_any_column_names(spark):
    names = ["doc_id", "text", "id", "sha", "key", "row", "c0", "node", "class_id", "z", "component"]
    frame = spark.createDataFrame([(k, "the same few words here", *["x"] * 9) for k in (1, 2)], names)
    kept = b.keep_one(frame)
    assert kept.columns == names and [r.doc_id for r in kept.collect()] == [1]


def test_signature_estimates_weighted_jaccard():
    """The share of equal registers is unbiased for counts that differ."""
    m = 4096
    one = {1: 1, 2: 3, 3: 7, 4: 20, 5: 1}
    two = {1: 2, 2: 3, 3: 4, 4: 33, 6: 5}
    doc = np.repeat([0, 1], [len(one), len(two)])
    shingle = np.array([*one, *two], np.uint64)
    count = np.array([*one.values(), *two.values()])
    r = b.signatures(doc, shingle, count, 2, m)
    want = sum(min(one.get(k, 0), two.get(k, 0)) for k in {*one, *two}) / sum(max(one.get(k, 0), two.get(k, 0)) for k in {*one, *two})
    assert abs((r[0] == r[1]).mean() - want) < 0.03


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (1, 0)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    many = [(1000 + k, 5000) for k in range(900)] + [(5000, 7000), (7000, 7001)]  # a node with more edges than HUB
    got = {r.id: r.component for r in components(spark.createDataFrame(many, "a long, b long")).collect()}
    assert set(got.values()) == {1000} and len(got) == 903


def template(n, own, seed=4):
    """Texts of 50 common words and some of their own, as pages under one template."""
    rng = random.Random(seed)
    common = [f"t{k}" for k in range(50)]
    return {i: " ".join([*common[:25], *[f"o{i}x{k}" for k in range(own if isinstance(own, int) else rng.choice(own))], *common[25:]]) for i in range(n)}


@pytest.mark.parametrize("block", [512, 4])
def test_large_open_buckets_equal_brute_force(spark, docs, monkeypatch, block):
    """Texts of one template, just alike and just not, in buckets of all sizes; with small blocks all go by rare shingles."""
    monkeypatch.setattr(b, "BLOCK", block)
    rows = template(120, (1, 2, 3, 4, 9)) | {1000 + i: t for i, t in corpus(seed=9, groups=6).items()} | {5000 + i: f"{'a b c d e ' * (i % 4 + 4)} {i}" for i in range(40)}
    got = {r.doc_id: r.class_id for r in b.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_templates_are_compared_in_proportion(spark, docs, monkeypatch):
    """Texts of a similarity of about 0.7 share buckets but no class: what is moved and compared for them grows with their number, not with its square."""
    seen = {}
    plain = b.materialize

    def counted(df, name, *args, **options):
        out = plain(df, name, *args, **options)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(b, "materialize", counted)
    work = {}
    for n in (1000, 4000):
        seen.clear()
        got = b.near_duplicates(docs(template(n, 10))).collect()
        assert all(r.class_id == r.doc_id for r in got)
        small = seen["named"][0].join(seen["open"][0].where("small"), "key").count()
        work[n] = small + sum(seen[k][0].count() for k in ("tokens", "prefixes") if k in seen) + sum(s.agg(F.sum("rows")).first()[0] or 0 for s in seen["sizes"][2:] if "rows" in s.columns)
    assert work[4000] < 6 * work[1000] and work[4000] < 4000 * 80
