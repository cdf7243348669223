"""SimHash against its definition and all pairs, chains against plain Hamming distances, and hot cells."""

import random
import re

import numpy as np
import pytest
import xxhash

from cliploom.llm import simhash as s


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(points, threshold=4):
    """The least point reachable, by all pairs."""
    points = sorted(set(points))
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for n, p in enumerate(points):
        for q in points[:n]:
            if (p ^ q).bit_count() <= threshold:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in points}


def corpus():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "é É x y a B c"), (None, "one"), (None, "nobody else says this at all"), (9, "a b c d " * 30_000)]
    for at in range(20, 400, 12):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice((5, 60, 900)))]
        for k in range(rng.choice((1, 2, 11))):
            near = list(words)
            for _ in range(rng.randrange(4)):
                near[rng.randrange(len(near))] = f"X{rng.randrange(900)}"
            rows.append((at + k, rng.choice((" ", "\n")).join(near)))
    rows += [rows[-1], (20, rows[-2][1])]
    return rows


@pytest.mark.parametrize("chunk", [1024, 3])
def test_equals_brute_force(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(s, "CHUNK", chunk)
    rows = corpus()
    fps = [plain(t) for _, t in rows]
    root = classes(fps)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    got = s.near_copies(docs(rows).repartition(5))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = [(i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert len({c for _, _, c in want}) < len(set(fps))  # some fingerprints that differ are linked


@pytest.mark.parametrize("chunk, share", [(1024, 4096), (20, 3)])
def test_classes_of_fingerprints(spark, monkeypatch, chunk, share):
    """Dense balls, chains of links and single fingerprints; with small chunks most cells have several."""
    monkeypatch.setattr(s, "CHUNK", chunk)
    rng = random.Random(7)
    flip = lambda p, n: p ^ sum(1 << b for b in rng.sample(range(64), n))
    center = rng.getrandbits(64)
    points = {flip(center, rng.randrange(1, 6)) for _ in range(500)} | {rng.getrandbits(64) for _ in range(300)} | {0, 1, (1 << 64) - 1}
    walk = rng.getrandbits(64)
    for _ in range(120):
        points.add(walk := flip(walk, rng.choice((3, 4, 4, 5))))
    points |= {(center & ~0x1FFF) | rng.getrandbits(13) for _ in range(60)} | {(rng.getrandbits(51) << 13) | (center & 0x1FFF) for _ in range(200)}
    root = classes(points)
    nodes = spark.createDataFrame([(s._signed(p), 1) for p in points], "fp long, rows long")
    by = {}
    for r in s.link(nodes).collect():
        by.setdefault(r["class"], set()).add(r.fp % (1 << 64))
    want = {}
    for p, c in root.items():
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def test_every_near_pair_has_a_chain():
    rng = np.random.default_rng(0)
    for segments, threshold in ((5, 4), (6, 4), (8, 3), (2, 1)):
        ring = s.Ring(segments, threshold)
        for _ in range(2000):
            bits = rng.choice(64, rng.integers(0, threshold + 1), replace=False)
            differ = sum(1 << int(b) for b in bits)
            chained = [not differ >> ring.low[i] & (1 << ring.width[i]) - 1 and all((differ & m).bit_count() <= n for m, n in ring.chains[i]) for i in range(segments)]
            assert any(chained)
    with pytest.raises(ValueError):
        s.Ring(4, 4)


def test_chains_prune_before_the_full_count():
    ring = s.Ring(5, 4)
    rng = np.random.default_rng(1)
    differ = rng.integers(0, 1 << 63, 100_000, dtype=np.int64).astype(np.uint64) & ~np.uint64(0x1FFF)
    mask, budget = ring.chains[0][0]
    assert (np.bitwise_count(differ & np.uint64(mask)) <= budget).mean() < 0.01


def test_empty(spark, docs):
    got = s.near_copies(docs({}))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0
