"""Vector codes and centroid clusters against brute force in plain integers, and their SQL; the search kernels at work."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from cliploom.llm import codebooks, kdclusters, vectors
from cliploom.llm.registry import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<{}>, label int, part int, v string, cluster int, row string"


def whole(v):
    return [math.floor(Fraction(x) * 1024) for x in v]


def good(v, dim):
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def moved(points, books, owners):
    return [[sum(p[i] for p, o in zip(points, owners, strict=True) if o == e) // owners.count(e) for i in range(len(c))] if e in owners else c for e, c in enumerate(books)]


def fits(n):
    return n if n is not None and n < 1 << 63 else None


def brute_codes(rows, entries, dim=64, parts=4, rounds=4):
    kept = sorted((r for r in rows if good(r[1], dim)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = dim // parts
    cut = [[whole(r[1])[p * w : (p + 1) * w] for r in kept] for p in range(parts)]
    books, best = [c[:entries] for c in cut], lambda book, x: min(range(len(book)), key=lambda e: (apart(book[e], x), e))
    for _ in range(rounds):
        books = [moved(c, b, [best(b, x) for x in c]) for b, c in zip(books, cut, strict=True)]
    found = [[best(b, x) for x in c] for b, c in zip(books, cut, strict=True)]
    sha = hashlib.sha256(",".join(str(n) for b in books for e in b for n in e).encode()).hexdigest()
    errors = [sum(apart(books[p][found[p][i]], cut[p][i]) for p in range(parts)) for i in range(len(kept))]
    of = lambda label: [e for e, r in zip(errors, kept, strict=True) if r[2] == label]
    label = lambda r: fits(sum(of(r[2]))) if all(fits(e) is not None for e in of(r[2])) else None
    return sorted(repr((r[0], "".join(f"{found[p][i]:02x}" for p in range(parts)), fits(errors[i]), label(r), sha)) for i, r in enumerate(kept))


def brute_clusters(rows, k, dim=64, rounds=10, seed=3):
    kept = sorted((r for r in rows if good(r[1], dim)), key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    x = [whole(r[1]) for r in kept]
    z, best = x[:k], lambda z, v: min(range(len(z)), key=lambda e: (apart(z[e], v), e))
    for _ in range(rounds):
        z = moved(x, z, [best(z, v) for v in x])
    of = [best(z, v) for v in x]
    d = [apart(z[c], v) for c, v in zip(of, x, strict=True)]
    sha = lambda c: hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()
    return sorted(repr((r[0], of[i], fits(d[i]), fits(sum(e for e, c in zip(d, of, strict=True) if c == of[i])), fits(sum(d)), sha(of[i]))) for i, r in enumerate(kept))


def table(kind="some", seed=4, n=70):
    """Ties, repeated rows and ids, nulls of every sort, wrong lengths; coarse values make many equal distances."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = rng.choice((0.0, 0.5, -1.25))
        v = [base + rng.randrange(-3, 4) / 64 + rng.choice((0, 1e-4)) for _ in range(64)]
        rows.append((i, v, rng.choice((None, 0, 1, 2)), 1, "x", 2, "y"))
    rows += [rows[3], rows[3], (3, rows[4][1], 9, 1, "x", 2, "y"), (None, rows[5][1], None, None, None, None, None), (None, rows[6][1], 1, 1, "x", 2, "y")]
    rows += [(900, None, 1, 1, "x", 2, "y"), (901, [], 1, 1, "x", 2, "y"), (902, [0.5] * 63, 1, 1, "x", 2, "y"), (903, [0.5] * 63 + [None], 1, 1, "x", 2, "y")]
    rows += [(904 + i, [0.5] * 63 + [bad], 1, 1, "x", 2, "y") for i, bad in enumerate((math.nan, math.inf, -math.inf))]
    rows += [(-5, [0.25] * 64, 3, 1, "x", 2, "y")] * 3
    if kind == "large":
        rows += [(2000 + i, [rng.choice((1e6, -1e6, 3.5e4)) * rng.random() for _ in range(64)], 7, 1, "x", 2, "y") for i in range(9)]
    if kind == "huge":
        rows += [(2000, [1e30] * 64, 7, 1, "x", 2, "y"), (2001, [-1e300] * 64, None, 1, "x", 2, "y")]
    return [r for r in rows if kind != "few" or (r[0] or 0) < 5] if kind != "empty" else []


KINDS = ("some", "large", "huge", "few", "empty")


@pytest.mark.parametrize("kind", KINDS)
def test_codes_equal_brute_force(spark, kind):
    rows = table(kind)
    df = spark.createDataFrame(rows, SCHEMA.format("double")).repartition(3)
    got = codebooks.compress(df, entries=24)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_codes(rows, 24)


@pytest.mark.parametrize("kind", [k for k in KINDS if k != "huge"])
def test_clusters_equal_brute_force(spark, kind):
    rows = table(kind)
    df = spark.createDataFrame(rows, SCHEMA.format("double")).repartition(3)
    got = kdclusters.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_clusters(rows, 8)


def test_distances_beyond_long_are_null(spark):
    rows = [(i, [x] * 64, None, 1, "x", 2, "y") for i, x in enumerate((1e30, 1e29, 0.5))]
    got = kdclusters.cluster(spark.createDataFrame(rows, SCHEMA.format("double")), clusters=1, rounds=1).collect()
    assert len(got) == 3 and all(r.distance is None and r.inertia is None and r.cluster == 0 for r in got)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_centroid_clusters"])
@pytest.mark.parametrize("kind", ["some", "few", "empty"])
def test_sql(spark, tmp_path, name, kind):
    rows = table(kind, seed=8, n=300)
    spark.createDataFrame([r[:3] for r in rows], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(repr, want.select(*columns).fetchall()))


def test_a_hot_label_goes_apart(spark, monkeypatch):
    rows = [(i, [float(i % 7)] * 64, 5 if i % 3 else i, 1, "x", 2, "y") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA.format("float"))
    monkeypatch.setattr(codebooks, "SHARE", 4)
    got = codebooks.compress(df, entries=4, rounds=1)
    sums = {}
    for r in got.collect():
        label = 5 if r.vec_id % 3 else r.vec_id
        sums.setdefault(label, []).append((r.error, r.label_error))
    assert len(sums[5]) >= 600 and all(sum(e for e, _ in v) == total for v in sums.values() for _, total in v)


def test_exponion_scans_part_of_the_list():
    rng = np.random.default_rng(0)
    centers = rng.integers(-4000, 4000, (256, 16))
    x = centers[rng.integers(0, 256, 5000)] + rng.integers(-200, 200, (5000, 16))
    book = codebooks.Book(centers)
    plain = vectors.squares(x, centers)
    start, _ = book.nearest(x, np.zeros(5000, np.int64))
    assert (start == plain.argmin(axis=1)).all()
    reach = np.searchsorted
    scanned = sum(int(reach(book.apart[a], 4 * plain[i, a], side="right")) for i, a in enumerate(start))
    assert scanned < 5000 * 256 / 50  # from the right entry hardly anything is in reach


def test_filtering_prunes_nodes():
    rng = np.random.default_rng(1)
    z = rng.integers(-4000, 4000, (8, 64))
    x = (z[rng.integers(0, 8, 2000)] + rng.integers(-100, 100, (2000, 64))).astype(np.int32)
    tree = kdclusters.build(x)
    owner, count, sums = kdclusters.assign(tree, z)
    y = tree["x"].astype(np.int64)
    assert (owner == vectors.squares(y, z).argmin(axis=1)).all() and count.sum() == 2000
    assert all((sums[c] == y[owner == c].sum(axis=0)).all() for c in range(8))
    tree["x"] = np.zeros_like(tree["x"])  # whole nodes are assigned without their vectors
    again, n, s = kdclusters.assign(tree, z)
    assert (again == owner).mean() > 0.5 and (n > 0).all()
