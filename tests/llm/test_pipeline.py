"""The pipeline against a plain version of every stage, and its contract."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as p
from cliploom.llm import bpe, secrets
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_duplicates import brute as classes

tiktoken = pytest.importorskip("tiktoken")


def plain(rows, items):
    rows = {i: r for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    of = classes({i: r.text for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if of[i] == i}
    hit = {i for i, _, spans, _ in contaminated([(i, r.text) for i, r in rows.items()], items) if spans}
    rows = {i: r for i, r in rows.items() if i not in hit}
    owners, repos = defaultdict(set), defaultdict(set)
    for r in rows.values():
        for _, _, _, a, b in secrets.candidates(r.text or ""):
            owners[r.text[a:b]].add(r.source)
            repos[r.text[a:b]].add((r.source, r.lang))
    out = {}
    for i, r in rows.items():
        live = []
        for *_, a, b in secrets.candidates(r.text or ""):
            v = r.text[a:b]
            h = -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())
            copied = len(owners[v]) >= secrets.EXAMPLE_OWNERS or len(owners[v]) > 1 and len(repos[v]) >= secrets.EXAMPLE_REPOS
            if not copied and h >= min(secrets.MIN_ENTROPY, secrets.ENTROPY_SHARE * math.log2(len(v))):
                live.append((a, b))
        text, merged = r.text or "", []
        for a, b in sorted(live):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            text = text[:a] + "[SECRET]" + text[b:]
        out[i] = text
    return out


def test_run_equals_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain(rows, items)
    assert 0 < len(want) < len(rows)
    path, pattern = bpe.default_tokenizer()
    c = bpe.Codec(bpe.rank_bytes(path), pattern)
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=c.rank, special_tokens={})
    got = p.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        ids = public.encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_stages_keep_columns_and_stand_hard_rows(spark, sf, docs):
    rows = docs([(1, "the cat sat on the mat with token = q9X7bLw2RtY5uZ3k"), (1, "the cat"), (None, "the dog and the cat"), (3, None), (4, ""), (5, "一" * 50), (7, "the " * 20_000)])
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, rows, sf)
        assert out.columns == rows.columns, name
        assert len(out.collect()) <= 7
        assert stage(spark, rows.where("false"), sf).collect() == [], name
    assert len(p.STAGES[-1][1](spark, rows, sf).collect()) == 7
    assert [n for n, _ in p.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "tokens"]
