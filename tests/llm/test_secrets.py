"""Secret scans against the patterns as written, ownership verdicts and redaction."""

import hashlib
import re
import time

from cliploom.llm import secrets as s

PLAIN = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def plain(text):
    found = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in p.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_query_equals_patterns_as_written(spark):
    sf = "/root/testdata/sf0.01"
    want = texts(spark, sf)
    rows = s.op7_secrets(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        base = plain(want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in PLAIN]
        assert [x for x in r.spans.split(",") if x and not x.startswith("bare")] == base


def test_hard_texts(spark, docs):
    hex24, key = "0123456789abcdef01234567", "AKIA" + "Q" * 16
    hard = {
        1: f"PassWord='{hex24}' x", 2: f"é\U0001f600 token:= abcdef api_key = abc.d-f {key}{key} {hex24[:-1]}", 3: "secret=short secret: = secret=longenough",
        4: f"toKen=abcdefg {hex24}g{hex24} Key paſſword=abcdefg", 5: None, 6: "", 7: "AKIA" * 30 + "a", 8: "token=" + "x" * 100_000,
    }
    got = {r.doc_id: [f"{x.kind}:{x.start}:{x.end}" for x in r.spans if x.kind != "bare"] for r in s.find_secrets(docs(hard)).collect()}
    assert got == {i: plain(t) for i, t in hard.items()}


def test_ownership_separates_examples_from_live(spark, docs):
    copied, own, bare = "Ex4mpleKey0fTheDocs99", "q9X7bLw2RtY5uZ3k", "aB3dE5gH7jK9mN1pQ3sT5"
    rows = {i: f"token = {copied}" for i in range(30)} | {31: f"token = {own} and {bare}", 34: "password=aaaaaaaa"} | {i: f"see {bare}2x" for i in (40, 41, 42)}
    got = {r.doc_id: r.spans for r in s.find_secrets(docs(rows)).collect()}
    assert {x.verdict for i in range(30) for x in got[i]} == {"example"} and got[0][0].owners == 3 and got[0][0].repos == 6
    assert [(x.kind, x.verdict) for x in got[31]] == [("assign", "live"), ("bare", "live")]
    assert got[34][0].verdict == "weak" and got[40] == []


def test_redaction(spark, docs):
    own, hexa = "q9X7bLw2RtY5uZ3k", "0123456789abcdef01234567"
    rows = [(1, f"é token = {own}, then"), (1, "clean"), (2, f"secret={hexa}-Zz9 and {own}"), (3, None), (None, f"api_key: {own}"), (5, "nothing")]
    frame = docs(rows)
    out = s.redact(frame)
    assert out.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, "é token = [SECRET], then"), (1, "clean"), (2, f"secret=[SECRET] and {own}"), (3, None), (None, "api_key: [SECRET]"), (5, "nothing")], key=str)
    assert s.redact(docs({})).collect() == [] and s.find_secrets(docs({})).collect() == []


def test_repositories_and_short_values_decide(spark, docs):
    """Two owners in few repositories share a live value; in many it is an example. Short values are judged by what their length allows."""
    own, spread = "q9X7bLw2RtY5uZ3k", "Ex4mpleKey0fTheDocs99"
    rows = [(i, f"token = {own}", s_, "r1") for i, s_ in ((1, "a"), (2, "b"))] + [(10 + i, f"token = {spread}", "ab"[i % 2], f"r{i // 2}") for i in range(4)]
    rows += [(20 + i, "secret=Zk3#", "a", "r1") for i in range(2)] + [(30 + i, f"api_key={own}1", "a", f"r{i}") for i in range(6)] + [(40, "password=hunter2", "c", "r1"), (41, "password=aaaaab", "c", "r1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: [x.verdict for x in r.spans] for r in s.find_secrets(frame, repo_cols=("source", "repo")).collect()}
    assert got[1] == got[2] == ["live"] and {v for i in range(4) for v in got[10 + i]} == {"example"}
    assert got[20] == [] and {v for i in range(6) for v in got[30 + i]} == {"live"}
    assert got[40] == ["live"] and got[41] == ["weak"]


def test_hot_value(spark, docs):
    """A value of very many candidates goes another way, with the same verdict."""
    rows = {i: "token = Ex4mpleKey0fTheDocs99" for i in range(s.HOT + 50)} | {5000: "token = q9X7bLw2RtY5uZ3k"}
    got = {r.doc_id: [(x.verdict, x.owners) for x in r.spans] for r in s.find_secrets(docs(rows)).collect()}
    assert got.pop(5000) == [("live", 1)] and len(got) == s.HOT + 50 and set(map(tuple, got.values())) == {(("example", 3),)}


def test_redaction_with_any_column_names(spark):
    names = ["doc_id", "text", "source", "lang", "__cuts", "__key", "cuts", "whole", "row", "id", "spans", "hash", "s", "owner0", "body"]
    frame = spark.createDataFrame([(k, "token = q9X7bLw2RtY5uZ3k", "a", "en", *["x"] * 11) for k in (1, 1, 2)], names)
    out = s.redact(frame)
    assert out.columns == names and [r.text for r in out.collect()] == ["token = [SECRET]"] * 3
    assert s.find_secrets(frame).columns == ["doc_id", "spans"]


def test_owners_and_repositories_are_counted_apart(spark):
    """Owners that share repositories don't make more of them."""
    own = "q9X7bLw2RtY5uZ3k"
    rows = [(i, f"token = {own}", o, r) for i, (o, r) in enumerate([("a", "r1"), ("a", "r2"), ("b", "r1"), ("b", "r2")])] + [(9, "token = Ex4mpleKey0fTheDocs99", o, f"r{k}") for k, o in enumerate("aabb")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {(x.owners, x.repos, x.verdict) for r in s.find_secrets(frame, repo_cols=("repo",)).collect() for x in r.spans}
    assert got == {(2, 2, "live"), (2, 4, "example")}
    assert [r.text for r in s.redact(frame, repo_cols=("repo",)).where("doc_id < 4").collect()] == ["token = [SECRET]"] * 4


def test_redaction_takes_time_linear_in_its_cuts(spark):
    n = 40_000
    text = " ".join(f"token=q9X7bLw2Rt{i:06d}" for i in range(n))
    frame = spark.createDataFrame([(1, text, "a", "en"), (2, None, "a", "en")], "doc_id long, text string, source string, lang string")
    start = time.monotonic()
    got = {r.doc_id: r.text for r in s.redact(frame).collect()}
    assert got == {1: " ".join(["token=[SECRET]"] * n), 2: None} and time.monotonic() - start < 120


def test_masked():
    assert s.masked("abcdefgh", [(1, 3), (2, 4), (4, 5), (7, 8)], "_") == "a__fg_" and s.masked("", [], "_") == "" and s.masked(None, [], "_") is None
