"""URL filters: parsing as stated, stated rules, and mined rules against counting all subsets."""

from collections import Counter
from itertools import combinations

import pytest

from cliploom.llm import urlfilter as u

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://a.example.net", "http://example.net?x=/en/", "ftp://x://y/z", "http://b.example.com/de/1", "http://example.com/DE/1",
    "http://myexample.com/de/1", "http://ORG/fr/", "http://ÄB.org/fr/é", "http://x.org/fr", "http://x.net#/a", "http://x.org/en/a.HTML", "//x.org/fr/", "http://a\nb.org/fr/\nq",
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:stop]


def stated(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in u.STATED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def tokens(host, path):
    out = []
    if host:
        labels = host.split(".")
        out += ["h:" + ".".join(labels[-k:]) for k in (1, 2, 3) if len(labels) >= k]
    out += [f"p{k}:{x}" for k, x in enumerate([x for x in path.split("/") if x][:3], 1)]
    last = path.rsplit(".", 1)[-1]
    if "." in path and 1 <= len(last) <= 5 and last.isascii() and last.isalnum():
        out.append("x:" + last.lower())
    return sorted(set(out))


def brute(urls):
    rows = [(*parse(x), *stated(*parse(x))) for x in urls]
    every, by = Counter(), Counter()
    n = sum(r[3] is not None for r in rows)
    subsets = lambda t: [c for k in range(1, len(t) + 1) for c in combinations(t, k)]
    for host, path, _, v in rows:
        if v:
            for s in subsets(tokens(host, path)):
                every[s] += 1
                by[s, v] += 1
    rules = {(s, v): (c / every[s], c / n) for (s, v), c in by.items() if c >= -(-n * u.MIN_SUPPORT // 1) and c / every[s] >= u.MIN_CONFIDENCE}
    out = []
    for host, path, rule, v in rows:
        if not v:
            fired = [(*rules[s, x], x) for s in subsets(tokens(host, path)) for x in ("allow", "block") if (s, x) in rules]
            v = max(fired)[2] if fired else "allow"
        out.append((host, path, rule, v))
    return out


def frame(spark, urls):
    return spark.createDataFrame([(i, x, "h") for i, x in enumerate(urls)], "page_id long, url string, host string")


@pytest.mark.parametrize("many", [1, 40])
def test_equals_brute_force(spark, many):
    urls = URLS + [f"http://{a}.example.{b}/{c}/{i}.{'php' if i % 3 else 'htm'}" for i in range(many) for a in "xy" for b in ("net", "com", "org", "edu") for c in ("en", "de", "fr")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge_urls(frame(spark, urls)).collect()}
    assert got == dict(enumerate(brute(urls)))


def test_nothing_labelled_and_empty(spark):
    got = u.judge_urls(frame(spark, ["http://x.edu/a", None])).collect()
    assert sorted((r.page_id, r.verdict, r.source) for r in got) == [(0, "allow", "default"), (1, "allow", "default")]
    assert u.judge_urls(frame(spark, []).limit(0)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://b.net/")], "page_id long, url string")
    assert sorted(str((r.page_id, r.rule, r.verdict)) for r in u.judge_urls(rows).collect()) == sorted(map(str, [(1, "net/", "block"), (1, "net/", "block"), (None, "net/", "block")]))


def test_redundant_rules_are_pruned(spark):
    rows = spark.createDataFrame([(["a", "b"], "block")] * 5 + [(["a"], "block")] * 3 + [(["c"], "allow")] * 4, "tokens array<string>, verdict string")
    got = {(tuple(r.tokens), r.verdict) for r in u.mine(rows).collect()}
    assert got == {(("a",), "block"), (("b",), "block"), (("c",), "allow")}
