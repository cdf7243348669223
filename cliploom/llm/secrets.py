"""Secret scans whose verdict is corpus-wide ownership.

Patterns find candidates in each text. Every candidate value is hashed, and the
hashes are aggregated by distinct owners and repositories over the whole corpus:
a value of several owners, or of two owners in several repositories, is a copied example (documentation, test
fixtures); any other value that looks random for its length is a live-looking credential of its owner,
who may use it in several repositories.
Besides the three base kinds, bare high-entropy strings are candidates; they
become spans (kind ``bare``) only where ownership shows that they are owner-specific.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, worker

KINDS = ("assign", "access", "hex", "bare")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A bare candidate: so many characters of the value alphabet, with a digit and letters of both cases.
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", re.S)
#: A value of so many owners, or of two owners and so many repositories, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 4
#: Bits per character of a live-looking value; of a short one, this share of what its length allows.
MIN_ENTROPY, ENTROPY_SHARE = 3.0, 0.8
#: A value of more than this share of all candidates (and of more than HOT candidates) is hot: its verdict is broadcast.
HOT, HOT_SHARE = 1000, 4096
SPAN = "struct<kind:string,start:int,end:int,vstart:int,vend:int,hash:string,entropy:double>"


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def candidates(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) in code points, by start and kind.

    Base kinds are leftmost and don't overlap within a kind; bare ones keep clear of all base spans.
    """
    found = []
    low = text.lower()  # may only find more keywords than the pattern, never fewer
    if any(k in low for k in KEYWORDS):
        found += [(0, m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _, _ in found)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    for m in BARE.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that start before this one ends
        if (not before or reach[before - 1] <= m.start()) and MIXED.match(m[0]):
            found.append((3, m.start(), m.end(), m.start(), m.end()))
    found.sort(key=lambda x: (x[1], x[0]))
    return [(KINDS[k], *rest) for k, *rest in found]


def scan(docs: DataFrame, id_col: str, text_col: str, owner_cols: tuple[str, ...], repo_cols: tuple[str, ...]) -> DataFrame:
    """Rows (row, id, owner, repo, spans): one for each row of docs; ``row`` numbers them."""

    def name(cols):
        return F.to_json(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols]))

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), name(owner_cols).alias("owner"), name(repo_cols).alias("repo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("vstart", pa.int32()), ("vend", pa.int32()), ("hash", pa.string()), ("entropy", pa.float64())]
        names = [n for n, _ in fields]
        for batch in batches:
            spans = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                mine = []
                for span in candidates(text):
                    value = text[span[3] : span[4]]
                    mine.append(dict(zip(names, (*span, hashlib.sha256(value.encode()).hexdigest()[:32], entropy(value)), strict=True)))
                spans.append(mine)
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column("id"), batch.column("owner"), batch.column("repo"), pa.array(spans, pa.list_(pa.struct(fields)))], ["row", "id", "owner", "repo", "spans"])

    return source.mapInArrow(worker(run), f"row long, id {dict(source.dtypes)['id']}, owner string, repo string, spans array<{SPAN}>")


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ("source",), repo_cols: tuple[str, ...] = ("source", "lang"),
    example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, min_entropy: float = MIN_ENTROPY,
) -> DataFrame:
    """Returns id_col and spans: one row for each row of docs.

    A span has kind, start, end (code points, end exclusive), the value's own
    vstart and vend, its hash, entropy, owners, repos (distinct, over all docs) and
    verdict: ``example`` for a value of ``example_owners`` owners at least, or of two owners and ``example_repos``
    repositories at least; ``live`` for any other of ``min_entropy`` bits a character at least, or of
    ENTROPY_SHARE of the most that its length allows if that is less; else ``weak``. Spans stand by start,
    then kind. Null and empty texts have none. A null owner counts as the owner named by
    the empty string. Repeated rows give repeated rows and count once among owners.
    """
    scanned = materialize(scan(docs, id_col, text_col, owner_cols, repo_cols), "secrets")
    each = scanned.where("size(spans) > 0").select("row", "owner", "repo", F.explode("spans").alias("s")).select("row", "owner", "repo", "s", F.col("s.hash").alias("hash"))
    # Distinct (value, repository, owner) first, so that a value that is everywhere is a few rows; of these, distinct owners and distinct repositories.
    owned = each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    owned = owned.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"), F.sum("n").alias("n"))
    owned = materialize(owned, "owners")
    limit = max(HOT, (owned.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(owned.where(F.col("n") > limit))  # HOT_SHARE rows at most
    told = each.join(hot.select("hash"), "hash", "left_anti").join(owned.where(F.col("n") <= limit), "hash").unionByName(each.join(hot, "hash"))
    copied = (F.col("owners") >= example_owners) | ((F.col("owners") >= 2) & (F.col("repos") >= example_repos))
    bits = F.least(F.lit(float(min_entropy)), F.lit(ENTROPY_SHARE) * F.log2(F.col("s.vend") - F.col("s.vstart")))
    verdict = F.when(copied, "example").when(F.col("s.entropy") >= bits, "live").otherwise("weak")
    judged = told.select("row", "s", "owners", "repos", verdict.alias("verdict")).where("s.kind <> 'bare' or verdict = 'live'")
    order = F.when(F.col("s.kind") == "assign", 0).when(F.col("s.kind") == "access", 1).when(F.col("s.kind") == "hex", 2).otherwise(3)
    fields = ["kind", "start", "end", "vstart", "vend", "hash", "entropy"]
    whole = F.struct(F.col("s.start").alias("at"), order.alias("o"), *[F.col(f"s.{f}").alias(f) for f in fields], "owners", "repos", "verdict")
    lists = judged.groupBy("row").agg(F.array_sort(F.collect_list(whole)).alias("found"))
    lists = lists.select("row", F.transform("found", lambda x: F.struct(*[x[f].alias(f) for f in [*fields, "owners", "repos", "verdict"]])).alias("found"))
    out = scanned.where("size(spans) > 0").select("row", "id").join(lists, "row", "left").select("id", F.coalesce("found", F.array().cast(dict(lists.dtypes)["found"])).alias("spans"))
    none = scanned.where("size(spans) = 0").select("id", F.array().cast(dict(lists.dtypes)["found"]).alias("spans"))
    return out.unionByName(none).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", owner_cols: tuple[str, ...] = ("source",), repo_cols: tuple[str, ...] = ("source", "lang"), mask: str = "[SECRET]", **options) -> DataFrame:
    """The rows of docs, with the values of live-looking spans replaced in the text.

    All columns stay, whatever their names; rows without such a span stay as they are. Values that overlap are
    replaced together.
    """
    # A whole row is the id of its spans, so rows keep apart without a key.
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    named = {kind: {f"{kind}{i}": F.col(f"`{c}`") for i, c in enumerate(cols)} for kind, cols in (("owner", owner_cols), ("repo", repo_cols))}
    source = docs.select(row.alias("whole"), F.col(f"`{text_col}`").alias("body"), *[c.alias(k) for cols in named.values() for k, c in cols.items()])
    found = find_secrets(source, "whole", "body", tuple(named["owner"]), tuple(named["repo"]), **options)
    cuts = F.expr("array_sort(transform(filter(spans, s -> s.verdict = 'live'), s -> struct(s.vstart as a, s.vend as b)))")
    held = found.select("whole", cuts.alias("cuts"))
    text = F.col(f"whole.c{docs.columns.index(text_col)}")
    cover = F.pandas_udf(lambda texts, lists: pd.Series([masked(t, c, mask) for t, c in zip(texts, lists, strict=True)], dtype=object), "string")
    # Texts without a cut stay in the JVM.
    clean = F.when(F.size("cuts") == 0, text).otherwise(cover(F.when(F.size("cuts") > 0, text), F.expr("transform(cuts, s -> array(s.a, s.b))")))
    return held.select(*[(clean if c == text_col else F.col(f"whole.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def masked(text: str | None, cuts: list, mask: str) -> str | None:
    """The text with a mask for each run of overlapping cuts (start, end), which stand by start; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for a, b in cuts:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shown = lambda keep: F.concat_ws(",", F.transform(keep, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    return found.select(
        "doc_id", *[of_kind(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "bare")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "example").alias("n_example"),
    )


OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS lang FROM documents),
kinds(k, kind, least_size, p, q) AS (VALUES
  (0, 'assign', 6, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$'),
  (1, 'access', 20, 'AKIA[A-Z0-9]+', '(.*)'), (2, 'hex', 24, '[0-9a-f]{24,}', '(.*)'), (3, 'bare', 20, '[A-Za-z0-9+/_=-]{20,}', '(.*)')),
cut AS (
  SELECT r, k, kind, least_size, q, regexp_extract_all(t, p) AS hit, list_transform(string_split_regex(t, p), lambda x: length(x)) AS gap FROM docs, kinds WHERE regexp_matches(t, p)),
each AS (SELECT *, list_transform(hit, lambda x: length(x)) AS size, unnest(generate_series(1, len(hit))) AS i FROM cut),
found AS (
  SELECT r, k, kind, least_size, hit[i] AS m, regexp_extract(hit[i], q, 1) AS v, list_sum(gap[:i]) + coalesce(list_sum(size[:i - 1]), 0) AS s, list_sum(gap[:i]) + list_sum(size[:i]) AS e FROM each WHERE k = 0 OR size[i] >= least_size),
spans AS (SELECT r, k, kind, v, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM found WHERE length(v) >= least_size),
kept AS (
  SELECT * FROM spans WHERE k < 3 UNION ALL
  SELECT * FROM spans b WHERE k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM spans o WHERE o.r = b.r AND o.k < 3 AND o.s < b.e AND o.e > b.s)),
owned AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, lang)) AS repos FROM kept JOIN docs USING (r) GROUP BY v),
judged AS (
  SELECT r, k, kind, s, e, CASE WHEN owners >= 3 OR owners >= 2 AND repos >= 4 THEN 'example'
    WHEN list_aggregate(string_split(v, ''), 'entropy') >= least(3.0::DOUBLE, 0.8::DOUBLE * log2(length(v))) THEN 'live' ELSE 'weak' END AS verdict
  FROM kept JOIN owned USING (v)),
told AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
  FROM judged WHERE k < 3 OR verdict = 'live' GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN told USING (r)
"""
