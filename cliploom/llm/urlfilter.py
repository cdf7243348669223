"""URL filters: stated rules first, association rules for the rest. DataFrame operations only.

Pages that a stated rule decides are the labels. Their URL tokens (host suffixes, leading
path segments, file extension) and verdicts are transactions for Spark's FP-growth; of the association
rules it finds, those stay that conclude a verdict with enough confidence and support
and that no more general rule matches in confidence. Undecided URLs meet the rules through an inverted
index from token to rule: a rule fires where all its tokens are found. The surest rule that
fires gives the verdict.

A URL has at most ``MAX_TOKENS`` tokens, so a frequent token, item set or rule needs its share of the
labels: there are at most MAX_TOKENS / min_support tokens and 2 ** MAX_TOKENS / min_support rules,
whatever the number of pages. Only that bounded list of tokens comes to the driver.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the stated rules.
STATED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SUFFIXES, SEGMENTS = 3, 3
MAX_TOKENS = SUFFIXES + SEGMENTS + 1
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.6
MARK = "verdict="
HOT_SHARE = 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ? or #, A-Z lower-cased; path: on up to ? or #. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def stated_rule(host: Column, path: Column, rules=STATED) -> tuple[Column, Column]:
    """The longest stated rule that fits (as host + path) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host suffixes of 1 to 3 labels, path segments by depth 1 to 3, extension of the last segment."""
    labels = F.split(host, r"\.")
    suffix = [F.when(F.size(labels) >= k, F.concat(F.lit("h:"), F.array_join(F.slice(labels, -k, k), "."))) for k in range(1, SUFFIXES + 1)]
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    place = [F.concat(F.lit(f"p{k}:"), F.get(parts, k - 1)) for k in range(1, SEGMENTS + 1)]
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    found = [F.when(host != "", s) for s in suffix] + [*place, F.when(ending != "", F.concat(F.lit("x:"), F.translate(ending, UPPER, LOWER)))]
    return F.array_distinct(F.array_compact(F.array(*found)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """From rows (tokens, verdict) the rules (rule, tokens, verdict, confidence, support); ``rule`` names them.

    Rules that a more general rule of the same verdict matches in confidence are pruned.
    """
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(MARK), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit(MARK))).where(~F.exists("antecedent", lambda x: F.startswith(x, F.lit(MARK))))
    rules = found.select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(MARK) + 1, 1000).alias("verdict"), "confidence", "support",
    ).select(F.to_json(F.struct("tokens", "verdict")).alias("rule"), "*")
    rules = materialize(rules, "rules")
    # A rule's own tokens are matched against the index like a URL's.
    inner = rules.select(F.col("rule").alias("key"), "tokens", F.col("verdict").alias("own"), F.col("confidence").alias("sure"), F.size("tokens").alias("n"))
    general = fired(inner.select("key", "tokens"), rules).join(inner.drop("tokens"), "key").where("verdict = own and need < n and confidence >= sure")
    return rules.join(general.select(F.col("key").alias("rule")).distinct(), "rule", "left_anti")


def fired(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (key, rule, need, verdict, confidence, support) of the rules whose tokens all lie in a set (key, tokens)."""
    index = rules.select("rule", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    hits = sets.select("key", F.explode("tokens").alias("token")).join(index, "token").groupBy("key", "rule", "need").agg(F.count("*").alias("n")).where("n = need")
    return hits.select("key", "rule", "need").join(rules.select("rule", "verdict", "confidence", "support"), "rule")


def judge_urls(
    pages: DataFrame, rules=STATED, id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = "allow"
) -> DataFrame:
    """Returns id_col, host, path, rule, verdict, source: one row for each row of pages.

    ``rule`` is the stated rule that decides, or null; ``source`` says whether the verdict is
    ``stated``, ``mined`` or ``default``. Of fired rules the highest confidence counts, then
    the highest support, then ``block`` before ``allow``. A null URL and one without ``://`` have host and path empty. With no
    labelled page, or no rule that fires, the verdict is the default.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")).select("id", host.alias("host"), path.alias("path"))
    rule, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    judged = materialize(parsed.select("id", "host", "path", rule.alias("rule"), verdict.alias("stated")), "judged")
    labelled = judged.where("stated is not null").select(url_tokens(F.col("host"), F.col("path")).alias("tokens"), F.col("stated").alias("verdict"))
    out = ["id", "host", "path", "rule"]
    mined = mine(labelled, min_support, min_confidence) if not labelled.isEmpty() else None
    # At most MAX_TOKENS / min_support of them.
    known = [r.t for r in mined.select(F.explode("tokens").alias("t")).distinct().collect()] if mined is not None else []
    if not known:
        return judged.select(*out, F.coalesce("stated", F.lit(default)).alias("verdict"), F.when(F.col("stated").isNull(), "default").otherwise("stated").alias("source")).withColumnRenamed("id", id_col)
    decided = judged.where("stated is not null").select(*out, F.col("stated").alias("verdict"), F.lit("stated").alias("source"))
    held = F.array_sort(F.array_intersect(url_tokens(F.col("host"), F.col("path")), F.array(*[F.lit(t) for t in sorted(known)])))
    rest = judged.where("stated is null").select(*out, held.alias("tokens"))
    # URLs of equal known tokens are judged once, however many they are; those without any are decided by no rule.
    bare = rest.where("size(tokens) = 0").select(*out, F.lit(default).alias("verdict"), F.lit("default").alias("source"))
    rest = rest.where("size(tokens) > 0").withColumn("key", F.to_json(F.struct("tokens")))
    sets = rest.groupBy("key").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    best = fired(sets.select("key", "tokens"), mined).groupBy("key").agg(F.max(F.struct("confidence", "support", "verdict")).alias("best")).select("key", F.col("best.verdict").alias("verdict"))
    judged_sets = materialize(sets.select("key", "n").join(best, "key", "left"), "sets")
    # A set of more than this share of the URLs goes to them by broadcast: HOT_SHARE sets at most. The others meet theirs by key.
    limit = (judged_sets.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE + 1
    hot = F.broadcast(judged_sets.where(F.col("n") > limit).drop("n"))
    met = rest.join(hot, "key").unionByName(rest.join(hot.select("key"), "key", "left_anti").join(judged_sets.where(F.col("n") <= limit).drop("n"), "key"))
    told = met.select(*out, F.coalesce("verdict", F.lit(default)).alias("verdict"), F.when(F.col("verdict").isNull(), "default").otherwise("mined").alias("source"))
    return decided.unionByName(bare).unionByName(told).withColumnRenamed("id", id_col)


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h FROM cut)),
stated AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed),
given AS (SELECT *, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS v FROM stated),
parts AS (
  SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS p, lower(regexp_extract(path, '\.([A-Za-z0-9]{1,5})$', 1)) AS x FROM given),
toks AS (
  SELECT page_id, host, path, rule, v, list_distinct(list_filter([
    CASE WHEN host <> '' THEN 'h:' || l[-1] END, CASE WHEN host <> '' AND len(l) >= 2 THEN 'h:' || array_to_string(l[-2:], '.') END,
    CASE WHEN host <> '' AND len(l) >= 3 THEN 'h:' || array_to_string(l[-3:], '.') END,
    'p1:' || p[1], 'p2:' || p[2], 'p3:' || p[3], CASE WHEN x <> '' THEN 'x:' || x END], lambda t: t IS NOT NULL)) AS t
  FROM parts),
subs AS (
  SELECT page_id, v, array_to_string(list_sort(list_filter(t, lambda a, i: (m >> (i - 1)) & 1 = 1)), chr(9)) AS s
  FROM (SELECT page_id, v, t, unnest(generate_series(1, (1 << len(t)) - 1)) AS m FROM toks)),
total AS (SELECT count(*) AS n FROM toks WHERE v IS NOT NULL),
one AS (SELECT s, count(*) AS ns FROM subs WHERE v IS NOT NULL GROUP BY s),
two AS (SELECT s, v, count(*) AS nv FROM subs WHERE v IS NOT NULL GROUP BY s, v),
rules AS (
  SELECT two.s, two.v, CAST(nv AS DOUBLE) / ns AS confidence, nv FROM two JOIN one USING (s), total
  WHERE nv >= ceil(0.01 * n) AND CAST(nv AS DOUBLE) / ns >= 0.6),
best AS (
  SELECT u.page_id, max(struct_pack(c := r.confidence, n := r.nv, v := r.v)) AS b FROM subs u JOIN rules r USING (s) WHERE u.v IS NULL GROUP BY u.page_id)
SELECT page_id, host, path, rule, coalesce(toks.v, best.b.v, 'allow') AS verdict FROM toks LEFT JOIN best USING (page_id)
"""
