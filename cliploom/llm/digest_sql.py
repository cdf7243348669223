"""DuckDB SQL of fingerprints and stored samples: XXH64 and CRC-32 as list functions, all pairs of fingerprints, samples byte by byte."""

from __future__ import annotations

from .media import RATE, UNIT
from .simhash import BITS, SEED, SHINGLE, THRESHOLD

# The primes of XXH64 and the reflected polynomial of CRC-32.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
CRC32 = 3988292384


def _n(x: int) -> str:
    return f"{x % (1 << 64)}::UHUGEINT"


def _low(x: str) -> str:
    return f"(({x}) & {_n(-1)})"


def _turned(x: str, bits: int) -> str:
    """The 64 bits of x, turned to the left."""
    return f"((({x} & {_n((1 << 64 - bits) - 1)}) * {_n(1 << bits)}) | ({x} >> {_n(64 - bits)}))"


def _times(x: str, prime: int, plus: int = 0) -> str:
    return _low(f"{x} * {_n(prime)} + {_n(plus)}")


def _little(at: str, size: int) -> str:
    """The number of ``size`` bytes from byte ``at`` (from 0) of the hexadecimal x: reversed digits, with the two of each byte put back."""
    digits = f"CAST('0x' || reverse(substr(x, CAST(2 * ({at}) + 1 AS BIGINT), {2 * size})) AS UHUGEINT)"
    odd = int("0f" * size, 16)
    return f"((({digits} & {_n(odd)}) * {_n(16)}) | (({digits} >> {_n(4)}) & {_n(odd)}))"


def _folded(first: str, rest: str, step: str) -> str:
    """``step`` over a (so far) and b (next)."""
    return f"list_reduce(list_prepend({first}, {rest}), lambda a, b: {step})"


def xxh64(source: str, seed: int) -> list[str]:
    """CTEs that end in ``hashed`` (s, h): the hash of each text s of ``source``, an unsigned 64-bit number, by the steps of the published algorithm."""
    mixed = _times(_turned(_times("b", P2), 31), P1)
    starts = (seed + P1 + P2, seed + P2, seed, seed - P1)
    lane = "list_transform(range(CAST(n // 32 AS BIGINT)), lambda i: {})"
    streams = [_folded(_n(v), lane.format(_times(f"e[CAST(4 * i + {k + 1} AS BIGINT)]", P2)), _times(_turned(_low("(a + b)"), 31), P1)) for k, v in enumerate(starts)]
    merged = _low(" + ".join(_turned(f"v{k}", bits) for k, bits in enumerate((1, 7, 12, 18))))
    for k in range(4):
        merged = _times(f"xor({merged}, {mixed.replace('b *', f'v{k} *')})", P1, P4)
    tail = [  # what is left after the stripes: eights, a four, single bytes
        ("h8", _folded("h0", f"list_transform(e[CAST(n // 32 * 4 + 1 AS BIGINT) :], lambda b: {mixed})", _times(_turned("xor(a, b)", 27), P1, P4))),
        ("h4", f"CASE WHEN n % 8 < 4 THEN h8 ELSE {_times(_turned(f'xor(h8, {_times(_little("n // 8 * 8", 4), P1)})', 23), P2, P3)} END"),
        ("h1", _folded("h4", f"list_transform(range(CAST(n % 4 AS BIGINT)), lambda i: {_times(_little('n // 4 * 4 + i', 1), P5)})", _times(_turned("xor(a, b)", 11), P1))),
        ("g1", _times(f"xor(h1, h1 >> {_n(33)})", P2)),
        ("g2", _times(f"xor(g1, g1 >> {_n(29)})", P3)),
        ("h", f"CAST(xor(g2, g2 >> {_n(32)}) AS UBIGINT)"),
    ]
    steps = [
        f"read0 AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM {source})",
        f"read1 AS (SELECT *, list_transform(range(CAST(n // 8 AS BIGINT)), lambda i: {_little('8 * i', 8)}) AS e FROM read0)",
        "read2 AS (SELECT *, " + ", ".join(f"{v} AS v{k}" for k, v in enumerate(streams)) + " FROM read1)",
        f"t_ AS (SELECT *, {_low(f'CASE WHEN n < 32 THEN {_n(seed + P5)} ELSE {merged} END + n::UHUGEINT')} AS h0 FROM read2)",
    ]
    for k, (name, value) in enumerate(tail):
        steps.append(f"t{k} AS (SELECT *, {value} AS {name} FROM t{k - 1 if k else '_'})")
    return [*steps, f"hashed AS MATERIALIZED (SELECT s, h FROM t{len(tail) - 1})"]


def simhash(shingle: int = SHINGLE, seed: int = SEED, threshold: int = THRESHOLD) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ones = ", ".join(f"sum(k * CAST((h >> {b}) & 1 AS BIGINT)) AS c{b}" for b in range(BITS))
    bits = " + ".join(f"CASE WHEN 2 * c{b} > k THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(BITS))
    steps = [
        "docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex("
        f"translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents)",
        f"shingles AS MATERIALIZED (SELECT r, s, count(*) AS k FROM (SELECT r, unnest(list_transform(range(1, greatest(len(w) - {shingle - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {shingle - 1}], ' '))) AS s"
        " FROM docs WHERE len(w) > 0) GROUP BY r, s)",
        "texts AS MATERIALIZED (SELECT DISTINCT s FROM shingles)",
        *xxh64("texts", seed),
        f"counts AS (SELECT r, sum(k) AS k, {ones} FROM shingles JOIN hashed USING (s) GROUP BY r)",
        f"prints AS MATERIALIZED (SELECT docs.r, doc_id, coalesce({bits}, 0::UBIGINT) AS fp FROM docs LEFT JOIN counts ON docs.r = counts.r)",
        "points AS MATERIALIZED (SELECT fp, min(doc_id) AS m FROM prints GROUP BY fp)",
        f"links AS MATERIALIZED (SELECT x.fp AS a, y.fp AS b FROM points x JOIN points y ON x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)) <= {threshold})",
        "reach AS (SELECT fp AS a, fp AS b FROM points UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)",
        "classes AS (SELECT reach.a AS fp, min(points.m) AS component_id FROM reach JOIN points ON reach.b = points.fp GROUP BY reach.a)",
    ]
    return "WITH RECURSIVE " + ",\n".join(steps) + "\nSELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN classes USING (fp)"


def _le32(x: str) -> str:
    return "printf('%02x%02x%02x%02x', " + ", ".join(f"({x}) >> {8 * k} & 255" for k in range(4)) + ")"


def media(rate: int = RATE, unit: int = UNIT) -> str:
    """The texts as samples. Embedded media aren't looked for: plain texts, as those of the table, hold none."""
    rates = (rate.to_bytes(4, "little") * 2).hex()
    form = f"'{b'RIFF'.hex()}' || {_le32('36 + m')} || '{b'WAVEfmt '.hex()}1000000001000100{rates}01000800{b'data'.hex()}' || {_le32('m')}"
    turns = " + ".join(f"(len(signs) - len(replace(signs, '{x}', ''))) // 2" for x in ("01", "10"))
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
sized AS (SELECT *, CAST(octet_length(raw) AS BIGINT) AS n, CAST(greatest({unit}, (octet_length(raw) + {unit - 1}) // {unit} * {unit}) AS BIGINT) AS m FROM docs),
padded AS MATERIALIZED (SELECT r, doc_id, n, m, hex(raw) || repeat('00', m - n) AS x FROM sized),
bytes AS MATERIALIZED (SELECT r, regexp_extract_all(x, '..') AS b FROM padded),
stored AS (SELECT r, doc_id, n, m, unhex(x) AS payload, unhex({form} || x) AS file FROM padded),
levels AS (SELECT r, CAST('0x' || v AS BIGINT) - 128 AS level, count(*) AS k FROM (SELECT r, unnest(b) AS v FROM bytes) GROUP BY r, v),
sums AS (SELECT r, sum(k * level) AS total, sum(k * level * level) AS power FROM levels GROUP BY r),
changes AS (SELECT r, {turns} AS turns FROM (SELECT r, array_to_string(list_transform(b, lambda v: CASE WHEN v >= '80' THEN '1' ELSE '0' END), '') AS signs FROM bytes)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), list_transform(range(8), lambda k: 0::UBIGINT)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {CRC32}::UBIGINT) ELSE a >> 1 END) AS c FROM range(256) i(i))),
tails AS (SELECT r, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(b[-{unit} :], lambda v: CAST('0x' || v AS UBIGINT))),
  lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1]))) AS crc FROM bytes, crc_table)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(payload) AS payload_sha256, CAST(crc AS BIGINT) AS tail_crc32, CAST(octet_length(file) AS BIGINT) AS media_bytes, sha256(file) AS media_sha256,
  printf('audio/wav;n=%d mean=%.4f rms=%.4f turns=%d;', m, CAST(total AS DOUBLE) / m, sqrt(CAST(power AS DOUBLE) / m), turns) AS feature,
  'audio/wav' AS detected, true AS corrected, CAST(0 AS BIGINT) AS n_embedded
FROM stored JOIN sums USING (r) JOIN changes USING (r) JOIN tails USING (r)"""


OP3_SQL, OP13_SQL = media(), simhash()
