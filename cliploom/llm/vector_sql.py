"""DuckDB SQL of the operators on embeddings: rounds of plain nearest-neighbour assignment over all entries."""

from __future__ import annotations


def _floored(total: str, n: str) -> str:
    """floor(total / n) of integers, exactly."""
    return f"(({total}) - (({total}) % {n} + {n}) % {n}) // {n}"


def codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v"
        " FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT r, p, list_slice(v, CAST(p * len(v) // {parts} + 1 AS BIGINT), CAST((p + 1) * len(v) // {parts} AS BIGINT)) AS x FROM kept, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {entries})",
    ]
    best = "SELECT r, p, min({{'d': d, 'e': e}}) AS m FROM (SELECT cut.r, cut.p, b.e, list_sum(list_transform(list_zip(cut.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut JOIN {b} b USING (p)) GROUP BY r, p"
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({best.format(b=f'b{k}')})")
        steps.append(
            f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS c FROM ("
            f"SELECT p, a.m.e AS e, i, {_floored('sum(x[i])', 'count(*)')} AS y FROM cut JOIN a{k} a USING (r, p), range(1, len(x) + 1) t(i) GROUP BY p, a.m.e, i) GROUP BY p, e) n USING (p, e))"
        )
    steps.append(f"a AS MATERIALIZED ({best.format(b=f'b{rounds}')})")
    steps.append("coded AS (SELECT r, string_agg(printf('%02x', CAST(a.m.e AS INTEGER)), '' ORDER BY p) AS code, sum(a.m.d) AS error FROM a GROUP BY r)")
    steps.append(f"book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), book"
    )


def clusters(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> str:
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('" + f"{seed}" + ":' || CAST(vec_id AS VARCHAR)) NULLS LAST, embedding) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS x"
        f" FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"z0 AS MATERIALIZED (SELECT r - 1 AS e, x AS c FROM kept WHERE r <= {k})",
    ]
    best = "SELECT r, min({{'d': d, 'e': e}}) AS m FROM (SELECT r, e, list_sum(list_transform(list_zip(x, c), lambda y: (y[1] - y[2]) * (y[1] - y[2]))) AS d FROM kept, {z}) GROUP BY r"
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({best.format(z=f'z{i}')})")
        steps.append(
            f"z{i + 1} AS MATERIALIZED (SELECT e, coalesce(n.c, z.c) AS c FROM z{i} z LEFT JOIN (SELECT e, list(y ORDER BY i) AS c FROM ("
            f"SELECT a.m.e AS e, i, {_floored('sum(x[i])', 'count(*)')} AS y FROM kept JOIN a{i} a USING (r), range(1, {dim + 1}) t(i) GROUP BY a.m.e, i) GROUP BY e) n USING (e))"
        )
    steps.append(f"a AS MATERIALIZED ({best.format(z=f'z{rounds}')})")
    steps.append(f"named AS (SELECT e, sha256(array_to_string(c, ',')) AS h FROM z{rounds})")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, CAST(a.m.e AS INTEGER) AS cluster, CAST(a.m.d AS BIGINT) AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.e) AS BIGINT) AS cluster_inertia,"
        " CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM kept JOIN a USING (r) JOIN named ON named.e = a.m.e"
    )


OP11_SQL, OP12_SQL = codes(), clusters()
