"""The quality rules as one SQL statement for DuckDB, to hold op5 against; its constants are its own.

Concentration is unrolled to a fixed number of steps.  A start that has settled gives the same subset again, so further steps
leave it as it is.
"""

from __future__ import annotations

_N = 5  # statistics
_LOW = [(i, j) for i in range(_N) for j in range(i + 1)]
_Q = ", ".join(f"q{i}" for i in range(_N))
_R = ", ".join(f"r{i}" for i in range(_N))
_KEPT = ", ".join([f"m{i}" for i in range(_N)] + [f"l{i}_{j}" for i, j in _LOW] + ["logdet"])
# chi-squared with 5 degrees of freedom: quantiles of 0.975 and of 1 - 1e-9, and share / P(chi-squared with 7 below the share's quantile)
_INNER, _CUTOFF = 12.832501994030022, 50.692196688316415
_CONSISTENT, _REWEIGHT = 1.4120710601890472, 1.0555331100406589


def _factor(source: str) -> str:
    """``source`` with the Cholesky factor of c plus r on the diagonal, and the logarithm of its determinant."""
    cols = []
    for i, j in _LOW:
        value = f"c{i}_{j}" + (f" + r{i}" if i == j else "") + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        cols.append(f"sqrt(greatest({value}, 1e-12)) AS l{i}_{j}" if i == j else f"({value}) / l{j}_{j} AS l{i}_{j}")
    return f"SELECT *, {', '.join(cols)}, {' + '.join(f'2 * ln(l{i}_{i})' for i in range(_N))} AS logdet FROM ({source})"


def _scatter(factor: float) -> str:
    means = [f"sum(q{i})::DOUBLE / count(*) / 1000 AS m{i}" for i in range(_N)]
    return ", ".join(means + [f"(count(*)::HUGEINT * sum(q{i} * q{j}) - sum(q{i}) * sum(q{j}))::DOUBLE / count(*) / count(*) * {factor / 1e6!r}::DOUBLE AS c{i}_{j}" for i, j in _LOW])


def _distance(rows: str, estimate: str, also: str = "", join: str = "JOIN") -> str:
    z = [f"(q{i} / 1000 - m{i}{''.join(f' - l{i}_{k} * z{k}' for k in range(i))}) / l{i}_{i} AS z{i}" for i in range(_N)]
    return f"SELECT r.*, {also}{', '.join(z)}, {' + '.join(f'z{i} * z{i}' for i in range(_N))} AS d2 FROM {rows} r {join} {estimate} e ON e.grp = r.grp"


def quality_sql(support: float = 0.75, steps: int = 14, min_group: int = 25) -> str:
    space = r"\x20\x09-\x0D"
    quart = lambda i, p: f"quantile_cont(q{i}, {p})"
    zero = ", ".join(f"CASE WHEN {i} = {j} THEN pow(({quart(i, 0.75)} - {quart(i, 0.25)}) / 1349, 2) ELSE 0 END AS c{i}_{j}" for i, j in _LOW)
    unit = "exp(m0) - 1"
    parts = [
        f"a0 AS MATERIALIZED (SELECT grp, count(*) AS n_all, {', '.join(f'{quart(i, 0.5)} / 1000 AS m{i}' for i in range(_N))}, {zero} FROM fitted GROUP BY grp)",
        f"a AS MATERIALIZED (SELECT *, pow(ln(1 + 1 / ({unit} + 1)), 2) AS r0, pow(ln(1 + 1 / (({unit}) * exp(m1))), 2) AS r1, pow(ln(1 + 100 / ({unit})), 2) AS r2, r2 AS r3, pow(asin(sqrt(least(1, 6 / ({unit})))), 2) AS r4 FROM a0)",
        f"b AS MATERIALIZED (SELECT grp, any_value(n_all) AS n_all, {', '.join(f'any_value(a.r{i}) AS r{i}' for i in range(_N))}, {_scatter(1.0)} FROM fitted JOIN a USING (grp) GROUP BY grp)",
        f"turned AS MATERIALIZED (SELECT grp, {', '.join(f'(q{i} / 1000 - m{i}) / sqrt(c{i}_{i} + r{i}) AS u{i}' for i in range(_N))}, greatest(sqrt({' + '.join(f'u{i} * u{i}' for i in range(_N))}), 1e-9) AS norm, {', '.join(f'CAST(round(1000 * u{i} / norm) AS BIGINT) AS t{i}' for i in range(_N))} FROM fitted JOIN a USING (grp))",
        f"signs AS MATERIALIZED (SELECT grp, {', '.join(f'sum(t{i} * t{j})::DOUBLE / count(*) * {_N / 1e6!r}::DOUBLE AS s{i}_{j}' for i, j in _LOW)} FROM turned GROUP BY grp)",
        f"c AS MATERIALIZED (SELECT a.grp, n_all, {_R}, {', '.join(f'm{i}' for i in range(_N))}, {', '.join(f's{i}_{j} * sqrt(a.c{i}_{i} + r{i}) * sqrt(a.c{j}_{j} + r{j}) AS c{i}_{j}' for i, j in _LOW)} FROM a JOIN signs USING (grp))",
    ]
    names = f"grp, n_all, {_R}, {', '.join(f'm{i}' for i in range(_N))}, {', '.join(f'c{i}_{j}' for i, j in _LOW)}"
    every = " UNION ALL ".join(f"SELECT {k} AS start, {names} FROM {x}" for k, x in enumerate("abc"))
    parts.append(f"e0 AS MATERIALIZED (SELECT start, grp, n_all, {_R}, {_KEPT.replace('logdet', chr(39) + 'infinity' + chr(39) + '::DOUBLE AS logdet')} FROM ({_factor(every)}))")
    for k in range(steps):
        parts.append(f"d{k} AS MATERIALIZED (SELECT grp, start, n_all, {_Q}, floor(64 * ln(1 + d2)) AS step FROM ({_distance('fitted', f'e{k}', 'e.start, e.n_all, ')}))")
        parts.append(f"s{k} AS MATERIALIZED (SELECT grp, start, {_Q} FROM d{k} QUALIFY count(*) OVER (PARTITION BY grp, start ORDER BY step) - count(*) OVER (PARTITION BY grp, start, step) < {support} * n_all)")
        sums = f"SELECT grp, start, {_scatter(_CONSISTENT)} FROM s{k} GROUP BY grp, start"
        parts.append(f"t{k} AS MATERIALIZED ({_factor(f'SELECT x.*, {_R} FROM ({sums}) x JOIN e{k} USING (grp, start)')})")
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT start, grp, n_all, {', '.join(f'o.r{i}' for i in range(_N))}, {', '.join(f'CASE WHEN t.logdet < o.logdet - 1e-9 THEN t.{c} ELSE o.{c} END AS {c}' for c in _KEPT.split(', '))} FROM e{k} o JOIN t{k} t USING (grp, start))")
    parts.append(f"best AS MATERIALIZED (SELECT * FROM e{steps} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY logdet, start) = 1)")
    parts.append(f"inside AS MATERIALIZED (SELECT grp, {_Q} FROM ({_distance('fitted', 'best')}) WHERE d2 <= {_INNER!r})")
    parts.append(f"final AS MATERIALIZED ({_factor(f'SELECT x.*, n_all, {_R} FROM (SELECT grp, {_scatter(_REWEIGHT)} FROM inside GROUP BY grp) x JOIN best USING (grp) WHERE n_all >= {min_group}')})")
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{space}]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS lines FROM documents),
windows AS (SELECT rid, p, w[p:p + 2] AS seq FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 0) + 1)) AS p FROM docs)),
twice AS (SELECT rid, unnest(range(p, p + 3)) AS p FROM windows QUALIFY count(*) OVER (PARTITION BY rid, seq) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY rid),
counts AS (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM docs LEFT JOIN covered USING (rid)),
vectors AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS n, CAST(round(1000 * ln(1 + n)) AS BIGINT) AS q0, CAST(round(1000 * ln(greatest(word_chars, 1) / n)) AS BIGINT) AS q1, CAST(round(1000 * ln(1 + 100 * n_symbols / n)) AS BIGINT) AS q2, CAST(round(1000 * ln(1 + 100 * n_dup_lines / n)) AS BIGINT) AS q3, CAST(round(1000 * asin(sqrt(least(1, n_repeat_words / n)))) AS BIGINT) AS q4 FROM counts),
sizes AS (SELECT lang, source, count(*) AS n1 FROM vectors WHERE NOT base_failed GROUP BY ALL),
named AS (SELECT lang, source, CASE WHEN n1 >= {min_group} THEN concat('1', coalesce(lang, '-'), '|', coalesce('=' || source, '-')) WHEN sum(CASE WHEN n1 < {min_group} THEN n1 END) OVER (PARTITION BY lang) >= {min_group} THEN concat('0', coalesce(lang, '-')) ELSE '' END AS grp FROM sizes),
grouped AS MATERIALIZED (SELECT v.*, grp FROM vectors v LEFT JOIN named k ON v.lang IS NOT DISTINCT FROM k.lang AND v.source IS NOT DISTINCT FROM k.source),
fitted AS MATERIALIZED (SELECT grp, {_Q} FROM grouped WHERE NOT base_failed),
{', '.join(parts)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {_CUTOFF!r}, true) AS kept FROM ({_distance('grouped', 'final', '', 'LEFT JOIN')})"""
