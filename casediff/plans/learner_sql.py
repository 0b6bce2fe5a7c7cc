"""DuckDB SQL of the learned adapters, for the oracle of the registered queries."""

from __future__ import annotations

REG, DEPTH, BINS = 1e-3, 2, 16


def ridge_sql(rows: str, reg: float = REG) -> str:
    """CTE ``solved(w)``: coefficients and, last, the intercept of ridge least squares over ``rows(x, y)``.

    Gauss-Jordan elimination on the Gram matrix of (x, 1) with the sums of y beside it; it is positive definite, so
    no pivoting is needed."""
    return f"""
rx AS (SELECT list_concat(x, [1.0::DOUBLE]) AS x, y::DOUBLE AS y, len(x) + 1 AS n FROM {rows}),
re AS (SELECT i, j, CASE WHEN j <= n THEN x[i] * x[j] ELSE x[i] * y END AS v, n
       FROM (SELECT x, y, n, i, unnest(range(1, n + 2)) AS j FROM (SELECT x, y, n, unnest(range(1, n + 1)) AS i FROM rx))),
rg AS (SELECT i, j, n, avg(v) + CASE WHEN i = j AND i < n THEN {reg}::DOUBLE ELSE 0.0::DOUBLE END AS v FROM re GROUP BY i, j, n),
rr AS (SELECT i, n, list(v ORDER BY j) AS r FROM rg GROUP BY i, n),
rm AS (SELECT n, list(r ORDER BY i) AS m FROM rr GROUP BY n),
ge AS (SELECT * FROM (WITH RECURSIVE g(s, n, m) AS (
        SELECT 1::BIGINT, n, m FROM rm
        UNION ALL
        SELECT s + 1, n, list_transform(m, lambda row, i: CASE
                 WHEN i = s THEN list_transform(row, lambda v: v / row[s])
                 ELSE list_transform(list_zip(row, m[s]), lambda p: p[1] - p[2] * (row[s] / m[s][s])) END)
        FROM g WHERE s <= n) SELECT * FROM g WHERE s = n + 1)),
solved AS (SELECT list_transform(m, lambda row: row[n + 1]) AS w FROM ge)"""


def score_sql(x: str) -> str:
    """The prediction of ``solved`` for the vector ``x``."""
    return f"(list_sum(list_transform(list_zip({x}, w[1:len({x})]), lambda p: p[1] * p[2])) + w[len({x}) + 1])"


def _bin(v: str, bins: int) -> str:
    return (f"CASE WHEN ({v}) IS NOT NULL AND hi > lo THEN greatest(0, least({bins - 1}, "
            f"floor((({v}) - lo) * {bins} / (hi - lo)))) ELSE 0 END")


def _level(rows: str, level: int, bins: int) -> str:
    """CTE ``ts{level}``: the splits of the nodes of one level; ``rows(g, x, label, node)``."""
    return f"""
tc{level} AS (SELECT g, node, label, unnest(range(len(x))) AS f, unnest(x) AS v FROM {rows} WHERE node >= {2 ** level}),
th{level} AS (SELECT g, node, f, lo, hi, {_bin('v', bins)} AS bin, label, count(*) AS n FROM tc{level} JOIN tr_range USING (f) GROUP BY ALL),
tl{level} AS (SELECT g, node, label, count(*) AS t FROM {rows} WHERE node >= {2 ** level} GROUP BY ALL),
tn{level} AS (SELECT g, node, sum(t) AS total, sum(t * t) AS squares FROM tl{level} GROUP BY ALL),
tx{level} AS (SELECT g, node, f, lo, hi, b, label, sum(n) AS l FROM th{level} JOIN (SELECT range AS b FROM range(1, {bins})) ON bin < b GROUP BY ALL),
tp{level} AS (SELECT x.g, x.node, f, lo, hi, b, sum(l) AS nl, sum(l * l) AS sl, sum(t * l) AS tl
              FROM tx{level} x JOIN tl{level} y ON y.g = x.g AND y.node = x.node AND y.label = x.label GROUP BY ALL),
tq{level} AS (SELECT p.*, sl::DOUBLE / nl::DOUBLE + (squares - 2 * tl + sl)::DOUBLE / (total - nl)::DOUBLE AS purity,
                     squares::DOUBLE / total::DOUBLE AS now
              FROM tp{level} p JOIN tn{level} m ON m.g = p.g AND m.node = p.node WHERE total > nl),
ts{level} AS (SELECT g, node, f, b, lo, hi FROM tq{level} WHERE purity > now + 1e-9
              QUALIFY row_number() OVER (PARTITION BY g, node ORDER BY purity DESC, f, b) = 1)"""


def _step(name: str, rows: str, splits: str, columns: str, bins: int) -> str:
    columns = ", ".join(f"r.{c.strip()}" for c in columns.split(","))
    return f"""
{name} AS (SELECT {columns}, CASE WHEN s.f IS NULL THEN r.node
                  ELSE r.node * 2 + CASE WHEN {_bin('r.x[s.f + 1]', bins)} < s.b THEN 0 ELSE 1 END END AS node
           FROM {rows} r LEFT JOIN {splits} s ON s.g = r.g AND s.node = r.node)"""


def tree_sql(rows: str, depth: int = DEPTH, bins: int = BINS) -> str:
    """CTEs ``tsplit`` and ``tlabel``: trees over ``rows(g, x, label)``, one per ``g``."""
    parts = [f"""
tr_range AS (SELECT f, min(v) AS lo, max(v) AS hi FROM (SELECT unnest(range(len(x))) AS f, unnest(x) AS v FROM {rows}) GROUP BY f),
tw0 AS (SELECT g, x, label, 1 AS node FROM {rows})"""]
    for level in range(depth):
        parts.append(_level(f"tw{level}", level, bins))
        parts.append(_step(f"tw{level + 1}", f"tw{level}", f"ts{level}", "g, x, label", bins))
    parts.append("\ntsplit AS (" + " UNION ALL ".join(f"SELECT * FROM ts{level}" for level in range(depth)) + ")")
    parts.append(f"""
tlabel AS (SELECT g, node, label FROM (SELECT g, node, label, count(*) AS n FROM tw{depth} GROUP BY ALL)
           QUALIFY row_number() OVER (PARTITION BY g, node ORDER BY n DESC, label) = 1)""")
    return ",".join(parts)


def tree_score_sql(rows: str, columns: str, depth: int = DEPTH, bins: int = BINS) -> str:
    """CTE ``scored(columns, pred)`` of ``rows(g, x, columns)``."""
    own = [c.strip() for c in columns.split(",") if c.strip() != "g"]
    every = ", ".join(["g", "x", *own])
    parts = [f"\ntz0 AS (SELECT {every}, 1 AS node FROM {rows})"]
    parts += [_step(f"tz{i + 1}", f"tz{i}", "tsplit", every, bins) for i in range(depth)]
    parts.append(f"\nscored AS (SELECT {', '.join('z.' + c for c in ['g', *own])}, label AS pred FROM tz{depth} z "
                 "JOIN tlabel l ON l.g = z.g AND l.node = z.node)")
    return ",".join(parts)
