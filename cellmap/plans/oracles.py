"""SQL text for the operators: training, mapping and projection as chains of common table expressions."""

from __future__ import annotations

import numpy as np

from ..functions.grid import rectangular


def number(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def codebook(codes: np.ndarray, grid: np.ndarray) -> str:
    """A VALUES list: id, gx, gy, c0, c1, ..."""
    rows = ", ".join(f"({i + 1}, {number(g[0])}, {number(g[1])}, {', '.join(map(number, c))})" for i, (g, c) in enumerate(zip(grid, codes, strict=True)))
    names = ", ".join(f"c{j}" for j in range(codes.shape[1]))
    return f"(SELECT CAST(id AS INTEGER) AS id, gx, gy, {names} FROM (VALUES {rows}) AS v(id, gx, gy, {names}))"


def gap(d: int, metric: str = "euclidean") -> str:
    if metric == "cityblock":
        return " + ".join(f"abs(x{j} - c{j})" for j in range(d))
    if metric == "chebyshev":
        return f"greatest({', '.join(f'abs(x{j} - c{j})' for j in range(d))})"
    return f"sqrt({' + '.join(f'(x{j} - c{j}) * (x{j} - c{j})' for j in range(d))})"


def z_scaled(table: str, cols: list[str], keep: str = "") -> str:
    """Rows with x0.. scaled to mean 0 and population deviation 1."""
    parts = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x{j}" for j, c in enumerate(cols))
    return f"SELECT {keep}{parts} FROM {table}"


def kernel(kind: str, r: float, most: float) -> str:
    if kind == "gaussian":
        return f"exp(-(dist / {number(r)}) * (dist / {number(r)}) / 2)"
    if kind == "bubble":
        return f"sqrt(greatest(0, 1 - (dist / {number(r)}) * (dist / {number(r)})))"
    return f"({number(1e-6)} + CASE WHEN dist <= {number(min(r, 0.8 * most))} THEN 1 ELSE 0 END)"


def trained(data: str, codes: np.ndarray, xdim: int, ydim: int, radii: list[float], kind: str = "gaussian") -> str:
    """WITH clause whose last table, ``codes``, is the codebook after one epoch per radius."""
    d, grid = codes.shape[1], rectangular(xdim, ydim)
    names = ", ".join(f"c{j}" for j in range(d))
    ctes = [
        f"data AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM ({data}))",
        f"codes0 AS MATERIALIZED {codebook(codes, grid)}",
        "pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, greatest(abs(a.gx - b.gx), abs(a.gy - b.gy)) AS dist FROM codes0 a CROSS JOIN codes0 b)",
    ]
    for e, r in enumerate(radii):
        sums = ", ".join(f"sum(x{j}) AS s{j}" for j in range(d))
        new = ", ".join(f"sum(w * s{j}) / sum(w * n) AS c{j}" for j in range(d))
        ctes += [
            f"near{e} AS MATERIALIZED (SELECT rid, (min({{'d': {gap(d)}, 'id': id}})).id AS id FROM data CROSS JOIN codes{e} GROUP BY rid)",
            f"sums{e} AS MATERIALIZED (SELECT id, count(*) AS n, {sums} FROM data JOIN near{e} USING (rid) GROUP BY id)",
            f"kernel{e} AS MATERIALIZED (SELECT a, b, {kernel(kind, r, max(xdim, ydim) - 1)} AS w FROM pairs)",
            f"new{e} AS MATERIALIZED (SELECT a AS id, {new} FROM kernel{e} JOIN sums{e} ON b = sums{e}.id GROUP BY a)",
            f"codes{e + 1} AS MATERIALIZED (SELECT id, gx, gy, {names} FROM new{e} JOIN (SELECT id, gx, gy FROM codes0) USING (id))",
        ]
    ctes.append(f"codes AS MATERIALIZED (SELECT * FROM codes{len(radii)})")
    return "WITH " + ",\n".join(ctes)


def embedded(data: str, key: str, codes: np.ndarray, xdim: int, ydim: int, k: int, adjust: float, boost: float, m: float, edge: str = "product") -> str:
    """Coordinates of every row of ``data`` (``key``, x0, ...)."""
    d, n = codes.shape[1], xdim * ydim
    nk = min(k + 1, n)
    line = (lambda j: f"i.c{j} * j.c{j}") if edge == "product" else (lambda j: f"(j.c{j} - i.c{j})")
    xs, cs = (", ".join(f"{p}{j}" for j in range(d)) for p in "xc")
    cut = f" * (1 - exp(d * ({number(m)} / dn) - {number(m)}))" if k < nk else ""
    return f"""
WITH data AS MATERIALIZED ({data}),
codes AS MATERIALIZED {codebook(codes, rectangular(xdim, ydim))},
gaps AS MATERIALIZED (SELECT {key}, id, gx, gy, {xs}, {cs}, {gap(d)} AS d FROM data CROSS JOIN codes),
near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY d, id) AS r FROM gaps) WHERE r <= {nk}),
moments AS MATERIALIZED (SELECT {key}, sum(d / r) / sum(1.0::DOUBLE / r) AS mean, {number(boost)} / sqrt(sum(d * d / r) / sum(1.0::DOUBLE / r) - (sum(d / r) / sum(1.0::DOUBLE / r)) * (sum(d / r) / sum(1.0::DOUBLE / r))) AS sdev, max(d) AS dn FROM near GROUP BY {key}),
scored AS MATERIALIZED (SELECT near.*, exp((mean - d) * sdev){cut} AS s FROM near JOIN moments USING ({key}) WHERE r <= {k}),
pairs AS MATERIALIZED (
  SELECT i.{key}, i.gx AS ix, i.gy AS iy, j.gx - i.gx AS hx, j.gy - i.gy AS hy, i.s * j.s AS ss,
         {' + '.join(f'{line(j)} * (i.x{j} - i.c{j})' for j in range(d))} AS along, {' + '.join(f'({line(j)}) * ({line(j)})' for j in range(d))} AS square
  FROM scored i JOIN scored j ON i.{key} = j.{key} AND i.r < j.r),
placed AS MATERIALIZED (SELECT *, hx * hx + hy * hy AS hp, CASE WHEN along = 0 THEN 0 ELSE along / square END AS place FROM pairs WHERE along = 0 OR square <> 0),
weighted AS MATERIALIZED (SELECT *, ss * pow(1 + hp, -{number(adjust)}) * exp(-(place - 0.5) * (place - 0.5)) AS w FROM placed),
terms AS MATERIALIZED (
  SELECT {key}, hx * hx * w / hp AS a, hx * hy * w / hp AS b, hy * hy * w / hp AS c, hx * w * (place + (hx * ix + hy * iy) / hp) AS p, hy * w * (place + (hx * ix + hy * iy) / hp) AS q FROM weighted
  UNION ALL SELECT {key}, 1e-9::DOUBLE * s, 0, 1e-9::DOUBLE * s, 1e-9::DOUBLE * s * gx, 1e-9::DOUBLE * s * gy FROM scored),
total AS (SELECT {key}, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(p) AS p, sum(q) AS q FROM terms GROUP BY {key})
SELECT {key}, round((p * c - b * q) / (a * c - b * b), 4) + 0.0 AS x1, round((a * q - b * p) / (a * c - b * b), 4) + 0.0 AS x2 FROM total"""
