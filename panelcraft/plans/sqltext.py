"""SQL text of the normal distribution, Sharpe probabilities and series scores, for the SQL twins."""

from __future__ import annotations

import math

from ..functions import normal as N
from .registry import cte


def horner(coefficients, x: str) -> str:
    text = f"({coefficients[0]!r}::DOUBLE)"
    for c in coefficients[1:]:
        text = f"({text} * {x} + ({c!r}::DOUBLE))"
    return text


def phi(x: str) -> str:
    z = f"abs({x})"
    dens = f"exp(-{z} * {z} / 2.0)"
    frac = f"({z} + 1.0 / ({z} + 2.0 / ({z} + 3.0 / ({z} + 4.0 / ({z} + 0.65)))))"
    tail = (
        f"(CASE WHEN {z} < {N.CDF_SPLIT!r} THEN {dens} * {horner(N.CDF_NUM, z)} / {horner(N.CDF_DEN, z)} "
        f"ELSE {dens} / {frac} / {N.ROOT_TWO_PI!r} END)"
    )
    return (
        f"(CASE WHEN {x} >= 8.3 THEN 1.0::DOUBLE WHEN {x} <= -8.3 THEN 0.0::DOUBLE WHEN {x} > 0 THEN 1.0 - {tail} ELSE {tail} END)"
    )


def phi_inv(p: str) -> str:
    def tail(q: str) -> str:
        return f"({horner(N.INV_TAIL_NUM, q)} / {horner(N.INV_TAIL_DEN, q)})"

    c = f"({p} - 0.5)"
    r = f"({c} * {c})"
    return (
        f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {N.INV_LOW} THEN {tail(f'sqrt(-2.0 * ln({p}))')} "
        f"WHEN {p} > 1.0 - {N.INV_LOW} THEN -{tail(f'sqrt(-2.0 * ln(1.0 - {p}))')} "
        f"ELSE {horner(N.INV_CENTRAL_NUM, r)} * {c} / {horner(N.INV_CENTRAL_DEN, r)} END)"
    )


def variance(sr: str, skew: str, kurt: str) -> str:
    return f"(1.0 - {skew} * {sr} + ({kurt} - 1.0) / 4.0 * {sr} * {sr})"


def psr_of(source: str, columns: str, sr: str, star: str, t: str, skew: str, kurt: str, name: str) -> str:
    """Select `columns` and a Sharpe probability from a source."""
    v = variance(sr, skew, kurt)
    z = f"CASE WHEN {t} >= 2 AND {v} > 0 THEN ({sr} - {star}) * sqrt({t} - 1.0) / sqrt({v}) END"
    return f"SELECT {columns}, CASE WHEN z_ IS NOT NULL THEN {phi('z_')} END AS {name} FROM (SELECT *, {z} AS z_ FROM {source})"


def max_sharpe(v: str, n: str) -> str:
    g = repr(N.EULER_GAMMA)
    a, b = phi_inv(f"(1.0::DOUBLE - 1.0::DOUBLE / {n})"), phi_inv(f"(1.0::DOUBLE - 1.0::DOUBLE / ({n} * {math.e!r}))")
    return f"(CASE WHEN {n} <= 1 THEN 0.0 ELSE sqrt({v}) * ((1.0 - {g}) * {a} + {g} * {b}) END)"


def score_ctes(p: str, source: str) -> None:
    """Declare `<p>_moments`, `<p>_block` and `<p>_score` for a table (series_id, idx, ret)."""
    cte(f"{p}_stats", f"SELECT series_id, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, var_pop(ret) AS m2 FROM {source} GROUP BY 1")
    cte(f"{p}_eps", f"""
SELECT s.series_id, idx, ret - mean AS e, n, m2, greatest(5, floor(log10(n)))::BIGINT AS kn,
       (ceil(sqrt(n)) + greatest(5, floor(log10(n))))::BIGINT AS mm
FROM {source} s JOIN {p}_stats t ON s.series_id = t.series_id""")
    cte(f"{p}_moments", f"""
SELECT series_id, n, mean, std, status, CASE WHEN status = 'ok' THEN mean / std END AS sr,
       CASE WHEN status = 'ok' THEN m3 / power(m2, 1.5) END AS skew, CASE WHEN status = 'ok' THEN m4 / (m2 * m2) END AS kurt
FROM (SELECT *, CASE WHEN n < 2 THEN 'too_short' WHEN m2 > 0 THEN 'ok' ELSE 'zero_variance' END AS status
      FROM {p}_stats JOIN (SELECT series_id, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM {p}_eps GROUP BY 1) USING (series_id))""")
    cte(f"{p}_cross", f"""
SELECT a.series_id, a.n, a.kn, a.mm, a.lag, sum(a.e * b.e) AS x
FROM (SELECT *, unnest(range(0, mm + 1)) AS lag FROM {p}_eps WHERE n >= 11) a
JOIN {p}_eps b ON a.series_id = b.series_id AND b.idx = a.idx + a.lag GROUP BY ALL""")
    cte(f"{p}_prefix", f"""
SELECT series_id, idx, sum(e * e) OVER (PARTITION BY series_id ORDER BY idx) AS s, sum(e * e) OVER (PARTITION BY series_id) AS total FROM {p}_eps""")
    cte(f"{p}_lag", f"""
SELECT c.*, c.x / c.n AS acv, (h.total - h.s) * t.s > 0 AND abs(c.x) / sqrt((h.total - h.s) * t.s) < 2 * sqrt(log10(c.n) / c.n) AS calm
FROM {p}_cross c JOIN {p}_prefix h ON h.series_id = c.series_id AND h.idx = c.lag
JOIN {p}_prefix t ON t.series_id = c.series_id AND t.idx = c.n - 2 - c.lag""")
    cte(f"{p}_bw", f"""
SELECT series_id, n, CASE WHEN first IS NULL THEN mm ELSE least(2 * greatest(first, 1), mm) END AS bw FROM (
  SELECT series_id, n, mm, min(lag) FILTER (run = kn AND lag <= mm - kn) AS first FROM (
    SELECT *, count(*) FILTER (calm) OVER (PARTITION BY series_id ORDER BY lag ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS run FROM {p}_lag)
  GROUP BY ALL)""")
    cte(f"{p}_block", f"""
SELECT series_id, CASE WHEN lr = 0 THEN 1.0 ELSE least(power(power(g / lr, 2) * n, 1.0 / 3.0), ceil(least(3 * sqrt(n), n / 3.0))) END AS block
FROM (SELECT l.series_id, l.n, sum(CASE WHEN lag > 0 THEN 2 * lam * lag * acv ELSE 0 END) AS g,
             sum(CASE WHEN lag = 0 THEN acv ELSE 2 * lam * acv END) AS lr
      FROM (SELECT l.*, CASE WHEN lag / bw <= 0.5 THEN 1.0 ELSE 2.0 * (1.0 - lag / bw) END AS lam
            FROM {p}_lag l JOIN {p}_bw b ON l.series_id = b.series_id WHERE lag <= bw) l GROUP BY ALL)
UNION ALL SELECT series_id, 1.0 FROM {p}_stats WHERE n < 11""")
    base = f"""(SELECT m.*, block, greatest(2, floor(n / greatest(1.0, block)))::BIGINT AS effective_t
  FROM {p}_moments m JOIN {p}_block b ON m.series_id = b.series_id)"""
    cte(f"{p}_score", psr_of(base, "* EXCLUDE (z_)", "sr", "0.0", "effective_t", "skew", "kurt", "psr0"))
