"""SQL of the sampler diagnostics: rank-normalised split R-hat and effective sample sizes (Vehtari et al. 2021).

The lags' autocovariances are sums over self-joins, so the SQL shares no step with the kernel that it is held against.
"""

from __future__ import annotations

from treeweft.functions.normal import FAR_BOTTOM, FAR_TOP, NEAR_BOTTOM, NEAR_TOP

def polynomial(coefficients: tuple[str, ...], x: str) -> str:
    text = f"{coefficients[0]}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c}::DOUBLE)"
    return text


def normal_quantile(p: str) -> str:
    """SQL for the standard normal quantile of the column ``p``."""
    q, near = f"({p} - 0.5::DOUBLE)", f"(0.180625::DOUBLE - ({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    far = f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6::DOUBLE)"
    inside = f"{q} * {polynomial(NEAR_TOP, near)} / {polynomial((*NEAR_BOTTOM, '1.0'), near)}"
    outside = f"sign({q}) * {polynomial(FAR_TOP, far)} / {polynomial((*FAR_BOTTOM, '1.0'), far)}"
    return f"CASE WHEN abs({q}) <= 0.425::DOUBLE THEN {inside} ELSE {outside} END"


def diagnostics(chains: int, draws: int) -> str:
    """CTEs up to mc (node, k, mean, sd, hdi_lo, hdi_hi, mcse_mean, mcse_sd, ess_bulk, ess_tail, r_hat) of draws."""
    half, total = draws // 2, chains * draws
    span = int(0.94 * total)
    return f"""
mc_draws AS (
  SELECT node, k, chain * 2 + (draw >= {half})::INT AS c, draw % {half} AS i, value, avg(value) OVER p AS mu, median(value) OVER p AS med,
         quantile_cont(value, 0.05) OVER p AS q05, quantile_cont(value, 0.95) OVER p AS q95
  FROM draws WINDOW p AS (PARTITION BY node, k)
), mc_ranks AS (
  SELECT *, (rank() OVER (PARTITION BY node, k ORDER BY value) + (count(*) OVER (PARTITION BY node, k, value) - 1) / 2.0::DOUBLE - 0.375::DOUBLE) / {total + 0.25}::DOUBLE AS u,
         (rank() OVER (PARTITION BY node, k ORDER BY abs(value - med)) + (count(*) OVER (PARTITION BY node, k, abs(value - med)) - 1) / 2.0::DOUBLE - 0.375::DOUBLE) / {total + 0.25}::DOUBLE AS uf
  FROM mc_draws
), mc_x AS (
  SELECT 'raw' AS kind, node, k, c, i, value AS x FROM mc_ranks
  UNION ALL SELECT 'square', node, k, c, i, (value - mu) * (value - mu) FROM mc_ranks
  UNION ALL SELECT 'low', node, k, c, i, (value <= q05)::INT::DOUBLE FROM mc_ranks
  UNION ALL SELECT 'high', node, k, c, i, (value <= q95)::INT::DOUBLE FROM mc_ranks
  UNION ALL SELECT 'z', node, k, c, i, {normal_quantile('u')} FROM mc_ranks
  UNION ALL SELECT 'folded', node, k, c, i, {normal_quantile('uf')} FROM mc_ranks
), mc_chains AS (
  SELECT kind, node, k, c, avg(x) AS m, var_samp(x) AS v FROM mc_x GROUP BY ALL
), mc_between AS (
  SELECT kind, node, k, var_samp(m) AS between_, avg(v) AS within_ FROM mc_chains GROUP BY ALL
), mc_rhat AS (
  SELECT node, k, max(sqrt({half - 1}::DOUBLE / {half} + between_ / within_)) AS r_hat
  FROM mc_between WHERE kind IN ('z', 'folded') GROUP BY node, k
), mc_acov AS (
  SELECT kind, node, k, lag, avg(s) AS a FROM (
    SELECT a.kind, a.node, a.k, a.c, b.i - a.i AS lag, sum((a.x - m) * (b.x - m)) / {half} AS s
    FROM mc_x a JOIN mc_x b ON a.kind = b.kind AND a.node = b.node AND a.k = b.k AND a.c = b.c AND b.i >= a.i
    JOIN mc_chains h ON h.kind = a.kind AND h.node = a.node AND h.k = a.k AND h.c = a.c
    WHERE a.kind <> 'folded' GROUP BY ALL) GROUP BY ALL
), mc_rho AS (
  SELECT a.kind, a.node, a.k, a.lag, CASE WHEN a.lag = 0 THEN 1.0::DOUBLE
         ELSE 1 - (z.a * {half} / {half - 1}::DOUBLE - a.a) / (z.a + between_) END AS rho
  FROM mc_acov a JOIN mc_acov z ON z.lag = 0 AND z.kind = a.kind AND z.node = a.node AND z.k = a.k
  JOIN mc_between b ON b.kind = a.kind AND b.node = a.node AND b.k = a.k WHERE a.lag < {half - half % 2}
), mc_pairs AS (
  SELECT kind, node, k, lag // 2 AS p, sum(rho) AS r FROM mc_rho GROUP BY ALL
), mc_ess AS (
  SELECT kind, node, k, {total} / greatest(2 * coalesce(sum(r) FILTER (WHERE p < stop), 0) - 1, 1 / log10({total}::DOUBLE)) AS ess FROM (
    SELECT kind, node, k, p, min(r) OVER (PARTITION BY kind, node, k ORDER BY p) AS r,
           coalesce(min(p) FILTER (WHERE r <= 0) OVER (PARTITION BY kind, node, k), 1000000) AS stop FROM mc_pairs) GROUP BY ALL
), mc_sorted AS (
  SELECT node, k, value, row_number() OVER (PARTITION BY node, k ORDER BY value) AS i FROM draws
), mc_hdi AS (
  SELECT a.node, a.k, a.value AS lo, b.value AS hi FROM mc_sorted a JOIN mc_sorted b ON a.node = b.node AND a.k = b.k AND b.i = a.i + {span}
  QUALIFY row_number() OVER (PARTITION BY a.node, a.k ORDER BY b.value - a.value, a.value) = 1
), mc AS (
  SELECT d.node, d.k, d.mean, d.sd, h.lo AS hdi_lo, h.hi AS hdi_hi, sd / sqrt(e.raw) AS mcse_mean, sd / sqrt(2 * e.square) AS mcse_sd,
         e.z AS ess_bulk, least(e.low, e.high) AS ess_tail, r.r_hat
  FROM (SELECT node, k, avg(value) AS mean, stddev_samp(value) AS sd FROM draws GROUP BY node, k) d
  JOIN (SELECT node, k, max(ess) FILTER (WHERE kind = 'raw') AS raw, max(ess) FILTER (WHERE kind = 'square') AS square, max(ess) FILTER (WHERE kind = 'z') AS z,
        max(ess) FILTER (WHERE kind = 'low') AS low, max(ess) FILTER (WHERE kind = 'high') AS high FROM mc_ess GROUP BY node, k) e USING (node, k)
  JOIN mc_rhat r USING (node, k) JOIN mc_hdi h USING (node, k)
), stats AS (
  SELECT node, k, depth, mean, sd, ess_bulk, ess_tail, r_hat FROM mc JOIN inner_nodes USING (node)
)"""
