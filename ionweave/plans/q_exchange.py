"""Queries over shell exchange and translation."""

from __future__ import annotations

from ionweave.operators import exchange as ex
from ionweave.plans import views as v
from ionweave.plans.registry import define, register

LAGS = [1, 3, 8, 33]
TURNOVER_LAG = min(LAGS, key=lambda n: (abs(n * v.DT_PS - 1000.0), n))  # the lag nearest 1 ns
BLOCK_NS = 2.0


def shells(s, d):
    return ex.shell_sets(v.contacts(s, d))


def samples(s, d):
    """Four samples of a pair are made where they are summed; only the pairs are written."""
    pairs = v.shared(s, d, "exchange_pairs", lambda: ex.contact_pairs(v.contacts(s, d), v.located_grid(s, d), LAGS))
    return ex.samples_of_pairs(pairs, v.DT_PS, BLOCK_NS)


define(
    "shells",
    """SELECT DISTINCT CASE ligand_kind WHEN 'polymer' THEN 'chain' ELSE 'anion' END AS shell, frame, center_id, CASE ligand_kind WHEN 'polymer' THEN ligand_id * 2 + 1 ELSE ligand_id * 2 END AS member, CAST(-1 AS BIGINT) AS site_index FROM contacts
 UNION ALL SELECT DISTINCT 'combined', frame, center_id, CASE ligand_kind WHEN 'polymer' THEN ligand_id * 2 + 1 ELSE ligand_id * 2 END, -1 FROM contacts
 UNION ALL SELECT DISTINCT 'chain_site', frame, center_id, ligand_id, site_index FROM contacts WHERE ligand_kind = 'polymer'""", "contacts",
)
register("shell_sets", shells, "SELECT * FROM shells", ["shells"])
_LAGSQL = f"(SELECT CAST(unnest({LAGS}) AS BIGINT) AS lag)"
define(
    "retain",
    f"""SELECT shell, center_id, lag, origin, count(sf) AS n_initial, count(ef) AS n_final, count(*) FILTER (sf IS NOT NULL AND ef IS NOT NULL) AS n_retained FROM
 (SELECT shell, center_id, member, site_index, lag, frame AS origin, frame AS sf FROM shells CROSS JOIN {_LAGSQL}) a FULL JOIN (SELECT shell, center_id, member, site_index, lag, frame - lag AS origin, frame AS ef FROM shells CROSS JOIN {_LAGSQL}) b
 USING (shell, center_id, member, site_index, lag, origin) GROUP BY 1, 2, 3, 4""", "shells",
)
register("shell_retention", lambda s, d: ex.shell_retention(shells(s, d), LAGS), "SELECT * FROM retain", ["retain"])
define(
    "steps",
    """SELECT shell, center_id, frame, count(*) FILTER (a IS NULL OR b IS NULL) AS x FROM (SELECT shell, center_id, member, site_index, frame, 1 AS a FROM shells) FULL JOIN (SELECT shell, center_id, member, site_index, frame + 1 AS frame, 1 AS b FROM shells)
 USING (shell, center_id, member, site_index, frame) GROUP BY 1, 2, 3""", "shells",
)
register(
    "shell_steps", lambda s, d: ex.shell_steps(shells(s, d)),
    "SELECT center_id, frame, " + ", ".join(f"CAST(coalesce(sum(x) FILTER (shell = '{k}'), 0) AS BIGINT) AS x_{k}" for k in ex.SHELLS) + " FROM steps GROUP BY 1, 2", ["steps"],
)
define(
    "cumx",
    """SELECT w.*, shell, sum(coalesce(s.x, 0)) OVER (PARTITION BY w.center_id, shell ORDER BY w.frame) AS c FROM cwalk w CROSS JOIN (SELECT unnest(['anion', 'chain', 'chain_site', 'combined']) AS shell) k LEFT JOIN steps s USING (shell, center_id, frame)""",
    "cwalk", "steps",
)
define(
    "samples",
    f"""SELECT *, CASE WHEN retention IS NULL THEN NULL WHEN retention < 0.2 THEN '0.0-0.2' WHEN retention < 0.4 THEN '0.2-0.4' WHEN retention < 0.6 THEN '0.4-0.6' WHEN retention < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS retention_bin,
 CAST(floor(origin * CAST(30 AS DOUBLE) / 2000) AS BIGINT) AS block FROM (SELECT shell, center_id, lag, origin, origin_state, final_state, r2, CAST(turnover AS BIGINT) AS turnover, coalesce(n_initial, 0) AS n_initial, coalesce(n_final, 0) AS n_final, coalesce(n_retained, 0) AS n_retained,
 coalesce(n_initial - n_retained, 0) AS n_lost, coalesce(n_final - n_retained, 0) AS n_gained, coalesce(n_initial + n_final - 2 * n_retained, 0) AS n_exchange, n_retained / nullif(n_initial, 0) AS retention, n_retained / nullif(n_initial + n_final - n_retained, 0) AS jaccard FROM
 (SELECT a.shell, a.center_id, lag, a.frame AS origin, a.state AS origin_state, b.state AS final_state, (b.ux - a.ux) ** 2 + (b.uy - a.uy) ** 2 + (b.uz - a.uz) ** 2 AS r2, b.c - a.c AS turnover FROM cumx a CROSS JOIN {_LAGSQL} JOIN cumx b ON b.center_id = a.center_id AND b.shell = a.shell AND b.frame = a.frame + lag)
 LEFT JOIN retain USING (shell, center_id, lag, origin))""",
    "cumx", "retain",
)
register("exchange_samples", samples, "SELECT * FROM samples", ["samples"], {"r2": 5, "retention": 6, "jaccard": 6})
_MEANS = "count(*) AS n_samples, avg(r2) AS msd, avg(sqrt(r2)) AS mean_displacement, avg(retention) AS mean_retention, avg(n_exchange) AS mean_exchange, avg(turnover) AS mean_turnover"
_R = {"msd": 5, "mean_displacement": 6, "mean_retention": 6, "mean_exchange": 6, "mean_turnover": 6}
register(
    "exchange_by_retention", lambda s, d: ex.exchange_by_retention(samples(s, d)),
    f"""SELECT * FROM (SELECT shell, lag, retention_bin, {_MEANS}, count(DISTINCT center_id) AS n_centers, count(DISTINCT block) AS n_blocks FROM samples WHERE retention IS NOT NULL GROUP BY 1, 2, 3) JOIN
 (SELECT shell, lag, retention_bin, stddev_samp(m) / sqrt(count(m)) AS block_sem FROM (SELECT shell, lag, retention_bin, block, avg(r2) AS m FROM samples WHERE retention IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) USING (shell, lag, retention_bin)""",
    ["samples"], {**_R, "block_sem": 5},
)
register("exchange_by_state", lambda s, d: ex.exchange_by_state(samples(s, d)), f"SELECT shell, lag, origin_state, {_MEANS} FROM samples GROUP BY 1, 2, 3", ["samples"], _R)
register("exchange_by_lag", lambda s, d: ex.exchange_by_lag(samples(s, d)), f"SELECT shell, lag, {_MEANS}, median(retention) AS median_retention FROM samples GROUP BY 1, 2", ["samples"], {**_R, "median_retention": 6})
register("exchange_blocks", lambda s, d: ex.exchange_blocks(samples(s, d)),
         "SELECT shell, lag, block, origin_state, count(*) AS n_samples, avg(r2) AS msd, avg(retention) AS mean_retention, avg(turnover) AS mean_turnover FROM samples GROUP BY 1, 2, 3, 4", ["samples"], {"msd": 5, "mean_retention": 6, "mean_turnover": 6})
register("retention_memory", lambda s, d: ex.retention_memory(ex.exchange_by_lag(samples(s, d))), "SELECT shell, lag, avg(retention) AS mean_retention FROM samples GROUP BY 1, 2", ["samples"], ["mean_retention"])
register(
    "exchange_enhancement", lambda s, d: ex.exchange_enhancement(samples(s, d)),
    """SELECT *, msd_low / nullif(msd_high, 0) AS enhancement FROM (SELECT shell, lag, count(*) FILTER (retention < 0.5) AS n_low, count(*) FILTER (retention >= 0.8) AS n_high, avg(r2) FILTER (retention < 0.5) AS msd_low, avg(r2) FILTER (retention >= 0.8) AS msd_high
 FROM samples WHERE retention IS NOT NULL GROUP BY 1, 2)""", ["samples"], {"msd_low": 5, "msd_high": 5, "enhancement": 5},
)
register(
    "turnover_bins", lambda s, d: ex.turnover_bins(samples(s, d), TURNOVER_LAG),
    f"""SELECT bin, avg(turnover) AS mean_turnover, avg(r2) AS mean_msd, count(*) AS n FROM (SELECT turnover, r2, greatest(len(list_filter(e, lambda x: x < turnover)), 1) AS bin FROM (SELECT * FROM samples WHERE shell = 'combined' AND lag = {TURNOVER_LAG}),
 (SELECT list_distinct(quantile_cont(turnover, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM samples WHERE shell = 'combined' AND lag = {TURNOVER_LAG}) WHERE len(e) >= 3) GROUP BY 1""",
    ["samples"], {"mean_turnover": 6, "mean_msd": 5},
)
