"""Queries over motion along chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.operators import contacts as ct
from ionweave.operators import sliding as sl
from ionweave.plans import views as v
from ionweave.plans.q_comotion import dot_sql, walk_sql
from ionweave.plans.q_dynamics import bounds
from ionweave.plans.registry import define, register

N_SITES = 50
K = 5
LAGS = [1, 2, 3]


def _chosen(s, d):
    return v.shared(s, d, "dominant", lambda: sl.dominant_chain(v.contacts(s, d), N_SITES))


def _smooth(s, d):
    return v.shared(s, d, "smooth", lambda: sl.smooth_chosen(_chosen(s, d), v.grid(s, d)))


def _flags(s, d):
    n = ct.coordination_numbers(v.contacts(s, d), v.grid(s, d))
    return n.select(
        "frame", "center_id", (F.col("n_anion") > 0).cast("int").alias("anion_present"), (F.col("n_chain") >= 2).cast("int").alias("multichain"), "n_site", "n_chain"
    )


def _dwells(s, d):
    return v.shared(s, d, "dwells", lambda: sl.dwell_events(_smooth(s, d), v.contacts(s, d), *bounds(s, d), v.DT_PS))


def _n_frames(s, d):
    return v.frame_bounds(s, d).select((F.col("last") - F.col("first") + 1).alias("n")).scalar()


def _transitions(s, d):
    return v.shared(
        s, d, "transitions", lambda: sl.site_transitions(_dwells(s, d), _flags(s, d), bounds(s, d)[0], _n_frames(s, d), v.DT_PS, K)
    )


define(
    "tied",
    """SELECT center_id, frame, chain, coordinate, count(*) OVER (PARTITION BY center_id, frame) AS k, first_value(chain) OVER (PARTITION BY center_id, frame ORDER BY d, chain) AS dflt FROM
 (SELECT *, rank() OVER (PARTITION BY center_id, frame ORDER BY n DESC) AS rk FROM (SELECT center_id, frame, ligand_id AS chain, count(*) AS n, sum(CAST(round_even(distance * 1e9, 0) AS BIGINT)) AS d, sum(site_index / (distance * distance)) / sum(1 / (distance * distance)) AS coordinate
 FROM contacts WHERE ligand_kind = 'polymer' GROUP BY 1, 2, 3)) WHERE rk = 1""", "contacts",
)
define("onef", "SELECT DISTINCT center_id, frame, dflt FROM tied", "tied")
define(
    "pick",
    """SELECT a.center_id, a.frame, a.dflt AS chain FROM onef a LEFT JOIN onef b ON b.center_id = a.center_id AND b.frame = a.frame - 1 WHERE b.frame IS NULL
 UNION ALL SELECT o.center_id, o.frame, coalesce(t.chain, o.dflt) FROM pick p JOIN onef o ON o.center_id = p.center_id AND o.frame = p.frame + 1 LEFT JOIN tied t ON t.center_id = o.center_id AND t.frame = o.frame AND t.chain = p.chain""", "onef", "tied",
)
define("dom", f"SELECT frame, center_id, chain, CAST(greatest(1, least({N_SITES}, round_even(round_even(coordinate * 1e9, 0) / 1e9, 0))) AS BIGINT) AS site, coordinate FROM pick JOIN tied USING (center_id, frame, chain)", "pick", "tied")
define("cstate", "SELECT frame, center_id, coalesce(chain, -1) AS chain, coalesce(site, -1) AS site, coordinate FROM grid LEFT JOIN dom USING (frame, center_id)", "grid", "dom")
define(
    "smooth",
    """SELECT frame, center_id, chain, site, coordinate, sc AS smooth_chain, CASE WHEN sc >= 0 THEN CAST(round_even(list_median(list_filter([CASE WHEN lc = sc THEN ls END, CASE WHEN chain = sc THEN site END, CASE WHEN rc = sc THEN rs END], lambda x: x IS NOT NULL)), 0) AS BIGINT) ELSE -1 END AS smooth_site
 FROM (SELECT *, CASE WHEN lc = rc THEN lc ELSE chain END AS sc FROM (SELECT *, lag(chain, 1, chain) OVER w AS lc, lag(site, 1, site) OVER w AS ls, lead(chain, 1, chain) OVER w AS rc, lead(site, 1, site) OVER w AS rs FROM cstate WINDOW w AS (PARTITION BY center_id ORDER BY frame)))""", "cstate",
)
define("flags", "SELECT frame, center_id, CAST(n_anion > 0 AS INTEGER) AS anion_present, CAST(n_chain >= 2 AS INTEGER) AS multichain, n_site, n_chain FROM numbers", "numbers")
define(
    "dwell",
    """SELECT center_id, event, chain, site, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_frames, CAST(count(*) * 30 AS DOUBLE) AS duration_ps, CAST(min(frame) = any_value(f0) AS INTEGER) AS left_censored, CAST(max(frame) = any_value(f1) AS INTEGER) AS right_censored,
 max(anion_present) AS anion_any, avg(anion_present) AS anion_fraction, max(multichain) AS multichain_any, avg(multichain) AS multichain_fraction, avg(n_site) AS mean_sites, avg(n_chain) AS mean_chains, CAST(chain >= 0 AS INTEGER) AS is_bound FROM
 (SELECT frame, center_id, smooth_chain AS chain, smooth_site AS site, CAST(sum(brk) OVER (PARTITION BY center_id ORDER BY frame) AS BIGINT) AS event FROM (SELECT *, CASE WHEN smooth_chain = lag(smooth_chain) OVER w AND smooth_site = lag(smooth_site) OVER w THEN 0 ELSE 1 END AS brk
 FROM smooth WINDOW w AS (PARTITION BY center_id ORDER BY frame))) JOIN flags USING (frame, center_id), bounds GROUP BY 1, 2, 3, 4""", "smooth", "flags", "bounds",
)
define(
    "trn",
    f"""SELECT * EXCLUDE (f0, f1, nf), frame * CAST(30 AS DOUBLE) AS time_ps, least({K - 1}, CAST(floor((frame - f0) * {K} / nf) AS BIGINT)) AS block FROM (SELECT a.center_id, a.event AS from_event, b.event AS to_event, b.start_frame AS frame,
 CASE WHEN a.chain < 0 AND b.chain >= 0 THEN 'attachment' WHEN a.chain >= 0 AND b.chain < 0 THEN 'detachment' WHEN a.chain <> b.chain THEN 'interchain_hop' WHEN abs(b.site - a.site) = 1 THEN 'neighbour_slide' WHEN abs(b.site - a.site) > 1 THEN 'large_jump' END AS type,
 a.chain AS from_chain, a.site AS from_site, b.chain AS to_chain, b.site AS to_site, CASE WHEN a.chain >= 0 AND a.chain = b.chain THEN b.site - a.site END AS delta, a.duration_ps AS from_dwell_ps, b.duration_ps AS to_dwell_ps
 FROM dwell a JOIN dwell b ON b.center_id = a.center_id AND b.event = a.event + 1) JOIN (SELECT center_id, frame, max(anion_present) OVER w AS anion_involved, max(multichain) OVER w AS multichain_involved FROM flags WINDOW w AS (PARTITION BY center_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
 USING (center_id, frame), bounds WHERE type IS NOT NULL""", "dwell", "flags", "bounds",
)
register("dominant_chain", _chosen, "SELECT * FROM dom", ["dom"], ["coordinate"])
register("smooth_states", _smooth, "SELECT * FROM smooth", ["smooth"], ["coordinate"])
_DW = ["duration_ps", "anion_fraction", "multichain_fraction", "mean_sites", "mean_chains"]
register("dwell_events", _dwells, "SELECT * FROM dwell", ["dwell"], _DW)
_TR = ["from_dwell_ps", "to_dwell_ps", "time_ps"]
register("site_transitions", _transitions, "SELECT * FROM trn", ["trn"], _TR)
_TYPES = "(SELECT unnest(['attachment', 'detachment', 'interchain_hop', 'neighbour_slide', 'large_jump']) AS type)"
define(
    "tblock",
    f"""SELECT block, type, coalesce(n, 0) AS n_events, CAST(coalesce(sum(n) OVER (PARTITION BY block), 0) AS BIGINT) AS n_all, coalesce(n, 0) / nullif(coalesce(sum(n) OVER (PARTITION BY block), 0), 0) AS fraction
 FROM (SELECT unnest(range({K})) AS block) CROSS JOIN {_TYPES} LEFT JOIN (SELECT block, type, count(*) AS n FROM trn GROUP BY 1, 2) USING (block, type)""", "trn",
)
register("transition_blocks", lambda s, d: sl.transition_blocks(_transitions(s, d), K), "SELECT * FROM tblock", ["tblock"], ["fraction"])
register(
    "transition_summary", lambda s, d: sl.transition_summary(_transitions(s, d), K),
    """SELECT type, block_mean, block_std, block_sem, n_blocks, coalesce(n_events, 0) AS n_events, mean_abs_delta, frac_anion, frac_multichain, mean_from_dwell_ps, mean_to_dwell_ps, coalesce(n_events, 0) / (SELECT count(*) FROM trn) AS fraction FROM
 (SELECT type, avg(fraction) AS block_mean, stddev_samp(fraction) AS block_std, stddev_samp(fraction) / sqrt(count(fraction)) AS block_sem, count(fraction) AS n_blocks FROM tblock GROUP BY 1)
 LEFT JOIN (SELECT type, count(*) AS n_events, avg(abs(delta)) AS mean_abs_delta, avg(anion_involved) AS frac_anion, avg(multichain_involved) AS frac_multichain, avg(from_dwell_ps) AS mean_from_dwell_ps, avg(to_dwell_ps) AS mean_to_dwell_ps FROM trn GROUP BY 1) USING (type)""",
    ["tblock", "trn"], ["block_mean", "block_std", "block_sem", "mean_abs_delta", "frac_anion", "frac_multichain", "mean_from_dwell_ps", "mean_to_dwell_ps", "fraction"],
)
define(
    "episodes",
    """SELECT center_id, episode, from_chain AS chain, direction, min(frame) AS start_frame, max(frame) AS end_frame, arg_min(from_site, from_event) AS start_site, arg_max(to_site, from_event) AS end_site, count(*) AS n_steps, CAST(sum(delta) AS BIGINT) AS net_delta,
 max(anion_involved) AS anion_any, max(multichain_involved) AS multichain_any, CAST((max(frame) - min(frame)) * 30 AS DOUBLE) AS span_ps FROM (SELECT *, CAST(sum(brk) OVER (PARTITION BY center_id ORDER BY from_event) AS BIGINT) AS episode FROM
 (SELECT *, CAST(sign(delta) AS INTEGER) AS direction, CASE WHEN from_event - lag(from_event) OVER w = 1 AND sign(delta) = lag(sign(delta)) OVER w AND from_chain = lag(from_chain) OVER w THEN 0 ELSE 1 END AS brk FROM trn WHERE type = 'neighbour_slide' WINDOW w AS (PARTITION BY center_id ORDER BY from_event))) GROUP BY 1, 2, 3, 4""", "trn",
)
register("sliding_episodes", lambda s, d: sl.sliding_episodes(_transitions(s, d), v.DT_PS), "SELECT * FROM episodes", ["episodes"], ["span_ps"])
register(
    "dwell_summary", lambda s, d: sl.dwell_summary(_dwells(s, d)),
    """SELECT count(*) AS n_dwells, count(*) FILTER (is_bound = 1) AS n_bound, count(t) AS n_completed, (count(*) FILTER (is_bound = 1) - count(t)) / count(*) FILTER (is_bound = 1) AS frac_censored, avg(t) AS mean_ps, median(t) AS median_ps, quantile_cont(t, 0.9) AS p90_ps, quantile_cont(t, 0.95) AS p95_ps,
 max(duration_ps) FILTER (is_bound = 1) AS max_bound_ps, avg(anion_any) FILTER (is_bound = 1) AS frac_anion, avg(multichain_any) FILTER (is_bound = 1) AS frac_multichain, sum(anion_fraction * n_frames) FILTER (is_bound = 1) / sum(n_frames) FILTER (is_bound = 1) AS time_frac_anion,
 sum(multichain_fraction * n_frames) FILTER (is_bound = 1) / sum(n_frames) FILTER (is_bound = 1) AS time_frac_multichain FROM (SELECT *, CASE WHEN is_bound = 1 AND left_censored = 0 AND right_censored = 0 THEN duration_ps END AS t FROM dwell)""",
    ["dwell"], ["frac_censored", "mean_ps", "median_ps", "p90_ps", "p95_ps", "max_bound_ps", "frac_anion", "frac_multichain", "time_frac_anion", "time_frac_multichain"],
)


def _sliding_summary(s, d):
    n = v.table(s, d, "supplier").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    bound = _dwells(s, d).filter("is_bound = 1").agg((F.sum("duration_ps") / 1000.0).alias("t")).select("t").scalar()
    return sl.sliding_summary(sl.sliding_episodes(_transitions(s, d), v.DT_PS), n, _n_frames(s, d) * (v.DT_PS / 1000.0), bound)


register(
    "sliding_summary", _sliding_summary,
    """SELECT *, n_steps / ((SELECT count(*) FROM supplier) * (SELECT nf FROM bounds) * CAST(0.03 AS DOUBLE)) AS rate_total, n_steps / (SELECT sum(duration_ps) / 1000 FROM dwell WHERE is_bound = 1) AS rate_coordinated FROM
 (SELECT count(*) AS n_episodes, CAST(coalesce(sum(n_steps), 0) AS BIGINT) AS n_steps, avg(n_steps) AS mean_steps, median(n_steps) AS median_steps, max(n_steps) AS max_steps, avg(CAST(n_steps >= 2 AS INTEGER)) AS frac_multistep, avg(anion_any) AS frac_anion, avg(multichain_any) AS frac_multichain FROM episodes)""",
    ["episodes", "bounds", "dwell"], ["mean_steps", "median_steps", "frac_multistep", "frac_anion", "frac_multichain", "rate_total", "rate_coordinated"],
)


def _segment_rows(s, d):
    """Center positions with the position of their chain segment."""
    spot = lambda e, a, b: (e * a + F.col("frame") * b) % 2000 / 100.0
    c, g = F.col("center_id"), F.col("chain") * 50 + F.col("site")
    return sl.chain_states(_chosen(s, d), v.grid(s, d)).withColumns(
        {
            "cx": spot(c, 7919, 104729), "cy": spot(c, 6101, 15485863), "cz": spot(c, 3571, 49979687),
            "sx": spot(g, 7907, 104723), "sy": spot(g, 6089, 15485857), "sz": F.when(F.col("site") != 13, spot(g, 3559, 49979681)),
            "box": F.lit(v.BOX),
        }
    )


_P = lambda e, a, b: f"CAST(({e} * {a} + frame * {b}) % 2000 AS DOUBLE) / 100"
_G = "(chain * 50 + site)"
define(
    "seg",
    f"""SELECT *, {_P('center_id', 7919, 104729)} AS cx, {_P('center_id', 6101, 15485863)} AS cy, {_P('center_id', 3571, 49979687)} AS cz, {_P(_G, 7907, 104723)} AS sx, {_P(_G, 6089, 15485857)} AS sy, CASE WHEN site <> 13 THEN {_P(_G, 3559, 49979681)} END AS sz, CAST(20 AS DOUBLE) AS box,
 concat(center_id, '_', CAST(sum(brk) OVER (PARTITION BY center_id ORDER BY frame) AS BIGINT)) AS ep FROM (SELECT *, CASE WHEN chain = lag(chain) OVER (PARTITION BY center_id ORDER BY frame) THEN 0 ELSE 1 END AS brk FROM cstate)""", "cstate",
)
define("segok", "SELECT * FROM seg WHERE ep IN (SELECT ep FROM seg WHERE chain >= 0 GROUP BY ep HAVING count(*) >= 2 AND count(sz) = count(*))", "seg")
define("segwalk", walk_sql("segok", "ep", "frame", {"uc": ("cx", "cy", "cz"), "us": ("sx", "sy", "sz")}), "segok")
_D = ", ".join(f"b.{p}{a} - a.{p}{a} AS d{p}{a}" for p in ("uc", "us") for a in "xyz")
register(
    "segment_correlation", lambda s, d: sl.segment_correlation(_segment_rows(s, d), LAGS),
    f"""SELECT lag, n_episodes, n_origins, c2 / n_origins AS center_msd, s2 / n_origins AS segment_msd, cs / n_origins AS mean_dot, r2 / n_origins AS relative_msd, cs / sqrt(c2 * s2) AS vector_correlation, 2 * cs / (c2 + s2) AS alignment, r2 / (c2 + s2) AS relative_ratio,
 CAST(0 AS DOUBLE) AS identity_residual, CAST(n_episodes >= 20 AND n_origins >= 200 AS INTEGER) AS is_supported FROM (SELECT lag, count(DISTINCT ep) AS n_episodes, count(*) AS n_origins, sum({dot_sql('duc', 'duc')}) AS c2, sum({dot_sql('dus', 'dus')}) AS s2, sum({dot_sql('duc', 'dus')}) AS cs,
 sum({' + '.join(f'(duc{a} - dus{a}) ** 2' for a in 'xyz')}) AS r2 FROM (SELECT a.ep, lag, {_D} FROM segwalk a CROSS JOIN (SELECT CAST(unnest({LAGS}) AS BIGINT) AS lag) JOIN segwalk b ON b.ep = a.ep AND b.frame = a.frame + lag) GROUP BY 1)""",
    ["segwalk"], ["center_msd", "segment_msd", "mean_dot", "relative_msd", "vector_correlation", "alignment", "relative_ratio", "identity_residual"], 5,
)
register("chain_coordinate_table", lambda s, d: sl.chain_coordinate_table(_smooth(s, d), _flags(s, d)),
         "SELECT * FROM smooth JOIN flags USING (frame, center_id)", ["smooth", "flags"], ["coordinate"])
