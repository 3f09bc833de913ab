"""Queries over contact, state and bridge events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.operators import blocks as bl
from ionweave.operators import contacts as ct
from ionweave.operators import events as ev
from ionweave.plans import views as v
from ionweave.plans.registry import define, register

KEYS = ["contact_type", "center_id", "partner_id", "site_index"]
KEY_SQL = ", ".join(KEYS)


def bounds(s, d):
    b = v.frame_bounds(s, d)
    return b.select("first").scalar(), b.select("last").scalar()


def _presence(s, d):
    return ev.contact_presence(v.contacts(s, d))


def contact_events(s, d):
    return ev.contact_events(_presence(s, d), KEYS, *bounds(s, d), v.DT_PS)


def state_events(s, d):
    return ev.state_events(v.states(s, d), *bounds(s, d), v.DT_PS)


def _blocks(s, d):
    return bl.frame_blocks(v.frames(s, d))


define(
    "presence",
    """SELECT DISTINCT CASE ligand_kind WHEN 'polymer' THEN 'polymer_site' ELSE 'anion_site' END AS contact_type, center_id, ligand_id AS partner_id, site_index, frame FROM contacts
 UNION ALL SELECT DISTINCT CASE ligand_kind WHEN 'polymer' THEN 'polymer_chain' ELSE 'anion_molecule' END, center_id, ligand_id, -1, frame FROM contacts""",
    "contacts",
)


def islands(table: str, keys: str, gap: int, value: str = "") -> str:
    """SQL for gaps and islands with a frame tolerance and an optional value break."""
    change = f" OR {value} IS DISTINCT FROM lag({value}) OVER w" if value else ""
    extra = f", {value}" if value else ""
    return f"""SELECT {keys}{extra}, run, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_present FROM (
 SELECT *, CAST(sum(brk) OVER (PARTITION BY {keys} ORDER BY frame) AS BIGINT) AS run FROM (
 SELECT *, CASE WHEN frame - lag(frame) OVER w <= {gap + 1}{' AND ' + value + ' = lag(' + value + ') OVER w' if value else ''} THEN 0 ELSE 1 END AS brk FROM {table} WINDOW w AS (PARTITION BY {keys} ORDER BY frame)))
 GROUP BY {keys}{extra}, run"""


CENSOR = """CAST((end_frame - start_frame + 1) * 30 AS DOUBLE) AS duration_ps, CAST(start_frame = f0 AS INTEGER) AS left_censored,
 CAST(end_frame = f1 AS INTEGER) AS right_censored, CAST(start_frame = f0 OR end_frame = f1 AS INTEGER) AS censored"""

define(
    "cevents",
    f"""SELECT e.*, {CENSOR} FROM (SELECT *, 'continuous' AS rule FROM ({islands('presence', KEY_SQL, 0)})
 UNION ALL SELECT *, 'intermittent' FROM ({islands('presence', KEY_SQL, 2)})) e, bounds""",
    "presence", "bounds",
)
define("sevents", f"SELECT e.*, {CENSOR} FROM ({islands('states', 'center_id', 0, 'state')}) e, bounds", "states", "bounds")

register("contact_presence", _presence, "SELECT * FROM presence", ["presence"])
register("presence_runs", lambda s, d: ev.presence_runs(_presence(s, d), KEYS, 2),
         islands("presence", KEY_SQL, 2), ["presence"])
register("contact_events", contact_events, "SELECT * FROM cevents", ["cevents"], ["duration_ps"])
register("state_events", state_events, "SELECT * FROM sevents", ["sevents"], ["duration_ps"])
define(
    "trans",
    """SELECT f AS from_state, t AS to_state, coalesce(n, 0) AS count FROM (SELECT unnest(['P', 'PT', 'T', 'F']) AS f) CROSS JOIN (SELECT unnest(['P', 'PT', 'T', 'F']) AS t)
 LEFT JOIN (SELECT a.state AS f, b.state AS t, count(*) AS n FROM states a JOIN states b ON a.center_id = b.center_id AND b.frame = a.frame + 1 GROUP BY 1, 2) USING (f, t)""",
    "states",
)
register(
    "state_transitions", lambda s, d: ev.state_transitions(v.states(s, d)),
    """SELECT *, coalesce(count / nullif(sum(count) OVER w, 0), 0) AS p_all,
 coalesce(CASE WHEN from_state <> to_state THEN count ELSE 0 END / nullif(sum(CASE WHEN from_state <> to_state THEN count ELSE 0 END) OVER w, 0), 0) AS p_change
 FROM trans WINDOW w AS (PARTITION BY from_state)""",
    ["trans"], ["p_all", "p_change"],
)


def _exchange(s, d):
    return ev.ligand_exchange(_presence(s, d), v.grid(s, d), *bounds(s, d))


define(
    "exch",
    """SELECT contact_type, g.center_id, g.frame, CAST(coalesce(p, 0) AS BIGINT) AS n_previous, CAST(coalesce(c, 0) AS BIGINT) AS n_current, CAST(coalesce(gg, 0) AS BIGINT) AS n_gained,
 CAST(coalesce(l, 0) AS BIGINT) AS n_lost, CAST(coalesce(r, 0) AS BIGINT) AS n_retained, CAST(coalesce(gg + l, 0) > 0 AS INTEGER) AS occurred
 FROM (SELECT * FROM grid, bounds WHERE frame > f0) g CROSS JOIN (SELECT unnest(['polymer_site', 'polymer_chain', 'anion_site', 'anion_molecule']) AS contact_type)
 LEFT JOIN (SELECT contact_type, center_id, frame, count(pf) AS p, count(cf) AS c, count(*) FILTER (pf IS NULL) AS gg, count(*) FILTER (cf IS NULL) AS l, count(*) FILTER (pf IS NOT NULL AND cf IS NOT NULL) AS r
  FROM (SELECT *, frame AS cf FROM presence) a
  FULL JOIN (SELECT contact_type, center_id, partner_id, site_index, frame + 1 AS frame, frame AS pf FROM presence) b USING (contact_type, center_id, partner_id, site_index, frame) GROUP BY 1, 2, 3) x
 USING (contact_type, center_id, frame)""",
    "grid", "bounds", "presence",
)
define(
    "exblock",
    """SELECT *, total_gained / n_observations AS mean_gained, total_lost / n_observations AS mean_lost, n_exchange_steps / n_observations AS exchange_probability,
 n_exchange_steps / (n_observations * CAST(0.03 AS DOUBLE)) AS exchange_per_center_ns FROM
 (SELECT contact_type, block, count(*) AS n_observations, CAST(sum(occurred) AS BIGINT) AS n_exchange_steps, CAST(sum(n_gained) AS BIGINT) AS total_gained, CAST(sum(n_lost) AS BIGINT) AS total_lost
 FROM exch JOIN blocks USING (frame) GROUP BY 1, 2)""",
    "exch", "blocks",
)
register("ligand_exchange", _exchange, "SELECT * FROM exch", ["exch"])
_EXB = ["mean_gained", "mean_lost", "exchange_probability", "exchange_per_center_ns"]
register("exchange_block_summary", lambda s, d: ev.exchange_block_summary(_exchange(s, d), _blocks(s, d), v.DT_PS),
         "SELECT * FROM exblock", ["exblock"], _EXB)
register(
    "exchange_summary", lambda s, d: ev.exchange_summary(ev.exchange_block_summary(_exchange(s, d), _blocks(s, d), v.DT_PS)),
    """SELECT contact_type, avg(exchange_probability) AS mean_exchange_probability, stddev_samp(exchange_probability) AS block_std_exchange_probability,
 avg(exchange_per_center_ns) AS mean_exchange_per_center_ns, stddev_samp(exchange_per_center_ns) AS block_std_exchange_per_center_ns,
 stddev_samp(exchange_per_center_ns) / sqrt(count(DISTINCT block)) AS block_sem_exchange_per_center_ns, avg(mean_gained) AS mean_gained, avg(mean_lost) AS mean_lost,
 count(DISTINCT block) AS n_blocks FROM exblock GROUP BY 1""",
    ["exblock"],
    ["mean_exchange_probability", "block_std_exchange_probability", "mean_exchange_per_center_ns", "block_std_exchange_per_center_ns",
     "block_sem_exchange_per_center_ns", "mean_gained", "mean_lost"],
)


def _bridge_events(s, d):
    on = ct.anion_bridging(v.contacts(s, d)).filter("is_bridging = 1").select("anion_id", "frame")
    return ev.contact_events(on, ["anion_id"], *bounds(s, d), v.DT_PS)


define("bridging", "SELECT anion_id, frame FROM anions WHERE is_bridging = 1", "anions")
register(
    "anion_bridge_events", _bridge_events,
    f"""SELECT e.*, {CENSOR} FROM (SELECT *, 'continuous' AS rule FROM ({islands('bridging', 'anion_id', 0)})
 UNION ALL SELECT *, 'intermittent' FROM ({islands('bridging', 'anion_id', 2)})) e, bounds""",
    ["bridging", "bounds"], ["duration_ps"],
)
_BY = ["contact_type", "rule"]
register(
    "lifetime_summary", lambda s, d: ev.lifetime_summary(contact_events(s, d), _BY),
    """SELECT contact_type, rule, count(*) AS n_events, count(*) FILTER (censored = 0) AS n_uncensored, avg(censored) AS fraction_censored, avg(duration_ps) AS mean_all_ps,
 median(duration_ps) AS median_all_ps, avg(duration_ps) FILTER (censored = 0) AS mean_uncensored_ps, median(duration_ps) FILTER (censored = 0) AS median_uncensored_ps,
 max(duration_ps) AS max_ps FROM cevents GROUP BY 1, 2""",
    ["cevents"], ["fraction_censored", "mean_all_ps", "median_all_ps", "mean_uncensored_ps", "median_uncensored_ps", "max_ps"],
)
define(
    "lifeblocks",
    """SELECT contact_type, rule, block, avg(duration_ps) AS mean_lifetime_ps, median(duration_ps) AS median_lifetime_ps, count(*) AS n_events
 FROM cevents JOIN blocks ON blocks.frame = start_frame WHERE censored = 0 GROUP BY 1, 2, 3""",
    "cevents", "blocks",
)
register("lifetime_block_means", lambda s, d: ev.lifetime_block_means(contact_events(s, d), _blocks(s, d), _BY),
         "SELECT * FROM lifeblocks", ["lifeblocks"], ["mean_lifetime_ps", "median_lifetime_ps"])
register(
    "lifetime_block_summary",
    lambda s, d: ev.lifetime_block_summary(ev.lifetime_block_means(contact_events(s, d), _blocks(s, d), _BY), _BY),
    """SELECT contact_type, rule, avg(mean_lifetime_ps) AS mean_of_block_means_ps, stddev_samp(mean_lifetime_ps) AS block_std_ps, stddev_samp(mean_lifetime_ps) / sqrt(count(*)) AS block_sem_ps,
 count(*) AS n_blocks, CAST(sum(n_events) AS BIGINT) AS n_uncensored FROM lifeblocks GROUP BY 1, 2""",
    ["lifeblocks"], ["mean_of_block_means_ps", "block_std_ps", "block_sem_ps"],
)


def km_sql(source: str, by: str, origin: bool, support: int | None, time: str = "duration_ps") -> str:
    part = f"PARTITION BY {by}" if by else ""
    g = f"{by}, " if by else ""
    flag = "" if support is None else f", CAST(n >= {support} AS INTEGER) AS is_supported"
    base = f"""WITH d AS (SELECT {g}{time} AS time_ps, count(*) FILTER (right_censored = 0) AS n_terminated, count(*) FILTER (right_censored = 1) AS n_censored FROM {source} GROUP BY ALL),
 t AS (SELECT *, CAST(sum(n_terminated + n_censored) OVER ({part} ORDER BY time_ps DESC) AS BIGINT) AS n_at_risk, sum(n_terminated + n_censored) OVER ({part}) AS n FROM d),
 c AS (SELECT {g}time_ps, product(1 - n_terminated / n_at_risk) OVER ({part} ORDER BY time_ps) AS survival, n_at_risk, n_terminated, n_censored, n FROM t)
 SELECT * EXCLUDE (n){flag} FROM c"""
    if origin:
        base += f" UNION ALL SELECT {g}0, 1, CAST(n AS BIGINT), 0, 0{flag} FROM (SELECT DISTINCT {g}n FROM c)"
    return f"SELECT * FROM ({base})"


register("kaplan_meier", lambda s, d: ev.kaplan_meier(contact_events(s, d), _BY),
         km_sql("cevents", "contact_type, rule", True, 5), ["cevents"], ["time_ps", "survival"])
register("state_survival", lambda s, d: ev.kaplan_meier(state_events(s, d), ["state"]),
         km_sql("sevents", "state", True, 5), ["sevents"], ["time_ps", "survival"])
register(
    "state_lifetime_summary", lambda s, d: ev.lifetime_summary(state_events(s, d), ["state"]),
    """SELECT state, count(*) AS n_events, count(*) FILTER (censored = 0) AS n_uncensored, avg(censored) AS fraction_censored, avg(duration_ps) AS mean_all_ps,
 median(duration_ps) AS median_all_ps, avg(duration_ps) FILTER (censored = 0) AS mean_uncensored_ps, median(duration_ps) FILTER (censored = 0) AS median_uncensored_ps,
 max(duration_ps) AS max_ps FROM sevents GROUP BY 1""",
    ["sevents"], ["fraction_censored", "mean_all_ps", "median_all_ps", "mean_uncensored_ps", "median_uncensored_ps", "max_ps"],
)
