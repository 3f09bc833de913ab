"""Queries over bound pairs, their events and the pair population."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.operators import pairs as pr
from ionweave.operators import population as po
from ionweave.plans import views as v
from ionweave.plans.q_dynamics import bounds, islands, km_sql
from ionweave.plans.registry import define, register
from ionweave.session import scratch
from ionweave.streaming.pair_tracker import pair_events_stream

PLAIN = ["frame", "center_id", "anion_id", "n_sites", "min_distance", "mean_distance"]


def _pairs(s, d):
    return v.pairs(s, d).select(*PLAIN)


def events(s, d):
    """The pair table: a stage table, read by every pair query."""
    return v.shared(s, d, "pair_events", lambda: pr.pair_events(_pairs(s, d), v.frames(s, d), v.DT_PS))


def _n_centers(s, d):
    return v.table(s, d, "supplier").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()


def _n_anions(s, d):
    return v.table(s, d, "supplier").select((F.max(F.floor(F.col("s_suppkey") / 2)) + 3).alias("n")).scalar()


def summary(s, d):
    return pr.pair_event_summary(events(s, d), *bounds(s, d), v.DT_PS)


def _frame_rows(s, d):
    return pr.frame_pair_summary(events(s, d), v.frames(s, d), _n_centers(s, d), _n_anions(s, d))


def _n_frames(s, d):
    return v.frame_bounds(s, d).select((F.col("last") - F.col("first") + 1).alias("n")).scalar()


def series(s, d):
    """Pairs per frame, empty frames included."""
    n = v.edges(s, d).groupBy("frame").agg(F.count(F.lit(1)).alias("value"))
    return v.frames(s, d).join(n, "frame", "left").fillna(0, ["value"])


define(
    "pevents",
    """SELECT frame, center_id, anion_id, n_sites, min_distance, mean_distance, frame - f0 AS ordinal, concat('M', center_id, '_T', anion_id) AS pair_id,
 concat('M', center_id, '_T', anion_id, '_E', lpad(CAST(run AS VARCHAR), 4, '0')) AS instance_id, run AS event_number, age AS age_frames, CAST((age - 1) * 30 AS DOUBLE) AS age_ps,
 frame - age + 1 AS start_frame, CAST(age > 1 AS INTEGER) AS continuing, CAST(age = 1 AS INTEGER) AS new_event FROM
 (SELECT *, row_number() OVER (PARTITION BY center_id, anion_id, run ORDER BY frame) AS age FROM
 (SELECT *, CAST(sum(brk) OVER (PARTITION BY center_id, anion_id ORDER BY frame) AS BIGINT) AS run FROM
 (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY center_id, anion_id ORDER BY frame) = 1 THEN 0 ELSE 1 END AS brk FROM pairs))), bounds""",
    "pairs", "bounds",
)
define(
    "psum",
    """SELECT *, CAST(regexp_extract(instance_id, '_E(\\d+)$', 1) AS BIGINT) AS event_number, CAST(event_no > 1 AS INTEGER) AS reformation, last_frame - first_frame + 1 AS expected_frames,
 CAST(n_frames = last_frame - first_frame + 1 AS INTEGER) AS is_continuous, CAST((last_frame - first_frame) * 30 AS DOUBLE) AS span_ps, CAST(n_frames * 30 AS DOUBLE) AS occupancy_ps,
 CAST(first_frame = f0 AS INTEGER) AS left_censored, CAST(last_frame = f1 AS INTEGER) AS right_censored, CAST(first_frame = f0 AND last_frame = f1 AS INTEGER) AS fully_censored,
 CAST(first_frame <> f0 AND last_frame <> f1 AS INTEGER) AS completed FROM
 (SELECT instance_id, pair_id, center_id, anion_id, max(event_number) AS event_no, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames, avg(min_distance) AS mean_min_distance,
 min(min_distance) AS min_distance, max(min_distance) AS max_min_distance, avg(mean_distance) AS mean_distance, avg(n_sites) AS mean_sites, max(n_sites) AS max_sites,
 count(*) FILTER (n_sites >= 2) AS n_multi_site_frames, avg(CAST(n_sites >= 2 AS INTEGER)) AS frac_multi_site, min(age_frames) AS first_age, max(age_frames) AS last_age,
 CAST(sum(new_event) AS BIGINT) AS n_new_flags, CAST(sum(continuing) AS BIGINT) AS n_continuing_flags FROM pevents GROUP BY 1, 2, 3, 4), bounds""",
    "pevents", "bounds",
)
_PD = ["min_distance", "mean_distance"]


def _stream(s, d):
    """Drive the stateful stream over the pair table in frame order, a third at a time with a restart between, and read its sink."""
    source = v.shared(s, d, "stream_input", lambda: events(s, d).select("center_id", "anion_id", "frame", "ordinal"))
    n = source.agg(F.max("ordinal") + 1).first()[0] or 0
    out = scratch(s, "stream")
    for k in range(3):
        part = source.filter((F.col("ordinal") * 3 >= k * n) & (F.col("ordinal") * 3 < (k + 1) * n))
        part.write.mode("append").parquet(f"{out}/input")
        numbered = pair_events_stream(s.readStream.schema(source.schema).parquet(f"{out}/input"))
        numbered.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(
            availableNow=True
        ).start().awaitTermination()
    return s.read.parquet(f"{out}/rows")


register("pair_events_stream", _stream, "SELECT center_id, anion_id, frame, ordinal, event_number, age_frames, continuing, new_event, 0 AS is_late FROM pevents", ["pevents"])
register("frame_pairs", lambda s, d: pr.frame_pairs(v.contacts(s, d)),
         "SELECT frame, center_id, anion_id, n_sites, min_distance, mean_distance FROM pairs", ["pairs"], _PD)
register("pair_events", events, "SELECT * FROM pevents", ["pevents"], [*_PD, "age_ps"])


def _rows(s, d):
    at = v.pairs(s, d)
    centers = at.groupBy("frame", "center_id").agg(*[F.min(c).alias(c) for c in ("cx", "cy", "cz", "box")])
    anions = at.groupBy("frame", "anion_id").agg(*[F.min(c).alias(c) for c in ("ax", "ay", "az")])
    return pr.pair_rows(events(s, d), centers, anions)


register("pair_rows", _rows, "SELECT e.*, cx, cy, cz, ax, ay, az, box FROM pevents e JOIN pairs USING (frame, center_id, anion_id)",
         ["pevents", "pairs"], [*_PD, "age_ps"])
define(
    "frows",
    """SELECT frame, coalesce(n_contacts, 0) AS n_contacts, coalesce(np, 0) AS n_pairs, coalesce(ncc, 0) AS n_coordinated_centers, coalesce(ncc, 0) / (SELECT count(*) FROM supplier) AS frac_coordinated_centers,
 coalesce(nca, 0) AS n_coordinated_anions, coalesce(nca, 0) / (SELECT max(s_suppkey // 2) + 3 FROM supplier) AS frac_coordinated_anions, coalesce(np, 0) / (SELECT count(*) FROM supplier) AS mean_pairs_per_center,
 coalesce(np / nullif(ncc, 0), 0) AS mean_pairs_per_coordinated_center, coalesce(mx, 0) AS max_pairs_per_center, coalesce(ms, 0) AS mean_sites_per_pair, coalesce(xs, 0) AS max_sites_per_pair, mean_min_distance,
 coalesce(nc, 0) AS n_continuing, coalesce(nn, 0) AS n_new, (SELECT count(*) FROM pevents p WHERE p.frame = frames.frame - 1) - coalesce(nc, 0) AS n_ended
 FROM frames LEFT JOIN (SELECT frame, CAST(sum(n_sites) AS BIGINT) AS n_contacts, count(*) AS np, count(DISTINCT center_id) AS ncc, count(DISTINCT anion_id) AS nca, avg(n_sites) AS ms, max(n_sites) AS xs,
 avg(min_distance) AS mean_min_distance, CAST(sum(continuing) AS BIGINT) AS nc, CAST(sum(new_event) AS BIGINT) AS nn FROM pevents GROUP BY 1) USING (frame)
 LEFT JOIN (SELECT frame, max(n) AS mx FROM (SELECT frame, center_id, count(*) AS n FROM pevents GROUP BY 1, 2) GROUP BY 1) USING (frame)""",
    "frames", "pevents",
)
register("frame_pair_summary", _frame_rows, "SELECT * FROM frows", ["frows"],
         ["frac_coordinated_centers", "frac_coordinated_anions", "mean_pairs_per_center", "mean_pairs_per_coordinated_center", "mean_sites_per_pair", "mean_min_distance"])
register("pair_event_summary", summary, "SELECT * EXCLUDE (event_no, f0, f1, nf) FROM psum", ["psum"],
         ["mean_min_distance", "min_distance", "max_min_distance", "mean_distance", "mean_sites", "frac_multi_site", "span_ps", "occupancy_ps"])
register(
    "distance_histogram", lambda s, d: pr.distance_histogram(_pairs(s, d), 4.0),
    """SELECT bin, (bin + 0.5) * (CAST(4 AS DOUBLE) / 200) AS center, coalesce(n, 0) AS count, coalesce(n, 0) / ((SELECT count(*) FROM pairs WHERE min_distance BETWEEN 0 AND 4) * (CAST(4 AS DOUBLE) / 200)) AS density,
 (SELECT count(*) FROM pairs WHERE min_distance < 0) AS n_below, (SELECT count(*) FROM pairs WHERE min_distance > 4) AS n_above
 FROM (SELECT unnest(range(200)) AS bin) LEFT JOIN (SELECT least(CAST(floor(min_distance / (CAST(4 AS DOUBLE) / 200)) AS BIGINT), 199) AS bin, count(*) AS n FROM pairs WHERE min_distance BETWEEN 0 AND 4 GROUP BY 1) USING (bin)""",
    ["pairs"], ["center", "density"],
)
register("site_multiplicity", lambda s, d: pr.site_multiplicity(_pairs(s, d)),
         "SELECT n_sites, count(*) AS count, count(*) / sum(count(*)) OVER () AS probability FROM pairs GROUP BY 1", ["pairs"], ["probability"])
register("distance_outliers", lambda s, d: pr.distance_outliers(_pairs(s, d)),
         "SELECT frame, center_id, anion_id, n_sites, min_distance, mean_distance FROM pairs WHERE min_distance < 1.8", ["pairs"], _PD)
define(
    "pident",
    """SELECT pair_id, center_id, anion_id, count(*) AS n_events, CAST(sum(reformation) AS BIGINT) AS n_reformations, CAST(sum(completed) AS BIGINT) AS n_completed, CAST(sum(left_censored) AS BIGINT) AS n_left_censored,
 CAST(sum(right_censored) AS BIGINT) AS n_right_censored, CAST(sum(fully_censored) AS BIGINT) AS n_fully_censored, min(first_frame) AS first_frame, max(last_frame) AS last_frame, CAST(sum(n_frames) AS BIGINT) AS total_frames,
 sum(n_frames) / (SELECT nf FROM bounds) AS occupancy_fraction, max(occupancy_ps) AS max_occupancy_ps, avg(occupancy_ps) FILTER (completed = 1) AS mean_completed_ps, median(occupancy_ps) FILTER (completed = 1) AS median_completed_ps,
 sum(mean_min_distance * n_frames) / sum(n_frames) AS mean_min_distance, min(min_distance) AS min_distance, sum(mean_sites * n_frames) / sum(n_frames) AS mean_sites, sum(n_multi_site_frames) / sum(n_frames) AS frac_multi_site
 FROM psum GROUP BY 1, 2, 3""",
    "psum", "bounds",
)


def _identity(s, d):
    return pr.pair_identity_summary(summary(s, d), _n_frames(s, d))


register("pair_identity_summary", _identity, "SELECT * FROM pident", ["pident"],
         ["occupancy_fraction", "max_occupancy_ps", "mean_completed_ps", "median_completed_ps", "mean_min_distance", "min_distance", "mean_sites", "frac_multi_site"])
_CLS = {
    "all_events": "true", "completed_events": "completed = 1", "left_censored_events": "left_censored = 1", "right_censored_events": "right_censored = 1",
    "fully_censored_events": "fully_censored = 1", "first_formation_events": "reformation = 0", "reformation_events": "reformation = 1",
}
register(
    "pair_lifetime_summary", lambda s, d: pr.pair_lifetime_summary(summary(s, d)),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS event_class, count(*) AS n_events, avg(occupancy_ps) AS mean_ps, median(occupancy_ps) AS median_ps, stddev_samp(occupancy_ps) AS std_ps, min(occupancy_ps) AS min_ps,
 quantile_cont(occupancy_ps, 0.25) AS p25_ps, quantile_cont(occupancy_ps, 0.75) AS p75_ps, quantile_cont(occupancy_ps, 0.9) AS p90_ps, quantile_cont(occupancy_ps, 0.95) AS p95_ps, max(occupancy_ps) AS max_ps FROM psum WHERE {t}"""
        for c, t in _CLS.items()
    ), ["psum"], ["mean_ps", "median_ps", "std_ps", "min_ps", "p25_ps", "p75_ps", "p90_ps", "p95_ps", "max_ps"],
)
define("pserie", "SELECT frame, coalesce(n, 0) AS value, row_number() OVER (ORDER BY frame) - 1 AS o FROM frames LEFT JOIN (SELECT frame, count(*) AS n FROM edges GROUP BY 1) USING (frame)", "frames", "edges")
register(
    "population_rolling_mean", lambda s, d: po.population_rolling_mean(series(s, d), 33),
    "SELECT frame, value, CASE WHEN count(*) OVER w >= 8 THEN avg(value) OVER w END AS rolling_mean FROM pserie WINDOW w AS (ORDER BY frame ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING)",
    ["pserie"], ["rolling_mean"],
)


def _pop_blocks(s, d):
    return po.population_blocks(_frame_rows(s, d).withColumn("value", F.col("n_pairs")), 40, v.DT_PS, ["frac_coordinated_centers", "frac_coordinated_anions", "n_contacts"])


define(
    "pblocks",
    """SELECT (frame - f0) // 40 AS block, min(frame) AS start_frame, max(frame) AS end_frame, CAST(0.015 AS DOUBLE) * (min(frame) + max(frame)) AS midpoint_ns, count(*) AS n_frames, CAST(count(*) >= 36 AS INTEGER) AS is_complete,
 avg(n_pairs) AS mean, stddev_samp(n_pairs) AS std, stddev_samp(n_pairs) / sqrt(count(*)) AS sem, min(n_pairs) AS minimum, max(n_pairs) AS maximum, avg(frac_coordinated_centers) AS mean_frac_coordinated_centers,
 avg(frac_coordinated_anions) AS mean_frac_coordinated_anions, avg(n_contacts) AS mean_n_contacts FROM frows, bounds GROUP BY 1""",
    "frows", "bounds",
)
register("population_blocks", _pop_blocks, "SELECT * FROM pblocks", ["pblocks"],
         ["midpoint_ns", "mean", "std", "sem", "mean_frac_coordinated_centers", "mean_frac_coordinated_anions", "mean_n_contacts"])


def trend_sql(x: str, y: str) -> str:
    return f"""CASE WHEN regr_count({y}, {x}) >= 3 THEN regr_slope({y}, {x}) END AS slope, CASE WHEN regr_count({y}, {x}) >= 3 THEN regr_intercept({y}, {x}) END AS intercept, CASE WHEN regr_count({y}, {x}) >= 3 THEN regr_r2({y}, {x}) END AS r2,
 CASE WHEN regr_count({y}, {x}) >= 3 THEN sqrt((regr_syy({y}, {x}) - regr_slope({y}, {x}) * regr_slope({y}, {x}) * regr_sxx({y}, {x})) / (regr_count({y}, {x}) - 2) / regr_sxx({y}, {x})) END AS slope_error,
 CASE WHEN regr_count({y}, {x}) >= 3 THEN regr_slope({y}, {x}) * (max({x}) - min({x})) END AS net_change"""


_TR = ["slope", "intercept", "r2", "slope_error", "net_change"]
register("linear_trend", lambda s, d: po.linear_trend(_pop_blocks(s, d).filter("is_complete = 1"), "midpoint_ns", "mean"),
         f"SELECT {trend_sql('midpoint_ns', 'mean')} FROM pblocks WHERE is_complete = 1", ["pblocks"], _TR)
register(
    "equilibration_sensitivity", lambda s, d: po.equilibration_sensitivity(series(s, d), v.DT_PS, (0.0, 1.0, 2.0, 5.0, 10.0, 20.0)),
    f"""SELECT start_ns, min(t) AS actual_start_ns, max(t) AS end_ns, count(*) AS n_frames, avg(value) AS mean, stddev_samp(value) AS std, stddev_samp(value) / sqrt(count(*)) AS sem, {trend_sql('t', 'value')}
 FROM (SELECT CAST(unnest([0, 1, 2, 5, 10, 20]) AS DOUBLE) AS start_ns) JOIN (SELECT frame * CAST(0.03 AS DOUBLE) AS t, value FROM pserie) ON t >= start_ns WHERE start_ns < (SELECT max(frame) * 0.03 FROM pserie) GROUP BY 1""",
    ["pserie"], ["start_ns", "actual_start_ns", "end_ns", "mean", "std", "sem", *_TR],
)
define(
    "pacf",
    """SELECT lag, c / first_value(c) OVER (ORDER BY lag) AS acf FROM (SELECT b.o - a.o AS lag, sum((a.value - m) * (b.value - m)) / count(*) AS c
 FROM pserie a JOIN pserie b ON b.o >= a.o, (SELECT avg(value) AS m FROM pserie) GROUP BY 1)""",
    "pserie",
)
register("population_acf", lambda s, d: po.population_acf(series(s, d), 60), "SELECT * FROM pacf WHERE lag <= 60", ["pacf"], ["acf"])
register(
    "integrated_time", lambda s, d: po.integrated_time(series(s, d), lags_per_pass=64),
    """SELECT tau AS tau_frames, n / (2 * tau) AS effective_samples, CASE WHEN n / (2 * tau) > 1 THEN sd / sqrt(n / (2 * tau)) END AS corrected_sem FROM
 (SELECT 0.5 + coalesce(sum(acf), 0) AS tau FROM pacf WHERE lag >= 1 AND lag < coalesce((SELECT min(lag) FROM pacf WHERE acf <= 0), 1e18)), (SELECT count(*) AS n, stddev_samp(value) AS sd FROM pserie)""",
    ["pacf", "pserie"], ["tau_frames", "effective_samples", "corrected_sem"],
)
register(
    "half_split_drift", lambda s, d: po.half_split_drift(series(s, d)),
    "SELECT a AS first_half, b AS second_half, b - a AS difference, 100 * (b - a) / a AS percent FROM (SELECT avg(value) FILTER (o < (SELECT nf // 2 FROM bounds)) AS a, avg(value) FILTER (o >= (SELECT nf // 2 FROM bounds)) AS b FROM pserie)",
    ["pserie", "bounds"], ["first_half", "second_half", "difference", "percent"],
)
define("pfree", "SELECT * FROM psum WHERE left_censored = 0", "psum")
register("pair_survival", lambda s, d: pr.pair_survival(summary(s, d)), km_sql("pfree", "", False, None, "occupancy_ps"), ["pfree"], ["time_ps", "survival"])
register("median_survival", lambda s, d: pr.median_survival(pr.pair_survival(summary(s, d))),
         f"SELECT min(time_ps) AS median_survival_ps FROM ({km_sql('pfree', '', False, None, 'occupancy_ps')}) WHERE survival <= 0.5", ["pfree"], ["median_survival_ps"])


def _reconcile(s, d):
    ev, su = events(s, d), summary(s, d)
    return pr.stage_reconciliation(ev, su, pr.pair_identity_summary(su, _n_frames(s, d)), _frame_rows(s, d), pr.pair_survival(su))


register(
    "stage_reconciliation", _reconcile,
    f"""SELECT unnest(['event_rows', 'identity_rows', 'identity_events', 'frame_pairs', 'frame_new_events', 'frame_contacts', 'one_new_flag_per_event', 'events_are_continuous', 'survival_bounded']) AS "check",
 unnest([CAST(a = b AS INTEGER), CAST(a = c AS INTEGER), CAST(e = f AS INTEGER), CAST(a = g AS INTEGER), CAST(e = h AS INTEGER), CAST(i = j AS INTEGER), CAST(k = 1 AS INTEGER), CAST(l = 1 AS INTEGER), CAST(m >= 0 AND n <= 1 AS INTEGER)]) AS passed,
 unnest([CAST(a - b AS DOUBLE), a - c, e - f, a - g, e - h, i - j, k, l, m]) AS value FROM
 (SELECT count(*) AS a, sum(n_sites) AS i FROM pevents), (SELECT count(*) AS e, sum(n_frames) AS b, max(n_new_flags) AS k, min(is_continuous) AS l FROM psum), (SELECT sum(total_frames) AS c, sum(n_events) AS f FROM pident),
 (SELECT sum(n_pairs) AS g, sum(n_new) AS h, sum(n_contacts) AS j FROM frows), (SELECT min(survival) AS m, max(survival) AS n FROM ({km_sql('pfree', '', False, None, 'occupancy_ps')}))""",
    ["pevents", "psum", "pident", "frows", "pfree"], ["value"],
)
