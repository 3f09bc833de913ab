"""Queries over the joint motion of bound pairs."""

from __future__ import annotations


from ionweave.operators import comotion as cm
from ionweave.plans import views as v
from ionweave.plans.q_mobility import MASS, mic_sql
from ionweave.plans.q_pairs import events, summary
from ionweave.plans.registry import define, register

LAGS = [1, 2, 3]
MC, MA = MASS["metal"], MASS["anion"]
XYZ = ("cx", "cy", "cz", "ax", "ay", "az")


def _rows(s, d):
    at = v.pairs(s, d).select("frame", "center_id", "anion_id", *XYZ, "box")
    return events(s, d).select("frame", "center_id", "anion_id", "instance_id", "ordinal").join(at, ["frame", "center_id", "anion_id"])


def _classes(s, d):
    return cm.event_classes(summary(s, d))


def _lag_sums(s, d):
    return cm.event_lag_sums(_rows(s, d), LAGS, MC, MA)


def lag_table(s, d):
    cls = _classes(s, d).select("instance_id", "completed", "lifetime_class", "formation_class", "coordination_class")
    return v.shared(s, d, "pair_lags", lambda: _lag_sums(s, d).join(cls, "instance_id"))


define(
    "pclass",
    """SELECT *, CASE WHEN occupancy_ps <= 50 THEN 'transient_10_50_ps' WHEN occupancy_ps <= 500 THEN 'short_50_500_ps' WHEN occupancy_ps <= 5000 THEN 'intermediate_0.5_5_ns' ELSE 'persistent_gt_5_ns' END AS lifetime_class,
 CASE WHEN reformation = 1 THEN 'reformation_event' ELSE 'first_formation_event' END AS formation_class,
 CASE WHEN frac_multi_site <= 0 THEN 'strictly_monodentate' WHEN frac_multi_site <= 0.25 THEN 'occasional_multioxygen' ELSE 'multioxygen_enriched' END AS coordination_class FROM psum""",
    "psum",
)
register("event_classes", lambda s, d: _classes(s, d).select("instance_id", "occupancy_ps", "lifetime_class", "formation_class", "coordination_class"),
         "SELECT instance_id, occupancy_ps, lifetime_class, formation_class, coordination_class FROM pclass", ["pclass"], ["occupancy_ps"])
for _c in ("lifetime_class", "formation_class", "coordination_class"):
    register(
        f"class_counts_{_c[:-6]}", lambda s, d, c=_c: cm.class_counts(_classes(s, d), c),
        f"SELECT {_c}, count(*) AS n_events, CAST(sum(completed) AS BIGINT) AS n_completed, CAST(sum(n_frames) AS BIGINT) AS n_frames, median(occupancy_ps) AS median_occupancy_ps, max(occupancy_ps) AS max_occupancy_ps FROM pclass GROUP BY 1",
        ["pclass"], ["median_occupancy_ps", "max_occupancy_ps"],
    )


def walk_sql(src: str, key: str, order: str, bodies: dict[str, tuple[str, str, str]]) -> str:
    """Running unwrapped positions of several bodies per event."""
    step = ", ".join(f"coalesce({mic_sql(f'{c} - lag({c}) OVER w')}, {c}) AS s_{b}{a}" for b, xyz in bodies.items() for a, c in zip("xyz", xyz))
    tot = ", ".join(f"sum(s_{b}{a}) OVER (PARTITION BY {key} ORDER BY {order}) AS {b}{a}" for b in bodies for a in "xyz")
    lens = ", ".join(f"CASE WHEN NOT f0 THEN sqrt(s_{b}x ** 2 + s_{b}y ** 2 + s_{b}z ** 2) END AS {b}step" for b in bodies)
    return f"SELECT *, {tot}, {lens} FROM (SELECT *, {step}, lag({order}) OVER w IS NULL AS f0 FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY {order}))"


define("prow", "SELECT e.frame, e.center_id, e.anion_id, instance_id, ordinal, cx, cy, cz, ax, ay, az, box FROM pevents e JOIN pairs USING (frame, center_id, anion_id)", "pevents", "pairs")
define("pwalk", walk_sql("prow", "instance_id", "ordinal", {"uc": ("cx", "cy", "cz"), "ua": ("ax", "ay", "az")}), "prow")


def moves_sql(src: str, key: str, order: str, bodies, lags) -> str:
    d = ", ".join(f"b.{p}{a} - a.{p}{a} AS d{p}{a}" for p in bodies for a in "xyz")
    return f"SELECT a.{key}, lag, {d} FROM {src} a CROSS JOIN (SELECT CAST(unnest({lags}) AS BIGINT) AS lag) JOIN {src} b ON b.{key} = a.{key} AND b.{order} = a.{order} + lag"


def dot_sql(p: str, q: str) -> str:
    return "(" + " + ".join(f"{p}{a} * {q}{a}" for a in "xyz") + ")"


define("pmove", moves_sql("pwalk", "instance_id", "ordinal", ("uc", "ua"), LAGS), "pwalk")
_C2, _A2, _DOT = dot_sql("duc", "duc"), dot_sql("dua", "dua"), dot_sql("duc", "dua")
_COM = " + ".join(f"(({MC} * duc{a} + {MA} * dua{a}) / {MC + MA}) ** 2" for a in "xyz")
define(
    "plag",
    f"""SELECT instance_id, lag, count(*) AS n_origins, sum({_C2}) AS sum_c2, sum({_A2}) AS sum_a2, sum({' + '.join(f'(duc{a} - dua{a}) ** 2' for a in 'xyz')}) AS sum_rel2,
 sum({' + '.join(f'(0.5 * (duc{a} + dua{a})) ** 2' for a in 'xyz')}) AS sum_mid2, sum({_COM}) AS sum_com2, sum({_DOT}) AS sum_dot,
 coalesce(sum(CASE WHEN sqrt({_C2}) * sqrt({_A2}) > 1e-20 THEN {_DOT} / (sqrt({_C2}) * sqrt({_A2})) END), 0) AS sum_cos, count(CASE WHEN sqrt({_C2}) * sqrt({_A2}) > 1e-20 THEN 1 END) AS n_cos FROM pmove GROUP BY 1, 2""",
    "pmove",
)
_LS = {c: 5 for c in cm.PAIR_SUMS if c != "n_cos"}
register("event_lag_sums", _lag_sums, "SELECT * FROM plag", ["plag"], _LS)
register(
    "event_path_summary", lambda s, d: cm.event_path_summary(cm.unwrap_pairs(_rows(s, d)), MC, MA),
    f"""SELECT instance_id, n_frames, is_continuous, center_path, anion_path, center_max_step, anion_max_step, sqrt({dot_sql('c', 'c')}) AS net_center, sqrt({dot_sql('a', 'a')}) AS net_anion,
 sqrt({' + '.join(f'(c{a} - a{a}) ** 2' for a in 'xyz')}) AS net_relative, sqrt({' + '.join(f'(({MC} * c{a} + {MA} * a{a}) / {MC + MA}) ** 2' for a in 'xyz')}) AS net_com, {dot_sql('c', 'a')} AS net_dot,
 CASE WHEN sqrt({dot_sql('c', 'c')}) * sqrt({dot_sql('a', 'a')}) > 1e-20 THEN {dot_sql('c', 'a')} / (sqrt({dot_sql('c', 'c')}) * sqrt({dot_sql('a', 'a')})) END AS net_cosine FROM
 (SELECT instance_id, count(*) AS n_frames, CAST(count(*) = max(ordinal) - min(ordinal) + 1 AS INTEGER) AS is_continuous, coalesce(sum(ucstep), 0) AS center_path, coalesce(sum(uastep), 0) AS anion_path,
 coalesce(max(ucstep), 0) AS center_max_step, coalesce(max(uastep), 0) AS anion_max_step, {', '.join(f'arg_max(u{b}{a}, ordinal) - arg_min(u{b}{a}, ordinal) AS {b}{a}' for b in 'ca' for a in 'xyz')} FROM pwalk GROUP BY 1)""",
    ["pwalk"], ["center_path", "anion_path", "center_max_step", "anion_max_step", "net_center", "net_anion", "net_relative", "net_com", "net_dot", "net_cosine"], 5,
)
define(
    "pltab", "SELECT l.*, completed, lifetime_class, formation_class, coordination_class FROM plag l JOIN pclass USING (instance_id)", "plag", "pclass",
)


def scoped_sql(src: str, groups: dict[str, str | None], extra: str = "") -> str:
    one = " UNION ALL ".join(
        f"SELECT '{sc}' AS scope, '{k}' AS group_type, {repr('all') if c is None else c} AS group_label, * FROM {src} WHERE {w}"
        for sc, w in (("all_observed", "true"), ("completed_only", "completed = 1")) for k, c in groups.items()
    )
    return f"({one})"


PAIR_GROUPS = {"all": None, "lifetime": "lifetime_class", "formation": "formation_class", "coordination": "coordination_class"}
PAIR_METRICS = """c2 / n AS center_msd, a2 / n AS anion_msd, rel / n AS relative_msd, mid / n AS midpoint_msd, com / n AS com_msd, dt / n AS mean_dot, (dt / n) / nullif(sqrt(c2 / n * a2 / n), 0) AS vector_correlation,
 2 * dt / nullif(c2 + a2, 0) AS alignment, rel / nullif(c2 + a2, 0) AS relative_ratio, cs / nullif(nc, 0) AS mean_cosine"""
_PSUM = "sum(n_origins{w}) AS n, sum(sum_c2{w}) AS c2, sum(sum_a2{w}) AS a2, sum(sum_rel2{w}) AS rel, sum(sum_mid2{w}) AS mid, sum(sum_com2{w}) AS com, sum(sum_dot{w}) AS dt, sum(sum_cos{w}) AS cs, sum(n_cos{w}) AS nc"
define(
    "pcurve",
    f"""SELECT scope, group_type, group_label, lag, n_events, CAST(n AS BIGINT) AS n_origins, {PAIR_METRICS}, CAST(n_events >= 20 AND n >= 200 AS INTEGER) AS is_supported FROM
 (SELECT scope, group_type, group_label, lag, count(*) AS n_events, {_PSUM.format(w='')} FROM {scoped_sql('pltab', PAIR_GROUPS)} GROUP BY 1, 2, 3, 4)""",
    "pltab",
)
_M = ["center_msd", "anion_msd", "relative_msd", "midpoint_msd", "com_msd", "mean_dot", "vector_correlation", "alignment", "relative_ratio", "mean_cosine"]


def _curves(s, d):
    return cm.comotion_curves(lag_table(s, d))


register("comotion_curves", _curves, "SELECT * FROM pcurve", ["pcurve"], _M, 5)
register(
    "key_lag_lookup", lambda s, d: cm.key_lag_lookup(_curves(s, d), [0.01, 0.05, 0.1, 1.0], v.DT_PS),
    """SELECT target_ns, * EXCLUDE (target_ns, rk, scope, group_type, group_label, is_supported) FROM (SELECT *, row_number() OVER (PARTITION BY target_ns ORDER BY abs(lag * CAST(0.03 AS DOUBLE) - target_ns), lag) AS rk
 FROM pcurve CROSS JOIN (SELECT CAST(unnest([0.01, 0.05, 0.1, 1.0]) AS DOUBLE) AS target_ns) WHERE scope = 'all_observed' AND group_type = 'all' AND is_supported = 1) WHERE rk = 1""",
    ["pcurve"], {"target_ns": 6, **{m: 5 for m in _M}},
)
REPLICATES = 40
register(
    "bootstrap_ci",
    lambda s, d: cm.bootstrap_ci(lag_table(s, d), {"all": None, "formation": "formation_class"}, cm.PAIR_SUMS, cm.pair_metrics(), "instance_id", REPLICATES, seed=7),
    f"""SELECT scope, group_type, group_label, lag, max(n_events) AS n_events, {', '.join(f"quantile_cont(CASE WHEN n > 0 AND n_events >= 2 THEN {m} END, 0.025) AS {m}_low, quantile_cont(CASE WHEN n > 0 AND n_events >= 2 THEN {m} END, 0.975) AS {m}_high" for m in _M)}
 FROM (SELECT *, {PAIR_METRICS} FROM (SELECT scope, group_type, group_label, lag, replicate, count(*) AS n_events, {_PSUM.format(w=' * weight')} FROM
 {scoped_sql('(SELECT *, ' + ' + '.join(f'CAST(u >= CAST({e!r} AS DOUBLE) AS INTEGER)' for e in cm.POISSON_EDGES) + " AS weight FROM (SELECT *, CAST(CAST('0x' || substr(md5(concat('7|', replicate // 4, '|', instance_id)), 8 * (replicate % 4) + 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS u FROM pltab CROSS JOIN (SELECT unnest(range(" + str(REPLICATES) + ')) AS replicate)))', {'all': None, 'formation': 'formation_class'})} GROUP BY 1, 2, 3, 4, 5)) GROUP BY 1, 2, 3, 4""",
    ["pltab"], {f"{m}_{k}": 4 for m in _M for k in ("low", "high")},
)
