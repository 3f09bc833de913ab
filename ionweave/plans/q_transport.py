"""Queries over collective transport.  One track frame counts as 1 ns here."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions import lags as lg
from ionweave.operators import mobility as mo
from ionweave.operators import transport as tr
from ionweave.plans import views as v
from ionweave.plans.q_mobility import MASS_SQL, mass_column, unwrapped
from ionweave.plans.registry import define, register

DT = 1000.0
T_K = 373.0
Z = {"metal": 2.0, "cation": 1.0, "anion": -1.0}
MAX_NS = 100.0  # fixed value: the largest lag, where the track is long enough
SCHEMES = (
    tr.BlockScheme("4x20ns", 20.0, 12.0, 4, ((1.0, 8.0), (3.0, 11.0))),
    tr.BlockScheme("3x26ns", 26.0, 14.0, 3, ((1.0, 8.0), (4.0, 13.0))),
)
BLOCK_LAGS = {s.name: lg.stepped(10_000, DT, s.max_lag_ns, 25, 1.0) for s in SCHEMES}


def _volume(s, d):
    return v.track(s, d).agg(F.avg(F.col("box") * F.col("box") * F.col("box")).alias("v")).select("v").scalar()


def n_frames(s, d) -> int:
    """Frames that the tracks hold: one number."""
    return v.track(s, d).agg((F.max("frame") + 1).alias("n")).first()["n"]


def longest_ns(s, d) -> float:
    return min(MAX_NS, (n_frames(s, d) - 1) * DT / 1000.0)


def drift_free(s, d):
    """Unwrapped positions less the motion of the common center of mass."""
    return v.shared(s, d, "drift_free", lambda: mo.remove_drift(unwrapped(s, d), mass_column()))


def correlations(s, d):
    lags = lambda: lg.stepped(n_frames(s, d), DT, MAX_NS, 25, 1.0)
    return v.shared(s, d, "correlations", lambda: tr.collective_correlations(drift_free(s, d), lags()))


def _table(s, d):
    return tr.charge_msd(correlations(s, d), Z)


# One frame is the dense step, so every lag up to the longest is in the list.
LAGS_SQL = f"(SELECT unnest(range(1, least(max(frame), {int(MAX_NS)}) + 1)) AS lag FROM track)"


def corr_cte(walk: str, lags: list[int] | str, by: str = "", frame: str = "frame", stride: int = 1) -> str:
    g = f"{by}, " if by else ""
    on = " AND ".join(f"a.{c} = b.{c}" for c in (by.split(", ") if by else [])) or "true"
    sums = ", ".join(f"coalesce(sum(u{c}) FILTER (species = '{s}'), 0) AS {s}_{c}" for s in tr.SPECIES for c in "xyz")
    dot = lambda p, q: " + ".join(f"(b.{p}_{c} - a.{p}_{c}) * (b.{q}_{c} - a.{q}_{c})" for c in "xyz")
    ga = "".join(f"a.{c}, " for c in (by.split(", ") if by else []))
    cross = ", ".join(f"avg({dot(a, b)}) AS C_{a}_{b}" for a, b in [(s, s) for s in tr.SPECIES] + list(tr.CROSS))
    selfs = ", ".join(f"coalesce(s_{s}, 0) / n_origins AS self_{s}" for s in tr.SPECIES)
    dist = ", ".join(f"C_{s}_{s} - coalesce(s_{s}, 0) / n_origins AS distinct_{s}" for s in tr.SPECIES)
    own = ", ".join(f"sum(r2) FILTER (species = '{s}') AS s_{s}" for s in tr.SPECIES)
    return f"""WITH t AS (SELECT {g}{frame} AS fr, {sums} FROM {walk} GROUP BY ALL), l AS {lags if isinstance(lags, str) else f"(SELECT CAST(unnest({lags}) AS BIGINT) AS lag)"},
 x AS (SELECT {ga}lag, {cross}, count(*) AS n_origins FROM t a CROSS JOIN l JOIN t b ON b.fr = a.fr + lag AND {on} WHERE a.fr % {stride} = 0 GROUP BY ALL),
 y AS (SELECT {ga}lag, {own} FROM (SELECT {ga}lag, a.species, (b.ux - a.ux) ** 2 + (b.uy - a.uy) ** 2 + (b.uz - a.uz) ** 2 AS r2 FROM {walk} a CROSS JOIN l JOIN {walk} b ON b.{frame} = a.{frame} + lag AND a.entity_id = b.entity_id AND {on} WHERE a.{frame} % {stride} = 0) a GROUP BY ALL)
 SELECT {g}lag, * EXCLUDE ({g}lag, s_metal, s_cation, s_anion), {selfs}, {dist} FROM x JOIN y USING ({g}lag)"""


CHARGE = " + ".join([f"{Z[s] ** 2} * C_{s}_{s}" for s in tr.SPECIES] + [f"({2 * Z[a] * Z[b]}) * C_{a}_{b}" for a, b in tr.CROSS])
SELF = " + ".join(f"{Z[s] ** 2} * self_{s}" for s in tr.SPECIES)


def charge_cte(src: str) -> str:
    return f"""SELECT *, charge_msd - charge_msd_self AS charge_msd_correlation, charge_msd * CAST(0.64 AS DOUBLE) AS charge_msd_scaled, charge_msd_self * CAST(0.64 AS DOUBLE) AS charge_msd_self_scaled
 FROM (SELECT *, CAST({CHARGE} AS DOUBLE) AS charge_msd, CAST({SELF} AS DOUBLE) AS charge_msd_self FROM {src})"""


define(
    "dwalk",
    f"""SELECT w.* REPLACE (ux - (rx - bx) AS ux, uy - (ry - by0) AS uy, uz - (rz - bz) AS uz) FROM walk w JOIN (SELECT frame, rx, ry, rz, first_value(rx) OVER f AS bx, first_value(ry) OVER f AS by0, first_value(rz) OVER f AS bz FROM
 (SELECT frame, sum(m * ux) / sum(m) AS rx, sum(m * uy) / sum(m) AS ry, sum(m * uz) / sum(m) AS rz FROM (SELECT *, {MASS_SQL} AS m FROM walk) GROUP BY 1) WINDOW f AS (ORDER BY frame)) c ON c.frame = w.frame""", "walk",
)
define("corr", corr_cte("dwalk", LAGS_SQL), "dwalk", "track")
define("ctable", charge_cte("corr"), "corr")
_C = {f"C_{a}_{b}": 2 for a, b in [(s, s) for s in tr.SPECIES] + list(tr.CROSS)} | {f"{k}_{s}": 2 for k in ("self", "distinct") for s in tr.SPECIES}
_Q = {c: 1 for c in ("charge_msd", "charge_msd_self", "charge_msd_correlation", "charge_msd_scaled", "charge_msd_self_scaled")}
register("collective_correlations", correlations, "SELECT * FROM corr", ["corr"], _C)
register("charge_msd", _table, "SELECT * FROM ctable", ["ctable"], {**_C, **_Q})


def fit_sql(x: str, y: str) -> dict[str, str]:
    ok = f"count({y}) >= 2"
    pos = f"({x} > 0 AND {y} > 0)"
    lx, ly = f"CASE WHEN {pos} THEN ln(greatest({x}, 1e-300)) END", f"CASE WHEN {pos} THEN ln(greatest({y}, 1e-300)) END"
    return {
        "slope": f"CASE WHEN {ok} THEN regr_slope({y}, {x}) END", "intercept": f"CASE WHEN {ok} THEN regr_intercept({y}, {x}) END",
        "r2": f"CASE WHEN {ok} THEN regr_r2({y}, {x}) END",
        "beta": f"CASE WHEN {ok} AND count(CASE WHEN {pos} THEN 1 END) >= 2 THEN regr_slope({ly}, {lx}) END", "n_points": f"count({y})",
    }


def windows_sql(windows, always=()) -> str:
    """Windows that the track is long enough for, and those that are always fitted."""
    rows = ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), {str((a, b) in always).lower()})" for a, b in windows)
    return f"(SELECT a AS fit_start_ns, b AS fit_end_ns FROM (VALUES {rows}) AS w(a, b, fixed) WHERE fixed OR b <= (SELECT max(frame) FROM track))"


WINDOWS = tr.fit_windows(MAX_NS)


def windows(s, d):
    return tr.fit_windows(longest_ns(s, d))


_F = fit_sql("x_ps", "charge_msd")


def wfit_sql(src: str, col: str, windows, always=tr.FIT_WINDOWS_NS) -> str:
    f = fit_sql("x_ps", col) | {"is_supported": f"CAST(count({col}) >= 6 AS INTEGER)"}
    return f"SELECT fit_start_ns, fit_end_ns, {', '.join(f'{e} AS {n}' for n, e in f.items())} FROM (SELECT *, lag * CAST(1000 AS DOUBLE) AS x_ps FROM {src}) JOIN {windows_sql(windows, always)} ON lag BETWEEN fit_start_ns AND fit_end_ns GROUP BY 1, 2"


register("window_fit", lambda s, d: tr.window_fit(_table(s, d), "charge_msd", windows(s, d), DT), wfit_sql("ctable", "charge_msd", WINDOWS), ["ctable"],
         {"fit_start_ns": 6, "fit_end_ns": 6, "slope": 5, "intercept": 1, "r2": 6, "beta": 6})
COND = "(1.602176634e-19 * 1.602176634e-19 * 1.0e-20 / 1.0e-12) / (6.0 * {v} * 1.0e-30 * 1.380649e-23 * 373.0) * 10.0"
SPECS = tr.observables(Z)


def scan_sql(src: str, windows, by: str = "", volume: str = "8000.0", always=tr.FIT_WINDOWS_NS) -> str:
    g = f"{by}, " if by else ""
    sig = ", ".join(f"{fit_sql('x_ps', c)['slope']} * ({z}) * {COND.format(v=volume)} AS sigma_{n}" for n, (c, z) in SPECS.items())
    cross = " + ".join(f"sigma_{a}_{b}_cross" for a, b in tr.CROSS)
    sp = " + ".join(f"sigma_{p}_{p}" for p in tr.SPECIES)
    pt = " + ".join(f"sigma_{p}_self + sigma_{p}_distinct" for p in tr.SPECIES)
    return f"""SELECT *, fit_end_ns - fit_start_ns AS duration_ns, sigma_total * CAST(0.64 AS DOUBLE) AS sigma_total_scaled, {sp} + {cross} - sigma_total AS closure_species, {pt} + {cross} - sigma_total AS closure_parts FROM
 (SELECT {g}fit_start_ns, fit_end_ns, {_F['n_points']} AS n_points, {_F['beta']} AS beta, {_F['r2']} AS r2, {sig} FROM (SELECT *, lag * CAST(1000 AS DOUBLE) AS x_ps FROM {src}) JOIN {windows_sql(windows, always)} ON lag BETWEEN fit_start_ns AND fit_end_ns GROUP BY ALL)"""


def scan(s, d):
    return tr.window_scan(_table(s, d), windows(s, d), Z, DT, _volume(s, d), T_K)


define("wscan", scan_sql("ctable", WINDOWS), "ctable")
_W = {"fit_start_ns": 6, "fit_end_ns": 6, "duration_ns": 6, "beta": 6, "r2": 6, "closure_species": 4, "closure_parts": 4, "sigma_total_scaled": 4, **{f"sigma_{n}": 4 for n in SPECS}}
register("window_scan", scan, "SELECT * FROM wscan", ["wscan"], _W)
register(
    "conductivity", lambda s, d: tr.window_fit(_table(s, d), "charge_msd", windows(s, d), DT).select("fit_start_ns", "fit_end_ns", tr.conductivity(F.col("slope"), _volume(s, d), T_K).alias("sigma")),
    "SELECT fit_start_ns, fit_end_ns, sigma_total AS sigma FROM wscan", ["wscan"], {"fit_start_ns": 6, "fit_end_ns": 6, "sigma": 4},
)
register(
    "fit_windows", lambda s, d: _table(s, d).agg(F.max(F.col("lag") * DT / 1000.0).alias("m")).select(
        F.explode(F.filter(F.array(*[F.struct(F.lit(a).alias("fit_start_ns"), F.lit(b).alias("fit_end_ns")) for a, b in tr.fit_windows(200.0)]), lambda w: w["fit_end_ns"] <= F.col("m"))).alias("w")
    ).select("w.fit_start_ns", "w.fit_end_ns"),
    """SELECT * FROM (SELECT CAST(5 * i AS DOUBLE) AS fit_start_ns, CAST(5 * i + l AS DOUBLE) AS fit_end_ns FROM (SELECT unnest(range(1, 40)) AS i), (SELECT unnest([10, 15, 20, 30]) AS l)
 UNION SELECT a, b FROM (VALUES (5.0, 20.0), (10.0, 30.0), (20.0, 50.0), (30.0, 60.0), (40.0, 80.0), (50.0, 100.0)) AS f(a, b)) WHERE fit_end_ns <= (SELECT max(lag) FROM corr)""",
    ["corr"], ["fit_start_ns", "fit_end_ns"],
)
D_TABLE = (("metal", 0.02), ("cation", 0.11), ("anion", 0.05))


def _ne(s, d):
    counts = v.track(s, d).select("species", "entity_id").distinct().groupBy("species").agg(F.count(F.lit(1)).alias("n_ions"))
    table = s.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("species"), F.lit(x).alias("d_nm2_ns")) for n, x in D_TABLE])).alias("r")).select("r.*")
    return tr.nernst_einstein(counts, table, Z, _volume(s, d), T_K)


define(
    "ne",
    f"""SELECT species, n_ions, z AS charge, dd AS d_nm2_ns, n_ions * z * z * 1.602176634e-19 * 1.602176634e-19 * dd * 1e-9 / (8000.0 * 1e-30 * 1.380649e-23 * 373.0) * 10.0 AS sigma_ne
 FROM (SELECT species, count(DISTINCT entity_id) AS n_ions FROM track GROUP BY 1) JOIN (VALUES ('metal', CAST(0.02 AS DOUBLE), CAST(2 AS DOUBLE)), ('cation', CAST(0.11 AS DOUBLE), CAST(1 AS DOUBLE)), ('anion', CAST(0.05 AS DOUBLE), CAST(-1 AS DOUBLE))) AS t(species, dd, z) USING (species)""",
    "track",
)
_NE = {"charge": 6, "d_nm2_ns": 6, "sigma_ne": 6, "sigma_ne_scaled": 6, "fraction": 6}
register(
    "nernst_einstein", _ne,
    """SELECT *, sigma_ne * CAST(0.64 AS DOUBLE) AS sigma_ne_scaled, sigma_ne / (SELECT sum(sigma_ne) FROM ne) AS fraction FROM (SELECT * FROM ne UNION ALL SELECT 'TOTAL', CAST(sum(n_ions) AS BIGINT), NULL, NULL, sum(sigma_ne) FROM ne)""",
    ["ne"], _NE,
)


def _sigma_ne(s, d):
    return _ne(s, d).filter("species = 'TOTAL'").select("sigma_ne").scalar()


_CW = tr.cumulative_windows(MAX_NS)
register(
    "cumulative_scan", lambda s, d: tr.cumulative_scan(_table(s, d), longest_ns(s, d), DT, _volume(s, d), T_K, _sigma_ne(s, d)),
    f"""SELECT *, sigma_total * CAST(0.64 AS DOUBLE) AS sigma_total_scaled, sigma_total / (SELECT sum(sigma_ne) FROM ne) AS ratio_total, sigma_self_total / (SELECT sum(sigma_ne) FROM ne) AS ratio_self FROM
 (SELECT fit_start_ns, fit_end_ns, fit_end_ns - fit_start_ns AS duration_ns, n_points, beta, r2, slope * {COND.format(v='8000.0')} AS sigma_total, s2 * {COND.format(v='8000.0')} AS sigma_self_total
 FROM ({wfit_sql('ctable', 'charge_msd', _CW, ())}) JOIN (SELECT fit_start_ns, fit_end_ns, slope AS s2 FROM ({wfit_sql('ctable', 'charge_msd_self', _CW, ())})) USING (fit_start_ns, fit_end_ns))""",
    ["ctable", "ne"],
    {"fit_start_ns": 6, "fit_end_ns": 6, "duration_ns": 6, "beta": 6, "r2": 6, "sigma_total": 4, "sigma_total_scaled": 4, "sigma_self_total": 4, "ratio_total": 4, "ratio_self": 4},
)
OVER = "greatest(0, least({a}.fit_end_ns, {b}.fit_end_ns) - greatest({a}.fit_start_ns, {b}.fit_start_ns)) / least({a}.fit_end_ns - {a}.fit_start_ns, {b}.fit_end_ns - {b}.fit_start_ns)"
define(
    "nbr",
    f"""SELECT any_value(a) AS a, count(b.sigma_total) AS neighbour_count, avg(b.sigma_total) AS neighbour_mean, stddev_samp(b.sigma_total) AS neighbour_std, median(b.sigma_total) AS m
 FROM wscan a LEFT JOIN wscan b ON b.duration_ns / a.duration_ns BETWEEN 0.67 AND 1.5 AND {OVER.format(a='a', b='b')} >= 0.5 AND b.sigma_total > 0 GROUP BY a.fit_start_ns, a.fit_end_ns""",
    "wscan",
)
define("wn", "SELECT a.*, neighbour_count, neighbour_mean, neighbour_std, neighbour_std / nullif(abs(neighbour_mean), 0) AS neighbour_cv, abs(a.sigma_total - m) / nullif(abs(m), 0) AS difference_from_median FROM nbr", "nbr")
_N = {"neighbour_mean": 4, "neighbour_std": 4, "neighbour_cv": 5, "difference_from_median": 5}
register("window_neighbours", lambda s, d: tr.window_neighbours(scan(s, d)), "SELECT * FROM wn", ["wn"], {**_W, **_N})


def _block_scan(s, d):
    volumes = v.track(s, d).groupBy("frame").agg(F.min(F.col("box") * F.col("box") * F.col("box")).alias("volume"))
    return v.shared(s, d, "block_scan", lambda: tr.block_scan(drift_free(s, d), volumes, SCHEMES, BLOCK_LAGS, Z, DT, T_K))


for i, sch in enumerate(SCHEMES):
    n = int(sch.length_ns)
    define(
        f"bw{i}",
        f"SELECT *, '{sch.name}' AS scheme, frame // {n} AS block, frame % {n} AS block_frame FROM dwalk WHERE (frame // {n} + 1) * {n} - 1 <= (SELECT max(frame) FROM walk)"
        f" UNION ALL SELECT *, '{sch.name}', frame // {n} - 1, {n} FROM dwalk WHERE frame % {n} = 0 AND frame > 0", "dwalk",
    )
    define(f"bc{i}", corr_cte(f"bw{i}", BLOCK_LAGS[sch.name], "scheme, block", "block_frame", 1), f"bw{i}")
    define(f"bt{i}", charge_cte(f"bc{i}"), f"bc{i}")
    define(f"bs{i}", scan_sql(f"bt{i}", sch.windows, "scheme, block", always=sch.windows), f"bt{i}")
define("bscan", " UNION ALL BY NAME ".join(f"SELECT * FROM bs{i}" for i in range(len(SCHEMES))), *[f"bs{i}" for i in range(len(SCHEMES))])
register("block_scan", _block_scan, "SELECT * FROM bscan", ["bscan"], _W)
_BC = ("sigma_total", "sigma_self_total", "beta", "r2")
define(
    "bsum", "SELECT scheme, fit_start_ns, fit_end_ns, " + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, stddev_samp({c}) / sqrt(count({c})) AS {c}_sem" for c in _BC)
    + ", count(DISTINCT block) AS n_blocks FROM bscan GROUP BY 1, 2, 3", "bscan",
)
_BR = {"fit_start_ns": 6, "fit_end_ns": 6, **{f"{c}_{k}": 4 for c in _BC for k in ("mean", "std", "sem")}}
register("block_summary", lambda s, d: tr.block_summary(_block_scan(s, d)), "SELECT * FROM bsum", ["bsum"], _BR)


def _nearest(s, d):
    return tr.nearest_block_window(tr.window_neighbours(scan(s, d)), tr.block_summary(_block_scan(s, d)))


define(
    "wb",
    f"""SELECT * EXCLUDE (rk, block_count), coalesce(block_count, 0) AS block_count, block_std / nullif(abs(block_mean), 0) AS block_cv, abs(sigma_total - block_mean) / nullif(abs(block_mean), 0) AS block_difference FROM
 (SELECT a.*, b.scheme AS block_scheme, b.fit_start_ns AS block_start_ns, b.fit_end_ns AS block_end_ns, b.sigma_total_mean AS block_mean, b.sigma_total_std AS block_std, b.sigma_total_sem AS block_sem, b.n_blocks AS block_count,
 row_number() OVER (PARTITION BY a.fit_start_ns, a.fit_end_ns ORDER BY abs((a.fit_start_ns + a.fit_end_ns) / 2 - (b.fit_start_ns + b.fit_end_ns) / 2) + 0.5 * abs(a.duration_ns - (b.fit_end_ns - b.fit_start_ns)) - 5 * {OVER.format(a='a', b='b')},
 b.fit_start_ns, b.fit_end_ns, b.scheme) AS rk FROM wn a LEFT JOIN bsum b ON {OVER.format(a='a', b='b')} > 0) WHERE rk = 1""",
    "wn", "bsum",
)
_B = {"block_start_ns": 6, "block_end_ns": 6, "block_mean": 4, "block_std": 4, "block_sem": 4, "block_cv": 5, "block_difference": 5}
register("nearest_block_window", _nearest, "SELECT * FROM wb", ["wb"], {**_W, **_N, **_B})


def _flags(s, d):
    return tr.stable_flags(_nearest(s, d).withColumn("self_ratio", F.col("sigma_self_total") / _sigma_ne(s, d)))


define(
    "wflag",
    """SELECT *, passes_beta * passes_r2 * passes_neighbours * passes_blocks * passes_self_ratio * passes_positive AS is_stable FROM (SELECT *, coalesce(CAST(beta BETWEEN 0.9 AND 1.1 AS INTEGER), 0) AS passes_beta,
 coalesce(CAST(r2 >= 0.98 AS INTEGER), 0) AS passes_r2, coalesce(CAST(neighbour_count >= 3 AND neighbour_cv <= 0.25 AS INTEGER), 0) AS passes_neighbours,
 coalesce(CAST(block_count >= 3 AND block_cv <= 0.75 AND block_difference <= 0.35 AS INTEGER), 0) AS passes_blocks, coalesce(CAST(self_ratio BETWEEN 0.7 AND 1.3 AS INTEGER), 0) AS passes_self_ratio,
 coalesce(CAST(sigma_total > 0 AS INTEGER), 0) AS passes_positive FROM (SELECT *, sigma_self_total / (SELECT sum(sigma_ne) FROM ne) AS self_ratio FROM wb))""",
    "wb", "ne",
)
register("stable_flags", _flags, "SELECT * FROM wflag", ["wflag"], {**_W, **_N, **_B, "self_ratio": 4})
register(
    "stable_window", lambda s, d: tr.stable_window(_flags(s, d)),
    """SELECT CASE WHEN n_stable > 0 THEN 'stable_window_found' ELSE 'no_stable_window_found' END AS status, fit_start_ns, fit_end_ns, sigma_total, sigma_total_scaled, beta, r2, neighbour_cv, block_scheme, block_mean, n_stable FROM
 (SELECT *, CAST(sum(is_stable) OVER () AS BIGINT) AS n_stable, row_number() OVER (ORDER BY CASE WHEN is_stable = 1 THEN 0 WHEN sigma_total > 0 AND r2 IS NOT NULL THEN 1 ELSE 2 END,
 CASE WHEN is_stable = 1 THEN abs(beta - 1) + 2 * greatest(1 - r2, 0) + coalesce(neighbour_cv, 10) + coalesce(block_cv, 10) + coalesce(block_difference, 10)
 WHEN sigma_total > 0 AND r2 IS NOT NULL THEN coalesce(abs(beta - 1), 5) + 2 * greatest(1 - r2, 0) ELSE 0 END, fit_start_ns, fit_end_ns) AS rk FROM wflag) WHERE rk = 1""",
    ["wflag"], {"fit_start_ns": 6, "fit_end_ns": 6, "sigma_total": 4, "sigma_total_scaled": 4, "beta": 5, "r2": 6, "neighbour_cv": 5, "block_mean": 4},
)
