"""Queries over periodic geometry and lag-time mobility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions import lags as lg
from ionweave.functions.geometry import BOX_COLUMNS, Vector, minimum_image, minimum_image_triclinic, vector
from ionweave.operators import contacts as ct
from ionweave.operators import mobility as mo
from ionweave.plans import views as v
from ionweave.plans.boxes import boxes_sql, cell_numbers, fraction_sql
from ionweave.plans.registry import define, register

LAGS = [1, 2, 5, 10]
MASS = {"metal": 65.38, "cation": 111.17, "anion": 280.15}


def mass_column():
    return F.when(F.col("species") == "metal", MASS["metal"]).when(F.col("species") == "cation", MASS["cation"]).otherwise(MASS["anion"])


MASS_SQL = "CAST(CASE species WHEN 'metal' THEN 65.38 WHEN 'cation' THEN 111.17 ELSE 280.15 END AS DOUBLE)"


def mic_sql(d: str, box: str = "box") -> str:
    return f"(({d}) - {box} * round_even(({d}) / {box}, 0))"


def _mic(s, d):
    p = v.pairs(s, d)
    m = minimum_image(vector("ax", "ay", "az").minus(vector("cx", "cy", "cz")), Vector(*[F.col("box")] * 3))
    return p.select("frame", "center_id", "anion_id", *[c.alias(n) for c, n in zip(m, ("mx", "my", "mz"))])


register("minimum_image", _mic, f"SELECT frame, center_id, anion_id, {mic_sql('ax - cx')} AS mx, {mic_sql('ay - cy')} AS my, {mic_sql('az - cz')} AS mz FROM pairs",
         ["pairs"], ["mx", "my", "mz"])


def _tri(s, d):
    p = v.pairs(s, d)
    cell = [F.col("box"), F.col("box") * 1.1, F.col("box") * 0.9, F.lit(80.0), F.lit(95.0), F.lit(70.0)]
    m = minimum_image_triclinic(vector("ax", "ay", "az").minus(vector("cx", "cy", "cz")), *cell)
    return p.select("frame", "center_id", "anion_id", *[c.alias(n) for c, n in zip(m, ("mx", "my", "mz"))])


register(
    "minimum_image_triclinic", _tri,
    """SELECT frame, center_id, anion_id, wx * a + wy * bx + wz * cx0 AS mx, wy * by0 + wz * cy0 AS my, wz * cz0 AS mz FROM
 (SELECT *, fx - round_even(fx, 0) AS wx, fy - round_even(fy, 0) AS wy, fz - round_even(fz, 0) AS wz FROM
 (SELECT *, (dx - fy * bx - fz * cx0) / a AS fx FROM (SELECT *, (dy - fz * cy0) / by0 AS fy FROM (SELECT *, dz / cz0 AS fz FROM
 (SELECT *, sqrt(c * c - cx0 * cx0 - cy0 * cy0) AS cz0 FROM (SELECT *, b * cos(radians(70)) AS bx, b * sin(radians(70)) AS by0, c * cos(radians(95)) AS cx0,
 c * (cos(radians(80)) - cos(radians(95)) * cos(radians(70))) / sin(radians(70)) AS cy0 FROM
 (SELECT frame, center_id, anion_id, ax - cx AS dx, ay - cy AS dy, az - cz AS dz, box AS a, box * CAST(1.1 AS DOUBLE) AS b, box * CAST(0.9 AS DOUBLE) AS c FROM pairs)))))))""",
    ["pairs"], ["mx", "my", "mz"],
)


def _contacts(s, d):
    p = v.sites(s, d)
    centers = p.filter("role = 'center'").select("frame", F.col("site_id").alias("center_id"), "x", "y", "z", "box")
    return ct.contact_join(centers, p.filter("role <> 'center'"), 3.0)


register(
    "contact_join", _contacts,
    f"""SELECT * FROM (SELECT c.site_id AS center_id, s.frame, s.site_id, s.role, s.ligand_id, sqrt({mic_sql('s.x - c.x', 'c.box')} ** 2 + {mic_sql('s.y - c.y', 'c.box')} ** 2 + {mic_sql('s.z - c.z', 'c.box')} ** 2) AS distance
 FROM sites c JOIN sites s ON c.frame = s.frame AND c.role = 'center' AND s.role <> 'center') WHERE distance <= 3""",
    ["sites"], ["distance"],
)


def _slanted_contacts(s, d):
    p = v.slanted(v.sites(s, d))
    centers = p.filter("role = 'center'").select("frame", F.col("site_id").alias("center_id"), "x", "y", "z", *BOX_COLUMNS)
    return ct.contact_join_cell(centers, p.filter("role <> 'center'"), REACH)


# A cutoff over half of a height: a site may be near in several images, of which the nearest counts.
REACH = 9.0
_CELL = cell_numbers(*v.SLANTED)
_IMAGE = boxes_sql("i", "j", "k", _CELL)
register(
    "contact_join_triclinic", _slanted_contacts,
    f"""SELECT center_id, frame, site_id, role, ligand_id, min(distance) AS distance FROM (SELECT c.site_id AS center_id, s.frame, s.site_id, s.role, s.ligand_id,
 sqrt((s.x - c.x - dx + tx) ** 2 + (s.y - c.y - dy + ty) ** 2 + (s.z - c.z - dz + tz) ** 2) AS distance FROM
 (SELECT *, {", ".join(f"{b} AS d{a}" for a, b in zip("xyz", boxes_sql("floor(sx) - floor(cx)", "floor(sy) - floor(cy)", "floor(sz) - floor(cz)", _CELL)))} FROM
 (SELECT c, s, {", ".join(f"{f} AS c{a}" for a, f in zip("xyz", fraction_sql("c.x", "c.y", "c.z", _CELL)))}, {", ".join(f"{f} AS s{a}" for a, f in zip("xyz", fraction_sql("s.x", "s.y", "s.z", _CELL)))}
 FROM sites c JOIN sites s ON c.frame = s.frame AND c.role = 'center' AND s.role <> 'center'))
 CROSS JOIN (SELECT {", ".join(f"{b} AS t{a}" for a, b in zip("xyz", _IMAGE))} FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j), (SELECT unnest(range(-2, 3)) AS k)))
 WHERE distance <= {REACH} GROUP BY 1, 2, 3, 4, 5""",
    ["sites"], ["distance"],
)


def unwrapped(s, d, rule="current"):
    return v.shared(s, d, f"unwrapped_{rule}", lambda: mo.unwrap(v.track(s, d), ["entity_id"], rule=rule))


def unwrap_cte(source: str, key: str, order: str = "frame") -> str:
    """SQL running unwrapped positions."""
    step = ", ".join(
        f"coalesce({mic_sql(f'{c} - lag({c}) OVER w')}, {c}) AS s{c}" for c in "xyz"
    )
    tot = ", ".join(f"sum(s{c}) OVER (PARTITION BY {key} ORDER BY {order}) AS u{c}" for c in "xyz")
    return f"""SELECT *, {tot}, CASE WHEN NOT f0 THEN sqrt(sx * sx + sy * sy + sz * sz) END AS step FROM (SELECT *, {step}, lag({order}) OVER w IS NULL AS f0 FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY {order}))"""


define("walk", unwrap_cte("track", "entity_id"), "track")
_U = ["ux", "uy", "uz", "step"]
for rule in ("current", "mean"):
    register(f"unwrap_{rule}", lambda s, d, rule=rule: unwrapped(s, d, rule).select("entity_id", "frame", *_U),
             "SELECT entity_id, frame, ux, uy, uz, step FROM walk", ["walk"], _U)
register("max_step_audit", lambda s, d: mo.max_step_audit(unwrapped(s, d)),
         "SELECT species, max(step) AS max_step, CAST(max(step) > 25 AS INTEGER) AS warn FROM walk GROUP BY 1", ["walk"], ["max_step"])
register(
    "remove_drift",
    lambda s, d: mo.remove_drift(unwrapped(s, d), mass_column()).select("entity_id", "frame", "ux", "uy", "uz"),
    f"""SELECT entity_id, frame, ux - (rx - first_value(rx) OVER w) AS ux, uy - (ry - first_value(ry) OVER w) AS uy, uz - (rz - first_value(rz) OVER w) AS uz
 FROM walk JOIN (SELECT frame, sum(m * ux) / sum(m) AS rx, sum(m * uy) / sum(m) AS ry, sum(m * uz) / sum(m) AS rz FROM (SELECT *, {MASS_SQL} AS m FROM walk) GROUP BY 1) USING (frame) WINDOW w AS (ORDER BY frame)""",
    ["walk"], ["ux", "uy", "uz"], 5,
)
register(
    "segment_center",
    lambda s, d: mo.segment_center(v.track(s, d).withColumn("f", F.lit(0)), ["f", "entity_id"], "frame", 2).drop("f"),
    """SELECT entity_id, frame, avg(ux) OVER w AS sx, avg(uy) OVER w AS sy, avg(uz) OVER w AS sz FROM walk
 WINDOW w AS (PARTITION BY entity_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    ["walk"], ["sx", "sy", "sz"],
)


def _slanted_segments(s, d):
    rows = v.slanted(v.track(s, d).withColumn("f", F.lit(0)))
    return mo.segment_center(rows, ["f", "entity_id"], "frame", 2, BOX_COLUMNS).drop("f")


register(
    "segment_center_triclinic", _slanted_segments,
    f"""SELECT entity_id, frame, avg(ux) OVER w AS sx, avg(uy) OVER w AS sy, avg(uz) OVER w AS sz FROM
 (SELECT entity_id, frame, {", ".join(f"sum(s{a}) OVER (PARTITION BY entity_id ORDER BY frame) AS u{a}" for a in "xyz")} FROM
 (SELECT entity_id, frame, {", ".join(f"coalesce(d{a} - {b}, {a}) AS s{a}" for a, b in zip("xyz", boxes_sql("round_even(fx, 0)", "round_even(fy, 0)", "round_even(fz, 0)", _CELL)))} FROM
 (SELECT *, {", ".join(f"{f} AS f{a}" for a, f in zip("xyz", fraction_sql("dx", "dy", "dz", _CELL)))} FROM
 (SELECT entity_id, frame, x, y, z, {", ".join(f"{a} - lag({a}) OVER (PARTITION BY entity_id ORDER BY frame) AS d{a}" for a in "xyz")} FROM track))))
 WINDOW w AS (PARTITION BY entity_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    ["track"], ["sx", "sy", "sz"],
)


def _rg(s, d):
    atoms = v.sites(s, d).withColumns({"mass": F.when(F.col("role") == "center", 65.38).otherwise(15.999)})
    return mo.radius_of_gyration(atoms, "ligand_id")


define(
    "rg",
    """SELECT frame, ligand_id, sqrt(sum(m * ((x - bx) ** 2 + (y - by0) ** 2 + (z - bz) ** 2)) / sum(m)) AS rg FROM (SELECT *, sum(m * x) OVER w / sum(m) OVER w AS bx, sum(m * y) OVER w / sum(m) OVER w AS by0,
 sum(m * z) OVER w / sum(m) OVER w AS bz FROM (SELECT *, CAST(CASE role WHEN 'center' THEN 65.38 ELSE 15.999 END AS DOUBLE) AS m FROM sites) WINDOW w AS (PARTITION BY frame, ligand_id)) GROUP BY 1, 2""",
    "sites",
)
register("radius_of_gyration", _rg, "SELECT * FROM rg", ["rg"], ["rg"])
register("rg_frame_mean", lambda s, d: _rg(s, d).groupBy("frame").agg(F.avg("rg").alias("mean_rg")),
         "SELECT frame, avg(rg) AS mean_rg FROM rg GROUP BY 1", ["rg"], ["mean_rg"])
register(
    "rg_histogram", lambda s, d: mo.rg_histogram(_rg(s, d), 0.0, 12.0, 24),
    """SELECT bin, (bin + 0.5) * CAST(0.5 AS DOUBLE) AS center, coalesce(c, 0) AS count, coalesce(c, 0) / ((SELECT count(*) FROM rg WHERE rg <= 12) * CAST(0.5 AS DOUBLE)) AS density,
 (SELECT count(*) FROM rg WHERE rg < 0) AS n_below, (SELECT count(*) FROM rg WHERE rg > 12) AS n_above
 FROM (SELECT unnest(range(24)) AS bin) LEFT JOIN (SELECT least(CAST(floor(rg / CAST(0.5 AS DOUBLE)) AS BIGINT), 23) AS bin, count(*) AS c FROM rg WHERE rg <= 12 GROUP BY 1) USING (bin)""",
    ["rg"], ["center", "density"],
)
define(
    "lagr",
    """SELECT a.entity_id, a.species, a.frame, l.lag, (b.ux - a.ux) ** 2 + (b.uy - a.uy) ** 2 + (b.uz - a.uz) ** 2 AS r2
 FROM walk a CROSS JOIN (SELECT CAST(unnest([1, 2, 5, 10]) AS BIGINT) AS lag) l JOIN walk b ON b.entity_id = a.entity_id AND b.frame = a.frame + l.lag""",
    "walk",
)
define("msd", "SELECT species, lag, avg(r2) AS msd, avg(r2 * r2) AS r4, count(*) AS n, 3 * avg(r2 * r2) / (5 * avg(r2) * avg(r2)) - 1 AS alpha2 FROM lagr GROUP BY 1, 2", "lagr")


def msd(s, d):
    return mo.msd_ngp(unwrapped(s, d), LAGS)


_MSD = {"msd": 5, "r4": 2, "alpha2": 6}
register("msd_ngp", msd, "SELECT * FROM msd", ["msd"], _MSD)
define("lx", "SELECT *, ln(lag) AS x, ln(msd) AS y, count(*) OVER (PARTITION BY species) AS k FROM msd", "msd")
register(
    "msd_exponent", lambda s, d: mo.msd_exponent(msd(s, d)),
    """SELECT species, lag, msd, r4, n, alpha2, CASE WHEN k < 3 THEN NULL WHEN x0 IS NULL THEN (y1 - y) / (x1 - x) WHEN x1 IS NULL THEN (y - y0) / (x - x0)
 ELSE ((x - x0) ** 2 * y1 + ((x1 - x) ** 2 - (x - x0) ** 2) * y - (x1 - x) ** 2 * y0) / ((x - x0) * (x1 - x) * (x1 - x0)) END AS beta
 FROM (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM lx WINDOW w AS (PARTITION BY species ORDER BY lag))""",
    ["lx"], {**_MSD, "beta": 6},
)
register("ngp_peak", lambda s, d: mo.ngp_peak(msd(s, d), v.DT_PS),
         "SELECT species, max(alpha2) AS alpha2_max, arg_max(lag, alpha2) * CAST(30 AS DOUBLE) AS time_ps, arg_max(msd, alpha2) AS msd FROM msd GROUP BY 1",
         ["msd"], {"alpha2_max": 6, "time_ps": 6, "msd": 5})
register(
    "self_van_hove", lambda s, d: mo.self_van_hove(unwrapped(s, d), LAGS),
    """SELECT species, lag, (bin + 0.5) * CAST(0.1 AS DOUBLE) AS r, coalesce(c, 0) / (n_in * CAST(0.1 AS DOUBLE)) AS density, n_samples, n_samples - n_in AS n_above FROM
 (SELECT species, lag, count(*) AS n_samples, count(*) FILTER (round_even(sqrt(r2) / CAST(0.1 AS DOUBLE) * 1e6, 0) / 1e6 <= 300) AS n_in FROM lagr GROUP BY 1, 2) CROSS JOIN (SELECT unnest(range(300)) AS bin)
 LEFT JOIN (SELECT species, lag, least(CAST(floor(round_even(sqrt(r2) / CAST(0.1 AS DOUBLE) * 1e6, 0) / 1e6) AS BIGINT), 299) AS bin, count(*) AS c FROM lagr WHERE round_even(sqrt(r2) / CAST(0.1 AS DOUBLE) * 1e6, 0) / 1e6 <= 300 GROUP BY 1, 2, 3) USING (species, lag, bin)""",
    ["lagr"], ["r", "density"],
)


def center_walk(s, d):
    return v.shared(s, d, "center_walk", lambda: mo.unwrap(v.center_track(s, d), ["center_id"]))


define(
    "ctrack",
    """SELECT s.frame, s.center_id, s.state, c.is_multi_center AS is_clustered, CAST((s.center_id * 7919 + s.frame * 104729) % 2000 AS DOUBLE) / 100 AS x, CAST((s.center_id * 6101 + s.frame * 15485863) % 2000 AS DOUBLE) / 100 AS y,
 CAST((s.center_id * 3571 + s.frame * 49979687) % 2000 AS DOUBLE) / 100 AS z, CAST(20 AS DOUBLE) AS box
 FROM states s JOIN nodes n ON n.kind = 'center' AND n.frame = s.frame AND n.node_id = s.center_id JOIN clusters c ON c.frame = n.frame AND c.root = n.root""",
    "states", "nodes", "clusters",
)
define("cwalk", unwrap_cte("ctrack", "center_id"), "ctrack")
_CATS = {**{f"state_{x}": f"state = '{x}'" for x in ("P", "PT", "T", "F")}, "isolated": "is_clustered = 0", "clustered": "is_clustered = 1"}
define("cflag", "SELECT *, " + ", ".join(f"CAST({t} AS INTEGER) AS c_{n}, sum(CAST({t} AS INTEGER)) OVER w AS p_{n}" for n, t in _CATS.items()) + " FROM cwalk WINDOW w AS (PARTITION BY center_id ORDER BY frame)", "cwalk")
define(
    "clag",
    "SELECT l.lag, (b.ux - a.ux) ** 2 + (b.uy - a.uy) ** 2 + (b.uz - a.uz) ** 2 AS r2, "
    + ", ".join(f"a.c_{n} AS i_{n}, CAST(a.c_{n} = 1 AND b.p_{n} - a.p_{n} = l.lag AS INTEGER) AS k_{n}" for n in _CATS)
    + " FROM cflag a CROSS JOIN (SELECT CAST(unnest([1, 2, 5, 10]) AS BIGINT) AS lag) l JOIN cflag b ON b.center_id = a.center_id AND b.frame = a.frame + l.lag",
    "cflag",
)
register(
    "conditioned_msd", lambda s, d: mo.conditioned_msd(center_walk(s, d), LAGS, min_samples=20),
    "SELECT category, rule, lag, msd, median_r2, n, CAST(n >= 20 AS INTEGER) AS is_supported FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS category, '{r}' AS rule, lag, avg(r2) FILTER ({k}_{n} = 1) AS msd, median(r2) FILTER ({k}_{n} = 1) AS median_r2, count(*) FILTER ({k}_{n} = 1) AS n FROM clag GROUP BY lag"
        for n in _CATS for r, k in (("initial", "i"), ("persistent", "k"))
    ) + ")",
    ["clag"], {"msd": 4, "median_r2": 4},
)


GRID_NS, GRID_DT = 60.0, 1000.0


def lag_grid(s, d):
    """(rule, lag): every lag rule for the frames that the tracks hold."""
    n = v.track(s, d).agg((F.max("frame") + 1).alias("n")).select("n").first()[0]
    rules = {
        "early_and_log": lg.early_and_log(n, GRID_DT, GRID_NS, 20, 10), "linear_then_log": lg.linear_then_log(n, GRID_DT, GRID_NS, 15, 8),
        "geometric": [g for g in lg.geometric(GRID_DT, GRID_NS, 12) if g < n], "stepped": lg.stepped(n, GRID_DT, GRID_NS, 5, 7.0, 35.0, 10.0),
        "requested": lg.requested([1000.0, 4400.0, 9000.0, 1e9], GRID_DT, n),
    }
    return s.createDataFrame([(r, g) for r, lags in rules.items() for g in lags], "rule string, lag bigint")


register(
    "lag_grid", lag_grid,
    """SELECT * FROM (WITH t AS (SELECT max(frame) AS most, least(max(frame), 60) AS top FROM track), i AS (SELECT unnest(range(60)) AS i),
 g AS (SELECT 'early_and_log' AS rule, i AS lag FROM i WHERE i <= 10 UNION SELECT 'early_and_log', CAST(round(pow(top, i / CAST(19 AS DOUBLE))) AS BIGINT) FROM i, t WHERE i < 20
 UNION SELECT 'linear_then_log', i FROM i WHERE i <= 8 UNION SELECT 'linear_then_log', CAST(round(9 * pow(top / CAST(9 AS DOUBLE), i / CAST(14 AS DOUBLE))) AS BIGINT) FROM i, t WHERE i < 15 AND top > 8
 UNION SELECT 'geometric', CAST(round(pow(60, i / CAST(11 AS DOUBLE))) AS BIGINT) FROM i WHERE i < 12
 UNION SELECT 'stepped', i FROM i WHERE i <= 5 UNION SELECT 'stepped', 7 * i FROM i, t WHERE 7 * i <= least(35, top) UNION SELECT 'stepped', least(35, top) + 10 * i FROM i, t WHERE i > 0 UNION SELECT 'stepped', top FROM t
 UNION SELECT 'requested', unnest([1, 4, 9]))
 SELECT rule, lag FROM g, t WHERE lag >= 1 AND lag <= CASE WHEN rule IN ('geometric', 'requested') THEN most ELSE top END)""",
    ["track"],
)
