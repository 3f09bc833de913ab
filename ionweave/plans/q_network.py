"""Queries over bridges, aggregates and their lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.functions.geometry import BOX_COLUMNS
from ionweave.operators import aggregates as ag
from ionweave.plans import views as v
from ionweave.plans.boxes import boxes_sql, cell_numbers, fraction_sql
from ionweave.plans.q_comotion import LAGS, MA, MC, dot_sql, moves_sql, scoped_sql, walk_sql
from ionweave.plans.q_dynamics import bounds
from ionweave.plans.registry import define, register

Z = 2


def _edges(s, d):
    return v.gain_edges(s, d)


def _nodes(s, d):
    return v.shared(s, d, "nodes", lambda: ag.aggregate_nodes(_edges(s, d), v.labels(s, d), MC, MA))


def geometry(s, d):
    return v.shared(s, d, "geometry", lambda: ag.component_geometry(_edges(s, d), v.labels(s, d), _nodes(s, d), Z))


# Placement in SQL: walk from every root, however many boxes away.
def _geometry_sql(end: str, box: tuple[float, ...], columns: str) -> None:
    cell = cell_numbers(*box)
    steps = fraction_sql("ax - cx", "ay - cy", "az - cz", cell)
    define(
        f"gedge{end}",
        "SELECT frame, center_id * 2 AS a, anion_id * 2 + 1 AS b, "
        + ", ".join(f"-CAST(round_even({f}, 0) AS BIGINT) AS g{c}" for c, f in zip("xyz", steps)) + " FROM pairs", "pairs",
    )
    define(f"gends{end}", f"SELECT frame, a, b, gx, gy, gz FROM gedge{end} UNION ALL SELECT frame, b AS a, a AS b, -gx, -gy, -gz FROM gedge{end}", f"gedge{end}")
    # A node is placed once, when it is first met.
    define(
        f"placed{end}",
        f"""SELECT frame, root * 2, root, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT frame, root FROM bound_nodes)
 UNION SELECT frame, b, any_value(root), min(o)[1], min(o)[2], min(o)[3] FROM (SELECT e.frame, e.b, p.root, [p.ox + e.gx, p.oy + e.gy, p.oz + e.gz] AS o FROM placed{end} p JOIN gends{end} e ON e.frame = p.frame AND e.a = p.node
 LEFT JOIN recurring.placed{end} q ON q.frame = e.frame AND q.node = e.b WHERE q.node IS NULL) GROUP BY frame, b""",
        "bound_nodes", f"gends{end}", head="(frame, node, root, ox, oy, oz) USING KEY (frame, node)",
    )
    # What the steps between placed nodes leave over are the windings that all closed ways are made of.
    define(
        f"turns{end}",
        f"""SELECT p.frame, p.root, sum(wx * wx) AS xx, sum(wy * wy) AS yy, sum(wz * wz) AS zz, sum(wx * wy) AS xy, sum(wx * wz) AS xz, sum(wy * wz) AS yz FROM
 (SELECT DISTINCT a.frame, a.root, a.ox + e.gx - b.ox AS wx, a.oy + e.gy - b.oy AS wy, a.oz + e.gz - b.oz AS wz FROM gedge{end} e JOIN placed{end} a ON a.frame = e.frame AND a.node = e.a JOIN placed{end} b ON b.frame = e.frame AND b.node = e.b) p GROUP BY 1, 2""",
        f"placed{end}", f"gedge{end}",
    )
    # A percolating component stands at its nearest images to the smallest center.
    shift = boxes_sql("ox", "oy", "oz", cell)
    turn = boxes_sql(*[f"floor(f{c} + CAST({0.5 + ag.HALF!r} AS DOUBLE))" for c in "xyz"], cell)
    far = fraction_sql("n.x - r.x", "n.y - r.y", "n.z - r.z", cell)
    define(
        f"nodeat{end}",
        f"""SELECT n.*, p.x, p.y, p.z FROM placed{end} n JOIN (SELECT DISTINCT frame, center_id * 2 AS node, cx AS x, cy AS y, cz AS z FROM pairs UNION SELECT DISTINCT frame, anion_id * 2 + 1, ax, ay, az FROM pairs) p ON p.frame = n.frame AND p.node = n.node""",
        f"placed{end}", "pairs",
    )
    define(
        f"nodepos{end}",
        f"""SELECT DISTINCT frame, root, CASE WHEN node % 2 = 0 THEN 'center' ELSE 'anion' END AS kind, node // 2 AS node_id, CAST(CASE WHEN node % 2 = 0 THEN {MC} ELSE {MA} END AS DOUBLE) AS mass,
 {", ".join(f"CASE WHEN whole THEN {c} + {t} ELSE {c} - {u} END AS {c}" for c, t, u in zip("xyz", shift, turn))} FROM
 (SELECT n.*, t.xx + t.yy + t.zz = 0 AS whole, {", ".join(f"{f} AS f{c}" for c, f in zip("xyz", far))} FROM nodeat{end} n JOIN nodeat{end} r ON r.frame = n.frame AND r.root = n.root AND r.node = r.root * 2 JOIN turns{end} t ON t.frame = n.frame AND t.root = n.root)""",
        f"nodeat{end}", f"turns{end}",
    )
    define(
        f"geo{end}",
        f"""SELECT g.frame, g.root, n_centers, n_anions, n_centers + n_anions AS n_nodes, {Z} * n_centers - n_anions AS charge, comx AS com_x, comy AS com_y, comz AS com_z, rg, {columns}, CAST(NOT whole AS INTEGER) AS is_percolating,
 CASE WHEN xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) > 0 THEN 3 WHEN xx * yy - xy * xy + xx * zz - xz * xz + yy * zz - yz * yz > 0 THEN 2 WHEN xx + yy + zz > 0 THEN 1 ELSE 0 END AS winding_rank,
 CASE WHEN whole THEN 'none' ELSE concat(CASE WHEN xx > 0 THEN 'x' ELSE '' END, CASE WHEN yy > 0 THEN 'y' ELSE '' END, CASE WHEN zz > 0 THEN 'z' ELSE '' END) END AS winding_axes, CAST(0 AS DOUBLE) AS closure_residual, keytext FROM
 (SELECT frame, root, count(DISTINCT node_id) FILTER (kind = 'center') AS n_centers, count(DISTINCT node_id) FILTER (kind = 'anion') AS n_anions, any_value(cmx) AS comx, any_value(cmy) AS comy, any_value(cmz) AS comz,
 sqrt(sum(mass * ((x - cmx) ** 2 + (y - cmy) ** 2 + (z - cmz) ** 2)) / sum(mass)) AS rg FROM (SELECT *, sum(mass * x) OVER w / sum(mass) OVER w AS cmx, sum(mass * y) OVER w / sum(mass) OVER w AS cmy, sum(mass * z) OVER w / sum(mass) OVER w AS cmz
 FROM nodepos{end} WINDOW w AS (PARTITION BY frame, root)) GROUP BY 1, 2) g JOIN (SELECT *, xx + yy + zz = 0 AS whole FROM turns{end}) t ON t.frame = g.frame AND t.root = g.root
 JOIN (SELECT frame, root, concat('M:', string_agg(CAST(node // 2 AS VARCHAR), ',' ORDER BY node // 2) FILTER (node % 2 = 0), '|T:', string_agg(CAST(node // 2 AS VARCHAR), ',' ORDER BY node // 2) FILTER (node % 2 = 1)) AS keytext FROM bound_nodes GROUP BY 1, 2) k
 ON k.frame = g.frame AND k.root = g.root""",
        f"nodepos{end}", f"turns{end}", "bound_nodes",
    )


_geometry_sql("", (20.0, 20.0, 20.0), "CAST(20 AS DOUBLE) AS box")
_geometry_sql("_slanted", v.SLANTED, ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in zip(BOX_COLUMNS, v.SLANTED)))
_GEO = ["com_x", "com_y", "com_z", "rg", "closure_residual"]
register("component_geometry", lambda s, d: geometry(s, d).drop("shape_a", "shape_b"), "SELECT * EXCLUDE (keytext) FROM geo", ["geo"], _GEO)


def _slanted_geometry(s, d):
    edges, labels = v.slanted_edges(s, d), v.slanted_labels(s, d)
    nodes = ag.aggregate_nodes(edges, labels, MC, MA, BOX_COLUMNS)
    return ag.component_geometry(edges, labels, nodes, Z, BOX_COLUMNS).drop("shape_a", "shape_b")


register("component_geometry_triclinic", _slanted_geometry, "SELECT * EXCLUDE (keytext) FROM geo_slanted", ["geo_slanted"], _GEO)
define(
    "network",
    """SELECT frame, n_pairs, ncc AS n_coordinated_centers, nca AS n_coordinated_anions, nba AS n_bridging_anions, nbe AS n_bridge_edges, n_aggregates, mean_size, largest_size, largest_centers, largest_anions, multi / ncc AS frac_centers_multi,
 n_neutral, n_cationic, n_anionic, n_percolating, largest_percolating, perc / ncc AS frac_centers_percolating, max_winding_rank FROM
 (SELECT frame, CAST(sum(k) AS BIGINT) AS n_pairs, count(*) AS nca, count(*) FILTER (k >= 2) AS nba, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS nbe FROM (SELECT frame, anion_id, count(*) AS k FROM edges GROUP BY 1, 2) GROUP BY 1)
 JOIN (SELECT frame, CAST(sum(n_centers) AS BIGINT) AS ncc, count(*) AS n_aggregates, avg(n_nodes) AS mean_size, max(n_nodes) FILTER (rk = 1) AS largest_size, max(n_centers) FILTER (rk = 1) AS largest_centers, max(n_anions) FILTER (rk = 1) AS largest_anions,
 sum(CASE WHEN n_centers >= 2 THEN n_centers ELSE 0 END) AS multi, count(*) FILTER (charge = 0) AS n_neutral, count(*) FILTER (charge > 0) AS n_cationic, count(*) FILTER (charge < 0) AS n_anionic, count(*) FILTER (is_percolating = 1) AS n_percolating,
 coalesce(max(n_nodes) FILTER (is_percolating = 1), 0) AS largest_percolating, coalesce(sum(n_centers) FILTER (is_percolating = 1), 0) AS perc, max(winding_rank) AS max_winding_rank
 FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n_nodes DESC, keytext) AS rk FROM geo) GROUP BY 1) USING (frame)""",
    "edges", "geo",
)


def _network(s, d):
    return ag.frame_network(v.edges(s, d), geometry(s, d))


_NW = ["mean_size", "frac_centers_multi", "frac_centers_percolating"]
register("frame_network", _network, "SELECT * FROM network", ["network"], _NW)


def _full(s, d):
    n = v.edges(s, d).groupBy("frame").agg(F.count(F.lit(1)).alias("n_pairs"))
    return ag.frame_network_full(v.frames(s, d), _network(s, d), n)


register("frame_network_full", _full, "SELECT frame, coalesce(COLUMNS(* EXCLUDE (frame)), 0), 1 AS pairs_agree FROM frames LEFT JOIN network USING (frame)", ["frames", "network"], _NW)
register(
    "aggregate_size_distribution", lambda s, d: ag.aggregate_size_distribution(geometry(s, d)),
    "SELECT n_nodes, n_centers, n_anions, charge, is_percolating, count(*) AS count, count(*) / sum(count(*)) OVER () AS fraction FROM geo GROUP BY ALL", ["geo"], ["fraction"],
)

# --- bridges ---
define(
    "bridges",
    """SELECT a.frame, a.anion_id, a.center_id AS center_a, b.center_id AS center_b, concat('T', a.anion_id, '_M', a.center_id, '_M', b.center_id) AS bridge_id
 FROM edges a JOIN edges b ON a.frame = b.frame AND a.anion_id = b.anion_id AND a.center_id < b.center_id""", "edges",
)
register("bridge_pairs", lambda s, d: ag.bridge_pairs(v.edges(s, d)), "SELECT * FROM bridges", ["bridges"])
define(
    "brow",
    """SELECT *, concat(bridge_id, '_E', lpad(CAST(run AS VARCHAR), 5, '0')) AS instance_id FROM (SELECT *, CAST(sum(brk) OVER (PARTITION BY bridge_id ORDER BY frame) AS BIGINT) AS run FROM
 (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY bridge_id ORDER BY frame) = 1 THEN 0 ELSE 1 END AS brk FROM bridges))""", "bridges",
)
OCC = """CAST(n_frames * 30 AS DOUBLE) AS occupancy_ps, CAST(start_frame = f0 AS INTEGER) AS left_censored, CAST(end_frame = f1 AS INTEGER) AS right_censored, CAST(start_frame <> f0 AND end_frame <> f1 AS INTEGER) AS completed,
 CASE WHEN n_frames * 30 <= 50 THEN 'transient_10_50_ps' WHEN n_frames * 30 <= 500 THEN 'short_50_500_ps' WHEN n_frames * 30 <= 5000 THEN 'intermediate_0.5_5_ns' ELSE 'persistent_gt_5_ns' END AS persistence_class"""
define(
    "bevents",
    f"SELECT * EXCLUDE (f0, f1, nf), {OCC} FROM (SELECT instance_id, bridge_id, anion_id, center_a, center_b, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_frames FROM brow GROUP BY 1, 2, 3, 4, 5), bounds", "brow", "bounds",
)


def _bridge_rows(s, d):
    return ag.bridge_rows(ag.bridge_pairs(v.edges(s, d)))


def _bridge_events(s, d):
    return ag.bridge_events(_bridge_rows(s, d), *bounds(s, d), v.DT_PS)


register("bridge_events", _bridge_events, "SELECT * FROM bevents", ["bevents"], ["occupancy_ps"])


def _bridge_lags(s, d):
    p = v.pairs(s, d)
    spot = lambda k, o: p.select("frame", "anion_id", F.col("center_id").alias(k), *[F.col(f"c{a}").alias(f"{o}{a}") for a in "xyz"])
    t = p.groupBy("frame", "anion_id").agg(*[F.min(f"a{a}").alias(f"t{a}") for a in "xyz"], F.min("box").alias("box"))
    rows = (
        _bridge_rows(s, d).join(spot("center_a", "m1"), ["frame", "anion_id", "center_a"])
        .join(spot("center_b", "m2"), ["frame", "anion_id", "center_b"]).join(t, ["frame", "anion_id"])
    )
    return ag.bridge_lag_sums(rows, LAGS, MC, MA)


define(
    "bpos",
    """SELECT b.frame, b.instance_id, p.cx AS m1x, p.cy AS m1y, p.cz AS m1z, q.cx AS m2x, q.cy AS m2y, q.cz AS m2z, p.ax AS tx, p.ay AS ty, p.az AS tz, p.box FROM brow b
 JOIN pairs p ON p.frame = b.frame AND p.anion_id = b.anion_id AND p.center_id = b.center_a JOIN pairs q ON q.frame = b.frame AND q.anion_id = b.anion_id AND q.center_id = b.center_b""", "brow", "pairs",
)
define("bwalk", walk_sql("bpos", "instance_id", "frame", {"u1": ("m1x", "m1y", "m1z"), "u2": ("m2x", "m2y", "m2z"), "ut": ("tx", "ty", "tz")}), "bpos")
define("bmove", moves_sql("bwalk", "instance_id", "frame", ("u1", "u2", "ut"), LAGS), "bwalk")
_A, _B = dot_sql("du1", "du1"), dot_sql("du2", "du2")
_S = lambda f: "sum(" + " + ".join(f.format(a=a) for a in "xyz") + ")"
define(
    "blag",
    f"""SELECT instance_id, lag, count(*) AS n_origins, sum({_A}) AS sum_a2, sum({_B}) AS sum_b2, sum({dot_sql('dut', 'dut')}) AS sum_t2, {_S('(du1{a} - du2{a}) ** 2')} AS sum_rel2, {_S('(0.5 * (du1{a} + du2{a})) ** 2')} AS sum_mid2,
 {_S(f'(({MC} * (du1{{a}} + du2{{a}}) + {MA} * dut{{a}}) / {2 * MC + MA}) ** 2')} AS sum_com2, {_S('(dut{a} - 0.5 * (du1{a} + du2{a})) ** 2')} AS sum_tmid2, sum({dot_sql('du1', 'du2')}) AS sum_ab, sum({dot_sql('du1', 'dut')}) AS sum_at, sum({dot_sql('du2', 'dut')}) AS sum_bt,
 coalesce(sum(CASE WHEN sqrt({_A}) * sqrt({_B}) > 1e-20 THEN {dot_sql('du1', 'du2')} / (sqrt({_A}) * sqrt({_B})) END), 0) AS sum_cos, count(CASE WHEN sqrt({_A}) * sqrt({_B}) > 1e-20 THEN 1 END) AS n_cos FROM bmove GROUP BY 1, 2""", "bmove",
)
register("bridge_lag_sums", _bridge_lags, "SELECT * FROM blag", ["blag"], {c: 5 for c in ag.BRIDGE_SUMS if c != "n_cos"})
define("btab", "SELECT l.*, completed, persistence_class FROM blag l JOIN bevents USING (instance_id)", "blag", "bevents")
_BM = ["center_a_msd", "center_b_msd", "anion_msd", "relative_msd", "midpoint_msd", "com_msd", "anion_midpoint_msd", "vector_correlation", "alignment", "relative_ratio", "mean_cosine", "anion_alignment"]
define(
    "bcurve",
    f"""SELECT scope, group_type, group_label, lag, n_events, CAST(n AS BIGINT) AS n_origins, a / n AS center_a_msd, b / n AS center_b_msd, t / n AS anion_msd, rel / n AS relative_msd, mid / n AS midpoint_msd, com / n AS com_msd, tm / n AS anion_midpoint_msd,
 (ab / n) / nullif(sqrt(a / n * b / n), 0) AS vector_correlation, 2 * ab / nullif(a + b, 0) AS alignment, rel / nullif(a + b, 0) AS relative_ratio, cs / nullif(nc, 0) AS mean_cosine, (2 * at_ / (a + t) + 2 * bt / (b + t)) / 2 AS anion_alignment,
 CAST(n_events >= 5 AND n >= 10 AS INTEGER) AS is_supported FROM (SELECT scope, group_type, group_label, lag, count(*) AS n_events, sum(n_origins) AS n, sum(sum_a2) AS a, sum(sum_b2) AS b, sum(sum_t2) AS t, sum(sum_rel2) AS rel, sum(sum_mid2) AS mid, sum(sum_com2) AS com,
 sum(sum_tmid2) AS tm, sum(sum_ab) AS ab, sum(sum_at) AS at_, sum(sum_bt) AS bt, sum(sum_cos) AS cs, sum(n_cos) AS nc FROM {scoped_sql('btab', {'all': None, 'persistence': 'persistence_class'})} GROUP BY 1, 2, 3, 4)""", "btab",
)
register(
    "bridge_curves",
    lambda s, d: ag.bridge_curves(_bridge_lags(s, d).join(_bridge_events(s, d).select("instance_id", "completed", "persistence_class"), "instance_id"), 5, 10),
    "SELECT * FROM bcurve",
    ["bcurve"], _BM, 5,
)
register(
    "bridge_counts", lambda s, d: ag.bridge_counts(v.edges(s, d)),
    "SELECT frame, anion_id, count(*) AS n_centers, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_bridges FROM edges GROUP BY 1, 2 HAVING count(*) > 1", ["edges"],
)
register(
    "bridge_moment_curves",
    lambda s, d: ag.bridge_moment_curves(ag.bridge_moments(v.pairs(s, d), LAGS, MC, MA, *bounds(s, d)), 5, 10),
    "SELECT * EXCLUDE (group_type, group_label) FROM bcurve WHERE group_type = 'all'", ["bcurve"], _BM, 5,
)

# --- aggregate events ---
define(
    "arow",
    """SELECT *, concat(keytext, '_E', run) AS inst FROM (SELECT *, CAST(sum(brk) OVER (PARTITION BY keytext ORDER BY frame) AS BIGINT) AS run FROM
 (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY keytext ORDER BY frame) = 1 THEN 0 ELSE 1 END AS brk FROM geo))""", "geo",
)
define(
    "aevents",
    f"""SELECT * EXCLUDE (f0, f1, nf), {OCC}, CASE WHEN n_nodes = 2 THEN 'pair_cluster' WHEN n_nodes <= 4 THEN 'small_3_4' WHEN n_nodes <= 8 THEN 'medium_5_8' WHEN n_nodes <= 16 THEN 'large_9_16' ELSE 'network_gt_16' END AS size_class,
 CASE n_centers WHEN 1 THEN 'one_metal' WHEN 2 THEN 'two_metals' ELSE 'three_plus_metals' END AS count_class FROM
 (SELECT inst, root, n_centers, n_anions, n_nodes, charge, run AS event_number, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_frames, max(is_percolating) AS is_percolating, max(winding_rank) AS max_winding_rank, avg(rg) AS mean_rg FROM arow GROUP BY 1, 2, 3, 4, 5, 6, 7), bounds""",
    "arow", "bounds",
)


def _agg_rows(s, d):
    return v.shared(s, d, "agg_rows", lambda: ag.aggregate_rows(geometry(s, d)))


def _agg_events(s, d):
    return v.shared(s, d, "agg_events", lambda: ag.aggregate_events(_agg_rows(s, d), *bounds(s, d), v.DT_PS))


register("aggregate_events", lambda s, d: _agg_events(s, d).drop("instance_id"), "SELECT * EXCLUDE (inst) FROM aevents", ["aevents"], ["mean_rg", "occupancy_ps"])


def _agg_lags(s, d):
    ev = _agg_events(s, d)
    return ag.aggregate_lag_sums(_agg_rows(s, d), ev, _nodes(s, d), LAGS).join(
        ev.select("instance_id", "root", "start_frame", "completed", "persistence_class", "size_class", "count_class"), "instance_id"
    )


define("akeep", "SELECT * FROM arow WHERE inst IN (SELECT inst FROM aevents WHERE is_percolating = 0)", "arow", "aevents")
define("awalk", walk_sql("akeep", "inst", "frame", {"u": ("com_x", "com_y", "com_z")}), "akeep")
define("arel", "SELECT k.inst, n.frame, concat(k.inst, n.kind, n.node_id) AS nk, n.mass, n.x - k.com_x AS rx, n.y - k.com_y AS ry, n.z - k.com_z AS rz FROM nodepos n JOIN akeep k ON n.frame = k.frame AND n.root = k.root", "nodepos", "akeep")
define(
    "alag",
    f"""SELECT inst, lag, n_origins, sum_com2, sum_rg2, coalesce(si, 0) AS sum_internal, CASE WHEN si IS NOT NULL THEN n_origins ELSE 0 END AS n_internal FROM
 (SELECT a.inst, lag, count(*) AS n_origins, sum((b.ux - a.ux) ** 2 + (b.uy - a.uy) ** 2 + (b.uz - a.uz) ** 2) AS sum_com2, sum((b.rg - a.rg) ** 2) AS sum_rg2 FROM awalk a CROSS JOIN (SELECT CAST(unnest({LAGS}) AS BIGINT) AS lag) JOIN awalk b ON b.inst = a.inst AND b.frame = a.frame + lag GROUP BY 1, 2)
 LEFT JOIN (SELECT inst, lag, sum(q) AS si FROM (SELECT a.inst, a.frame, lag, sum(a.mass * ((b.rx - a.rx) ** 2 + (b.ry - a.ry) ** 2 + (b.rz - a.rz) ** 2)) / sum(a.mass) AS q FROM arel a CROSS JOIN (SELECT CAST(unnest({LAGS}) AS BIGINT) AS lag) JOIN arel b ON b.nk = a.nk AND b.frame = a.frame + lag GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (inst, lag)""",
    "awalk", "arel",
)
define("atab", "SELECT l.*, root, start_frame, completed, persistence_class, size_class, count_class FROM alag l JOIN aevents USING (inst)", "alag", "aevents")
_AL = {"sum_com2": 5, "sum_rg2": 5, "sum_internal": 5}
register("aggregate_lag_sums", lambda s, d: _agg_lags(s, d).drop("instance_id"), "SELECT * EXCLUDE (inst) FROM atab", ["atab"], _AL)
register(
    "aggregate_curves", lambda s, d: ag.aggregate_curves(_agg_lags(s, d), 5, 10),
    f"""SELECT scope, group_type, group_label, lag, n_events, CAST(n AS BIGINT) AS n_origins, c / n AS com_msd, r / n AS rg_change_msd, i / nullif(ni, 0) AS internal_msd, (c / n) / nullif(c / n + i / nullif(ni, 0), 0) AS translation_fraction, CAST(n_events >= 5 AND n >= 10 AS INTEGER) AS is_supported FROM
 (SELECT scope, group_type, group_label, lag, count(*) AS n_events, sum(n_origins) AS n, sum(sum_com2) AS c, sum(sum_rg2) AS r, sum(sum_internal) AS i, sum(n_internal) AS ni FROM {scoped_sql('atab', {'all': None, 'persistence': 'persistence_class', 'size': 'size_class', 'centers': 'count_class'})} GROUP BY 1, 2, 3, 4)""",
    ["atab"], ["com_msd", "rg_change_msd", "internal_msd", "translation_fraction"], 5,
)

# --- lineage ---


def _bound(s, d):
    return v.components(s, d, False)


def _links(s, d):
    return v.shared(s, d, "links", lambda: ag.lineage_links(_bound(s, d)))


define(
    "cand",
    """SELECT c.frame, c.root AS current, p.root AS previous, count(*) / (any_value(c.n) + any_value(p.n) - count(*)) AS score, any_value(p.rk) AS pi, any_value(c.rk) AS ci FROM
 (SELECT b.frame, node, b.root, n, rk FROM bound_nodes b JOIN comp USING (frame, root)) c JOIN (SELECT b.frame, node, b.root, n, rk FROM bound_nodes b JOIN comp USING (frame, root)) p ON p.frame = c.frame - 1 AND p.node = c.node
 GROUP BY 1, 2, 3 HAVING count(*) / (any_value(c.n) + any_value(p.n) - count(*)) >= 0.5""", "bound_nodes", "comp",
)
define("comp", "SELECT frame, root, n_nodes AS n, row_number() OVER (PARTITION BY frame ORDER BY n_nodes DESC, keytext) AS rk FROM geo", "geo")
define(
    "links",
    """SELECT frame, current, previous, score, CAST(np > 1 AS INTEGER) AS is_merge, CAST(nc > 1 AS INTEGER) AS is_split FROM (SELECT *, count(*) OVER (PARTITION BY frame, current) AS np, count(*) OVER (PARTITION BY frame, previous) AS nc,
 row_number() OVER (PARTITION BY frame, current ORDER BY score DESC, pi DESC, ci DESC) AS r1, row_number() OVER (PARTITION BY frame, previous ORDER BY score DESC, pi DESC, ci DESC) AS r2 FROM cand) WHERE r1 = 1 AND r2 = 1""", "cand",
)
register("lineage_links", _links, "SELECT * FROM links", ["links"], ["score"])
define(
    "lroot",
    """SELECT c.frame, c.root, c.frame AS first_frame, c.root AS first_root FROM comp c WHERE (c.frame, c.root) NOT IN (SELECT frame, current FROM links)
 UNION ALL SELECT l.frame, l.current, r.first_frame, r.first_root FROM lroot r JOIN links l ON l.frame = r.frame + 1 AND l.previous = r.root""", "comp", "links",
)
register(
    "lineages", lambda s, d: ag.lineages(_bound(s, d), _links(s, d), v.DT_PS),
    """SELECT *, concat('L', lpad(CAST(row_number() OVER (ORDER BY first_frame, first_root) AS VARCHAR), 7, '0')) AS lineage_id, CAST((last_frame - first_frame) * 30 AS DOUBLE) AS span_ps FROM
 (SELECT first_frame, first_root, max(r.frame) AS last_frame, count(*) AS n_frames, avg(n_nodes) AS mean_size, min(n_nodes) AS min_size, max(n_nodes) AS max_size, max(n_centers) AS max_centers, max(n_anions) AS max_anions,
 CAST(sum(coalesce(is_merge, 0)) AS BIGINT) AS n_merges, CAST(sum(coalesce(is_split, 0)) AS BIGINT) AS n_splits, avg(score) AS mean_jaccard FROM lroot r JOIN geo g ON g.frame = r.frame AND g.root = r.root LEFT JOIN links l ON l.frame = r.frame AND l.current = r.root GROUP BY 1, 2)""",
    ["lroot", "geo", "links"], ["mean_size", "mean_jaccard", "span_ps"],
)
