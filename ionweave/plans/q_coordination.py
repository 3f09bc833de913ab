"""Queries over sources, contacts, coordination tables and structural summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.operators import blocks as bl
from ionweave.operators import components as cp
from ionweave.operators import contacts as ct
from ionweave.operators import coordination as co
from ionweave.operators import structure as st
from ionweave.plans import views as v
from ionweave.plans.registry import define, register
from ionweave.session import scratch
from ionweave.sources import checks as ck
from ionweave.sources import dump as dp
from ionweave.sources import tables as tb
from ionweave.functions import codecs

# --- A: selections, clock, checks, codecs -------------------------------------------------

HEADS = ("id type x y z", "id type xs ys zs", "id type xu yu zu x y z")


def _dump_text(s, d):
    """One dump record per event: a frame with one atom, under one of three headers."""
    e = v.table(s, d, "events")
    x, k = F.col("value"), F.col("event_id") % 3
    num = lambda c: c.cast("string")
    head = F.when(k == 0, HEADS[0]).when(k == 1, HEADS[1]).otherwise(HEADS[2])
    xyz = F.when(k == 1, F.concat_ws(" ", F.lit("0.5"), num(x / 1000), F.lit("0.25"))).otherwise(F.concat_ws(" ", num(x), F.lit("1.5"), num(-x)))
    tail = F.when(k == 2, F.lit(" 0 0 0")).otherwise(F.lit(""))
    return e.select(
        F.concat(
            num(F.col("event_id") * 10), F.lit("\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0.0 10.0\n-5.0 15.0\n0.0 40.0\nITEM: ATOMS "),
            head, F.lit("\n"), num(F.col("user_id")), F.lit(" 4 "), xyz, tail, F.lit("\n"),
        ).alias("value")
    )


register(
    "ingest_trajectory", lambda s, d: dp.parse_dump(_dump_text(s, d)),
    """SELECT row_number() OVER (ORDER BY event_id) - 1 AS frame, event_id * 10 AS step, user_id AS atom_id, 4 AS type, CASE WHEN event_id % 3 = 1 THEN 5 ELSE value END AS x, CASE WHEN event_id % 3 = 1 THEN -5 + value / 1000 * 20 ELSE 1.5 END AS y,
 CASE WHEN event_id % 3 = 1 THEN 10 ELSE -value END AS z, CAST(10 AS DOUBLE) AS box_a, CAST(20 AS DOUBLE) AS box_b, CAST(40 AS DOUBLE) AS box_c, CASE WHEN event_id % 3 = 2 THEN 'unwrapped' ELSE 'wrapped' END AS mode,
 CAST(90 AS DOUBLE) AS alpha, CAST(90 AS DOUBLE) AS beta, CAST(90 AS DOUBLE) AS gamma FROM events""",
    (), ["x", "y", "z"],
)


def _tilted_text(s, d):
    """One frame of one scaled atom per event, in a tilted box given by the bounds of its extent."""
    e = v.table(s, d, "events")
    num = lambda c: c.cast("string")
    return e.select(
        F.concat(
            num(F.col("event_id") * 10), F.lit("\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS xy xz yz pp pp pp\n-1.0 12.0 2.0\n-5.0 18.0 -1.0\n0.0 40.0 3.0\nITEM: ATOMS "),
            F.lit("id type xs ys zs\n"), num(F.col("user_id")), F.lit(" 4 0.5 "), num(F.col("value") / 1000), F.lit(" 0.25\n"),
        ).alias("value")
    )


register(
    "ingest_trajectory_tilted", lambda s, d: dp.parse_dump(_tilted_text(s, d)),
    """SELECT row_number() OVER (ORDER BY event_id) - 1 AS frame, event_id * 10 AS step, user_id AS atom_id, 4 AS type, 4.75 + value / 1000 * 2 AS x, -4.25 + value / 1000 * 20 AS y, CAST(10 AS DOUBLE) AS z,
 CAST(10 AS DOUBLE) AS box_a, sqrt(CAST(404 AS DOUBLE)) AS box_b, sqrt(CAST(1610 AS DOUBLE)) AS box_c, 'wrapped' AS mode,
 degrees(acos(58 / (sqrt(CAST(404 AS DOUBLE)) * sqrt(CAST(1610 AS DOUBLE))))) AS alpha, degrees(acos(-1 / sqrt(CAST(1610 AS DOUBLE)))) AS beta, degrees(acos(2 / sqrt(CAST(404 AS DOUBLE)))) AS gamma FROM events""",
    (), ["x", "y", "z", "box_b", "box_c", "alpha", "beta", "gamma"],
)


def _written(s, d):
    """States written as gzip CSV and read back typed."""
    out = scratch(s, "csv")
    tb.write_tables({"master": tb.frame_time(v.states(s, d), v.DT_PS)}, out, "csv.gz")
    return tb.read_master(s, f"{out}/master", fmt="csv")


register("read_master", _written, "SELECT *, frame * CAST(30 AS DOUBLE) AS time_ps FROM states", ["states"], ["time_ps"])


def _written_pairs(s, d):
    out = scratch(s, "pairs")
    tb.write_tables({"pairs": v.pairs(s, d)}, out)
    return tb.read_pairs(s, f"{out}/pairs", ["frame", "center_id", "anion_id", "min_distance"])


register("read_pairs", _written_pairs, "SELECT * FROM pairs", ["pairs"], ["min_distance", "mean_distance"])
register(
    "select_atoms",
    lambda s, d: tb.select_atoms(
        v.sites(s, d).withColumnRenamed("site_id", "atom_id").select("frame", "atom_id", "x"),
        v.sites(s, d).select(F.col("site_id").alias("atom_id"), "role", "ligand_id"),
        F.col("role") == "polymer",
    ),
    "SELECT site_id AS atom_id, frame, x, role, ligand_id FROM sites WHERE role = 'polymer'",
    ["sites"], ["x"],
)
register(
    "frame_slice",
    lambda s, d: tb.frame_slice(v.states(s, d), 10, 200, 3).select("frame", "center_id", "n_total"),
    "SELECT frame, center_id, n_total FROM states WHERE frame >= 10 AND frame < 200 AND (frame - 10) % 3 = 0",
    ["states"],
)
register(
    "frame_time",
    lambda s, d: tb.frame_time(v.track(s, d), v.DT_PS).select("entity_id", "frame", "time_ps"),
    "SELECT entity_id, frame, frame * CAST(30 AS DOUBLE) AS time_ps FROM track",
    ["track"], ["time_ps"],
)
register(
    "encode_id_list",
    lambda s, d: v.contacts(s, d).groupBy("frame", "center_id").agg(
        codecs.encode_id_list(F.collect_set("ligand_id")).alias("ligand_ids")
    ),
    "SELECT frame, center_id, string_agg(CAST(ligand_id AS VARCHAR), ';' ORDER BY ligand_id) AS ligand_ids"
    " FROM (SELECT DISTINCT frame, center_id, ligand_id FROM contacts) GROUP BY 1, 2",
    ["contacts"],
)
register(
    "decode_id_list",
    lambda s, d: v.table(s, d, "events").select(
        "event_id",
        F.explode(
            codecs.decode_id_list(
                F.concat_ws(";", F.col("user_id").cast("string"), F.lit(" "), F.lit("x"),
                            F.concat(F.col("user_id").cast("string"), F.lit(".0")),
                            (F.col("event_id") % 7).cast("string"))
            )
        ).alias("id"),
    ),
    "SELECT event_id, user_id AS id FROM events UNION SELECT event_id, event_id % 7 AS id FROM events",
)
register(
    "decode_json_map",
    lambda s, d: v.table(s, d, "events").select(
        "event_id", F.explode(codecs.decode_site_map(F.concat(F.lit('{"7":[1,2],"'), F.col("user_id").cast("string"), F.lit('":'), (F.col("event_id") % 3 + 1).cast("string"), F.lit("}")))).alias("key", "sites")
    ).select("event_id", "key", F.explode("sites").alias("site")).distinct(),
    """SELECT event_id, user_id AS key, CAST(unnest(range(event_id % 3 + 1)) AS INTEGER) AS site FROM events WHERE user_id <> 7
 UNION ALL SELECT event_id, CAST(7 AS BIGINT) AS key, unnest([1, 2]) AS site FROM events WHERE user_id <> 7
 UNION ALL SELECT event_id, CAST(7 AS BIGINT), CAST(unnest(range(event_id % 3 + 1)) AS INTEGER) FROM events WHERE user_id = 7""",
)
register(
    "discard_initial_fraction",
    lambda s, d: ck.discard_initial_fraction(v.states(s, d), 0.25).groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_total").alias("n_total")
    ),
    "SELECT frame, count(*) AS n, CAST(sum(n_total) AS BIGINT) AS n_total FROM states"
    " WHERE frame >= (SELECT f0 + CAST(floor(nf * 0.25) AS BIGINT) FROM bounds) GROUP BY 1",
    ["states", "bounds"],
)
register(
    "topology_profile",
    lambda s, d: ck.topology_profile(v.table(s, d, "lineitem").select("l_suppkey"), "l_suppkey"),
    """SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, min(n) AS min_size, max(n) AS max_size,
 avg(n) AS mean_size, median(n) AS median_size FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)""",
    (), ["mean_size", "median_size"],
)
register(
    "reference_site_check",
    lambda s, d: ck.reference_site_check(
        v.table(s, d, "lineitem"), "l_orderkey", F.col("l_linenumber") == 1, F.col("l_returnflag") == "N"
    ),
    """SELECT * FROM (SELECT *, CASE WHEN n_sites > 0 AND n_reference = 0 THEN 'sites without reference'
 WHEN n_sites = 0 AND n_reference > 0 THEN 'reference without sites' WHEN n_reference > 1 THEN 'several references' END AS reason
 FROM (SELECT l_orderkey, count(*) FILTER (l_linenumber = 1) AS n_reference, count(*) FILTER (l_returnflag = 'N') AS n_sites
 FROM lineitem GROUP BY 1)) WHERE reason IS NOT NULL""",
)
register(
    "box_check",
    lambda s, d: ck.box_check(
        v.track(s, d).withColumns({"l": F.col("box") - (F.col("entity_id") == 3).cast("double") * 25, "ang": F.lit(90.0)}),
        ["l"], ["ang", "ang", "ang"],
    ),
    "SELECT frame, CAST(min(CASE WHEN entity_id = 3 THEN 0 ELSE 1 END) AS INTEGER) AS lengths_ok, 1 AS angles_ok,"
    " 1 AS is_orthorhombic FROM track GROUP BY frame",
    ["track"],
)
register(
    "grid_check",
    lambda s, d: ck.grid_check(v.contacts(s, d)),
    """SELECT 'duplicate_cells' AS "check", CAST(v = 0 AS INTEGER) AS passed, CAST(v AS DOUBLE) AS value FROM (SELECT count(*) AS v FROM (SELECT 1 FROM contacts GROUP BY frame, center_id HAVING count(*) > 1))
 UNION ALL SELECT 'missing_cells', CAST(v = 0 AS INTEGER), v FROM (SELECT count(DISTINCT frame) * count(DISTINCT center_id) - count(DISTINCT (frame, center_id)) AS v FROM contacts)
 UNION ALL SELECT 'incomplete_centers', CAST(v = 0 AS INTEGER), v FROM (SELECT count(*) AS v FROM (SELECT center_id FROM contacts GROUP BY 1 HAVING count(DISTINCT frame) < (SELECT count(DISTINCT frame) FROM contacts)))""",
    ["contacts"],
)


def _validation(s, d):
    st_ = v.states(s, d)
    return ck.validation_table(
        st_,
        {
            "total_is_sum": (F.bool_and(F.col("n_total") == F.col("n_site") + F.col("n_anion_site")), F.count(F.lit(1))),
            "no_crowded_center": (F.max("n_total") <= 4, F.max("n_total")),
        },
        warnings=["no_crowded_center"],
    )


register(
    "validation_table", _validation,
    """WITH c AS (SELECT 'total_is_sum' AS "check", CAST(bool_and(n_total = n_site + n_anion_site) AS INTEGER) AS passed, CAST(count(*) AS DOUBLE) AS value, false AS soft FROM states
 UNION ALL SELECT 'no_crowded_center', CAST(max(n_total) <= 4 AS INTEGER), max(n_total), true FROM states)
 SELECT "check", passed, value, CASE WHEN passed = 1 THEN 'PASSED' WHEN soft THEN 'WARNING' ELSE 'FAILED' END AS status FROM c
 UNION ALL SELECT 'status', CAST(count(*) FILTER (passed = 0 AND NOT soft) = 0 AS INTEGER), count(*) FILTER (passed = 0),
 CASE WHEN count(*) FILTER (passed = 0 AND NOT soft) > 0 THEN 'FAILED' WHEN count(*) FILTER (passed = 0) > 0 THEN 'PASSED_WITH_WARNINGS' ELSE 'PASSED' END FROM c""".replace("WITH c AS", "SELECT * FROM (WITH c AS") + ")",
    ["states"],
)

register(
    "encode_json_map", lambda s, d: tb.master_texts(v.contacts(s, d)),
    """SELECT frame, center_id, concat('{', coalesce(string_agg(concat('"', ligand_id, '":[', sites, ']'), ',' ORDER BY ligand_id) FILTER (ligand_kind = 'polymer'), ''), '}') AS chain_sites,
 concat('{', coalesce(string_agg(concat('"', ligand_id, '":', n), ',' ORDER BY ligand_id) FILTER (ligand_kind = 'anion'), ''), '}') AS anion_counts FROM
 (SELECT frame, center_id, ligand_kind, ligand_id, count(*) AS n, string_agg(CAST(site_index AS VARCHAR), ',' ORDER BY site_index) AS sites FROM contacts GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
    ["contacts"],
)
register(
    "contacts_from_master", lambda s, d: tb.contacts_from_master(tb.master_texts(v.contacts(s, d))),
    """SELECT frame, center_id, ligand_kind, ligand_id, site_index FROM contacts WHERE ligand_kind = 'polymer'
 UNION ALL SELECT frame, center_id, ligand_kind, ligand_id, unnest(range(1, denticity + 1)) FROM lig WHERE ligand_kind = 'anion'""",
    ["contacts", "lig"],
)

# --- C: coordination database --------------------------------------------------------------

register("coordination_numbers", lambda s, d: ct.coordination_numbers(v.contacts(s, d), v.grid(s, d)),
         "SELECT * FROM numbers", ["numbers"])
register("coordination_state", lambda s, d: v.states(s, d).select("frame", "center_id", "state"),
         "SELECT frame, center_id, state FROM states", ["states"])
register(
    "chain_site_index",
    lambda s, d: ct.chain_site_index(
        v.table(s, d, "orders").select(F.col("o_custkey").alias("chain_id"), F.col("o_orderkey").alias("atom_id"))
    ),
    "SELECT o_custkey AS chain_id, o_orderkey AS atom_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS site_index FROM orders",
)
register(
    "plausible_chain_keys",
    lambda s, d: ct.plausible_chain_keys(v.table(s, d, "orders"), ("o_custkey", "o_orderkey", "o_orderstatus")),
    " UNION ALL ".join(
        f"""SELECT '{k}' AS chain_key, CAST({i} AS BIGINT) AS preference, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_sites, median(n) AS median_size,
 CAST(count(*) >= 2 AND count(*) < sum(n) AND median(n) >= 2 AS INTEGER) AS plausible FROM (SELECT count(*) AS n FROM orders GROUP BY {k})"""
        for i, k in enumerate(("o_custkey", "o_orderkey", "o_orderstatus"))
    ), (), ["median_size"],
)
define("poly", "SELECT frame, ligand_id AS chain_id, center_id, site_index FROM contacts WHERE ligand_kind = 'polymer'", "contacts")
define(
    "chain_pairs",
    """SELECT a.frame, a.chain_id, a.center_id AS center_a, b.center_id AS center_b, min(abs(a.site_index - b.site_index)) AS separation
 FROM poly a JOIN poly b ON a.frame = b.frame AND a.chain_id = b.chain_id AND a.center_id < b.center_id GROUP BY 1, 2, 3, 4""",
    "poly",
)
define(
    "occupancy",
    """SELECT c.frame, c.chain_id, coalesce(n_centers, 0) AS n_centers, CAST(coalesce(n_centers, 0) >= 2 AS INTEGER) AS is_shared,
 coalesce(n_pairs, 0) AS n_pairs, coalesce(n_local, 0) AS n_local_pairs, coalesce(n_pairs - n_local, 0) AS n_remote_pairs,
 CAST(coalesce(n_local, 0) > 0 AS INTEGER) AS has_local_bridge, CAST(coalesce(n_pairs - n_local, 0) > 0 AS INTEGER) AS has_remote_pair, min_separation
 FROM chains c LEFT JOIN (SELECT frame, chain_id, count(DISTINCT center_id) AS n_centers FROM poly GROUP BY 1, 2) n ON n.frame = c.frame AND n.chain_id = c.chain_id
 LEFT JOIN (SELECT frame, chain_id, count(*) AS n_pairs, count(*) FILTER (separation <= 4) AS n_local, min(separation) AS min_separation FROM chain_pairs GROUP BY 1, 2) p
 ON p.frame = c.frame AND p.chain_id = c.chain_id""",
    "chains", "chain_pairs",
)
define(
    "anions",
    """SELECT frame, ligand_id AS anion_id, count(*) AS n_centers, CAST(count(*) >= 2 AS INTEGER) AS is_bridging
 FROM lig WHERE ligand_kind = 'anion' GROUP BY 1, 2""", "lig",
)
# Component label = smallest center; centers 2*id, anions 2*id+1 as node numbers.
define("half", "SELECT frame, center_id * 2 AS a, anion_id * 2 + 1 AS b FROM edges", "edges")
define("ends", "SELECT frame, a, b FROM half UNION ALL SELECT frame, b AS a, a AS b FROM half", "half")
define(
    "reach",
    """SELECT frame, a AS node, a AS lbl FROM (SELECT DISTINCT frame, a FROM ends WHERE a % 2 = 0)
 UNION SELECT e.frame, e.b, r.lbl FROM reach r JOIN ends e ON e.frame = r.frame AND e.a = r.node""",
    "ends",
)
define("bound_nodes", "SELECT frame, node, min(lbl) // 2 AS root FROM reach GROUP BY 1, 2", "reach")
define(
    "nodes",
    """SELECT frame, CASE WHEN node % 2 = 0 THEN 'center' ELSE 'anion' END AS kind, node // 2 AS node_id, root FROM bound_nodes
 UNION ALL SELECT frame, 'center', center_id, center_id FROM grid WHERE (frame, center_id) NOT IN (SELECT frame, center_id FROM edges)""",
    "bound_nodes", "grid", "edges",
)
define(
    "clusters",
    """SELECT frame, root, concat(frame, '_', dense_rank() OVER (PARTITION BY frame ORDER BY root)) AS cluster_id,
 n_centers, n_anions, n_centers + n_anions AS n_nodes, CAST(n_centers >= 2 AS INTEGER) AS is_multi_center FROM
 (SELECT frame, root, count(*) FILTER (kind = 'center') AS n_centers, count(*) FILTER (kind = 'anion') AS n_anions FROM nodes GROUP BY 1, 2)""",
    "nodes",
)
register("chain_bridges", lambda s, d: ct.chain_bridges(v.contacts(s, d)),
         "SELECT * FROM chain_pairs WHERE separation <= 4", ["chain_pairs"])
register("min_site_separation", lambda s, d: ct.min_site_separation(v.contacts(s, d)).filter("min_separation is not null"),
         "SELECT frame, chain_id, min(separation) AS min_separation FROM chain_pairs GROUP BY 1, 2", ["chain_pairs"])
register("chain_occupancy", lambda s, d: ct.chain_occupancy(v.contacts(s, d), v.chains(s, d)),
         "SELECT * FROM occupancy", ["occupancy"])
register("anion_bridging", lambda s, d: ct.anion_bridging(v.contacts(s, d)), "SELECT * FROM anions", ["anions"])
register("contact_components", lambda s, d: v.components(s, d, True), "SELECT * FROM nodes", ["nodes"])


def _clusters(s, d):
    return cp.cluster_table(v.components(s, d, True))


register("cluster_table", _clusters, "SELECT * FROM clusters", ["clusters"])
register(
    "cluster_members", lambda s, d: cp.cluster_members(v.components(s, d, True), _clusters(s, d)),
    "SELECT n.frame, cluster_id, kind, node_id FROM nodes n JOIN clusters c ON n.frame = c.frame AND n.root = c.root",
    ["clusters", "nodes"],
)


def _master(s, d):
    nodes = v.components(s, d, True)
    return co.master_table(v.contacts(s, d), v.grid(s, d), nodes, cp.cluster_table(nodes), v.DT_PS)


define("chain_ends", "SELECT frame, chain_id, center_a AS center_id, separation FROM chain_pairs UNION ALL SELECT frame, chain_id, center_b, separation FROM chain_pairs", "chain_pairs")
define(
    "master",
    """SELECT s.frame, s.frame * CAST(30 AS DOUBLE) AS time_ps, s.center_id, n_site, n_chain, n_anion_site, n_anion, n_total, state,
 CAST(coalesce(nb, 0) > 0 AS INTEGER) AS is_anion_bridged, coalesce(nb, 0) AS n_bridging_anions,
 CAST(coalesce(ns, 0) > 0 AS INTEGER) AS is_shared_chain, coalesce(ns, 0) AS n_shared_chains,
 CAST(coalesce(nl, 0) > 0 AS INTEGER) AS is_local_bridged, coalesce(nl, 0) AS n_local_chains,
 CAST(coalesce(nr, 0) > 0 AS INTEGER) AS is_remote_shared, coalesce(nr, 0) AS n_remote_chains,
 c.cluster_id, c.n_centers AS cluster_n_centers, c.n_anions AS cluster_n_anions, c.n_nodes AS cluster_n_nodes, c.is_multi_center
 FROM states s JOIN nodes n ON n.kind = 'center' AND n.frame = s.frame AND n.node_id = s.center_id
 JOIN clusters c ON c.frame = n.frame AND c.root = n.root
 LEFT JOIN (SELECT l.frame, l.center_id, count(*) AS nb FROM lig l JOIN anions a ON a.frame = l.frame AND a.anion_id = l.ligand_id AND is_bridging = 1
  WHERE ligand_kind = 'anion' GROUP BY 1, 2) b ON b.frame = s.frame AND b.center_id = s.center_id
 LEFT JOIN (SELECT frame, center_id, count(DISTINCT chain_id) AS ns, count(DISTINCT chain_id) FILTER (separation <= 4) AS nl,
  count(DISTINCT chain_id) FILTER (separation > 4) AS nr FROM chain_ends GROUP BY 1, 2) p ON p.frame = s.frame AND p.center_id = s.center_id""",
    "states", "nodes", "clusters", "lig", "anions", "chain_ends",
)
register("master_table", _master, "SELECT * FROM master", ["master"], ["time_ps"])


def frame_summary(s, d):
    n_anions = v.table(s, d, "supplier").select((F.max(F.floor(F.col("s_suppkey") / 2)) + 3).alias("n")).scalar()
    n_chains = v.table(s, d, "supplier").select((F.max(F.floor(F.col("s_suppkey") / 4)) + 2).alias("n")).scalar()
    nodes = v.components(s, d, True)
    clusters = cp.cluster_table(nodes)
    master = co.master_table(v.contacts(s, d), v.grid(s, d), nodes, clusters, v.DT_PS)
    return co.frame_summary(
        master, ct.anion_bridging(v.contacts(s, d)), ct.chain_occupancy(v.contacts(s, d), v.chains(s, d)),
        clusters, n_anions, n_chains,
    )


_FS_DOUBLES = (
    "time_ps frac_P frac_PT frac_T frac_F mean_site_cn mean_chain_cn mean_anion_site_cn mean_anion_cn mean_total_cn "
    "frac_coordinated_anions_bridging frac_all_anions_bridging frac_centers_anion_bridged frac_coordinating_chains_shared "
    "frac_all_chains_shared frac_coordinating_chains_local frac_all_chains_local frac_centers_shared_chain frac_centers_local_bridged "
    "frac_centers_remote_shared mean_centers_per_chain frac_centers_any_bridge frac_centers_both_bridges frac_centers_chain_only "
    "frac_centers_anion_only mean_cluster_number mean_cluster_weight largest_cluster_fraction frac_centers_multi_cluster frac_single_clusters"
).split()
register(
    "frame_summary", frame_summary,
    """SELECT m.frame, time_ps, n_centers, n_P, n_PT, n_T, n_F, n_P / n_centers AS frac_P, n_PT / n_centers AS frac_PT, n_T / n_centers AS frac_T, n_F / n_centers AS frac_F,
 mean_site_cn, mean_chain_cn, mean_anion_site_cn, mean_anion_cn, mean_total_cn,
 coalesce(nca, 0) AS n_coordinated_anions, coalesce(nba, 0) AS n_bridging_anions, coalesce(nba / nullif(nca, 0), 0) AS frac_coordinated_anions_bridging,
 coalesce(nba, 0) / (SELECT max(s_suppkey // 2) + 3 FROM supplier) AS frac_all_anions_bridging, xb / n_centers AS frac_centers_anion_bridged,
 ncc AS n_coordinating_chains, nsc AS n_shared_chains, nlc AS n_local_chains, nrc AS n_remote_chains,
 coalesce(nsc / nullif(ncc, 0), 0) AS frac_coordinating_chains_shared, nsc / (SELECT max(s_suppkey // 4) + 2 FROM supplier) AS frac_all_chains_shared,
 coalesce(nlc / nullif(ncc, 0), 0) AS frac_coordinating_chains_local, nlc / (SELECT max(s_suppkey // 4) + 2 FROM supplier) AS frac_all_chains_local,
 xs / n_centers AS frac_centers_shared_chain, xl / n_centers AS frac_centers_local_bridged, xr / n_centers AS frac_centers_remote_shared,
 coalesce(onc / nullif(ncc, 0), 0) AS mean_centers_per_chain, mxc AS max_centers_on_chain,
 xany / n_centers AS frac_centers_any_bridge, xboth / n_centers AS frac_centers_both_bridges, xco / n_centers AS frac_centers_chain_only, xao / n_centers AS frac_centers_anion_only,
 ncl AS n_clusters, mcn AS mean_cluster_number, mcw AS mean_cluster_weight, lc AS largest_cluster, lc / n_centers AS largest_cluster_fraction,
 multi / n_centers AS frac_centers_multi_cluster, single / ncl AS frac_single_clusters
 FROM (SELECT frame, any_value(time_ps) AS time_ps, count(*) AS n_centers, count(*) FILTER (state = 'P') AS n_P, count(*) FILTER (state = 'PT') AS n_PT,
  count(*) FILTER (state = 'T') AS n_T, count(*) FILTER (state = 'F') AS n_F, avg(n_site) AS mean_site_cn, avg(n_chain) AS mean_chain_cn, avg(n_anion_site) AS mean_anion_site_cn,
  avg(n_anion) AS mean_anion_cn, avg(n_total) AS mean_total_cn, sum(is_anion_bridged) AS xb, sum(is_shared_chain) AS xs, sum(is_local_bridged) AS xl, sum(is_remote_shared) AS xr,
  sum(greatest(is_anion_bridged, is_local_bridged)) AS xany, sum(is_anion_bridged * is_local_bridged) AS xboth,
  sum(is_local_bridged * (1 - is_anion_bridged)) AS xco, sum(is_anion_bridged * (1 - is_local_bridged)) AS xao FROM master GROUP BY 1) m
 LEFT JOIN (SELECT frame, count(*) AS nca, CAST(sum(is_bridging) AS BIGINT) AS nba FROM anions GROUP BY 1) a ON a.frame = m.frame
 LEFT JOIN (SELECT frame, count(*) FILTER (n_centers > 0) AS ncc, CAST(sum(is_shared) AS BIGINT) AS nsc, CAST(sum(has_local_bridge) AS BIGINT) AS nlc, CAST(sum(has_remote_pair) AS BIGINT) AS nrc,
  sum(n_centers) AS onc, max(n_centers) AS mxc FROM occupancy GROUP BY 1) c ON c.frame = m.frame
 LEFT JOIN (SELECT frame, count(*) AS ncl, avg(n_centers) AS mcn, sum(n_centers * n_centers) / sum(n_centers) AS mcw, max(n_centers) AS lc,
  sum(CASE WHEN n_centers >= 2 THEN n_centers ELSE 0 END) AS multi, count(*) FILTER (n_centers = 1) AS single FROM clusters GROUP BY 1) k ON k.frame = m.frame""",
    ["master", "anions", "occupancy", "clusters"], _FS_DOUBLES,
)

# --- D: structural summary -----------------------------------------------------------------


def _blocks(s, d):
    return bl.frame_blocks(v.frames(s, d))


register("frame_blocks", _blocks, "SELECT * FROM blocks", ["blocks"])
_NUM = list(st.NUMBER_METRICS)
register(
    "block_statistics",
    lambda s, d: bl.block_statistics(v.states(s, d).join(_blocks(s, d), "frame"), "block", _NUM),
    """SELECT metric, avg(value) AS mean, stddev_samp(value) AS block_std, stddev_samp(value) / sqrt(count(value)) AS block_sem, count(value) AS n_blocks
 FROM (UNPIVOT (SELECT block, avg(n_site) AS n_site, avg(n_chain) AS n_chain, avg(n_anion_site) AS n_anion_site, avg(n_anion) AS n_anion, avg(n_total) AS n_total
 FROM states JOIN blocks USING (frame) GROUP BY 1) ON n_site, n_chain, n_anion_site, n_anion, n_total INTO NAME metric VALUE value) GROUP BY 1""",
    ["states", "blocks"], ["mean", "block_std", "block_sem"],
)
define(
    "state_fracs",
    "SELECT block, " + ", ".join(f"count(*) FILTER (state = '{x}') / count(*) AS frac_{x}" for x in ("P", "PT", "T", "F"))
    + " FROM states JOIN blocks USING (frame) GROUP BY 1", "states", "blocks",
)
_FR = ["frac_P", "frac_PT", "frac_T", "frac_F"]
register("state_block_fractions", lambda s, d: st.state_block_fractions(v.states(s, d), _blocks(s, d)),
         "SELECT * FROM state_fracs", ["state_fracs"], _FR)
register(
    "state_summary", lambda s, d: st.state_summary(st.state_block_fractions(v.states(s, d), _blocks(s, d))),
    " UNION ALL ".join(
        f"SELECT '{x}' AS state, avg(frac_{x}) AS mean, stddev_samp(frac_{x}) AS std, stddev_samp(frac_{x}) / sqrt(count(*)) AS sem, count(*) AS n_blocks FROM state_fracs"
        for x in ("P", "PT", "T", "F")
    ), ["state_fracs"], ["mean", "std", "sem"],
)
register(
    "coordination_distribution", lambda s, d: st.coordination_distribution(v.states(s, d)),
    """SELECT metric, value, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY metric) AS probability
 FROM (UNPIVOT (SELECT n_site, n_chain, n_anion_site, n_anion, n_total FROM states) ON n_site, n_chain, n_anion_site, n_anion, n_total INTO NAME metric VALUE value) GROUP BY 1, 2""",
    ["states"], ["probability"],
)


def _share(table: str, cols: str, where: str = "true") -> str:
    return f"SELECT {cols}, count(*) AS count, count(*) / sum(count(*)) OVER () AS probability FROM {table} WHERE {where} GROUP BY ALL"


register("joint_coordination", lambda s, d: st.joint_coordination(v.states(s, d)), _share("states", "n_site, n_anion"), ["states"], ["probability"])
register("anion_denticity_distribution", lambda s, d: st.anion_denticity_distribution(ct.ligand_contacts(v.contacts(s, d))),
         _share("lig", "denticity", "ligand_kind = 'anion'"), ["lig"], ["probability"])
register("centers_per_anion", lambda s, d: bl.probability(ct.anion_bridging(v.contacts(s, d)), ["n_centers"]),
         _share("anions", "n_centers"), ["anions"], ["probability"])
register("centers_per_chain", lambda s, d: bl.probability(ct.chain_occupancy(v.contacts(s, d), v.chains(s, d)), ["n_centers"]),
         _share("occupancy", "n_centers"), ["occupancy"], ["probability"])
register("site_separation_distribution", lambda s, d: st.site_separation_distribution(ct.chain_occupancy(v.contacts(s, d), v.chains(s, d))),
         _share("occupancy", "min_separation", "n_pairs >= 1"), ["occupancy"], ["probability"])
register(
    "cluster_size_distribution", lambda s, d: st.cluster_size_distribution(_clusters(s, d)),
    """SELECT *, count / sum(count) OVER () AS probability, weight / sum(weight) OVER () AS center_fraction FROM
 (SELECT n_centers, count(*) AS count, count(*) * n_centers AS weight FROM clusters GROUP BY 1)""",
    ["clusters"], ["probability", "center_fraction"],
)


def _systems(s, d):
    parts = {
        n: st.coordination_distribution(v.states(s, d).filter(F.col("center_id") % 2 == r))
        for n, r in (("even", 0), ("odd", 1))
    }
    return st.combine_systems(parts, ["odd"])


register(
    "combine_systems", _systems,
    """SELECT metric, value, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY system, metric) AS probability, system,
 CAST(CASE system WHEN 'odd' THEN 0 ELSE 1 END AS BIGINT) AS system_rank
 FROM (UNPIVOT (SELECT CASE WHEN center_id % 2 = 0 THEN 'even' ELSE 'odd' END AS system, n_site, n_chain, n_anion_site, n_anion, n_total FROM states)
 ON n_site, n_chain, n_anion_site, n_anion, n_total INTO NAME metric VALUE value) GROUP BY metric, value, system""",
    ["states"], ["probability"],
)
