"""Queries over denticity, ligand sharing and network topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionweave.operators import components as cp
from ionweave.operators import contacts as ct
from ionweave.operators import ligands as li
from ionweave.plans import views as v
from ionweave.plans.registry import define, register

BLOCK_NS = 2.0
Z = 2
BLOCK = "CAST(floor(frame * CAST(30 AS DOUBLE) / 1000 / 2) AS BIGINT)"


def _dent(s, d):
    return li.denticity_contacts(v.contacts(s, d))


def _counts(s, d):
    return li.denticity_counts(_dent(s, d), v.DT_PS, BLOCK_NS)


def _numbers(s, d):
    return ct.coordination_numbers(v.contacts(s, d), v.grid(s, d))


register("denticity_contacts", _dent, "SELECT frame, center_id, ligand_kind, ligand_id, denticity FROM lig", ["lig"])
register(
    "denticity_check", lambda s, d: li.denticity_check(_dent(s, d), _numbers(s, d)),
    """SELECT 'bad_sites' AS "check", 1 AS passed, CAST(0 AS DOUBLE) AS value UNION ALL SELECT 'bad_anion_sites', 1, 0
 UNION ALL SELECT 'high_denticity', CAST(count(*) = 0 AS INTEGER), count(*) FROM (SELECT frame, center_id FROM lig GROUP BY 1, 2 HAVING max(denticity) > 4) UNION ALL SELECT 'rows', 1, count(*) FROM grid""",
    ["lig", "grid"], ["value"],
)


def _denticity_texts(s, d):
    """Texts made of events; every fifth lacks its end and every seventh is blank."""
    whole = F.concat(F.lit('{"'), F.col("user_id").cast("string"), F.lit('":'), (F.col("event_id") % 4).cast("string"))
    text = F.when(F.col("event_id") % 7 == 0, " ").when(F.col("event_id") % 5 == 0, whole).otherwise(F.concat(whole, F.lit("}")))
    return v.table(s, d, "events").select(text.alias("denticity_json"))


register(
    "denticity_text_check", lambda s, d: li.denticity_text_check(_denticity_texts(s, d), {"polymer": "denticity_json"}),
    """SELECT 'bad_text_polymer' AS "check", CAST(count(*) = 0 AS INTEGER) AS passed, CAST(count(*) AS DOUBLE) AS value FROM events WHERE event_id % 5 = 0 AND event_id % 7 <> 0
 UNION ALL SELECT 'nonpositive_polymer', CAST(count(*) = 0 AS INTEGER), count(*) FROM events WHERE event_id % 4 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0""",
    [], ["value"],
)
define("dcount", f"SELECT ligand_kind AS kind, {BLOCK} AS block, denticity, count(*) AS count FROM lig GROUP BY 1, 2, 3", "lig")
define(
    "dblock",
    """SELECT *, count / sum(count) OVER (PARTITION BY kind, block) AS probability FROM (SELECT kind, block, denticity, coalesce(count, 0) AS count FROM
 (SELECT kind, block, unnest(range(1, top + 1)) AS denticity FROM (SELECT DISTINCT kind, block FROM dcount) JOIN (SELECT kind, max(denticity) AS top FROM dcount GROUP BY 1) USING (kind)) LEFT JOIN dcount USING (kind, block, denticity))""", "dcount",
)
register("denticity_block_distribution", lambda s, d: li.denticity_block_distribution(_counts(s, d)), "SELECT * FROM dblock", ["dblock"], ["probability"])
register(
    "denticity_distribution", lambda s, d: li.denticity_distribution(_counts(s, d)),
    """SELECT *, count / sum(count) OVER (PARTITION BY kind) AS probability FROM (SELECT kind, denticity, CAST(sum(count) AS BIGINT) AS count, avg(probability) AS block_mean, stddev_samp(probability) AS block_std,
 stddev_samp(probability) / sqrt(count(*)) AS block_sem FROM dblock GROUP BY 1, 2)""", ["dblock"], ["probability", "block_mean", "block_std", "block_sem"],
)
define(
    "dsum",
    """SELECT kind, block, CAST(sum(count) AS BIGINT) AS n_contacts, sum(denticity * count) / sum(count) AS mean_denticity, coalesce(sum(count) FILTER (denticity >= 2), 0) / sum(count) AS frac_multi,
 coalesce(sum(count) FILTER (denticity >= 3), 0) / sum(count) AS frac_three FROM dcount GROUP BY 1, 2""", "dcount",
)
register("denticity_block_summary", lambda s, d: li.denticity_block_summary(_counts(s, d)), "SELECT * FROM dsum", ["dsum"], ["mean_denticity", "frac_multi", "frac_three"])
register(
    "denticity_summary", lambda s, d: li.denticity_summary(_counts(s, d)),
    """SELECT * FROM (SELECT ligand_kind AS kind, count(*) AS n_contacts, avg(denticity) AS mean_denticity, avg(CAST(denticity = 1 AS INTEGER)) AS frac_mono, avg(CAST(denticity >= 2 AS INTEGER)) AS frac_multi, avg(CAST(denticity >= 3 AS INTEGER)) AS frac_three,
 min(denticity) AS min_denticity, max(denticity) AS max_denticity FROM lig GROUP BY 1) JOIN (SELECT kind, stddev_samp(mean_denticity) AS std_mean_denticity, stddev_samp(mean_denticity) / sqrt(count(*)) AS sem_mean_denticity,
 stddev_samp(frac_multi) AS std_frac_multi, stddev_samp(frac_multi) / sqrt(count(*)) AS sem_frac_multi, stddev_samp(frac_three) / sqrt(count(*)) AS sem_frac_three, count(*) AS n_blocks FROM dsum GROUP BY 1) USING (kind)""",
    ["lig", "dsum"], ["mean_denticity", "frac_mono", "frac_multi", "frac_three", "std_mean_denticity", "sem_mean_denticity", "std_frac_multi", "sem_frac_multi", "sem_frac_three"],
)
register(
    "denticity_frame_summary", lambda s, d: li.denticity_frame_summary(_dent(s, d), _numbers(s, d), v.DT_PS, BLOCK_NS),
    f"""SELECT {BLOCK} AS block, count(*) AS n_center_frames, count(*) FILTER (n_chain > 0) AS n_polymer_frames, count(*) FILTER (n_anion > 0) AS n_anion_frames, avg(n_site) FILTER (n_chain > 0) AS mean_sites_bound, avg(n_chain) FILTER (n_chain > 0) AS mean_chains_bound,
 avg(p) FILTER (n_chain > 0) AS mean_max_chain_denticity, avg(n_anion_site) FILTER (n_anion > 0) AS mean_anion_sites_bound, avg(n_anion) FILTER (n_anion > 0) AS mean_anions_bound, avg(a) FILTER (n_anion > 0) AS mean_max_anion_denticity
 FROM numbers LEFT JOIN (SELECT frame, center_id, max(denticity) FILTER (ligand_kind = 'polymer') AS p, max(denticity) FILTER (ligand_kind = 'anion') AS a FROM lig GROUP BY 1, 2) USING (frame, center_id) GROUP BY 1""",
    ["numbers", "lig"], ["mean_sites_bound", "mean_chains_bound", "mean_max_chain_denticity", "mean_anion_sites_bound", "mean_anions_bound", "mean_max_anion_denticity"],
)


def _mult(s, d):
    return li.ligand_multiplicity(v.contacts(s, d))


define(
    "elem",
    """SELECT DISTINCT frame, CASE ligand_kind WHEN 'polymer' THEN 'chain' ELSE 'anion' END AS kind, ligand_id AS ligand, CAST(-1 AS BIGINT) AS site, center_id FROM contacts
 UNION ALL SELECT DISTINCT frame, 'chain_site', ligand_id, site_index, center_id FROM contacts WHERE ligand_kind = 'polymer'""", "contacts",
)
define("mult", "SELECT frame, kind, ligand, site, count(*) AS n_centers FROM elem GROUP BY 1, 2, 3, 4", "elem")
register("ligand_multiplicity", _mult, "SELECT * FROM mult", ["mult"])
register("multiplicity_distribution", lambda s, d: li.multiplicity_distribution(_mult(s, d)),
         "SELECT kind, n_centers, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY kind) AS probability FROM mult GROUP BY 1, 2", ["mult"], ["probability"])
register(
    "ligand_sharing_summary", lambda s, d: li.ligand_sharing_summary(_mult(s, d)),
    """SELECT kind, count(*) AS n_ligand_frames, count(*) FILTER (n_centers = 1) AS n_single, count(*) FILTER (n_centers >= 2) AS n_multi, avg(CAST(n_centers = 1 AS INTEGER)) AS frac_single, avg(CAST(n_centers >= 2 AS INTEGER)) AS frac_multi,
 avg(n_centers) AS mean_centers, max(n_centers) AS max_centers, CAST(sum(n_centers) AS BIGINT) AS n_contacts, CAST(coalesce(sum(n_centers) FILTER (n_centers >= 2), 0) AS BIGINT) AS n_shared_contacts,
 coalesce(sum(n_centers) FILTER (n_centers >= 2), 0) / sum(n_centers) AS frac_shared_contacts FROM mult GROUP BY 1""",
    ["mult"], ["frac_single", "frac_multi", "mean_centers", "frac_shared_contacts"],
)
register("ligand_sharing_blocks", lambda s, d: li.ligand_sharing_blocks(_mult(s, d), v.DT_PS, BLOCK_NS),
         f"SELECT kind, {BLOCK} AS block, count(*) AS n_ligand_frames, avg(CAST(n_centers >= 2 AS INTEGER)) AS frac_multi, avg(n_centers) AS mean_centers FROM mult GROUP BY 1, 2", ["mult"], ["frac_multi", "mean_centers"])
register(
    "center_sharing_summary", lambda s, d: li.center_sharing_summary(v.contacts(s, d), v.grid(s, d)),
    """SELECT count(DISTINCT frame) AS n_frames, count(*) AS n_center_frames, avg(CAST(c IS NOT NULL AS INTEGER)) AS frac_polymer_bound, avg(CAST(a IS NOT NULL AS INTEGER)) AS frac_anion_bound, avg(coalesce(c, 0)) AS frac_shared_chain, avg(c) AS frac_shared_chain_given_bound,
 avg(coalesce(o, 0)) AS frac_shared_site, avg(o) AS frac_shared_site_given_bound, avg(coalesce(a, 0)) AS frac_shared_anion, avg(a) AS frac_shared_anion_given_bound FROM grid LEFT JOIN
 (SELECT frame, center_id, max(s) FILTER (kind = 'chain') AS c, max(s) FILTER (kind = 'chain_site') AS o, max(s) FILTER (kind = 'anion') AS a FROM (SELECT e.*, CAST(n_centers >= 2 AS INTEGER) AS s FROM elem e JOIN mult USING (frame, kind, ligand, site)) GROUP BY 1, 2) USING (frame, center_id)""",
    ["grid", "elem", "mult"],
    ["frac_polymer_bound", "frac_anion_bound", "frac_shared_chain", "frac_shared_chain_given_bound", "frac_shared_site", "frac_shared_site_given_bound", "frac_shared_anion", "frac_shared_anion_given_bound"],
)


def _components(s, d):
    return li.network_components(cp.cluster_table(v.components(s, d, True)), Z)


def _degrees(s, d):
    return li.degrees(v.edges(s, d), v.grid(s, d))


define("ncomp", f"SELECT frame, root, n_centers, n_anions, n_nodes, {Z} * n_centers - n_anions AS charge, is_multi_center FROM clusters", "clusters")
define(
    "deg",
    """SELECT frame, 'center' AS kind, center_id AS node_id, coalesce(k, 0) AS degree FROM grid LEFT JOIN (SELECT frame, center_id, count(*) AS k FROM edges GROUP BY 1, 2) USING (frame, center_id)
 UNION ALL SELECT frame, 'anion', anion_id, count(*) FROM edges GROUP BY 1, 3""", "grid", "edges",
)
register("network_components", _components, "SELECT * FROM ncomp", ["ncomp"])
register("network_degrees", _degrees, "SELECT * FROM deg", ["deg"])
register("degree_distribution", lambda s, d: li.degree_distribution(_degrees(s, d)),
         "SELECT kind, degree, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY kind) AS probability FROM deg GROUP BY 1, 2", ["deg"], ["probability"])
register("component_size_distribution", lambda s, d: li.component_size_distribution(_components(s, d)),
         "SELECT n_nodes, count(*) AS count, count(*) / sum(count(*)) OVER () AS number_probability, n_nodes * count(*) / sum(n_nodes * count(*)) OVER () AS ion_probability FROM ncomp WHERE is_multi_center = 1 GROUP BY 1", ["ncomp"], ["number_probability", "ion_probability"])
register("component_composition_distribution", lambda s, d: li.component_composition_distribution(_components(s, d)),
         "SELECT n_centers, n_anions, charge, count(*) AS count, count(*) / sum(count(*)) OVER () AS probability FROM ncomp WHERE is_multi_center = 1 GROUP BY 1, 2, 3", ["ncomp"], ["probability"])


def _network(s, d):
    return li.network_frame(_components(s, d), _degrees(s, d))


define(
    "nframe",
    """SELECT frame, n_centers, n_coordinated_anions, n_components, n_multi_components, ins / n_centers AS frac_centers_multi, mean_multi_size, ion_weighted_size, center_weighted_size, largest_centers, largest_nodes, largest_centers / n_centers AS largest_center_fraction,
 largest_nodes / nodes AS largest_node_fraction, CAST(largest_centers / n_centers >= 0.5 AS INTEGER) AS is_giant, mean_center_degree, mean_anion_degree, frac_bridging, frac_branching, frac_centers_degree3 FROM
 (SELECT frame, CAST(sum(n_centers) AS BIGINT) AS n_centers, count(*) AS n_components, count(*) FILTER (is_multi_center = 1) AS n_multi_components, coalesce(sum(n_centers) FILTER (is_multi_center = 1), 0) AS ins, avg(n_nodes) FILTER (is_multi_center = 1) AS mean_multi_size,
 sum(n_nodes * n_nodes) FILTER (is_multi_center = 1) / sum(n_nodes) FILTER (is_multi_center = 1) AS ion_weighted_size, sum(n_nodes * n_centers) FILTER (is_multi_center = 1) / sum(n_centers) FILTER (is_multi_center = 1) AS center_weighted_size,
 max(n_centers) AS largest_centers, max(n_nodes) AS largest_nodes, sum(n_nodes) AS nodes FROM ncomp GROUP BY 1)
 JOIN (SELECT frame, count(*) FILTER (kind = 'anion') AS n_coordinated_anions, avg(degree) FILTER (kind = 'center') AS mean_center_degree, avg(degree) FILTER (kind = 'anion') AS mean_anion_degree, avg(CAST(degree >= 2 AS INTEGER)) FILTER (kind = 'anion') AS frac_bridging,
 avg(CAST(degree >= 3 AS INTEGER)) FILTER (kind = 'anion') AS frac_branching, avg(CAST(degree >= 3 AS INTEGER)) FILTER (kind = 'center') AS frac_centers_degree3 FROM deg GROUP BY 1) USING (frame)""",
    "ncomp", "deg",
)
_NF = [*li.NETWORK_METRICS, "mean_multi_size"]
register("network_frame", _network, "SELECT * FROM nframe", ["nframe"], _NF)
register(
    "network_blocks", lambda s, d: li.network_blocks(_network(s, d), v.DT_PS, BLOCK_NS),
    f"SELECT {BLOCK} AS block, " + ", ".join(f"avg({m}) AS {m}" for m in li.NETWORK_METRICS) + ", avg(is_giant) AS giant_probability FROM nframe GROUP BY 1", ["nframe"], [*li.NETWORK_METRICS, "giant_probability"],
)
register(
    "network_overall", lambda s, d: li.network_overall(_network(s, d)),
    "SELECT count(*) AS n_frames, avg(is_giant) AS giant_probability, max(largest_center_fraction) AS largest_center_fraction_max, " + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in li.NETWORK_METRICS) + " FROM nframe",
    ["nframe"], ["giant_probability", "largest_center_fraction_max", *[f"{m}_{k}" for m in li.NETWORK_METRICS for k in ("mean", "std")]],
)
