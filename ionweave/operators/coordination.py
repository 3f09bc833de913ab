"""Wide coordination record per (frame, center) and its per-frame summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.functions.states import STATES, safe_ratio
from ionweave.operators import contacts as ct

KEY = ["frame", "center_id"]


SHARED = ("n_bridging_anions", "n_shared_chains", "n_local_chains", "n_remote_chains")


def shared_ligands(contacts: DataFrame, k: int = ct.LOCAL_SEPARATION) -> DataFrame:
    """Per coordinated (frame, center): coordination numbers, bridging anions, shared chains, local and remote chain partners."""
    lig = contacts.groupBy("frame", "center_id", "ligand_kind", "ligand_id").agg(F.count(F.lit(1)).alias("denticity"))
    size = lig.groupBy("frame", "ligand_kind", "ligand_id").agg(F.count(F.lit(1)).alias("__n"))
    bridges = ct.chain_bridges(contacts, k)
    local = (
        bridges.select(
            "frame", "chain_id", F.explode(F.array("center_a", "center_b")).alias("center_id")
        )
        .groupBy("frame", "chain_id", "center_id")
        .agg(F.count(F.lit(1)).alias("__local"))
        .select(
            "frame", F.lit(ct.POLYMER).alias("ligand_kind"), F.col("chain_id").alias("ligand_id"),
            "center_id", "__local",
        )
    )
    both = lig.join(size, ["frame", "ligand_kind", "ligand_id"]).join(
        local, ["frame", "ligand_kind", "ligand_id", "center_id"], "left"
    )
    many = F.col("__n") >= 2
    poly = F.col("ligand_kind") == ct.POLYMER
    near = F.coalesce("__local", F.lit(0))

    def number(test: Column) -> Column:
        return F.count(F.when(test, F.lit(1)))

    return both.groupBy(*KEY).agg(
        *ct.number_counts(),
        number(~poly & many).alias("n_bridging_anions"),
        number(poly & many).alias("n_shared_chains"),
        number(poly & (near > 0)).alias("n_local_chains"),
        number(poly & (F.col("__n") - 1 > near)).alias("n_remote_chains"),
    )


def master_table(
    contacts: DataFrame, grid: DataFrame, components: DataFrame, clusters: DataFrame,
    dt_ps: float, k: int = ct.LOCAL_SEPARATION,
) -> DataFrame:
    """One row per (frame, center): numbers, state, sharing flags and cluster membership.

    Every join is on (frame, center) or (frame, root).  The id lists of the record stay in
    row form (``contacts``, ``anion_members``, ``cluster_members``).
    """
    base = ct.with_state(ct.on_grid(shared_ligands(contacts, k), grid, SHARED))
    where = components.filter(F.col("kind") == "center").select(
        "frame", F.col("node_id").alias("center_id"), "root"
    )
    # The cluster meets the narrow membership, so the wide rows stay where their cell is.
    out = base.join(where.join(clusters, ["frame", "root"]), KEY)
    flag = lambda c: (F.col(c) > 0).cast("int")
    return out.select(
        "frame",
        (F.col("frame") * dt_ps).alias("time_ps"),
        "center_id", "n_site", "n_chain", "n_anion_site", "n_anion", "n_total", "state",
        flag("n_bridging_anions").alias("is_anion_bridged"), "n_bridging_anions",
        flag("n_shared_chains").alias("is_shared_chain"), "n_shared_chains",
        flag("n_local_chains").alias("is_local_bridged"), "n_local_chains",
        flag("n_remote_chains").alias("is_remote_shared"), "n_remote_chains",
        "cluster_id",
        F.col("n_centers").alias("cluster_n_centers"),
        F.col("n_anions").alias("cluster_n_anions"),
        F.col("n_nodes").alias("cluster_n_nodes"),
        "is_multi_center",
    )


def frame_summary(
    master: DataFrame, anions: DataFrame, chains: DataFrame, clusters: DataFrame,
    n_anions_total: Column, n_chains_total: Column,
) -> DataFrame:
    """Per-frame counts, fractions, mean numbers, bridging and cluster-size metrics.

    Ratios over zero are 0.0.  ``anions`` is ``anion_bridging``, ``chains`` is
    ``chain_occupancy``; the totals come from the topology.
    """
    one = lambda t: F.count(F.when(t, F.lit(1)))
    anion = F.col("is_anion_bridged") == 1
    local = F.col("is_local_bridged") == 1
    per_center = master.groupBy("frame", "time_ps").agg(
        F.count(F.lit(1)).alias("n_centers"),
        *[one(F.col("state") == s).alias(f"n_{s}") for s in STATES],
        F.avg("n_site").alias("mean_site_cn"),
        F.avg("n_chain").alias("mean_chain_cn"),
        F.avg("n_anion_site").alias("mean_anion_site_cn"),
        F.avg("n_anion").alias("mean_anion_cn"),
        F.avg("n_total").alias("mean_total_cn"),
        one(anion).alias("__bridged"),
        one(F.col("is_shared_chain") == 1).alias("__shared"),
        one(local).alias("__local"),
        one(F.col("is_remote_shared") == 1).alias("__remote"),
        one(anion | local).alias("__any"),
        one(anion & local).alias("__both"),
        one(local & ~anion).alias("__chain_only"),
        one(anion & ~local).alias("__anion_only"),
    )
    per_anion = anions.groupBy("frame").agg(
        F.count(F.lit(1)).alias("n_coordinated_anions"),
        F.sum("is_bridging").alias("n_bridging_anions"),
    )
    used = F.col("n_centers") > 0
    per_chain = chains.groupBy("frame").agg(
        one(used).alias("n_coordinating_chains"),
        F.sum("is_shared").alias("n_shared_chains"),
        F.sum("has_local_bridge").alias("n_local_chains"),
        F.sum("has_remote_pair").alias("n_remote_chains"),
        F.sum("n_centers").alias("__on_chains"),
        F.max("n_centers").alias("max_centers_on_chain"),
    )
    n = F.col("n_centers")
    per_cluster = clusters.filter(n > 0).groupBy("frame").agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.avg(n).alias("mean_cluster_number"),
        (F.sum(n * n) / F.sum(n)).alias("mean_cluster_weight"),
        F.max(n).alias("largest_cluster"),
        F.sum(F.when(n >= 2, n).otherwise(0)).alias("__multi"),
        one(n == 1).alias("__single"),
    )
    wide = (
        per_center.join(per_anion, "frame", "left")
        .join(per_chain, "frame", "left")
        .join(per_cluster, "frame", "left")
        .fillna(0)
    )
    c = F.col
    over_centers = lambda name: safe_ratio(c(name), c("n_centers"), 0.0)
    return wide.select(
        "frame", "time_ps", "n_centers",
        *[f"n_{s}" for s in STATES],
        *[over_centers(f"n_{s}").alias(f"frac_{s}") for s in STATES],
        "mean_site_cn", "mean_chain_cn", "mean_anion_site_cn", "mean_anion_cn", "mean_total_cn",
        "n_coordinated_anions", "n_bridging_anions",
        safe_ratio(c("n_bridging_anions"), c("n_coordinated_anions"), 0.0).alias("frac_coordinated_anions_bridging"),
        safe_ratio(c("n_bridging_anions"), n_anions_total, 0.0).alias("frac_all_anions_bridging"),
        over_centers("__bridged").alias("frac_centers_anion_bridged"),
        "n_coordinating_chains", "n_shared_chains", "n_local_chains", "n_remote_chains",
        safe_ratio(c("n_shared_chains"), c("n_coordinating_chains"), 0.0).alias("frac_coordinating_chains_shared"),
        safe_ratio(c("n_shared_chains"), n_chains_total, 0.0).alias("frac_all_chains_shared"),
        safe_ratio(c("n_local_chains"), c("n_coordinating_chains"), 0.0).alias("frac_coordinating_chains_local"),
        safe_ratio(c("n_local_chains"), n_chains_total, 0.0).alias("frac_all_chains_local"),
        over_centers("__shared").alias("frac_centers_shared_chain"),
        over_centers("__local").alias("frac_centers_local_bridged"),
        over_centers("__remote").alias("frac_centers_remote_shared"),
        safe_ratio(c("__on_chains"), c("n_coordinating_chains"), 0.0).alias("mean_centers_per_chain"),
        "max_centers_on_chain",
        over_centers("__any").alias("frac_centers_any_bridge"),
        over_centers("__both").alias("frac_centers_both_bridges"),
        over_centers("__chain_only").alias("frac_centers_chain_only"),
        over_centers("__anion_only").alias("frac_centers_anion_only"),
        "n_clusters", "mean_cluster_number", "mean_cluster_weight", "largest_cluster",
        over_centers("largest_cluster").alias("largest_cluster_fraction"),
        over_centers("__multi").alias("frac_centers_multi_cluster"),
        safe_ratio(c("__single"), c("n_clusters"), 0.0).alias("frac_single_clusters"),
    )
