"""Distributions and block summaries of the coordination tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions.states import STATES
from ionweave.operators.blocks import melt, probability, with_share

NUMBER_METRICS = ("n_site", "n_chain", "n_anion_site", "n_anion", "n_total")


def state_block_fractions(states: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fraction of each state per block; an absent state is 0."""
    # Collapse to (frame, state) counts before joining the block map.
    counts = states.groupBy("frame", "state").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.join(blocks, "frame").groupBy("block").agg(
        F.sum("n").alias("__all"),
        *[F.sum(F.when(F.col("state") == s, F.col("n")).otherwise(0)).alias(s) for s in STATES],
    )
    return sums.select("block", *[(F.col(s) / F.col("__all")).alias(f"frac_{s}") for s in STATES])


def state_summary(fractions: DataFrame) -> DataFrame:
    """Mean, sample std and SEM over blocks per state."""
    long = melt(fractions, ["block"], {s: F.col(f"frac_{s}") for s in STATES})
    return long.groupBy(F.col("metric").alias("state")).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"),
        F.count("value").alias("n_blocks"),
    )


def coordination_distribution(numbers: DataFrame, metrics: Sequence[str] = NUMBER_METRICS) -> DataFrame:
    return probability(melt(numbers, [], metrics), ["value"], ["metric"])


def joint_coordination(numbers: DataFrame) -> DataFrame:
    return probability(numbers, ["n_site", "n_anion"])


def anion_denticity_distribution(ligands: DataFrame) -> DataFrame:
    return probability(ligands.filter(F.col("ligand_kind") == "anion"), ["denticity"])


def site_separation_distribution(occupancy: DataFrame) -> DataFrame:
    """Closest separations of chains that hold at least one pair."""
    return probability(occupancy.filter(F.col("n_pairs") >= 1), ["min_separation"])


def cluster_size_distribution(clusters: DataFrame) -> DataFrame:
    """Number share and center-weighted share per cluster size."""
    counts = with_share(
        clusters.filter(F.col("n_centers") > 0).groupBy("n_centers").agg(F.count(F.lit(1)).alias("count")),
        [], "count", "probability",
    ).withColumn("weight", F.col("count") * F.col("n_centers"))
    return with_share(counts, [], "weight", "center_fraction")


def combine_systems(tables: dict[str, DataFrame], order: Sequence[str] = ()) -> DataFrame:
    """Stack one table per system with a ``system`` label and a display rank.

    Systems named in ``order`` come first in that order, the rest follow alphabetically.
    """
    names = [n for n in order if n in tables] + sorted(n for n in tables if n not in order)
    out = None
    for rank, name in enumerate(names):
        part = tables[name].withColumns(
            {"system": F.lit(name), "system_rank": F.lit(rank).cast("long")}
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def rank_systems(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Display rank for a table that already holds a ``system`` column."""
    listed = F.array_position(F.array(*map(F.lit, order)), F.col("system"))
    names = df.select("system").distinct()
    w = Window.orderBy(
        F.when(listed > 0, listed).otherwise(F.lit(len(order) + 1)), F.col("system")
    )
    return df.join(
        names.withColumn("system_rank", (F.row_number().over(w) - 1).cast("long")), "system"
    )
