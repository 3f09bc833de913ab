"""Denticity, ligand sharing and network topology tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.functions.states import safe_ratio
from ionweave.operators.blocks import probability, time_block, with_share
from ionweave.operators.contacts import POLYMER, ligand_contacts
from ionweave.sources.checks import check_rows

MAX_DENTICITY = 4  # fixed value: larger denticities are reported by the check
GIANT_SHARE = 0.5  # fixed value: a component with this share of the centers counts as giant


# --- denticity ------------------------------------------------------------------------------


def denticity_contacts(contacts: DataFrame) -> DataFrame:
    return ligand_contacts(contacts).filter(F.col("denticity") > 0).select(
        "frame", "center_id", "ligand_kind", "ligand_id", "denticity"
    )


def denticity_check(denticity: DataFrame, numbers: DataFrame, limit: int = MAX_DENTICITY) -> DataFrame:
    """Site numbers rebuilt from denticities against the stored ones, and unusually high denticities."""
    poly = F.col("ligand_kind") == POLYMER
    rebuilt = denticity.groupBy("frame", "center_id").agg(
        F.coalesce(F.sum(F.when(poly, F.col("denticity"))), F.lit(0)).alias("__p"),
        F.coalesce(F.sum(F.when(~poly, F.col("denticity"))), F.lit(0)).alias("__a"),
        F.max("denticity").alias("__max"),
    )
    zero = F.lit(0)
    one = numbers.join(rebuilt, ["frame", "center_id"], "left").agg(
        F.sum((F.col("n_site") != F.coalesce("__p", zero)).cast("bigint")).alias("bad_sites"),
        F.sum((F.col("n_anion_site") != F.coalesce("__a", zero)).cast("bigint")).alias("bad_anion_sites"),
        F.sum((F.coalesce("__max", zero) > limit).cast("bigint")).alias("high_denticity"),
        F.count(F.lit(1)).alias("rows"),
    )
    c = F.col
    return check_rows(
        one,
        {n: (c(n) == 0, c(n)) for n in ("bad_sites", "bad_anion_sites", "high_denticity")} | {"rows": (c("rows") > 0, c("rows"))},
    )


def denticity_text_check(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Texts of denticities per ligand that are no JSON object of whole numbers, and denticities below one, per kind.

    ``columns`` maps a kind to its text column. A blank or NULL text is an empty object; a value that is no whole
    number makes its text a bad one. Bad texts don't add to the denticities. No rows give counts of 0.
    """
    counts = {}
    for kind, column in columns.items():
        text = F.trim(F.coalesce(F.col(column), F.lit("")))
        values = F.map_values(F.from_json(F.when(text != "", text), "map<string,string>"))
        whole = F.transform(values, lambda v: v.try_cast("int"))
        bad = (text != "") & (values.isNull() | F.exists(whole, lambda v: v.isNull()))
        low = F.when(~bad & values.isNotNull(), F.size(F.filter(whole, lambda v: v <= 0))).otherwise(0)
        counts |= {f"bad_text_{kind}": F.sum(bad.cast("bigint")), f"nonpositive_{kind}": F.sum(low.cast("bigint"))}
    one = rows.agg(*[F.coalesce(v, F.lit(0).cast("bigint")).alias(n) for n, v in counts.items()])
    return check_rows(one, {n: (F.col(n) == 0, F.col(n)) for n in counts})


def _kind_counts(denticity: DataFrame, block_of: Column) -> DataFrame:
    """Counts per (kind, block, denticity): a few hundred rows that every table below shares."""
    return denticity.groupBy(F.col("ligand_kind").alias("kind"), block_of.alias("block"), "denticity").agg(
        F.count(F.lit(1)).alias("count")
    )


def denticity_counts(denticity: DataFrame, dt_ps: float, block_ns: float) -> DataFrame:
    return _kind_counts(denticity, time_block(F.col("frame") * dt_ps, block_ns))


def denticity_block_distribution(counts: DataFrame) -> DataFrame:
    """Dense 1..max rows per kind and block, zero counts included."""
    top = counts.groupBy("kind").agg(F.max("denticity").alias("__top"))
    cells = counts.select("kind", "block").distinct().join(top, "kind").select(
        "kind", "block", F.explode(F.sequence(F.lit(1).cast("bigint"), "__top")).alias("denticity")
    )
    full = cells.join(counts, ["kind", "block", "denticity"], "left").fillna(0, ["count"])
    return with_share(full, ["kind", "block"], "count", "probability")


def denticity_distribution(counts: DataFrame) -> DataFrame:
    """Counts and probabilities over all frames with block mean, std and SEM."""
    blocks = denticity_block_distribution(counts)
    out = blocks.groupBy("kind", "denticity").agg(
        F.sum("count").alias("count"), F.avg("probability").alias("block_mean"),
        F.stddev_samp("probability").alias("block_std"),
        (F.stddev_samp("probability") / F.sqrt(F.count(F.lit(1)))).alias("block_sem"),
    )
    return with_share(out, ["kind"], "count", "probability")


def denticity_block_summary(counts: DataFrame) -> DataFrame:
    d, n = F.col("denticity"), F.col("count")
    return counts.groupBy("kind", "block").agg(
        F.sum(n).alias("n_contacts"), (F.sum(d * n) / F.sum(n)).alias("mean_denticity"),
        (F.sum(F.when(d >= 2, n).otherwise(0)) / F.sum(n)).alias("frac_multi"),
        (F.sum(F.when(d >= 3, n).otherwise(0)) / F.sum(n)).alias("frac_three"),
    )


def denticity_summary(counts: DataFrame) -> DataFrame:
    d, n = F.col("denticity"), F.col("count")
    whole = counts.groupBy("kind").agg(
        F.sum(n).alias("n_contacts"), (F.sum(d * n) / F.sum(n)).alias("mean_denticity"),
        (F.sum(F.when(d == 1, n).otherwise(0)) / F.sum(n)).alias("frac_mono"),
        (F.sum(F.when(d >= 2, n).otherwise(0)) / F.sum(n)).alias("frac_multi"),
        (F.sum(F.when(d >= 3, n).otherwise(0)) / F.sum(n)).alias("frac_three"),
        F.min(d).alias("min_denticity"), F.max(d).alias("max_denticity"),
    )
    root = F.sqrt(F.count(F.lit(1)))
    spread = denticity_block_summary(counts).groupBy("kind").agg(
        F.stddev_samp("mean_denticity").alias("std_mean_denticity"), (F.stddev_samp("mean_denticity") / root).alias("sem_mean_denticity"),
        F.stddev_samp("frac_multi").alias("std_frac_multi"), (F.stddev_samp("frac_multi") / root).alias("sem_frac_multi"),
        (F.stddev_samp("frac_three") / root).alias("sem_frac_three"), F.count(F.lit(1)).alias("n_blocks"),
    )
    return whole.join(spread, "kind")


def denticity_frame_summary(denticity: DataFrame, numbers: DataFrame, dt_ps: float, block_ns: float) -> DataFrame:
    """Per block: means over coordinated center-frames, with the mean of the largest denticity."""
    poly = F.col("ligand_kind") == POLYMER
    top = denticity.groupBy("frame", "center_id").agg(
        F.max(F.when(poly, F.col("denticity"))).alias("__p"), F.max(F.when(~poly, F.col("denticity"))).alias("__a")
    )
    p, a = F.col("n_chain") > 0, F.col("n_anion") > 0
    given = lambda t, c: F.avg(F.when(t, F.col(c)))
    return numbers.join(top, ["frame", "center_id"], "left").groupBy(
        time_block(F.col("frame") * dt_ps, block_ns).alias("block")
    ).agg(
        F.count(F.lit(1)).alias("n_center_frames"), F.count(F.when(p, 1)).alias("n_polymer_frames"), F.count(F.when(a, 1)).alias("n_anion_frames"),
        given(p, "n_site").alias("mean_sites_bound"), given(p, "n_chain").alias("mean_chains_bound"), given(p, "__p").alias("mean_max_chain_denticity"),
        given(a, "n_anion_site").alias("mean_anion_sites_bound"), given(a, "n_anion").alias("mean_anions_bound"), given(a, "__a").alias("mean_max_anion_denticity"),
    )


# --- sharing --------------------------------------------------------------------------------


def _elements(contacts: DataFrame) -> DataFrame:
    """(frame, kind, element, center): chains, chain sites and anions as shareable elements."""
    poly = F.col("ligand_kind") == POLYMER
    site = F.struct(F.lit("chain_site").alias("kind"), F.col("ligand_id").alias("ligand"), F.col("site_index").alias("site"))
    whole = F.struct(
        F.when(poly, "chain").otherwise("anion").alias("kind"), F.col("ligand_id").alias("ligand"), F.lit(-1).cast("bigint").alias("site")
    )
    return contacts.select(
        "frame", "center_id", F.explode(F.when(poly, F.array(site, whole)).otherwise(F.array(whole))).alias("e")
    ).select("frame", "e.kind", "e.ligand", "e.site", "center_id").distinct()


ELEMENT = ["frame", "kind", "ligand", "site"]


def ligand_multiplicity(contacts: DataFrame) -> DataFrame:
    """Distinct centers per coordinated chain, chain site and anion of every frame."""
    return _elements(contacts).groupBy(*ELEMENT).agg(F.count(F.lit(1)).alias("n_centers"))


def multiplicity_distribution(multiplicity: DataFrame) -> DataFrame:
    return probability(multiplicity, ["n_centers"], ["kind"])


def ligand_sharing_summary(multiplicity: DataFrame) -> DataFrame:
    n = F.col("n_centers")
    many = F.sum(F.when(n >= 2, n).otherwise(0))
    rows = F.count(F.lit(1))
    return multiplicity.groupBy("kind").agg(
        rows.alias("n_ligand_frames"), F.count(F.when(n == 1, 1)).alias("n_single"), F.count(F.when(n >= 2, 1)).alias("n_multi"),
        (F.count(F.when(n == 1, 1)) / rows).alias("frac_single"), (F.count(F.when(n >= 2, 1)) / rows).alias("frac_multi"),
        F.avg(n).alias("mean_centers"), F.max(n).alias("max_centers"), F.sum(n).alias("n_contacts"),
        many.alias("n_shared_contacts"), (many / F.sum(n)).alias("frac_shared_contacts"),
    )


def ligand_sharing_blocks(multiplicity: DataFrame, dt_ps: float, block_ns: float) -> DataFrame:
    n = F.col("n_centers")
    return multiplicity.groupBy("kind", time_block(F.col("frame") * dt_ps, block_ns).alias("block")).agg(
        F.count(F.lit(1)).alias("n_ligand_frames"), (F.count(F.when(n >= 2, 1)) / F.count(F.lit(1))).alias("frac_multi"), F.avg(n).alias("mean_centers")
    )


def center_sharing_summary(contacts: DataFrame, grid: DataFrame) -> DataFrame:
    """Share of center-frames bound to, and in shared, chains, sites and anions."""
    e = _elements(contacts)
    many = e.groupBy(*ELEMENT).agg((F.count(F.lit(1)) >= 2).cast("int").alias("__s"))
    shared = lambda k: F.max(F.when(F.col("kind") == k, F.col("__s")))
    flags = e.join(many, ELEMENT).groupBy("frame", "center_id").agg(
        shared("chain").alias("__c"), shared("chain_site").alias("__o"), shared("anion").alias("__a")
    )
    full = grid.select("frame", "center_id").join(flags, ["frame", "center_id"], "left")
    zero = F.lit(0)
    return full.agg(
        F.count_distinct("frame").alias("n_frames"), F.count(F.lit(1)).alias("n_center_frames"),
        F.avg(F.col("__c").isNotNull().cast("int")).alias("frac_polymer_bound"), F.avg(F.col("__a").isNotNull().cast("int")).alias("frac_anion_bound"),
        F.avg(F.coalesce("__c", zero)).alias("frac_shared_chain"), F.avg("__c").alias("frac_shared_chain_given_bound"),
        F.avg(F.coalesce("__o", zero)).alias("frac_shared_site"), F.avg("__o").alias("frac_shared_site_given_bound"),
        F.avg(F.coalesce("__a", zero)).alias("frac_shared_anion"), F.avg("__a").alias("frac_shared_anion_given_bound"),
    )


# --- topology -------------------------------------------------------------------------------


def degrees(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """(frame, kind, node_id, degree); uncoordinated centers have degree 0."""
    anions = edges.groupBy("frame", F.col("anion_id").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    centers = grid.select("frame", "center_id").join(
        edges.groupBy("frame", "center_id").agg(F.count(F.lit(1)).alias("degree")), ["frame", "center_id"], "left"
    ).fillna(0, ["degree"])
    return centers.select("frame", F.lit("center").alias("kind"), F.col("center_id").alias("node_id"), "degree").unionByName(
        anions.select("frame", F.lit("anion").alias("kind"), "node_id", "degree")
    )


def network_components(clusters: DataFrame, center_charge: int) -> DataFrame:
    """One row per component, single centers included, with charge and the multi-center flag."""
    return clusters.select(
        "frame", "root", "n_centers", "n_anions", "n_nodes",
        (center_charge * F.col("n_centers") - F.col("n_anions")).alias("charge"), "is_multi_center",
    )


def component_size_distribution(components: DataFrame) -> DataFrame:
    sizes = components.filter("is_multi_center = 1").groupBy("n_nodes").agg(F.count(F.lit(1)).alias("count"))
    shared = with_share(sizes, [], "count", "number_probability").withColumn("__w", F.col("count") * F.col("n_nodes"))
    return with_share(shared, [], "__w", "ion_probability").drop("__w")


def component_composition_distribution(components: DataFrame) -> DataFrame:
    return probability(components.filter("is_multi_center = 1"), ["n_centers", "n_anions", "charge"])


def degree_distribution(degree_rows: DataFrame) -> DataFrame:
    return probability(degree_rows, ["degree"], ["kind"])


NETWORK_METRICS = (
    "frac_centers_multi", "ion_weighted_size", "center_weighted_size", "largest_center_fraction", "largest_node_fraction",
    "mean_center_degree", "mean_anion_degree", "frac_bridging", "frac_branching", "frac_centers_degree3",
)


def network_frame(components: DataFrame, degree_rows: DataFrame, giant_share: float = GIANT_SHARE) -> DataFrame:
    """Per-frame topology over all centers; aggregate means are NULL without an aggregate."""
    nm, n = F.col("n_centers"), F.col("n_nodes")
    multi = F.col("is_multi_center") == 1
    big = lambda c: F.when(multi, c)
    comp = components.groupBy("frame").agg(
        F.sum(nm).alias("n_centers"), F.count(F.lit(1)).alias("n_components"), F.count(F.when(multi, 1)).alias("n_multi_components"),
        F.coalesce(F.sum(big(nm)), F.lit(0)).alias("__in"), F.avg(big(n)).alias("mean_multi_size"),
        (F.sum(big(n * n)) / F.sum(big(n))).alias("ion_weighted_size"), (F.sum(big(n * nm)) / F.sum(big(nm))).alias("center_weighted_size"),
        F.max(nm).alias("largest_centers"), F.max(n).alias("largest_nodes"), F.sum(n).alias("__nodes"),
    )
    c, a, k = F.col("kind") == "center", F.col("kind") == "anion", F.col("degree")
    deg = degree_rows.groupBy("frame").agg(
        F.count(F.when(a, 1)).alias("n_coordinated_anions"), F.avg(F.when(c, k)).alias("mean_center_degree"), F.avg(F.when(a, k)).alias("mean_anion_degree"),
        F.avg(F.when(a, (k >= 2).cast("int"))).alias("frac_bridging"), F.avg(F.when(a, (k >= 3).cast("int"))).alias("frac_branching"),
        F.avg(F.when(c, (k >= 3).cast("int"))).alias("frac_centers_degree3"),
    )
    share = safe_ratio(F.col("largest_centers"), F.col("n_centers"))
    return comp.join(deg, "frame").select(
        "frame", "n_centers", "n_coordinated_anions", "n_components", "n_multi_components",
        safe_ratio(F.col("__in"), F.col("n_centers")).alias("frac_centers_multi"), "mean_multi_size", "ion_weighted_size", "center_weighted_size",
        "largest_centers", "largest_nodes", share.alias("largest_center_fraction"), safe_ratio(F.col("largest_nodes"), F.col("__nodes")).alias("largest_node_fraction"),
        (share >= giant_share).cast("int").alias("is_giant"), "mean_center_degree", "mean_anion_degree", "frac_bridging", "frac_branching", "frac_centers_degree3",
    )


def network_blocks(frames: DataFrame, dt_ps: float, block_ns: float, metrics: Sequence[str] = NETWORK_METRICS) -> DataFrame:
    return frames.groupBy(time_block(F.col("frame") * dt_ps, block_ns).alias("block")).agg(
        *[F.avg(m).alias(m) for m in metrics], F.avg("is_giant").alias("giant_probability")
    )


def network_overall(frames: DataFrame, metrics: Sequence[str] = NETWORK_METRICS) -> DataFrame:
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return frames.agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg("is_giant").alias("giant_probability"),
        F.max("largest_center_fraction").alias("largest_center_fraction_max"), *aggs,
    )
