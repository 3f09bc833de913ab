"""Coordination state and event classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State labels, class labels and class edges that results must reproduce.
STATES = ("P", "PT", "T", "F")
LIFETIME_CLASSES = (
    (50.0, "transient_10_50_ps"),
    (500.0, "short_50_500_ps"),
    (5000.0, "intermediate_0.5_5_ns"),
    (None, "persistent_gt_5_ns"),
)
SIZE_CLASSES = (
    (2, "pair_cluster"),
    (4, "small_3_4"),
    (8, "medium_5_8"),
    (16, "large_9_16"),
    (None, "network_gt_16"),
)
COUNT_CLASSES = ((1, "one_metal"), (2, "two_metals"), (None, "three_plus_metals"))
COORDINATION_CLASSES = (
    (0.0, "strictly_monodentate"),
    (0.25, "occasional_multioxygen"),
    (None, "multioxygen_enriched"),
)
FORMATION_CLASSES = ("first_formation_event", "reformation_event")


def classed(value: Column, table: tuple) -> Column:
    """Label of the first class whose inclusive upper edge holds ``value``."""
    out = F.when(value <= table[0][0], table[0][1])
    for edge, label in table[1:-1]:
        out = out.when(value <= edge, label)
    return out.otherwise(table[-1][1])


def lifetime_class(occupancy_ps: Column) -> Column:
    return classed(occupancy_ps, LIFETIME_CLASSES)


def size_class(n: Column) -> Column:
    return classed(n, SIZE_CLASSES)


def center_count_class(n: Column) -> Column:
    return classed(n, COUNT_CLASSES)


def coordination_class(multi_site_fraction: Column) -> Column:
    return classed(multi_site_fraction, COORDINATION_CLASSES)


def formation_class(reformation: Column) -> Column:
    return F.when(reformation == 1, FORMATION_CLASSES[1]).otherwise(FORMATION_CLASSES[0])


def coordination_state(n_polymer: Column, n_anion: Column) -> Column:
    """Polymer only, polymer and anion, anion only, or free."""
    return (
        F.when((n_polymer > 0) & (n_anion > 0), "PT")
        .when(n_polymer > 0, "P")
        .when(n_anion > 0, "T")
        .otherwise("F")
    )


def nan_to_null(c: Column) -> Column:
    """Missing readings are NULL inside the engine, never NaN."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """num/den, or ``empty`` where the denominator is zero or missing."""
    return F.when(den != 0, num / den).otherwise(F.lit(empty).cast("double"))
