"""Joint motion of bound bodies inside their events: lag sums, curves, bootstrap intervals.

Lag sums are additive, so every curve is a ratio of grouped sums.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.functions.geometry import Vector, vector
from ionweave.functions.states import coordination_class, formation_class, lifetime_class, safe_ratio
from ionweave.operators.mobility import unwrap_bodies
from ionweave.operators.ordered import lag_pairs

EPSILON = 1.0e-10  # fixed value: shorter displacements have no direction
MIN_EVENTS, MIN_ORIGINS = 20, 200  # fixed values
#: Cumulative Poisson(1) probabilities until the rest is below what a 32-bit uniform number resolves.
POISSON_EDGES = tuple(sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(13))

PAIR_SUMS = ("sum_c2", "sum_a2", "sum_rel2", "sum_mid2", "sum_com2", "sum_dot", "sum_cos", "n_cos")


def event_classes(events: DataFrame) -> DataFrame:
    """Lifetime, formation and coordination class of every pair event."""
    return events.withColumns(
        {
            "lifetime_class": lifetime_class(F.col("occupancy_ps")),
            "formation_class": formation_class(F.col("reformation")),
            "coordination_class": coordination_class(F.col("frac_multi_site")),
        }
    )


def class_counts(events: DataFrame, column: str) -> DataFrame:
    """Events, completed events, frames and occupancy per class (occupancies are whole frames)."""
    return events.groupBy(column).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum("completed").alias("n_completed"),
        F.sum("n_frames").alias("n_frames"),
        F.median("occupancy_ps").alias("median_occupancy_ps"),
        F.max("occupancy_ps").alias("max_occupancy_ps"),
    )


def _moves(bodies: Sequence[str]) -> dict[str, Vector]:
    return {
        b: vector(*[f"end_{b}{a}" for a in "xyz"]).minus(vector(*[f"{b}{a}" for a in "xyz"])) for b in bodies
    }


def _cosine(a: Vector, b: Vector) -> Column:
    size = a.norm() * b.norm()
    return F.when(size > EPSILON**2, a.dot(b) / size)


def body_pairs(rows: DataFrame, event: Sequence[str], order: str, bodies: Sequence[str], lags: Sequence[int]) -> DataFrame:
    cols = [f"{b}{a}" for b in bodies for a in "xyz"]
    return lag_pairs(rows, event, order, lags, cols, cols)


def event_lag_sums(
    rows: DataFrame, lags: Sequence[int], center_mass: float, anion_mass: float, *, rule: str = "mean",
    event: str = "instance_id", order: str = "ordinal",
) -> DataFrame:
    """Per event and lag: sums of squared displacements, dot products and cosines."""
    walk = unwrap_pairs(rows, event, order, rule)
    pairs = body_pairs(walk, [event], order, ("uc", "ua"), lags)
    m = _moves(("uc", "ua"))
    c, a = m["uc"], m["ua"]
    com = c.scaled(center_mass).plus(a.scaled(anion_mass)).scaled(1.0 / (center_mass + anion_mass))
    cos = _cosine(c, a)
    return pairs.groupBy(event, "lag").agg(
        F.count(F.lit(1)).alias("n_origins"),
        F.sum(c.norm2()).alias("sum_c2"),
        F.sum(a.norm2()).alias("sum_a2"),
        F.sum(c.minus(a).norm2()).alias("sum_rel2"),
        F.sum(c.plus(a).scaled(0.5).norm2()).alias("sum_mid2"),
        F.sum(com.norm2()).alias("sum_com2"),
        F.sum(c.dot(a)).alias("sum_dot"),
        F.coalesce(F.sum(cos), F.lit(0.0)).alias("sum_cos"),
        F.count(cos).alias("n_cos"),
    )


def unwrap_pairs(rows: DataFrame, event: str = "instance_id", order: str = "ordinal", rule: str = "mean") -> DataFrame:
    """Both partners unwrapped inside their event: ``uc*``, ``ua*`` and step lengths."""
    return unwrap_bodies(rows, [event], order, {"uc": ("cx", "cy", "cz"), "ua": ("ax", "ay", "az")}, rule=rule)


def event_path_summary(
    walk: DataFrame, center_mass: float, anion_mass: float, event: str = "instance_id", order: str = "ordinal"
) -> DataFrame:
    """Path lengths, net displacements, net cosine and largest steps per event."""
    cols = [f"u{b}{a}" for b in "ca" for a in "xyz"]
    e = walk.groupBy(event).agg(
        F.count(F.lit(1)).alias("n_frames"),
        (F.count(F.lit(1)) == F.max(order) - F.min(order) + 1).cast("int").alias("is_continuous"),
        F.coalesce(F.sum("ucstep"), F.lit(0.0)).alias("center_path"),
        F.coalesce(F.sum("uastep"), F.lit(0.0)).alias("anion_path"),
        F.coalesce(F.max("ucstep"), F.lit(0.0)).alias("center_max_step"),
        F.coalesce(F.max("uastep"), F.lit(0.0)).alias("anion_max_step"),
        F.min_by(F.struct(*cols), order).alias("s"),
        F.max_by(F.struct(*cols), order).alias("t"),
    )
    net = {b: Vector(*[F.col(f"t.u{b}{a}") - F.col(f"s.u{b}{a}") for a in "xyz"]) for b in "ca"}
    com = net["c"].scaled(center_mass).plus(net["a"].scaled(anion_mass)).scaled(1.0 / (center_mass + anion_mass))
    return e.select(
        event, "n_frames", "is_continuous", "center_path", "anion_path", "center_max_step", "anion_max_step",
        net["c"].norm().alias("net_center"), net["a"].norm().alias("net_anion"),
        net["c"].minus(net["a"]).norm().alias("net_relative"), com.norm().alias("net_com"),
        net["c"].dot(net["a"]).alias("net_dot"), _cosine(net["c"], net["a"]).alias("net_cosine"),
    )


def pair_metrics() -> dict[str, Column]:
    """Metric name -> expression over summed pair columns."""
    c = F.col
    n = c("n_origins")
    mc, ma, rel, dot = (c(k) / n for k in ("sum_c2", "sum_a2", "sum_rel2", "sum_dot"))
    both = mc + ma
    return {
        "center_msd": mc,
        "anion_msd": ma,
        "relative_msd": rel,
        "midpoint_msd": c("sum_mid2") / n,
        "com_msd": c("sum_com2") / n,
        "mean_dot": dot,
        "vector_correlation": safe_ratio(dot, F.sqrt(F.greatest(mc * ma, F.lit(0.0)))),
        "alignment": safe_ratio(2.0 * dot, both),
        "relative_ratio": safe_ratio(rel, both),
        "mean_cosine": safe_ratio(c("sum_cos"), c("n_cos")),
    }


def support_flag(n_events: Column, n_origins: Column, min_events: int = MIN_EVENTS, min_origins: int = MIN_ORIGINS) -> Column:
    return ((n_events >= min_events) & (n_origins >= min_origins)).cast("int")


def scoped(lag_sums: DataFrame, groups: Mapping[str, str | None]) -> DataFrame:
    """Copy each event-lag row to its scopes and groups.

    ``groups`` maps a group type to its class column (None = everything in one group).
    """
    labels = F.array(
        *[
            F.struct(
                F.lit(kind).alias("group_type"),
                (F.lit("all") if col is None else F.col(col)).alias("group_label"),
            )
            for kind, col in groups.items()
        ]
    )
    scopes = F.when(F.col("completed") == 1, F.array(F.lit("all_observed"), F.lit("completed_only"))).otherwise(
        F.array(F.lit("all_observed"))
    )
    return (
        lag_sums.withColumn("scope", F.explode(scopes))
        .withColumn("__g", F.explode(labels))
        .withColumns({"group_type": F.col("__g.group_type"), "group_label": F.col("__g.group_label")})
        .drop("__g")
    )


CURVE_KEY = ["scope", "group_type", "group_label", "lag"]


def ratio_curves(
    lag_sums: DataFrame, groups: Mapping[str, str | None], sums: Sequence[str], metrics: Mapping[str, Column],
    min_events: int = MIN_EVENTS, min_origins: int = MIN_ORIGINS,
) -> DataFrame:
    """Ratio-of-sums metrics by scope, group and lag with a support flag."""
    out = scoped(lag_sums, groups).groupBy(*CURVE_KEY).agg(
        F.count(F.lit(1)).alias("n_events"), *[F.sum(s).alias(s) for s in ("n_origins", *sums)]
    )
    return out.select(
        *CURVE_KEY, "n_events", "n_origins", *[m.alias(n) for n, m in metrics.items()],
        support_flag(F.col("n_events"), F.col("n_origins"), min_events, min_origins).alias("is_supported"),
    )


def comotion_curves(lag_sums: DataFrame, min_events: int = MIN_EVENTS, min_origins: int = MIN_ORIGINS) -> DataFrame:
    groups = {
        "all": None, "lifetime": "lifetime_class", "formation": "formation_class", "coordination": "coordination_class",
    }
    return ratio_curves(lag_sums, groups, PAIR_SUMS, pair_metrics(), min_events, min_origins)


def poisson_weight(uniform: Column) -> Column:
    """Poisson(1) count for a uniform number in [0, 1)."""
    return sum(((uniform >= e).cast("int") for e in POISSON_EDGES), F.lit(0))


def event_weights(event: Column, replicates: int, seed: int) -> Column:
    """One Poisson(1) count per replicate, drawn from hashes of (seed, replicate, event); one digest serves four replicates."""

    def quarters(q: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), q.cast("string"), event.cast("string")))
        words = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("double") for k in range(4)]
        return F.array(*[word / 4294967296.0 for word in words])

    uniform = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1)), quarters))
    return F.transform(F.slice(uniform, 1, replicates), lambda u: poisson_weight(u).cast("tinyint"))


#: Numbers of partial sums that a task holds before it puts them out.
PARTIAL = 1 << 23


def _weighted_partials(classes: Sequence[str], sums: Sequence[str], replicates: int):
    """Arrow function: rows (classes, cells, weights) to weighted sums per classes and lag, one array of replicates per sum."""
    room = max(1, PARTIAL // (replicates * len(sums)))

    def batch_of(held: dict, types: list) -> pa.RecordBatch:
        keys, values = list(held), list(held.values())
        columns = [pa.array([k[i] for k in keys], type=t) for i, t in enumerate(types)]
        columns += [pa.array([k[-1] for k in keys], type=pa.int64()), pa.array([n for n, _ in values], type=pa.int64())]
        columns += [pa.array([list(block[:, i]) for _, block in values], type=pa.list_(pa.float64())) for i in range(len(sums))]
        return pa.RecordBatch.from_arrays(columns, names=[*classes, "lag", "n_events", *sums])

    def work(batches):
        held, types = {}, []
        for batch in batches:
            types = [batch.schema.field(c).type for c in classes]
            owners = list(zip(*[batch.column(c).to_pylist() for c in classes]))
            numbers = {k: i for i, k in enumerate(dict.fromkeys(owners))}
            label = list(numbers)
            weights = batch.column("weights").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, replicates)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("cells")).to_numpy(zero_copy_only=False))
            lag, *values = [f.to_numpy(zero_copy_only=False) for f in batch.column("cells").flatten().flatten()]
            table = np.column_stack([v.astype(np.float64) for v in values])
            code = np.array([numbers[o] for o in owners], dtype=np.int64)[row]
            found, place = np.unique(np.column_stack([code, lag]), axis=0, return_inverse=True)
            order = np.argsort(place.ravel(), kind="stable")
            ends = np.searchsorted(place.ravel()[order], np.arange(len(found) + 1))
            for k, (owner, at) in enumerate(found):
                members = order[ends[k]:ends[k + 1]]
                key = (*label[owner], int(at))
                n, block = held.get(key, (0, 0.0))
                for i in range(0, len(members), 1024):
                    some = members[i:i + 1024]
                    block = block + weights[row[some]].astype(np.float64).T @ table[some]
                held[key] = (n + len(members), block)
                if len(held) >= room:
                    yield batch_of(held, types)
                    held = {}
        if held:
            yield batch_of(held, types)

    return work


def bootstrap_ci(
    lag_sums: DataFrame, groups: Mapping[str, str | None], sums: Sequence[str], metrics: Mapping[str, Column],
    event: str, replicates: int, seed: int = 0, level: float = 0.95,
) -> DataFrame:
    """Event-level bootstrap percentile interval of each metric; fewer than two events give NULLs.

    A replicate weights every event by a Poisson(1) count drawn from a hash of (seed, replicate, event), so results
    do not depend on partitioning. The lags of an event come together and its weights are drawn once, as an array; each
    task multiplies weights and sums as matrices, one block per class and lag. No event row is copied: scopes, groups and
    replicates become rows after that. NULL sums count as 0; no rows give no rows.
    """
    every = ("n_origins", *sums)
    classes = list(dict.fromkeys(["completed", *[c for c in groups.values() if c is not None]]))
    cell = F.struct(F.col("lag").cast("bigint").alias("lag"), *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in every])
    events = lag_sums.groupBy(event, *classes).agg(F.collect_list(cell).alias("cells"))
    drawn = events.select(*classes, "cells", event_weights(F.col(event), replicates, seed).alias("weights"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in drawn.schema if f.name in classes)
    schema = f"{kept}, lag bigint, n_events bigint, " + ", ".join(f"`{s}` array<double>" for s in every)
    partial = drawn.mapInArrow(_weighted_partials(classes, every, replicates), schema)
    spread = scoped(partial, groups).select(*CURVE_KEY, "n_events", F.posexplode(F.arrays_zip(*every)).alias("replicate", "__s"))
    weighted = spread.groupBy(*CURVE_KEY, "replicate").agg(
        F.sum("n_events").alias("n_events"), *[F.sum(f"__s.{s}").alias(s) for s in every]
    )
    ok = F.col("n_origins") > 0
    values = weighted.select(
        *CURVE_KEY, "n_events", *[F.when(ok & (F.col("n_events") >= 2), m).alias(n) for n, m in metrics.items()]
    )
    low, high = (1.0 - level) / 2.0, (1.0 + level) / 2.0
    aggs = []
    for n in metrics:
        aggs += [F.percentile(n, low).alias(f"{n}_low"), F.percentile(n, high).alias(f"{n}_high")]
    return values.groupBy(*CURVE_KEY).agg(F.max("n_events").alias("n_events"), *aggs)


def key_lag_lookup(curves: DataFrame, targets_ns: Sequence[float], dt_ps: float) -> DataFrame:
    """The supported all-observed lag nearest to each target; the shorter one on ties."""
    rows = curves.filter(
        (F.col("scope") == "all_observed") & (F.col("group_type") == "all") & (F.col("is_supported") == 1)
    ).withColumn("target_ns", F.explode(F.array(*[F.lit(float(t)) for t in targets_ns])))
    far = F.abs(F.col("lag") * dt_ps / 1000.0 - F.col("target_ns"))
    kept = [c for c in curves.columns if c not in ("scope", "group_type", "group_label", "is_supported")]
    return rows.groupBy("target_ns").agg(F.min_by(F.struct(*kept), F.struct(far, F.col("lag"))).alias("r")).select(
        "target_ns", "r.*"
    )
