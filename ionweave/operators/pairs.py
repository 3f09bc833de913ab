"""Bound pairs: event numbering, per-frame and per-event summaries, lifetimes and survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.functions.states import safe_ratio
from ionweave.operators.blocks import probability
from ionweave.operators.events import survival_curve
from ionweave.operators.ordered import neighbours, ordinals, runs
from ionweave.sources.checks import check_rows

OUTLIER_DISTANCE = 1.8  # fixed value
EVENT_CLASSES = (  # fixed values, in report order
    "all_events",
    "completed_events",
    "left_censored_events",
    "right_censored_events",
    "fully_censored_events",
    "first_formation_events",
    "reformation_events",
)


def frame_pairs(contacts: DataFrame) -> DataFrame:
    """Anion contacts collapsed to (frame, center, anion) with site count and distances."""
    return contacts.filter(F.col("ligand_kind") == "anion").groupBy(
        "frame", "center_id", F.col("ligand_id").alias("anion_id")
    ).agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.min("distance").alias("min_distance"),
        F.avg("distance").alias("mean_distance"),
    )


def pair_events(pairs: DataFrame, frames: DataFrame, dt_ps: float, stride: int = 1) -> DataFrame:
    """Adds event number, instance id, age and start to every pair row.

    An event continues while the pair is present in the previous *processed* frame, so runs
    are taken over frame ordinals.
    """
    order = ordinals(frames.select("frame").distinct(), [], "frame", "ordinal")
    numbered = runs(pairs.join(order, "frame"), ["center_id", "anion_id"], "ordinal")
    pair = F.format_string("M%d_T%d", "center_id", "anion_id")
    age = F.col("ordinal") - F.col("run_start") + 1
    return numbered.select(
        *pairs.columns,
        "ordinal",
        pair.alias("pair_id"),
        F.format_string("%s_E%04d", pair, F.col("run")).alias("instance_id"),
        F.col("run").alias("event_number"),
        age.alias("age_frames"),
        ((age - 1) * F.lit(dt_ps * stride)).alias("age_ps"),
        (F.col("frame") - (age - 1) * stride).alias("start_frame"),
        (age > 1).cast("int").alias("continuing"),
        (age == 1).cast("int").alias("new_event"),
    )


def pair_rows(events: DataFrame, centers: DataFrame, anions: DataFrame) -> DataFrame:
    """Pair events with the reference positions of both partners and the box.

    ``centers``: frame, center_id, cx, cy, cz, box; ``anions``: frame, anion_id, ax, ay, az.
    """
    return events.join(centers, ["frame", "center_id"]).join(anions, ["frame", "anion_id"])


def frame_pair_summary(
    events: DataFrame, frames: DataFrame, n_centers: Column, n_anions: Column
) -> DataFrame:
    """Per-frame pair population; frames without pairs are kept.

    Pairs that ended are last frame's pairs minus the pairs that continue.
    """
    per_center = events.groupBy("frame", "center_id").agg(F.count(F.lit(1)).alias("__p"))
    centers = per_center.groupBy("frame").agg(
        F.count(F.lit(1)).alias("n_coordinated_centers"), F.max("__p").alias("max_pairs_per_center")
    )
    anions = events.select("frame", "anion_id").distinct().groupBy("frame").agg(
        F.count(F.lit(1)).alias("n_coordinated_anions")
    )
    base = events.groupBy("frame").agg(
        F.sum("n_sites").alias("n_contacts"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("n_sites").alias("__sites"),
        F.max("n_sites").alias("max_sites_per_pair"),
        F.avg("min_distance").alias("mean_min_distance"),
        F.sum("continuing").alias("n_continuing"),
        F.sum("new_event").alias("n_new"),
    )
    counts = [
        "n_contacts", "n_pairs", "n_coordinated_centers", "n_coordinated_anions",
        "max_pairs_per_center", "max_sites_per_pair", "n_continuing", "n_new",
    ]
    wide = (
        frames.select("frame").distinct()
        .join(base, "frame", "left").join(centers, "frame", "left").join(anions, "frame", "left")
        .fillna(0, counts)
    )
    wide = neighbours(ordinals(wide, [], "frame", "ordinal"), [], "ordinal", {"before": -1}, ["n_pairs"])
    c = F.col
    return wide.select(
        "frame", "n_contacts", "n_pairs", "n_coordinated_centers",
        safe_ratio(c("n_coordinated_centers"), n_centers).alias("frac_coordinated_centers"),
        "n_coordinated_anions",
        safe_ratio(c("n_coordinated_anions"), n_anions).alias("frac_coordinated_anions"),
        safe_ratio(c("n_pairs"), n_centers).alias("mean_pairs_per_center"),
        safe_ratio(c("n_pairs"), c("n_coordinated_centers"), 0.0).alias("mean_pairs_per_coordinated_center"),
        "max_pairs_per_center",
        F.coalesce("__sites", F.lit(0.0)).alias("mean_sites_per_pair"),
        "max_sites_per_pair", "mean_min_distance", "n_continuing", "n_new",
        (F.coalesce(c("before.n_pairs"), F.lit(0)) - c("n_continuing")).alias("n_ended"),
    )


def pair_event_summary(
    events: DataFrame, first: Column, last: Column, dt_ps: float, stride: int = 1
) -> DataFrame:
    """One row per event: span, occupancy, censoring, distances and site statistics."""
    multi = (F.col("n_sites") >= 2).cast("int")
    e = events.groupBy("instance_id", "pair_id", "center_id", "anion_id").agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.count(F.lit(1)).alias("n_frames"),
        F.avg("min_distance").alias("mean_min_distance"),
        F.min("min_distance").alias("min_distance"),
        F.max("min_distance").alias("max_min_distance"),
        F.avg("mean_distance").alias("mean_distance"),
        F.avg("n_sites").alias("mean_sites"),
        F.max("n_sites").alias("max_sites"),
        F.sum(multi).alias("n_multi_site_frames"),
        F.avg(multi).alias("frac_multi_site"),
        F.min("age_frames").alias("first_age"),
        F.max("age_frames").alias("last_age"),
        F.sum("new_event").alias("n_new_flags"),
        F.sum("continuing").alias("n_continuing_flags"),
    )
    number = F.regexp_extract("instance_id", r"_E(\d+)$", 1).cast("bigint")
    left = (F.col("first_frame") == first).cast("int")
    right = (F.col("last_frame") == last).cast("int")
    expected = ((F.col("last_frame") - F.col("first_frame")) / stride + 1).cast("bigint")
    return e.withColumns(
        {
            "event_number": number,
            "reformation": (number > 1).cast("int"),
            "expected_frames": expected,
            "is_continuous": (F.col("n_frames") == expected).cast("int"),
            "span_ps": (F.col("last_frame") - F.col("first_frame")) * F.lit(float(dt_ps)),
            "occupancy_ps": F.col("n_frames") * F.lit(float(dt_ps * stride)),
            "left_censored": left,
            "right_censored": right,
            "fully_censored": left * right,
            "completed": (1 - left) * (1 - right),
        }
    )


def distance_histogram(pairs: DataFrame, cutoff: float, bins: int = 200) -> DataFrame:
    """Equal bins on [0, cutoff]; density over in-range rows; empty bins kept, last bin closed.

    ``n_below`` and ``n_above`` count the rows outside, in every row.
    """
    width = cutoff / bins
    d = F.col("min_distance")
    counted = pairs.filter((d >= 0) & (d <= cutoff)).groupBy(
        F.least(F.floor(d / width), F.lit(bins - 1)).cast("bigint").alias("bin")
    ).agg(F.count(F.lit(1)).alias("count"))
    full = pairs.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left")
    inside = F.count(F.when((d >= 0) & (d <= cutoff), 1))
    ends = pairs.agg(F.struct(inside.alias("n"), F.count(F.when(d < 0, 1)).alias("low"), F.count(F.when(d > cutoff, 1)).alias("high")).alias("e"))
    ends = ends.select("e").scalar()
    total = ends["n"]
    count = F.coalesce("count", F.lit(0))
    return full.select(
        "bin", ((F.col("bin") + 0.5) * width).alias("center"), count.alias("count"),
        (count / (total * width)).alias("density"), ends["low"].alias("n_below"), ends["high"].alias("n_above"),
    )


def site_multiplicity(pairs: DataFrame) -> DataFrame:
    return probability(pairs, ["n_sites"])


def distance_outliers(pairs: DataFrame, threshold: float = OUTLIER_DISTANCE) -> DataFrame:
    return pairs.filter(F.col("min_distance") < threshold)


def pair_identity_summary(events: DataFrame, n_frames: Column) -> DataFrame:
    """Per pair: event and censor counts, occupied share, lifetimes, row-weighted means."""
    w = F.col("n_frames")
    done = F.when(F.col("completed") == 1, F.col("occupancy_ps"))
    return events.groupBy("pair_id", "center_id", "anion_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum("reformation").alias("n_reformations"),
        F.sum("completed").alias("n_completed"),
        F.sum("left_censored").alias("n_left_censored"),
        F.sum("right_censored").alias("n_right_censored"),
        F.sum("fully_censored").alias("n_fully_censored"),
        F.min("first_frame").alias("first_frame"),
        F.max("last_frame").alias("last_frame"),
        F.sum(w).alias("total_frames"),
        (F.sum(w) / n_frames).alias("occupancy_fraction"),
        F.max("occupancy_ps").alias("max_occupancy_ps"),
        F.avg(done).alias("mean_completed_ps"),
        F.median(done).alias("median_completed_ps"),
        (F.sum(F.col("mean_min_distance") * w) / F.sum(w)).alias("mean_min_distance"),
        F.min("min_distance").alias("min_distance"),
        (F.sum(F.col("mean_sites") * w) / F.sum(w)).alias("mean_sites"),
        (F.sum("n_multi_site_frames") / F.sum(w)).alias("frac_multi_site"),
    )


def pair_lifetime_summary(events: DataFrame) -> DataFrame:
    """Occupancy statistics of the seven event classes; an empty class keeps a row of NULLs.

    Occupancies are whole frames, so the exact percentiles buffer one entry per frame count.
    """
    tests = {
        "all_events": F.lit(True),
        "completed_events": F.col("completed") == 1,
        "left_censored_events": F.col("left_censored") == 1,
        "right_censored_events": F.col("right_censored") == 1,
        "fully_censored_events": F.col("fully_censored") == 1,
        "first_formation_events": F.col("reformation") == 0,
        "reformation_events": F.col("reformation") == 1,
    }
    member = F.array_compact(F.array(*[F.when(tests[c], F.lit(c)) for c in EVENT_CLASSES]))
    t = F.col("occupancy_ps")
    stats = events.select(F.explode(member).alias("event_class"), "occupancy_ps").groupBy("event_class").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg(t).alias("mean_ps"),
        F.median(t).alias("median_ps"),
        F.stddev_samp(t).alias("std_ps"),
        F.min(t).alias("min_ps"),
        *[F.percentile(t, p / 100.0).alias(f"p{p}_ps") for p in (25, 75, 90, 95)],
        F.max(t).alias("max_ps"),
    )
    every = events.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, EVENT_CLASSES))).alias("event_class")
    )
    return every.join(stats, "event_class", "left").fillna(0, ["n_events"])


def pair_survival(events: DataFrame) -> DataFrame:
    """Product-limit survival over events that are not left-censored; no row at time zero."""
    return survival_curve(events.filter(F.col("left_censored") == 0), [], time="occupancy_ps", origin=False)


def median_survival(curve: DataFrame) -> DataFrame:
    """First time at which survival is at most one half."""
    return curve.agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time_ps"))).alias("median_survival_ps"))


def stage_reconciliation(
    pairs: DataFrame, events: DataFrame, identities: DataFrame, frame_rows: DataFrame, curve: DataFrame
) -> DataFrame:
    """Row, event and frame totals agree between stages; survival is bounded and never rises."""
    n = F.count(F.lit(1))
    one = pairs.agg(n.alias("rows"), F.sum("new_event").alias("new_flags"), F.sum("n_sites").alias("contacts"))

    def total(df: DataFrame, **aggs: Column) -> dict[str, Column]:
        row = df.agg(F.struct(*[v.alias(k) for k, v in aggs.items()]).alias("s")).select("s").scalar()
        return {k: row[k] for k in aggs}

    one = one.withColumns(
        total(events, events=n, event_rows=F.sum("n_frames"), continuous=F.min("is_continuous"), flags=F.max("n_new_flags"))
        | total(identities, id_events=F.sum("n_events"), id_rows=F.sum("total_frames"))
        | total(frame_rows, frame_pairs=F.sum("n_pairs"), frame_new=F.sum("n_new"), frame_contacts=F.sum("n_contacts"))
        | total(curve, s_min=F.min("survival"), s_max=F.max("survival"))
    )
    c = F.col
    diff = lambda a, b: (c(a) == c(b), (c(a) - c(b)).cast("double"))
    return check_rows(
        one,
        {
            "event_rows": diff("rows", "event_rows"),
            "identity_rows": diff("rows", "id_rows"),
            "identity_events": diff("events", "id_events"),
            "frame_pairs": diff("rows", "frame_pairs"),
            "frame_new_events": diff("events", "frame_new"),
            "frame_contacts": diff("contacts", "frame_contacts"),
            "one_new_flag_per_event": (c("flags") == 1, c("flags").cast("double")),
            "events_are_continuous": (c("continuous") == 1, c("continuous").cast("double")),
            "survival_bounded": ((c("s_min") >= 0) & (c("s_max") <= 1), c("s_min")),
        },
    )
