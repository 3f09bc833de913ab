"""Contact, state and bridge events: runs in time with censoring, transitions and exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions.states import STATES, safe_ratio
from ionweave.operators.ordered import neighbours, runs

CONTACT_TYPES = ("polymer_site", "polymer_chain", "anion_site", "anion_molecule")
TOLERATED_GAP = 2  # fixed value: frames an intermittent contact may be away
MIN_EVENTS = 5  # fixed value: curves of smaller groups are marked as unsupported


def contact_presence(contacts: DataFrame) -> DataFrame:
    """(contact_type, center_id, partner_id, site_index, frame) at site level and at ligand level.

    A partner is a ligand; ``site_index`` tells its sites apart and is -1 where the whole ligand is meant.
    """
    poly = F.col("ligand_kind") == "polymer"
    pair = F.array(
        F.struct(
            F.when(poly, CONTACT_TYPES[0]).otherwise(CONTACT_TYPES[2]).alias("contact_type"),
            F.col("ligand_id").alias("partner_id"), F.col("site_index").cast("bigint").alias("site_index"),
        ),
        F.struct(
            F.when(poly, CONTACT_TYPES[1]).otherwise(CONTACT_TYPES[3]).alias("contact_type"),
            F.col("ligand_id").alias("partner_id"), F.lit(-1).cast("bigint").alias("site_index"),
        ),
    )
    return (
        contacts.select("frame", "center_id", F.explode(pair).alias("p"))
        .select("p.contact_type", "center_id", "p.partner_id", "p.site_index", "frame")
        .distinct()
    )


def presence_runs(
    presence: DataFrame, keys: Sequence[str], tolerance: int, step: int = 1, chunk: int = 20_000
) -> DataFrame:
    """Runs of presence: same run while the frame difference is at most ``step*(tolerance+1)``."""
    numbered = runs(presence, keys, "frame", tolerance=tolerance, step=step, chunk=chunk)
    return numbered.groupBy(*keys, "run").agg(
        F.min("frame").alias("start_frame"),
        F.max("frame").alias("end_frame"),
        F.count(F.lit(1)).alias("n_present"),
    )


def _censor(events: DataFrame, first: Column, last: Column, dt_ps: float, step: int = 1) -> DataFrame:
    """Duration counts frames, tolerated gaps included; censored where a run touches an end."""
    left = (F.col("start_frame") == first).cast("int")
    right = (F.col("end_frame") == last).cast("int")
    frames = (F.col("end_frame") - F.col("start_frame")) / step + 1
    return events.withColumns(
        {
            "duration_ps": frames * F.lit(float(dt_ps)),
            "left_censored": left,
            "right_censored": right,
            "censored": F.greatest(left, right),
        }
    )


def contact_events(
    presence: DataFrame, keys: Sequence[str], first: Column, last: Column, dt_ps: float,
    tolerance: int = TOLERATED_GAP, step: int = 1,
) -> DataFrame:
    """Continuous and intermittent (gap-tolerant) events of every key."""
    out = None
    for rule, gap in (("continuous", 0), ("intermittent", tolerance)):
        part = presence_runs(presence, keys, gap, step).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return _censor(out, first, last, dt_ps, step)


def state_events(
    states: DataFrame, first: Column, last: Column, dt_ps: float, step: int = 1
) -> DataFrame:
    """Runs of one state per center; a missing frame also ends a run."""
    numbered = runs(states.select("center_id", "frame", "state"), ["center_id"], "frame", step=step, value=["state"])
    ev = numbered.groupBy("center_id", "run", "state").agg(
        F.min("frame").alias("start_frame"),
        F.max("frame").alias("end_frame"),
        F.count(F.lit(1)).alias("n_present"),
    )
    return _censor(ev, first, last, dt_ps, step)


def state_transitions(states: DataFrame, step: int = 1) -> DataFrame:
    """4x4 counts between consecutive frames, with P(to|from) and P(to|from, change)."""
    nxt = neighbours(
        states.select("center_id", "frame", "state"), ["center_id"], "frame", {"next": step}, ["state"]
    ).filter(F.col("next").isNotNull())
    seen = nxt.groupBy(F.col("state").alias("from_state"), F.col("next.state").alias("to_state")).agg(
        F.count(F.lit(1)).alias("count")
    )
    every = F.array(*[F.struct(F.lit(a).alias("f"), F.lit(b).alias("t")) for a in STATES for b in STATES])
    cells = states.sparkSession.range(1).select(F.explode(every).alias("c")).select(
        F.col("c.f").alias("from_state"), F.col("c.t").alias("to_state")
    )
    full = cells.join(seen, ["from_state", "to_state"], "left").fillna(0, ["count"])
    w = Window.partitionBy("from_state")
    moved = F.when(F.col("from_state") != F.col("to_state"), F.col("count")).otherwise(F.lit(0))
    return full.select(
        "from_state", "to_state", "count",
        safe_ratio(F.col("count"), F.sum("count").over(w), 0.0).alias("p_all"),
        safe_ratio(moved, F.sum(moved).over(w), 0.0).alias("p_change"),
    )


def ligand_exchange(
    presence: DataFrame, grid: DataFrame, first: Column, last: Column, step: int = 1,
    types: Sequence[str] = CONTACT_TYPES,
) -> DataFrame:
    """Gained, lost and retained partners per (center, step, contact type).

    Each contact votes once as "now" at its frame and once as "before" at the next frame;
    the set algebra is then plain grouped sums, however many partners a center has.
    """
    members = exchange_members(presence, step)
    flags = members.groupBy("contact_type", "center_id", "frame").agg(
        F.sum("was").alias("n_previous"),
        F.sum("now").alias("n_current"),
        F.sum(F.col("now") * (1 - F.col("was"))).alias("n_gained"),
        F.sum(F.col("was") * (1 - F.col("now"))).alias("n_lost"),
        F.sum(F.col("was") * F.col("now")).alias("n_retained"),
    )
    names = ["n_previous", "n_current", "n_gained", "n_lost", "n_retained"]
    cells = grid.filter((F.col("frame") > first) & (F.col("frame") <= last)).select(
        "frame", "center_id", F.explode(F.array(*map(F.lit, types))).alias("contact_type")
    )
    return (
        cells.join(flags, ["contact_type", "center_id", "frame"], "left")
        .fillna(0, names)
        .withColumns({n: F.col(n).cast("long") for n in names})
        .withColumn("occurred", ((F.col("n_gained") + F.col("n_lost")) > 0).cast("int"))
    )


def exchange_members(presence: DataFrame, step: int = 1) -> DataFrame:
    """Partner rows behind ``ligand_exchange``: ``was``/``now`` flags per (center, frame, partner)."""
    roles = F.array(
        F.struct(F.col("frame").alias("f"), F.lit(1).alias("now"), F.lit(0).alias("was")),
        F.struct((F.col("frame") + step).alias("f"), F.lit(0).alias("now"), F.lit(1).alias("was")),
    )
    partner = [c for c in presence.columns if c not in ("contact_type", "center_id", "frame")]
    return (
        presence.select("contact_type", "center_id", *partner, F.explode(roles).alias("r"))
        .groupBy("contact_type", "center_id", F.col("r.f").alias("frame"), *partner)
        .agg(F.max("r.was").alias("was"), F.max("r.now").alias("now"))
    )


def exchange_block_summary(exchange: DataFrame, blocks: DataFrame, dt_ps: float) -> DataFrame:
    per_frame = exchange.groupBy("contact_type", "frame").agg(
        F.count(F.lit(1)).alias("n"), F.sum("occurred").alias("x"),
        F.sum("n_gained").alias("g"), F.sum("n_lost").alias("l"),
    )
    out = per_frame.join(blocks, "frame").groupBy("contact_type", "block").agg(
        F.sum("n").alias("n_observations"), F.sum("x").alias("n_exchange_steps"),
        F.sum("g").alias("total_gained"), F.sum("l").alias("total_lost"),
    )
    n = F.col("n_observations")
    return out.withColumns(
        {
            "mean_gained": F.col("total_gained") / n,
            "mean_lost": F.col("total_lost") / n,
            "exchange_probability": F.col("n_exchange_steps") / n,
            "exchange_per_center_ns": F.col("n_exchange_steps") / (n * dt_ps / 1000.0),
        }
    )


def exchange_summary(block_summary: DataFrame) -> DataFrame:
    return block_summary.groupBy("contact_type").agg(
        F.avg("exchange_probability").alias("mean_exchange_probability"),
        F.stddev_samp("exchange_probability").alias("block_std_exchange_probability"),
        F.avg("exchange_per_center_ns").alias("mean_exchange_per_center_ns"),
        F.stddev_samp("exchange_per_center_ns").alias("block_std_exchange_per_center_ns"),
        (F.stddev_samp("exchange_per_center_ns") / F.sqrt(F.count_distinct("block"))).alias(
            "block_sem_exchange_per_center_ns"
        ),
        F.avg("mean_gained").alias("mean_gained"),
        F.avg("mean_lost").alias("mean_lost"),
        F.count_distinct("block").alias("n_blocks"),
    )


def lifetime_summary(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, censored share and durations.  Durations are whole frames, so the exact
    median's buffer holds at most one entry per frame count."""
    free = F.col("censored") == 0
    d = F.col("duration_ps")
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count(F.when(free, 1)).alias("n_uncensored"),
        F.avg("censored").alias("fraction_censored"),
        F.avg(d).alias("mean_all_ps"),
        F.median(d).alias("median_all_ps"),
        F.avg(F.when(free, d)).alias("mean_uncensored_ps"),
        F.median(F.when(free, d)).alias("median_uncensored_ps"),
        F.max(d).alias("max_ps"),
    )


def lifetime_block_means(events: DataFrame, blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Uncensored mean and median duration per group and block of the start frame."""
    inside = events.filter(F.col("censored") == 0).join(
        blocks.withColumnRenamed("frame", "start_frame"), "start_frame"
    )
    return inside.groupBy(*by, "block").agg(
        F.avg("duration_ps").alias("mean_lifetime_ps"),
        F.median("duration_ps").alias("median_lifetime_ps"),
        F.count(F.lit(1)).alias("n_events"),
    )


def lifetime_block_summary(means: DataFrame, by: Sequence[str]) -> DataFrame:
    m = F.col("mean_lifetime_ps")
    return means.groupBy(*by).agg(
        F.avg(m).alias("mean_of_block_means_ps"),
        F.stddev_samp(m).alias("block_std_ps"),
        (F.stddev_samp(m) / F.sqrt(F.count(m))).alias("block_sem_ps"),
        F.count(m).alias("n_blocks"),
        F.sum("n_events").alias("n_uncensored"),
    )


def survival_curve(
    events: DataFrame, by: Sequence[str], *, time: str = "duration_ps", origin: bool = True, support: int | None = None
) -> DataFrame:
    """Product-limit survival per group.

    Events collapse to one row per (group, duration) before any window, so the windows hold
    at most one row per distinct duration.  With ``support``, ``is_supported`` marks groups of at
    least that many events.
    """
    by = list(by)
    d = events.filter(F.col(time) > 0).groupBy(*by, F.col(time).alias("time_ps")).agg(
        F.count(F.when(F.col("right_censored") == 0, 1)).alias("n_terminated"),
        F.count(F.when(F.col("right_censored") == 1, 1)).alias("n_censored"),
    )
    part = Window.partitionBy(*by)
    later = part.orderBy("time_ps").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = part.orderBy("time_ps").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.col("n_terminated") + F.col("n_censored")
    t = d.withColumns({"n_at_risk": F.sum(n).over(later), "__all": F.sum(n).over(part)})
    if support is not None:
        t = t.withColumn("is_supported", (F.col("__all") >= support).cast("int"))
    curve = t.withColumn("survival", F.product(1.0 - F.col("n_terminated") / F.col("n_at_risk")).over(upto))
    flag = [] if support is None else ["is_supported"]
    cols = [*by, "time_ps", "survival", "n_at_risk", "n_terminated", "n_censored", *flag]
    if origin:
        zero = t.select(*by, F.col("__all").alias("n_at_risk"), *flag).distinct().select(
            *by, *flag, F.lit(0.0).alias("time_ps"), F.lit(1.0).alias("survival"), "n_at_risk",
            F.lit(0).cast("long").alias("n_terminated"), F.lit(0).cast("long").alias("n_censored"),
        )
        return zero.select(*cols).unionByName(curve.select(*cols))
    return curve.select(*cols)


def kaplan_meier(events: DataFrame, by: Sequence[str], min_events: int = MIN_EVENTS) -> DataFrame:
    """Survival from t=0 of every group; ``is_supported`` marks those with at least ``min_events`` events."""
    return survival_curve(events, by, origin=True, support=min_events)


