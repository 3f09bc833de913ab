"""Input checks and validation reports as DataFrames of check rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.functions.geometry import is_orthorhombic
from ionweave.operators.ordered import ordinals


def topology_profile(topology: DataFrame, group: str) -> DataFrame:
    """Groups, rows and the min, max, mean and median rows per group."""
    sizes = topology.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    # The median buffer holds distinct group sizes only.
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("__n").alias("n_rows"),
        F.min("__n").alias("min_size"),
        F.max("__n").alias("max_size"),
        F.avg("__n").alias("mean_size"),
        F.median("__n").alias("median_size"),
    )


def reference_site_check(topology: DataFrame, group: str, is_reference: Column, is_site: Column) -> DataFrame:
    """Groups without exactly one reference site, or with only one of reference and sites."""
    n = topology.groupBy(group).agg(
        F.count(F.when(is_reference, 1)).alias("n_reference"),
        F.count(F.when(is_site, 1)).alias("n_sites"),
    )
    reason = (
        F.when((F.col("n_sites") > 0) & (F.col("n_reference") == 0), "sites without reference")
        .when((F.col("n_sites") == 0) & (F.col("n_reference") > 0), "reference without sites")
        .when(F.col("n_reference") > 1, "several references")
    )
    return n.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def box_check(frames: DataFrame, lengths: Sequence[str], angles: Sequence[str]) -> DataFrame:
    """Per frame: finite positive lengths, angles inside (0, 180), right-angled box."""
    ok_len = F.lit(True)
    for c in lengths:
        ok_len = ok_len & F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    ok_ang = F.lit(True)
    for c in angles:
        ok_ang = ok_ang & F.col(c).isNotNull() & (F.col(c) > 0) & (F.col(c) < 180)
    return frames.groupBy("frame").agg(
        F.bool_and(ok_len).cast("int").alias("lengths_ok"),
        F.bool_and(ok_ang).cast("int").alias("angles_ok"),
        F.bool_and(is_orthorhombic(*[F.col(c) for c in angles])).cast("int").alias("is_orthorhombic"),
    )


def grid_check(df: DataFrame, frame: str = "frame", center: str = "center_id") -> DataFrame:
    """Duplicate cells, missing cells and incomplete centers of a (frame, center) table.

    Missing cells follow from counts, so the full frames-by-centers product is never formed.
    """
    cells = df.groupBy(frame, center).agg(F.count(F.lit(1)).alias("__n"))
    per_center = cells.groupBy(center).agg(
        F.count(F.lit(1)).alias("__frames"),
        F.sum((F.col("__n") > 1).cast("long")).alias("__dup"),
    )
    n_frames = df.agg(F.count_distinct(frame).alias("n")).select("n").scalar()
    totals = per_center.agg(
        F.sum("__dup").alias("duplicate_cells"),
        (F.count(F.lit(1)) * n_frames - F.sum("__frames")).alias("missing_cells"),
        F.sum((F.col("__frames") < n_frames).cast("long")).alias("incomplete_centers"),
    )
    return check_rows(
        totals,
        {
            c: (F.col(c) == 0, F.col(c).cast("double"))
            for c in ("duplicate_cells", "missing_cells", "incomplete_centers")
        },
    )


def discard_initial_fraction(df: DataFrame, fraction: float, frame: str = "frame") -> DataFrame:
    """Drop the first floor(n * fraction) distinct frames."""
    if fraction <= 0:
        return df
    if fraction >= 1:
        raise ValueError("fraction must be below 1")
    ranked = ordinals(df.select(frame).distinct(), [], frame, "__o", total="__n")
    kept = ranked.filter(F.col("__o") >= F.floor(F.col("__n") * fraction)).select(frame)
    return df.join(kept, frame, "left_semi")


def check_rows(one_row: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(check, passed, value) rows from a one-row table."""
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("check"),
                F.coalesce(ok.cast("int"), F.lit(0)).alias("passed"),
                val.cast("double").alias("value"),
            )
            for n, (ok, val) in checks.items()
        ]
    )
    return one_row.select(F.explode(rows).alias("r")).select("r.check", "r.passed", "r.value")


def validation_table(
    df: DataFrame,
    checks: Mapping[str, tuple[Column, Column]],
    warnings: Sequence[str] = (),
) -> DataFrame:
    """Named aggregate checks over a table plus an overall ``status`` row.

    Each check is (aggregate boolean, aggregate value).  A failed check listed in
    ``warnings`` only downgrades the status.
    """
    aggs = []
    for n, (ok, val) in checks.items():
        aggs += [ok.alias(f"ok_{n}"), val.cast("double").alias(f"v_{n}")]
    one = df.agg(*aggs)
    rows = check_rows(one, {n: (F.col(f"ok_{n}"), F.col(f"v_{n}")) for n in checks})
    soft = F.col("check").isin(list(warnings)) if warnings else F.lit(False)
    overall = rows.agg(
        F.sum(((F.col("passed") == 0) & ~soft).cast("int")).alias("hard"),
        F.sum(((F.col("passed") == 0) & soft).cast("int")).alias("soft"),
    ).select(
        F.lit("status").alias("check"),
        (F.col("hard") == 0).cast("int").alias("passed"),
        (F.col("hard") + F.col("soft")).cast("double").alias("value"),
        F.when(F.col("hard") > 0, "FAILED")
        .when(F.col("soft") > 0, "PASSED_WITH_WARNINGS")
        .otherwise("PASSED")
        .alias("status"),
    )
    return rows.withColumn(
        "status", F.when(F.col("passed") == 1, "PASSED").when(soft, "WARNING").otherwise("FAILED")
    ).unionByName(overall)
