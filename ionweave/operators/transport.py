"""Collective displacement correlations, charge transport and fit-window selection.

Only ``collective_correlations`` touches entity-level data; everything after it works on one
row per lag or per fit window (at most a few hundred rows).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions.geometry import Vector
from ionweave.functions.states import safe_ratio
from ionweave.operators.mobility import displacements
from ionweave.operators.ordered import lag_pairs

SPECIES = ("metal", "cation", "anion")
CROSS = (("metal", "cation"), ("metal", "anion"), ("cation", "anion"))

# Physical constants, charge scale, fit windows and acceptance limits.
ELEMENTARY_CHARGE_C = 1.602176634e-19
BOLTZMANN_J_K = 1.380649e-23
CHARGE_SCALE = 0.8
MIN_FIT_POINTS = 6  # fixed value: fits of fewer points are marked as unsupported
FIT_WINDOWS_NS = ((5.0, 20.0), (10.0, 30.0), (20.0, 50.0), (30.0, 60.0), (40.0, 80.0), (50.0, 100.0))
SLIDING_LENGTHS_NS = (10.0, 15.0, 20.0, 30.0)
SLIDING_STEP_NS = 5.0
CUMULATIVE_STARTS_NS = (2.0, 5.0, 10.0, 20.0)
CUMULATIVE_STEP_NS = 5.0
BETA_RANGE = (0.90, 1.10)
R2_MIN = 0.98
NEIGHBOUR_CV_MAX, NEIGHBOURS_MIN = 0.25, 3
BLOCK_CV_MAX, BLOCKS_MIN, BLOCK_DIFFERENCE_MAX = 0.75, 3, 0.35
SELF_RATIO_RANGE = (0.70, 1.30)


def collective_correlations(
    positions: DataFrame, lags: Sequence[int], *, stride: int = 1, by: Sequence[str] = (), ordinal: str = "frame"
) -> DataFrame:
    """C_ab = <dR_a . dR_b>, self and distinct parts per lag.

    Species totals per frame are summed before any lag join, so the cross terms work on
    frame-sized data.
    """
    by = list(by)
    totals = positions.groupBy(*by, ordinal).agg(
        *[
            F.struct(
                *[F.coalesce(F.sum(F.when(F.col("species") == s, F.col(f"u{c}"))), F.lit(0.0)).alias(c) for c in "xyz"]
            ).alias(s)
            for s in SPECIES
        ]
    )
    pairs = lag_pairs(totals, by, ordinal, lags, SPECIES, SPECIES, stride=stride)
    move = {s: Vector(*[F.col(f"end_{s}")[c] - F.col(s)[c] for c in "xyz"]) for s in SPECIES}
    cross = pairs.groupBy(*by, "lag").agg(
        *[F.avg(move[s].norm2()).alias(f"C_{s}_{s}") for s in SPECIES],
        *[F.avg(move[a].dot(move[b])).alias(f"C_{a}_{b}") for a, b in CROSS],
        F.count(F.lit(1)).alias("n_origins"),
    )
    own = displacements(positions, [*by, "entity_id"], ordinal, lags, ["species"], stride).groupBy(*by, "lag").agg(
        *[F.sum(F.when(F.col("species") == s, F.col("r2"))).alias(f"__{s}") for s in SPECIES]
    )
    out = cross.join(own, [*by, "lag"])
    selfs = {f"self_{s}": F.coalesce(F.col(f"__{s}"), F.lit(0.0)) / F.col("n_origins") for s in SPECIES}
    out = out.withColumns(selfs)
    return out.withColumns(
        {f"distinct_{s}": F.col(f"C_{s}_{s}") - F.col(f"self_{s}") for s in SPECIES}
    ).drop(*[f"__{s}" for s in SPECIES])


def charge_msd(table: DataFrame, charges: Mapping[str, float], scale: float = CHARGE_SCALE) -> DataFrame:
    """Charge-weighted displacement: total, self and correlation part, and the scaled-charge form."""
    total = sum((charges[s] ** 2 * F.col(f"C_{s}_{s}") for s in SPECIES), F.lit(0.0)) + sum(
        (2.0 * charges[a] * charges[b] * F.col(f"C_{a}_{b}") for a, b in CROSS), F.lit(0.0)
    )
    own = sum((charges[s] ** 2 * F.col(f"self_{s}") for s in SPECIES), F.lit(0.0))
    return table.withColumns({"charge_msd": total, "charge_msd_self": own}).withColumns(
        {
            "charge_msd_correlation": F.col("charge_msd") - F.col("charge_msd_self"),
            "charge_msd_scaled": F.col("charge_msd") * scale**2,
            "charge_msd_self_scaled": F.col("charge_msd_self") * scale**2,
        }
    )


def conductivity(slope: Column, volume: Column | float, temperature_k: float) -> Column:
    """mS/cm from a charge-displacement slope in e2 A2/ps and a volume in A3."""
    si = slope * (ELEMENTARY_CHARGE_C**2 * 1.0e-20 / 1.0e-12)
    return si / (6.0 * volume * 1.0e-30 * BOLTZMANN_J_K * temperature_k) * 10.0


def _fit(x: Column, y: Column) -> tuple[Column, Column, Column, Column, Column]:
    n = F.count(y)
    ok = n >= 2
    lx, ly = F.when((x > 0) & (y > 0), F.log(x)), F.when((x > 0) & (y > 0), F.log(y))
    return (
        F.when(ok, F.regr_slope(y, x)),
        F.when(ok, F.regr_intercept(y, x)),
        F.when(ok & (F.regr_syy(y, x) > 0), F.regr_r2(y, x)),
        F.when(F.count(ly) >= 2, F.regr_slope(ly, lx)),
        n,
    )


def _in_windows(table: DataFrame, windows: Sequence[tuple[float, float]], dt_ps: float) -> DataFrame:
    """Copy every lag row to the fit windows that hold it."""
    ns = F.col("lag") * dt_ps / 1000.0
    listed = F.array(*[F.struct(F.lit(a).alias("fit_start_ns"), F.lit(b).alias("fit_end_ns")) for a, b in windows])
    inside = F.filter(listed, lambda w: (w["fit_start_ns"] <= ns) & (ns <= w["fit_end_ns"]))
    return table.withColumns({"x_ps": F.col("lag") * dt_ps, "__w": F.explode(inside)}).withColumns(
        {"fit_start_ns": F.col("__w.fit_start_ns"), "fit_end_ns": F.col("__w.fit_end_ns")}
    ).drop("__w")


def window_fit(
    table: DataFrame, column: str, windows: Sequence[tuple[float, float]], dt_ps: float, by: Sequence[str] = ()
) -> DataFrame:
    """Least squares and log-log exponent per window; fewer than six points give NULLs."""
    slope, intercept, r2, beta, n = _fit(F.col("x_ps"), F.col(column))
    return _in_windows(table, windows, dt_ps).groupBy(*by, "fit_start_ns", "fit_end_ns").agg(
        slope.alias("slope"), intercept.alias("intercept"), r2.alias("r2"), beta.alias("beta"), n.alias("n_points"), (n >= MIN_FIT_POINTS).cast("int").alias("is_supported")
    )


def observables(charges: Mapping[str, float]) -> dict[str, tuple[str, float]]:
    """Name -> (column, charge prefactor) of the fitted observables."""
    out = {
        "total": ("charge_msd", 1.0),
        "self_total": ("charge_msd_self", 1.0),
        "correlation_total": ("charge_msd_correlation", 1.0),
    }
    for s in SPECIES:
        z2 = charges[s] ** 2
        out |= {f"{s}_{s}": (f"C_{s}_{s}", z2), f"{s}_self": (f"self_{s}", z2), f"{s}_distinct": (f"distinct_{s}", z2)}
    for a, b in CROSS:
        out[f"{a}_{b}_cross"] = (f"C_{a}_{b}", 2.0 * charges[a] * charges[b])
    return out


def window_scan(
    table: DataFrame, windows: Sequence[tuple[float, float]], charges: Mapping[str, float], dt_ps: float,
    volume: Column | float, temperature_k: float, by: Sequence[str] = (), scale: float = CHARGE_SCALE,
) -> DataFrame:
    """Conductivity of every observable per fit window, with both closure errors."""
    x = F.col("x_ps")
    specs = observables(charges)
    slopes = {n: _fit(x, F.col(c))[0] * f for n, (c, f) in specs.items()}
    _, _, r2, beta, n_points = _fit(x, F.col("charge_msd"))
    if isinstance(volume, Column):
        table = table.withColumn("__v", volume)
        size: Column | float = F.first("__v")
    else:
        size = volume
    fits = _in_windows(table, windows, dt_ps).groupBy(*by, "fit_start_ns", "fit_end_ns").agg(
        n_points.alias("n_points"), beta.alias("beta"), r2.alias("r2"),
        *[conductivity(slope, size, temperature_k).alias(f"sigma_{n}") for n, slope in slopes.items()],
    )
    s = lambda n: F.col(f"sigma_{n}")
    crosses = sum((s(f"{a}_{b}_cross") for a, b in CROSS), F.lit(0.0))
    by_species = sum((s(f"{p}_{p}") for p in SPECIES), F.lit(0.0)) + crosses
    by_part = sum((s(f"{p}_self") + s(f"{p}_distinct") for p in SPECIES), F.lit(0.0)) + crosses
    return fits.withColumns(
        {
            "duration_ns": F.col("fit_end_ns") - F.col("fit_start_ns"),
            "sigma_total_scaled": s("total") * scale**2,
            "closure_species": by_species - s("total"),
            "closure_parts": by_part - s("total"),
        }
    )


def fit_windows(max_lag_ns: float) -> list[tuple[float, float]]:
    """Fixed windows and sliding ones of four lengths; a few dozen, so a plain list."""
    out = set(FIT_WINDOWS_NS)
    for length in SLIDING_LENGTHS_NS:
        n = int((max_lag_ns - 5.0 - length) // SLIDING_STEP_NS) + 1
        out |= {(5.0 + i * SLIDING_STEP_NS, 5.0 + i * SLIDING_STEP_NS + length) for i in range(max(0, n))}
    return sorted(out)


def cumulative_windows(max_lag_ns: float) -> list[tuple[float, float]]:
    """Fixed starts with an end that grows in steps."""
    out = []
    for start in CUMULATIVE_STARTS_NS:
        k = -(-(start + 10.0) // CUMULATIVE_STEP_NS)
        while k * CUMULATIVE_STEP_NS <= max_lag_ns:
            out.append((start, k * CUMULATIVE_STEP_NS))
            k += 1
    return out


def cumulative_scan(
    table: DataFrame, max_lag_ns: float, dt_ps: float, volume: Column | float, temperature_k: float,
    sigma_ne: Column | float, scale: float = CHARGE_SCALE,
) -> DataFrame:
    windows = cumulative_windows(max_lag_ns)
    key = ["fit_start_ns", "fit_end_ns"]
    total = window_fit(table, "charge_msd", windows, dt_ps)
    own = window_fit(table, "charge_msd_self", windows, dt_ps).select(*key, F.col("slope").alias("__self"))
    sigma = conductivity(F.col("slope"), volume, temperature_k)
    sigma_self = conductivity(F.col("__self"), volume, temperature_k)
    return total.join(own, key).select(
        *key, (F.col("fit_end_ns") - F.col("fit_start_ns")).alias("duration_ns"), "n_points", "beta", "r2",
        sigma.alias("sigma_total"), (sigma * scale**2).alias("sigma_total_scaled"), sigma_self.alias("sigma_self_total"),
        (sigma / sigma_ne).alias("ratio_total"), (sigma_self / sigma_ne).alias("ratio_self"),
    )


def _overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    common = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return safe_ratio(common, F.least(a1 - a0, b1 - b0), 0.0)


def window_neighbours(scan: DataFrame) -> DataFrame:
    """Spread of the conductivity over windows of similar place and length (itself included)."""
    key = ["fit_start_ns", "fit_end_ns"]
    b = scan.select(F.col("fit_start_ns").alias("b0"), F.col("fit_end_ns").alias("b1"), F.col("sigma_total").alias("bs"))
    a0, a1, b0, b1 = F.col("fit_start_ns"), F.col("fit_end_ns"), F.col("b0"), F.col("b1")
    near = (
        ((b1 - b0) / (a1 - a0)).between(0.67, 1.50)
        & (_overlap(a0, a1, b0, b1) >= 0.5)
        & (F.col("bs") > 0)
    )
    spread = scan.select(*key, "sigma_total").join(b, near, "left").groupBy(*key, "sigma_total").agg(
        F.count("bs").alias("neighbour_count"),
        F.avg("bs").alias("neighbour_mean"),
        F.stddev_samp("bs").alias("neighbour_std"),
        F.median("bs").alias("__median"),
    )
    out = spread.select(
        *key, "neighbour_count", "neighbour_mean", "neighbour_std",
        safe_ratio(F.col("neighbour_std"), F.abs("neighbour_mean")).alias("neighbour_cv"),
        safe_ratio(F.abs(F.col("sigma_total") - F.col("__median")), F.abs("__median")).alias("difference_from_median"),
    )
    return scan.join(out, key)


class BlockScheme(NamedTuple):
    name: str
    length_ns: float
    max_lag_ns: float
    blocks: int  # nominal; every whole block in the data is used
    windows: tuple[tuple[float, float], ...]


BLOCK_SCHEMES = (  # fixed values
    BlockScheme("5x40ns", 40.0, 20.0, 5, ((2.0, 8.0), (5.0, 12.0), (8.0, 16.0), (10.0, 20.0))),
    BlockScheme("4x50ns", 50.0, 25.0, 4, ((2.0, 8.0), (5.0, 12.0), (8.0, 16.0), (10.0, 20.0), (12.0, 25.0))),
)


def block_rows(df: DataFrame, schemes: Sequence[BlockScheme], dt_ps: float, frame: str = "frame") -> DataFrame:
    """Copy rows to their (scheme, block): all whole blocks the frames hold; a frame shared by two blocks belongs to both."""
    last = df.agg(F.max(frame).alias("f")).select("f").scalar()
    options = []
    for sch in schemes:
        n = int(round(sch.length_ns * 1000.0 / dt_ps))
        b = F.floor(F.col(frame) / n)
        for shift in (0, 1):
            block = b - shift
            inside = (block >= 0) & ((block + 1) * n - 1 <= last)
            if shift:
                inside = inside & (F.col(frame) % n == 0)
            options.append(
                F.when(
                    inside,
                    F.struct(
                        F.lit(sch.name).alias("scheme"), block.cast("bigint").alias("block"),
                        (F.col(frame) - block * n).cast("bigint").alias("block_frame"),
                    ),
                )
            )
    return df.withColumn("__b", F.explode(F.array_compact(F.array(*options)))).select(
        *df.columns, "__b.scheme", "__b.block", "__b.block_frame"
    )


def block_scan(
    positions: DataFrame, volumes: DataFrame, schemes: Sequence[BlockScheme], lags: Mapping[str, Sequence[int]],
    charges: Mapping[str, float], dt_ps: float, temperature_k: float, stride: int = 1,
) -> DataFrame:
    """Window scan of every block of every scheme, with the block's own mean volume.

    ``volumes``: frame, volume.
    """
    out = None
    for sch in schemes:
        rows = block_rows(positions, [sch], dt_ps)
        by = ["scheme", "block"]
        table = charge_msd(
            collective_correlations(rows, lags[sch.name], stride=stride, by=by, ordinal="block_frame"), charges
        )
        volume = block_rows(volumes, [sch], dt_ps).groupBy(*by).agg(F.avg("volume").alias("volume"))
        scan = window_scan(
            table.join(volume, by), sch.windows, charges, dt_ps, F.col("volume"), temperature_k, by
        )
        out = scan if out is None else out.unionByName(scan)
    return out


def block_summary(scan: DataFrame, columns: Sequence[str] = ("sigma_total", "sigma_self_total", "beta", "r2")) -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
            (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_sem"),
        ]
    return scan.groupBy("scheme", "fit_start_ns", "fit_end_ns").agg(*aggs, F.count_distinct("block").alias("n_blocks"))


def nearest_block_window(scan: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block window closest in place and length to each full-run window that overlaps it."""
    key = ["fit_start_ns", "fit_end_ns"]
    b = blocks.select(
        F.col("scheme").alias("block_scheme"), F.col("fit_start_ns").alias("block_start_ns"),
        F.col("fit_end_ns").alias("block_end_ns"), F.col("sigma_total_mean").alias("block_mean"),
        F.col("sigma_total_std").alias("block_std"), F.col("sigma_total_sem").alias("block_sem"),
        F.col("n_blocks").alias("block_count"),
    )
    a0, a1, b0, b1 = F.col("fit_start_ns"), F.col("fit_end_ns"), F.col("block_start_ns"), F.col("block_end_ns")
    share = _overlap(a0, a1, b0, b1)
    score = F.abs((a0 + a1) / 2.0 - (b0 + b1) / 2.0) + 0.5 * F.abs((a1 - a0) - (b1 - b0)) - 5.0 * share
    best = scan.select(*key).join(b, share > 0).groupBy(*key).agg(
        F.min_by(F.struct(*b.columns), F.struct(score, b0, b1, F.col("block_scheme"))).alias("b")
    )
    out = scan.join(best, key, "left").select("*", *[F.col(f"b.{c}").alias(c) for c in b.columns]).drop("b")
    return out.withColumns(
        {
            "block_count": F.coalesce("block_count", F.lit(0)),
            "block_cv": safe_ratio(F.col("block_std"), F.abs("block_mean")),
            "block_difference": safe_ratio(F.abs(F.col("sigma_total") - F.col("block_mean")), F.abs("block_mean")),
        }
    )


def stable_flags(scan: DataFrame) -> DataFrame:
    """Six acceptance flags per window; a missing value never passes."""
    c = F.col
    tests = {
        "passes_beta": c("beta").between(*BETA_RANGE),
        "passes_r2": c("r2") >= R2_MIN,
        "passes_neighbours": (c("neighbour_count") >= NEIGHBOURS_MIN) & (c("neighbour_cv") <= NEIGHBOUR_CV_MAX),
        "passes_blocks": (c("block_count") >= BLOCKS_MIN) & (c("block_cv") <= BLOCK_CV_MAX)
        & (c("block_difference") <= BLOCK_DIFFERENCE_MAX),
        "passes_self_ratio": c("self_ratio").between(*SELF_RATIO_RANGE),
        "passes_positive": c("sigma_total") > 0,
    }
    out = scan.withColumns({n: F.coalesce(t.cast("int"), F.lit(0)) for n, t in tests.items()})
    product = c("passes_beta")
    for n in list(tests)[1:]:
        product = product * c(n)
    return out.withColumn("is_stable", product)


def stable_window(flags: DataFrame) -> DataFrame:
    """The best stable window, else the best diagnostic one, with a status."""
    c = F.col
    lack = F.greatest(1.0 - c("r2"), F.lit(0.0))
    stable = F.abs(c("beta") - 1.0) + 2.0 * lack + sum(
        (F.coalesce(c(n), F.lit(10.0)) for n in ("neighbour_cv", "block_cv", "block_difference")), F.lit(0.0)
    )
    diagnostic = F.coalesce(F.abs(c("beta") - 1.0), F.lit(5.0)) + 2.0 * F.coalesce(lack, F.lit(5.0))
    usable = c("sigma_total").isNotNull() & c("r2").isNotNull() & (c("sigma_total") > 0)
    rank = F.struct(
        F.when(c("is_stable") == 1, 0).when(usable, 1).otherwise(2).alias("tier"),
        F.when(c("is_stable") == 1, stable).when(usable, diagnostic).otherwise(F.lit(0.0)).alias("score"),
        c("fit_start_ns").alias("a"), c("fit_end_ns").alias("b"),
    )
    kept = ["fit_start_ns", "fit_end_ns", "sigma_total", "sigma_total_scaled", "beta", "r2", "neighbour_cv", "block_scheme", "block_mean"]
    best = flags.agg(F.min_by(F.struct(*kept, rank.alias("rank")), rank).alias("w"), F.sum("is_stable").alias("n_stable"))
    return best.select(
        F.when(c("n_stable") > 0, "stable_window_found").otherwise("no_stable_window_found").alias("status"),
        *[c(f"w.{k}").alias(k) for k in kept], "n_stable",
    )


def nernst_einstein(
    counts: DataFrame, diffusion: DataFrame, charges: Mapping[str, float], volume: Column | float, temperature_k: float,
    scale: float = CHARGE_SCALE,
) -> DataFrame:
    """Ideal conductivity per species and in total; missing coefficients give NULLs.

    ``counts``: species, n_ions; ``diffusion``: species, d_nm2_ns.
    """
    z = F.lit(None).cast("double")
    for s, q in charges.items():
        z = F.when(F.col("species") == s, F.lit(float(q))).otherwise(z)
    sigma = (
        F.col("n_ions") * z * z * ELEMENTARY_CHARGE_C**2 * F.col("d_nm2_ns") * 1.0e-9
        / (volume * 1.0e-30 * BOLTZMANN_J_K * temperature_k) * 10.0
    )
    rows = counts.join(diffusion, "species", "left").select(
        "species", "n_ions", z.alias("charge"), "d_nm2_ns", sigma.alias("sigma_ne")
    )
    # A total over an incomplete table is unknown.
    whole = F.when(F.count("sigma_ne") == F.count(F.lit(1)), F.sum("sigma_ne"))
    total = rows.agg(F.sum("n_ions").alias("n_ions"), whole.alias("sigma_ne")).select(
        F.lit("TOTAL").alias("species"), "n_ions", F.lit(None).cast("double").alias("charge"),
        F.lit(None).cast("double").alias("d_nm2_ns"), "sigma_ne",
    )
    every = rows.unionByName(total)
    w = Window.partitionBy(F.lit(0))
    all_of_it = F.max(F.when(F.col("species") == "TOTAL", F.col("sigma_ne"))).over(w)
    return every.select(
        "*", (F.col("sigma_ne") * scale**2).alias("sigma_ne_scaled"), (F.col("sigma_ne") / all_of_it).alias("fraction")
    )
