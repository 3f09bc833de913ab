"""Time series of per-frame counts: rolling means, blocks, trends and autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.operators.ordered import _CHUNK, CHUNK, _with_ghosts, ordinals

STARTS_NS = (0.0, 10.0, 20.0, 50.0, 100.0)  # fixed values
ACF_LAGS_PER_PASS = 256


def population_rolling_mean(series: DataFrame, window: int, value: str = "value", frame: str = "frame") -> DataFrame:
    """Centered mean over ``window`` rows, at least max(1, window // 4) of them."""
    before, after = window // 2, (window - 1) // 2
    ranked = ordinals(series, [], frame, "__o")
    w = Window.partitionBy(_CHUNK).orderBy("__o").rangeBetween(-before, after)
    seen = _with_ghosts(ranked, [], "__o", before, after, max(CHUNK, 4 * window))
    mean = F.when(F.count(value).over(w) >= max(1, window // 4), F.avg(value).over(w))
    return (
        seen.withColumn("rolling_mean", mean)
        .filter(F.col("__home") == F.col(_CHUNK))
        .select(*series.columns, "rolling_mean")
    )


def population_blocks(
    series: DataFrame, size: int, dt_ps: float, metrics: Sequence[str], value: str = "value", frame: str = "frame"
) -> DataFrame:
    """Blocks of ``size`` frames: statistics of ``value``, means of ``metrics``, complete if >= 90 % full."""
    ranked = ordinals(series, [], frame, "__o")
    ns = dt_ps / 1000.0
    return ranked.groupBy(F.floor(F.col("__o") / size).cast("bigint").alias("block")).agg(
        F.min(frame).alias("start_frame"),
        F.max(frame).alias("end_frame"),
        (0.5 * ns * (F.min(frame) + F.max(frame))).alias("midpoint_ns"),
        F.count(F.lit(1)).alias("n_frames"),
        (F.count(F.lit(1)) >= 0.9 * size).cast("int").alias("is_complete"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        *[F.avg(m).alias(f"mean_{m}") for m in metrics],
    )


def trend_columns(x: Column, y: Column) -> list[Column]:
    """Least-squares slope, intercept, R2, slope error and net change as aggregates."""
    n, sxx, syy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x)
    slope = F.regr_slope(y, x)
    ok = (n >= 3) & (sxx > 0)
    rest = F.greatest(syy - slope * slope * sxx, F.lit(0.0))
    return [
        F.when(ok, slope).alias("slope"),
        F.when(ok, F.regr_intercept(y, x)).alias("intercept"),
        F.when(ok & (syy > 0), F.regr_r2(y, x)).alias("r2"),
        F.when(ok, F.sqrt(rest / (n - 2) / sxx)).alias("slope_error"),
        F.when(ok, slope * (F.max(x) - F.min(x))).alias("net_change"),
    ]


def linear_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Ordinary least squares per group; fewer than three points give NULLs."""
    return df.groupBy(*by).agg(*trend_columns(F.col(x), F.col(y)))


def equilibration_sensitivity(
    series: DataFrame, dt_ps: float, starts_ns: Sequence[float] = STARTS_NS, value: str = "value"
) -> DataFrame:
    """Mean, spread and trend of the series from several start times on."""
    t = series.withColumn("__t", F.col("frame") * (dt_ps / 1000.0))
    last = t.agg(F.max("__t").alias("m")).select("m").scalar()
    starts = F.array(*[F.lit(float(v)) for v in starts_ns])
    inside = t.select("__t", value, F.explode(F.filter(starts, lambda v: v <= F.col("__t"))).alias("start_ns"))
    return inside.filter(F.col("start_ns") < last).groupBy("start_ns").agg(
        F.min("__t").alias("actual_start_ns"),
        F.max("__t").alias("end_ns"),
        F.count(F.lit(1)).alias("n_frames"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
        *trend_columns(F.col("__t"), F.col(value)),
    )


def _acf(series: DataFrame, low: int, high: int, value: str, frame: str) -> DataFrame:
    """Unbiased autocorrelation at lags low..high; zero variance gives 1, 0, 0, ..."""
    ranked = ordinals(series.select(frame, value), [], frame, "o", total="n")
    mean = series.agg(F.avg(value).alias("m")).select("m").scalar()
    x = ranked.select("o", "n", (F.col(value) - mean).alias("x"))
    variance = x.agg(F.avg(F.col("x") * F.col("x")).alias("v")).select("v").scalar()
    # One row per frame on both sides; the right side is small enough for Spark to broadcast.
    head = x.select(
        "n", F.col("x").alias("a"), "o", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag")
    ).withColumn("o", F.col("o") + F.col("lag"))
    pairs = head.join(x.select("o", F.col("x").alias("b")), "o")
    cov = F.sum(F.col("a") * F.col("b")) / F.count(F.lit(1))
    return pairs.groupBy(F.col("lag").cast("bigint").alias("lag")).agg(
        F.when(variance > 0, cov / variance)
        .otherwise(F.when(F.first("lag") == 0, 1.0).otherwise(0.0))
        .alias("acf")
    )


def population_acf(series: DataFrame, max_lag: int, value: str = "value", frame: str = "frame") -> DataFrame:
    return _acf(series, 0, max_lag, value, frame)


def integrated_time(series: DataFrame, value: str = "value", frame: str = "frame", lags_per_pass: int = ACF_LAGS_PER_PASS) -> DataFrame:
    """tau = 1/2 + sum of the autocorrelation up to its first non-positive value, ESS and SEM.

    Lags are evaluated in passes until the sign changes, so long series never need all of them.
    """
    stats = series.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("std"))
    n = stats.first()["n"]
    tau, low = 0.5, 1
    while low < n:
        high = min(n - 1, low + lags_per_pass - 1)
        part = _acf(series, low, high, value, frame)
        stop = part.filter(F.col("acf") <= 0).agg(F.min("lag").alias("k"))
        k = stop.select("k").scalar()
        row = part.agg(
            F.sum(F.when(k.isNull() | (F.col("lag") < k), F.col("acf"))).alias("s"), F.max(k).alias("k")
        ).first()
        tau += row["s"] or 0.0
        if row["k"] is not None:
            break
        low = high + 1
    ess = F.col("n") / (2.0 * F.lit(tau))
    return stats.select(
        F.lit(tau).alias("tau_frames"),
        ess.alias("effective_samples"),
        F.when(ess > 1, F.col("std") / F.sqrt(ess)).alias("corrected_sem"),
    )


def half_split_drift(series: DataFrame, value: str = "value", frame: str = "frame") -> DataFrame:
    """Means of the first n//2 frames and of the rest, with their difference."""
    ranked = ordinals(series.select(frame, value), [], frame, "o", total="n")
    first = F.col("o") < F.floor(F.col("n") / 2)
    a, b = F.avg(F.when(first, F.col(value))), F.avg(F.when(~first, F.col(value)))
    return ranked.agg(
        a.alias("first_half"), b.alias("second_half"), (b - a).alias("difference"),
        (100.0 * (b - a) / a).alias("percent"),
    )
