"""Block rules, two-level block statistics and probability tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.operators.ordered import ordinals


def even_block(ordinal: Column, total: Column, k: int) -> Column:
    """1-based contiguous block; the first ``total mod k`` blocks are one longer."""
    size = F.floor(total / k)
    extra = total % k
    edge = extra * (size + 1)
    return (
        F.when(ordinal < edge, F.floor(ordinal / (size + 1)) + 1)
        .otherwise(extra + F.floor((ordinal - edge) / size) + 1)
        .cast("long")
    )


def proportional_block(ordinal: Column, total: Column, k: int) -> Column:
    """0-based block ``min(k-1, floor(ordinal*k/total))``."""
    return F.least(F.lit(k - 1), F.floor(ordinal * k / total)).cast("long")


def time_block(time_ps: Column, block_ns: float) -> Column:
    """0-based block of fixed duration."""
    return F.floor(time_ps / 1000.0 / block_ns).cast("long")


def frame_blocks(frames: DataFrame, k: int = 5, frame: str = "frame") -> DataFrame:
    """``k`` contiguous blocks over the distinct frames; fewer frames than blocks is an error."""
    ranked = ordinals(frames.select(frame).distinct(), [], frame, "ordinal", total="n_frames")
    guard = F.when(
        F.col("n_frames") < k, F.raise_error(F.lit(f"fewer than {k} frames")).cast("long")
    )
    block = F.coalesce(guard, even_block(F.col("ordinal"), F.col("n_frames"), k))
    return ranked.select(frame, block.alias("block"))


def block_means(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """First level: mean of every metric per (by, block)."""
    return df.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def over_blocks(
    blocks: DataFrame, by: Sequence[str], metrics: Sequence[str], prefix: str = "mean_"
) -> DataFrame:
    """Second level in wide form: mean, sample std and SEM of block values per ``by``."""
    aggs = []
    for m in metrics:
        aggs += [
            F.avg(m).alias(f"{prefix}{m}"),
            F.stddev_samp(m).alias(f"block_std_{m}"),
            (F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"block_sem_{m}"),
        ]
    return blocks.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_blocks"))


def block_statistics(
    df: DataFrame, block: str, metrics: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Long form: one row per metric with mean of block means, sample std, SEM, n blocks."""
    means = block_means(df, [*by, block], metrics)
    long = means.select(
        *by,
        block,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                    for m in metrics
                ]
            )
        ).alias("__m"),
    ).select(*by, block, "__m.metric", "__m.value")
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("block_std"),
        (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("block_sem"),
        F.count("value").alias("n_blocks"),
    )


def with_share(counts: DataFrame, by: Sequence[str], count: str, out: str) -> DataFrame:
    """Adds ``count / sum(count)`` within ``by``; ``counts`` is already one row per value."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn(out, F.col(count) / F.sum(count).over(w))


def probability(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of distinct ``values`` within ``by`` (NULL is a value)."""
    counts = df.groupBy(*by, *values).agg(F.count(F.lit(1)).alias("count"))
    return with_share(counts, by, "count", "probability")


def melt(df: DataFrame, by: Sequence[str], metrics: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """Unpivot metric columns to (metric, value) rows."""
    if not isinstance(metrics, Mapping):
        metrics = {m: F.col(m) for m in metrics}
    pairs = F.array(
        *[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in metrics.items()]
    )
    return df.select(*by, F.explode(pairs).alias("__m")).select(*by, "__m.metric", "__m.value")
