"""Exact quantiles of continuous values; only counts and the rows near the answer are exchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.session import staged

LIMIT = 10_000
CELLS = 4096


def _placed(rows: DataFrame, open_: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows up to the upper end of their group's bracket; those below it only while their number is unknown."""
    inside = (F.col("__v") <= F.col("__hi")) & (F.col("__below").isNull() | (F.col("__v") >= F.col("__lo")))
    return rows.join(open_, list(by)).filter(inside)


def _narrowed(rows: DataFrame, open_: DataFrame, by: Sequence[str], q: float, cells: int) -> DataFrame:
    """The one cell of each bracket that holds the rank; rows are counted by cell where they are.

    The ends of a bracket are values of the group and have cells of their own, so every round takes some values away.
    """
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    part = F.floor((v - lo) / (hi - lo) * cells)
    cell = F.when(v < lo, -2).when(v == lo, -1).when(v == hi, cells).otherwise(F.greatest(F.least(part, F.lit(cells - 1)), F.lit(0)))
    counts = _placed(rows, open_, by).groupBy(*by, "__n", cell.alias("__cell")).agg(
        F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__a"), F.max("__v").alias("__b"), F.max(F.coalesce("__below", F.lit(0))).alias("__past")
    )
    w = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("__upto", F.sum("__c").over(w) + F.col("__past"))
    rank = F.lit(q) * (F.col("__n") - 1)
    at = lambda r: F.min(F.when(F.col("__upto") > r, F.struct("__cell", "__c", "__upto", "__a", "__b")))
    found = ranked.groupBy(*by, "__n").agg(at(F.floor(rank)).alias("s"), at(F.ceil(rank)).alias("t"))
    same = F.col("s.__cell") == F.col("t.__cell")
    return found.select(
        *by, "__n", F.when(same, F.col("s.__a")).otherwise(F.col("s.__b")).alias("__lo"),
        F.when(same, F.col("t.__b")).otherwise(F.col("t.__a")).alias("__hi"), F.when(same, F.col("s.__upto") - F.col("s.__c")).alias("__below"),
        F.when(~same, 2).when(F.col("s.__a") == F.col("s.__b"), 1).otherwise(F.col("s.__c")).alias("__width"),
    )


def exact_quantile(
    df: DataFrame, by: Sequence[str], value: str, q: float, out: str = "quantile", accuracy: int = 10_000,
    limit: int = LIMIT, cells: int = CELLS,
) -> DataFrame:
    """Linear-interpolated quantile per group.

    A bounded sketch with rank error ``n / accuracy`` brackets the answer. While a bracket holds more than ``limit``
    values, its rows are counted by ``cells`` equal cells and only the cell of the rank stays open; then rows inside the bracket
    are exchanged and ranked, so no window holds more than about ``limit`` values of a group. The brackets
    are written, so Spark knows their size when it plans the joins: a few groups are broadcast and the rows of
    ``df``, which are read once a round, stay where they are.  NULL values take no part; groups without values give no row.
    """
    names = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*names, F.col(value).alias("__v"))
    by = names or ["__all"]
    if not names:
        rows = rows.withColumn("__all", F.lit(0))
    low, high = max(0.0, q - 2.0 / accuracy), min(1.0, q + 2.0 / accuracy)
    edges = rows.groupBy(*by).agg(
        F.percentile_approx("__v", [low, high], accuracy).alias("__e"),
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__lo"),
        F.max("__v").alias("__hi"),
    )
    edges = edges.select(
        *by, "__n",
        (F.col("__lo") if low == 0.0 else F.col("__e")[0]).alias("__lo"),
        (F.col("__hi") if high == 1.0 else F.col("__e")[1]).alias("__hi"),
        F.lit(None).cast("bigint").alias("__below"), F.ceil(F.col("__n") * 4.0 / accuracy).alias("__width"),
    )
    open_ = staged(edges, "quantile_edges")
    while (open_.agg(F.max("__width")).first()[0] or 0) > limit:
        open_ = staged(_narrowed(rows, open_, by, q, cells), "quantile_edges")
    # Rows below the bracket collapse to one count per group, rows inside to one per value.
    at = F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))
    counted = _placed(rows, open_, by).groupBy(*by, "__n", at.alias("__v")).agg(
        F.count(F.lit(1)).alias("__c"), F.max(F.coalesce("__below", F.lit(0))).alias("__past")
    )
    w = Window.partitionBy(*by).orderBy(F.col("__v").asc_nulls_first())
    upto = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("__upto", upto + F.col("__past"))
    rank = F.lit(q) * (F.col("__n") - 1)
    lower = F.min(F.when((F.col("__upto") > F.floor(rank)), F.col("__v")))
    upper = F.min(F.when((F.col("__upto") > F.ceil(rank)), F.col("__v")))
    part = rank - F.floor(rank)
    return ranked.groupBy(*by, "__n").agg(lower.alias("__a"), upper.alias("__b")).select(
        *names, (F.col("__a") + (F.col("__b") - F.col("__a")) * part).alias(out)
    )
