"""Order-dependent cores: running totals, runs, ordinals, neighbours and lag pairs.

A plain ``PARTITION BY entity`` window puts a whole entity in one task, which fails when
one entity owns a large share of the rows.  Every core here windows over
``(entity, chunk of the order column)`` instead, so a task never sees more than one chunk:

* ``accumulate``/``runs``/``ordinals`` summarise each chunk to one row, scan those few
  rows, and hand each chunk what came before it;
* ``neighbours``/``lag_pairs`` copy the rows a chunk has to look ahead at (at most the
  largest lag) into that chunk, so one shuffle serves every lag.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 20_000
_CHUNK = "__chunk"


def _struct(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def _opening(first, head: Column) -> Column:
    if isinstance(first, Column):
        return first
    return first(head) if callable(first) else F.lit(first)


def _chunked(df: DataFrame, keys: Sequence[str], order: str, chunk: int) -> DataFrame:
    bucket = F.floor(F.col(order) / F.lit(chunk)).cast("long")
    return df.withColumn(_CHUNK, bucket).repartition(*[F.col(k) for k in keys], F.col(_CHUNK))


def accumulate(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    step: Callable[[Column, Column], Mapping[str, Column]],
    first: Mapping[str, Column | float | Callable[[Column], Column]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Running totals of ``step(previous, current)`` along ``order`` within ``keys``.

    ``previous`` and ``current`` are structs of ``columns``; ``first`` gives the step of
    the first row of a key (a value, or a function of that row's struct).  Adds ``<name>`` (inclusive total) and ``<name>_step``.
    """
    keys = list(keys)
    names = list(first)
    # The order column is unique within a key, so min_by/max_by are well defined.
    base = _chunked(df, keys, order, chunk)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    local = base.withColumns({"__cur": _struct(columns)}).withColumn("__prev", F.lag("__cur").over(w))
    steps = step(F.col("__prev"), F.col("__cur"))
    local = local.withColumns(
        {f"{n}_step": F.when(F.col("__prev").isNotNull(), steps[n]) for n in names}
    )
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.withColumns(
        {f"__t_{n}": F.coalesce(F.sum(f"{n}_step").over(running), F.lit(0)) for n in names}
    )
    totals = local.groupBy(*keys, _CHUNK).agg(
        F.min_by("__cur", order).alias("__head"),
        F.max_by("__cur", order).alias("__tail"),
        *[F.sum(f"{n}_step").alias(f"__s_{n}") for n in names],
    )
    wk = Window.partitionBy(*keys).orderBy(_CHUNK)
    carry = totals.withColumn("__before", F.lag("__tail").over(wk))
    head = step(F.col("__before"), F.col("__head"))
    carry = carry.withColumns(
        {
            f"__h_{n}": F.when(F.col("__before").isNotNull(), head[n]).otherwise(
                _opening(first[n], F.col("__head"))
            )
            for n in names
        }
    )
    upto = wk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = wk.rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(
        *keys,
        _CHUNK,
        *[F.col(f"__h_{n}") for n in names],
        *[
            (
                F.sum(f"__h_{n}").over(upto)
                + F.coalesce(F.sum(f"__s_{n}").over(past), F.lit(0))
            ).alias(f"__o_{n}")
            for n in names
        ],
    )
    out = local.join(carry, [*keys, _CHUNK])
    out = out.withColumns(
        {n: F.col(f"__o_{n}") + F.col(f"__t_{n}") for n in names}
        | {
            f"{n}_step": F.when(F.col("__prev").isNull(), F.col(f"__h_{n}")).otherwise(
                F.col(f"{n}_step")
            )
            for n in names
        }
    )
    return out.select(*df.columns, *names, *[f"{n}_step" for n in names])


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    tolerance: int = 0,
    step: int = 1,
    value: Sequence[str] = (),
    chunk: int = CHUNK,
) -> DataFrame:
    """Gaps and islands: adds ``run`` (1-based per key) and ``run_start``.

    A row continues the run when its order is at most ``step * (tolerance + 1)`` past the
    previous row and every ``value`` column is unchanged.
    """
    keys, value = list(keys), list(value)
    limit = step * (tolerance + 1)
    base = _chunked(df, keys, order, chunk)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(order)

    def breaks(prev: Column, cur: Column) -> Column:
        test = cur[order] - prev[order] > limit
        for v in value:
            test = test | ~cur[v].eqNullSafe(prev[v])
        return test

    seen = list(dict.fromkeys([order, *value]))
    local = base.withColumn("__cur", _struct(seen)).withColumn("__prev", F.lag("__cur").over(w))
    local = local.withColumn(
        "__brk",
        F.when(F.col("__prev").isNull(), F.lit(0))
        .when(breaks(F.col("__prev"), F.col("__cur")), F.lit(1))
        .otherwise(F.lit(0)),
    )
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.withColumns(
        {
            "__run": F.sum("__brk").over(running),
            "__start": F.max(F.when(F.col("__brk") == 1, F.col(order))).over(running),
        }
    )
    totals = local.groupBy(*keys, _CHUNK).agg(
        F.min_by("__cur", order).alias("__head"),
        F.max_by("__cur", order).alias("__tail"),
        F.sum("__brk").alias("__n"),
        F.max("__start").alias("__last"),
    )
    wk = Window.partitionBy(*keys).orderBy(_CHUNK)
    upto = wk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = wk.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("__before", F.lag("__tail").over(wk)).withColumn(
        "__hb",
        F.when(F.col("__before").isNull(), F.lit(1))
        .when(breaks(F.col("__before"), F.col("__head")), F.lit(1))
        .otherwise(F.lit(0)),
    )
    own = F.when(F.col("__hb") == 1, F.col("__head")[order])
    carry = carry.withColumn("__open", F.coalesce(F.col("__last"), own))
    carry = carry.select(
        *keys,
        _CHUNK,
        (F.sum("__hb").over(upto) + F.coalesce(F.sum("__n").over(past), F.lit(0))).alias("__off"),
        F.coalesce(own, F.last("__open", ignorenulls=True).over(past)).alias("__from"),
    )
    return (
        local.join(carry, [*keys, _CHUNK])
        .withColumns(
            {
                "run": (F.col("__off") + F.col("__run")).cast("long"),
                "run_start": F.coalesce("__start", "__from"),
            }
        )
        .select(*df.columns, "run", "run_start")
    )


def ordinals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "ordinal",
    total: str | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """0-based rank of a unique integer ``order`` within ``keys``; optionally the key's row count."""
    keys = list(keys)
    base = _chunked(df, keys, order, chunk)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    wk = Window.partitionBy(*keys).orderBy(_CHUNK)
    counts = base.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    whole = wk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = counts.select(
        *keys,
        _CHUNK,
        F.coalesce(
            F.sum("__n").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
        F.sum("__n").over(whole).alias("__all"),
    )
    out = base.withColumn("__rn", F.row_number().over(w)).join(carry, [*keys, _CHUNK])
    extra = [F.col("__all").cast("long").alias(total)] if total else []
    return out.select(
        *df.columns, (F.col("__off") + F.col("__rn") - 1).cast("long").alias(name), *extra
    )


def _with_ghosts(
    df: DataFrame, keys: Sequence[str], order: str, back: int, ahead: int, chunk: int
) -> DataFrame:
    """Each row in its own chunk, and again in every chunk that looks at it across an edge."""
    home = F.floor(F.col(order) / F.lit(chunk)).cast("long")
    low = F.floor((F.col(order) - F.lit(ahead)) / F.lit(chunk)).cast("long")
    high = F.floor((F.col(order) + F.lit(back)) / F.lit(chunk)).cast("long")
    return df.withColumn("__home", home).withColumn(_CHUNK, F.explode(F.sequence(low, high)))


def _dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.repartition(*[F.col(k) for k in keys], F.col(_CHUNK))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    offsets: Mapping[str, int],
    columns: Sequence[str],
    chunk: int = CHUNK,
) -> DataFrame:
    """Adds, per ``{name: offset}``, the struct of ``columns`` at ``order + offset`` (or NULL)."""
    back = max(0, -min(offsets.values()))
    ahead = max(0, max(offsets.values()))
    chunk = max(chunk, 4 * max(back, ahead))
    w = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    # One struct column for all offsets, made of the shuffled rows, so that the shuffle does not carry it too.
    ghosts = _dealt(_with_ghosts(df, keys, order, back, ahead, chunk), keys).withColumn("__seen", _struct(columns))
    found = ghosts.withColumns(
        {n: F.first("__seen").over(w.rangeBetween(o, o)) for n, o in offsets.items()}
    )
    return found.filter(F.col("__home") == F.col(_CHUNK)).select(*df.columns, *offsets)


def lag_pairs(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    lags: Sequence[int],
    start: Sequence[str],
    end: Sequence[str],
    *,
    between: Mapping[str, Column] | None = None,
    stride: int = 1,
    chunk: int = CHUNK,
) -> DataFrame:
    """All (origin, origin + lag) pairs of one entity, for every lag in ``lags``.

    Result: ``keys``, ``ordinal``, ``lag``, the ``start`` columns, ``end_<c>`` for each
    ``end`` column, and for each ``between`` entry its sum over ``(origin, origin + lag]``.
    Rows are copied to at most one extra chunk, not once per lag.
    """
    between = dict(between or {})
    lags = sorted({int(v) for v in lags})
    if not lags:
        raise ValueError("no lags given")
    top = lags[-1]
    chunk = max(chunk, 4 * top)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(ordinal)
    rows = _dealt(_with_ghosts(df, keys, ordinal, 0, top, chunk), keys)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if between:
        rows = rows.withColumns({f"__p_{n}": F.sum(c).over(running) for n, c in between.items()})
    # One struct column for all lags, made of the shuffled rows.
    ahead = F.struct(
        *[F.col(c).alias(f"end_{c}") for c in end], *[F.col(f"__p_{n}") for n in between]
    )
    rows = rows.withColumn("__ahead", ahead)
    found = rows.withColumns({f"__l{v}": F.first("__ahead").over(w.rangeBetween(v, v)) for v in lags})
    found = found.filter(
        (F.col("__home") == F.col(_CHUNK)) & (F.col(ordinal) % F.lit(stride) == 0)
    )
    pairs = F.array(
        *[F.struct(F.lit(v).cast("long").alias("lag"), F.col(f"__l{v}").alias("to")) for v in lags]
    )
    head = list(dict.fromkeys([*keys, ordinal, *start]))
    long = found.select(
        *head, *[f"__p_{n}" for n in between], F.explode(pairs).alias("__pair")
    ).filter(F.col("__pair.to").isNotNull())
    return long.select(
        *head,
        F.col("__pair.lag").alias("lag"),
        *[F.col(f"__pair.to.end_{c}").alias(f"end_{c}") for c in end],
        *[
            (F.col(f"__pair.to.__p_{n}") - F.col(f"__p_{n}")).alias(n) for n in between
        ],
    )
