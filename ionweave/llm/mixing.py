"""Mixing sources to target weights by nested hash thresholds.

Every document has a repeatable hash key. The words of each (source, hash bucket) are summed
once; the bucket in which a source's budget ends is split further, and only that one, until a
single key is left. Documents below the key are taken once more than the whole repeats that
the target holds. Rows are filtered, never sorted, and a larger budget takes a superset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.llm.common import KEY_BITS, WORD, group_key, order_key, salted_join
from ionweave.session import staged

#: Bits by which one pass narrows the bucket in which a budget ends.
LEVEL_BITS = 12


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(__g, source, source_size, target): ``share`` of all sizes dealt by weight, at most ``limit`` times a source's size.

    Sources are ordered by code point, null last, and the weights repeat along that order. What
    a source can't hold goes to the others by weight; each round needs two sums over the sources.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("__g").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    ranges = staged(
        totals.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("__part", F.spark_partition_id()), "sources"
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    within = Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())
    ranked = ranges.withColumn("__r", F.row_number().over(within) - 1).join(starts, "__part")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("__start") + F.col("__r")) % len(weights) + 1).cast("int"))
    table = staged(
        ranked.select("__g", "source", "source_size", turn.cast("long").alias("__w"), (F.col("source_size") * limit).alias("__cap")),
        "weights",
    )
    level, full = 0.0, -1
    while True:
        over = F.col("__cap") < F.col("__w") * F.lit(level)
        words, held, free, n = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("__cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("__w"))), F.lit(0)), F.count(F.when(over, 1)),
        ).first()
        if n == full or not free:
            break
        full, level = n, (share * words - held) / free
    target = F.least(F.col("__cap"), F.col("__w") * F.lit(level)).cast("double")
    return table.select("__g", "source", "source_size", target.alias("target"))


def _narrow(rows: DataFrame, ends: DataFrame, shift: int, wider: int) -> DataFrame:
    """One refinement: of the rows in each source's open bucket, the part in which its budget ends."""
    held = salted_join(rows, ends.select("__g", "__at", "__left"), "__g", F.col("__key"))
    held = held.filter(F.shiftright("__key", wider) == F.col("__at"))
    part = F.shiftright(F.col("__key"), shift).alias("__part")
    sums = held.groupBy("__g", part).agg(
        F.sum("size").alias("__s"), F.min("__key").alias("__low"), F.max("__key").alias("__high"), F.first("__left").alias("__left")
    )
    upto = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("__upto", F.sum("__s").over(upto)).filter(F.col("__upto") > F.col("__left"))
    first = sums.groupBy("__g").agg(F.min_by(F.struct("__part", "__s", "__low", "__high", "__upto", "__left"), "__part").alias("e"))
    return first.select(
        "__g", F.col("e.__part").alias("__at"), F.col("e.__s").alias("__s"), F.col("e.__low").alias("__low"), F.col("e.__high").alias("__high"),
        (F.col("e.__left") - F.col("e.__upto") + F.col("e.__s")).alias("__left"),
    )


def mix_thresholds(rows: DataFrame, weights: Sequence[int], share: float, limit: float) -> DataFrame:
    """Per source: target, whole repeats, and the key below which a document is taken once more.

    ``rows`` is a written table with __g, source, size and __key.
    """
    targets = source_targets(rows, weights, share, limit)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("target") - whole * F.col("source_size")
    targets = staged(targets.select("__g", "source_size", "target", whole.alias("__whole"), left.alias("__left")), "targets")
    ends = targets.filter("__left > 0").select("__g", F.lit(0).cast("long").alias("__at"), "__left")
    wider = KEY_BITS
    while wider > 0:
        shift = max(0, wider - LEVEL_BITS)
        ends = staged(_narrow(rows, ends, shift, wider), "ends")
        wider = shift
        if not ends.filter("__low < __high").limit(1).count():
            break
    bound = F.when(F.col("__left") * 2 >= F.col("__s"), F.col("__high") + 1).otherwise(F.col("__low"))
    return staged(
        targets.drop("__left").join(ends.select("__g", bound.alias("__bound")), "__g", "left").fillna(0, ["__bound"]), "thresholds"
    )


def _keyed(documents: DataFrame, seed: int) -> DataFrame:
    return documents.withColumns({"__g": group_key("source"), "__key": order_key(seed, F.col("doc_id"), F.md5("text"))})


def _sized(documents: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = _keyed(documents.select("doc_id", "source", "text"), seed)
    return staged(rows.select("doc_id", "source", size.alias("size"), "__g", "__key"), "mix")


def _copies() -> Column:
    return F.col("__whole") + (F.col("__key") < F.col("__bound")).cast("long")


def mix_sources(
    documents: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 0
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``documents``.

    ``copies`` is how often the mix repeats the document (0 to ``limit`` rounded up, 2 by default) and
    ``taken = copies * size``. Defined cases: a null text has size 0; rows of one doc_id (or, where it
    is null, of one text) share a key and are taken alike; a null source is a source of its own, the
    last; sources without words have target 0; an empty table gives an empty result; other columns
    are ignored. The unit at a threshold is taken if that brings the source nearer to its target.
    """
    rows = _sized(documents, seed)
    out = salted_join(rows, mix_thresholds(rows, weights, share, limit), "__g", F.col("__key"))
    out = out.select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(
    documents: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 0
) -> DataFrame:
    """The rows of ``documents`` with all their columns, each as often as ``mix_sources`` takes it; texts are not shuffled.

    Cases as in ``mix_sources``: rows of one key are repeated alike, null texts, which have no words, as often as their
    source is taken whole and once more below its threshold; an empty table gives an empty one; columns of any
    name keep their values.
    """
    plan = mix_thresholds(_sized(documents, seed), weights, share, limit).select("__g", "__whole", "__bound")
    # The whole row travels as one column, so no column of it can meet one of the plan.
    nested = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    keyed = nested.select("row", group_key(F.col("row.source")).alias("__g"), order_key(seed, F.col("row.doc_id"), F.md5("row.text")).alias("__key"))
    rows = salted_join(keyed, plan, "__g", F.col("__key"))
    times = F.array_repeat(F.lit(1), _copies().cast("int"))
    return rows.select("row", F.explode(times).alias("__copy")).select("row.*")
