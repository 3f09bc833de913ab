"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded key and ranked; row k of a source with n rows
stands at (k + u) / n of the whole order, with one offset u per source. Cutting that order into
equal pieces gives every shard each source's share, to within one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.llm.common import KEY_BITS, group_key, order_key, prefix_sums, salted_join
from ionweave.session import staged

#: Rows that one window sorts, about.
SPAN = 2048


def stratified_shards(documents: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, text_crc32, source_rank, place, law, shard, slot, grown_shard), a row for each row.

    Law ``rows``: the numbers of rows of any two shards differ by one at most, and so do those of
    the rows of one source. Slots count from 0 in each shard. Defined cases: a null text has size 1
    and crc 0; a null doc_id is ordered by its text; a null source is a source of its own; equal
    rows are told apart by their place in the order only; an empty table gives an empty result;
    other columns are ignored.
    """
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = documents.select(
        "doc_id", "source", group_key("source").alias("__g"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), order_key(seed, F.col("doc_id"), F.md5("text")).alias("__key"),
    )
    rows = staged(rows, "shard_rows")
    counts = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    # Buckets of the shuffled order: as many for each source as keep them short.
    bits = F.greatest(F.lit(0), F.least(F.lit(KEY_BITS), F.ceil(F.log2(F.col("__n") / F.lit(SPAN))))).cast("int")
    offset = order_key(seed + 1, F.col("__g")) / F.lit(float(1 << KEY_BITS))
    counts = staged(counts.select("__g", "__n", bits.alias("__bits"), offset.alias("__u")), "shard_sources")
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    rows = salted_join(rows, counts, "__g", F.col("__key"))
    rows = rows.withColumn("__b", F.floor(F.col("__key") / F.pow(F.lit(2.0), F.lit(KEY_BITS) - F.col("__bits"))).cast("long"))
    starts = rows.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__c"))
    starts = prefix_sums(starts, ["__g"], "__b", "__c", "__start").drop("__c")
    w = Window.partitionBy("__g", "__b").orderBy("__key", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("__i", F.row_number().over(w) - 1).join(starts, ["__g", "__b"])
    rank = (F.col("__start") + F.col("__i")).cast("long")
    rows = rows.withColumn("source_rank", rank).withColumn("place", (F.col("source_rank") + F.col("__u")) / F.col("__n"))
    pieces = max(1, -(-total // SPAN))
    rows = rows.withColumn("__p", F.floor(F.col("place") * pieces).cast("long")).drop("__b", "__i", "__start", "__n", "__bits", "__u")
    rows = staged(rows, "shard_places")
    before = prefix_sums(rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__c")), [], "__p", "__c", "__start").drop("__c")
    w = Window.partitionBy("__p").orderBy("place", "__g", "source_rank")
    rows = rows.withColumn("__i", F.row_number().over(w) - 1).join(before, "__p").withColumn("__at", F.col("__start") + F.col("__i"))
    shard = F.expr(f"(__at * {shards}) div {max(1, total)}").cast("int")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard).withColumn("slot", (F.col("__at") - first).cast("long")).select(
        "doc_id", "source", "size", "text_crc32", "source_rank", "place", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(documents: DataFrame, path: str, shards: int = 8, seed: int = 0) -> None:
    """Write whole rows under ``path/shard=<n>``, each row with its slot; doc_id must be unique and not null here."""
    plan = stratified_shards(documents, shards, seed).select("doc_id", "shard", "slot")
    rows = documents.join(plan, "doc_id")
    cells = rows.repartition(F.col("shard"), F.floor(F.col("slot") / F.lit(100_000)))
    cells.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
