"""Column expressions and small distributed helpers that several operators share."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionweave.session import scratch, tune

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of ``order_key``.
KEY_BITS = 60
#: Small tables are copied this often when they meet rows of a key that may be hot.
SALTS = 32
#: Bits of the filter of ``possible``: at most 1024 rows of 4 kB, however many keys there are.
FILTER_BITS = 1 << 25
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to a Python worker at once; texts may be long, and a worker holds several copies of a batch.
BATCH_ROWS = 2000


def group_key(source: str | Column) -> Column:
    """A text that is never null and differs for null, for the empty text and for every other value."""
    c = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def order_key(seed: int, *parts: Column) -> Column:
    """A repeatable pseudo-random number of 60 bits from the seed and the first part that is not null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(*[p.cast("string") for p in parts], F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def salted_join(rows: DataFrame, small: DataFrame, key: str | Sequence[str], salt: Column, how: str = "inner") -> DataFrame:
    """Join ``rows`` with one row per ``key`` of ``small``; a hot key is dealt to ``SALTS`` partitions."""
    keys = [key] if isinstance(key, str) else list(key)
    copies = small.withColumn("__salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return rows.withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("long")).join(copies, [*keys, "__salt"], how).drop("__salt")


def possible(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The ``rows`` whose ``key`` may be in ``keys``, all that are among them; with "left_anti" the others, none of them in ``keys``.

    A bitmap of hashed keys is broadcast, so that wide rows meet the exact join only where it may matter.
    """
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = keys.select(F.shiftright(at, 15).alias("__part"), at.bitwiseAND(F.lit(32767)).alias("__at"))
    bits = bits.groupBy("__part").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(at, 3).bitwiseAND(F.lit(4095)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    here = (F.shiftright(at, 15) == F.col("__part")) & (F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return rows.join(F.broadcast(bits), here, how)


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, span: int = 4096) -> DataFrame:
    """Sum of ``value`` over the rows before this one, by the unique non-negative integer ``order`` within ``keys``.

    Works in two levels, so that a task holds at most ``span`` neighbouring values of ``order``,
    or one row for each of these groups.
    """
    keys = list(keys)
    rows = df.withColumn("__hi", F.floor(F.col(order) / F.lit(span)).cast("long"))
    past = Window.unboundedPreceding
    tops = rows.groupBy(*keys, "__hi").agg(F.sum(value).alias("__s"))
    wk = Window.partitionBy(*keys).orderBy("__hi").rowsBetween(past, -1)
    tops = tops.select(*keys, "__hi", F.coalesce(F.sum("__s").over(wk), F.lit(0)).alias("__base"))
    w = Window.partitionBy(*keys, "__hi").orderBy(order).rowsBetween(past, -1)
    local = rows.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return local.join(tops, [*keys, "__hi"]).withColumn(out, (F.col("__base") + F.col("__in")).cast("long")).drop("__hi", "__base", "__in")


class Stages:
    """Tables written to the shared scratch folder and deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in map(self.spark._jvm.org.apache.hadoop.fs.Path, self.paths):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the options of ``tune``, its Python workers able to import this package from the driver's copy."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    return tune(spark)
