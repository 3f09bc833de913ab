"""Session helpers: reliable checkpoints and the adaptive settings the joins rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

ESTIMATED, COUNTED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
GIVEN = "spark.ionweave.givenBroadcastThreshold"


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options every operator here assumes."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    given = spark.conf.get(GIVEN, None)
    if given is not None:
        spark.conf.set(ESTIMATED, given)
        for key in (COUNTED, GIVEN):
            spark.conf.unset(key)
    return spark


def counted_broadcasts(spark: SparkSession) -> SparkSession:
    """Broadcast a side of a join by the bytes counted when it has run, up to the given threshold, never by an estimate.

    An exploded range counts as one row in Spark's estimate and a sorted column as its few bytes on disk, so that
    a grid of millions of cells looks small enough for the driver. ``tune`` takes this back.
    """
    given = spark.conf.get(GIVEN, None) or spark.conf.get(ESTIMATED)
    for key, value in ((GIVEN, given), (COUNTED, given), (ESTIMATED, "-1")):
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a local one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table as Parquet to the shared folder and read it back (columnar, prunable)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
