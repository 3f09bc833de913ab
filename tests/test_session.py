"""What a registered query may broadcast."""

from pyspark.sql import functions as F

from ionweave import session
from ionweave.plans import registry


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_grid_is_not_broadcast_by_its_estimate(spark):
    # Spark's estimate of the exploded side is four rows; it has 1.6 million.
    def build(s, _):
        grid = s.range(4).select(F.col("id").alias("center_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(400_000).cast("long"))).alias("frame"))
        return s.range(2_000_000).withColumnRenamed("id", "frame").join(grid, "frame").agg(F.count(F.lit(1)).alias("n"))

    registry.register("__probe", build)
    given = spark.conf.get(session.ESTIMATED)
    try:
        plan = final_plan(registry.QUERIES.pop("__probe")(spark, ""))
    finally:
        session.tune(spark)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert spark.conf.get(session.ESTIMATED) == given and spark.conf.get(session.GIVEN, None) is None
