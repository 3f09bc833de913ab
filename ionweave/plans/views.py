"""Trajectory-shaped views over the relational test tables.

Supplier = center, part = site of a ligand, ship week = frame; user = moving entity and the
order of its events = frame; embedding = point in a box.  Every view reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.functions.geometry import BOX_COLUMNS
from ionweave.operators import aggregates
from ionweave.operators import components as comp
from ionweave.operators import contacts as ct
from ionweave.operators.ordered import ordinals
from ionweave.session import staged

DT_PS = 30.0
BOX = 20.0
EPOCH = "1995-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _week(date: str):
    return F.floor(F.datediff(F.col(date), F.lit(EPOCH).cast("date")) / 7).cast("long")


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Contact table, written once per application: most queries read it several times."""
    return shared(spark, sf, "contacts", lambda: build_contacts(spark, sf))


def build_contacts(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_partkey", "l_orderkey", "l_returnflag", "l_shipdate"
    )
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    anion = F.col("l_returnflag") == "N"
    near = F.when(
        anion, F.floor(F.col("l_suppkey") / 2) + F.col("l_partkey") % 3
    ).otherwise(F.floor(F.col("l_suppkey") / 4) + F.col("l_partkey") % 2)
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .groupBy(
            _week("l_shipdate").alias("frame"),
            F.col("l_suppkey").alias("center_id"),
            F.when(anion, ct.ANION).otherwise(ct.POLYMER).alias("ligand_kind"),
            near.cast("long").alias("ligand_id"),
            F.col("p_size").cast("long").alias("site_index"),
        )
        .agg(
            F.min(1.5 + ((F.col("l_partkey") * 31 + F.col("l_orderkey") * 17) % 250) / 100.0).alias(
                "distance"
            )
        )
    )


def frame_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(
        F.min(_week("l_shipdate")).alias("first"), F.max(_week("l_shipdate")).alias("last")
    )


def _axis(spark: SparkSession, sf: str):
    bounds = frame_bounds(spark, sf)
    return F.explode(
        F.sequence(bounds.select("first").scalar(), bounds.select("last").scalar())
    ).alias("frame")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every center in every week between the first and the last."""
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("center_id"), _axis(spark, sf)
    ).select("frame", "center_id")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(_axis(spark, sf))


def chains(spark: SparkSession, sf: str) -> DataFrame:
    """Every chain a center can reach, in every week."""
    reach = F.explode(F.array(F.lit(0), F.lit(1)))
    return (
        table(spark, sf, "supplier")
        .select(F.floor(F.col("s_suppkey") / 4).alias("base"), reach.alias("o"))
        .select((F.col("base") + F.col("o")).cast("long").alias("chain_id"))
        .distinct()
        .select("chain_id", _axis(spark, sf))
        .select("frame", "chain_id")
    )


def states(spark: SparkSession, sf: str) -> DataFrame:
    """Coordination numbers and state of every cell; a stage table like the contact table."""
    return shared(
        spark, sf, "states",
        lambda: ct.with_state(ct.coordination_numbers(contacts(spark, sf), grid(spark, sf))),
    )


def _spot(entity: str, a: int, b: int):
    return ((F.col(entity) * a + F.col("frame") * b) % 2000) / 100.0


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Bound center-anion pairs with reference positions in a cubic box."""
    bound = contacts(spark, sf).filter(F.col("ligand_kind") == ct.ANION)
    return _located(
        bound.groupBy("frame", "center_id", F.col("ligand_id").alias("anion_id"))
        .agg(
            F.count(F.lit(1)).alias("n_sites"),
            F.min("distance").alias("min_distance"),
            F.avg("distance").alias("mean_distance"),
        )
    )


def _located(bound: DataFrame) -> DataFrame:
    return bound.withColumns(
        {
            "cx": _spot("center_id", 7919, 104729),
            "cy": _spot("center_id", 6101, 15485863),
            "cz": _spot("center_id", 3571, 49979687),
            "ax": _spot("anion_id", 7907, 104723),
            "ay": _spot("anion_id", 6089, 15485857),
            "az": _spot("anion_id", 3559, 49979681),
            "box": F.lit(BOX),
        }
    )


def touching(spark: SparkSession, sf: str) -> DataFrame:
    """Center and anion of every contact with an anion, once per site."""
    return contacts(spark, sf).filter(F.col("ligand_kind") == ct.ANION).select(
        "frame", "center_id", F.col("ligand_id").alias("anion_id")
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return touching(spark, sf).distinct()


def track(spark: SparkSession, sf: str) -> DataFrame:
    """Wrapped positions per user; frame = order of the user's events."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    ev = ev.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    # Events of a user have distinct microsecond stamps; chunks of one day keep hot users split.
    ranked = ordinals(ev, ["user_id"], "__us", "frame", chunk=86_400_000_000)
    species = (
        F.when(F.col("user_id") % 3 == 0, "metal")
        .when(F.col("user_id") % 3 == 1, "cation")
        .otherwise("anion")
    )
    return ranked.select(
        "frame",
        F.col("user_id").alias("entity_id"),
        species.alias("species"),
        (F.col("value") % BOX).alias("x"),
        ((F.col("event_id") * 7919) % 2000 / 100.0).alias("y"),
        ((F.col("event_id") * 104729) % 2000 / 100.0).alias("z"),
        F.lit(BOX).alias("box"),
    )


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Points for the radius join in a cubic box of 30."""
    e = table(spark, sf, "embeddings")
    coord = {c: e.embedding[i].cast("double") * 30 + 15 for i, c in enumerate("xyz")}
    role = F.when(e.label < 3, "center").when(e.label < 7, "polymer").otherwise("anion")
    return e.select(
        (e.vec_id % 5).alias("frame"),
        e.vec_id.alias("site_id"),
        role.alias("role"),
        (e.vec_id % 40).alias("ligand_id"),
        *[v.alias(c) for c, v in coord.items()],
        F.lit(30.0).alias("box"),
    )


_SHARED: dict[tuple, DataFrame] = {}


def _versions(spark: SparkSession, sf: str) -> tuple:
    """Name, length and time of everything in the folder, so a changed table is staged anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed))


def shared(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Stage tables are written once per application and read by every query that needs them."""
    key = (spark.sparkContext.applicationId, sf, name, _versions(spark, sf))
    if key not in _SHARED:
        _SHARED[key] = staged(build(), name)
    return _SHARED[key]


GAINS = ("gx", "gy", "gz")


def gain_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Bound pairs as edges with the image gain of the center-to-anion step."""
    return aggregates.image_gains(pairs(spark, sf))


#: The slanted box of the views below: edge lengths and angles.
SLANTED = (20.0, 22.0, 18.0, 80.0, 95.0, 70.0)


def slanted(df: DataFrame) -> DataFrame:
    """``df`` in a slanted box, the same in every frame."""
    return df.drop("box").withColumns({n: F.lit(x) for n, x in zip(BOX_COLUMNS, SLANTED)})


def slanted_edges(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.image_gains(slanted(pairs(spark, sf)), BOX_COLUMNS)


def slanted_labels(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "slanted_labels", lambda: comp.label_centers(aggregates.image_gains(slanted(_located(touching(spark, sf))), BOX_COLUMNS), GAINS))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Component label and image offset of every coordinated center."""
    return shared(
        spark, sf, "labels", lambda: comp.label_centers(aggregates.image_gains(_located(touching(spark, sf))), GAINS)
    )


def components(spark: SparkSession, sf: str, every_center: bool) -> DataFrame:
    return comp.contact_components(
        touching(spark, sf), grid(spark, sf) if every_center else None, labels(spark, sf)
    )


def _placed(cells: DataFrame) -> DataFrame:
    """Cells with the wrapped position of their center in a cubic box."""
    return cells.withColumns(
        {
            "x": _spot("center_id", 7919, 104729),
            "y": _spot("center_id", 6101, 15485863),
            "z": _spot("center_id", 3571, 49979687),
            "box": F.lit(BOX),
        }
    )


def located_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every center in every week with its wrapped position."""
    return _placed(grid(spark, sf))


def center_track(spark: SparkSession, sf: str) -> DataFrame:
    """Every center in every week: wrapped position, state and cluster flag."""
    nodes = components(spark, sf, True)
    sizes = nodes.groupBy("frame", "root").agg(
        (F.count(F.when(F.col("kind") == "center", 1)) >= 2).cast("int").alias("is_clustered")
    )
    where = nodes.filter(F.col("kind") == "center").select(
        "frame", "root", F.col("node_id").alias("center_id")
    )
    flags = where.join(sizes, ["frame", "root"]).select("frame", "center_id", "is_clustered")
    return _placed(states(spark, sf).select("frame", "center_id", "state").join(flags, ["frame", "center_id"]))
