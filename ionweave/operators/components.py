"""Connected components of the center-anion graph, with optional periodic winding.

Only anions with several centers link anything: edges of others are left out at once. A round hooks
every center to the smallest center seen through a shared anion, follows the hooks to their roots by pointer
doubling and puts the roots in place of the centers, so that the next round has the edges between
roots that are still linked. Rows shrink at least by half every second round, whatever the length of a component.
When an edge carries integer image gains, each hook also carries the image offset of its center relative to the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.operators.ordered import ordinals
from ionweave.session import staged


def _linked(edges: DataFrame, gains: Sequence[str]) -> DataFrame:
    """Edges, repeats removed, of the anions with several centers, each with ``best``, the smallest center there."""
    key = ["frame", "anion_id"]
    rows = edges.repartition(*key).groupBy(*key, "center_id").agg(F.min(F.struct("center_id", *gains)).alias("at"))
    best = rows.groupBy(*key).agg(F.min("at").alias("best"), F.max("center_id").alias("__last"))
    return rows.join(best.filter(F.col("best.center_id") < F.col("__last")).drop("__last"), key).select(
        *key, "center_id", *[F.col(f"at.{g}").alias(g) for g in gains], "best"
    )


def _rooted(hooks: DataFrame, offs: Sequence[str]) -> DataFrame:
    """Hooks (frame, center_id, root, offsets) followed to their roots, which are hooked to nothing."""
    done, left = [], staged(hooks, "hooks")
    while True:
        up = reduce(DataFrame.unionByName, [*done, left]).select(
            "frame", F.col("center_id").alias("root"), F.col("root").alias("__up"), *[F.col(o).alias(f"__{o}") for o in offs]
        )
        far = staged(
            left.join(up, ["frame", "root"], "left").select(
                "frame", "center_id", F.coalesce("__up", "root").alias("root"),
                *[(F.col(o) + F.coalesce(F.col(f"__{o}"), F.lit(0))).alias(o) for o in offs],
                F.col("__up").isNotNull().alias("__hooked"),
            ), "hooks",
        )
        done.append(far.filter("not __hooked").drop("__hooked"))
        left = far.filter("__hooked").drop("__hooked")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)


def label_centers(edges: DataFrame, gains: Sequence[str] = ()) -> DataFrame:
    """(frame, center_id, root[, o_<gain>...]): root is the smallest center of the component.

    ``edges`` has (frame, center_id, anion_id) rows; a gain is the number of boxes
    added when walking from the center to the anion.
    """
    gains = list(gains)
    offs = [f"o_{g}" for g in gains]
    rounds = []
    linked = staged(_linked(edges.select("frame", "center_id", "anion_id", *gains), gains), "linked")
    while not linked.isEmpty():
        to = F.struct(F.col("best.center_id").alias("root"), *[(F.col(f"best.{g}") - F.col(g)).alias(f"o_{g}") for g in gains])
        hooks = linked.filter(F.col("best.center_id") < F.col("center_id")).groupBy("frame", "center_id").agg(F.min(to).alias("to"))
        rounds.append(_rooted(hooks.select("frame", "center_id", "to.*"), offs))
        moved = linked.drop("best").join(rounds[-1], ["frame", "center_id"], "left").select(
            "frame", F.coalesce("root", "center_id").alias("center_id"), "anion_id",
            *[(F.col(g) + F.coalesce(F.col(f"o_{g}"), F.lit(0))).alias(g) for g in gains],
        )
        linked = staged(_linked(moved, gains), "linked")
    centers = edges.select("frame", "center_id").distinct()
    if not rounds:
        return centers.select("frame", "center_id", F.col("center_id").alias("root"), *[F.lit(0).cast("long").alias(o) for o in offs])
    # A center leaves the graph in the round that hooks it, so the rounds together are hooks once more.
    roots = rounds[0] if len(rounds) == 1 else _rooted(reduce(DataFrame.unionByName, rounds), offs)
    return centers.join(roots, ["frame", "center_id"], "left").select(
        "frame", "center_id", F.coalesce("root", "center_id").alias("root"), *[F.coalesce(F.col(o), F.lit(0)).cast("long").alias(o) for o in offs]
    )


def label_anions(edges: DataFrame, labels: DataFrame, gains: Sequence[str] = ()) -> DataFrame:
    """(frame, anion_id, root[, o_<gain>...]) read off the center labels."""
    best = edges.join(labels, ["frame", "center_id"]).groupBy("frame", "anion_id").agg(
        F.min(F.struct("root", *[(F.col(f"o_{g}") + F.col(g)).alias(f"o_{g}") for g in gains])).alias("b")
    )
    return best.select("frame", "anion_id", "b.root", *[F.col(f"b.o_{g}") for g in gains])


def contact_components(
    edges: DataFrame, grid: DataFrame | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """(frame, kind, node_id, root): every center of ``grid`` is a node, contact or not."""
    labels = label_centers(edges) if labels is None else labels
    labels = labels.select("frame", "center_id", "root")

    def nodes(rows: DataFrame, kind: str, node: str) -> DataFrame:
        return rows.select("frame", "center_id", F.lit(kind).alias("kind"), F.col(node).alias("node_id"))

    # An anion is where any one of its centers is.
    anions = nodes(edges.groupBy("frame", "anion_id").agg(F.min("center_id").alias("center_id")), "anion", "anion_id")
    if grid is None:
        centers = labels.select("frame", F.lit("center").alias("kind"), F.col("center_id").alias("node_id"), "root")
        return centers.unionByName(anions.join(labels, ["frame", "center_id"]).select("frame", "kind", "node_id", "root"))
    moved = labels.filter(F.col("root") != F.col("center_id"))
    return nodes(grid, "center", "center_id").unionByName(anions).join(moved, ["frame", "center_id"], "left").select(
        "frame", "kind", "node_id", F.coalesce("root", "center_id").alias("root")
    )


def cluster_table(components: DataFrame) -> DataFrame:
    """One row per component: counts, rank by smallest center (``cluster_id = frame_rank``)."""
    sizes = components.groupBy("frame", "root").agg(
        F.count(F.when(F.col("kind") == "center", 1)).alias("n_centers"),
        F.count(F.when(F.col("kind") == "anion", 1)).alias("n_anions"),
    )
    ranked = ordinals(sizes, ["frame"], "root", "__k")
    return ranked.select(
        "frame",
        "root",
        F.concat_ws("_", F.col("frame").cast("string"), (F.col("__k") + 1).cast("string")).alias(
            "cluster_id"
        ),
        "n_centers",
        "n_anions",
        (F.col("n_centers") + F.col("n_anions")).alias("n_nodes"),
        (F.col("n_centers") >= 2).cast("int").alias("is_multi_center"),
    )


def cluster_members(components: DataFrame, clusters: DataFrame) -> DataFrame:
    """Member list of ``cluster_table`` in rows."""
    return components.join(clusters.select("frame", "root", "cluster_id"), ["frame", "root"]).select(
        "frame", "cluster_id", "kind", "node_id"
    )
