"""Centroid clustering of integer vectors by JVM expressions.

Components become integers, so distances and sums are exact and a run repeats on any partitioning. A
round is one pass over the written vectors: the centroids stand in the plan as literal arrays,
``zip_with`` and ``aggregate`` give the squared distances, ``array_min`` over (distance, number) picks
the nearest, and one grouped sum per component, combined map-side, moves the centroids. Only these
sums, one row per centroid, reach the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.session import staged

#: Components are held within these bounds (|x| <= 131072 at the scale of 1024): any squared distance of 64 of them fits in a long.
LIMIT = 1 << 27

Centroid = tuple[int, ...]


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every vector of ``dims`` components that are all finite; other vectors are left out."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), c * F.lit(float(scale))))
    rows = vectors.filter((F.size("embedding") == dims) & finite)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(held(c)).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[Centroid]:
    """The vectors of the ``k`` smallest hashes of seed and id; a null id counts as an empty text, equal hashes go by vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [tuple(r[0]) for r in rows.select("v", key.alias("h")).orderBy("h", "v").limit(k).select("v").collect()]


def nearest(centroids: list[Centroid]) -> Column:
    """Struct (distance, cluster) of the nearest centroid to ``v``; ties go to the smaller number."""

    def distance(c: Centroid) -> Column:
        squares = F.zip_with("v", F.expr(f"array({','.join(f'{x}L' for x in c)})"), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda s, x: s + x)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(j).alias("cluster")) for j, c in enumerate(centroids)]))


def moved(rows: DataFrame, centroids: list[Centroid]) -> list[Centroid]:
    """One round: every centroid goes to the floor of the mean of its vectors; one without vectors stays."""
    dims = len(centroids[0])
    sums = [F.expr(f"sum(cast(v[{i}] AS bigint)) AS s{i}") for i in range(dims)]
    groups = rows.select(nearest(centroids)["cluster"].alias("cluster"), "v").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums)
    out = list(centroids)
    for row in groups.collect():
        out[row["cluster"]] = tuple(row[f"s{i}"] // row["n"] for i in range(dims))
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024
) -> tuple[DataFrame, list[Centroid]]:
    """((vec_id, cluster, distance) of every kept vector, final centroids).

    Defined cases: vectors that are null, of another length, or that hold null, NaN or infinite
    components are left out; components beyond ``LIMIT`` are held there; repeated rows count as often
    as they stand; of fewer than ``k`` vectors each is a centroid; equal starting vectors leave the
    later centroid empty, where it stays; an empty table gives an empty result; other columns are
    not read.
    """
    rows = staged(integer_vectors(vectors, dims, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        after = moved(rows, centroids)
        if after == centroids:
            break
        centroids = after
    return staged(rows.select("vec_id", nearest(centroids).alias("c")).select("vec_id", "c.cluster", "c.distance"), "assigned"), centroids


def clusters_with_inertia(vectors: DataFrame, **options: int) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector; cases as in ``cluster_vectors``.

    A sum of distances beyond a long is null.
    """
    rows, centroids = cluster_vectors(vectors, **options)
    text = [",".join(map(str, c)) for c in centroids]
    digests = [(j, hashlib.sha256(t.encode()).hexdigest()) for j, t in enumerate(text)]
    names = rows.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # One row per centroid on this side: k rows whatever the table holds.
    sums = [tuple(r) for r in rows.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()]
    whole = None if any(s is None for _, s in sums) or sum(s for _, s in sums) >= 1 << 63 else sum(s for _, s in sums)
    inertia = rows.sparkSession.createDataFrame([(c, s, whole) for c, s in sums], "cluster int, cluster_inertia long, inertia long")
    return rows.join(F.broadcast(inertia.join(names, "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
