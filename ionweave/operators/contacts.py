"""Contact finding and per-frame coordination tables.

A contact is one row per (frame, center_id, ligand_kind, ligand_id, site_index) with its
distance; ``ligand_kind`` is ``polymer`` (ligand = chain) or ``anion``.  Member sets are kept
as rows, not as arrays, so a hot ligand or component never has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ionweave.functions.geometry import BOX_COLUMNS, Cell, Vector, box_cell, cartesian, fractional, heights, minimum_image, vector
from ionweave.functions.states import coordination_state
from ionweave.operators.ordered import accumulate, ordinals

POLYMER, ANION = "polymer", "anion"
LOCAL_SEPARATION = 4  # fixed value: sites at most this far apart on a chain form a local bridge


def contact_join(
    centers: DataFrame, sites: DataFrame, cutoff: float, box: str = "box"
) -> DataFrame:
    """All (center, site) pairs of a frame within ``cutoff`` under a cubic periodic box.

    Space is cut into cells at least ``cutoff`` wide; each center is copied to its 27
    neighbouring cells (repeats removed in small boxes) and joined on (frame, cell).
    Expects ``frame, center_id, x, y, z, box`` and ``frame, site_id, x, y, z``.
    """
    length = F.col(box)
    n_cells = F.greatest(F.floor(length / cutoff), F.lit(1)).cast("long")

    def cell(c: str) -> Column:
        return F.pmod(F.floor(F.col(c) / (length / n_cells)).cast("long"), n_cells)

    around = F.array(*[F.lit(v).cast("long") for v in (-1, 0, 1)])

    def near(c: str) -> Column:
        return F.array_distinct(F.transform(around, lambda o: F.pmod(cell(c) + o, n_cells)))

    c = (
        centers.withColumn("__cx", F.explode(near("x")))
        .withColumn("__cy", F.explode(near("y")))
        .withColumn("__cz", F.explode(near("z")))
        .select(
            "frame", "center_id", "__cx", "__cy", "__cz", length.alias("__box"),
            *[F.col(v).alias(f"__c{v}{v}") for v in "xyz"],
        )
    )
    s = sites.select(
        *[F.col(col) for col in sites.columns],
        cell("x").alias("__cx"), cell("y").alias("__cy"), cell("z").alias("__cz"),
    )
    d = minimum_image(
        vector("x", "y", "z").minus(vector("__cxx", "__cyy", "__czz")),
        Vector(*[F.col("__box")] * 3),
    )
    kept = [v for v in sites.columns if v not in ("x", "y", "z", box)]
    return (
        c.join(s, ["frame", "__cx", "__cy", "__cz"])
        .withColumn("distance", d.norm())
        .filter(F.col("distance") <= cutoff)
        .select("center_id", *kept, "distance")
    )


def _placed(rows: DataFrame, kept: Sequence[str], cutoff: float, box: Sequence[str]) -> DataFrame:
    """``kept`` with the wrapped position ``__w``, the cell matrix ``__b*``, and the cell index ``__c*``, cell count ``__n*`` and reach ``__m*`` along the edges."""
    wide = cutoff * (1 + 1e-9)
    names = {c: [f"__{c}{a}" for a in (Cell._fields if c == "b" else "xyz")] for c in "bfhincm"}

    def named(c: str, cols: Sequence[Column]) -> list[Column]:
        return [v.alias(n) for v, n in zip(cols, names[c])]

    # Step by step, each from columns of the one before: written out at once, the expressions grow to megabytes.
    cell, f, high, inside, n = Cell(*map(F.col, names["b"])), *(Vector(*map(F.col, names[c])) for c in "fhin")
    rows = rows.select(*kept, *[F.col(a).alias(f"__{a}") for a in "xyz"], *named("b", box_cell(box)))
    rows = rows.select(*kept, *names["b"], *named("f", fractional(vector("__x", "__y", "__z"), cell)), *named("h", heights(cell)))
    counts = [F.greatest(F.floor(h / wide), F.lit(1)).cast("long") for h in high]
    rows = rows.select(*kept, *names["b"], *names["h"], *named("i", [v - F.floor(v) for v in f]), *named("n", counts))
    reach = [F.ceil(F.lit(wide) * k / h).cast("long") for k, h in zip(n, high)]
    index = [F.least(F.floor(v * k).cast("long"), k - 1) for v, k in zip(inside, n)]
    where = F.struct(*[v.alias(a) for v, a in zip(cartesian(inside, cell), "xyz")]).alias("__w")
    return rows.select(*kept, where, *named("c", index), *names["n"], *named("m", reach), *names["b"])


#: Rows of a cell that one block holds; a block of centers meets a block of sites at once.
PART = 512


def _blocks(rows: DataFrame, by: Sequence[str], key: str, held: Column) -> DataFrame:
    """Rows of equal ``by`` gathered in arrays ``held`` of about ``PART``, dealt by a hash of ``key``."""
    many = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("long").alias("__parts"))
    dealt = rows.join(many.filter("__parts > 1"), list(by), "left").withColumn("__parts", F.coalesce("__parts", F.lit(1).cast("long")))
    block = F.pmod(F.xxhash64(key), F.col("__parts")).alias("__part")
    return dealt.groupBy(*by, "__parts", block).agg(F.collect_list(held).alias("__held"))


def contact_join_cell(centers: DataFrame, sites: DataFrame, cutoff: float, box: Sequence[str] = BOX_COLUMNS) -> DataFrame:
    """All (center, site) pairs of a frame within ``cutoff``, with the distance of the nearest image, in a box of any shape.

    Cells are cut in fractional coordinates, at least ``cutoff`` wide between the faces of the box. A
    center is copied to the cells around its own, each with the number of boxes crossed to get
    there. Along an edge with fewer than three cells it meets every cell once, and the
    nearest of the images there counts. The rows of a cell stand in blocks of about ``PART``; blocks are joined on (frame, cell), and the
    pairs of two blocks are compared at once where they meet, so only pairs within the cutoff are ever rows. ``box`` names one length, three lengths, or three lengths and three angles, which
    both tables have; a missing number is an error. Expects ``frame, center_id, x, y, z`` and ``frame, site_id, x, y, z``.
    """
    one = F.lit(1).cast("long")

    def few(a: str) -> Column:
        return F.col(f"__n{a}") < 3

    def around(a: str) -> Column:
        low, high = F.col(f"__c{a}") - F.col(f"__m{a}"), F.col(f"__c{a}") + F.col(f"__m{a}")
        return F.sequence(F.when(few(a), 0 * one).otherwise(low), F.when(few(a), F.col(f"__n{a}") - 1).otherwise(high))

    place = [f"__c{a}" for a in "xyz"]
    c = _placed(centers, ["frame", "center_id"], cutoff, box).withColumnRenamed("__w", "__o")
    for a in "xyz":
        c = c.withColumn(f"__u{a}", F.explode(around(a)))
    home = {a: F.pmod(F.col(f"__u{a}"), F.col(f"__n{a}")) for a in "xyz"}
    image = [((F.col(f"__u{a}") - home[a]) / F.col(f"__n{a}")).cast("long").alias(f"__k{a}") for a in "yz"]
    # Images searched on both sides of the own one: none along an edge of three cells or more.
    reach = [F.when(F.col(f"__n{a}") == 1, F.col(f"__m{a}")).when(few(a), one).otherwise(0 * one).alias(f"__r{a}") for a in "yz"]
    numbers = ["__ky", "__kz", "__ry", "__rz", *(f"__b{n}" for n in Cell._fields)]
    c = c.select("frame", "center_id", "__o", *[home[a].alias(f"__c{a}") for a in "xyz"], *image, *reach, *[f"__b{n}" for n in Cell._fields])
    kept = [v for v in sites.columns if v not in ("frame", "x", "y", "z", *box)]
    s = _placed(sites, ["frame", *kept], cutoff, box).select("frame", *kept, "__w", *place)
    where = ["frame", *place]
    # Centers of a block share the images they look at and the box.
    c = _blocks(c, [*where, *numbers], "center_id", F.struct("center_id", "__o.x", "__o.y", "__o.z")).withColumnRenamed("__held", "__near").drop("__part", "__parts")
    s = _blocks(s, where, "site_id", F.struct(F.col("__w.x").alias("__x"), F.col("__w.y").alias("__y"), F.col("__w.z").alias("__z"), *kept))
    # Each block of sites is a key of its own, so that a few full cells fill many tasks.
    parts = s.groupBy(*where).agg(F.max("__parts").alias("__parts"))
    c = c.join(parts, where).withColumn("__part", F.explode(F.sequence(0 * one, F.col("__parts") - 1))).drop("__parts")
    # Few bytes make many pairs: the number of tasks is kept, whatever the bytes.
    tasks = int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*where, "__part"]
    met = c.repartition(tasks, *keys).join(s.drop("__parts").repartition(tasks, *keys), keys).select("frame", "__near", "__held", *numbers)
    names = [*[v for v in sites.columns if v in ("frame", *kept)]]
    fields = [centers.schema["center_id"], *[sites.schema[v] for v in names], StructField("distance", DoubleType())]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                near, held = (batch.column(k).slice(row, 1).flatten() for k in (1, 2))
                ky, kz, ry, rz, ax, bx, by, cx, cy, cz = (c[row].as_py() for c in batch.columns[3:])
                near, held = dict(zip([f.name for f in near.type], near.flatten())), dict(zip([f.name for f in held.type], held.flatten()))
                dx, dy, dz = (held[f"__{a}"].to_numpy()[None, :] - near[a].to_numpy()[:, None] for a in "xyz")
                least = np.full(dx.shape, np.inf)
                for k in range(kz - rz, kz + rz + 1):
                    z2 = (dz + k * cz) ** 2
                    for j in range(ky - ry, ky + ry + 1):
                        x = dx + (j * bx + k * cx)
                        x -= np.rint(x / ax) * ax
                        np.minimum(least, x * x + (dy + (j * by + k * cy)) ** 2 + z2, out=least)
                distance = np.sqrt(least)
                i, j = (pa.array(v) for v in np.nonzero(distance <= cutoff))
                if len(i):
                    held["frame"] = pa.array([batch.column(0)[row].as_py()], batch.column(0).type).take(pa.array(np.zeros(held["__x"].__len__(), np.int64)))
                    columns = [near["center_id"].take(i), *[held[v].take(j) for v in names], pa.array(distance[distance <= cutoff])]
                    yield pa.RecordBatch.from_arrays(columns, names=["center_id", *names, "distance"])

    # Images are searched in blocks: as one expression they are too long a method for the JVM to compile.
    return met.mapInArrow(nearest, StructType(fields))


def ligand_contacts(contacts: DataFrame) -> DataFrame:
    """Contacts collapsed to (frame, center, kind, ligand) with denticity and distances."""
    return contacts.groupBy("frame", "center_id", "ligand_kind", "ligand_id").agg(
        F.count(F.lit(1)).alias("denticity"),
        F.min("distance").alias("min_distance"),
        F.avg("distance").alias("mean_distance"),
    )


def coordination_numbers(contacts: DataFrame, grid: DataFrame) -> DataFrame:
    """Distinct sites and ligands per (frame, center); centers without contact keep zeros."""
    return on_grid(ligand_contacts(contacts).groupBy("frame", "center_id").agg(*number_counts()), grid)


NUMBERS = ("n_site", "n_chain", "n_anion_site", "n_anion")


def number_counts() -> list[Column]:
    """Coordination numbers of a center from its rows of ``ligand_contacts``."""
    polymer, anion = F.col("ligand_kind") == POLYMER, F.col("ligand_kind") == ANION
    return [
        F.sum(F.when(polymer, F.col("denticity"))).alias("n_site"),
        F.count(F.when(polymer, F.lit(1))).alias("n_chain"),
        F.sum(F.when(anion, F.col("denticity"))).alias("n_anion_site"),
        F.count(F.when(anion, F.lit(1))).alias("n_anion"),
    ]


def on_grid(counts: DataFrame, grid: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Counts of every cell of ``grid``, zero where there is none, and the sum of the sites."""
    return (
        grid.select("frame", "center_id")
        .join(counts, ["frame", "center_id"], "left")
        .select(
            "frame",
            "center_id",
            *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in (*NUMBERS, *more)],
        )
        .withColumn("n_total", F.col("n_site") + F.col("n_anion_site"))
    )


def with_state(numbers: DataFrame) -> DataFrame:
    """Adds the coordination state from polymer-site and anion-molecule counts."""
    return numbers.withColumn("state", coordination_state(F.col("n_site"), F.col("n_anion")))


def chain_site_index(topology: DataFrame, chain: str = "chain_id", atom: str = "atom_id") -> DataFrame:
    """1-based site index by atom id within each chain."""
    ranked = ordinals(topology, [chain], atom, "__o")
    return ranked.withColumn("site_index", F.col("__o") + 1).drop("__o")


def plausible_chain_keys(topology: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """Which grouping columns look like chain ids: >= 2 groups, fewer than rows, median size >= 2."""
    out = None
    for rank, key in enumerate(candidates):
        sizes = topology.groupBy(F.col(key).cast("string").alias("__k")).agg(
            F.count(F.lit(1)).alias("__n")
        )
        row = sizes.agg(
            F.lit(key).alias("chain_key"),
            F.lit(rank).cast("long").alias("preference"),
            F.count(F.lit(1)).alias("n_groups"),
            F.sum("__n").alias("n_sites"),
            F.median("__n").alias("median_size"),
        )
        out = row if out is None else out.unionByName(row)
    return out.withColumn(
        "plausible",
        (
            (F.col("n_groups") >= 2)
            & (F.col("n_groups") < F.col("n_sites"))
            & (F.col("median_size") >= 2)
        ).cast("int"),
    )


def _polymer(contacts: DataFrame) -> DataFrame:
    return contacts.filter(F.col("ligand_kind") == POLYMER).select(
        "frame", F.col("ligand_id").alias("chain_id"), "center_id", "site_index"
    )


def chain_bridges(contacts: DataFrame, k: int = LOCAL_SEPARATION) -> DataFrame:
    """Local bridges: center pairs on one chain whose closest sites are at most ``k`` apart.

    Sites are matched by an equi-join on stretches of ``4 k`` sites: each site meets those up to ``k`` ahead,
    in its own stretch or, near its end, also in the next one, so rows are copied 1.25 times, not once per site of the band.
    Remote pairs are counted, never listed: see ``chain_occupancy``.
    """
    sites = _polymer(contacts)
    width = F.lit(4 * k + 1)
    near = [F.floor(c / width) for c in (F.col("site_index"), F.col("site_index") + k)]
    left = sites.select(
        "frame", "chain_id", F.col("center_id").alias("__a"), F.col("site_index").alias("__at"),
        F.explode(F.sequence(*near)).alias("__s"),
    )
    right = sites.select(
        "frame", "chain_id", F.col("center_id").alias("__b"), F.col("site_index").alias("__to"), near[0].alias("__s")
    )
    gap = F.col("__to") - F.col("__at")
    # Two centers on one site would meet in both orders.
    once = ((gap > 0) & (gap <= k) & (F.col("__a") != F.col("__b"))) | ((gap == 0) & (F.col("__a") < F.col("__b")))
    return (
        left.join(right, ["frame", "chain_id", "__s"])
        .filter(once)
        .groupBy("frame", "chain_id", F.least("__a", "__b").alias("center_a"), F.greatest("__a", "__b").alias("center_b"))
        .agg(F.min(gap).cast("long").alias("separation"))
    )


def chain_members(contacts: DataFrame) -> DataFrame:
    """One row per (frame, chain, center)."""
    return _polymer(contacts).select("frame", "chain_id", "center_id").distinct()


def min_site_separation(contacts: DataFrame, chunk: int = 20_000) -> DataFrame:
    """Smallest site-index distance between two different centers per (frame, chain).

    The closest two-center pair is always adjacent in site order, so one ordered pass over
    the sites replaces comparing all pairs.  A site held by two centers has distance 0.
    """
    per_site = _polymer(contacts).groupBy("frame", "chain_id", "site_index").agg(
        F.min("center_id").alias("low"), F.max("center_id").alias("high")
    )

    def gap(prev: Column, cur: Column) -> dict[str, Column]:
        differ = (prev["low"] != cur["high"]) | (prev["high"] != cur["low"])
        return {"gap": F.when(differ, cur["site_index"] - prev["site_index"])}

    steps = accumulate(
        per_site, ["frame", "chain_id"], "site_index", ["site_index", "low", "high"],
        gap, {"gap": F.lit(None).cast("long")}, chunk,
    )
    sep = F.when(F.col("low") != F.col("high"), F.lit(0)).otherwise(F.col("gap_step"))
    return steps.groupBy("frame", "chain_id").agg(F.min(sep).cast("long").alias("min_separation"))


def chain_occupancy(
    contacts: DataFrame, chain_grid: DataFrame, k: int = LOCAL_SEPARATION
) -> DataFrame:
    """One row per frame and every chain, empty chains included."""
    n = chain_members(contacts).groupBy("frame", "chain_id").agg(
        F.count(F.lit(1)).alias("n_centers")
    )
    local = chain_bridges(contacts, k).groupBy("frame", "chain_id").agg(
        F.count(F.lit(1)).alias("n_local_pairs")
    )
    key = ["frame", "chain_id"]
    filled = (
        chain_grid.select(*key)
        .join(n, key, "left")
        .join(local, key, "left")
        .join(min_site_separation(contacts), key, "left")
        .fillna(0, ["n_centers", "n_local_pairs"])
    )
    pairs = (F.col("n_centers") * (F.col("n_centers") - 1) / 2).cast("long")
    return filled.select(
        *key,
        "n_centers",
        (F.col("n_centers") >= 2).cast("int").alias("is_shared"),
        pairs.alias("n_pairs"),
        "n_local_pairs",
        (pairs - F.col("n_local_pairs")).alias("n_remote_pairs"),
        (F.col("n_local_pairs") > 0).cast("int").alias("has_local_bridge"),
        (pairs > F.col("n_local_pairs")).cast("int").alias("has_remote_pair"),
        "min_separation",
    )


def ligand_occupancy(contacts: DataFrame, kind: str) -> DataFrame:
    """Distinct centers per coordinated ligand of a kind; ligands without contact are absent."""
    lig = contacts.filter(F.col("ligand_kind") == kind).select(
        "frame", "ligand_id", "center_id"
    ).distinct()
    return lig.groupBy("frame", "ligand_id").agg(F.count(F.lit(1)).alias("n_centers"))


def anion_bridging(contacts: DataFrame) -> DataFrame:
    """Coordinated anions per frame with their number of centers and a bridging flag."""
    return ligand_occupancy(contacts, ANION).select(
        "frame",
        F.col("ligand_id").alias("anion_id"),
        "n_centers",
        (F.col("n_centers") >= 2).cast("int").alias("is_bridging"),
    )


def anion_members(contacts: DataFrame) -> DataFrame:
    """Member list of ``anion_bridging`` in rows: (frame, anion_id, center_id)."""
    return contacts.filter(F.col("ligand_kind") == ANION).select(
        "frame", F.col("ligand_id").alias("anion_id"), "center_id"
    ).distinct()
