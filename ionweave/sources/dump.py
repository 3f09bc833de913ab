"""Trajectory text dumps: one text record per frame, parsed JVM-side into atom rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.operators.ordered import ordinals

# Section heads and coordinate column names of the dump format.
FRAME_MARK = "ITEM: TIMESTEP\n"
BOUNDS_HEAD = "ITEM: BOX BOUNDS"
ATOMS_HEAD = "ITEM: ATOMS "
UNWRAPPED = (("xu", "yu", "zu"), ("xsu", "ysu", "zsu"))
WRAPPED = (("x", "y", "z"), ("xs", "ys", "zs"))


def coordinate_mode(columns: Column) -> Column:
    """``unwrapped`` or ``wrapped`` from the header's column names; unwrapped wins, neither is an error."""

    def has(names: tuple[str, str, str]) -> Column:
        return F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(columns, n))

    return (
        F.when(has(UNWRAPPED[0]) | has(UNWRAPPED[1]), "unwrapped")
        .when(has(WRAPPED[0]) | has(WRAPPED[1]), "wrapped")
        .otherwise(F.raise_error(F.lit("no known coordinate columns")).cast("string"))
    )


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Atom rows ``frame, step, atom_id, type, x, y, z, box_a, box_b, box_c, mode, alpha, beta, gamma``.

    ``frame`` is the 0-based order of the steps.  Each frame is one input record, so files are
    split at frame marks and frames parse in parallel.  Box lengths and angles (degrees) are those of
    the edges; the bounds of tilted boxes are restored from those of their extent.
    """
    text = spark.read.option("lineSep", FRAME_MARK).text(path)
    return parse_dump(text)


def parse_dump(text: DataFrame) -> DataFrame:
    """Parse records whose ``value`` is the text of one frame after its mark."""
    lines = F.filter(F.split("value", "\n"), lambda v: F.length(F.trim(v)) > 0)
    records = (
        text.filter(F.length(F.trim("value")) > 0)
        .select(lines.alias("l"))
        .select(
            F.trim(F.element_at("l", 1)).cast("bigint").alias("step"),
            F.array_position(F.transform("l", lambda v: v.startswith(BOUNDS_HEAD)), True)
            .cast("int").alias("b"),
            F.array_position(F.transform("l", lambda v: v.startswith(ATOMS_HEAD)), True)
            .cast("int").alias("a"),
            "l",
        )
        .select(
            "step",
            F.split(F.trim(F.regexp_replace(F.element_at("l", F.col("a")), ATOMS_HEAD, "")), " +").alias("cols"),
            F.transform(F.slice("l", F.col("b") + 1, 3), lambda v: F.split(F.trim(v), " +").cast("array<double>")).alias("bounds"),
            F.element_at("l", F.col("b")).contains("abc origin").alias("general"),
            F.slice("l", F.col("a") + 1, F.size("l")).alias("atoms"),
        )
    )
    frames = ordinals(records.select("step").distinct(), [], "step", "frame", chunk=1_000_000)
    atoms = records.join(frames, "step").select(
        "frame", "step", "cols", coordinate_mode(F.col("cols")).alias("mode"),
        F.when(F.col("general"), F.raise_error(F.lit("boxes by edge vectors are not read")).cast("array<array<double>>")).otherwise(F.col("bounds")).alias("bounds"),
        F.explode("atoms").alias("line"),
    ).withColumn("v", F.split(F.trim("line"), " +"))

    def value(name: str) -> Column:
        at = F.array_position("cols", name).cast("int")
        return F.when(at > 0, F.get("v", at - 1))

    bound = lambda axis, at: F.col("bounds")[axis][at]
    xy, xz, yz = (F.coalesce(F.get(F.col("bounds")[i], F.lit(2)), F.lit(0.0)) for i in range(3))
    none = F.lit(0.0)
    shifts = [(none, xy, xz, xy + xz), (none, yz), (none, none)]
    lows = [bound(i, 0) - F.least(*t) for i, t in enumerate(shifts)]
    lengths = [bound(i, 1) - F.greatest(*t) - lows[i] for i, t in enumerate(shifts)]
    tilts = [((1, xy), (2, xz)), ((2, yz),), ()]

    def coordinate(axis: int) -> Column:
        plain = lambda names: value(names[axis]).cast("double")
        tilted = lambda names: [value(names[k]).cast("double") * t for k, t in tilts[axis]]
        scaled = lambda names: sum(tilted(names), lows[axis] + plain(names) * lengths[axis])
        return F.coalesce(
            plain(UNWRAPPED[0]), scaled(UNWRAPPED[1]), plain(WRAPPED[0]), scaled(WRAPPED[1])
        )

    a, b, c = lengths[0], F.sqrt(lengths[1] ** 2 + xy**2), F.sqrt(lengths[2] ** 2 + xz**2 + yz**2)
    edge = {"box_a": a, "box_b": b, "box_c": c}
    cosines = {"alpha": (xy * xz + lengths[1] * yz) / (b * c), "beta": xz / c, "gamma": xy / b}
    return atoms.select(
        "frame", "step",
        value("id").cast("bigint").alias("atom_id"),
        value("type").cast("int").alias("type"),
        *[coordinate(i).alias(c) for i, c in enumerate("xyz")],
        *[c.alias(n) for n, c in edge.items()],
        "mode",
        *[F.degrees(F.acos(v)).alias(n) for n, v in cosines.items()],
    )
