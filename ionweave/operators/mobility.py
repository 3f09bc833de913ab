"""Unwrapping, drift, shapes and lag-time mobility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions.geometry import Vector, fields, minimum_image, minimum_image_triclinic, vector
from ionweave.functions.states import STATES
from ionweave.operators.ordered import CHUNK, accumulate, lag_pairs, neighbours
from ionweave.operators.quantiles import exact_quantile
from ionweave.session import staged

WARN_STEP = 25.0  # fixed value


def unwrap_bodies(
    df: DataFrame, keys: Sequence[str], order: str, bodies: Mapping[str, tuple[str, str, str]],
    *, box: Sequence[str] = ("box",), rule: str = "current", chunk: int = CHUNK,
) -> DataFrame:
    """Running unwrapped positions of several bodies in one ordered pass.

    ``bodies`` maps an output prefix to its wrapped columns; adds ``<prefix>x/y/z`` and the
    minimum-image step length ``<prefix>step`` (NULL on the first row of a key).  ``box`` is
    one cubic length, three lengths, or three lengths and three angles; ``rule`` takes the box
    of the current row or the mean of previous and current.
    """
    def cell(prev: Column, cur: Column) -> list[Column]:
        now = [cur[b] for b in box]
        if rule == "mean":
            now = [(prev[b] + n) / 2.0 for b, n in zip(box, now)]
        return now * 3 if len(now) == 1 else now

    def step(prev: Column, cur: Column) -> dict[str, Column]:
        out = {"__hop": F.lit(1)}
        for name, xyz in bodies.items():
            d = fields(cur, xyz).minus(fields(prev, xyz))
            lengths = cell(prev, cur)
            moved = (
                minimum_image_triclinic(d, *lengths) if len(lengths) == 6
                else minimum_image(d, Vector(*lengths))
            )
            out |= {f"{name}{a}": m for a, m in zip("xyz", moved)}
        return out

    first = {f"{n}{a}": (lambda head, c=c: head[c]) for n, xyz in bodies.items() for a, c in zip("xyz", xyz)}
    columns = list(dict.fromkeys([c for xyz in bodies.values() for c in xyz] + list(box)))
    done = accumulate(df, keys, order, columns, step, {**first, "__hop": 0}, chunk)
    lengths = {
        f"{n}step": F.when(F.col("__hop") > 0, vector(*[f"{n}{a}_step" for a in "xyz"]).norm()) for n in bodies
    }
    return done.withColumns(lengths).select(*df.columns, *[f"{n}{a}" for n in bodies for a in "xyz"], *lengths)


def unwrap(
    df: DataFrame, keys: Sequence[str], order: str = "frame", *, xyz: tuple[str, str, str] = ("x", "y", "z"),
    box: Sequence[str] = ("box",), rule: str = "current", chunk: int = CHUNK,
) -> DataFrame:
    """Unwrapped ``ux, uy, uz`` of one body and its ``step`` length."""
    return unwrap_bodies(df, keys, order, {"u": xyz}, box=box, rule=rule, chunk=chunk).withColumnRenamed(
        "ustep", "step"
    )


def max_step_audit(unwrapped: DataFrame, species: str = "species", warn: float = WARN_STEP) -> DataFrame:
    return unwrapped.groupBy(species).agg(
        F.max("step").alias("max_step"), (F.max("step") > warn).cast("int").alias("warn")
    )


def remove_drift(df: DataFrame, mass: Column, xyz: tuple[str, str, str] = ("ux", "uy", "uz")) -> DataFrame:
    """Subtract the mass-weighted displacement of all entities since the first frame."""
    center = df.groupBy("frame").agg(
        *[(F.sum(mass * F.col(c)) / F.sum(mass)).alias(f"__{c}") for c in xyz]
    )
    start = center.agg(F.min_by(F.struct(*[f"__{c}" for c in xyz]), "frame").alias("s")).select("s").scalar()
    moved = center.select("frame", *[(F.col(f"__{c}") - start[f"__{c}"]).alias(f"__{c}") for c in xyz])
    shifted = {c: F.col(c) - F.col(f"__{c}") for c in xyz}
    return df.join(moved, "frame").withColumns(shifted).select(*df.columns)


def segment_center(
    sites: DataFrame, chain_keys: Sequence[str], site: str, half_width: int, box: str | Sequence[str] = "box", chunk: int = CHUNK
) -> DataFrame:
    """Mean of the sites within ``half_width`` along a chain, after unwrapping along the chain in a box of one, three or six numbers."""
    walk = unwrap(sites, chain_keys, site, box=(box,) if isinstance(box, str) else tuple(box), chunk=chunk)
    offsets = {f"__n{o + half_width}": o for o in range(-half_width, half_width + 1)}
    near = neighbours(walk, chain_keys, site, offsets, ["ux", "uy", "uz"], chunk)

    def mean(c: str) -> Column:
        found = F.array_compact(F.array(*[F.col(n)[c] for n in offsets]))
        return F.aggregate(found, F.lit(0.0), lambda a, v: a + v) / F.size(found)

    return near.select(*chain_keys, site, *[mean(f"u{a}").alias(f"s{a}") for a in "xyz"])


def radius_of_gyration(
    atoms: DataFrame, chain: str, mass: str = "mass", site: str | None = None, skip: int = 0
) -> DataFrame:
    """Mass-weighted radius of gyration per (frame, chain); the first ``skip`` sites may be left out."""
    rows = atoms if site is None or skip == 0 else atoms.filter(F.col(site) > skip)
    m = F.col(mass)
    com = rows.groupBy("frame", chain).agg(
        F.sum(m).alias("__m"), *[(F.sum(m * F.col(c)) / F.sum(m)).alias(f"__{c}") for c in "xyz"]
    )
    d = vector("x", "y", "z").minus(vector("__x", "__y", "__z"))
    spread = rows.join(com, ["frame", chain]).groupBy("frame", chain).agg(
        F.sqrt(F.sum(m * d.norm2()) / F.sum(m)).alias("rg")
    )
    return spread


def rg_histogram(rg: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Density histogram of radii on [low, high]; empty bins kept; ``n_below``/``n_above`` count radii outside."""
    width = (high - low) / bins
    r = F.col("rg")
    counted = rg.filter((r >= low) & (r <= high)).groupBy(
        F.least(F.floor((r - low) / width), F.lit(bins - 1)).cast("bigint").alias("bin")
    ).agg(F.count(F.lit(1)).alias("count"))
    inside = F.count(F.when((r >= low) & (r <= high), 1))
    ends = rg.agg(F.struct(inside.alias("n"), F.count(F.when(r < low, 1)).alias("low"), F.count(F.when(r > high, 1)).alias("high")).alias("e"))
    ends = ends.select("e").scalar()
    total = ends["n"]
    return rg.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left").select(
        "bin", (low + (F.col("bin") + 0.5) * width).alias("center"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / (total * width)).alias("density"), ends["low"].alias("n_below"), ends["high"].alias("n_above"),
    )


def displacements(
    positions: DataFrame, keys: Sequence[str], ordinal: str, lags: Sequence[int], start: Sequence[str] = (),
    stride: int = 1, **kw,
) -> DataFrame:
    """Lag pairs with their squared displacement ``r2``."""
    pairs = lag_pairs(
        positions, keys, ordinal, lags, [*start, "ux", "uy", "uz"], ["ux", "uy", "uz"], stride=stride, **kw
    )
    r2 = vector("end_ux", "end_uy", "end_uz").minus(vector("ux", "uy", "uz")).norm2()
    return pairs.withColumn("r2", r2)


def msd_ngp(
    positions: DataFrame, lags: Sequence[int], *, entity: str = "entity_id", ordinal: str = "frame", stride: int = 1
) -> DataFrame:
    """Mean squared and quartic displacement and the non-Gaussian parameter per species and lag."""
    r2 = F.col("r2")
    sums = displacements(positions, [entity], ordinal, lags, ["species"], stride).groupBy("species", "lag").agg(
        F.avg(r2).alias("msd"), F.avg(r2 * r2).alias("r4"), F.count(F.lit(1)).alias("n")
    )
    return sums.withColumn(
        "alpha2", F.when(F.col("msd") > 0, 3.0 * F.col("r4") / (5.0 * F.col("msd") * F.col("msd")) - 1.0)
    )


def msd_exponent(msd: DataFrame) -> DataFrame:
    """Local slope d ln(msd) / d ln(lag): three-point in the middle, one-sided at the ends.

    The windows run over the few lags of a species.
    """
    ok = msd.filter((F.col("msd") > 0) & (F.col("lag") > 0)).withColumns(
        {"__x": F.log(F.col("lag").cast("double")), "__y": F.log("msd")}
    )
    w = Window.partitionBy("species").orderBy("lag")
    n = F.count(F.lit(1)).over(Window.partitionBy("species"))
    x0, y0, x1, y1 = F.lag("__x").over(w), F.lag("__y").over(w), F.lead("__x").over(w), F.lead("__y").over(w)
    hs, hd = F.col("__x") - x0, x1 - F.col("__x")
    y = F.col("__y")
    inner = (hs * hs * y1 + (hd * hd - hs * hs) * y - hd * hd * y0) / (hs * hd * (hs + hd))
    slope = F.when(x0.isNull(), (y1 - y) / hd).when(x1.isNull(), (y - y0) / hs).otherwise(inner)
    beta = ok.withColumn("beta", F.when(n >= 3, slope)).select("species", "lag", "beta")
    return msd.join(beta, ["species", "lag"], "left")


def ngp_peak(msd: DataFrame, dt_ps: float) -> DataFrame:
    """Lag of the largest non-Gaussian parameter per species; the first one on ties."""
    best = msd.filter(F.col("alpha2").isNotNull()).groupBy("species").agg(
        F.max(F.struct(F.col("alpha2"), (-F.col("lag")).alias("back"), F.col("msd"))).alias("b")
    )
    return best.select(
        "species", F.col("b.alpha2").alias("alpha2_max"), (-F.col("b.back") * dt_ps).alias("time_ps"),
        F.col("b.msd").alias("msd"),
    )


def self_van_hove(
    positions: DataFrame, lags: Sequence[int], *, width: float = 0.1, bins: int = 300, stride: int = 1,
    entity: str = "entity_id", ordinal: str = "frame",
) -> DataFrame:
    """Radial displacement histogram per species and lag.

    The density divides by in-range samples; ``n_samples`` counts all of them and ``n_above`` those beyond the last bin.
    A bin holds its lower edge, in millionths of a bin: the last bits of unwrapped positions decide no bin.
    """
    place = F.rint(F.sqrt("r2") / width * 1.0e6) / 1.0e6
    r = displacements(positions, [entity], ordinal, lags, ["species"], stride).select("species", "lag", place.alias("place"))
    bin_of = F.when(F.col("place") <= bins, F.least(F.floor("place"), F.lit(bins - 1)).cast("bigint")).otherwise(F.lit(-1))
    counts = r.groupBy("species", "lag", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("species", "lag").agg(
        F.sum("c").alias("n_samples"), F.sum(F.when(F.col("bin") >= 0, F.col("c"))).alias("__in")
    )
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")))
    return grid.join(counts, ["species", "lag", "bin"], "left").select(
        "species", "lag", ((F.col("bin") + 0.5) * width).alias("r"),
        (F.coalesce("c", F.lit(0)) / (F.col("__in") * width)).alias("density"), "n_samples",
        (F.col("n_samples") - F.coalesce("__in", F.lit(0))).alias("n_above"),
    )


def conditioned_msd(
    positions: DataFrame, lags: Sequence[int], *, min_samples: int = 100, stride: int = 1,
    entity: str = "center_id", ordinal: str = "frame", state: str = "state", clustered: str = "is_clustered",
) -> DataFrame:
    """MSD by state and by clustered or isolated, at the origin and over the whole lag.

    ``persistent`` needs the condition at every frame of [t, t+lag]; that is a difference of
    running counts, so no interval is scanned.  ``is_supported`` marks at least ``min_samples`` samples.
    """
    tests = {f"state_{s}": F.col(state) == s for s in STATES}
    tests["isolated"] = F.col(clustered) == 0
    tests["clustered"] = F.col(clustered) == 1
    flagged = positions.withColumns({f"c_{n}": t.cast("long") for n, t in tests.items()})
    flags = [f"c_{n}" for n in tests]
    pairs = displacements(
        flagged, [entity], ordinal, lags, flags, stride, between={f"k_{n}": F.col(f"c_{n}") for n in tests}
    )
    marks = {}
    for n in tests:
        marks[n, "initial"] = F.col(f"c_{n}") == 1
        marks[n, "persistent"] = marks[n, "initial"] & (F.col(f"k_{n}") == F.col("lag"))
    # One narrow row per lag pair, read three times: sums, brackets and ranks.
    mask = sum((m.cast("int") * (1 << i) for i, m in enumerate(marks.values())), F.lit(0))
    narrow = staged(pairs.select("lag", "r2", mask.alias("mask")), "lag_pairs")
    has = [F.col("mask").bitwiseAND(1 << i) > 0 for i in range(len(marks))]
    sums = narrow.groupBy("lag").agg(F.array(*[
        F.struct(F.sum(F.when(h, F.col("r2"))).alias("s"), F.count(F.when(h, 1)).alias("n")) for h in has
    ]).alias("cells"))
    names = F.array(*[F.struct(F.lit(n).alias("category"), F.lit(r).alias("rule")) for n, r in marks])
    by = ["category", "rule", "lag"]
    mean = sums.select("lag", F.explode(F.arrays_zip(names.alias("g"), F.col("cells"))).alias("x")).select(
        "x.g.category", "x.g.rule", "lag", (F.col("x.cells.s") / F.col("x.cells.n")).alias("msd"), F.col("x.cells.n").alias("n")
    )
    # Copies exist between the read and the map-side counts of the quantile only.
    own = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(n).alias("category"), F.lit(r).alias("rule"))) for h, (n, r) in zip(has, marks)]))
    mid = exact_quantile(narrow.select("lag", "r2", F.explode(own).alias("g")).select("g.*", "lag", "r2"), by, "r2", 0.5, "median_r2")
    cells = names
    every = positions.sparkSession.range(1).select(
        F.explode(cells).alias("g")
    ).select("g.category", "g.rule", F.explode(F.array(*[F.lit(int(v)).cast("bigint") for v in lags])).alias("lag"))
    enough = F.col("n") >= min_samples
    return (
        every.join(mean, by, "left").join(mid, by, "left").fillna(0, ["n"])
        .select(*by, "msd", "median_r2", "n", enough.cast("int").alias("is_supported"))
    )
