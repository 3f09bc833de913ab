"""Bridges and ion aggregates: geometry, percolation, events, transport and lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions.geometry import Vector, box_cell, cartesian, fractional, image_shift, vector
from ionweave.functions.states import center_count_class, lifetime_class, safe_ratio, size_class
from ionweave.operators.blocks import with_share
from ionweave.operators.comotion import EPSILON, _cosine, _moves, body_pairs, ratio_curves, support_flag
from ionweave.operators.components import label_anions
from ionweave.operators.mobility import unwrap_bodies
from ionweave.operators.ordered import accumulate, lag_pairs, ordinals, runs
from ionweave.session import cut

GAINS = ("gx", "gy", "gz")
HALF = 1e-9


# --- bridges --------------------------------------------------------------------------------


def bridge_pairs(edges: DataFrame) -> DataFrame:
    """(anion, two of its centers) per frame.

    Every joined row is a bridge of the result; (frame, anion) keys spread a busy anion over
    its frames and adaptive skew splitting handles a busy key inside one frame.
    """
    a = edges.select("frame", "anion_id", F.col("center_id").alias("center_a"))
    b = edges.select("frame", "anion_id", F.col("center_id").alias("center_b"))
    return a.join(b, ["frame", "anion_id"]).filter(F.col("center_a") < F.col("center_b")).withColumn(
        "bridge_id", F.format_string("T%d_M%d_M%d", "anion_id", "center_a", "center_b")
    )


def _occupied(events: DataFrame, first: Column, last: Column, dt_ps: float) -> DataFrame:
    left = (F.col("start_frame") == first).cast("int")
    right = (F.col("end_frame") == last).cast("int")
    return events.withColumns(
        {
            "occupancy_ps": F.col("n_frames") * F.lit(float(dt_ps)),
            "left_censored": left,
            "right_censored": right,
            "completed": (1 - left) * (1 - right),
        }
    ).withColumn("persistence_class", lifetime_class(F.col("occupancy_ps")))


def bridge_rows(bridges: DataFrame, step: int = 1) -> DataFrame:
    """Bridge rows with their event number and instance id; a frame gap above ``step`` ends an event."""
    key = ["anion_id", "center_a", "center_b"]
    return runs(bridges, key, "frame", step=step).withColumn(
        "instance_id", F.format_string("%s_E%05d", F.col("bridge_id"), F.col("run"))
    )


def bridge_events(rows: DataFrame, first: Column, last: Column, dt_ps: float) -> DataFrame:
    ev = rows.groupBy("instance_id", "bridge_id", "anion_id", "center_a", "center_b").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("n_frames")
    )
    return _occupied(ev, first, last, dt_ps)


BRIDGE_SUMS = (
    "sum_a2", "sum_b2", "sum_t2", "sum_rel2", "sum_mid2", "sum_com2", "sum_tmid2", "sum_ab", "sum_at", "sum_bt", "sum_cos", "n_cos",
)


def bridge_lag_sums(rows: DataFrame, lags: Sequence[int], center_mass: float, anion_mass: float) -> DataFrame:
    """Three-body lag sums per bridge event.

    ``rows`` holds instance_id, frame, positions of both centers (``m1*``, ``m2*``) and the
    anion (``t*``) and the box.
    """
    bodies = {"u1": ("m1x", "m1y", "m1z"), "u2": ("m2x", "m2y", "m2z"), "ut": ("tx", "ty", "tz")}
    walk = unwrap_bodies(rows, ["instance_id"], "frame", bodies, rule="mean")
    m = _moves(tuple(bodies))
    a, b, t = m["u1"], m["u2"], m["ut"]
    mid = a.plus(b).scaled(0.5)
    com = a.plus(b).scaled(center_mass).plus(t.scaled(anion_mass)).scaled(1.0 / (2 * center_mass + anion_mass))
    cos = _cosine(a, b)
    return body_pairs(walk, ["instance_id"], "frame", tuple(bodies), lags).groupBy("instance_id", "lag").agg(
        F.count(F.lit(1)).alias("n_origins"),
        F.sum(a.norm2()).alias("sum_a2"), F.sum(b.norm2()).alias("sum_b2"), F.sum(t.norm2()).alias("sum_t2"),
        F.sum(a.minus(b).norm2()).alias("sum_rel2"), F.sum(mid.norm2()).alias("sum_mid2"),
        F.sum(com.norm2()).alias("sum_com2"), F.sum(t.minus(mid).norm2()).alias("sum_tmid2"),
        F.sum(a.dot(b)).alias("sum_ab"), F.sum(a.dot(t)).alias("sum_at"), F.sum(b.dot(t)).alias("sum_bt"),
        F.coalesce(F.sum(cos), F.lit(0.0)).alias("sum_cos"), F.count(cos).alias("n_cos"),
    )


def bridge_metrics() -> dict[str, Column]:
    c = F.col
    n = c("n_origins")
    a, b, t = (c(k) / n for k in ("sum_a2", "sum_b2", "sum_t2"))
    dot, at, bt = (c(k) / n for k in ("sum_ab", "sum_at", "sum_bt"))
    first, second = safe_ratio(2.0 * at, a + t), safe_ratio(2.0 * bt, b + t)
    known = F.when(first.isNotNull(), 1).otherwise(0) + F.when(second.isNotNull(), 1).otherwise(0)
    zero = F.lit(0.0)
    return {
        "center_a_msd": a, "center_b_msd": b, "anion_msd": t,
        "relative_msd": c("sum_rel2") / n, "midpoint_msd": c("sum_mid2") / n, "com_msd": c("sum_com2") / n,
        "anion_midpoint_msd": c("sum_tmid2") / n,
        "vector_correlation": safe_ratio(dot, F.sqrt(a * b)),
        "alignment": safe_ratio(2.0 * dot, a + b),
        "relative_ratio": safe_ratio(c("sum_rel2") / n, a + b),
        "mean_cosine": safe_ratio(c("sum_cos"), c("n_cos")),
        "anion_alignment": safe_ratio(F.coalesce(first, zero) + F.coalesce(second, zero), known),
    }


def bridge_curves(lag_table: DataFrame, min_events: int = 20, min_origins: int = 200) -> DataFrame:
    return ratio_curves(
        lag_table, {"all": None, "persistence": "persistence_class"}, BRIDGE_SUMS, bridge_metrics(), min_events, min_origins
    )


# Sums over the members before the current one, in order of center id.
_BEFORE = {
    "k": "__one", "old": "__old", "p2": "__p2", "px": "__dx", "py": "__dy", "pz": "__dz",
    "qx": "__ex", "qy": "__ey", "qz": "__ez", "kd": "__has",
}


def bridge_counts(edges: DataFrame) -> DataFrame:
    """Centers and bridges of each anion and frame; bridges are counted, not listed."""
    n = F.count(F.lit(1))
    return edges.groupBy("frame", "anion_id").agg(n.alias("n_centers")).filter("n_centers > 1").withColumn(
        "n_bridges", (F.col("n_centers") * (F.col("n_centers") - 1) / 2).cast("bigint")
    )


def bridge_moments(
    rows: DataFrame, lags: Sequence[int], center_mass: float, anion_mass: float, first: Column, last: Column,
    box: Sequence[str] = ("box",),
) -> DataFrame:
    """Three-body lag sums over all bridges, per scope and lag, without listing a bridge.

    ``rows``: one contact per frame, center_id and anion_id with ``cx..cz``, ``ax..az`` and the box. A bridge holds
    [t, t+lag] if both of its centers' contact runs do, so the bridges of (anion, t, lag) are the pairs of one set
    of members. Every member, in order of center id, meets the sums of those before it: rows grow with contacts
    and lags, also for an anion with thousands of centers. A bridge is open to the left (right) if both runs are,
    which inclusion and exclusion over four running sums takes away for ``completed_only``. A bridge starts at t unless
    both runs hold t-1, so ``n_events`` counts the events of at least lag + 1 frames. A body that moves less than the
    square root of the shortest product has no direction. No rows give no rows; sums are 0 where a scope has none.
    """
    key = ["anion_id", "center_id", "run"]
    member = runs(rows, key[:2], "frame")
    walk = unwrap_bodies(member, key, "frame", {"uc": ("cx", "cy", "cz"), "ua": ("ax", "ay", "az")}, box=box, rule="mean")
    edge = member.groupBy(*key).agg(F.min("frame").alias("__f0"), F.max("frame").alias("__f1")).select(
        *key, "__f0", (F.col("__f0") == first).alias("__left"), (F.col("__f1") == last).alias("__right")
    )
    moved = body_pairs(walk, key, "frame", ("uc", "ua"), lags).join(edge, key)
    m = _moves(("uc", "ua"))
    c, t = m["uc"], m["ua"]
    far = c.norm() > EPSILON
    flat = moved.select(
        "anion_id", "center_id", "frame", "lag", "__left", "__right", F.lit(1.0).alias("__one"),
        (F.col("frame") > F.col("__f0")).cast("double").alias("__old"), far.cast("double").alias("__has"), c.norm2().alias("__p2"),
        *[d.alias(f"__d{a}") for a, d in zip("xyz", c)], *[d.alias(f"__t{a}") for a, d in zip("xyz", t)],
        *[F.when(far, d / c.norm()).otherwise(0.0).alias(f"__e{a}") for a, d in zip("xyz", c)],
    )
    w = Window.partitionBy("anion_id", "frame", "lag").orderBy("center_id").rowsBetween(Window.unboundedPreceding, -1)
    left, right = F.col("__left"), F.col("__right")
    sets = {"": F.lit(True), "l": left, "r": right, "lr": left & right}
    before = flat.withColumns({
        f"__{s}_{n}": F.coalesce(F.sum(F.when(is_in, F.col(v))).over(w), F.lit(0.0)) for s, is_in in sets.items() for n, v in _BEFORE.items()
    })

    def met(n: str, completed: bool) -> Column:
        out = F.col(f"___{n}")
        if completed:
            out = out - F.when(left, F.col(f"__l_{n}")).otherwise(0.0) - F.when(right, F.col(f"__r_{n}")).otherwise(0.0)
            out = out + F.when(left & right, F.col(f"__lr_{n}")).otherwise(0.0)
        return out

    own, anion = vector("__dx", "__dy", "__dz"), vector("__tx", "__ty", "__tz")

    def sums(completed: bool) -> list[Column]:
        v = {n: met(n, completed) for n in _BEFORE}
        past, ways = Vector(v["px"], v["py"], v["pz"]), Vector(v["qx"], v["qy"], v["qz"])
        cells = {
            "n_events": v["k"] - F.col("__old") * v["old"], "n_origins": v["k"],
            "sum_a2": v["p2"], "sum_b2": v["k"] * F.col("__p2"), "sum_t2": v["k"] * anion.norm2(),
            "sum_ab": own.dot(past), "sum_at": anion.dot(past), "sum_bt": v["k"] * own.dot(anion),
            "sum_cos": vector("__ex", "__ey", "__ez").dot(ways), "n_cos": F.col("__has") * v["kd"],
        }
        return [F.sum(x).alias(n) for n, x in cells.items()]

    scopes = {"all_observed": False, "completed_only": True}
    table = before.groupBy("lag").agg(F.array(*[
        F.struct(F.lit(s).alias("scope"), F.struct(*sums(done)).alias("v")) for s, done in scopes.items()
    ]).alias("s"))
    flat_sums = table.select("lag", F.explode("s").alias("s")).select("s.scope", "lag", "s.v.*")
    a2, b2, t2, ab, to = F.col("sum_a2"), F.col("sum_b2"), F.col("sum_t2"), F.col("sum_ab"), F.col("sum_at") + F.col("sum_bt")
    mid, total = (a2 + b2 + 2 * ab) / 4, 2 * center_mass + anion_mass
    return flat_sums.withColumns({
        **{n: F.col(n).cast("bigint") for n in ("n_events", "n_origins", "n_cos")},
        "sum_rel2": a2 + b2 - 2 * ab, "sum_mid2": mid, "sum_tmid2": t2 + mid - to,
        "sum_com2": (4 * center_mass**2 * mid + anion_mass**2 * t2 + 2 * center_mass * anion_mass * to) / total**2,
    })


def bridge_moment_curves(moments: DataFrame, min_events: int = 20, min_origins: int = 200) -> DataFrame:
    """The curves of all bridges from ``bridge_moments``; curves by persistence need the events themselves."""
    return moments.filter("n_origins > 0").select(
        "scope", "lag", "n_events", "n_origins", *[m.alias(n) for n, m in bridge_metrics().items()],
        support_flag(F.col("n_events"), F.col("n_origins"), min_events, min_origins).alias("is_supported"),
    )


# --- aggregate geometry ---------------------------------------------------------------------


def image_gains(pairs: DataFrame, box: Sequence[str] = ("box",)) -> DataFrame:
    """``pairs`` with the boxes ``gx, gy, gz`` that the nearest-image step from center to anion crosses along the edges of the box."""
    d = vector("ax", "ay", "az").minus(vector("cx", "cy", "cz"))
    if len(box) == 1:
        turns = [image_shift(c, F.col(box[0])) for c in d]
    else:
        turns = [F.rint(f) for f in fractional(d, box_cell(box))]
    return pairs.withColumns({g: (-t).cast("long") for g, t in zip(GAINS, turns)})


def _boxes(counts: Sequence[str], box: Sequence[str]) -> Vector:
    """Displacement by whole boxes along the edges."""
    if len(box) == 1:
        return Vector(*(F.col(box[0]) * F.col(c) for c in counts))
    return cartesian(Vector(*(F.col(c).cast("double") for c in counts)), box_cell(box))


def aggregate_nodes(edges: DataFrame, labels: DataFrame, center_mass: float, anion_mass: float, box: Sequence[str] = ("box",)) -> DataFrame:
    """Every bound node placed next to its component's smallest center.

    Placement is the wrapped position plus whole boxes; the box counts come with the component
    labels, so no component is ever walked inside one task.  ``edges``: unique frame,
    center_id, anion_id, gains, cx..az, ``box`` (one, three or six numbers).
    """
    offs = [f"o_{g}" for g in GAINS]
    place = _boxes(offs, box)

    def side(kind: str, key: str, prefix: str, where: DataFrame, mass: float) -> DataFrame:
        at = edges.groupBy("frame", key).agg(
            *[F.min(f"{prefix}{a}").alias(a) for a in "xyz"], *[F.min(b).alias(b) for b in box]
        )
        return at.join(where, ["frame", key]).select(
            "frame", "root", F.lit(kind).alias("kind"), F.col(key).alias("node_id"), F.lit(float(mass)).alias("mass"),
            *[(F.col(a) + t).alias(a) for a, t in zip("xyz", place)], *box,
        )

    anions = label_anions(edges, labels, GAINS)
    return side("center", "center_id", "c", labels, center_mass).unionByName(
        side("anion", "anion_id", "a", anions, anion_mass)
    )


def windings(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per percolating component: rank of its winding vectors and the axes they touch.

    An edge whose placed ends differ from its own image step closes a loop through the
    boundary.  The rank follows from minors of the Gram matrix of the distinct windings.
    """
    anions = label_anions(edges, labels, GAINS).select(
        "frame", "anion_id", *[F.col(f"o_{g}").alias(f"t_{g}") for g in GAINS]
    )
    w = {a: F.col(f"o_{g}") + F.col(g) - F.col(f"t_{g}") for a, g in zip("xyz", GAINS)}
    turns = (
        edges.select("frame", "center_id", "anion_id", *GAINS)
        .join(labels, ["frame", "center_id"]).join(anions, ["frame", "anion_id"])
        .select("frame", "root", *[w[a].alias(f"w{a}") for a in "xyz"])
        .filter((F.col("wx") != 0) | (F.col("wy") != 0) | (F.col("wz") != 0))
        .distinct()
    )
    dot = lambda a, b: F.sum(F.col(f"w{a}") * F.col(f"w{b}"))
    g = turns.groupBy("frame", "root").agg(
        *[dot(a, b).alias(a + b) for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))]
    )
    c = F.col
    minors = (
        c("xx") * c("yy") - c("xy") * c("xy") + c("xx") * c("zz") - c("xz") * c("xz") + c("yy") * c("zz") - c("yz") * c("yz")
    )
    det = (
        c("xx") * (c("yy") * c("zz") - c("yz") * c("yz"))
        - c("xy") * (c("xy") * c("zz") - c("yz") * c("xz"))
        + c("xz") * (c("xy") * c("yz") - c("yy") * c("xz"))
    )
    return g.select(
        "frame", "root", F.when(det > 0, 3).when(minors > 0, 2).otherwise(1).alias("winding_rank"),
        F.concat(*[F.when(c(a + a) > 0, a).otherwise("") for a in "xyz"]).alias("winding_axes"),
    )


def closure_residuals(edges: DataFrame, labels: DataFrame, box: Sequence[str] = ("box",)) -> DataFrame:
    """(frame, root, closure_residual): the farthest that a nearest-image step from a placed center ends from an image of its placed anion.

    Steps are real-valued and placements whole boxes, so anything but rounding is a fault of the boxes or the labels.
    """
    anions = label_anions(edges, labels, GAINS).select("frame", "anion_id", *[F.col(f"o_{g}").alias(f"t_{g}") for g in GAINS])
    rows = edges.join(labels, ["frame", "center_id"]).join(anions, ["frame", "anion_id"])
    rows = rows.withColumns({f"w_{g}": F.col(f"o_{g}") + F.col(g) - F.col(f"t_{g}") for g in GAINS})
    c, a = vector("cx", "cy", "cz"), vector("ax", "ay", "az")
    start, end = c.plus(_boxes([f"o_{g}" for g in GAINS], box)), a.plus(_boxes([f"t_{g}" for g in GAINS], box))
    step = a.minus(c).plus(_boxes(GAINS, box))
    left = start.plus(step).minus(end).minus(_boxes([f"w_{g}" for g in GAINS], box))
    return rows.groupBy("frame", "root").agg(F.max(left.norm()).alias("closure_residual"))


def component_geometry(edges: DataFrame, labels: DataFrame, nodes: DataFrame, center_charge: int, box: Sequence[str] = ("box",)) -> DataFrame:
    """One row per bound component: counts, charge, center of mass, radius, percolation, closure residual.

    A percolating component has no placement of its own. Its center of mass and radius are given for one
    stated cut: every node at its nearest image to the smallest center.  ``shape_a``/``shape_b``
    fingerprint the exact membership.
    """
    m = F.col("mass")
    member = [F.col("kind"), F.col("node_id")]
    start = nodes.filter((F.col("kind") == "center") & (F.col("node_id") == F.col("root"))).select(
        "frame", "root", *[F.col(a).alias(f"__s{a}") for a in "xyz"]
    )
    d = vector("x", "y", "z").minus(vector("__sx", "__sy", "__sz"))
    parts = [c / F.col(box[0]) for c in d] if len(box) == 1 else fractional(d, box_cell(box))
    # Half a box away, and what rounding makes of it, goes to the lower image, wherever the node was placed.
    turns = [F.floor(f + 0.5 + HALF).cast("double") for f in parts]
    rows = nodes.join(start, ["frame", "root"]).withColumns({f"__t{a}": t for a, t in zip("xyz", turns)})
    near = d.minus(_boxes(["__tx", "__ty", "__tz"], box))

    def moments(at: Vector, name: str) -> list[Column]:
        means = [(F.sum(m * c) / F.sum(m)).alias(f"__{name}{a}") for a, c in zip("xyz", at)]
        return [*means, (F.sum(m * at.norm2()) / F.sum(m)).alias(f"__{name}2")]

    base = rows.groupBy("frame", "root").agg(
        F.count(F.when(F.col("kind") == "center", 1)).alias("n_centers"),
        F.count(F.when(F.col("kind") == "anion", 1)).alias("n_anions"),
        *[F.min(f"__s{a}").alias(f"__s{a}") for a in "xyz"],
        *moments(d, "whole"), *moments(near, "near"),
        *[F.min(b).alias(b) for b in box],
        F.bit_xor(F.xxhash64(*member)).alias("shape_a"),
        F.bit_xor(F.xxhash64(*reversed(member), F.lit("second"))).alias("shape_b"),
    )
    out = base.join(windings(edges, labels), ["frame", "root"], "left").fillna({"winding_rank": 0, "winding_axes": "none"})
    out = out.join(closure_residuals(edges, labels, box), ["frame", "root"])
    whole = F.col("winding_rank") == 0

    def chosen(part: str) -> Column:
        return F.when(whole, F.col(f"__whole{part}")).otherwise(F.col(f"__near{part}"))

    rg = F.sqrt(F.greatest(chosen("2") - sum((chosen(a) ** 2 for a in "xyz"), F.lit(0.0)), F.lit(0.0)))
    n = F.col("n_centers") + F.col("n_anions")
    return out.select(
        "frame", "root", "n_centers", "n_anions", n.alias("n_nodes"),
        (center_charge * F.col("n_centers") - F.col("n_anions")).alias("charge"),
        *[(F.col(f"__s{a}") + chosen(a)).alias(f"com_{a}") for a in "xyz"],
        rg.alias("rg"), *box, "shape_a", "shape_b",
        (~whole).cast("int").alias("is_percolating"), "winding_rank", "winding_axes", "closure_residual",
    )


def _key_text() -> Column:
    """Orders components of one frame as their member lists would: they differ at the smallest center."""
    return F.concat(F.col("root").cast("string"), F.when(F.col("n_centers") > 1, ",").otherwise("|"))


def frame_network(edges: DataFrame, geometry: DataFrame) -> DataFrame:
    """Per-frame network metrics over coordinated ions."""
    one = lambda t: F.count(F.when(t, F.lit(1)))
    per_anion = edges.groupBy("frame", "anion_id").agg(F.count(F.lit(1)).alias("k"))
    k = F.col("k")
    links = per_anion.groupBy("frame").agg(
        F.sum("k").alias("n_pairs"), F.count(F.lit(1)).alias("n_coordinated_anions"),
        one(k >= 2).alias("n_bridging_anions"),
        F.sum((k * (k - 1) / 2).cast("bigint")).alias("n_bridge_edges"),
    )
    n, c, p = F.col("n_nodes"), F.col("n_centers"), F.col("is_percolating") == 1
    comps = geometry.groupBy("frame").agg(
        F.sum(c).alias("n_coordinated_centers"),
        F.count(F.lit(1)).alias("n_aggregates"),
        F.avg(n).alias("mean_size"),
        F.min_by(F.struct(n.alias("n"), c.alias("c"), F.col("n_anions").alias("a")), F.struct(-n, _key_text())).alias("__big"),
        F.sum(F.when(c >= 2, c).otherwise(0)).alias("__multi"),
        one(F.col("charge") == 0).alias("n_neutral"), one(F.col("charge") > 0).alias("n_cationic"),
        one(F.col("charge") < 0).alias("n_anionic"), one(p).alias("n_percolating"),
        F.coalesce(F.max(F.when(p, n)), F.lit(0)).alias("largest_percolating"),
        F.sum(F.when(p, c).otherwise(0)).alias("__perc"),
        F.max("winding_rank").alias("max_winding_rank"),
    )
    total = F.col("n_coordinated_centers")
    return links.join(comps, "frame").select(
        "frame", "n_pairs", "n_coordinated_centers", "n_coordinated_anions", "n_bridging_anions", "n_bridge_edges",
        "n_aggregates", "mean_size", F.col("__big.n").alias("largest_size"), F.col("__big.c").alias("largest_centers"),
        F.col("__big.a").alias("largest_anions"), safe_ratio(F.col("__multi"), total, 0.0).alias("frac_centers_multi"),
        "n_neutral", "n_cationic", "n_anionic", "n_percolating", "largest_percolating",
        safe_ratio(F.col("__perc"), total, 0.0).alias("frac_centers_percolating"), "max_winding_rank",
    )


def frame_network_full(frames: DataFrame, network: DataFrame, frame_pairs: DataFrame) -> DataFrame:
    """All frames with zeros where nothing is bound, and the pair count checked against ``frame_pairs``."""
    full = frames.select("frame").distinct().join(network, "frame", "left").fillna(0)
    return full.join(frame_pairs.select("frame", F.col("n_pairs").alias("__p")), "frame", "left").withColumn(
        "pairs_agree", (F.col("n_pairs") == F.coalesce("__p", F.lit(0))).cast("int")
    ).drop("__p")


def aggregate_size_distribution(geometry: DataFrame) -> DataFrame:
    counts = geometry.groupBy("n_nodes", "n_centers", "n_anions", "charge", "is_percolating").agg(
        F.count(F.lit(1)).alias("count")
    )
    return with_share(counts, [], "count", "fraction")


# --- aggregate events -----------------------------------------------------------------------

SHAPE = ["root", "n_centers", "n_anions", "shape_a", "shape_b"]


def aggregate_rows(geometry: DataFrame, step: int = 1) -> DataFrame:
    """Component rows with the event number of their exact membership and an instance id."""
    numbered = runs(geometry, SHAPE, "frame", step=step)
    # Spells out every column of SHAPE and the run, so equal ids are equal instances.
    parts = [F.lower(F.hex(c)) if c.startswith("shape") else F.col(c).cast("string") for c in SHAPE]
    return numbered.withColumn("instance_id", F.concat(F.lit("C"), F.concat_ws("_", *parts), F.format_string("_E%05d", F.col("run"))))


def aggregate_events(rows: DataFrame, first: Column, last: Column, dt_ps: float) -> DataFrame:
    ev = rows.groupBy("instance_id", "root", "n_centers", "n_anions", "charge", F.col("run").alias("event_number")).agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("n_frames"),
        F.max("is_percolating").alias("is_percolating"), F.max("winding_rank").alias("max_winding_rank"),
        F.avg("rg").alias("mean_rg"),
    )
    n = F.col("n_centers") + F.col("n_anions")
    return _occupied(ev, first, last, dt_ps).withColumns(
        {"n_nodes": n, "size_class": size_class(n), "count_class": center_count_class(F.col("n_centers"))}
    )


AGGREGATE_SUMS = ("sum_com2", "sum_rg2", "sum_internal", "n_internal")


def aggregate_lag_sums(
    rows: DataFrame, events: DataFrame, nodes: DataFrame, lags: Sequence[int]
) -> DataFrame:
    """Lag sums of the center of mass, radius change and internal rearrangement per event.

    Events that percolate at any frame are left out.  Internal motion is summed over
    (event, node) rows, so a large aggregate is spread over many keys.
    """
    # An event that ends before the smallest lag has no pair: its rows and nodes go no further.
    lasting = (F.col("is_percolating") == 0) & (F.col("end_frame") - F.col("start_frame") >= min(lags))
    kept = rows.join(events.filter(lasting).select("instance_id"), "instance_id", "left_semi")
    walk = unwrap_bodies(kept, ["instance_id"], "frame", {"u": ("com_x", "com_y", "com_z")}, rule="mean")
    pairs = lag_pairs(walk, ["instance_id"], "frame", lags, ["ux", "uy", "uz", "rg"], ["ux", "uy", "uz", "rg"])
    move = _moves(("u",))["u"]
    turn = F.col("end_rg") - F.col("rg")
    outer = pairs.groupBy("instance_id", "lag").agg(
        F.count(F.lit(1)).alias("n_origins"), F.sum(move.norm2()).alias("sum_com2"), F.sum(turn * turn).alias("sum_rg2")
    )
    inside = kept.select(
        "frame", "root", "instance_id", *[f"com_{a}" for a in "xyz"]
    )
    rel = nodes.join(inside, ["frame", "root"]).select(
        "instance_id", "frame", "kind", "node_id", "mass", *[(F.col(a) - F.col(f"com_{a}")).alias(f"r{a}") for a in "xyz"]
    )
    r = lag_pairs(rel, ["instance_id", "kind", "node_id"], "frame", lags, ["mass", "rx", "ry", "rz"], ["rx", "ry", "rz"])
    shift = vector("end_rx", "end_ry", "end_rz").minus(vector("rx", "ry", "rz"))
    inner = r.groupBy("instance_id", "lag").agg(
        F.sum(F.col("mass") * shift.norm2()).alias("__w"), F.sum("mass").alias("__all")
    )
    out = outer.join(inner, ["instance_id", "lag"], "left")
    # sum over origins of (mass-weighted mean over nodes); the event's total mass is constant.
    weighted = F.col("__w") / (F.col("__all") / F.col("n_origins"))
    return out.select(
        "instance_id", "lag", "n_origins", "sum_com2", "sum_rg2", F.coalesce(weighted, F.lit(0.0)).alias("sum_internal"),
        F.when(F.col("__w").isNotNull(), F.col("n_origins")).otherwise(0).alias("n_internal"),
    )


def aggregate_metrics() -> dict[str, Column]:
    n = F.col("n_origins")
    com = F.col("sum_com2") / n
    internal = safe_ratio(F.col("sum_internal"), F.col("n_internal"))
    return {
        "com_msd": com, "rg_change_msd": F.col("sum_rg2") / n, "internal_msd": internal,
        "translation_fraction": safe_ratio(com, com + internal),
    }


def aggregate_curves(lag_table: DataFrame, min_events: int = 20, min_origins: int = 200) -> DataFrame:
    groups = {"all": None, "persistence": "persistence_class", "size": "size_class", "centers": "count_class"}
    return ratio_curves(lag_table, groups, AGGREGATE_SUMS, aggregate_metrics(), min_events, min_origins)


# --- lineage --------------------------------------------------------------------------------


def lineage_candidates(components: DataFrame, threshold: float = 0.5, step: int = 1) -> DataFrame:
    """Component pairs of consecutive frames whose Jaccard overlap reaches ``threshold``.

    Overlaps are counted by joining members on (frame, node), which no component can skew.
    """
    sizes = components.groupBy("frame", "root").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "center", 1)).alias("c")
    )
    now = components.select("frame", "kind", "node_id", F.col("root").alias("current"))
    before = components.select((F.col("frame") + step).alias("frame"), "kind", "node_id", F.col("root").alias("previous"))
    common = now.join(before, ["frame", "kind", "node_id"]).groupBy("frame", "current", "previous").agg(
        F.count(F.lit(1)).alias("__i")
    )
    a = sizes.select("frame", F.col("root").alias("current"), F.col("n").alias("__a"), F.col("c").alias("__ac"))
    b = sizes.select(
        (F.col("frame") + step).alias("frame"), F.col("root").alias("previous"), F.col("n").alias("__b"), F.col("c").alias("__bc")
    )
    score = F.col("__i") / (F.col("__a") + F.col("__b") - F.col("__i"))

    def rank(n: str, c: str, root: str) -> Column:
        # Position in the frame's list: larger components first, then by member list.
        text = F.concat(F.col(root).cast("string"), F.when(F.col(c) > 1, ",").otherwise("|"))
        return F.struct((-F.col(n)).alias("n"), text.alias("t"))

    return common.join(a, ["frame", "current"]).join(b, ["frame", "previous"]).select(
        "frame", "current", "previous", score.alias("score"),
        rank("__b", "__bc", "previous").alias("__pr"), rank("__a", "__ac", "current").alias("__cr"),
    ).filter(F.col("score") >= threshold)


def lineage_links(components: DataFrame, threshold: float = 0.5, step: int = 1) -> DataFrame:
    """Greedy one-to-one matches by (score, previous, current) descending, with merge and split flags.

    A candidate that is the best of both its ends is what the greedy order would take next, so
    rounds of "keep mutual bests, drop their rivals" give the greedy result without a per-frame
    loop.  At thresholds of one half and above one round settles everything.
    """
    every = lineage_candidates(components, threshold, step)
    parents = every.groupBy("frame", "current").agg(F.count(F.lit(1)).alias("__np"))
    children = every.groupBy("frame", "previous").agg(F.count(F.lit(1)).alias("__nc"))
    taken = None
    open_ = every if threshold >= 0.5 else cut(every)
    while True:
        order = F.struct("score", "__pr", "__cr")
        best_c = open_.groupBy("frame", "current").agg(F.max(order).alias("__bc"))
        best_p = open_.groupBy("frame", "previous").agg(F.max(order).alias("__bp"))
        ranked = open_.join(best_c, ["frame", "current"]).join(best_p, ["frame", "previous"])
        won = ranked.filter((order == F.col("__bc")) & (order == F.col("__bp"))).select(*open_.columns)
        if threshold >= 0.5:
            taken = won
            break
        won = cut(won)
        taken = won if taken is None else taken.unionByName(won)
        open_ = cut(
            open_.join(won.select("frame", "current"), ["frame", "current"], "left_anti").join(
                won.select("frame", "previous"), ["frame", "previous"], "left_anti"
            )
        )
        if open_.limit(1).count() == 0:
            break
    return taken.join(parents, ["frame", "current"]).join(children, ["frame", "previous"]).select(
        "frame", "current", "previous", "score",
        (F.col("__np") > 1).cast("int").alias("is_merge"), (F.col("__nc") > 1).cast("int").alias("is_split"),
    )


def lineage_roots(components: DataFrame, links: DataFrame, step: int = 1) -> DataFrame:
    """(frame, root, first_frame, first_root): where the lineage of each component began.

    Links form simple paths, so pointer doubling reaches every start in log2(length) rounds.
    """
    nodes = components.select("frame", "root").distinct()
    link = links.select("frame", F.col("current").alias("root"), F.col("previous"))
    chain = nodes.join(link, ["frame", "root"], "left").select(
        "frame", "root",
        F.when(F.col("previous").isNull(), F.col("frame")).otherwise(F.col("frame") - step).alias("pf"),
        F.coalesce("previous", "root").alias("pr"),
    )
    chain = cut(chain)
    while True:
        up = chain.select(F.col("frame").alias("pf"), F.col("root").alias("pr"), F.col("pf").alias("qf"), F.col("pr").alias("qr"))
        nxt = cut(
            chain.join(up, ["pf", "pr"]).select(
                "frame", "root", F.col("qf").alias("pf"), F.col("qr").alias("pr"),
                ((F.col("qf") != F.col("pf")) | (F.col("qr") != F.col("pr"))).alias("moved"),
            )
        )
        done = nxt.filter("moved").limit(1).count() == 0
        chain = nxt.drop("moved")
        if done:
            return chain.select("frame", "root", F.col("pf").alias("first_frame"), F.col("pr").alias("first_root"))


def lineages(components: DataFrame, links: DataFrame, dt_ps: float, step: int = 1, roots: DataFrame | None = None) -> DataFrame:
    """One row per lineage: frames, sizes, merges, splits, mean overlap; numbered by first appearance."""
    roots = lineage_roots(components, links, step) if roots is None else roots
    sizes = components.groupBy("frame", "root").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "center", 1)).alias("c")
    ).withColumn("a", F.col("n") - F.col("c"))
    link = links.select("frame", F.col("current").alias("root"), "score", "is_merge", "is_split")
    rows = roots.join(sizes, ["frame", "root"]).join(link, ["frame", "root"], "left")
    out = rows.groupBy("first_frame", "first_root").agg(
        F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n_frames"), F.avg("n").alias("mean_size"),
        F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.max("c").alias("max_centers"), F.max("a").alias("max_anions"),
        F.sum(F.coalesce("is_merge", F.lit(0))).alias("n_merges"), F.sum(F.coalesce("is_split", F.lit(0))).alias("n_splits"),
        F.avg("score").alias("mean_jaccard"),
    )
    # Number = lineages of earlier frames + rank by first center inside the frame.
    per_frame = out.groupBy("first_frame").agg(F.count(F.lit(1)).alias("__k"))
    before = accumulate(
        per_frame, [], "first_frame", ["__k"], lambda p, c: {"__upto": c["__k"]}, {"__upto": lambda head: head["__k"]}
    ).select("first_frame", (F.col("__upto") - F.col("__k")).alias("__before"))
    ranked = ordinals(out, ["first_frame"], "first_root", "__o").join(before, "first_frame")
    return ranked.select(
        F.format_string("L%07d", F.col("__before") + F.col("__o") + 1).alias("lineage_id"), *out.columns,
        ((F.col("last_frame") - F.col("first_frame")) * float(dt_ps)).alias("span_ps"),
    )
