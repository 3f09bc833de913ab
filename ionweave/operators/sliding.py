"""Motion of centers along chains: dominant chain, dwells, transitions, sliding, segment coupling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ionweave.functions.states import safe_ratio
from ionweave.operators.blocks import proportional_block
from ionweave.operators.comotion import _moves, body_pairs, support_flag
from ionweave.operators.contacts import ANION, POLYMER
from ionweave.operators.mobility import unwrap_bodies
from ionweave.operators.ordered import _CHUNK, CHUNK, _chunked, _dealt, _with_ghosts, neighbours, runs
from ionweave.session import cut, staged

UNBOUND = -1
FINE = 1.0e9  # distances and coordinates are compared in billionths: the last bits of a sum decide no tie
TRANSITIONS = ("attachment", "detachment", "interchain_hop", "neighbour_slide", "large_jump")


def _settled(step: int, chunk: int, columns: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Choice of each cell from rows in order of (center, chunk, frame), the default first.

    A cell looks at the one before it in its chunk; cells whose choice hangs on the chunk before stay open, with all their rows.
    """

    def choose(rows: pa.Table, past: tuple) -> tuple[pa.Table, tuple]:
        center, part, frame, chain = (rows.column(c).to_numpy() for c in ("center_id", _CHUNK, "frame", "chain"))
        new = np.ones(len(chain), bool)
        new[1:] = (center[1:] != center[:-1]) | (part[1:] != part[:-1]) | (frame[1:] != frame[:-1])
        start = np.flatnonzero(new)
        many = np.diff(start, append=len(chain))
        center, part, frame = center[start], part[start], frame[start]
        same, linked = np.zeros(len(start), bool), np.zeros(len(start), bool)
        same[1:] = (center[1:] == center[:-1]) & (part[1:] == part[:-1])
        linked[1:] = same[1:] & (frame[1:] - frame[:-1] == step)
        if past and past[:2] == (center[0], part[0]):
            same[0], linked[0] = True, frame[0] - past[2] == step
        unknown = (many > 1) & ~same & ((frame - step + chunk // 2) // chunk != part)
        pick = start.copy()
        for i in np.flatnonzero((many > 1) & linked):
            # Of the cell before: its chain, or that it is open.
            was, hangs = (chain[pick[i - 1]], unknown[i - 1]) if i else past[3:]
            unknown[i] = hangs
            tied = np.flatnonzero(chain[start[i] : start[i] + many[i]] == was)
            if len(tied) and not hangs:
                pick[i] = start[i] + tied[0]
        kept = np.repeat(unknown, many)
        opened = kept.copy()
        kept[pick] = True
        out = rows.append_column("__open", pa.array(opened)).append_column("__default", pa.array(new)).filter(pa.array(kept))
        return out.select([*columns, "__open", "__default"]), (center[-1], part[-1], frame[-1], chain[pick[-1]], unknown[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, past = None, ()
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            # The last cell may go on in the next batch.
            center, part, frame = (rows.column(c).to_numpy() for c in ("center_id", _CHUNK, "frame"))
            other = np.flatnonzero((center != center[-1:]) | (part != part[-1:]) | (frame != frame[-1:]))
            whole = int(other[-1]) + 1 if len(other) else 0
            held = rows.slice(whole)
            if whole:
                out, past = choose(rows.slice(0, whole), past)
                yield from out.combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from choose(held, past)[0].combine_chunks().to_batches()

    return run


def _resolved(rows: DataFrame, step: int) -> DataFrame:
    """Choice of the open cells: pointer doubling from the settled cells before them, or from none, along their chains."""
    key = ["center_id", "frame"]
    nodes = cut(rows.filter("__open").select(*key, "chain", "__default"))
    at = nodes.select(*key).distinct()
    earlier = at.select("center_id", (F.col("frame") - step).alias("frame"))
    settled = cut(rows.filter("not __open").join(earlier, key, "left_semi").select(*key, "chain"))
    after = nodes.filter("__default").select("center_id", (F.col("frame") - step).alias("frame"), F.col("chain").alias("__nd"))
    same = nodes.select("center_id", (F.col("frame") - step).alias("frame"), "chain", F.lit(1).alias("__same"))
    origins = nodes.select(*key, "chain").unionByName(settled)
    jump = cut(
        origins.join(after, key).join(same, [*key, "chain"], "left").select(
            *key, "chain", (F.col("frame") + step).alias("to_frame"),
            F.when(F.col("__same") == 1, F.col("chain")).otherwise(F.col("__nd")).alias("to_chain"),
        )
    )
    before = origins.select("center_id", (F.col("frame") + step).alias("frame")).distinct()
    # Nothing bound in the frame before: no history needed.
    chosen = cut(settled.unionByName(nodes.filter("__default").join(before, key, "left_anti").select(*key, "chain")))
    while jump.limit(1).count() > 0:
        found = chosen.join(jump, [*key, "chain"]).select(
            "center_id", F.col("to_frame").alias("frame"), F.col("to_chain").alias("chain")
        )
        chosen = cut(chosen.unionByName(found).distinct())
        step2 = jump.select(
            "center_id", F.col("frame").alias("to_frame"), F.col("chain").alias("to_chain"),
            F.col("to_frame").alias("__f"), F.col("to_chain").alias("__c"),
        )
        jump = cut(
            jump.join(step2, ["center_id", "to_frame", "to_chain"]).select(
                *key, "chain", F.col("__f").alias("to_frame"), F.col("__c").alias("to_chain")
            )
        )
    return chosen.join(at, key, "left_semi")


def dominant_chain(contacts: DataFrame, n_sites: int, step: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(frame, center_id, chain, site, coordinate) of bound centers.

    The chain with most contacts wins; on a tie the previous frame's chain stays if it is
    among the tied ones, else the closest on average (in billionths; smaller chain on a tie).  Contacts are exchanged
    once, by center and chunk of frames, and a chunk is settled in the order of its frames.  The rule looks back only through
    ties, so only ties that open a chunk hang on the chunk before; pointer doubling settles those, in a
    number of rounds logarithmic in the longest run of them.
    """
    d = F.greatest(F.col("distance"), F.lit(1.0e-8))
    # Tied chains have equally many contacts, so whole sums compare their means, in whatever order they are added.
    units = F.rint(F.col("distance") * FINE).cast("bigint")
    bound = contacts.filter(F.col("ligand_kind") == POLYMER).select(
        "center_id", "frame", F.col("ligand_id").alias("chain"), "site_index", "distance"
    )
    cell = ["center_id", _CHUNK, "frame"]
    # No chunk begins at frame 0, where every center would be open.
    part = F.floor((F.col("frame") + chunk // 2) / F.lit(chunk)).cast("long")
    per_chain = bound.withColumn(_CHUNK, part).repartition("center_id", _CHUNK).groupBy(*cell, "chain").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(units).alias("__d"),
        (F.sum(F.col("site_index") / (d * d)) / F.sum(1.0 / (d * d))).alias("coordinate"),
    )
    order = [F.col("__n").desc(), F.col("__d"), F.col("chain")]
    most = F.first("__n").over(Window.partitionBy(*cell).orderBy(*order))
    tied = per_chain.withColumn("__most", most).filter("__n = __most").sortWithinPartitions(*cell, *order).select(*cell, "chain", "coordinate")
    kept = ["frame", "center_id", "chain", "coordinate"]
    flags = [StructField(c, BooleanType()) for c in ("__open", "__default")]
    rows = staged(tied.mapInArrow(_settled(step, chunk, kept), StructType([*tied.select(*kept).schema.fields, *flags])), "tied")
    chosen = rows.filter("not __open")
    if not rows.filter("__open").isEmpty():
        found = _resolved(rows, step)
        chosen = chosen.unionByName(rows.filter("__open").join(found, ["center_id", "frame", "chain"], "left_semi"))
    site = F.greatest(F.lit(1), F.least(F.lit(n_sites), F.rint(F.rint(F.col("coordinate") * FINE) / FINE))).cast("bigint")
    return chosen.select("frame", "center_id", "chain", site.alias("site"), "coordinate")


def chain_states(chosen: DataFrame, grid: DataFrame) -> DataFrame:
    """Every (frame, center) with its chain and site, -1 where unbound."""
    none = F.lit(UNBOUND).cast("bigint")
    return grid.select("frame", "center_id").join(chosen, ["frame", "center_id"], "left").select(
        "frame", "center_id", F.coalesce("chain", none).alias("chain"), F.coalesce("site", none).alias("site"), "coordinate"
    )


def _smoothed(near: DataFrame) -> DataFrame:
    """``smooth_chain`` and ``smooth_site`` of rows that hold the states before and after as ``__l`` and ``__r``."""
    left, right = (F.coalesce(F.col(f"{s}.chain"), F.col("chain")) for s in ("__l", "__r"))
    ls, rs = (F.coalesce(F.col(f"{s}.site"), F.col("site")) for s in ("__l", "__r"))
    smooth = F.when(left == right, left).otherwise(F.col("chain"))
    kept = F.array_sort(
        F.array_compact(
            F.array(F.when(left == smooth, ls), F.when(F.col("chain") == smooth, F.col("site")), F.when(right == smooth, rs))
        )
    )
    n = F.size(kept)
    median = (F.get(kept, F.floor((n - 1) / 2).cast("int")) + F.get(kept, F.floor(n / 2).cast("int"))) / 2.0
    site = F.when(smooth >= 0, F.rint(median)).otherwise(F.lit(UNBOUND)).cast("bigint")
    return near.withColumns({"smooth_chain": smooth, "smooth_site": site}).select(
        "frame", "center_id", "chain", "site", "coordinate", "smooth_chain", "smooth_site"
    )


def smooth_states(states: DataFrame, step: int = 1) -> DataFrame:
    """Three-frame filter: agreeing neighbours overrule the middle; site = median of matching sites."""
    return _smoothed(neighbours(states, ["center_id"], "frame", {"__l": -step, "__r": step}, ["chain", "site"]))


def smooth_chosen(chosen: DataFrame, grid: DataFrame, step: int = 1, chunk: int = CHUNK) -> DataFrame:
    """``smooth_states`` of ``chain_states``: choices and grid meet and see their neighbours in one exchange."""
    none = F.lit(UNBOUND).cast("bigint")
    named = ["frame", "center_id", "chain", "site", "coordinate", "__cell"]
    empty = [F.lit(None).cast(chosen.schema[c].dataType).alias(c) for c in ("chain", "site", "coordinate")]
    rows = grid.select("frame", "center_id", *empty, F.lit(True).alias("__cell")).unionByName(chosen.withColumn("__cell", F.lit(False)).select(named))
    dealt = _dealt(_with_ghosts(rows, ["center_id"], "frame", step, step, chunk), ["center_id"])
    cells = dealt.groupBy("center_id", _CHUNK, "frame").agg(
        F.coalesce(F.max("chain"), none).alias("chain"), F.coalesce(F.max("site"), none).alias("site"),
        F.max("coordinate").alias("coordinate"), F.bool_or("__cell").alias("__cell"),
    ).filter("__cell")
    w = Window.partitionBy("center_id", _CHUNK).orderBy("frame")
    near = cells.withColumn("__at", F.struct("chain", "site")).withColumns(
        {n: F.first("__at").over(w.rangeBetween(o, o)) for n, o in (("__l", -step), ("__r", step))}
    )
    return _smoothed(near.filter(F.floor(F.col("frame") / F.lit(chunk)) == F.col(_CHUNK)))


def dwell_cells(smoothed: DataFrame, contacts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Smoothed states with the coordination numbers of their cell; both are exchanged once, by center and chunk of frames.

    Gives ``center_id, __chunk, frame, chain, site, n_site, n_chain, n_anion`` and leaves rows where they were dealt.
    """
    polymer, anion = F.col("ligand_kind") == POLYMER, F.col("ligand_kind") == ANION
    state = smoothed.select(
        "center_id", "frame", F.col("smooth_chain").alias("chain"), F.col("smooth_site").alias("site"),
        F.lit(None).cast("boolean").alias("__polymer"), F.lit(None).cast("bigint").alias("__ligand"),
    )
    none = F.lit(None).cast("bigint")
    bound = contacts.filter(polymer | anion).select(
        "center_id", "frame", none.alias("chain"), none.alias("site"), polymer.alias("__polymer"), F.col("ligand_id").alias("__ligand")
    )
    cell = ["center_id", _CHUNK, "frame"]
    dealt = _chunked(state.unionByName(bound), ["center_id"], "frame", chunk)
    one = F.max("chain").alias("chain"), F.max("site").alias("site")
    ligands = dealt.groupBy(*cell, "__polymer", "__ligand").agg(*one, F.count(F.lit(1)).alias("__n"))
    return ligands.groupBy(*cell).agg(
        *one, F.coalesce(F.sum(F.when(F.col("__polymer"), F.col("__n"))), F.lit(0)).alias("n_site"),
        F.count(F.when(F.col("__polymer"), 1)).alias("n_chain"), F.count(F.when(~F.col("__polymer"), 1)).alias("n_anion"),
    ).filter("chain IS NOT NULL")


def dwell_events(
    smoothed: DataFrame, contacts: DataFrame, first: Column, last: Column, dt_ps: float, step: int = 1, chunk: int = CHUNK
) -> DataFrame:
    """Runs of one (chain, site), unbound runs included, with the contacts met in them.

    Runs are summed where the rows were dealt and written as pieces; those at the edges of a chunk, two at most, are then put together.
    """
    w = Window.partitionBy("center_id", _CHUNK).orderBy("frame")
    before = F.lag(F.struct("frame", "chain", "site")).over(w)
    goes_on = lambda a, frame, b: (frame - a <= step) & (b["chain"] == F.col("chain")) & (b["site"] == F.col("site"))
    cells = dwell_cells(smoothed, contacts, chunk).withColumn("__b", before)
    new = F.when(goes_on(F.col("__b.frame"), F.col("frame"), F.col("__b")), 0).otherwise(1)
    run = F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    anion, multi = (F.col("n_anion") > 0).cast("int"), (F.col("n_chain") >= 2).cast("int")
    pieces = cells.withColumn("__run", run).groupBy("center_id", _CHUNK, "__run", "chain", "site").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("n_frames"),
        F.sum(anion).alias("__anion"), F.sum(multi).alias("__multi"), F.sum("n_site").alias("__sites"), F.sum("n_chain").alias("__chains"),
    )
    pieces = staged(pieces, "dwell_pieces")
    # One row per chunk: how many runs are before it, and whether its first one goes on from them.
    at = lambda best, edge: best(F.struct(F.col(edge).alias("frame"), "chain", "site"), "__run")
    chunks = pieces.groupBy("center_id", _CHUNK).agg(
        F.max("__run").alias("__n"), at(F.min_by, "start_frame").alias("__head"), at(F.max_by, "end_frame").alias("__tail")
    )
    wk = Window.partitionBy("center_id").orderBy(_CHUNK)
    chunks = chunks.withColumn("__b", F.lag("__tail").over(wk)).select("*", "__head.chain", "__head.site")
    linked = F.when(goes_on(F.col("__b.frame"), F.col("__head.frame"), F.col("__b")), 1).otherwise(0)
    past = F.coalesce(F.sum("__n").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.withColumn("__linked", linked).select(
        "center_id", _CHUNK, (past - F.sum("__linked").over(wk.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("__past"), "__n"
    )
    numbered = pieces.join(chunks, ["center_id", _CHUNK]).withColumn("event", (F.col("__past") + F.col("__run")).cast("bigint"))
    key, sums = ["center_id", "event", "chain", "site"], ["n_frames", "__anion", "__multi", "__sites", "__chains"]
    inside = (F.col("__run") > 1) & (F.col("__run") < F.col("__n"))
    whole = numbered.filter(inside).select(*key, "start_frame", "end_frame", *sums)
    put = numbered.filter(~inside).groupBy(*key).agg(
        F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), *[F.sum(c).alias(c) for c in sums]
    )
    n = F.col("n_frames")
    return whole.unionByName(put).select(
        *key, "start_frame", "end_frame", "n_frames", (n * F.lit(float(dt_ps))).alias("duration_ps"),
        (F.col("start_frame") == first).cast("int").alias("left_censored"), (F.col("end_frame") == last).cast("int").alias("right_censored"),
        (F.col("__anion") > 0).cast("int").alias("anion_any"), (F.col("__anion") / n).alias("anion_fraction"),
        (F.col("__multi") > 0).cast("int").alias("multichain_any"), (F.col("__multi") / n).alias("multichain_fraction"),
        (F.col("__sites") / n).alias("mean_sites"), (F.col("__chains") / n).alias("mean_chains"),
        (F.col("chain") >= 0).cast("int").alias("is_bound"),
    )


def transition_type(chain: Column, site: Column, to_chain: Column, to_site: Column) -> Column:
    far = F.abs(to_site - site)
    return (
        F.when((chain < 0) & (to_chain >= 0), TRANSITIONS[0])
        .when((chain >= 0) & (to_chain < 0), TRANSITIONS[1])
        .when((chain >= 0) & (chain != to_chain), TRANSITIONS[2])
        .when((chain >= 0) & (far == 1), TRANSITIONS[3])
        .when((chain >= 0) & (far > 1), TRANSITIONS[4])
    )


def site_transitions(
    dwells: DataFrame, flags: DataFrame, first: Column, n_frames: Column, dt_ps: float, k: int = 5, step: int = 1
) -> DataFrame:
    """Steps between consecutive dwells with involvement flags over the boundary +-1 frame."""
    cols = ["chain", "site", "start_frame", "duration_ps"]
    nxt = neighbours(dwells.select("center_id", "event", *cols), ["center_id"], "event", {"to": 1}, cols).filter(
        F.col("to").isNotNull()
    )
    kind = transition_type(F.col("chain"), F.col("site"), F.col("to.chain"), F.col("to.site"))
    moved = nxt.withColumn("type", kind).filter(F.col("type").isNotNull())
    near = neighbours(
        flags.select("frame", "center_id", "anion_present", "multichain"), ["center_id"], "frame", {"__l": -step, "__r": step},
        ["anion_present", "multichain"],
    )
    around = lambda c: F.greatest(F.col(c), F.coalesce(F.col(f"__l.{c}"), F.lit(0)), F.coalesce(F.col(f"__r.{c}"), F.lit(0)))
    near = near.select(
        "center_id", "frame", around("anion_present").alias("anion_involved"), around("multichain").alias("multichain_involved")
    )
    same = (F.col("chain") >= 0) & (F.col("chain") == F.col("to.chain"))
    out = moved.select(
        "center_id", F.col("event").alias("from_event"), (F.col("event") + 1).alias("to_event"), F.col("to.start_frame").alias("frame"),
        "type", F.col("chain").alias("from_chain"), F.col("site").alias("from_site"), F.col("to.chain").alias("to_chain"),
        F.col("to.site").alias("to_site"), F.when(same, F.col("to.site") - F.col("site")).alias("delta"),
        F.col("duration_ps").alias("from_dwell_ps"), F.col("to.duration_ps").alias("to_dwell_ps"),
    )
    ordinal = ((F.col("frame") - first) / step).cast("bigint")
    return out.join(near, ["center_id", "frame"]).withColumns(
        {"time_ps": F.col("frame") * F.lit(float(dt_ps)), "block": proportional_block(ordinal, n_frames, k)}
    )


def transition_blocks(transitions: DataFrame, k: int) -> DataFrame:
    """Counts and shares for all five types in every block; NULL share in an empty block."""
    counts = transitions.groupBy("block", "type").agg(F.count(F.lit(1)).alias("n_events"))
    cells = transitions.sparkSession.range(k).select(
        F.col("id").alias("block"), F.explode(F.array(*map(F.lit, TRANSITIONS))).alias("type")
    )
    totals = counts.groupBy("block").agg(F.sum("n_events").alias("n_all"))
    full = cells.join(counts, ["block", "type"], "left").join(totals, "block", "left").fillna(0, ["n_events", "n_all"])
    return full.withColumn("fraction", safe_ratio(F.col("n_events"), F.col("n_all")))


def transition_summary(transitions: DataFrame, k: int) -> DataFrame:
    """Per type: counts, share, block statistics, mean |delta|, involvement, dwell before and after."""
    per = transitions.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(F.abs("delta")).alias("mean_abs_delta"), F.avg("anion_involved").alias("frac_anion"),
        F.avg("multichain_involved").alias("frac_multichain"), F.avg("from_dwell_ps").alias("mean_from_dwell_ps"), F.avg("to_dwell_ps").alias("mean_to_dwell_ps"),
    )
    blocks = transition_blocks(transitions, k)
    spread = blocks.groupBy("type").agg(
        F.avg("fraction").alias("block_mean"), F.stddev_samp("fraction").alias("block_std"),
        (F.stddev_samp("fraction") / F.sqrt(F.count("fraction"))).alias("block_sem"), F.count("fraction").alias("n_blocks"),
        F.sum("n_all").alias("__all"),
    )
    out = spread.join(per, "type", "left").fillna(0, ["n_events"])
    return out.withColumn("fraction", safe_ratio(F.col("n_events"), F.col("__all"))).drop("__all")


def sliding_episodes(transitions: DataFrame, dt_ps: float) -> DataFrame:
    """Maximal runs of linked neighbour slides in one direction."""
    slides = transitions.filter(F.col("type") == TRANSITIONS[3]).withColumn("direction", F.signum("delta").cast("int"))
    linked = runs(slides, ["center_id"], "from_event", value=["direction", "from_chain"])
    e = linked.groupBy("center_id", F.col("run").alias("episode"), F.col("from_chain").alias("chain"), "direction").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.min_by("from_site", "from_event").alias("start_site"),
        F.max_by("to_site", "from_event").alias("end_site"), F.count(F.lit(1)).alias("n_steps"), F.sum("delta").alias("net_delta"),
        F.max("anion_involved").alias("anion_any"), F.max("multichain_involved").alias("multichain_any"),
    )
    return e.withColumn("span_ps", (F.col("end_frame") - F.col("start_frame")) * float(dt_ps))


def dwell_summary(dwells: DataFrame) -> DataFrame:
    """One row over bound dwells.  Durations are whole frames, so exact percentiles stay small."""
    bound = F.col("is_bound") == 1
    done = bound & (F.col("left_censored") == 0) & (F.col("right_censored") == 0)
    t = F.when(done, F.col("duration_ps"))
    n = F.count(F.when(bound, 1))
    w = F.when(bound, F.col("n_frames"))
    share = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    return dwells.agg(
        F.count(F.lit(1)).alias("n_dwells"), n.alias("n_bound"), F.count(t).alias("n_completed"),
        safe_ratio(n - F.count(t), n).alias("frac_censored"), F.avg(t).alias("mean_ps"), F.median(t).alias("median_ps"),
        F.percentile(t, 0.9).alias("p90_ps"), F.percentile(t, 0.95).alias("p95_ps"), F.max(F.when(bound, F.col("duration_ps"))).alias("max_bound_ps"),
        F.avg(F.when(bound, F.col("anion_any"))).alias("frac_anion"), F.avg(F.when(bound, F.col("multichain_any"))).alias("frac_multichain"),
        share("anion_fraction").alias("time_frac_anion"), share("multichain_fraction").alias("time_frac_multichain"),
    )


def sliding_summary(episodes: DataFrame, n_centers: Column, total_time_ns: Column, coordinated_time_ns: Column) -> DataFrame:
    steps = F.coalesce(F.sum("n_steps"), F.lit(0))
    return episodes.agg(
        F.count(F.lit(1)).alias("n_episodes"), steps.alias("n_steps"), F.avg("n_steps").alias("mean_steps"), F.median("n_steps").alias("median_steps"),
        F.max("n_steps").alias("max_steps"), F.avg((F.col("n_steps") >= 2).cast("int")).alias("frac_multistep"), F.avg("anion_any").alias("frac_anion"),
        F.avg("multichain_any").alias("frac_multichain"),
    ).select(
        "*", safe_ratio(F.col("n_steps"), n_centers * total_time_ns, 0.0).alias("rate_total"),
        safe_ratio(F.col("n_steps"), coordinated_time_ns, 0.0).alias("rate_coordinated"),
    )


def segment_correlation(rows: DataFrame, lags: list[int], min_episodes: int = 20, min_origins: int = 200, step: int = 1) -> DataFrame:
    """Center and segment motion inside same-chain episodes of at least two frames.

    ``rows``: frame, center_id, chain, positions ``cx..cz`` and ``sx..sz``, box.  An episode with
    a missing coordinate is left out whole.
    """
    numbered = runs(rows, ["center_id"], "frame", step=step, value=["chain"])
    known = sum((F.col(f"{b}{a}").isNull().cast("int") for b in "cs" for a in "xyz"), F.lit(0)) == 0
    good = numbered.filter(F.col("chain") >= 0).groupBy("center_id", "run").agg(
        F.count(F.lit(1)).alias("__n"), F.bool_and(known).alias("__ok")
    ).filter((F.col("__n") >= 2) & F.col("__ok")).select("center_id", "run")
    kept = numbered.join(good, ["center_id", "run"], "left_semi")
    walk = unwrap_bodies(kept, ["center_id", "run"], "frame", {"uc": ("cx", "cy", "cz"), "us": ("sx", "sy", "sz")})
    m = _moves(("uc", "us"))
    c, s = m["uc"], m["us"]
    per_episode = body_pairs(walk, ["center_id", "run"], "frame", ("uc", "us"), lags).groupBy("center_id", "run", "lag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(c.norm2()).alias("c2"), F.sum(s.norm2()).alias("s2"), F.sum(c.dot(s)).alias("cs"),
        F.sum(c.minus(s).norm2()).alias("r2"),
    )
    sums = per_episode.groupBy("lag").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.sum("n").alias("n_origins"), *[F.sum(k).alias(k) for k in ("c2", "s2", "cs", "r2")]
    )
    n = F.col("n_origins")
    mc, ms, dot, rel = (F.col(k) / n for k in ("c2", "s2", "cs", "r2"))
    align, ratio = safe_ratio(2.0 * dot, mc + ms), safe_ratio(rel, mc + ms)
    return sums.select(
        "lag", "n_episodes", "n_origins", mc.alias("center_msd"), ms.alias("segment_msd"), dot.alias("mean_dot"), rel.alias("relative_msd"),
        safe_ratio(dot, F.sqrt(F.greatest(mc * ms, F.lit(0.0)))).alias("vector_correlation"), align.alias("alignment"), ratio.alias("relative_ratio"),
        (ratio - (1.0 - align)).alias("identity_residual"), support_flag(F.col("n_episodes"), n, min_episodes, min_origins).alias("is_supported"),
    )


def chain_coordinate_table(smoothed: DataFrame, flags: DataFrame) -> DataFrame:
    """Raw and smoothed chain states with counts and flags."""
    return smoothed.join(flags, ["frame", "center_id"])
