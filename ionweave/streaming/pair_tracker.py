"""Bound-pair event numbering as a keyed, stateful stream.

Frames arrive in order, one micro-batch holding one or more whole frames.  State per pair is
three integers, so it is bounded by the number of distinct pairs; it can't end with an event,
because the next event of the pair continues its numbering.  A row that comes after a later
frame of its pair is handed on as late, without a number, and leaves the state as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = (
    "center_id bigint, anion_id bigint, frame bigint, ordinal bigint, event_number bigint, age_frames bigint, "
    "continuing int, new_event int, is_late int"
)
STATE = "event_number bigint, age bigint, last_ordinal bigint"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Continue the pair's open event, or open the next one after any missed frame.

    Rows of a pair and micro-batch come as bounded Arrow batches; they are put in frame order
    first because a micro-batch may hold several frames.
    """
    rows = pd.concat(list(batches)).sort_values("ordinal")
    number, age, last = state.get if state.exists else (0, 0, None)
    if last is not None and (late := rows[rows["ordinal"] <= last]).shape[0]:
        yield pd.DataFrame(
            {
                "center_id": key[0], "anion_id": key[1], "frame": late["frame"].to_numpy(), "ordinal": late["ordinal"].to_numpy(),
                "event_number": None, "age_frames": None, "continuing": None, "new_event": None, "is_late": 1,
            }
        ).astype({c: "Int64" for c in ("event_number", "age_frames")} | {c: "Int32" for c in ("continuing", "new_event", "is_late")})
        rows = rows[rows["ordinal"] > last]
    if rows.empty:
        return
    order = rows["ordinal"].to_numpy()
    gap = pd.Series(order).diff()
    gap.iloc[0] = order[0] - last if last is not None else 0
    fresh = (gap != 1).to_numpy()
    run = fresh.cumsum()
    first = pd.Series(order).groupby(run).transform("min").to_numpy()
    ages = order - first + 1
    ages[run == 0] += age
    state.update((int(number + run[-1]), int(ages[-1]), int(order[-1])))
    yield pd.DataFrame(
        {
            "center_id": key[0], "anion_id": key[1], "frame": rows["frame"].to_numpy(), "ordinal": order,
            "event_number": number + run, "age_frames": ages,
            "continuing": (ages > 1).astype("int32"), "new_event": (ages == 1).astype("int32"),
            "is_late": 0,
        }
    )


def pair_events_stream(pairs: DataFrame) -> DataFrame:
    """Stream of (center_id, anion_id, frame, ordinal) to numbered pair rows (append mode).

    ``ordinal`` is the position of the frame in the processed sequence.  Equal to the batch
    operator's event number, age and flags.
    """
    keyed = pairs.select("center_id", "anion_id", "frame", "ordinal").groupBy("center_id", "anion_id")
    return keyed.applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def closed_events(numbered: DataFrame, last_ordinal: int) -> DataFrame:
    """End-of-stream summary of the emitted rows; events open at the last frame are flagged."""
    return numbered.groupBy("center_id", "anion_id", "event_number").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("n_frames"),
        (F.max("ordinal") == last_ordinal).cast("int").alias("is_open"),
    )
