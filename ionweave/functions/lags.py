"""Lag lists in frames.  A few hundred integers at most, so they are plain Python lists."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def frames_of(time: float, dt: float) -> int:
    """Whole frames nearest to a time, at least one; ties go to the even number."""
    return max(1, int(round(time / dt)))


def _clean(values: np.ndarray, top: int) -> list[int]:
    whole = np.rint(np.asarray(values, dtype=float)).astype(int)
    return sorted({int(v) for v in whole if 1 <= v <= top})


def _top(n_frames: int, dt_ps: float, max_lag_ns: float) -> int:
    top = min(n_frames - 1, int(round(max_lag_ns * 1000.0 / dt_ps)))
    if top < 1:
        raise ValueError("too few frames for any lag")
    return top


def early_and_log(n_frames: int, dt_ps: float, max_lag_ns: float, n_log: int, n_linear: int) -> list[int]:
    """Every lag up to ``n_linear``, ``n_log`` logarithmic ones from 1, and the largest."""
    top = _top(n_frames, dt_ps, max_lag_ns)
    spread = np.logspace(0, np.log10(top), n_log)
    return _clean(np.concatenate([np.arange(1, n_linear + 1), spread, [top]]), top)


def linear_then_log(n_frames: int, dt_ps: float, max_lag_ns: float, n_log: int, n_linear: int) -> list[int]:
    """Every lag up to ``n_linear``, then logarithmic ones above it."""
    top = min(n_frames - 1, int(max_lag_ns * 1000.0 // dt_ps))
    if top < 1:
        raise ValueError("too few frames for any lag")
    linear = min(n_linear, top)
    lags = list(range(1, linear + 1))
    if top > linear:
        spread = np.logspace(np.log10(linear + 1), np.log10(top), n_log)
        lags += [v for v in _clean(spread, top) if v > linear]
    return lags


def geometric(dt_ps: float, max_lag_ns: float, n: int) -> list[int]:
    top = frames_of(max_lag_ns * 1000.0, dt_ps)
    return [1] if top == 1 else _clean(np.geomspace(1, top, max(2, n)), top)


def requested(times_ps: Sequence[float], dt_ps: float, n_frames: int) -> list[int]:
    lags = _clean(np.asarray(times_ps, dtype=float) / dt_ps, n_frames - 1)
    if not lags:
        raise ValueError("no requested lag fits the frames")
    return lags


def stepped(
    n_frames: int, dt_ps: float, max_lag_ns: float, n_linear: int, dense_step_ns: float,
    dense_end_ns: float | None = None, late_step_ns: float | None = None,
) -> list[int]:
    """Early lags, a dense regular grid, optionally a coarser one after ``dense_end_ns``, and the largest."""
    top = min(n_frames - 1, frames_of(max_lag_ns * 1000.0, dt_ps))
    if top < 1:
        raise ValueError("too few frames for any lag")
    step = frames_of(dense_step_ns * 1000.0, dt_ps)
    end = top if dense_end_ns is None else min(top, frames_of(dense_end_ns * 1000.0, dt_ps))
    lags = set(range(1, n_linear + 1)) | set(range(step, end + 1, step)) | {top}
    if late_step_ns is not None:
        late = frames_of(late_step_ns * 1000.0, dt_ps)
        lags |= set(range(end + late, top + 1, late))
    return sorted(v for v in lags if v <= top)
