"""Runs, censoring, survival, transitions and exchange on hand data."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.operators import contacts as ct
from ionweave.operators import events as ev
from ionweave.operators import exchange as ex
from ionweave.operators import pairs as pr
from ionweave.operators import population as po

FRAMES = [0, 1, 2, 5, 6, 10]


def presence(spark):
    return spark.createDataFrame([(1, f) for f in FRAMES], "k int, frame bigint")


@pytest.mark.parametrize("gap, want", [(0, [(0, 2), (5, 6), (10, 10)]), (2, [(0, 6), (10, 10)])])
def test_presence_runs(spark, gap, want):
    got = ev.presence_runs(presence(spark), ["k"], gap).orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == want


def test_contact_events_count_tolerated_gaps(spark):
    e = ev.contact_events(presence(spark), ["k"], F.lit(0), F.lit(10), 10.0).filter("rule = 'intermittent'").orderBy("start_frame").collect()
    assert [(r.duration_ps, r.left_censored, r.right_censored) for r in e] == [(70.0, 1, 0), (10.0, 0, 1)]


def test_states(spark):
    df = spark.createDataFrame([(3, 0), (2, 1), (0, 2), (0, 0)], "n_site int, n_anion int")
    assert [r.state for r in ct.with_state(df).collect()] == ["P", "PT", "T", "F"]


def survival_events(spark):
    rows = [(10.0, 0), (10.0, 0), (20.0, 0), (30.0, 1)]
    return spark.createDataFrame(rows, "duration_ps double, right_censored int").withColumns(
        {"occupancy_ps": F.col("duration_ps"), "left_censored": F.lit(0), "g": F.lit("x")}
    )


def test_kaplan_meier(spark):
    got = ev.kaplan_meier(survival_events(spark), ["g"], 1).orderBy("time_ps").collect()
    assert [(r.time_ps, r.survival) for r in got] == [(0.0, 1.0), (10.0, 0.5), (20.0, 0.25), (30.0, 0.25)]
    few = ev.kaplan_meier(survival_events(spark), ["g"]).collect()
    assert len(few) == 4 and {r.is_supported for r in few} == {0}


def test_pair_survival_has_no_origin_row(spark):
    curve = pr.pair_survival(survival_events(spark))
    assert [r.survival for r in curve.orderBy("time_ps").collect()] == [0.5, 0.25, 0.25]
    assert pr.median_survival(curve).first()[0] == 10.0


def test_state_transitions(spark):
    df = spark.createDataFrame([(1, 0, "P"), (1, 1, "P"), (1, 2, "T"), (1, 4, "P")], "center_id int, frame bigint, state string")
    got = {(r.from_state, r.to_state): r for r in ev.state_transitions(df).collect()}
    assert len(got) == 16
    assert got["P", "P"]["count"] == 1 and got["P", "T"]["count"] == 1 and got["T", "P"]["count"] == 0
    assert got["P", "T"].p_all == 0.5 and got["P", "T"].p_change == 1.0 and got["T", "P"].p_all == 0.0


def test_ligand_exchange(spark):
    p = spark.createDataFrame([("anion_molecule", 1, q, f) for f, s in ((0, (1, 2)), (1, (2, 3))) for q in s], "contact_type string, center_id int, partner_id int, frame bigint")
    grid = spark.createDataFrame([(0, 1), (1, 1)], "frame bigint, center_id int")
    r = ev.ligand_exchange(p, grid, F.lit(0), F.lit(1), types=("anion_molecule",)).collect()
    assert len(r) == 1
    assert (r[0].n_previous, r[0].n_current, r[0].n_gained, r[0].n_lost, r[0].n_retained, r[0].occurred) == (2, 2, 1, 1, 1, 1)


def test_shell_retention(spark):
    s = spark.createDataFrame([("anion", f, 1, m) for f, ms in ((0, (1, 2, 3)), (1, (2, 3, 4))) for m in ms], "shell string, frame bigint, center_id int, member int")
    r = ex.shell_retention(s, [1]).filter("origin = 0").withColumns(ex.retention_columns(F.col("n_initial"), F.col("n_final"), F.col("n_retained"))).first()
    assert r.retention == pytest.approx(2 / 3) and r.jaccard == 0.5 and r.n_exchange == 2


def test_retention_bins(spark):
    df = spark.createDataFrame([(0.2,), (0.8,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(ex.retention_bin(F.col("x"))).collect()] == ["0.2-0.4", "0.8-1.0", "0.8-1.0", None]


def test_pair_events_follow_processed_frames(spark):
    pairs = spark.createDataFrame([(f, 1, 2, 1, 2.0, 2.0) for f in (0, 10, 30, 40)], "frame bigint, center_id int, anion_id int, n_sites int, min_distance double, mean_distance double")
    frames = spark.createDataFrame([(f,) for f in (0, 10, 20, 30, 40)], "frame bigint")
    got = pr.pair_events(pairs, frames, 1.0, stride=10).orderBy("frame").collect()
    assert [(r.event_number, r.age_frames, r.start_frame) for r in got] == [(1, 1, 0), (1, 2, 0), (2, 1, 30), (2, 2, 30)]
    assert got[-1].instance_id == "M1_T2_E0002"


def series(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "frame bigint, value double")


@pytest.mark.parametrize("values, want", [((1, 1, 1), [1, 0, 0]), ((1, 2, 3), [1, 0, -1.5])])
def test_autocorrelation(spark, values, want):
    got = po.population_acf(series(spark, values), 2).orderBy("lag").collect()
    assert [r.acf for r in got] == pytest.approx(want)


def test_integrated_time_uses_every_lag_to_the_sign_change(spark):
    x = np.repeat([1.0, 2.0, 5.0, 3.0, 1.0, 0.0], 4)
    d = x - x.mean()
    acf = [np.mean(d[: len(d) - k] * d[k:]) / np.mean(d * d) for k in range(len(d))]
    stop = next(k for k, v in enumerate(acf) if k and v <= 0)
    for per_pass in (1, 3, 100):
        r = po.integrated_time(series(spark, x), lags_per_pass=per_pass).first()
        assert r.tau_frames == pytest.approx(0.5 + sum(acf[1:stop]))


def test_rolling_mean(spark):
    got = po.population_rolling_mean(series(spark, [1, 2, 3, 4, 5]), 4).orderBy("frame").collect()
    assert [r.rolling_mean for r in got] == [1.5, 2.0, 2.5, 3.5, 4.0]


def test_linear_trend_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.arange(20.0)
    y = 2 * x + rng.normal(size=20)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = po.linear_trend(df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    res = y - slope * x - intercept
    assert r.slope == pytest.approx(slope) and r.intercept == pytest.approx(intercept)
    assert r.slope_error == pytest.approx(np.sqrt(res @ res / 18 / ((x - x.mean()) ** 2).sum()))
    assert po.linear_trend(df.limit(2), "x", "y").first().slope is None


def test_sites_past_a_thousand_stay_apart(spark):
    rows = [(0, 7, "polymer", 1, 1001), (0, 7, "polymer", 2, 1), (1, 7, "polymer", 1, 1001)]
    contacts = spark.createDataFrame(rows, "frame bigint, center_id bigint, ligand_kind string, ligand_id bigint, site_index bigint")
    sites = ev.contact_presence(contacts).filter("contact_type = 'polymer_site' AND frame = 0")
    assert {(r.partner_id, r.site_index) for r in sites.collect()} == {(1, 1001), (2, 1)}
    assert ex.shell_sets(contacts).filter("shell = 'chain_site' AND frame = 0").count() == 2
    steps = ex.shell_steps(ex.shell_sets(contacts)).filter("frame = 1").first()
    assert (steps.x_chain_site, steps.x_chain) == (1, 1)


def test_shell_retention_counts_members_that_come_back(spark):
    rng = random.Random(11)
    rows = {(s, f, c, m, -1) for s in ("anion", "chain") for f in range(14) for c in (1, 2) for m in range(5) if rng.random() < 0.55}
    df = spark.createDataFrame(list(rows), "shell string, frame bigint, center_id bigint, member bigint, site_index bigint")
    lags = [1, 3, 6]
    got = {(r.shell, r.center_id, r.lag, r.origin): (r.n_initial, r.n_final, r.n_retained) for r in ex.shell_retention(df, lags).collect()}
    sets = {}
    for s, f, c, m, _ in rows:
        sets.setdefault((s, c, f), set()).add(m)
    want = {}
    for s, c, f in sets:
        for v in lags:
            for t in (f, f - v):
                a, b = sets.get((s, c, t), set()), sets.get((s, c, t + v), set())
                want[s, c, v, t] = (len(a), len(b), len(a & b))
    assert got == want


def test_shell_retention_shuffles_members_once_for_all_lags(spark):
    df = spark.createDataFrame([("anion", 0, 1, 2, -1)], "shell string, frame bigint, center_id bigint, member bigint, site_index bigint")
    counts = [ex.shell_retention(df, lags)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for lags in ([1], [1, 2, 3, 5, 8])]
    assert counts[0] == counts[1] <= 3


def test_bootstrap_interval_equals_a_loop_over_replicates(spark, monkeypatch):

    from ionweave.operators import comotion as cm

    rng = np.random.default_rng(3)
    rows = [(f"e{i}", lag, i % 3 != 0, ["x", "y", None][i % 3 if i else 2], int(rng.integers(1, 5)), float(rng.uniform(1, 9)))
            for i in range(40) for lag in (1, 2, 5) if (i + lag) % 4]
    rows += [("lonely", 9, False, "x", 3, 6.0), ("lonely", 5, False, "x", 2, None)]
    df = spark.createDataFrame([(e, lag, int(c), k, n, v) for e, lag, c, k, n, v in rows], "e string, lag bigint, completed int, kind string, n_origins bigint, s double")
    replicates = 10
    metric = {"m": F.col("s") / F.col("n_origins")}

    def weight(event, r):
        word = hashlib.md5(f"5|{r // 4}|{event}".encode()).hexdigest()[8 * (r % 4):8 * (r % 4) + 8]
        return sum(int(word, 16) / 2**32 >= edge for edge in cm.POISSON_EDGES)

    want = {}
    for scope in ("all_observed", "completed_only"):
        for kind in ("all", "kind"):
            cells = {}
            for e, lag, c, k, n, v in rows:
                if c or scope == "all_observed":
                    cells.setdefault((scope, kind, "all" if kind == "all" else k, lag), []).append((e, n, v or 0.0))
            for at, members in cells.items():
                ratios = []
                for r in range(replicates):
                    n = sum(weight(e, r) * n for e, n, _ in members)
                    if n and len(members) > 1:
                        ratios.append(sum(weight(e, r) * v for e, _, v in members) / n)
                ends = (np.quantile(ratios, 0.025), np.quantile(ratios, 0.975)) if ratios else (None, None)
                want[at] = (len(members), *ends)
    for partial in (1 << 23, 1):
        monkeypatch.setattr(cm, "PARTIAL", partial)
        got = cm.bootstrap_ci(df, {"all": None, "kind": "kind"}, ["s"], metric, "e", replicates, seed=5).collect()
        assert {(r.scope, r.group_type, r.group_label, r.lag) for r in got} == set(want)
        for r in got:
            n, low, high = want[r.scope, r.group_type, r.group_label, r.lag]
            assert r.n_events == n
            assert (r.m_low, r.m_high) == ((None, None) if low is None else (pytest.approx(low), pytest.approx(high)))
    assert cm.bootstrap_ci(df.limit(0), {"all": None}, ["s"], metric, "e", replicates).count() == 0
