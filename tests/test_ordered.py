"""Chunked cores against plain Python, with chunks small enough to cut every key."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionweave.functions import lags as lg
from ionweave.operators import blocks as bl
from ionweave.operators import ordered as o
from ionweave.operators.quantiles import exact_quantile


def expected_runs(frames, values, limit):
    out, run, start, last = {}, 0, None, None
    for f, v in sorted(zip(frames, values)):
        if last is None or f - last[0] > limit or v != last[1]:
            run, start = run + 1, f
        out[f], last = (run, start), (f, v)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.integers(0, 60), min_size=1), st.integers(0, 2), st.sampled_from([1, 3, 7, 100]))
def test_runs_do_not_depend_on_chunks(spark, frames, gap, chunk):
    values = {f: f // 9 % 2 for f in frames}
    df = spark.createDataFrame([("k", f, values[f]) for f in frames], "k string, frame bigint, v int")
    got = o.runs(df, ["k"], "frame", tolerance=gap, value=["v"], chunk=chunk).collect()
    want = expected_runs(list(frames), [values[f] for f in frames], gap + 1)
    assert {r.frame: (r.run, r.run_start) for r in got} == want


@pytest.mark.parametrize("chunk", [2, 5, 1000])
def test_hot_key_is_split_and_exact(spark, chunk):
    rows = [("hot", f) for f in range(0, 200, 2)] + [("cold", 3), ("cold", 50)]
    df = spark.createDataFrame(rows, "k string, frame bigint")
    got = {(r.k, r.frame): (r.ordinal, r.n) for r in o.ordinals(df, ["k"], "frame", total="n", chunk=chunk).collect()}
    assert all(got[("hot", f)] == (f // 2, 100) for f in range(0, 200, 2))
    assert got[("cold", 3)] == (0, 2) and got[("cold", 50)] == (1, 2)


@pytest.mark.parametrize("chunk", [4, 9, 1000])
def test_lag_pairs_matches_all_origins(spark, chunk):
    rng = random.Random(5)
    frames = sorted(rng.sample(range(80), 60))
    df = spark.createDataFrame([(1, f, float(f * f), 1) for f in frames], "e int, frame bigint, x double, one int")
    lags = [1, 2, 7]
    got = o.lag_pairs(df, ["e"], "frame", lags, ["x"], ["x"], between={"seen": F.col("one")}, stride=2, chunk=chunk).collect()
    have = set(frames)
    want = {(f, v): sum(1 for g in frames if f < g <= f + v) for f in frames if f % 2 == 0 for v in lags if f + v in have}
    assert {(r.frame, r.lag): r.seen for r in got} == want
    assert all(r.end_x == float((r.frame + r.lag) ** 2) and r.x == float(r.frame**2) for r in got)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_neighbours(spark, chunk):
    frames = [0, 1, 2, 4, 5, 6, 7]
    df = spark.createDataFrame([(1, f, f * 10) for f in frames], "e int, frame bigint, v int")
    got = o.neighbours(df, ["e"], "frame", {"l": -1, "r": 1}, ["v"], chunk).collect()
    value = lambda s: None if s is None else s.v
    want = {f: ((f - 1) * 10 if f - 1 in frames else None, (f + 1) * 10 if f + 1 in frames else None) for f in frames}
    assert {r.frame: (value(r.l), value(r.r)) for r in got} == want


def test_frame_blocks(spark):
    df = spark.range(12).withColumnRenamed("id", "frame")
    sizes = [r["count"] for r in bl.frame_blocks(df, 5).groupBy("block").count().orderBy("block").collect()]
    assert sizes == [3, 3, 2, 2, 2]
    with pytest.raises(Exception, match="fewer than 5 frames"):
        bl.frame_blocks(spark.range(3).withColumnRenamed("id", "frame"), 5).collect()


def test_exact_quantile(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=501), "b": rng.exponential(size=1000), "c": np.array([2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k string, v double")
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {r.k: r.quantile for r in exact_quantile(df, ["k"], "v", q, accuracy=50).collect()}
        for k, v in data.items():
            assert got[k] == pytest.approx(np.quantile(v, q))


def test_exact_quantile_narrows_until_few_values_are_left(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    data = {
        "wide": np.exp(rng.normal(scale=20, size=900)), "ties": rng.integers(0, 3, size=900).astype(float), "same": np.full(400, 7.0),
        "signed": rng.normal(size=700), "gap": np.array([-1e9] * 50 + [1e9] * 50), "one": np.array([3.5]),
    }
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("none", None)], "k string, v double")
    for q in (0.0, 0.37, 0.5, 1.0):
        got = {r.k: r.quantile for r in exact_quantile(df, ["k"], "v", q, accuracy=8, limit=5, cells=4).collect()}
        assert set(got) == set(data)
        for k, v in data.items():
            assert got[k] == pytest.approx(np.quantile(v, q)), (k, q)
    alone = exact_quantile(df.filter("k = 'signed'"), [], "v", 0.5, accuracy=8, limit=5, cells=4).first().quantile
    assert alone == pytest.approx(np.median(data["signed"]))
    assert exact_quantile(df.filter("v is null"), ["k"], "v", 0.5).count() == 0


def test_lag_lists():
    assert lg.linear_then_log(100, 10.0, 1.0, 5, 10)[:10] == list(range(1, 11))
    assert lg.linear_then_log(100, 10.0, 1.0, 5, 10)[-1] == 99
    assert lg.requested([10, 20, 24, 26, 5000], 10.0, 50) == [1, 2, 3]
    assert lg.geometric(10.0, 0.01, 5) == [1]
    assert lg.early_and_log(50, 10.0, 100.0, 6, 3)[-1] == 49
    assert lg.stepped(1000, 1000.0, 40.0, 5, 10.0, 20.0, 15.0) == [1, 2, 3, 4, 5, 10, 20, 35, 40]
