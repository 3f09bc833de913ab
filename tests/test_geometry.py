"""Periodic geometry against hand values and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.functions.geometry import BOX_COLUMNS, Vector, minimum_image, minimum_image_triclinic, vector
from ionweave.operators import contacts as ct
from ionweave.operators import mobility as mo
from ionweave.plans.registry import rounded


def one(spark, columns):
    return spark.range(1).select(*columns).first()


def test_minimum_image_with_unequal_edges_and_several_wraps(spark):
    d = Vector(F.lit(25.5), F.lit(-31.0), F.lit(-3.25))
    got = one(spark, minimum_image(d, Vector(F.lit(8.0), F.lit(14.0), F.lit(6.0))))
    assert list(got) == [1.5, -3.0, 2.75]


@pytest.mark.parametrize("d, want", [(5.0, 5.0), (15.0, -5.0)])
def test_half_box_goes_to_even_image(spark, d, want):
    v = Vector(*[F.lit(d)] * 3)
    assert one(spark, minimum_image(v, Vector(*[F.lit(10.0)] * 3)))[0] == want


def test_triclinic_matches_numpy(spark):
    rng = np.random.default_rng(1)
    box = (20.0, 22.0, 18.0, 80.0, 95.0, 70.0)
    a, b, c = box[:3]
    al, be, ga = np.radians(box[3:])
    cx, cy = c * np.cos(be), c * (np.cos(al) - np.cos(be) * np.cos(ga)) / np.sin(ga)
    m = np.array([[a, 0, 0], [b * np.cos(ga), b * np.sin(ga), 0], [cx, cy, np.sqrt(c * c - cx * cx - cy * cy)]])
    d = rng.uniform(-60, 60, (50, 3))
    f = d @ np.linalg.inv(m)
    want = (f - np.rint(f)) @ m
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(d)], "i int, x double, y double, z double")
    got = df.select("i", *minimum_image_triclinic(vector("x", "y", "z"), *[F.lit(v) for v in box])).orderBy("i").collect()
    assert np.allclose(np.array([r[1:] for r in got]), want)


def test_triclinic_with_right_angles_is_orthorhombic(spark):
    d = Vector(F.lit(7.5), F.lit(-3.25), F.lit(13.0))
    got = one(spark, minimum_image_triclinic(d, F.lit(8.0), F.lit(6.0), F.lit(11.0), *[F.lit(89.99993)] * 3))
    assert list(got) == [-0.5, 2.75, 2.0]


def test_unwrap_step(spark):
    rows = [(0, 0, 1.0, 3.0, 2.0, 12.0), (0, 1, 11.0, 7.0, 2.0, 12.0), (0, 2, 9.5, 1.0, 2.0, 12.0)]
    df = spark.createDataFrame(rows, "e int, frame bigint, x double, y double, z double, box double")
    got = mo.unwrap(df, ["e"]).orderBy("frame").collect()
    assert [r.ux for r in got] == [1.0, -1.0, -2.5]
    assert got[0].step is None and np.allclose([r.step for r in got[1:]], [np.hypot(2, 4), np.hypot(1.5, 6)])


@pytest.mark.parametrize("rule", ["current", "mean"])
@pytest.mark.parametrize("chunk", [3, 1000])
def test_unwrap_across_chunks(spark, rule, chunk):
    rng = np.random.default_rng(2)
    n = 40
    box = 10 + rng.uniform(0, 1, n)
    wrapped = rng.uniform(0, 10, (n, 3))
    want = [wrapped[0]]
    for t in range(1, n):
        length = box[t] if rule == "current" else (box[t] + box[t - 1]) / 2
        d = wrapped[t] - wrapped[t - 1]
        want.append(want[-1] + d - length * np.rint(d / length))
    df = spark.createDataFrame(
        [(7, t, *map(float, wrapped[t]), float(box[t])) for t in range(n)], "e int, frame bigint, x double, y double, z double, box double"
    )
    got = mo.unwrap(df, ["e"], rule=rule, chunk=chunk).orderBy("frame").collect()
    assert np.allclose([[r.ux, r.uy, r.uz] for r in got], want)


@pytest.mark.parametrize("box, cutoff", [(10.0, 3.0), (5.0, 2.4), (4.0, 3.9)])
def test_contact_join_matches_all_pairs(spark, box, cutoff):
    rng = np.random.default_rng(3)
    c, s = rng.uniform(-box, 2 * box, (30, 3)), rng.uniform(-box, 2 * box, (60, 3))
    d = c[:, None] - s[None]
    dist = np.sqrt(((d - box * np.rint(d / box)) ** 2).sum(-1))
    want = {(i, j) for i, j in zip(*np.where(dist <= cutoff))}
    cdf = spark.createDataFrame([(0, i, *map(float, r), box) for i, r in enumerate(c)], "frame bigint, center_id int, x double, y double, z double, box double")
    sdf = spark.createDataFrame([(0, i, *map(float, r), box) for i, r in enumerate(s)], "frame bigint, site_id int, x double, y double, z double, box double")
    got = ct.contact_join(cdf, sdf, cutoff).collect()
    assert len(got) == len(want) and {(r.center_id, r.site_id) for r in got} == want


def matrix(box):
    a, b, c = box[:3]
    al, be, ga = np.radians(box[3:])
    cx, cy = c * np.cos(be), c * (np.cos(al) - np.cos(be) * np.cos(ga)) / np.sin(ga)
    return np.array([[a, 0, 0], [b * np.cos(ga), b * np.sin(ga), 0], [cx, cy, np.sqrt(c * c - cx * cx - cy * cy)]])


SIX = "box_a double, box_b double, box_c double, alpha double, beta double, gamma double"


@pytest.mark.parametrize(
    "box, cutoff",
    [
        ((20.0, 22.0, 18.0, 80.0, 95.0, 70.0), 4.0),  # several cells
        ((9.0, 11.0, 8.0, 65.0, 110.0, 75.0), 5.5),  # the nearest of several images
        ((4.0, 30.0, 5.0, 60.0, 90.0, 115.0), 6.0),  # heights under the cutoff
        ((12.0, 7.0, 9.0, 90.0, 90.0, 90.0), 3.4),
    ],
)
def test_contact_join_in_any_box_matches_all_images(spark, box, cutoff):
    rng = np.random.default_rng(6)
    m = matrix(box)
    c, s = rng.uniform(-1.5, 2.5, (25, 3)) @ m, rng.uniform(-1.5, 2.5, (40, 3)) @ m
    s[3] = c[4]
    wrap = lambda x: x - np.floor(x @ np.linalg.inv(m)) @ m
    shifts = np.array([(i, j, k) for i in range(-5, 6) for j in range(-5, 6) for k in range(-5, 6)]) @ m
    d = wrap(s)[None, :, None] - wrap(c)[:, None, None] + shifts
    dist = np.sqrt((d**2).sum(-1)).min(-1)
    want = {(i, j): dist[i, j] for i, j in zip(*np.where(dist <= cutoff))}
    cdf = spark.createDataFrame([(0, i, *map(float, r), *box) for i, r in enumerate(c)], f"frame bigint, center_id int, x double, y double, z double, {SIX}")
    sdf = spark.createDataFrame([(0, i, "s", *map(float, r), *box) for i, r in enumerate(s)], f"frame bigint, site_id int, kind string, x double, y double, z double, {SIX}")
    got = ct.contact_join_cell(cdf, sdf, cutoff)
    assert got.columns == ["center_id", "frame", "site_id", "kind", "distance"]
    rows = got.collect()
    assert len(rows) == len(want) and {(r.center_id, r.site_id) for r in rows} == set(want)
    assert np.allclose([r.distance for r in rows], [want[r.center_id, r.site_id] for r in rows])


def test_contact_join_meets_a_site_once_in_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(ct, "PART", 16)
    rng = np.random.default_rng(8)
    box, cutoff = (20.0, 22.0, 18.0, 80.0, 95.0, 70.0), 9.0
    m = matrix(box)
    c, s = rng.uniform(0, 1, (12, 3)) @ m, rng.uniform(0, 1, (90, 3)) @ m
    cdf = spark.createDataFrame([(0, i, *map(float, r), *box) for i, r in enumerate(c)], f"frame bigint, center_id int, x double, y double, z double, {SIX}")
    sdf = spark.createDataFrame([(0, i, *map(float, r), *box) for i, r in enumerate(s)], f"frame bigint, site_id int, x double, y double, z double, {SIX}")
    shifts = np.array([(i, j, k) for i in range(-3, 4) for j in range(-3, 4) for k in range(-3, 4)]) @ m
    dist = np.sqrt(((s[None, :, None] - c[:, None, None] + shifts) ** 2).sum(-1)).min(-1)
    got = ct.contact_join_cell(cdf, sdf, cutoff).collect()
    assert {(r.center_id, r.site_id): round(r.distance, 9) for r in got} == {(i, j): round(float(dist[i, j]), 9) for i, j in zip(*np.where(dist <= cutoff))}
    assert len(got) == (dist <= cutoff).sum()
    # Beyond every distance all rows that meet stay: each center and site once.
    assert ct.contact_join_cell(cdf, sdf, 40.0).count() == 12 * 90


def test_missing_angle_is_an_error(spark):
    rows = spark.createDataFrame([(0, 1, 1.0, 1.0, 1.0, 9.0, 9.0, 9.0, 90.0, None, 90.0)], f"frame bigint, center_id int, x double, y double, z double, {SIX}")
    with pytest.raises(Exception, match="box number missing"):
        ct.contact_join_cell(rows, rows.withColumnRenamed("center_id", "site_id"), 3.0).collect()


def test_segment_center_in_a_slanted_box(spark):
    rng = np.random.default_rng(7)
    box = (9.0, 11.0, 8.0, 65.0, 110.0, 75.0)
    m = matrix(box)
    walk = np.cumsum(rng.normal(0, 0.8, (12, 3)), axis=0)
    wrapped = walk - np.floor(walk @ np.linalg.inv(m)) @ m
    df = spark.createDataFrame([(0, i, *map(float, r), *box) for i, r in enumerate(wrapped)], f"chain int, site bigint, x double, y double, z double, {SIX}")
    got = mo.segment_center(df, ["chain"], "site", 1, BOX_COLUMNS).orderBy("site").collect()
    base = walk - walk[0] + wrapped[0]
    want = [base[max(0, i - 1) : i + 2].mean(0) for i in range(12)]
    assert np.allclose([[r.sx, r.sy, r.sz] for r in got], want)


def test_radius_of_gyration(spark):
    rows = [(0, 1, 0.0, 0.0, 0.0, 1.0), (0, 1, 2.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "frame bigint, chain int, x double, y double, z double, mass double")
    assert mo.radius_of_gyration(df, "chain").first().rg == pytest.approx(1.0)


def test_alpha2_of_equal_displacements(spark):
    rows = [(e, t, float(t), 0.0, 0.0, "metal") for e in range(3) for t in range(4)]
    df = spark.createDataFrame(rows, "entity_id int, frame bigint, ux double, uy double, uz double, species string")
    r = mo.msd_ngp(df, [1]).first()
    assert r.msd == 1.0 and r.n == 9 and r.alpha2 == pytest.approx(-0.4)


def test_van_hove_bins_hold_their_lower_edge(spark):
    # 0.1 + 0.2 a step is 0.3 and belongs to the bin from 0.3 on, as 3 * 0.1 does.
    rows = [(e, "metal", f, x * f, 0.0, 0.0) for e, x in ((1, 0.1 + 0.2), (2, 0.3)) for f in (0, 1)]
    df = spark.createDataFrame(rows, "entity_id bigint, species string, frame bigint, ux double, uy double, uz double")
    got = mo.self_van_hove(df, [1]).filter("density > 0").collect()
    assert [(round(r.r, 6), r.n_samples) for r in got] == [(0.35, 2)]


def test_contact_join_makes_rows_of_near_pairs_only(spark, monkeypatch):
    monkeypatch.setattr(ct, "PART", 64)
    rng = np.random.default_rng(9)
    box = (40.0, 40.0, 40.0, 90.0, 90.0, 90.0)
    c, s = rng.uniform(0, 40, (150, 3)), rng.uniform(0, 40, (300, 3))
    cdf = spark.createDataFrame([(0, i, *map(float, r), *box) for i, r in enumerate(c)], f"frame bigint, center_id int, x double, y double, z double, {SIX}")
    sdf = spark.createDataFrame([(0, i, *map(float, r), *box) for i, r in enumerate(s)], f"frame bigint, site_id int, x double, y double, z double, {SIX}")
    d = c[:, None] - s[None]
    near = np.sqrt(((d - 40.0 * np.rint(d / 40.0)) ** 2).sum(-1)) <= 15.0
    df = ct.contact_join_cell(cdf, sdf, 15.0)
    assert df.count() == near.sum()
    # The rows that are joined are blocks: far fewer than the pairs they give.
    met = []
    monkeypatch.setattr(type(cdf), "mapInArrow", lambda df, *_: met.append(df.count()) or df)
    ct.contact_join_cell(cdf, sdf, 15.0)
    assert met[0] * 20 < near.sum()


@pytest.mark.parametrize("places", [0, 4, 6])
def test_rounding_equals_spark(spark, places):
    rng = np.random.default_rng(places)
    values = [*(rng.normal(size=400) * 10.0 ** rng.integers(-8, 17, 400)), *(rng.integers(-999, 999, 200) / 2000), 0.0, -0.0, 1e300]
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),), (float("inf"),), (None,)], "v double")
    fast = rounded(F.col("v"), places)
    got = df.select((fast + 0.0).alias("a"), (F.round("v", places) + 0.0).alias("b")).collect()
    assert [repr(r.a) for r in got] == [repr(r.b) for r in got]
