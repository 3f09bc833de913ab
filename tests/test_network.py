"""Components, windings, lineage, chain tables and sliding on hand data and brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.functions.geometry import BOX_COLUMNS
from ionweave.operators import aggregates as ag
from ionweave.operators import components as cp
from ionweave.operators import contacts as ct
from ionweave.operators import sliding as sl
from ionweave.operators import transport as tr
from ionweave.plans import catalog, q_network, registry  # noqa: F401


def test_components_and_ids(spark):
    edges = spark.createDataFrame([(5, 0, 10), (5, 1, 10), (5, 2, 11)], "frame bigint, center_id bigint, anion_id bigint")
    grid = spark.createDataFrame([(5, c) for c in range(4)], "frame bigint, center_id bigint")
    clusters = cp.cluster_table(cp.contact_components(edges, grid)).orderBy("root").collect()
    assert [(r.cluster_id, r.n_centers, r.n_anions) for r in clusters] == [("5_1", 2, 1), ("5_2", 1, 1), ("5_3", 1, 0)]


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for c, a in edges:
        p, q = find(("c", c)), find(("a", a))
        if p != q:
            parent[max(p, q)] = min(p, q)
    roots = {}
    for n in list(parent):
        roots.setdefault(find(n), []).append(n)
    return {n[1]: min(m[1] for m in ms if m[0] == "c") for ms in roots.values() for n in ms if n[0] == "c"}


@pytest.mark.parametrize("shape", ["path", "hub", "random"])
def test_components_match_brute_force(spark, shape):
    rng = random.Random(8)
    if shape == "path":
        order = list(range(120))
        rng.shuffle(order)
        pairs = {(c, i) for i, c in enumerate(order)} | {(c, i + 1) for i, c in enumerate(order)}
    elif shape == "hub":
        pairs = {(c, 0) for c in range(200)} | {(c, c) for c in range(1, 50)}
    else:
        pairs = {(rng.randrange(150), rng.randrange(150)) for _ in range(130)}
    df = spark.createDataFrame([(0, c, a) for c, a in pairs], "frame bigint, center_id bigint, anion_id bigint")
    got = {r.center_id: r.root for r in cp.label_centers(df).collect()}
    assert got == brute_components(pairs)


def gain_edges(spark, points, pairs, box):
    rows = []
    for c, a in pairs:
        pc, pa = points["c", c], points["a", a]
        g = [-int(np.rint((y - x) / box)) for x, y in zip(pc, pa)]
        rows.append((0, c, a, *map(float, pc), *map(float, pa), float(box), *g))
    return spark.createDataFrame(
        rows, "frame bigint, center_id bigint, anion_id bigint, cx double, cy double, cz double, ax double, ay double, az double, box double, gx bigint, gy bigint, gz bigint"
    )


@pytest.mark.parametrize("axes, rank", [("x", 1), ("xy", 2), ("xyz", 3)])
def test_winding_rank_and_axes(spark, axes, rank):
    points, pairs = {("c", 0): (0.0, 0.0, 0.0)}, []
    for i, axis in enumerate(axes):
        j = "xyz".index(axis)
        at = lambda v: tuple(v if k == j else 0.0 for k in range(3))
        a1, c1, a2 = 2 * i, i + 1, 2 * i + 1
        points |= {("a", a1): at(2.5), ("c", c1): at(5.0), ("a", a2): at(7.5)}
        pairs += [(0, a1), (c1, a1), (c1, a2), (0, a2)]
    edges = gain_edges(spark, points, pairs, 10.0)
    labels = cp.label_centers(edges, ag.GAINS)
    nodes = ag.aggregate_nodes(edges, labels, 1.0, 1.0)
    g = ag.component_geometry(edges, labels, nodes, 2).collect()
    assert len(g) == 1 and g[0].is_percolating == 1 and g[0].winding_rank == rank and g[0].winding_axes == axes
    # The stated cut: every node at its nearest image to the smallest center.
    pos = np.array([points[k] for k in points])
    pos = pos - 10 * np.floor(pos / 10 + 0.5)
    assert np.allclose([g[0].com_x, g[0].com_y, g[0].com_z], pos.mean(0)) and g[0].closure_residual == pytest.approx(0, abs=1e-9)
    assert g[0].rg == pytest.approx(np.sqrt(((pos - pos.mean(0)) ** 2).sum(1).mean()))


def test_geometry_in_a_slanted_box(spark):
    """One cluster over the boundary and one percolating along an edge, against a walk."""
    box = (9.0, 11.0, 8.0, 65.0, 110.0, 75.0)
    al, be, ga = np.radians(box[3:])
    cx, cy = box[2] * np.cos(be), box[2] * (np.cos(al) - np.cos(be) * np.cos(ga)) / np.sin(ga)
    m = np.array([[box[0], 0, 0], [box[1] * np.cos(ga), box[1] * np.sin(ga), 0], [cx, cy, np.sqrt(box[2] ** 2 - cx * cx - cy * cy)]])
    inv = np.linalg.inv(m)
    rng = np.random.default_rng(4)
    true = {("c", 0): rng.uniform(-1, 1, 3) @ np.eye(3)}
    for i in range(1, 5):
        true["a", i] = true["c", i - 1] + rng.uniform(-1.5, 1.5, 3)
        true["c", i] = true["a", i] + rng.uniform(-1.5, 1.5, 3)
    pairs = [(i - 1, i) for i in range(1, 5)] + [(i, i) for i in range(1, 5)]
    ring = {("c", 10): np.zeros(3), ("a", 10): m[1] * 0.25, ("c", 11): m[1] * 0.5, ("a", 11): m[1] * 0.75}
    pairs += [(10, 10), (11, 10), (11, 11), (10, 11)]
    spots = {k: p - np.floor(p @ inv) @ m for k, p in {**true, **ring}.items()}
    names = ", ".join(f"{n} double" for n in BOX_COLUMNS)
    rows = [(0, c, a, *map(float, spots["c", c]), *map(float, spots["a", a]), *box) for c, a in pairs]
    df = spark.createDataFrame(rows, f"frame bigint, center_id bigint, anion_id bigint, cx double, cy double, cz double, ax double, ay double, az double, {names}")
    edges = ag.image_gains(df, BOX_COLUMNS)
    labels = cp.label_centers(edges, ag.GAINS)
    geo = ag.component_geometry(edges, labels, ag.aggregate_nodes(edges, labels, 3.0, 1.0, BOX_COLUMNS), 1, BOX_COLUMNS).orderBy("root").collect()
    assert [(g.root, g.is_percolating, g.winding_rank, g.winding_axes) for g in geo] == [(0, 0, 0, "none"), (10, 1, 1, "y")]
    nearest = {k: p - np.floor(p @ inv + 0.5 + ag.HALF) @ m for k, p in ring.items()}
    for g, at, start in ((geo[0], true, ("c", 0)), (geo[1], nearest, ("c", 10))):
        w = np.array([3.0 if k[0] == "c" else 1.0 for k in at])
        pos = np.array(list(at.values())) - at[start] + spots[start]
        com = w @ pos / w.sum()
        assert np.allclose([g.com_x, g.com_y, g.com_z], com) and g.closure_residual < 1e-9 and g.gamma == 75.0
        assert g.rg == pytest.approx(np.sqrt((w * ((pos - com) ** 2).sum(1)).sum() / w.sum()))


def test_geometry_of_a_wrapped_cluster(spark):
    rng = np.random.default_rng(6)
    true = {("c", i): rng.uniform(-2, 2, 3) + 9.5 for i in range(4)} | {("a", i): rng.uniform(-2, 2, 3) + 9.5 for i in range(4)}
    wrapped = {k: tuple(v % 10.0) for k, v in true.items()}
    pairs = [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (0, 3)]
    edges = gain_edges(spark, wrapped, pairs, 10.0)
    labels = cp.label_centers(edges, ag.GAINS)
    g = ag.component_geometry(edges, labels, ag.aggregate_nodes(edges, labels, 3.0, 1.0), 1).first()
    m = np.array([3.0] * 4 + [1.0] * 4)
    pos = np.array(list(true.values()))
    com = m @ pos / m.sum()
    assert g.is_percolating == 0 and g.charge == 0
    assert g.rg == pytest.approx(np.sqrt((m * ((pos - com) ** 2).sum(1)).sum() / m.sum()))
    diff = np.array([g.com_x, g.com_y, g.com_z]) - com
    assert np.allclose(diff - 10 * np.rint(diff / 10), 0)


def component_rows(spark, frames):
    rows = [(f, "anion" if n >= 100 else "center", n, min(s)) for f, sets in enumerate(frames) for s in sets for n in s]
    return spark.createDataFrame(rows, "frame bigint, kind string, node_id bigint, root bigint")


def greedy(frames, threshold):
    def key(s):
        c, a = sorted(n for n in s if n < 100), sorted(n for n in s if n >= 100)
        return (-len(s), "M:" + ",".join(map(str, c)) + "|T:" + ",".join(map(str, a)))

    out = {}
    for f in range(1, len(frames)):
        before, now = sorted(frames[f - 1], key=key), sorted(frames[f], key=key)
        cand = sorted(
            ((len(p & c) / len(p | c), i, j) for i, p in enumerate(before) for j, c in enumerate(now) if len(p & c) / len(p | c) >= threshold), reverse=True
        )
        up, uc = set(), set()
        for s, i, j in cand:
            if i not in up and j not in uc:
                up.add(i)
                uc.add(j)
                out[f, min(now[j])] = (min(before[i]), round(s, 9))
    return out


def test_lineage_keeps_the_larger_child(spark):
    df = component_rows(spark, [[{1, 2, 3}], [{1, 2}, {3, 4}]])
    links = ag.lineage_links(df)
    assert [(r.current, r.previous, round(r.score, 6)) for r in links.collect()] == [(1, 1, 0.666667)]
    rows = ag.lineages(df, links, 10.0).orderBy("lineage_id").collect()
    assert [(r.lineage_id, r.first_frame, r.n_frames) for r in rows] == [("L0000001", 0, 2), ("L0000002", 1, 1)]


@pytest.mark.parametrize("threshold", [0.5, 0.2])
def test_lineage_matches_the_greedy_order(spark, threshold):
    rng = random.Random(9)
    frames = []
    for _ in range(8):
        # Every set starts with its own center, so each component has a smallest center.
        sets = [{c} for c in range(1, 13)]
        for n in list(range(20, 32)) + list(range(100, 124)):
            sets[rng.choice((n % 12, n % 12, (n + 1) % 12))].add(n)
        frames.append(sets)
    df = component_rows(spark, frames)
    got = {(r.frame, r.current): (r.previous, round(r.score, 9)) for r in ag.lineage_links(df, threshold).collect()}
    assert got == greedy(frames, threshold)


def test_lineage_splits_and_merges_at_one_half(spark):
    df = component_rows(spark, [[{1, 2, 101, 102}], [{1, 101}, {2, 102}], [{1, 2, 101, 102}]])
    rows = {(r.frame, r.current): (r.previous, r.is_merge, r.is_split) for r in ag.lineage_links(df).collect()}
    # The later one in list order wins the tie: keys "M:1|..." < "M:2|...".
    assert rows == {(1, 2): (1, 0, 1), (2, 1): (2, 1, 0)}


def test_chain_tables(spark):
    sites = [(0, 1), (0, 2), (1, 5), (2, 12)]
    df = spark.createDataFrame([(0, c, "polymer", 7, s, 2.0) for c, s in sites], "frame bigint, center_id int, ligand_kind string, ligand_id bigint, site_index bigint, distance double")
    grid = spark.createDataFrame([(0, 7), (0, 8)], "frame bigint, chain_id bigint")
    full, empty = ct.chain_occupancy(df, grid).orderBy("chain_id").collect()
    assert (full.n_pairs, full.n_local_pairs, full.n_remote_pairs, full.min_separation) == (3, 1, 2, 3)
    assert (empty.n_centers, empty.n_pairs, empty.min_separation) == (0, 0, None)


def test_min_separation_matches_brute_force(spark):
    rng = random.Random(3)
    rows = {(f, c, s) for f in range(5) for c in range(6) for s in rng.sample(range(1, 60), 4)}
    df = spark.createDataFrame([(f, c, "polymer", 7, s, 2.0) for f, c, s in rows], "frame bigint, center_id int, ligand_kind string, ligand_id bigint, site_index bigint, distance double")
    for chunk in (5, 1000):
        got = {r.frame: r.min_separation for r in ct.min_site_separation(df, chunk).collect()}
        for f in range(5):
            assert got[f] == min(abs(s - t) for g, c, s in rows if g == f for h, d, t in rows if h == f and c != d)


def test_transition_types(spark):
    steps = [(-1, -1, 0, 3), (0, 3, 0, 4), (0, 4, 0, 7), (0, 7, 1, 2), (1, 2, -1, -1)]
    df = spark.createDataFrame(steps, "a int, b int, c int, d int")
    got = [r[0] for r in df.select(sl.transition_type(*[F.col(x) for x in "abcd"])).collect()]
    assert got == ["attachment", "neighbour_slide", "large_jump", "interchain_hop", "detachment"]


def test_smoothing(spark):
    rows = [(0, 1, 0, 3), (1, 1, 1, 9), (2, 1, 0, 5)]
    df = spark.createDataFrame(rows, "frame bigint, center_id int, chain bigint, site bigint").withColumn("coordinate", F.lit(1.0))
    mid = sl.smooth_states(df).filter("frame = 1").first()
    assert (mid.smooth_chain, mid.smooth_site) == (0, 4)


def test_dominant_chain_carries_ties(spark):
    rng = random.Random(11)
    contacts, truth = [], {}
    for center in range(4):
        previous = -1
        for f in range(60):
            if rng.random() < 0.06:
                previous = -1
                continue
            tied = rng.random() < 0.85
            chains = rng.sample(range(4), rng.choice((2, 3))) if tied else [rng.randrange(4)]
            dist = {c: round(rng.uniform(2, 3), 3) for c in chains}
            contacts += [(f, center, "polymer", c, 10 + c, d) for c, d in dist.items()]
            previous = previous if previous in chains else min(chains, key=lambda c: (dist[c], c))
            truth[f, center] = previous
    df = spark.createDataFrame(contacts, "frame bigint, center_id int, ligand_kind string, ligand_id bigint, site_index bigint, distance double")
    got = {(r.frame, r.center_id): (r.chain, r.site) for r in sl.dominant_chain(df, 50).collect()}
    assert got == {k: (c, 10 + c) for k, c in truth.items()}


def test_correlations_decompose(spark):
    rng = np.random.default_rng(12)
    species = ["metal", "metal", "cation", "anion", "anion"]
    pos = rng.normal(size=(5, 15, 3)).cumsum(1)
    df = spark.createDataFrame(
        [(e, s, t, *map(float, pos[e, t])) for e, s in enumerate(species) for t in range(15)], "entity_id int, species string, frame bigint, ux double, uy double, uz double"
    )
    z = {"metal": 2.0, "cation": 1.0, "anion": -1.0}
    r = tr.charge_msd(tr.collective_correlations(df, [3]), z).first()
    q = np.array([z[s] for s in species])
    total = np.tensordot(q, pos, 1)
    assert r.charge_msd == pytest.approx(((total[3:] - total[:-3]) ** 2).sum(-1).mean())
    step = pos[:, 3:] - pos[:, :-3]
    assert r.self_anion == pytest.approx((step[3:] ** 2).sum((0, 2)).mean())
    assert r.charge_msd_correlation == pytest.approx(r.charge_msd - r.charge_msd_self)


def test_conductivity_value(spark):
    got = spark.range(1).select(tr.conductivity(F.lit(1.0), 1000.0, 300.0)).first()[0]
    assert got == pytest.approx(1.602176634e-19**2 * 1e-8 / (6 * 1e-27 * 1.380649e-23 * 300) * 10)


def contact_rows(seed, centers, frames, keep):
    rng = random.Random(seed)
    rows = []
    for t in range(frames):
        at = [rng.uniform(0, 20) for _ in range(3)]
        for c in range(centers):
            if rng.random() < keep:
                rows.append((t, c, 0, *[rng.uniform(0, 20) for _ in range(3)], *at, 20.0))
    return rows


CONTACT = "frame bigint, center_id bigint, anion_id bigint, cx double, cy double, cz double, ax double, ay double, az double, box double"


def test_bridge_moments_equal_the_listed_bridges(spark):
    pairs = spark.createDataFrame(contact_rows(5, 6, 12, 0.75), CONTACT)
    lags, first, last = [1, 2, 4], F.lit(0), F.lit(11)
    listed = ag.bridge_rows(ag.bridge_pairs(pairs))
    spot = lambda k, o: pairs.select("frame", "anion_id", F.col("center_id").alias(k), *[F.col(f"c{a}").alias(f"{o}{a}") for a in "xyz"])
    where = pairs.select("frame", "anion_id", *[F.col(f"a{a}").alias(f"t{a}") for a in "xyz"], "box").distinct()
    rows = listed.join(spot("center_a", "m1"), ["frame", "anion_id", "center_a"]).join(spot("center_b", "m2"), ["frame", "anion_id", "center_b"])
    sums = ag.bridge_lag_sums(rows.join(where, ["frame", "anion_id"]), lags, 7.0, 280.0)
    events = ag.bridge_events(listed, first, last, 30.0).select("instance_id", "completed", "persistence_class")
    curves = ag.bridge_curves(sums.join(events, "instance_id"), 5, 10).filter("group_type = 'all'")
    want = {(r.scope, r.lag): r.asDict() for r in curves.collect()}
    got = ag.bridge_moment_curves(ag.bridge_moments(pairs, lags, 7.0, 280.0, first, last), 5, 10).collect()
    assert {(r.scope, r.lag) for r in got} == set(want) and len(want) >= 5
    for r in got:
        for name, value in r.asDict().items():
            assert value == (pytest.approx(want[r.scope, r.lag][name], rel=1e-9) if isinstance(value, float) else want[r.scope, r.lag][name]), name


def test_bridge_moments_of_a_crowded_anion(spark):
    """Ten thousand centers at one anion: fifty million bridges, thirty thousand rows."""
    n, move = 10_000, 0.25
    c = spark.range(3).withColumnRenamed("id", "frame").join(spark.range(n).withColumnRenamed("id", "center_id"))
    turn = F.when(F.col("center_id") % 2 == 0, 1.0).otherwise(-1.0) * move * F.col("frame")
    pairs = c.select(
        "frame", "center_id", F.lit(0).cast("bigint").alias("anion_id"), (10.0 + turn).alias("cx"), F.lit(10.0).alias("cy"), F.lit(10.0).alias("cz"),
        *[F.lit(10.0).alias(f"a{a}") for a in "xyz"], F.lit(20.0).alias("box"),
    )
    moments = ag.bridge_moments(pairs, [1], 7.0, 280.0, F.lit(0), F.lit(9)).filter("scope = 'all_observed'").first()
    bridges = n * (n - 1) // 2
    opposite = (n // 2) ** 2
    assert (moments.n_events, moments.n_origins, moments.n_cos) == (bridges, 2 * bridges, 2 * bridges)
    assert moments.sum_rel2 == pytest.approx(2 * opposite * (2 * move) ** 2)
    assert moments.sum_cos == pytest.approx(2 * (bridges - 2 * opposite))
    assert moments.sum_mid2 == pytest.approx(2 * (bridges - opposite) * move**2)
    assert ag.bridge_counts(pairs).first().n_bridges == bridges


def test_bridge_moments_of_no_rows(spark):
    none = spark.createDataFrame([], CONTACT)
    assert ag.bridge_moments(none, [1], 7.0, 280.0, F.lit(0), F.lit(9)).count() == 0
    assert ag.bridge_counts(none).count() == 0


def test_dominant_chain_ties_on_equal_means(spark):
    # 0.1 + 0.2 and 0.15 + 0.15 are equal distances, though not as sums of doubles.
    rows = [(0, 1, "polymer", 0, 3, 0.1), (0, 1, "polymer", 0, 4, 0.2), (0, 1, "polymer", 1, 3, 0.15), (0, 1, "polymer", 1, 4, 0.15)]
    df = spark.createDataFrame(rows, "frame bigint, center_id bigint, ligand_kind string, ligand_id bigint, site_index bigint, distance double")
    assert [r.chain for r in sl.dominant_chain(df, 50).collect()] == [0]


def test_components_many_boxes_long_match_their_sql(spark, monkeypatch):
    # Twelve centers on a line of ten boxes, and a ring through the boundary.
    line = [(0, i + k, i, 18.0 * (i + k) % 20, (18.0 * i + 9) % 20) for i in range(11) for k in (0, 1)]
    ring = [(1, i, a, 7.0 * i % 20, (7.0 * a + 3.5) % 20 if a < 2 else 17.0) for i, a in ((0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (0, 2))]
    rows = [(f, c, a, cx, 1.0, 1.0, ax, 1.0, 1.0, 20.0) for f, c, a, cx, ax in line + ring]
    names = "frame center_id anion_id cx cy cz ax ay az box".split()
    con = duckdb.connect()
    con.execute("CREATE TABLE given (" + ", ".join(f"{n} {'BIGINT' if i < 3 else 'DOUBLE'}" for i, n in enumerate(names)) + ")")
    con.executemany("INSERT INTO given VALUES (" + ", ".join("?" * 10) + ")", rows)
    for name in ("pairs", "edges"):
        monkeypatch.setitem(registry.CTES, name, "SELECT * FROM given")
        monkeypatch.setitem(registry.NEEDS, name, [])
    cols = "frame, root, n_nodes, round(rg, 6), is_percolating, winding_rank, winding_axes"
    want = con.execute(registry.with_tables(f"SELECT {cols} FROM geo ORDER BY frame", "geo")).fetchall()
    edges = ag.image_gains(spark.createDataFrame(rows, ", ".join(f"{n} {'bigint' if i < 3 else 'double'}" for i, n in enumerate(names))))
    labels = cp.label_centers(edges, ag.GAINS)
    got = ag.component_geometry(edges, labels, ag.aggregate_nodes(edges, labels, q_network.MC, q_network.MA), 2)
    got = got.withColumn("rg", F.round("rg", 6)).orderBy("frame").select("frame", "root", "n_nodes", "rg", "is_percolating", "winding_rank", "winding_axes")
    assert [tuple(r) for r in got.collect()] == want
    assert [(r[2], r[4], r[6]) for r in want] == [(23, 0, "none"), (6, 1, "x")]


def test_finished_components_leave_the_rounds(spark, monkeypatch):
    written = []
    for name in ("cut", "staged"):
        keep = getattr(cp, name, None)
        if keep is not None:
            def counted(df, *rest, keep=keep):
                out = keep(df, *rest)
                written.append(out.count())
                return out

            monkeypatch.setattr(cp, name, counted)
    path = [(c, c + d) for c in range(60) for d in (0, 1)]
    pairs = path + [(c, c + 10) for c in range(1000, 1400)]
    df = spark.createDataFrame([(0, c, a) for c, a in pairs], "frame bigint, center_id bigint, anion_id bigint")
    got = {r.center_id: r.root for r in cp.label_centers(df).collect()}
    assert got == {c: 0 if c < 60 else c for c, _ in pairs}
    assert sum(written) < 2 * len(pairs)


def test_chain_bridges_copy_a_site_to_few_stretches(spark):
    rng = random.Random(3)
    rows = sorted({(0, rng.randrange(12), "polymer", 1, rng.randrange(-40, 60)) for _ in range(150)})
    df = spark.createDataFrame([(*r, 2.0) for r in rows], "frame bigint, center_id bigint, ligand_kind string, ligand_id bigint, site_index bigint, distance double")
    best = {}
    for a in rows:
        for b in rows:
            if a[1] < b[1] and abs(a[4] - b[4]) <= 4:
                best[a[1], b[1]] = min(best.get((a[1], b[1]), 99), abs(a[4] - b[4]))
    bridges = ct.chain_bridges(df)
    assert {(r.center_a, r.center_b): r.separation for r in bridges.collect()} == best
    # Every site was copied to each site of its band.
    assert "sequence((site_index" not in bridges._jdf.queryExecution().optimizedPlan().toString()


def test_events_shorter_than_the_smallest_lag_meet_no_nodes(spark, monkeypatch):
    # Event A lasts three frames, B two, every C one; P percolates.
    spans = {"A": (0, 3), "B": (5, 7), "P": (0, 3)} | {f"C{i}": (i, i + 1) for i in range(20)}
    rows = [(f, root, name, 1.0 + f, 2.0, 3.0, 20.0, 1.0 + f) for root, (name, (a, b)) in enumerate(spans.items()) for f in range(a, b)]
    nodes = [(r[0], r[1], "center", r[1] * 10 + k, 2.0, r[3] + k * r[0], r[4], r[5]) for r in rows for k in (0, 1)]
    events = [(name, int(name == "P"), a, b - 1) for name, (a, b) in spans.items()]
    given = []

    def counting(df, *args, lag_pairs=ag.lag_pairs, **more):
        given.append(df.select("instance_id").distinct().count())
        return lag_pairs(df, *args, **more)

    monkeypatch.setattr(ag, "lag_pairs", counting)
    got = ag.aggregate_lag_sums(
        spark.createDataFrame(rows, "frame bigint, root bigint, instance_id string, com_x double, com_y double, com_z double, box double, rg double"),
        spark.createDataFrame(events, "instance_id string, is_percolating int, start_frame bigint, end_frame bigint"),
        spark.createDataFrame(nodes, "frame bigint, root bigint, kind string, node_id bigint, mass double, x double, y double, z double"), [1, 2],
    ).collect()
    # One node of two stands still beside the center of mass, the other moves by one length a frame.
    want = [("A", 1, 2, 2.0, 2.0, 1.0, 2), ("A", 2, 1, 4.0, 4.0, 2.0, 1), ("B", 1, 1, 1.0, 1.0, 0.5, 1)]
    assert sorted(tuple(r) for r in got) == want
    assert given == [2, 2]


@pytest.mark.parametrize("chunk", [7, 20_000])
def test_dominant_chain_looks_back_over_chunks(spark, monkeypatch, chunk):
    rng = random.Random(4)
    contacts, truth = [], {}
    for center in range(6):
        previous = -1
        for f in range(70):
            if rng.random() < 0.04:
                previous = -1
                continue
            chains = rng.sample(range(4), rng.choice((2, 3))) if rng.random() < 0.9 or center == 5 else [rng.randrange(4)]
            dist = {c: round(rng.uniform(2, 3), 3) for c in chains}
            contacts += [(f, center, "polymer", c, 10 + c, d) for c, d in dist.items()]
            previous = previous if previous in chains else min(chains, key=lambda c: (dist[c], c))
            truth[f, center] = (previous, 10 + previous)
    cuts = []
    monkeypatch.setattr(sl, "cut", lambda df, cut=sl.cut: cuts.append(df) or cut(df))
    df = spark.createDataFrame(contacts, "frame bigint, center_id bigint, ligand_kind string, ligand_id bigint, site_index bigint, distance double")
    rows = (sl.dominant_chain(df, 50, chunk=chunk) if chunk < 100 else sl.dominant_chain(df, 50)).collect()
    assert len(rows) == len(truth) and {(r.frame, r.center_id): (r.chain, r.site) for r in rows} == truth
    # One pass over the rows, unless ties cross from chunk to chunk.
    assert bool(cuts) == (chunk < 100)


@pytest.mark.parametrize("chunk", [5, 20_000])
def test_dwells_are_put_together_over_chunks(spark, chunk):
    rng = random.Random(8)
    states, contacts, want = {}, set(), {}
    for center in range(4):
        event, was = 0, None
        for f in range(40):
            now = was if was and rng.random() < 0.7 + 0.1 * center else rng.choice([(-1, -1), (0, 3), (0, 4), (1, 3)])
            states[f, center] = now
            bound = {(rng.choice(["polymer", "anion"]), rng.randrange(3), rng.randrange(4)) for _ in range(rng.randrange(4))}
            contacts |= {(f, center, *b, 2.0) for b in bound}
            event, was = event + (now != was), now
            chains, anions = {b[1] for b in bound if b[0] == "polymer"}, {b[1] for b in bound if b[0] == "anion"}
            row = (f, bool(anions), len(chains) >= 2, sum(b[0] == "polymer" for b in bound), len(chains))
            want.setdefault((center, event, *now), []).append(row)
    # A cell without a state is in no dwell.
    contacts.add((40, 0, "anion", 1, 1, 2.0))
    smooth = spark.createDataFrame([(f, c, *s) for (f, c), s in states.items()], "frame bigint, center_id bigint, smooth_chain bigint, smooth_site bigint")
    rows = spark.createDataFrame(sorted(contacts), "frame bigint, center_id bigint, ligand_kind string, ligand_id bigint, site_index bigint, distance double")
    got = sl.dwell_events(smooth, rows, F.lit(0), F.lit(39), 2.0, chunk=chunk).collect()
    assert len(got) == len(want)
    for r in got:
        cells = want[r.center_id, r.event, r.chain, r.site]
        f, anion, multi, sites, chains = zip(*cells)
        assert (r.start_frame, r.end_frame, r.n_frames, r.duration_ps) == (f[0], f[-1], len(f), 2.0 * len(f))
        assert (r.left_censored, r.right_censored, r.is_bound) == (f[0] == 0, f[-1] == 39, r.chain >= 0)
        assert (r.anion_any, r.multichain_any) == (any(anion), any(multi))
        means = [sum(c) / len(f) for c in (anion, multi, sites, chains)]
        assert [r.anion_fraction, r.multichain_fraction, r.mean_sites, r.mean_chains] == pytest.approx(means)


@pytest.mark.parametrize("chunk", [4, 20_000])
def test_smoothing_of_choices_exchanges_rows_once(spark, chunk):
    rng = random.Random(6)
    grid = spark.createDataFrame([(f, c) for f in range(20) for c in range(3)], "frame bigint, center_id bigint")
    rows = [(f, c, rng.randrange(2), rng.randrange(1, 4), 1.5) for f in range(22) for c in range(3) if rng.random() < 0.7]
    chosen = spark.createDataFrame(rows, "frame bigint, center_id bigint, chain bigint, site bigint, coordinate double")
    smooth = sl.smooth_chosen(chosen, grid, chunk=chunk)
    assert smooth._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = sl.smooth_states(sl.chain_states(chosen, grid))
    assert sorted(map(str, smooth.collect())) == sorted(map(str, want.collect()))
