"""Dump parsing, codecs, sinks, checks and the stream."""

import pytest
from pyspark.sql import functions as F

from ionweave.functions import codecs
from ionweave.operators import pairs as pr
from ionweave.sources import checks as ck
from ionweave.sources import dump, tables
from ionweave.streaming.pair_tracker import closed_events, pair_events_stream

FRAME = "ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0.0 10.0\n0.0 20.0\n-5.0 5.0\nITEM: ATOMS id type {cols}\n2 1 {b}\n1 3 {a}\n"


def write(tmp_path, **kw):
    text = FRAME.format(step=100, **kw) + FRAME.format(step=50, **kw)
    (tmp_path / "run.dump").write_text(text)
    return str(tmp_path / "run.dump")


def test_read_dump(spark, tmp_path):
    got = dump.read_dump(spark, write(tmp_path, cols="x y z", a="1 2 3", b="4 5 6")).orderBy("frame", "atom_id").collect()
    assert [(r.frame, r.step, r.atom_id, r.type, r.x, r.y, r.z) for r in got] == [
        (0, 50, 1, 3, 1.0, 2.0, 3.0), (0, 50, 2, 1, 4.0, 5.0, 6.0), (1, 100, 1, 3, 1.0, 2.0, 3.0), (1, 100, 2, 1, 4.0, 5.0, 6.0)
    ]
    assert (got[0].box_a, got[0].box_b, got[0].box_c, got[0].mode) == (10.0, 20.0, 10.0, "wrapped")


def test_scaled_and_unwrapped_columns(spark, tmp_path):
    r = dump.read_dump(spark, write(tmp_path, cols="xs ys zs", a="0.5 0.5 0.5", b="0 0 0")).filter("atom_id = 1").first()
    assert (r.x, r.y, r.z, r.mode) == (5.0, 10.0, 0.0, "wrapped")
    r = dump.read_dump(spark, write(tmp_path, cols="x y z xu yu zu", a="1 1 1 11 1 1", b="0 0 0 0 0 0")).filter("atom_id = 1").first()
    assert (r.x, r.mode) == (11.0, "unwrapped")


def test_unknown_columns_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="coordinate columns"):
        dump.read_dump(spark, write(tmp_path, cols="vx vy vz", a="1 1 1", b="0 0 0")).collect()


def test_codecs(spark):
    df = spark.createDataFrame([("3;1; ;x;3.0", '{"7":2}', '{"8":[3,4]}', '{"7":2,"x":1}'), ("nan", "", "{}", "oops")], "a string, b string, c string, d string")
    rows = df.select(
        codecs.decode_id_list(F.col("a")).alias("a"), codecs.decode_site_map(F.col("b")).alias("b"),
        codecs.decode_site_map(F.col("c")).alias("c"), codecs.decode_count_map(F.col("d")).alias("d"),
    ).collect()
    assert rows[0].a == [1, 3] and rows[0].b == {7: [0, 1]} and rows[0].c == {8: [3, 4]} and rows[0].d == {7: 2}
    assert rows[1].a == [] and rows[1].b == {} and rows[1].c == {} and rows[1].d == {}
    back = df.select(codecs.encode_id_list(F.array(F.lit(3), F.lit(1), F.lit(3))).alias("s")).first()
    assert back.s == "1;3"


@pytest.mark.parametrize("fmt", ["parquet", "csv", "csv.gz"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 0.5, 7, 2), (0, float("nan"), 8, 3)], "frame bigint, time_ps double, center_id bigint, n_site bigint")
    tables.write_tables({"master": df}, str(tmp_path), fmt)
    got = tables.read_master(spark, f"{tmp_path}/master", fmt="csv" if fmt.startswith("csv") else fmt).orderBy("frame").collect()
    assert [(r.frame, r.time_ps, r.center_id, r.n_site) for r in got] == [(0, None, 8, 3), (1, 0.5, 7, 2)]
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_master(spark, f"{tmp_path}/master", ["frame", "nothing"], fmt="csv" if fmt.startswith("csv") else fmt)


def test_selection_must_match(spark):
    df = spark.createDataFrame([(1, "a")], "atom_id int, role string")
    with pytest.raises(ValueError, match="no atoms"):
        tables.select_atoms(df.select("atom_id"), df, F.col("role") == "b")


def test_frame_time_falls_back(spark):
    df = spark.createDataFrame([(2, 7.0), (3, float("nan")), (4, None)], "frame bigint, t double")
    assert [r.time_ps for r in tables.frame_time(df, 10.0, time="t").orderBy("frame").collect()] == [7.0, 30.0, 40.0]


def test_validation_status(spark):
    df = spark.range(5)
    hard = ck.validation_table(df, {"few": (F.count(F.lit(1)) < 3, F.count(F.lit(1)))})
    soft = ck.validation_table(df, {"few": (F.count(F.lit(1)) < 3, F.count(F.lit(1)))}, ["few"])
    status = lambda t: t.filter("check = 'status'").first().status
    assert status(hard) == "FAILED" and status(soft) == "PASSED_WITH_WARNINGS"


def test_stream_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = [(f, c, a, 1, 2.0, 2.0) for f in range(30) for c in range(3) for a in range(2) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "frame bigint, center_id bigint, anion_id bigint, n_sites int, min_distance double, mean_distance double")
    frames = spark.range(30).withColumnRenamed("id", "frame")
    source = str(tmp_path / "in")
    for lo in range(0, 30, 10):
        part = df.filter((F.col("frame") >= lo) & (F.col("frame") < lo + 10)).withColumn("ordinal", F.col("frame"))
        part.select("center_id", "anion_id", "frame", "ordinal").coalesce(1).write.mode("append").parquet(source)
    schema = "center_id bigint, anion_id bigint, frame bigint, ordinal bigint"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        pair_events_stream(stream).writeStream.format("memory").queryName("numbered").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.table("numbered")
    batch = pr.pair_events(df, frames, 10.0)
    cols = ["frame", "center_id", "anion_id", "event_number", "age_frames", "continuing", "new_event"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    assert closed_events(got, 29).filter("is_open = 1").count() == df.filter("frame = 29").count()


def test_stream_hands_on_late_rows_and_restarts(spark, tmp_path):
    schema = "center_id bigint, anion_id bigint, frame bigint, ordinal bigint"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for ordinals in ([0, 1], [1, 2, 5], [0, 6]):
        spark.createDataFrame([(1, 2, o * 10, o) for o in ordinals], schema).coalesce(1).write.mode("append").parquet(source)
        stream = pair_events_stream(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out)
        stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(out).collect()
    late = [(r.ordinal, r.event_number) for r in got if r.is_late]
    assert sorted(late) == [(0, None), (1, None)]
    kept = sorted((r.ordinal, r.event_number, r.age_frames) for r in got if not r.is_late)
    assert [(o, a) for o, _, a in kept] == [(0, 1), (1, 2), (2, 3), (5, 1), (6, 2)]
    assert len({e for _, e, _ in kept}) == 2


def test_master_file_to_contacts(spark, tmp_path):
    text = 'frame,metal_atom_id,n_peo_oxygen,coordination_state,peo_chain_eo_mapping,tfsi_denticity\n3,9,2,PT,"{""7"": [4, 5]}","{""2"": 2, ""5"": 1}"\n4,9,0,F,,{}\n'
    (tmp_path / "m.csv").write_text(text)
    master = tables.read_master(spark, str(tmp_path / "m.csv"), ["frame", "center_id", "state"], "csv")
    assert [r.state for r in master.orderBy("frame").collect()] == ["PT", "F"]
    got = sorted(map(tuple, tables.contacts_from_master(master).collect()))
    assert got == [(3, 9, "anion", 2, 1), (3, 9, "anion", 2, 2), (3, 9, "anion", 5, 1), (3, 9, "polymer", 7, 4), (3, 9, "polymer", 7, 5)]


def test_tilted_box(spark):
    text = "0\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS xy xz yz pp pp pp\n0 13 3\n0 10 0\n0 10 0\nITEM: ATOMS id type xs ys zs\n1 1 0.5 0.5 0.5\n"
    r = dump.parse_dump(spark.createDataFrame([(text,)], "value string")).first()
    assert (r.x, r.y, r.z, r.box_a, r.box_c, r.alpha, r.beta) == (6.5, 5.0, 5.0, 10.0, 10.0, 90.0, 90.0)
    assert abs(r.box_b - 109**0.5) < 1e-12 and abs(r.gamma - 73.30075576600639) < 1e-9


def test_denticity_texts(spark):
    from ionweave.operators.ligands import denticity_text_check

    texts = ['{"1":2,"4":1}', "", None, "  ", "{}", '{"1":0,"2":-1}', '{"1":2', '{"1":"x"}', "[1]", "word", '{"1":1.5}', '{"1":null}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.check: (r.passed, r.value) for r in denticity_text_check(rows, {"polymer": "t"}).collect()}
    assert got == {"bad_text_polymer": (0, 6.0), "nonpositive_polymer": (0, 2.0)}
    assert {r.value for r in denticity_text_check(rows.limit(0), {"polymer": "t"}).collect()} == {0.0}


def test_contacts_from_master_reads_each_row_once(spark):
    rows = [(0, 1, '{"7":[1,2],"x":[4]}', '{"3":2,"4":0}'), (0, 2, None, '{"5":1}'), (1, 2, "{}", None), (1, 3, '{"8":2}', "nan")]
    master = spark.createDataFrame(rows, "frame bigint, center_id bigint, chain_sites string, anion_counts string")
    contacts = tables.contacts_from_master(master)
    assert sorted(tuple(r) for r in contacts.collect()) == [
        (0, 1, "anion", 3, 1), (0, 1, "anion", 3, 2), (0, 1, "polymer", 7, 1), (0, 1, "polymer", 7, 2), (0, 2, "anion", 5, 1),
        (1, 3, "polymer", 8, 0), (1, 3, "polymer", 8, 1),
    ]
    assert "Union" not in contacts._jdf.queryExecution().optimizedPlan().toString()
