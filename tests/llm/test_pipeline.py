"""The pipeline: each stage keeps what it must and its decisions take effect."""

import sys
from pathlib import Path

from test_texts import labelled

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from ionweave.llm.common import prepared  # noqa: E402
from ionweave.session import scratch  # noqa: E402


def test_pipeline(spark):
    prepared(spark)
    rows, marks = labelled()
    rows += [(500 + i, rows[1][1], "s1", "en", 1, 1, None, 1) for i in range(5)]
    folder = scratch(spark, "test_pipeline")
    docs = spark.createDataFrame([(r[0], r[1], r[3], r[2], len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([m[:3] for m in marks], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    held, at = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, folder).write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        assert at.columns == docs.columns
        held.append([r.doc_id for r in at.collect()])
    assert not [i for i in held[0] if i < 400 and i % 4 == 0] and len(held[0]) == 305
    assert sorted(held[1]) == sorted(i for i in held[0] if i < 500)
    assert set(held[2]) <= set(held[1]) and max(map(held[2].count, set(held[2]))) == 2
    packed = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in packed.filter("piece = 0").select("doc_id").collect()) == sorted(held[2])
