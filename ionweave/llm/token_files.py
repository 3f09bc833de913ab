"""Token-id output: flat unsigned integers and 64-bit document offsets.

A data set is a folder with, per shard, ``<stem>.bin`` (ids, little-endian, 16 bits where the
vocabulary allows it, else 32), ``<stem>.idx`` (n + 1 little-endian 64-bit offsets in ids from
the start of the shard) and ``<stem>.docs`` (document ids, an Arrow file). Shards and the
documents in them are in ascending doc_id order. The manifest, a Parquet table, lists the
committed shards; a shard's base in the whole data set is the sum of the ids before it.
A retried task writes new stems; what a lost task left is not in the manifest and never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.common import prefix_sums
from ionweave.llm.files import local_path, opened
from ionweave.llm.tokens import encoder

MANIFEST = "shard long, stem string, n_docs long, n_ids long, width int"
#: Bytes of ids held before they are written out.
FLUSH = 8 << 20


def write_token_files(documents: DataFrame, path: str, vocabulary: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the data set to ``path``; returns the manifest.

    Defined cases: a null text is an empty one and gives the end id alone; null doc_ids come first
    and rows of one doc_id are ordered by their text; an empty table gives a manifest of empty
    shards; other columns are ignored; very long texts are encoded whole.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = rows.repartitionByRange(shards, *order[:2]) if shards else rows.repartitionByRange(*order[:2])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        width = 2 if encoder(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        stem = f"{path}/{shard:08d}-{uuid.uuid4().hex[:12]}"
        system, place = opened(stem)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        lengths, ids, held, end = [], [], 0, np.array([end_id], dtype=f"<u{width}").tobytes()
        names = []
        with system.open_output_stream(f"{place}.bin") as out:
            for batch in batches:
                names.append(batch.column(0))
                for text in batch.column(1).to_pylist():
                    raw = encode(text)
                    lengths.append(len(raw) // 4 + 1)
                    ids.append(raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes())
                    ids.append(end)
                    held += len(raw)
                    if held > FLUSH:
                        out.write(b"".join(ids))
                        ids, held = [], 0
            out.write(b"".join(ids))
        offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype="<i8"))]).astype("<i8")
        with system.open_output_stream(f"{place}.idx") as out:
            out.write(offsets.tobytes())
        field = pa.schema([pa.field("doc_id", names[0].type if names else pa.int64())])
        with system.open_output_stream(f"{place}.docs") as out, pa.ipc.new_file(out, field) as ipc:
            for column in names:
                ipc.write_batch(pa.RecordBatch.from_arrays([column], schema=field))
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "stem": [stem], "n_docs": [len(lengths)], "n_ids": [int(offsets[-1])], "width": pa.array([width], pa.int32())}
        )

    rows.sortWithinPartitions(*order).mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("id_type", F.lit(kind))


def _mapped(uri: str, kind: str) -> np.ndarray:
    place = local_path(uri)
    if place is not None:
        with open(place, "rb") as f:
            empty = not f.read(1)
        return np.empty(0, kind) if empty else np.memmap(place, dtype=kind, mode="r")
    system, place = opened(uri)
    with system.open_input_file(place) as f:
        return np.frombuffer(f.read(), dtype=kind)


def read_token_files(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(doc_id, shard, start, n_tokens, ids_crc32) per document, from the files alone.

    ``start`` counts the ids of all documents before it; the checksum is over 32-bit little-endian ids.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    based = prefix_sums(manifest, [], "shard", "n_ids", "base").filter("n_docs > 0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets = _mapped(f"{row['stem']}.bin", f"<u{row['width']}"), _mapped(f"{row['stem']}.idx", "<i8")
                system, place = opened(f"{row['stem']}.docs")
                with system.open_input_file(place) as f:
                    docs = pa.ipc.open_file(f).read_all().column(0)
                for a in range(0, row["n_docs"], 4096):
                    cut = offsets[a : a + 4097]
                    sums = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(cut[:-1], cut[1:])]
                    n = len(sums)
                    yield pa.RecordBatch.from_arrays(
                        [
                            docs.slice(a, n).combine_chunks(), pa.array(np.full(n, row["shard"])), pa.array(cut[:-1] + row["base"]),
                            pa.array(np.diff(cut)), pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"],
                    )

    files = max(1, based.count())
    spread = based.select("shard", "stem", "n_docs", "width", "base").repartition(files, "shard")
    return spread.mapInArrow(read, f"doc_id {id_type}, shard long, start long, n_tokens long, ids_crc32 long")
