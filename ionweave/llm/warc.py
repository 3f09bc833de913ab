"""WARC archives: a writer that turns equal payloads into revisit records, and a Spark data source that reads them.

Files are sequences of gzip members, one per record. Each member tells its compressed length in the
gzip extra field ``sl``, so a reader inflates a record's headers first and steps over the rest of
a record that is not wanted. Readers plan whole files into partitions by size, take equality and IN
filters on record type and other header columns, and decode payloads only if the column is asked for.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from ionweave.llm.common import salted_join
from ionweave.llm.files import local_path, opened
from ionweave.session import staged

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_HEAD = struct.Struct("<4sIBBHccHII")
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
HEADERS = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
MANIFEST = "file string, n_records long, bytes long"
#: Bytes after which a task starts a new file, and planned bytes of a reading task.
FILE_BYTES, TASK_BYTES = 64 << 20, 16 << 20


def member(data: bytes) -> bytes:
    """One gzip member; its extra field ``sl`` holds the lengths of the whole member and of the data."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = GZIP_HEAD.size + len(body) + 8
    head = GZIP_HEAD.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"s", b"l", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(uri: str) -> int | None:
    digits = uri[len("<urn:page:") : -1]
    return int(digits) if digits else None


def record(page: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, kind: str) -> bytes:
    """A response record with the payload behind its HTTP head, or a revisit record with the head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if kind == "response" else http
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page)}", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_id(refers_to)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def with_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` as (page_id, url, payload, sha1, record_type, refers_to).

    Of the rows with an equal payload of at least ``least`` bytes those with the largest page_id are
    responses, the others revisit it; where all have a null page_id, all are responses.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    narrow = rows.filter(F.octet_length("payload") >= least).select("sha1", "page_id")
    shared = narrow.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    shared = staged(shared.select("sha1", "refers_to"), "shared_payloads")
    # Only the small table of repeated payloads meets the rows; hot payloads are dealt by page.
    salt = F.xxhash64("page_id", "url")
    out = salted_join(rows, shared, "sha1", salt, "left")
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.octet_length("payload") >= least)
    return out.select(
        "page_id", "url", "payload", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("refers_to")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, path: str, least: int = 1000) -> DataFrame:
    """Write a record per row to files under ``path`` and return the manifest of the committed files.

    Defined cases: a null html is an empty payload; null page_ids and urls are left out of the
    headers' values; repeated rows give a record each; an empty table gives an empty manifest;
    other columns are ignored. Tasks that are run again write new files; the manifest has the last,
    and readers take the files of the manifest alone.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, parts, size, count = [], [], 0, 0

        def close() -> None:
            if parts:
                target = f"{path}/{uuid.uuid4().hex}.warc.gz"
                system, place = opened(target)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place, compression=None) as out:
                    for p in parts:
                        out.write(p)
                done.append((target, count, size))

        for batch in batches:
            for row in batch.to_pylist():
                part = member(record(row["page_id"], row["url"], row["payload"], row["sha1"], row["refers_to"], row["record_type"]))
                parts.append(part)
                size += len(part)
                count += 1
                if size >= FILE_BYTES:
                    close()
                    parts, size, count = [], 0, 0
        close()
        columns = list(zip(*done)) if done else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["file", "n_records", "bytes"]
        )

    with_records(pages, least).mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines if line)}


def _wanted(row: dict, tests: Sequence[tuple[str, tuple]]) -> bool:
    return all(row[c] in values for c, values in tests)


def records(data: memoryview | bytes, tests: Sequence[tuple[str, tuple]], payloads: bool) -> Iterator[dict]:
    """The records of an archive that pass ``tests`` on header columns; payloads are inflated on demand only."""
    at, end = 0, len(data)
    while at < end:
        _, _, _, _, _, _, _, _, size, _ = GZIP_HEAD.unpack_from(data, at)
        inflate, body, fed = zlib.decompressobj(-15), b"", at + GZIP_HEAD.size
        stop = at + size - 8
        # Headers first: small steps until the blank line behind the HTTP head.
        while body.count(b"\r\n\r\n") < 2 and fed < stop:
            step = bytes(data[fed : min(stop, fed + 512)])
            body += inflate.decompress(step)
            fed += len(step)
        warc, http, rest = body.split(b"\r\n\r\n", 2)
        fields, inner = _fields(warc), _fields(http)
        row = {
            "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
            "refers_to": _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
            "payload_bytes": int(inner["content-length"]),
            "payload_digest": base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), "payload": None,
        }
        if _wanted(row, tests):
            if payloads and row["record_type"] == "response":
                whole = rest + inflate.decompress(bytes(data[fed:stop])) + inflate.flush()
                row["payload"] = whole[: row["payload_bytes"]]
                if len(row["payload"]) != row["payload_bytes"]:
                    raise ValueError(f"record {row['page_id']} is cut short")
            yield row
        at += size


class Files(InputPartition):
    """Archive files that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    """Plans files by size and reads headers before payloads."""

    def __init__(self, options: dict, columns: Sequence[str]):
        self.path, self.columns, self.tests = options["path"], list(columns), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((column, (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, tuple(v for v in f.value if v is not None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, place = opened(self.path)
        listed = [f.path for f in system.get_file_info(fs.FileSelector(f"{place}/manifest")) if f.base_name.endswith(".parquet") and f.base_name[0] not in "._"]
        # Files of lost or repeated tasks are in no manifest. Names are taken from it without their folder, which may have moved.
        rows = [r for p in listed for r in pq.ParquetFile(system.open_input_file(p)).read(["file", "bytes"]).to_pylist()]
        sizes = sorted(((r["bytes"], f"{self.path}/{r['file'].rpartition('/')[2]}") for r in rows), reverse=True)
        plan, held = [[]], 0
        for size, name in sizes:
            if plan[-1] and held + size > TASK_BYTES:
                plan.append([])
                held = 0
            plan[-1].append(name)
            held += size
        return [Files(p) for p in plan]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        schema = pa.schema([schema.field(c) for c in self.columns])
        for name in partition.paths:
            place = local_path(name)
            if place is not None:
                data = pa.memory_map(place).read_buffer()
            else:
                system, place = opened(name)
                with system.open_input_file(place) as f:
                    data = f.read_buffer()
            rows, held = [], 0
            for row in records(memoryview(data), self.tests, "payload" in self.columns):
                rows.append({c: row[c] for c in self.columns})
                held += len(row["payload"] or b"")
                if len(rows) >= 2048 or held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``columns`` narrows the schema, so payloads are not decoded without need."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _columns(self) -> list[str]:
        every = [c.strip().split(" ")[0] for c in RECORD.split(",")]
        asked = self.options.get("columns")
        return [c for c in every if c in asked.split(",")] if asked else every

    def schema(self) -> str:
        kinds = dict(c.strip().split(" ") for c in RECORD.split(","))
        return ", ".join(f"{c} {kinds[c]}" for c in self._columns())

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, [f.name for f in schema.fields])


def read_warc(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The records under ``path``; filters on header columns are pushed into the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    read = spark.read.format("warc")
    return (read.option("columns", ",".join(columns)) if columns else read).load(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), sizes and digests of stored payloads taken anew from them."""
    headers = [c for c in HEADERS if c != "url"]
    stored = read_warc(spark, path, [*headers, "payload"]).filter(F.col("record_type") == "response")
    stored = stored.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    again = read_warc(spark, path, headers).filter(F.col("record_type") == "revisit")
    return stored.select(*headers).unionByName(again.select(*headers))
