"""Registered queries of the training-data operators: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm import clusters, fingerprints, languages, licenses, mixing, neardup, packing, sharding, spelling, token_files, topk, toxicity, warc
from ionweave.llm.common import prepared
from ionweave.llm.tokens import vocabulary
from ionweave.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf}/{name}.parquet")


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@_query
def op1_token_files(spark: SparkSession, sf: str) -> DataFrame:
    documents, path = _table(spark, sf, "documents"), scratch(spark, "token_files")
    token_files.write_token_files(documents, path, vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


@_query
def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf, "documents")).drop("text_hash")


@_query
def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages, path = _table(spark, sf, "pages"), scratch(spark, "warc")
    warc.write_warc(pages, path)
    return warc.page_records(spark, path)


@_query
def op4_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf, "documents")).drop("copies")


@_query
def op5_stratified_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.stratified_shards(_table(spark, sf, "documents"))


@_query
def op6_pack_documents(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@_query
def op7_top_products(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_products(_table(spark, sf, "embeddings"))


@_query
def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf, "documents"))


@_query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@_query
def op10_scan_licences(spark: SparkSession, sf: str) -> DataFrame:
    out = licenses.scan_licences(_table(spark, sf, "documents"))
    return out.withColumn("templates", F.array_join("templates", ","))


@_query
def op11_centroid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.clusters_with_inertia(_table(spark, sf, "embeddings"))


@_query
def op12_languages(spark: SparkSession, sf: str) -> DataFrame:
    return languages.identify_languages(_table(spark, sf, "documents"))


@_query
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf, "documents"))


# The order key: 60 bits of the MD5 of "<seed>:<doc_id>", or of the text's MD5 where the id is null.
_KEY = "CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 15)) AS BIGINT)"
_GROUP = "coalesce('=' || source, '')"

ORACLES["op4_mix_sources"] = f"""
WITH d AS (SELECT doc_id, source, {_GROUP} AS g, {_KEY.format(seed=0)} AS k,
 CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT g, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY g),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, CAST(source_size AS DOUBLE) * 2 AS cap FROM s),
o AS (SELECT *, sum(w) OVER (ORDER BY cap / w, g) AS w_upto, sum(cap) OVER (ORDER BY cap / w, g) AS cap_upto,
 sum(w) OVER () AS w_all, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS budget FROM w),
lv AS (SELECT arg_min((budget - cap_upto + cap) / (w_all - w_upto + w), w_upto) AS lv FROM o
 WHERE (budget - cap_upto + cap) / (w_all - w_upto + w) <= cap / w),
t AS (SELECT g, source_size, CAST(least(cap, w * lv) AS DOUBLE) AS target FROM w, lv),
u AS (SELECT g, k, sum(size) AS size FROM d GROUP BY g, k),
c AS (SELECT u.g, k, size, sum(size) OVER (PARTITION BY u.g ORDER BY k) AS upto, target - floor(target / source_size) * source_size AS room
 FROM u JOIN t ON t.g = u.g WHERE source_size > 0),
e AS (SELECT g, min(k) AS at_key FROM c WHERE upto > room GROUP BY g),
b AS (SELECT c.g, CASE WHEN (room - upto + size) * 2 >= size THEN c.k + 1 ELSE c.k END AS bound FROM c JOIN e ON c.g = e.g AND c.k = e.at_key WHERE room > 0)
SELECT doc_id, source, size, source_size, target,
 CAST(size * (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END + CASE WHEN k < coalesce(bound, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN t ON t.g = d.g LEFT JOIN b ON b.g = d.g"""


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after another: assignment, then floors of the means."""
    squares = "list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"
    text = f"""WITH p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM
 (SELECT v, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM p ORDER BY h, v LIMIT {k}))"""
    for i in range(rounds + 1):
        text += f""",
a{i} AS MATERIALIZED (SELECT r, vec_id, p.v, unnest(m) FROM (SELECT r, vec_id, v, min({{'distance': d, 'c': c}}) AS m FROM
 (SELECT r, vec_id, p.v, c.c, CAST({squares} AS BIGINT) AS d FROM p, c{i} c) p GROUP BY ALL) p)"""
        if i < rounds:
            text += f""",
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN
 (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM
 (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY c, i) GROUP BY c) m ON m.c = c{i}.c)"""
    return text + f"""
SELECT vec_id, a.c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


ORACLES["op11_centroid_clusters"] = _cluster_sql()
