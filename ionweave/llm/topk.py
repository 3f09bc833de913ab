"""Exact top-k by integer inner product, over candidates in descending length.

Candidates are packed into blocks of rows of descending norm. Their common directions, the
eigenvectors of the sum of outer products, rotate queries and candidates so that the first
coordinates hold most of a product. A block of queries first meets the blocks of longest vectors,
which gives each query a score to beat; a later block is skipped for a query when the product of
norms can't reach that score, and a candidate when the partial sum plus the Cauchy-Schwarz bound of
the remaining coordinates can't. What is left is scored in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.llm.common import salted_join
from ionweave.session import staged

#: Vectors in a block.
BLOCK = 512
BLOCK_SCHEMA = "block long, top double, n int, dims int, ids binary, data binary"
LONG = 2**63 - 1


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v, norm): floor(scale * x) of each component; rows without an id, a vector or with a component that is not finite go."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Packed blocks: (block, top, n, dims, ids, data), ``top`` being the largest norm in it; norms descend through a partition."""
    ordered = rows.repartitionByRange(F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids, norms = part.column(0).to_numpy(), part.column(2).to_numpy()
                data = _matrix(part.column(1), dims)
                yield pa.RecordBatch.from_pydict({
                    "block": [number], "top": [float(norms.max())], "n": pa.array([len(ids)], pa.int32()), "dims": pa.array([dims], pa.int32()),
                    "ids": [ids.astype("<i8").tobytes()], "data": [data.astype("<f8").tobytes()],
                })
                number += 1

    return ordered.mapInArrow(pack, BLOCK_SCHEMA)


def directions(rows: DataFrame, dims: int) -> np.ndarray:
    """Rotation by the eigenvectors of the sum of outer products, largest first: ``dims`` squared numbers from each task."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(a, 4096), dims)
                with np.errstate(over="ignore", invalid="ignore"):
                    total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(dims), dims), "j": np.tile(np.arange(dims), dims), "s": total.ravel()})

    sums = rows.select("v").mapInArrow(outer, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    gram = np.zeros((dims, dims))
    for i, j, s in sums.collect():
        gram[i, j] = s
    if not np.isfinite(gram).all():
        return np.eye(dims)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer products as floats below 2**53, else as Python integers held within 64 bits."""
    with np.errstate(over="ignore"):
        bound = np.sqrt((queries**2).sum()) * np.sqrt((data**2).sum(axis=1).max(initial=0.0))
    if bound < 2**53:
        return (data @ queries).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(queries, row)) for row in data]
    return np.array([min(max(s, -LONG - 1), LONG) for s in whole], dtype=np.int64)


def _search(query_block: dict, block: dict, rotation: np.ndarray, to_beat: dict[int, int], k: int, head: int) -> list[tuple]:
    """(query_id, vec_id, score) of up to k candidates of ``block`` for each query that can still gain from it."""
    dims = block["dims"]
    ids, data = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["data"], "<f8").reshape(-1, dims)
    qids, queries = np.frombuffer(query_block["ids"], "<i8"), np.frombuffer(query_block["data"], "<f8").reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        norms, qnorms = np.sqrt((data**2).sum(axis=1)), np.sqrt((queries**2).sum(axis=1))
        turned, qturned = data @ rotation, queries @ rotation
        rest = np.sqrt(np.maximum(0, (turned[:, head:] ** 2).sum(axis=1)))
        qrest = np.sqrt(np.maximum(0, (qturned[:, head:] ** 2).sum(axis=1)))
    out = []
    for q, qid in enumerate(qids):
        least = to_beat.get(int(qid), -LONG - 1)
        # Room for rounding in the bounds; the scores themselves are exact.
        slack = 1e-9 * qnorms[q] * norms.max(initial=0.0) + 1e-6
        if not qnorms[q] * block["top"] + slack >= least and math.isfinite(slack):
            continue
        bound = turned[:, :head] @ qturned[q, :head] + rest * qrest[q] + slack
        open_ = np.flatnonzero(~(bound < least) & (ids != qid))
        if not len(open_):
            continue
        scores = _scores(queries[q], data[open_])
        first = np.lexsort((ids[open_], -scores if scores.min() > -LONG - 1 else [-int(s) for s in scores]))[:k]
        out += [(int(qid), int(ids[open_][i]), int(scores[i])) for i in first if scores[i] >= least]
    return out


HITS = "qb long, query_id long, vec_id long, score long"
PACKED = ("top", "n", "dims", "ids", "data")


def _searched(pairs: DataFrame, rotation: np.ndarray, k: int, head: int) -> DataFrame:
    """Hits of rows (qb, q, c, beat): a query block, a candidate block and the scores to beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("qb", "q", "c", "beat")}
                found = _search(row["q"], row["c"], rotation, dict(row["beat"] or []), k, head)
                columns = [[row["qb"]] * len(found), *([h[j] for h in found] for j in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["qb", "query_id", "vec_id", "score"])

    return pairs.select("qb", "q", "c", "beat").mapInArrow(run, HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, head: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows of another
    vec_id. Defined cases: rows with a null id, a null or empty vector, or a component that is null or
    not finite take no part; a shorter vector counts as padded with zeros; rows of one vec_id are
    candidates each, but a query's repeated rows count once; scores beyond 64 bits are held at its
    ends; fewer than k candidates give them all; an empty table gives an empty result.
    """
    rows = staged(integer_vectors(vectors, scale), "vectors")
    dims = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
    head = min(head, dims)
    rotation = directions(rows, dims)
    packed = [F.col(c) for c in PACKED]
    stored = staged(blocks(rows, dims).select("block", F.struct(*packed).alias("c")), "blocks")
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    number = F.row_number().over(Window.orderBy("block")).cast("long") - 1
    queries = staged(blocks(asked, dims), "queries")
    numbers = queries.select("block", number.alias("qb"))
    queries = queries.join(numbers, "block").select("qb", F.struct(*packed).alias("q"))
    longest = stored.agg(F.min("block")).first()[0]
    # The block of the longest vectors has a fixed size, so every task may have it.
    open_all = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<bigint>"))
    lead = F.broadcast(stored.filter(F.col("block") == F.lit(longest)))
    leading = queries.withColumn("block", F.lit(longest)).join(lead, "block").withColumn("beat", open_all)
    start = staged(_best(_searched(leading, rotation, k, head), k), "leading")
    # The score to beat is the k-th there; with fewer than k hits a query stays open to all.
    kth = start.filter(F.col("rank") == k).groupBy("qb").agg(
        F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("beat"), F.min("score").alias("weakest"), F.count(F.lit(1)).alias("known")
    )
    gates = queries.join(kth, "qb", "left").select(
        "qb", "q", F.coalesce("beat", open_all).alias("beat"), F.when(F.col("known") == F.col("q.n"), F.col("weakest")).alias("weakest")
    )
    gates = staged(gates, "gates")
    # The stated queries meet all rows, in blocks; pairs that can't reach any score to beat are left out.
    last = gates.agg(F.coalesce(F.max("qb"), F.lit(-1))).first()[0]
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")) if last >= 0 else F.array().cast("array<bigint>"))
    pairs = stored.filter(F.col("block") != F.lit(longest)).select("block", F.col("c.top").alias("top"), every_block.alias("qb"))
    reach = F.col("top") * F.col("q.top") * (1 + 1e-9) + 1e-6
    near = salted_join(pairs, gates, "qb", F.col("block")).filter(F.col("weakest").isNull() | (reach >= F.col("weakest")))
    rest = _searched(near.join(stored, "block"), rotation, k, head)
    hits = start.select("query_id", "vec_id", "score").unionByName(rest.select("query_id", "vec_id", "score"))
    return _best(hits, k).select("query_id", "rank", "vec_id", "score")
