"""Best-fit packing of documents into sequences of equal capacity, improved by local search.

Documents are encoded where they are read; only those longer than a sequence are cut. Pieces are
dealt to blocks of a few thousand, each packed best-fit from the longest on and then improved:
documents of the emptiest bins move to other underfull bins, one for none, one for one, or two
for one, as long as the sum of squared fills grows, until bins are empty. Pieces of bins that stay
underfull meet those of other blocks in further rounds.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.tokens import encoder
from ionweave.session import staged

#: Pieces in a block, about: what one call holds in memory.
BLOCK = 4096
PIECES = "piece int, start long, length long, ids_crc32 long"


def token_pieces(documents: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text with its end id; only texts over ``capacity`` are cut."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary).encode, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = encode(text) + end
                for k, a in enumerate(range(0, len(raw), capacity * 4)):
                    own = raw[a : a + capacity * 4]
                    at.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"doc_id {kind}, {PIECES}")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect.bisect_left(room, (n, -1))
        if k == len(room):
            b, left = len(bins), capacity
            bins.append([])
        else:
            left, b = room.pop(k)
        bins[b].append(int(i))
        if left > n:
            bisect.insort(room, (left - n, b))
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins by moves and exchanges that raise the sum of squared fills; never more bins than before."""
    least = -(-int(lengths.sum()) // capacity)
    fill = np.array([lengths[b].sum() for b in bins], dtype=np.int64)
    owner = np.empty(len(lengths), dtype=np.int64)
    for k, b in enumerate(bins):
        owner[b] = k
    every, items = np.arange(len(fill)), np.arange(len(lengths))

    def gains(donor: int, out: int, back: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Growth of the squared fills if pieces of size ``out`` go to bin ``to`` for ``back``; -1 where it doesn't fit."""
        more = out - back
        fits = (more > 0) & (fill[to] + more <= capacity) & (to != donor) & (fill[to] > 0)
        return np.where(fits, 2 * more * (more + fill[to] - fill[donor]), -1)

    def offers(own: np.ndarray) -> dict[int, tuple[int, ...]]:
        """Sizes that one or two of the donor's pieces have together, each with the pieces; equal sizes are one offer."""
        sizes, at = np.unique(lengths[own], return_index=True)
        found = {int(n): (int(own[i]),) for n, i in zip(sizes, at)}
        for x, n in enumerate(sizes):
            same = own[lengths[own] == n]
            for m, j in zip(sizes[x:], at[x:]):
                if n != m:
                    found.setdefault(int(n + m), (int(same[0]), int(own[j])))
                elif len(same) > 1:
                    found.setdefault(int(2 * n), (int(same[0]), int(same[1])))
        return {n: pieces for n, pieces in found.items() if n <= capacity}

    while (fill > 0).sum() > least:
        improved = False
        for donor in np.argsort(fill, kind="stable"):
            if not 0 < fill[donor] < capacity:
                continue
            best = (0, None, None, None)
            for size, out in offers(np.flatnonzero(owner == donor)).items():
                g = gains(donor, size, np.zeros(len(fill), np.int64), every)
                k = int(g.argmax())
                if g[k] > best[0]:
                    best = (int(g[k]), out, None, k)
                g = gains(donor, size, lengths, owner)
                k = int(g.argmax())
                if g[k] > best[0]:
                    best = (int(g[k]), out, items[k], int(owner[k]))
            if best[1] is None:
                continue
            _, out, back, to = best
            moved = sum(int(lengths[i]) for i in out) - (int(lengths[back]) if back is not None else 0)
            owner[list(out)] = to
            if back is not None:
                owner[back] = donor
            fill[to] += moved
            fill[donor] -= moved
            improved = True
            break
        if not improved:
            break
    order = np.argsort(owner, kind="stable")
    return [list(map(int, g)) for g in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)] if len(order) else []


def _packed(small: DataFrame, capacity: int, level: int) -> DataFrame:
    """(__id, length, sequence_id, offset, fill) of ``small`` (__id, length, __block), each block packed by itself."""

    def pack(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__id", ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        items = np.concatenate([np.asarray(b, dtype=np.int64) for b in bins])
        sizes = [len(b) for b in bins]
        return pd.DataFrame({
            "__id": group["__id"].to_numpy()[items], "length": lengths[items],
            "sequence_id": (level << 56) + (int(key[0]) << 28) + np.repeat(np.arange(len(bins)), sizes),
            "offset": np.concatenate([np.cumsum(lengths[b]) - lengths[b] for b in bins]),
            "fill": np.repeat([lengths[b].sum() for b in bins], sizes),
        })

    return small.groupBy("__block").applyInPandas(pack, "__id long, length long, sequence_id long, offset long, fill long")


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``capacity``) plus sequence_id and offset, gapless from 0 in each sequence.

    The pieces of sequences that a block leaves underfull are dealt to new blocks and packed again, with
    those of other blocks, until one block holds all of them or a round empties no sequence.
    """
    numbered = staged(pieces.withColumn("__id", F.monotonically_increasing_id()), "pieces")
    left, done, level = numbered.select("__id", F.col("length").cast("long").alias("length")), [], 0
    count, before = numbered.count(), None
    while True:
        blocks = max(1, -(-count // BLOCK))
        deal = F.pmod(F.xxhash64("__id", F.lit(level)), F.lit(blocks)).alias("__block")
        placed = staged(_packed(left.select("__id", "length", deal), capacity, level), "packed")
        if before is not None:
            # A round is taken if it needs no more sequences than the one before it did for these pieces.
            now = placed.agg(F.count(F.when(F.col("offset") == 0, 1))).first()[0]
            if now >= before[1]:
                done.append(before[0])
                break
        open_ = F.col("fill") < capacity
        row = placed.filter(open_).agg(F.count(F.lit(1)), F.count(F.when(F.col("offset") == 0, 1))).first()
        if blocks == 1 or row[1] < 2:
            done.append(placed)
            break
        done.append(placed.filter(~open_))
        left, count, before, level = placed.filter(open_).select("__id", "length"), row[0], (placed.filter(open_), row[1]), level + 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return numbered.join(every.select("__id", "sequence_id", "offset"), "__id").drop("__id")


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``capacity``) plus sequence_id and offset, gapless from 0 in each sequence."""
    numbered = staged(pieces.withColumn("__id", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-numbered.count() // BLOCK))
    small = numbered.select("__id", F.col("length").cast("long"), F.pmod(F.xxhash64("__id"), F.lit(blocks)).alias("__block"))

    def pack(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__id", ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        items = np.concatenate([np.asarray(b, dtype=np.int64) for b in bins])
        sequence = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        offset = np.concatenate([np.cumsum(lengths[b]) - lengths[b] for b in bins])
        return pd.DataFrame({"__id": group["__id"].to_numpy()[items], "sequence_id": (int(key[0]) << 32) + sequence, "offset": offset})

    placed = small.groupBy("__block").applyInPandas(pack, "__id long, sequence_id long, offset long")
    return numbered.join(placed, "__id").drop("__id")


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is a piece of the end id alone; a null doc_id stays null;
    repeated rows are packed each for itself; an empty table gives an empty result; other columns
    are ignored.
    """
    return pack_pieces(token_pieces(documents, vocabulary, capacity, end_id), capacity)
