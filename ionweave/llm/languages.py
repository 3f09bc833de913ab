"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Every whole training text counts: tasks sum n-gram counts by language in arrays and send one row per
language and bucket, Spark adds them up, and one row per language with its log probabilities goes to the
driver, which broadcasts the matrix. Texts are scored in batches: the n-grams of a batch are looked up
in the matrix and added up by text. The number of buckets falls with the number of languages, so the
matrix never exceeds ``CELLS`` numbers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in the matrix at most (of 4 bytes each), and buckets of n-grams at most.
CELLS, BUCKETS = 1 << 25, 1 << 16
#: Weight of an n-gram that was not seen.
SMOOTH = 0.5
#: Characters looked at together; a longer text is cut, with the two characters before the cut as context.
PIECE = 1 << 19
#: Languages counted at once in a task before it sends what it has.
HELD = 32
UNKNOWN = "und"

MARK = 1 << 21
LOW = 0x3000


def _value(code: int) -> int:
    """Lower-case code of a letter, a marked code for a combining mark, 0 for anything else."""
    kind = unicodedata.category(chr(code))[0]
    return ord(chr(code).lower()[0]) if kind == "L" else code | MARK if kind == "M" else 0


VALUES = np.array([_value(c) for c in range(LOW)], dtype=np.uint32)


def values(text: str) -> np.ndarray:
    """``_value`` of every character."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    out = VALUES[np.minimum(codes, LOW - 1)]
    high = np.flatnonzero(codes >= LOW)
    if len(high):
        known, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_value(int(c)) for c in known], dtype=np.uint32)[at]
    return out


def _hash(*columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), dtype=np.uint32)
    for c in columns:
        h = (h ^ c) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h * np.uint32(0x85EBCA6B)


def ngrams(v: np.ndarray, skip: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the last character, 32-bit hash) of the n-grams of 1 to 3 characters that end at ``skip`` or later.

    Other characters than letters stand for a word's edge; an n-gram holds one at its ends only, and not alone.
    """
    inside = v > 0
    for n in (1, 2, 3):
        if len(v) < n:
            return
        parts = [v[k : len(v) - n + 1 + k] for k in range(n)]
        held = [inside[k : len(v) - n + 1 + k] for k in range(n)]
        good = held[0] if n == 1 else held[0] | held[1] if n == 2 else held[1]
        at = np.flatnonzero(good)
        at = at[at + n - 1 >= skip]
        yield at + n - 1, _hash(*[p[at] for p in parts])


def pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(number of the first text, values, text of each place counted from the first, places of context) of runs of texts."""
    at, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size + len(texts[i]) > PIECE:
            if i > at:
                part = texts[at:i]
                yield at, values("\n" + "\n".join(part) + "\n"), np.repeat(np.arange(len(part)), [len(t) + 1 + (k == 0) for k, t in enumerate(part)]), 0
            at, size = i, 0
        if i < len(texts) and len(texts[i]) > PIECE:
            for lo in range(0, len(texts[i]), PIECE):
                v = values("\n" * (lo == 0) + texts[i][max(0, lo - 2) : lo + PIECE] + "\n" * (lo + PIECE >= len(texts[i])))
                yield i, v, np.zeros(len(v), dtype=np.int64), 2 if lo else 0
            at = i + 1
        elif i < len(texts):
            size += len(texts[i]) + 1


@dataclass
class Model:
    """Languages in order, their log shares of the training texts, and log probabilities by (language, bucket)."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log posterior but for a constant by (language, text), whether a text holds a letter)."""
        out = np.repeat(self.prior[:, None], max(1, len(texts)), axis=1)[:, : len(texts)]
        lettered = np.zeros(len(texts), dtype=bool)
        for first, v, owner, skip in pieces(texts):
            n = int(owner[-1]) + 1
            lettered[first + owner[(v > 0) & (v < MARK)]] = True
            for place, h in ngrams(v, skip):
                bucket, own = (h >> np.uint32(16)) & np.uint32(self.matrix.shape[1] - 1), owner[place]
                for j in range(len(self.languages)):
                    out[j, first : first + n] += np.bincount(own, weights=self.matrix[j][bucket], minlength=n)
        return out, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior of each text; ties go to the smaller language."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logs, lettered = self.scores(texts)
        best = np.argmax(logs, axis=0)
        share = 1 / np.exp(logs - logs.max(axis=0)).sum(axis=0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], np.where(lettered, share, 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learnt from: CRC-32 of the id as text leaves 1 by 3 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(documents: DataFrame) -> DataFrame:
    """(lang, text) of the documents to learn from."""
    return documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")


def ngram_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(lang, bucket, n) over all ``rows``; bucket -1 counts the texts that hold a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, sums in held.items():
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1), pa.array(sums[at])], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                if lang not in held and len(held) >= HELD:
                    yield from sent()
                sums = held.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                own = texts[langs == lang].tolist()
                lettered = np.zeros(len(own), dtype=bool)
                for first, v, owner, skip in pieces(own):
                    lettered[first + owner[(v > 0) & (v < MARK)]] = True
                    for _, h in ngrams(v, skip):
                        sums[1:] += np.bincount((h >> np.uint32(16)) & np.uint32(buckets - 1), minlength=buckets)
                sums[0] += int(lettered.sum())
        yield from sent()

    return rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn_languages(rows: DataFrame) -> Model:
    """The model of all ``rows`` (lang, text). Languages none of whose texts holds a letter are not learnt."""
    many = rows.select("lang").distinct().count()
    buckets = BUCKETS
    while buckets > 256 and buckets * many > CELLS:
        buckets //= 2

    def row(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(buckets + 1)
        sums[group["bucket"].to_numpy() + 1] = group["n"].to_numpy()
        seen = sums[1:] + SMOOTH
        return pd.DataFrame({"lang": [key[0]], "texts": [int(sums[0])], "logs": [np.log(seen / seen.sum()).astype(np.float32).tobytes()]})

    found = ngram_counts(rows, buckets).groupBy("lang").applyInPandas(row, "lang string, texts long, logs binary").filter("texts > 0")
    kept = sorted(found.collect(), key=lambda r: r["lang"])
    texts = np.array([r["texts"] for r in kept], dtype=float)
    return Model([r["lang"] for r in kept], np.log(texts / max(1.0, texts.sum())), np.array([np.frombuffer(r["logs"], dtype=np.float32) for r in kept]))


def identify_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; ``score`` is the posterior of the language.

    Without ``model`` one is learnt from the rows that have a language and are not held out. Defined
    cases: a null text and one without a letter are ``und`` with score 0, and so is every row where
    nothing could be learnt; a null doc_id is predicted by its text; repeated rows are predicted
    alike; ties go to the smaller language; texts of any length count whole; an empty table gives an
    empty result; other columns are not read.
    """
    model = learn_languages(training_rows(documents)) if model is None else model
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = documents.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
