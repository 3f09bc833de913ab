"""Toxicity by the nearest labelled examples.

A bounded, repeatable sample of labelled documents of each class gives the examples. Terms are words
and their beginnings of 4 to 6 bytes, all of them: every term of an example has its document
frequency counted over all documents, every other term shares that of its hash bucket, so that vectors
and norms cover whole texts. Terms whose presence goes with the label in the sample weigh more than the
others. Examples are indexed by term in blocks with the largest weight of each block; a document
visits the blocks whose bounds reach its nearest examples so far, so its neighbours are exact. Terms that
many examples hold stand as full rows of weights, which cost less to add than their postings and are added first.
Votes are weighted by cosine and by how much of its class an example stands for, and calibrated on
the examples themselves, each without its own vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.shingles import BASE, PIECE, U64, _mix
from ionweave.session import staged

#: Labelled examples of each class, at most, and distinct terms of all examples together, at most (in order of the sample).
EXAMPLES, POSTINGS = 1000, 1 << 22
NEIGHBOURS = 15
BLOCK = 64
#: Terms that at least one example of so many holds are full rows; these take at most so many times the room of their postings.
OFTEN = 12
#: Weight of a term that doesn't go with the label, beside 1.
PLAIN = 0.1
#: Hash buckets that hold the document frequencies of terms no example has.
BUCKETS = 1 << 18
#: Terms in a row of counts.
CHUNK = 1024
STARTS = (4, 5, 6)

VALUES = _mix(np.arange(256, dtype=U64), 3)
VALUES[65:91] = VALUES[97:123]
LETTER = np.zeros(256, dtype=bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
VALUES[~LETTER] = 0


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term hash) of every word and word beginning in ``texts`` (UTF-8; A-Z lower-cased)."""
    raw = b" ".join(texts) + b" "
    text = np.frombuffer(raw, dtype=np.uint8)
    letter = LETTER[text]
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, U64)
    lengths = stops - starts
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    gap = np.diff(np.append(starts, len(text)))
    place = np.arange(starts[0], len(text)) - np.repeat(starts, gap)
    powers = np.cumprod(np.full(int(gap.max()), BASE, dtype=U64))
    total = np.concatenate([[U64(0)], np.cumsum(VALUES[text[starts[0] :]] * powers[place], dtype=U64)])
    starts = starts - starts[0]
    hashes, owners = [_mix(total[starts + lengths] - total[starts], 1)], [owner]
    for n in STARTS:
        longer = lengths > n
        hashes.append(_mix(total[starts[longer] + n] - total[starts[longer]], n))
        owners.append(owner[longer])
    return np.concatenate(owners), np.concatenate(hashes)


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``PIECE`` bytes, with the number of the first; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if texts:
        yield at, texts[at:]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of every range lo..hi-1, one range after another, and their lengths."""
    n = hi - lo
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + n, n), n


class Lookup:
    """Numbers of terms: those of an example in order of hash, then the buckets of all others."""

    def __init__(self, terms: np.ndarray):
        self.sorted = np.sort(terms)
        self.size = len(terms) + BUCKETS

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        known = len(self.sorted)
        other = known + (hashes >> U64(46)).astype(np.int64)
        if not known:
            return other
        at = np.minimum(np.searchsorted(self.sorted, hashes), known - 1)
        return np.where(self.sorted[at] == hashes, at, other)

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, term number, count) of all terms, sorted; distinct terms of one bucket stay apart."""
        owner, hashes = term_hashes(texts)
        distinct, at = np.unique(hashes, return_inverse=True)
        size = max(1, len(distinct))
        keys, n = np.unique(owner * size + at, return_counts=True)
        return keys // size, self.numbers(distinct)[keys % size], n


@dataclass
class Index:
    """The labelled examples by term and block, and the two numbers of the calibration.

    ``runs[t] .. runs[t + 1]`` are the runs of term t, one for each block of examples that holds it, with
    its block and largest value; ``posts[r] .. posts[r + 1]`` are the postings of run r. A term of many
    examples has no runs: ``full[row[t]]`` are its values in all examples (``row`` is -1 for the others).
    """

    lookup: Lookup
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    runs: np.ndarray
    run_block: np.ndarray
    run_max: np.ndarray
    posts: np.ndarray
    examples: np.ndarray
    values: np.ndarray
    row: np.ndarray
    full: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[terms]
        return v / np.sqrt((v * v).sum())

    def nearest(self, terms: np.ndarray, vector: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the nearest examples with a common term, ties to the smaller number."""
        known = terms < len(self.runs) - 1
        terms, vector = terms[known], vector[known]
        often = self.row[terms] >= 0
        part = vector[often] @ self.full[self.row[terms[often]]]
        if without >= 0:
            part[without] = 0
        # Postings only add to these sums, so that the nearest examples have at least this.
        least = np.partition(part, -NEIGHBOURS)[-NEIGHBOURS] if len(part) > NEIGHBOURS else 0.0
        terms, vector = terms[~often], vector[~often]
        run, n = _ranges(self.runs[terms], self.runs[terms + 1])
        weight, block = np.repeat(vector, n), self.run_block[run]
        bounds = np.bincount(block, weight * self.run_max[run], minlength=-(-len(self.ids) // BLOCK))
        if len(part):
            bounds = bounds + np.maximum.reduceat(part, np.arange(0, len(part), BLOCK))
        visit = (bounds > 0) & (bounds * (1 + 1e-6) >= least)
        if not visit.all():
            own = visit[block]
            run, weight = run[own], weight[own]
        post, n = _ranges(self.posts[run], self.posts[run + 1])
        sums = part + np.bincount(self.examples[post], np.repeat(weight, n) * self.values[post], minlength=len(self.ids))
        if without >= 0:
            sums[without] = 0
        i = np.flatnonzero((sums > 0) & (sums >= least) & np.repeat(visit, BLOCK)[: len(sums)])
        best = np.lexsort((i, -sums[i]))[:NEIGHBOURS]
        return i[best], sums[i[best]]

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of the cosine-weighted votes, with the prior as one weak vote."""
        w = cosines * self.weight[found]
        part = ((w * self.toxic[found]).sum() + 0.1 * self.prior) / (w.sum() + 0.1)
        return float(np.log(part) - np.log1p(-part))

    def score(self, odds: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * odds + self.shift, -30, 30))))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learnt from: CRC-32 of the id as text divisible by 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one row per labelled document outside the held-out part; of several labels the mean decides."""
    rows = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    return rows.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))


def _examples(documents: DataFrame, labels: DataFrame, limit: int, postings: int) -> tuple[list, dict[int, int]]:
    """(doc_id, toxic, hashes, counts) of the sampled documents in order of id, and the labelled documents of each class.

    Of several rows of one id, that with the fewest terms is taken. The sample ends where its documents
    have ``postings`` distinct terms together, so the driver holds no more than that.
    """
    train = staged(training_labels(labels), "train_labels")
    totals = {r[0]: r[1] for r in train.groupBy("toxic").agg(F.count(F.lit(1))).collect()}
    picked = [train.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for t in (0, 1)]
    sample = staged(picked[0].unionByName(picked[1]), "sample").withColumnRenamed("doc_id", "__id")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(sample, F.col("doc_id") == F.col("__id")).select("doc_id", "toxic", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, packed = [], []
            for text in batch.column(2).to_pylist():
                hashes, n = np.unique(term_hashes([text.encode()])[1], return_counts=True)
                size.append(len(hashes))
                packed.append(hashes.astype("<u8").tobytes() + n.astype("<u4").tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "n", "packed"])

    rows = rows.mapInArrow(terms, "doc_id long, toxic int, n long, packed binary")
    least = F.min(F.struct("n", "packed")).alias("least")
    rows = staged(rows.groupBy("doc_id", "toxic").agg(least).select("doc_id", "toxic", "least.*", F.xxhash64("doc_id").alias("place")), "examples")
    ordered = sorted(rows.select("place", "doc_id", "n").collect())
    whole = np.cumsum([r[2] for r in ordered]) <= postings
    kept = rows if whole.all() else rows.join(rows.sparkSession.createDataFrame([(r[1],) for r, k in zip(ordered, whole) if k], "doc_id long"), "doc_id", "left_semi")
    found = []
    for doc_id, toxic, n, packed in kept.select("doc_id", "toxic", "n", "packed").toLocalIterator():
        found.append((doc_id, toxic, np.frombuffer(packed, "<u8", n), np.frombuffer(packed, "<u4", n, 8 * n)))
    return sorted(found, key=lambda r: r[0]), totals


def _telling(p: np.ndarray, c: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Whether presence in ``p`` toxic and ``c`` clean examples goes with the label: the likelihood ratio beats what chance gives."""
    if not toxic or not clean:
        return np.zeros(len(p), dtype=bool)
    share = toxic / (toxic + clean)

    def part(k: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(expected, 1e-12)), 0.0)

    def ratio(k: np.ndarray, of: np.ndarray) -> np.ndarray:
        return part(k, of * share) + part(of - k, of * (1 - share))

    g = 2 * (ratio(p, p + c) + ratio(toxic - p, toxic + clean - p - c))
    return (p + c >= 3) & (g >= 2 * np.log((p + c >= 3).sum() + 1))


def _document_frequencies(documents: DataFrame, lookup: Lookup) -> tuple[np.ndarray, int]:
    """Documents that hold each term, over all documents, and their number; tasks send packed counts, summed as they arrive."""

    def rows_of(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array(list(held), pa.int32()), "counts": pa.array([v.astype("<i8").tobytes() for v in held.values()], pa.binary()),
        })

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(-(-lookup.size // CHUNK) * CHUNK, np.int64), 0
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            n += len(texts)
            for _, part in _pieces(texts):
                held += np.bincount(lookup.counts(part)[1], minlength=len(held))
        chunks = {i: c for i, c in enumerate(held.reshape(-1, CHUNK)) if c.any()}
        yield rows_of(chunks | {-1: np.array([n])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(counts.as_buffer(), "<i8")
                held[chunk] = held[chunk] + more if chunk in held else more.copy()
        yield rows_of(held)

    kind = "chunk int, counts binary"
    rows = documents.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, kind)
    df, n = np.zeros(-(-lookup.size // CHUNK) * CHUNK), 0
    for chunk, counts in rows.repartition(8, "chunk").mapInArrow(add, kind).collect():
        counts = np.frombuffer(counts, "<i8")
        if chunk < 0:
            n = int(counts[0])
        else:
            df[chunk * CHUNK : (chunk + 1) * CHUNK] = counts
    return df[: lookup.size], n


def build_index(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES, postings: int = POSTINGS) -> Index:
    """The calibrated index; its size is bounded by the two parameters. Without labels of both classes it holds no example."""
    rows, totals = _examples(documents, labels, examples, postings)
    sampled = {t: sum(r[1] == t for r in rows) for t in (0, 1)}
    prior = min(max((totals.get(1, 0) + 0.01) / (sum(totals.values()) + 1.0), 1e-6), 1 - 1e-6)
    if not sampled[0] or not sampled[1]:
        rows = []
    known = np.unique(np.concatenate([np.empty(0, U64), *[r[2] for r in rows]]))
    lookup = Lookup(known)
    texts = [(r[0], r[1], np.searchsorted(known, r[2]), r[3]) for r in rows]
    sizes = np.array([len(r[2]) for r in texts], np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *[r[2] for r in texts]])
    toxic = np.repeat(np.array([r[1] for r in texts], np.int64), sizes)
    held = np.bincount(flat, minlength=len(known))
    p = np.bincount(flat[toxic == 1], minlength=len(known))
    idf = np.ones(lookup.size)
    if rows:
        df, n_docs = _document_frequencies(documents, lookup)
        idf = (np.log((1 + n_docs) / (1 + np.minimum(df, n_docs))) + 1) * PLAIN
        idf[: len(known)][_telling(p, held - p, sampled[1], sampled[0])] /= PLAIN
    # Examples with the same leading term share a block, which keeps the bounds of the others low.
    common = np.where(held * 50 >= len(texts), 1.0, 1e-3)
    filled = [r for r in texts if len(r[2])]
    lead = [int(r[2][np.argmax((1 + np.log(r[3])) * idf[r[2]] * common[r[2]])]) for r in filled]
    filled = [r for _, _, r in sorted(zip(lead, range(len(filled)), filled), key=lambda x: x[:2])]
    index = _postings(lookup, idf, filled, len(known), np.array([totals.get(r[1], 1) / max(1, sampled[r[1]]) for r in filled]), prior)
    none = np.empty(0, np.int64)
    odds, truth, weights = [], [], []
    for i, r in enumerate(filled):
        odds.append(index.vote(*index.nearest(r[2], index.vector(r[2], r[3]), without=i)))
        truth.append(r[1])
        weights.append(index.weight[i])
    for t in (0, 1):
        odds.append(index.vote(none, np.empty(0)))
        truth.append(t)
        weights.append((sampled[t] - sum(r[1] == t for r in filled)) * totals.get(t, 1) / max(1, sampled[t]) if rows else 0.0)
    if rows:
        index.slope, index.shift = _logistic(np.array(odds), np.array(truth, float), np.array(weights))
    return index


def _postings(lookup: Lookup, idf: np.ndarray, filled: list, known: int, weight: np.ndarray, prior: float) -> Index:
    """The block-max inverted index of examples (doc_id, toxic, terms, counts), numbered in their order."""
    ids, toxic = np.array([r[0] for r in filled], np.int64), np.array([r[1] for r in filled], np.int64)
    none = np.empty(0, np.int64)
    index = Index(
        lookup, idf, ids, toxic, weight, np.zeros(known + 1, np.int64), none, none, np.zeros(1, np.int64), none, none,
        np.full(known, -1), np.empty((0, len(ids))), prior,
    )
    if not filled:
        return index
    terms = np.concatenate([r[2] for r in filled])
    examples = np.repeat(np.arange(len(filled)), [len(r[2]) for r in filled])
    values = np.concatenate([index.vector(r[2], r[3]) for r in filled])
    often = np.flatnonzero(np.bincount(terms, minlength=known) * OFTEN >= len(filled))
    index.row[often] = np.arange(len(often))
    index.full = np.zeros((len(often), len(filled)))
    here = index.row[terms] >= 0
    index.full[index.row[terms[here]], examples[here]] = values[here]
    terms, examples, values = terms[~here], examples[~here], values[~here]
    order = np.lexsort((examples, terms))
    terms, index.examples, index.values = terms[order], examples[order], values[order]
    block = index.examples // BLOCK
    starts = np.flatnonzero((np.diff(terms, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    index.run_block, index.run_max = block[starts], np.maximum.reduceat(index.values, starts) if len(starts) else none
    index.posts = np.append(starts, len(terms))
    index.runs = np.searchsorted(terms[starts], np.arange(known + 1))
    return index


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit, held near (1, 0) by a weak prior; the slope is never negative."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = w * p * (1 - p) + 1e-9
        g = np.array([(w * (y - p) * x).sum() - (a - 1), (w * (y - p)).sum() - b])
        m = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]])
        step = np.linalg.solve(m, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-9:
            break
    return max(a, 0.05), b


def _scores(model: Index, texts: list[str]) -> tuple[np.ndarray, list[list[int]]]:
    """Score and nearest examples' ids of each text."""
    raw = [t.encode() for t in texts]
    none = model.score(model.vote(np.empty(0, np.int64), np.empty(0)))
    scores, evidence = np.full(len(raw), none), [[] for _ in raw]
    for at, part in _pieces(raw) if len(model.ids) else ():
        owner, terms, n = model.lookup.counts(part)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for lo, hi in zip(first, np.append(first[1:], len(owner))):
            found, cosines = model.nearest(terms[lo:hi], model.vector(terms[lo:hi], n[lo:hi]))
            scores[at + owner[lo]] = model.score(model.vote(found, cosines))
            evidence[at + owner[lo]] = model.ids[found[:3]].tolist()
    return scores, evidence


def score_toxicity(documents: DataFrame, labels: DataFrame, index: Index | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row: ``evidence`` lists up to three nearest examples' ids.

    Defined cases: null and empty texts, and texts without a term of an example, score by the prior alone; a
    null doc_id is scored by its text; repeated rows score alike; without labels of both classes every
    row has the prior; an empty table gives an empty result; other columns, lang and source among
    them, are not read.
    """
    model = build_index(documents, labels) if index is None else index
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence = _scores(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    out = rows.mapInArrow(score, f"doc_id {kind}, score double, evidence array<long>")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(documents: DataFrame, labels: DataFrame, index: Index | None = None) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score under 0.5; rows are not shuffled."""
    model = build_index(documents, labels) if index is None else index
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, _ = _scores(model, [t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores < 0.5))

    return documents.mapInArrow(keep, documents.schema)
