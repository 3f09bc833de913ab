"""Near-duplicate documents: MinHash signatures in an LSH forest, links confirmed on full shingle sets.

Documents of equal shingle sets are one class. The signature of a class gives several trees: its
minimum hashes in several orders. In a tree, classes that share the first hash are a region; a
region is sorted by the remaining hashes, and each class meets its next neighbours there, those of
the longest common prefix. Regions with many classes are split one hash deeper, as often as needed,
and the first class of a part meets the first of the whole. A first pass over two trees with single
neighbours joins the bulk of large groups; the second, over all trees with several neighbours, leaves
out pairs that are joined already. The classes of crowded regions that then still hold several components
are joined without a cap: two sets that reach the threshold share one of the rarest shingles of both, as
many as the threshold allows to differ and one more. Most of these shingles stand in one component only and
leave before anything is joined. The join itself drops pairs by size, by the place of the shared shingle
in both orders, and by sketches far under the threshold; every other pair is compared on its full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.llm.common import Stages, possible, salted_join
from ionweave.llm.graph import components
from ionweave.llm.shingles import U64, minhashes, set_hash, shingle_set, word_hashes
from ionweave.session import staged

TREES, DEPTH = 12, 8
#: Classes of a region that one window sorts; larger ones are split one hash deeper.
REGION = 2048
NEIGHBOURS = 8
#: Trees and neighbours of the first pass.
FIRST_PASS = (2, 1)
#: Counters by which shingles are ordered from rare to frequent.
COUNTERS = 1 << 16
#: Fewest equal 4-bit hashes of the 96 in the sketches: six standard deviations under the mean at the threshold.
SKETCH_LEAST = 48
#: Shingles hashed at once.
STEP = 1 << 20
SIGNED = "text_hash long, n_shingles long, h1 long, h2 long, sig array<int>, sketch array<long>"


def signatures(documents: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, h1, h2, sig, sketch) per row; sig and sketch are null for empty sets."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    count = TREES * DEPTH

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            sets, at, held = [], 0, 0
            for i, words in enumerate(word_hashes(texts)):
                sets.append(shingle_set(words, size))
                held += len(sets[-1])
                if held > STEP or i + 1 == len(texts):
                    yield _signed([batch.column(k).slice(at, len(sets)) for k in (0, 2)], sets, count)
                    sets, at, held = [], i + 1, 0

    rows = documents.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(sign, f"doc_id {kind}, {SIGNED}")


def _signed(ids: list[pa.Array], sets: list[np.ndarray], count: int) -> pa.RecordBatch:
    full = [i for i, s in enumerate(sets) if len(s)]
    rows: list = [None] * len(sets)
    sketch: list = [None] * len(sets)
    if full:
        found = minhashes([sets[i] for i in full], count)
        nibbles = (found & 15).astype(np.uint64).reshape(len(full), count // 16, 16)
        longs = np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)
        for k, i in enumerate(full):
            rows[i], sketch[i] = found[k], longs[k]
    hashes = [set_hash(s) for s in sets]
    return pa.RecordBatch.from_arrays(
        [
            *ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([h[0] for h in hashes], pa.int64()),
            pa.array([h[1] for h in hashes], pa.int64()), pa.array(rows, pa.list_(pa.int32())), pa.array(sketch, pa.list_(pa.int64())),
        ],
        names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig", "sketch"],
    )


def _alike(a: str, b: str) -> Column:
    """Equal 4-bit hashes of two sketches."""
    ones, words = F.lit(0x1111111111111111), TREES * DEPTH // 16

    def differing(k: int) -> Column:
        z = F.element_at(a, k + 1).bitwiseXOR(F.element_at(b, k + 1))
        spread = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        spread = spread.bitwiseOR(F.shiftrightunsigned(spread, 2))
        return F.bit_count(spread.bitwiseAND(ones))

    return F.lit(TREES * DEPTH) - reduce(lambda x, y: x + y, [differing(k) for k in range(words)])


def _pair() -> list[Column]:
    """The members x and y by their numbers, and the equal hashes of their sketches."""
    return [F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"), _alike("x.sketch", "y.sketch").alias("alike")]


def _region(depth: int) -> Column:
    """A hash of the tree and of its first ``depth`` minimum hashes."""
    return F.xxhash64("tree", F.slice("sig", F.col("tree") * DEPTH + 1, depth))


def _possible(percent: int) -> Column:
    """Sizes and sketches of a pair that could reach the threshold."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    return (F.col("x.root") != F.col("y.root")) & (small * 100 >= large * percent) & (_alike("x.sketch", "y.sketch") >= SKETCH_LEAST)


def candidates(classes: DataFrame, trees: int, neighbours: int, percent: int, stages: Stages) -> DataFrame:
    """Distinct (a, b, alike), a < b, of classes with different ``root`` that are neighbours in one of the first ``trees`` trees."""
    one = F.lit(1).cast("long")
    keys = classes.select("cid", "sig", F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"))
    keys = keys.select("cid", "tree", _region(1).alias("key"))
    shared = keys.groupBy("key").agg(F.count(one).alias("many")).filter("many > 1")
    met = keys.join(shared, "key").groupBy("cid").agg(F.collect_list(F.struct("tree", "key", "many")).alias("met"))
    member = F.struct("cid", F.col("n_shingles").alias("n"), "sketch", "root").alias("x")
    rows = classes.join(met, "cid").select(member, "sig", F.explode("met").alias("m"))
    # Of the signature a row takes along the hashes of its own tree.
    rows = rows.select("x", F.slice("sig", F.col("m.tree") * DEPTH + 1, DEPTH).alias("sig"), "m.tree", "m.key", "m.many")
    rows = stages.table(rows, "regions")
    found, depth = [], 1
    while True:
        order = [F.slice("sig", depth + 1, DEPTH - depth), F.col("x.cid")] if depth < DEPTH else [F.col("x.cid")]
        w = Window.partitionBy("tree", "key").orderBy(*order)
        small = rows.filter(F.col("many") <= REGION)
        near = small.select("x", F.array(*[F.lead("x", k).over(w) for k in range(1, neighbours + 1)]).alias("ys"))
        near = near.select("x", F.explode("ys").alias("y")).filter(F.col("y").isNotNull()).filter(_possible(percent))
        found.append(near.select(*_pair()))
        deep = rows.filter(F.col("many") > REGION)
        if not deep.limit(1).count():
            break
        depth += 1
        # One hash deeper; where all are used up, classes of one signature are dealt by their number.
        part = F.xxhash64("key", F.slice("sig", 1, depth)) if depth <= DEPTH else F.xxhash64("key", F.floor(F.col("x.cid") % 1_000_003 * F.col("many") / (1_000_003.0 * REGION)))
        deep = deep.withColumn("part", part)
        heads = stages.table(deep.groupBy("tree", "key", "part").agg(F.count(one).alias("in_part"), F.min("x").alias("first")), "heads")
        top = heads.groupBy("tree", "key").agg(F.min("first").alias("y"))
        tops = heads.join(top, ["tree", "key"]).select(F.col("first").alias("x"), "y").filter(_possible(percent))
        found.append(tops.select(*_pair()))
        sizes = heads.filter("in_part > 1").select("tree", "key", "part", "in_part")
        # Near copies by the thousand share many hashes: their rows are dealt anew.
        deep = salted_join(deep, sizes, ["tree", "key", "part"], F.col("x.cid")).select(
            "x", "sig", "tree", F.col("part").alias("key"), (F.least("in_part", F.lit(REGION)) if depth > DEPTH else F.col("in_part")).alias("many")
        )
        rows = stages.table(deep, "regions")
    return reduce(DataFrame.unionByName, found).distinct()


def _texts(documents: DataFrame, needed: DataFrame) -> DataFrame:
    """``needed`` (doc_id and other columns) with the texts of ``documents``; few other texts are exchanged for it."""
    rows = possible(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), needed, "doc_id")
    return rows.join(needed, "doc_id")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(cid, shingles): the full set of each class in ``rows`` (cid, h1, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            wanted, cids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            at, out, held = [], [], 0
            for i, words in enumerate(word_hashes(texts)):
                own = shingle_set(words, size)
                if set_hash(own)[0] == wanted[i]:
                    at.append(cids[i])
                    out.append(own.tobytes())
                    held += len(own)
                if at and (held > STEP or i + 1 == len(texts)):
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out, pa.binary())], names=["cid", "shingles"])
                    at, out, held = [], [], 0

    # Rows of one doc_id may repeat the text of their class.
    return rows.select("cid", "h1", "text").mapInArrow(sets, "cid long, shingles binary")


def crowded(classes: DataFrame, stages: Stages) -> DataFrame:
    """(cid, h1, doc_id, n, root) of the classes in regions of several components with more classes than met each other there."""
    keys = classes.select("cid", "root", F.explode(F.array(*[F.lit(t) for t in range(TREES)])).alias("tree"), "sig").select("cid", "root", _region(1).alias("key"))
    keys = stages.table(keys, "crowded_keys")
    mixed = keys.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = mixed.filter((F.col("many") > NEIGHBOURS + 1) & (F.col("low") < F.col("high"))).select("key")
    cids = salted_join(keys, mixed, "key", F.col("cid")).select("cid").distinct()
    return classes.join(cids, "cid").select("cid", "h1", F.col("rep").alias("doc_id"), F.col("n_shingles").alias("n"), "root")


def _places(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U64(48)).astype(np.int64) % COUNTERS


def rare_pairs(documents: DataFrame, classes: DataFrame, size: int, percent: int, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """All (a, b, alike), a < b, of ``crowded`` classes with different ``root`` that sizes, rare shingles and sketches let reach the threshold.

    Also (cid, h1, text) of these classes, and of some more.
    """
    within = stages.table(crowded(classes, stages), "crowded")
    # Texts take less room than their sets: these are made twice, to count and to choose.
    texts = stages.table(_texts(documents, within).select("cid", "h1", "text", "n", "root"), "crowded_texts")

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        wanted = batch.column(1).to_pylist()
        for i, words in enumerate(word_hashes([t.encode() for t in batch.column(2).to_pylist()])):
            own = shingle_set(words, size)
            # Rows of one doc_id may differ in text.
            if set_hash(own)[0] == wanted[i]:
                yield i, own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, own in sets(batch):
                held += np.bincount(_places(own), minlength=COUNTERS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["place", "n"])

    sums = texts.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[sums["place"].to_numpy()] = sums["n"].to_numpy()

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sizes, roots = (batch.column(k).to_pylist() for k in (0, 3, 4))
            for i, own in sets(batch):
                n = sizes[i]
                # Any one order of all shingles gives the same pairs; the rarest first gives the fewest candidates.
                own = own[np.lexsort((own, often[_places(own)]))][: n - -(-n * percent // 100) + 1]
                m = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.view(np.int64)), pa.array(np.full(m, cids[i])), pa.array(np.full(m, n)), pa.array(np.full(m, roots[i])), pa.array(np.arange(m))],
                    names=["s", "cid", "n", "root", "at"],
                )

    held = stages.table(texts.mapInArrow(rarest, "s long, cid long, n long, root long, at long"), "rare_shingles")
    # Of each shingle's components the one with most classes is met by the others only, not by itself.
    # Both groupings work on one dealing by shingle.
    tops = held.select("s", "root").repartition("s").groupBy("s", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(
        F.max_by("root", F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("roots")
    )
    tops = stages.table(tops.filter("roots > 1").select("s", "top"), "shared_shingles")
    # Shared shingles are few: what stays of the rows takes the sketches along, and the join itself uses them.
    shared = stages.table(held.join(tops, "s").join(classes.select("cid", "sketch"), "cid"), "shared_rows")
    member = F.struct("cid", "n", "root", "at", "sketch")
    few = shared.filter("root <> top").select("s", "top", member.alias("x"))
    many = shared.select(F.col("s").alias("__s"), member.alias("y"))
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    # At its first common shingle a pair can share that one and what follows in both orders.
    follows = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    fits = (small * 100 >= large * percent) & (follows * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)
    # Pairs outside the largest component are met in both orders, of which one is kept.
    once = (F.col("y.root") == F.col("top")) | (F.col("x.cid") < F.col("y.cid"))
    met = few.join(many, (F.col("s") == F.col("__s")) & (F.col("x.root") != F.col("y.root")) & once & fits & (_alike("x.sketch", "y.sketch") >= SKETCH_LEAST))
    return met.select(*_pair()).distinct(), texts


def full_sets(documents: DataFrame, classes: DataFrame, pairs: DataFrame, texts: DataFrame | None, size: int, stages: Stages) -> DataFrame:
    """(cid, shingles) of all classes in ``pairs``, from ``texts`` (cid, h1, text) if they are there already."""
    # Each column by itself first: a class stands in many pairs.
    ids = pairs.select(F.col("a").alias("cid")).distinct().unionByName(pairs.select(F.col("b").alias("cid")).distinct()).distinct()
    # Written first, so that Spark knows its size when it plans the join with the texts.
    if texts is not None:
        return stages.table(_sets(texts.join(stages.table(ids, "needed"), "cid"), size), "sets")
    needed = stages.table(ids.join(classes.select("cid", F.col("rep").alias("doc_id"), "h1"), "cid"), "needed")
    return stages.table(_sets(_texts(documents, needed), size), "sets")


def most_alike(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b, alike) that of each a, and that of each b, whose sketches have most in common."""
    first = pairs.groupBy("a").agg(F.max_by("b", F.struct("alike", "b")).alias("b"))
    return first.unionByName(pairs.groupBy("b").agg(F.max_by("a", F.struct("alike", "a")).alias("a"))).distinct()


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` with 100 * intersection >= percent * union on the full sets."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(one) + len(two) - len(np.union1d(one, two))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return staged(joined.mapInArrow(compare, "a long, b long").distinct(), "links")


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row of ``documents``.

    ``component_id`` is the smallest doc_id that links lead to, and ``kept`` marks the row that has
    it. Defined cases: null, empty and blank texts have an empty set, are linked with nothing and
    kept; rows with a null doc_id are linked with nothing, have a null component and are kept; rows of
    one doc_id with different texts are classes of their own, with equal ones one class; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = staged(signatures(documents, size), "signatures")
    real = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    grouped = real.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    narrow = staged(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # One row per class carries the signature: that of the representative.
    held = real.select(F.col("doc_id").alias("rep"), "h1", "h2", "n_shingles", "sig", "sketch")
    classes = held.join(narrow, ["rep", "h1", "h2", "n_shingles"]).dropDuplicates(["cid"])
    classes = staged(classes.select("cid", "rep", "h1", "n_shingles", "sig", "sketch"), "class_rows")
    rooted = classes.withColumn("root", F.col("cid"))
    links = None
    for trees, neighbours in (FIRST_PASS, (TREES, NEIGHBOURS), (0, 0)):
        stages = Stages(documents.sparkSession)
        pairs, texts = (candidates(rooted, trees, neighbours, percent, stages), None) if trees else rare_pairs(documents, rooted, size, percent, stages)
        pairs = stages.table(pairs, "pairs")
        sets = full_sets(documents, classes, pairs, texts, size, stages)
        # The likeliest links of each class first: most other pairs of a large group are then joined already.
        for part in (most_alike(pairs), None) if neighbours != 1 else (pairs,):
            if part is None:
                known = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
                apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
                part = pairs.join(known[0], "a", "left").join(known[1], "b", "left").filter(apart)
            more = confirmed(sets, stages.table(part.select("a", "b"), "compared"), percent)
            if links is None or more.limit(1).count():
                # Components so far stand for the links they came from.
                links = more if links is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
                roots = staged(components(links), "roots")
        stages.drop()
        known = roots.select(F.col("node").alias("cid"), "root")
        rooted = classes.join(known, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = narrow.join(roots, F.col("cid") == F.col("node"), "left").select("h1", "h2", "n_shingles", "rep", F.coalesce("root", "cid").alias("root"))
    named = staged(named, "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", "n_shingles", "component_id")
    joined = rows.select("doc_id", "text_hash", "n_shingles", "h1", "h2").join(staged(named, "components"), ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash"
    )


def without_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``documents``, with all their columns, of which one of each group stays; rows without words all stay.

    Rows that repeat doc_id and text are one document, unless the id is null.
    """
    found = staged(near_duplicates(documents, size, percent), "near_duplicates")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    gone = staged(gone, "gone")
    # Only rows whose id may be among them are exchanged.
    ids = gone.select(F.col("__id").alias("doc_id"))
    within = possible(documents, ids, "doc_id")
    here = (within["doc_id"] == gone["__id"]) & (F.xxhash64(within["text"]) == gone["__hash"])
    out = possible(documents, ids, "doc_id", "left_anti").unionByName(within.join(gone, here, "left_anti"))
    once = found.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    if once.filter("n > 1").limit(1).count():
        real = F.col("doc_id").isNotNull() & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
        out = out.filter(real).dropDuplicates(["doc_id", "text"]).unionByName(out.filter(~F.coalesce(real, F.lit(False))))
    return out
