"""Mixing and sharding: targets, nearness, limits and laws against plain loops."""

from collections import Counter, defaultdict
from zlib import crc32

from pyspark.sql import functions as F
from helpers import frame, sample, tokens

from ionweave.llm import mixing, sharding
from ionweave.llm.common import prepared


def water(sizes, weights, share, limit):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, left = set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return {s: limit * sizes[s] for s in order}
        level = (left - sum(limit * sizes[s] for s in capped)) / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > limit * sizes[s]}
        if not over:
            return {s: limit * sizes[s] if s in capped else w[s] * level for s in order}
        capped |= over


def test_mix(spark):
    got = mixing.mix_sources(frame(prepared(spark))).collect()
    size = Counter()
    for _, text, source, *_ in sample():
        size[source] += len(tokens(text))
    target = water(size, (3, 1, 2), 1.5, 2.0)
    taken, largest = Counter(), Counter()
    assert len(got) == len(sample())
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] * (15 if s == "S0" else 1)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix_sources(frame(spark).repartition(7)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}
    kept = Counter((r.doc_id, r.text) for r in mixing.mixed_documents(frame(spark)).collect())
    copies = defaultdict(int)
    for i, text, *_ in sample():
        copies[i, text] += 1
    for r in got:
        if r.doc_id is not None and r.size:
            assert sum(n for (i, _), n in kept.items() if i == r.doc_id) == r.copies * sum(n for (i, _), n in copies.items() if i == r.doc_id)


def test_larger_budgets_take_supersets(spark):
    docs = frame(prepared(spark))
    less = {r.doc_id for r in mixing.mix_sources(docs, share=0.5).filter("copies > 0 AND size > 0").collect()}
    more = {r.doc_id for r in mixing.mix_sources(docs, share=0.8).filter("copies > 0 AND size > 0").collect()}
    assert less <= more


def test_nothing_to_mix_or_shard(spark):
    docs = frame(prepared(spark), [])
    assert mixing.mix_sources(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0 and sharding.stratified_shards(docs).count() == 0
    blank = frame(spark, [(1, None, None, "en", 1, 1, True, 1), (2, "", "a", "en", 1, 1, True, 1)])
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix_sources(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_shards(spark):
    got = sharding.stratified_shards(frame(prepared(spark))).collect()
    want = Counter((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t, *_ in sample())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    counts = [len(shards[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    per = Counter((r.source, r.shard) for r in got)
    for s, n in Counter(r.source for r in got).items():
        assert all(abs(per[s, k] - n / 8) <= 2 for k in range(8))
    assert {r.grown_shard for r in got} == {None} and {r.law for r in got} == {"rows"}


def test_mixed_documents_keep_clashing_columns(spark):
    names = ["__g", "__key", "__whole", "__bound", "__salt", "__copy", "row"]
    docs = frame(spark).withColumns({n: F.concat(F.lit(n), F.coalesce("text", F.lit("-"))) for n in names})
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    plain = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_documents(frame(spark)).collect())
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == plain
    assert all(r[n] == n + ("-" if r.text is None else r.text) for r in rows for n in names)
