"""Near-duplicates, fingerprints, toxicity, licences and top products against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import frame, sample, tokens, words
from pyspark.sql import functions as F

from ionweave.llm import fingerprints, graph, licenses, neardup, topk, toxicity
from ionweave.llm.common import possible, prepared
from ionweave.llm.shingles import shingle_set, word_hashes


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text):
    w = tokens(lower(text))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def groups(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(r[0], len(sets[i]), None if r[0] is None else least[find(i)]) for i, r in enumerate(rows)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check_groups(spark, rows):
    got = neardup.near_duplicates(frame(prepared(spark), rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(groups(rows), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates(spark):
    check_groups(spark, sample())
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    kept = neardup.without_near_duplicates(frame(spark)).collect()
    assert sum(r.doc_id == 90 for r in kept) == 1 and not {r.doc_id for r in kept} & set(range(60, 85))


def test_near_duplicates_in_crowded_regions(spark, monkeypatch):
    rng = random.Random(5)
    passage, rows = words(rng, 60), []
    for i in range(150):
        own = words(rng, 60)
        rows.append((i, passage + " " + own, "s", "en", 1, 1, None, 1))
        if i % 5 == 0:
            rows.append((1000 + i, passage + " " + own.rsplit(" ", 6)[0] + " " + words(rng, 5), "s", "en", 1, 1, None, 1))
    base = words(rng, 120).split()
    for i in range(100):
        copy = list(base)
        for at in rng.sample(range(120), 2):
            copy[at] = words(rng, 1)
        rows.append((3000 + i, " ".join(copy), "s", "en", 1, 1, None, 1))
    monkeypatch.setattr(neardup, "REGION", 16)
    check_groups(spark, rows)


def test_near_duplicates_among_many_that_look_as_near(spark, monkeypatch):
    rng = random.Random(8)
    # All pairs are at 84 / 114 = 0.74; those with one more word in common reach 85 / 113 = 0.75.
    passage, rows = words(rng, 88), []
    for i in range(140):
        rows.append((i, passage + " " + words(rng, 15), "s", "en", 1, 1, None, 1))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(rows[-1][1].split()[:89]) + " " + words(rng, 14), "s", "en", 1, 1, None, 1))
    assert len({c for _, _, c in groups(rows)}) > 70
    monkeypatch.setattr(neardup, "NEIGHBOURS", 1)
    check_groups(spark, rows)


def test_near_copies_that_are_joined_are_not_compared(spark, monkeypatch):
    rng = random.Random(9)
    base, rows, compared = words(rng, 150).split(), [], []
    for i in range(200):
        copy = list(base)
        copy[rng.randrange(150)] = words(rng, 1)
        rows.append((i, " ".join(copy), "s", "en", 1, 1, None, 1))

    def counting(sets, pairs, percent, confirmed=neardup.confirmed):
        compared.append(pairs.count())
        return confirmed(sets, pairs, percent)

    # One neighbour in two trees would leave nothing of so small a group to the next pass.
    monkeypatch.setattr(neardup, "confirmed", counting)
    monkeypatch.setattr(neardup, "FIRST_PASS", (1, 1))
    check_groups(spark, rows)
    assert sum(compared) < 4 * len(rows)


def test_possible_keeps_all_keys_and_few_others(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("text"))
    keys = spark.range(7, 20_000, 13).select(F.col("id").alias("k"))
    held = {r.k for r in possible(rows, keys, "k").collect()}
    wanted = set(range(7, 20_000, 13))
    assert wanted <= held and len(held) < len(wanted) + 20
    left = [r.k for r in possible(rows, keys, "k", "left_anti").collect()]
    assert len(left) + len(held) == 20_000 and None in left and not wanted & set(left)


def test_batches_of_texts_are_small(spark):
    sizes = prepared(spark).range(9000, numPartitions=1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows])}) for b in bs), "n long")
    assert max(r.n for r in sizes.collect()) <= 2000


def test_word_hashes_do_not_depend_on_the_batch(monkeypatch):
    texts = [(t or "").encode() for _, t, *_ in sample()]
    whole = [shingle_set(w).tolist() for w in word_hashes(texts)]
    monkeypatch.setattr("ionweave.llm.shingles.PIECE", 500)
    assert [shingle_set(w).tolist() for w in word_hashes(texts)] == whole
    assert [len(w) for w in word_hashes(texts)] == [len(tokens(t)) for _, t, *_ in sample()]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fingerprints(spark):
    got = fingerprints.fingerprint_documents(frame(prepared(spark))).collect()
    rows = list(dict.fromkeys((i, t or "") for i, t, *_ in sample() if i is not None))
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(sample())
    found = {(r.doc_id, r.n_chars): r for r in got if r.doc_id is not None}
    for k, (i, text) in enumerate(order[:-1]):
        after, h = order[k + 1][1], len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        r = found[i, len(text)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = paragraphs(text), paragraphs(after)
        assert abs(r.near_next - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
        a, b = paragraphs(text), paragraphs(edited)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    same = {r.fingerprint for r in got if r.doc_id in range(75, 85)}
    assert len(same) == 1
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0
    one = fingerprints.fingerprint_documents(frame(spark, sample()[:1])).first()
    assert one.near_next == 1.0


def paragraphs(text):
    out = set()
    for line in re.split(r"\n+", text):
        out |= set(re.split(r"(?<=[.!?])\s+", line)) if len(line) > fingerprints.LONG_LINE else {line}
    return {p for p in out if p.strip(" ")}


def test_licences(spark):
    rng = random.Random(3)
    texts = [
        None, "", "...", "CC BY cc-by (cc) by", "all rights reserved. All\nRights  Reserved", "This work is licensed under the GNU General Public License, version 3.",
        "x Licensed under CC BY-NC 4.0. y", "Licensed under the Apache License, Version 2.0.", "general public", "cc\xe9 by cc byK cc by",
        words(rng, 3000) + " cc by " + words(rng, 3000), "caf\xc9 ALL rights reserved",
    ]
    rows = [(i, t, "s", "en", 1, 1, None, 1) for i, t in enumerate(texts)] + [(None, "cc by", None, None, 1, 1, None, 1)]
    got = licenses.scan_licences(frame(prepared(spark), rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower("cc by" if r.doc_id is None else texts[r.doc_id]))
        starts, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(starts), ",".join(sorted(labels))), r
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r.labels for r in got}
    assert "cc-by-nc" in by[6] and "apache-2.0" in by[7] and "gpl-3.0" in by[5] and by[8] == ""
    assert licenses.scan_licences(frame(spark, [])).count() == 0


def test_licence_labels_agree_with_every_place(spark):
    rng = random.Random(12)
    notices = [t.replace("[", "").replace("]", "") for t in licenses.TEMPLATES.values()]
    texts = []
    for k, notice in enumerate(notices * 3):
        w = notice.split()
        for _ in range(k % 4):  # near variants: words lost, changed and added
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], ["word"], [w[i], "the"]])
        texts.append(words(rng, rng.randint(0, 30)) + ".\n" + " ".join(w).title() + "; " + words(rng, 5))
    texts += [texts[0], texts[0], (notices[0] + ". ") * 300, " ".join(notices), notices[3].split(" ", 4)[-1]]
    rows = [(i, t, "s", "en", 1, 1, None, 1) for i, t in enumerate(texts)] + [(0, texts[0], "s", "en", 1, 1, None, 1)]
    got = licenses.scan_licences(frame(prepared(spark), rows)).collect()
    index = licenses.template_index()
    files = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r[1])) for r in rows]
    idf = {t[3]: np.log((1 + len(files)) / (1 + sum(t[3] in f for f in files))) + 1 for t in index}
    want = {}
    for i, f in enumerate(files[: len(texts)]):
        best, labels = 0.0, set()
        for name in {t[0] for t in index}:
            own = [t for t in index if t[0] == name]
            whole = sum(idf[t[3]] for t in own)
            for start in {p - t[4] for t in own if t[5] for p in range(len(f)) if f[p] == t[3]}:
                hit = [t for t in own if 0 <= start + t[4] < len(f) and f[start + t[4]] == t[3]]
                score = sum(idf[t[3]] for t in hit) / whole
                if sum(t[5] for t in hit) == sum(t[5] for t in own) and score >= 0.75 - 1e-12:
                    best, labels = max(best, score), labels | {own[0][1]}
        want[i] = (",".join(sorted(labels)), best)
    assert len(got) == len(rows) and {x for r in got for x in r.labels.split(",")} >= set(licenses.TEMPLATES) - {"cc-by-4.0"}
    for r in got:
        assert r.labels == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-9, (r, want[r.doc_id])


def test_licences_without_the_rarest_word(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files"
    rows = [(i, t, "s", "en", 1, 1, None, 1) for i, t in enumerate([notice, "a file", notice.replace("is hereby", "hereby")])]
    got = {r.doc_id: r for r in licenses.scan_licences(frame(prepared(spark), rows)).collect()}
    assert got[0].labels == "mit" and 0.75 <= got[0].score < 1 and got[1].labels == got[2].labels == ""


def test_top_products(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(700, 12)) * rng.exponential(size=(700, 1))).astype(np.float32)
    x[1::7] = x[::7][: len(x[1::7])]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan")] * 12, 1), (2300, [float("inf")] * 12, 1), (None, [1.0] * 12, 1), (2400, [], 1)]
    monkeypatch.setattr(topk, "BLOCK", 64)
    got = topk.top_products(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, score int"), every=50, head=4).collect()
    v = np.floor(x.astype(float) * 1024).astype(np.int64)
    want = []
    for q in range(0, 700, 50):
        s = v @ v[q]
        best = [j for j in np.lexsort((np.arange(700), -s)) if j != q][:10]
        want += [(q, k + 1, int(j), int(s[j])) for k, j in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    few = topk.top_products(spark.createDataFrame(rows[:4], "vec_id bigint, embedding array<float>, score int")).collect()
    assert len(few) == 3
    assert topk.top_products(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    huge = [(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [1.0, 1.0])]
    assert [r.score for r in topk.top_products(spark.createDataFrame(huge, "vec_id bigint, embedding array<float>")).orderBy("rank").collect()][0] == 2**63 - 1


def labelled():
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = words(rng, rng.randint(20, 60)).split()
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["Vexor", "grumbol", "skelfing"]) + rng.choice(["", "an", "ik"]))
        rows.append((i, " ".join(text), f"s{i % 3}", "en", 1, 1, None, 1))
        marks.append((i, 1, int(bad), "x"))
    return rows, marks


def test_toxicity(spark):
    rows, marks = labelled()
    prepared(spark)
    more = [(None, "a vexor", None, None, 1, 1, None, 1), (900, None, None, None, 1, 1, None, 1), (901, "", None, None, 1, 1, None, 1)]
    labels = spark.createDataFrame(marks + [(None, 1, 1, "x"), (900, 1, None, "x")], "doc_id bigint, quality int, toxic int, text string")
    docs = frame(spark, rows + more)
    index = toxicity.build_index(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, index).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400) if got[i].held_out)
    assert got[None].predicted == 1 and got[900].score == got[901].score < 0.5
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].evidence
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels, index).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    # Cosines over the full vectors of all examples, by a second count of terms in plain loops.
    texts = {r[0]: r[1] or "" for r in rows}
    hold = Counter(h for _, t, *_ in rows + more for h in every_term(t or ""))
    telling = dict(zip(index.lookup.sorted.tolist(), index.idf))
    bucket = Counter()
    for h, n in hold.items():
        if h not in telling:
            bucket[h >> 46] += n
    size = len(rows) + len(more)
    weight = lambda h: telling.get(h, toxicity.PLAIN * (np.log((1 + size) / (1 + min(size, bucket[h >> 46]))) + 1))
    for h, w in telling.items():
        assert np.isclose(w, np.log((1 + size) / (1 + hold[h])) + 1) or np.isclose(w, toxicity.PLAIN * (np.log((1 + size) / (1 + hold[h])) + 1))
    vectors = {}
    for i in {*index.ids.tolist(), *range(0, 40, 4)}:
        v = {h: (1 + np.log(n)) * weight(h) for h, n in every_term(texts[i]).items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {h: x / norm for h, x in v.items()}
    for i in range(0, 40, 4):
        owner, terms, n = index.lookup.counts([texts[i].encode()])
        found, cosines = index.nearest(terms, index.vector(terms, n))
        every = np.sort([sum(x * vectors[j].get(h, 0.0) for h, x in vectors[i].items()) for j in index.ids.tolist()])[::-1]
        assert np.allclose(cosines, every[every > 0][: toxicity.NEIGHBOURS])
    none = toxicity.score_toxicity(docs, labels.filter("toxic = 5")).collect()
    assert len(none) == 403 and len({r.score for r in none}) == 1
    assert toxicity.score_toxicity(frame(spark, []), labels).count() == 0


def test_frequent_terms_add_as_rows_what_their_postings_would(spark, monkeypatch):
    rows, marks = labelled()
    docs, labels = frame(spark, rows), prepared(spark).createDataFrame(marks, "doc_id bigint, quality int, toxic int, text string")
    index = toxicity.build_index(docs, labels)
    monkeypatch.setattr(toxicity, "OFTEN", 0)
    plain = toxicity.build_index(docs, labels)
    assert len(index.full) and not len(plain.full) and len(plain.examples) == len(index.examples) + (index.full > 0).sum()
    for r in rows[:60]:
        _, terms, n = index.lookup.counts([r[1].encode()])
        (_, one), (_, two) = index.nearest(terms, index.vector(terms, n)), plain.nearest(terms, plain.vector(terms, n))
        assert np.allclose(one, two, rtol=0, atol=1e-12)


def every_term(text):
    return Counter(toxicity.term_hashes([text.encode()])[1].tolist())


def test_copy_of_a_toxic_example_of_words_seen_nowhere_else(spark):
    rows, marks = labelled()
    learnt = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5)
    asked = next(i for i in range(1100, 1200) if zlib.crc32(str(i).encode()) % 5 == 0)
    strange = "qorl zunt plevid harsk ombit"
    long_text = " ".join(f"w{k}" for k in range(60000)) + " " + strange
    more = [(i, t, None, None, 1, 1, None, 1) for i, t in ((learnt, strange), (asked, strange), (asked, strange), (asked + 1000, long_text))]
    labels = prepared(spark).createDataFrame(marks + [(learnt, 1, 1, "x")], "doc_id bigint, quality int, toxic int, text string")
    got = toxicity.score_toxicity(frame(spark, rows + more), labels).filter(F.col("doc_id") >= 1000).collect()
    asked_rows = [r for r in got if r.doc_id == asked]
    assert len(asked_rows) == 2 and asked_rows[0] == asked_rows[1]
    assert asked_rows[0].held_out and asked_rows[0].score > 0.5 and asked_rows[0].evidence[0] == learnt
    assert [r.predicted for r in got if r.doc_id == asked + 1000] == [0]
