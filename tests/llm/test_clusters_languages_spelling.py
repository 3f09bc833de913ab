import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, frame, sample

from ionweave.llm import clusters, languages, spelling

VECTORS = "vec_id bigint, embedding array<float>, cluster int, distance string, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 7, "x", 1) for i, e in rows], VECTORS)


def brute_clusters(rows, k, rounds, dims):
    held = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            held.append((i, [min(max(math.floor(float(np.float32(x)) * 1024), -clusters.LIMIT), clusters.LIMIT) for x in e]))
    order = sorted(held, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in held:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, g in groups.items():
            cents[j] = [sum(col) // len(g) for col in zip(*g)]
    found = [(i, *nearest(v)[::-1]) for i, v in held]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, c, d, sums[c], sum(sums.values()), sha[c]) for i, c, d in found)


@pytest.mark.parametrize("k", [3, 40])
def test_clusters_agree_with_loops(spark, k):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 3, 0.6) for _ in range(4)]) for i in range(30)]
    rows += [rows[0], rows[0], (3, [9.0, 9.0, 9.0, -9.0]), (None, [0.1] * 4), (50, None), (51, [1.0] * 3), (52, [1.0, None, 1.0, 1.0])]
    rows += [(53, [float("nan"), 0.0, 0.0, 0.0]), (54, [float("inf"), 0.0, 0.0, 0.0]), (55, [3e38, 0.0, 0.0, -3e38]), (56, [])]
    got = clusters.clusters_with_inertia(vectors(spark, rows), k=k, rounds=4, dims=4)
    assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows, k, 4, 4)


def test_equal_starts_leave_an_empty_centroid_and_empty_tables(spark):
    rows = [(1, [0.5, 0.5])] * 5
    out, cents = clusters.cluster_vectors(vectors(spark, rows), k=3, rounds=2, dims=2)
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0)] * 5 and cents == [(512, 512)] * 3
    assert clusters.clusters_with_inertia(vectors(spark, [])).collect() == []
    assert clusters.clusters_with_inertia(vectors(spark, [(1, None)])).collect() == []


SOUNDS = {"aa": "th er on wh ing ly", "bb": "sch ung ü ver ß ich", "cc": "é eau ou ç les que", "дд": "ши на По ст ого ё"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def brute_ngrams(text):
    letters = [languages._value(ord(c)) for c in "\n" + text + "\n"]
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            gram = letters[i : i + n]
            inner = gram[1] if n == 3 else max(gram)
            if inner > 0:
                yield n, tuple(gram)


def test_language_counts_take_whole_texts(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, lang, rng.randint(0, 40)) for lang in SOUNDS for _ in range(6)] + ["", "42 %", "中文 text\U00010400é", "x" * 300, prose(rng, "cc", 200)]
    want = [Counter(int(languages._hash(*[np.array([x], np.uint32) for x in g])[0]) for _, g in brute_ngrams(t)) for t in texts]
    for piece in (1 << 19, 64, 17):
        monkeypatch.setattr(languages, "PIECE", piece)
        got = [Counter() for _ in texts]
        for first, v, owner, skip in languages.pieces(texts):
            for place, h in languages.ngrams(v, skip):
                for o, x in zip(owner[place], h):
                    got[first + int(o)][int(x)] += 1
        assert got == want, piece


def test_languages_are_learnt_and_held_out(spark):
    rng = random.Random(9)
    rows, truth = [], {}
    for i in range(240):
        lang = rng.choice(list(SOUNDS))
        held = zlib.crc32(str(i).encode()) % 3 == 1
        rows.append((i, prose(rng, lang, rng.randint(3, 60)), "s", "zz" if held else lang, 1, 1, None, 1))
        truth[i] = lang
    rows += [(900, None, "s", "aa", 1, 1, None, 1), (901, "", "s", "aa", 1, 1, None, 1), (902, "12 - 3", "s", "aa", 1, 1, None, 1), (5, rows[5][1], "s", None, 1, 1, None, 1), (None, "thererthing", None, None, 1, 1, None, 1)]
    rows.append((903, prose(rng, "bb", 200_000), "s", "bb", 1, 1, None, 1))
    got = languages.identify_languages(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        by_id.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["score"]))
    assert all(len(v) == 1 for v in by_id.values())
    assert [by_id[i] for i in (900, 901, 902)] == [{("und", 0.0)}] * 3
    assert next(iter(by_id[None]))[0] == "aa" and next(iter(by_id[903]))[0] == "bb"
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(next(iter(by_id[i]))[0] == truth[i] for i in held) >= 0.95 * len(held)
    assert "zz" not in {k for v in by_id.values() for k, _ in v}


def test_scores_are_those_of_naive_bayes(spark):
    rng = random.Random(4)
    rows = [(lang, prose(rng, lang, 8)) for lang in ("aa", "bb", "cc") for _ in range(5)]
    model = languages.learn_languages(spark.createDataFrame(rows, "lang string, text string"))
    buckets = model.matrix.shape[1]
    counts = {lang: Counter() for lang in ("aa", "bb", "cc")}
    index = lambda g: int(languages._hash(*[np.array([x], np.uint32) for x in g])[0] >> np.uint32(16)) & (buckets - 1)
    for lang, t in rows:
        counts[lang].update(index(g) for _, g in brute_ngrams(t))
    text = prose(rng, "bb", 2) + " " + prose(rng, "cc", 2)
    logs = {}
    for lang, c in counts.items():
        total = sum(c.values()) + languages.SMOOTH * buckets
        logs[lang] = math.log(1 / 3) + sum(math.log((c[index(g)] + languages.SMOOTH) / total) for _, g in brute_ngrams(text))
    best = max(sorted(logs), key=lambda k: logs[k])
    langs, scores = model.predict([text])
    assert langs == [best] and scores[0] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-3)


def test_nothing_to_learn_from(spark):
    rows = [(1, "abc", "s", None, 1, 1, None, 1)]
    assert [tuple(r) for r in languages.identify_languages(frame(spark, rows)).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert languages.identify_languages(spark.createDataFrame([], DOCS)).collect() == []


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, ratio):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def brute_words(rows):
    import re

    found = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


@pytest.mark.parametrize("symbols", [None, 2])
def test_near_words_agree_with_all_pairs(spark, monkeypatch, symbols):
    if symbols:  # Few symbols: many words share a reduced word.
        monkeypatch.setattr(spelling, "symbols_for", lambda many, least: symbols)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcéÿz") for _ in range(rng.randint(7, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    words = {}
    for w in base:
        words[w] = rng.choice([2, 3, 30, 400, 5000])
        for _ in range(4):
            i = rng.randrange(len(w))
            words.setdefault(rng.choice([w[:i] + rng.choice("abcéÿz") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abcéÿz") + w[i + 1 :]]), rng.choice([2, 25, 300]))
    words = {w: n for w, n in words.items() if len(w) >= 6}
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), ratio=10, least=6)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_groups(words, 10)


def test_variants_of_documents(spark):
    rng = random.Random(8)
    stock = ["".join(rng.choice("abcdeÀé") for _ in range(rng.randint(6, 11))) for _ in range(30)]
    rows = sample() + [(1000 + i, " ".join(w.title() if rng.random() < 0.3 else w for w in rng.choices(stock, k=120)), "s", "en", 1, 1, None, 1) for i in range(40)]
    rows += [(2000, "-".join(stock) * 200, "s", "en", 1, 1, None, 1), rows[-1], (2001, "x" * 100_000, None, None, 1, 1, None, 1)]
    want = brute_groups(brute_words(rows), 10)
    got = {tuple(r) for r in spelling.spelling_variants(frame(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == want and any(r[1] for r in want)
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []
