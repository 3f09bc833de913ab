"""Licence scan with a positional index of rare words.

Licence notices and phrases are short templates, whose words, weighted by their IDF over all files, form the
index. A file keeps the places of the index words. For each template that it could hold, its own rarest
word of the mandatory phrase is looked up, and the relative positions of the other mandatory words are
intersected with it: what is left are the places where the phrase stands word for word. The rest of the
words is intersected with those places alone and gives the score. All of that happens in the row; only
places found leave it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.session import staged

#: Words end at ASCII characters other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases of which every place counts, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening or key sentences, notices and headers of public licences; the phrases in brackets must stand word for word.
TEMPLATES = {
    "mit": "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files",
    "isc": "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted",
    "bsd": "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met",
    "apache-2.0": "licensed under the [apache license version 2 0]",
    "mpl-2.0": "this source code form is subject to the terms of the [mozilla public license] v 2 0",
    "lgpl": "under the terms of the gnu [lesser general public license] as published by the free software foundation",
    "agpl": "under the terms of the gnu [affero general public license] as published by the free software foundation",
    "gpl-3.0": "licensed under the gnu [general public license version 3] 0",
    "gpl-2.0": "licensed under the gnu [general public license version 2]",
    "cc-by-4.0": "licensed under [cc by 4 0]",
    "cc-by-sa": "licensed under [cc by sa] 4 0",
    "cc-by-nc": "licensed under [cc by nc] 4 0",
    "cc0": "[cc0 1 0 universal] public domain dedication",
    "unlicense": "this is free and unencumbered software [released into the public domain]",
    "mit-notice": "[the above copyright notice and this permission notice] shall be included in all copies or substantial portions of the software",
    "bsd-2-clause": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " 2 [redistributions in binary form must reproduce the above copyright notice] this list of conditions and the following disclaimer"
    " in the documentation and or other materials provided with the distribution",
    "bsd-3-clause": "neither the name of the copyright holder nor the names of its contributors may be [used to endorse or promote products"
    " derived from this software] without specific prior written permission",
    "as-is": "this software is provided by the copyright holders and contributors as is and [any express or implied warranties] including but not"
    " limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-2.0-header": "you may not use this file except in compliance with the license [you may obtain a copy of the license at] http www apache org"
    " licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"
    " basis without warranties or conditions of any kind either express or implied",
    "gpl-notice": "this program is free software you can [redistribute it and or modify it under the terms of the gnu general public license]"
    " as published by the free software foundation either version 3 of the license or at your option any later version",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be [held liable for any damages"
    " arising from the use of this software]",
    "bsl-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of [the software and accompanying documentation"
    " covered by this license] to use reproduce display distribute execute and transmit the software",
    "eclipse": "this program and the accompanying materials are made available under the terms of the [eclipse public license]",
    "artistic": "this package is free software you can redistribute it and or modify it under the terms of the [artistic license]",
}


SEPARATORS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def template_index(phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> list[tuple]:
    """(template, label, kind, word, tpos, mandatory) rows: bounded by the template texts alone."""
    texts = [(p, lab, "phrase", f"[{p}]") for p, lab in phrases.items()] + [(n, n, "template", t) for n, t in templates.items()]
    out = []
    for name, label, kind, text in texts:
        must, at = False, 0
        for piece in re.findall(r"\[|\]|[^\s\[\]]+", text):
            if piece in "[]":
                must = piece == "["
            else:
                out.append((name, label, kind, piece, at, must))
                at += 1
    return out


def licence_words(documents: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(doc_id, __row, n_words, hits, words): places of the words of the index in each whole text, in order, and which words they are."""
    text = F.coalesce("text", F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    rows = documents.select("doc_id", F.split(F.btrim(lower, F.lit(SEPARATORS)), GAP).alias("__w"))
    known = F.transform("__w", lambda w, i: F.when(w.isin(list(vocabulary)), F.struct(i.cast("long").alias("pos"), w.alias("word"))))
    n = F.when(F.element_at("__w", 1) == "", 0).otherwise(F.size("__w")).cast("long")
    rows = rows.select("doc_id", n.alias("n_words"), F.filter(known, lambda h: h.isNotNull()).alias("hits"))
    return rows.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "n_words", "hits", F.array_distinct("hits.word").alias("words"))


def word_idf(files: DataFrame, index: Sequence[tuple]) -> dict[str, float]:
    """IDF over all files of each word of the index: as many rows as the templates have words."""
    words = files.select(F.explode("words").alias("word"))
    held = {r[0]: r[1] for r in words.groupBy("word").agg(F.count(F.lit(1))).collect()}
    total = files.count()
    return {t[3]: math.log((1 + total) / (1 + held.get(t[3], 0))) + 1 for t in index}


def _postings(index: Sequence[tuple], idf: Mapping[str, float], least: float) -> Column:
    """The index as one array literal: of each template its leads, mandatory and other postings, and what they weigh.

    Leads are postings of which any place of score ``least`` holds one: the mandatory ones, or, in a
    template without, as many of highest IDF as no such place can lack.
    """

    def posting(t: tuple) -> str:
        return f"named_struct('w', '{t[3]}', 't', {t[4]}L, 'x', {idf[t[3]]!r}D)"

    def listed(ts: Sequence[tuple]) -> str:
        return f"array({', '.join(map(posting, ts))})" if ts else "cast(array() AS array<struct<w: string, t: bigint, x: double>>)"

    rows = []
    for name in dict.fromkeys(t[0] for t in index):
        own = [t for t in index if t[0] == name]
        must, rest, whole = [t for t in own if t[5]], [t for t in own if not t[5]], sum(idf[t[3]] for t in own)
        leads, spare = list(must), (1 - least) * whole * (1 + 1e-9)
        for t in () if must else sorted(rest, key=lambda t: (-idf[t[3]], t[4])):
            leads.append(t)
            spare -= idf[t[3]]
            if spare < 0:
                break
        rows.append(
            f"named_struct('template', '{name}', 'label', '{own[0][1]}', 'kind', '{own[0][2]}', 'leads', {listed(leads)}, 'must', {listed(must)}, 'rest', {listed(rest)},"
            f" 'base', {float(sum(idf[t[3]] for t in must))!r}D, 'whole', {float(whole)!r}D)"
        )
    return F.expr(f"array({', '.join(rows)})")


def licence_places(files: DataFrame, index: Sequence[tuple], idf: Mapping[str, float], least: float = 0.75) -> DataFrame:
    """(__row, template, label, kind, start, score): where templates stand in a file, with their matched weight (0 to 1).

    A notice that is cut off in front may start before the first word.
    """

    def starts(p: Column) -> Column:
        return F.transform(F.filter("hits", lambda h: h["word"] == p["w"]), lambda h: h["pos"] - p["t"])

    def begun(t: Column) -> Column:
        """Starts at the file's own rarest mandatory word (fewest places, then highest IDF); without one, at all leads."""
        rank = F.transform(t["must"], lambda p: F.struct(F.size(F.filter("hits", lambda h: h["word"] == p["w"])).alias("k"), (-p["x"]).alias("x"), p["t"].alias("t"), p["w"].alias("w")))
        every = F.array_distinct(F.flatten(F.transform(t["leads"], starts)))
        return F.when(F.size(t["must"]) > 0, starts(F.array_min(rank))).otherwise(every)

    def standing(t: Column) -> Column:
        return F.aggregate(t["must"], begun(t), lambda held, p: F.when(F.size(held) == 0, held).otherwise(F.array_intersect(held, starts(p))))

    # A template is open in a file that holds all its mandatory words and enough weight.
    def possible(t: Column) -> Column:
        has = lambda p: F.array_contains("words", p["w"])
        rest = F.aggregate(t["rest"], t["base"], lambda s, p: s + F.when(has(p), p["x"]).otherwise(0.0))
        return F.forall(t["must"], has) & (rest >= F.lit(least * (1 - 1e-9)) * t["whole"])

    names = ("template", "label", "kind", "rest", "base", "whole")
    opened = F.transform(F.filter(_postings(index, idf, least), possible), lambda t: F.struct(*[t[n].alias(n) for n in names], standing(t).alias("starts")))
    rows = files.select("__row", "hits", F.explode(opened).alias("t")).filter(F.size("t.starts") > 0)
    # One row per place and word of the rest that stands there, and one for the mandatory words.
    first = F.transform("t.starts", lambda s: F.struct(s.alias("start"), F.col("t.base").alias("x")))
    more = F.flatten(F.transform("t.rest", lambda p: F.transform(F.array_intersect("t.starts", starts(p)), lambda s: F.struct(s.alias("start"), p["x"].alias("x")))))
    held = rows.select("__row", "t.template", "t.label", "t.kind", "t.whole", F.explode(F.concat(first, more)).alias("p"))
    sums = held.groupBy("__row", "template", "label", "kind", "p.start").agg((F.sum("p.x") / F.max("whole")).alias("score"))
    return sums.filter(F.col("score") >= least * (1 - 1e-9)).select("__row", "template", "label", "kind", "start", F.least(F.lit(1.0), "score").alias("score"))


def scan_licences(
    documents: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, least: float = 0.75
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, templates.

    ``templates`` names the licence texts found, ``n_base`` counts all places of ``phrases`` and
    first_word/last_word are their smallest and largest start. The score is that of
    the best place, a phrase counting 1. Defined cases: null and empty texts have no words, labels ''
    and score 0; repeated rows are scanned each for itself; a null doc_id stays null; an empty table
    gives an empty result; other columns are ignored.
    """
    index = template_index(phrases, templates)
    files = staged(licence_words(documents, sorted({t[3] for t in index})), "licence_words")
    places = licence_places(files.filter(F.size("hits") > 0), index, word_idf(files, index), least)
    base = F.col("kind") == "phrase"
    found = places.groupBy("__row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("__base"), F.collect_set("label").alias("__labels"), F.max("score").alias("score"),
        # Bounded by the number of templates, however often one stands in a file.
        F.collect_set(F.when(~base, F.col("template"))).alias("templates"),
    )
    joined = files.select("__row", "doc_id", "n_words").join(found, "__row", "left")
    text = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        text("__base").alias("base_labels"), text("__labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("templates", F.array().cast("array<string>")).alias("templates"),
    )
