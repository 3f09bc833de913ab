"""A small fixture with nulls, ties, repeated rows, a very long text and columns that operators use themselves."""

import random
import re

DOCS = "doc_id bigint, text string, source string, lang string, size bigint, shard int, kept boolean, __row bigint"


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") for _ in range(n))


def sample(seed=1):
    rng = random.Random(seed)
    rows = []

    def add(i, text, source):
        rows.append((i, text, source, "en", 5, 1, None, 3))

    for i in range(60):
        add(i, words(rng, rng.randint(1, 80)) + ".\n" + words(rng, rng.randint(1, 60)), f"s{i % 4}")
    base = rows[3][1]
    for i in range(60, 75):
        add(i, base + " " + words(rng, 3), "s0")
    for i in range(75, 85):
        add(i, base, "s0")
    add(85, None, "s1")
    add(86, "", None)
    add(87, " \n\t ", "s1")
    add(88, words(rng, 30_000), "s9")
    add(None, base, "s2")
    add(None, "lone words here", None)
    add(90, "AB Ab aB", "S0")
    add(91, "caf\xe9 中文 \U0001f642 <|endoftext|> it's  two spaces\x1cx", "s1")
    add(90, "AB Ab aB", "S0")
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(sample() if rows is None else rows, DOCS)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
