"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart have reduced words that are equal or one
edit apart too, so the one-edit neighbourhood of every reduced word is generated and joined with the
reduced vocabulary, and the pairs that meet are verified on the original strings. The one-edit relation
is symmetric, so each unordered pair is met once: an insertion is the deletion seen from the longer
word, a replacement is made towards the larger symbol. The number of symbols rises with the vocabulary
so that a reduced word stands for few words at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.session import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All characters of a word once A-Z are lower-cased.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Hash functions tried for the letters; that which spreads the vocabulary's letters best is taken.
TRIALS = 64


def letter_runs(documents: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """(word) of every maximal run of letters of at least ``least``, A-Z lower-cased.

    A run loses one character where ``every`` divides the CRC-32 of its doc_id and itself; a null doc_id counts as an empty text.
    """
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"([A-Za-zÀ-ÿ]{{{least},}})"), F.lit(1))
    rows = documents.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("w")).select("w", F.crc32(F.concat("id", "w").cast("binary")).alias("h"))
    shorter = F.overlay("w", F.lit(""), (F.col("h") % F.length("w")).cast("int") + 1, F.lit(1))
    return rows.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("w")).alias("word"))


def vocabulary(words: DataFrame, least: int = 7, count: int = 2) -> DataFrame:
    """(word, n) of the words of at least ``least`` characters and ``count`` occurrences."""
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)


def symbols_for(words: int, least: int) -> int:
    """The fewest symbols, from 4 on, with as many reduced words of the least length as there are words."""
    size = 4
    while size**least < words and size < len(LETTERS):
        size += 1
    return size


def _symbols(size: int, trial: int) -> list[int]:
    return [((ord(c) + 1) * (2654435761 + 2 * trial * 40503) >> 13) % size for c in LETTERS]


def reduction(words: DataFrame, size: int) -> str:
    """The symbol of each of ``LETTERS``: of several hashes the one that spreads the letters of the vocabulary most evenly."""
    rows = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["c"]: r["n"] for r in rows.filter(F.col("c").isin(list(LETTERS))).collect()}

    def unevenness(trial: int) -> int:
        sums = [0] * size
        for c, k in zip(LETTERS, _symbols(size, trial)):
            sums[k] += counts.get(c, 0)
        return sum(s * s for s in sums)

    best = min(range(TRIALS), key=unevenness)
    return "".join(chr(ord("0") + k) for k in _symbols(size, best))


def neighbourhood(reduced: str, size: int) -> Column:
    """The reduced word first, then what one deletion or one replacement by a larger symbol makes of it."""
    r = F.col(reduced)
    places, symbols = F.sequence(F.lit(1), F.length(r)), F.array(*[F.lit(chr(ord("0") + k)) for k in range(size)])
    cut = F.transform(places, lambda i: F.overlay(r, F.lit(""), i, F.lit(1)))
    swapped = F.transform(places, lambda i: F.transform(F.filter(symbols, lambda s: s > r.substr(i, F.lit(1))), lambda s: F.overlay(r, s, i, F.lit(1))))
    return F.array_distinct(F.concat(F.array(r), cut, F.flatten(swapped)))


def near_pairs(words: DataFrame, least: int = 7) -> DataFrame:
    """(word, n, other, other_n) of all unordered pairs of distinct words exactly one edit apart; ``words`` (word, n) is read twice."""
    many = words.count()
    size = symbols_for(many, least)
    symbols = reduction(words, size)
    spread = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // 100_000)
    reduced = words.repartition(spread, "word").withColumn("r", F.translate("word", LETTERS, symbols))
    made = reduced.select("word", "n", F.posexplode(neighbourhood("r", size)).alias("place", "key"))
    held = reduced.select(F.col("r").alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    one = F.levenshtein("word", "other", 1) == 1
    # Words of one reduced word meet in both orders, and themselves: one order is kept.
    return made.join(held, (made.key == held.key) & ((F.col("place") > 0) | (F.col("word") < F.col("other"))) & one).select("word", "n", "other", "other_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word that ``links`` (word, root) lead to, by pointer doubling; counts rise along links, so they end."""
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        links = staged(links.join(on, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__on")), "roots")
        if links.filter("__on").isEmpty():
            return links.drop("__on")
        links = links.drop("__on")


def group_variants(words: DataFrame, ratio: int = 10, least: int = 7) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), whose words are distinct.

    ``form`` is the near word of largest n, ties to the smallest in code-point order, where that n is at
    least ``ratio`` (2 or more) times the word's own; ``root`` follows forms to the last.
    """
    pairs = near_pairs(words, least).select(
        F.explode(F.array(F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")
    )
    near = pairs.select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    formed = staged(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame, least: int = 7, count: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of whole ``documents`` texts.

    Defined cases: null and empty texts hold no word; a null doc_id counts as an empty text; repeated
    rows count as often as they stand; texts of any length count whole; a table without words gives an
    empty result; columns other than doc_id and text are not read.
    """
    return group_variants(staged(vocabulary(letter_runs(documents, least, every), least, count), "words"), ratio, least)
