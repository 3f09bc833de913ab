"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has 18 cells in three rows. Each distinct paragraph digest is added to one cell of each
row: a count, the XOR of the digests and the XOR of their check values. Two sketches subtract cell by
cell, which cancels the common paragraphs; cells left with a single digest are peeled one after
another until none is left, which recovers the digests that differ. Where that fails, both texts are
sketched again eight times as large (one sketch for each eighth of the digests), and so on for
the eighths that still fail. Everything is an array expression in the row of the document.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.session import staged

ROWS, WIDTH, PARTS = 3, 6, 8
#: Characters beyond which a line is cut at the ends of sentences.
LONG_LINE = 500
ROUNDS = 8
KEY = ["__id", "__null", "__text_hash"]


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs: lines, and sentences of long lines; blank ones don't count."""
    lines = F.split(text, r"\n+")
    pieces = F.transform(lines, lambda x: F.when(F.length(x) > LONG_LINE, F.split(x, r"(?<=[.!?])\s+")).otherwise(F.array(x)))
    return F.array_distinct(F.transform(F.filter(F.flatten(pieces), lambda p: F.btrim(p) != ""), lambda p: F.xxhash64(p)))


def _check(k: Column) -> Column:
    return F.hash(k, F.lit(7))


def _holds(k: Column, cell: Column, level: int) -> Column:
    """Whether digest ``k`` belongs to the cell, one of its row."""
    row = F.floor(cell / WIDTH).cast("int")
    field = F.when(row == 0, F.shiftrightunsigned(k, 0)).when(row == 1, F.shiftrightunsigned(k, 20)).otherwise(F.shiftrightunsigned(k, 40))
    return F.pmod(field.bitwiseAND(F.lit(0xFFFFF)) + level * 7 * (row + 1) * F.shiftrightunsigned(k, 44), F.lit(WIDTH)) == cell % WIDTH


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("long").alias("k"), c.cast("int").alias("c"))


def sketch(keys: Column, level: int = 0) -> Column:
    """The cells of a set of digests."""
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))

    def fill(i: Column) -> Column:
        def add(s: Column, k: Column) -> Column:
            return F.when(_holds(k, i, level), _cell(s["n"] + 1, s["k"].bitwiseXOR(k), s["c"].bitwiseXOR(_check(k)))).otherwise(s)

        return F.aggregate(keys, zero, add)

    return F.transform(F.sequence(F.lit(0), F.lit(ROWS * WIDTH - 1)), fill)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, level: int = 0) -> Column:
    """struct(found, done): how many digests differ, and whether every cell was emptied."""
    none = F.array().cast("array<struct<k:bigint,n:int>>")
    start = F.struct(cells.alias("cells"), none.alias("pure"), F.lit(0).alias("found"))

    def pure(s: Column) -> Column:
        single = F.filter(s["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"])))
        keys = F.array_distinct(F.transform(single, lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n"))))
        return F.struct(s["cells"].alias("cells"), keys.alias("pure"), s["found"].alias("found"))

    def remove(s: Column) -> Column:
        def without(x: Column, i: Column) -> Column:
            def take(y: Column, p: Column) -> Column:
                less = _cell(y["n"] - p["n"], y["k"].bitwiseXOR(p["k"]), y["c"].bitwiseXOR(_check(p["k"])))
                return F.when(_holds(p["k"], i, level), less).otherwise(y)

            return F.aggregate(s["pure"], x, take)

        cells = F.transform(s["cells"], without)
        return F.struct(cells.alias("cells"), none.alias("pure"), (s["found"] + F.size(s["pure"])).cast("int").alias("found"))

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, pure(s)).when(F.size(s["pure"]) > 0, remove(s)).otherwise(s)

    def end(s: Column) -> Column:
        full = F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0))
        return F.struct(s["found"].alias("found"), (~full).alias("done"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * ROUNDS)), start, step, end)


def _eighth(keys: Column, part: Column, level: int) -> Column:
    return F.filter(keys, lambda k: F.pmod(F.xxhash64(k, F.lit(1000 + level)), F.lit(PARTS)) == part)


def _retry(a: Column, b: Column, level: int) -> Column:
    """Array of struct(a, b, r) of the eighths, each with the result of its own sketch."""

    def one(part: Column) -> Column:
        return F.struct(_eighth(a, part, level).alias("a"), _eighth(b, part, level).alias("b"))

    def result(p: Column) -> Column:
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), peel(subtract(sketch(p["a"], level), sketch(p["b"], level)), level).alias("r"))

    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), one), result)


def next_texts(documents: DataFrame) -> DataFrame:
    """(__id, __null, __text_hash, text, next_head, next_keys) per row; the next document is that of the next smaller doc_id.

    Rows that repeat doc_id and text count as one document here. Texts are shuffled once, and half of
    each, with its digests, once more to the document before it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("__id"), F.col("doc_id").isNull().alias("__null"),
        F.xxhash64(text).alias("__text_hash"), text.alias("text"),
    )
    keys = rows.groupBy(*KEY).agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("many"))
    order = [F.col("__null"), F.col("__id").desc(), F.col("__text_hash")]
    placed = staged(keys.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "order")
    repeated = placed.filter("many > 1").limit(1).count() > 0
    me = F.struct(*KEY)
    w = Window.partitionBy("__part").orderBy(*order)
    ahead = placed.withColumns({"me": me, "next": F.lead(me).over(w)})
    heads = placed.groupBy("__part").agg(F.min(F.struct("__null", (-F.col("__id")).alias("__id"), "__text_hash")).alias("h"))
    head = F.struct((-F.col("h.__id")).alias("__id"), F.col("h.__null").alias("__null"), F.col("h.__text_hash").alias("__text_hash"))
    heads = heads.select("__part", head.alias("h"))
    # One row for each range of ids.
    over = Window.orderBy("__part")
    wrap = F.first("h").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("__part", F.coalesce(F.lead("h").over(over), wrap).alias("h"))
    link = ahead.join(heads, "__part").select("n", "me", F.coalesce("next", "h").alias("next"))
    link = link.select(*[F.col(f"next.{c}").alias(c) for c in KEY], *[F.col(f"me.{c}").alias(f"p{c}") for c in KEY], F.floor(F.col("n") / 2).cast("int").alias("need"))
    link = staged(link, "next")
    heads_of = rows.join(link, KEY).select(
        *[F.col(f"p{c}").alias(c) for c in KEY], F.substring(F.col("text"), F.lit(1), F.col("need")).alias("next_head"), digests(F.col("text")).alias("next_keys")
    )
    if repeated:
        heads_of = heads_of.dropDuplicates(KEY)
    return rows.join(heads_of, KEY)


def _hex(cells: Column) -> Column:
    shown = F.transform(cells, lambda x: F.concat_ws(".", x["n"].cast("string"), F.lower(F.hex(x["k"])), F.lower(F.hex(x["c"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))))
    return F.array_join(shown, "-")


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last half replaced by as much of the start of the next document. Likeness is
    common over all distinct paragraphs, from the recovered difference; two texts without a
    paragraph are alike (1.0). A fingerprint is the number of paragraphs, a hash of the whole text and
    the 18 cells. Defined cases: a null text is an empty one; null doc_ids come after all others;
    rows that repeat doc_id and text count as one document in the order and give a result each; a
    single document is its own next; an empty table gives an empty result; other columns are ignored.
    """
    rows = next_texts(documents)
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("next_head"))
    rows = rows.select(
        F.when(~F.col("__null"), F.col("__id")).alias("doc_id"), n.cast("long").alias("n_chars"), F.col("__text_hash").alias("th"),
        digests(F.col("text")).alias("a"), edited.alias("edited"), F.col("next_keys").alias("x"),
    )
    rows = rows.select(
        "doc_id", "n_chars", "th", "a", "x", digests(F.col("edited")).alias("e"), F.sha2("edited", 256).alias("sha"), F.xxhash64("edited").alias("eh")
    )
    rows = rows.withColumns({"fa": sketch(F.col("a")), "fe": sketch(F.col("e")), "fx": sketch(F.col("x"))})
    rows = rows.withColumns({"pe": peel(subtract(F.col("fa"), F.col("fe"))), "px": peel(subtract(F.col("fa"), F.col("fx")))})
    nothing = F.array().cast(f"array<struct<a:array<bigint>,b:array<bigint>,r:struct<found:int,done:boolean>>>")
    for p, b in (("pe", "e"), ("px", "x")):
        rows = rows.withColumn(f"{p}8", F.when(F.col(f"{p}.done"), nothing).otherwise(_retry(F.col("a"), F.col(b), 1)))

    def total(p: str) -> Column:
        parts = F.aggregate(F.filter(f"{p}8", lambda r: r["r"]["done"]), F.lit(0), lambda s, r: s + r["r"]["found"])
        return F.when(F.col(f"{p}.done"), F.col(f"{p}.found")).otherwise(parts)

    def open_parts(p: str, name: str) -> Column:
        left = F.filter(f"{p}8", lambda r: ~r["r"]["done"])
        return F.transform(left, lambda r: F.struct(F.lit(name).alias("pair"), r["a"].alias("a"), r["b"].alias("b")))

    first = staged(rows.select(
        F.monotonically_increasing_id().alias("__row"), "doc_id", "n_chars", "sha", "th", "eh", "fa", "fe", F.size("a").alias("na"), F.size("e").alias("ne"),
        F.size("x").alias("nx"), total("pe").alias("de"), total("px").alias("dx"), F.concat(open_parts("pe", "e"), open_parts("px", "x")).alias("open"),
    ), "fingerprints")
    open_ = first.select("__row", F.explode("open").alias("o")).select("__row", "o.pair", "o.a", "o.b")
    found, level = [], 1
    while open_.limit(1).count():
        level += 1
        tried = open_.select("__row", "pair", F.explode(_retry(F.col("a"), F.col("b"), level)).alias("t"))
        # Digests are written for the parts that go on only.
        left = [F.when(~F.col("t.r.done"), F.col(f"t.{c}")).alias(c) for c in "ab"]
        tried = staged(tried.select("__row", "pair", F.col("t.r.found").alias("d"), F.col("t.r.done").alias("done"), *left), "retry")
        found.append(tried.filter("done").select("__row", "pair", "d"))
        open_ = tried.filter("NOT done").select("__row", "pair", "a", "b")
    out = first.drop("open")
    if found:
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        more = every.groupBy("__row").agg(
            F.sum(F.when(F.col("pair") == "e", F.col("d"))).alias("me"), F.sum(F.when(F.col("pair") == "x", F.col("d"))).alias("mx")
        )
        out = out.join(more, "__row", "left")
    else:
        out = out.withColumns({"me": F.lit(0), "mx": F.lit(0)})

    def near(other: str, d: str, more: str) -> Column:
        both, apart = F.col("na") + F.col(other), F.col(d) + F.coalesce(F.col(more), F.lit(0))
        return F.when(both == 0, 1.0).otherwise((both - apart) / (both + apart))

    def shown(count: str, whole: str, cells: str) -> Column:
        return F.concat(F.col(count).cast("string"), F.lit(":"), F.lower(F.hex(whole)), F.lit(":"), _hex(F.col(cells)))

    return out.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), shown("na", "th", "fa").alias("fingerprint"),
        shown("ne", "eh", "fe").alias("edited_fingerprint"), near("ne", "de", "me").alias("near_edited"), near("nx", "dx", "mx").alias("near_next"),
    )
