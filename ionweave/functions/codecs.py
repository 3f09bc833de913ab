"""Text forms of nested values, used only at the CSV boundary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_WORDS = ("", "nan", "none", "<na>", "{}")  # fixed values, compared in lower case


def decode_id_list(text: Column) -> Column:
    """``"3;1; ;x;3.0"`` -> sorted distinct ``ARRAY<BIGINT>``; bad tokens are skipped."""
    number = lambda t: F.trim(t).try_cast("double")
    tokens = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), number)
    whole = F.filter(tokens, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.array_sort(F.array_distinct(F.transform(whole, lambda v: v.cast("bigint"))))


def encode_id_list(ids: Column) -> Column:
    """Sorted distinct ids joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda v: v.cast("string")), ";")


def _blank(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*EMPTY_WORDS)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, also where a lambda reads it for every element."""
    return F.transform(F.array(value), use)[0]


def _as_map(pairs: Column) -> Column:
    """Map of (key, value) structs; unparsable keys are skipped and the last repeat wins."""
    key = lambda e: e["key"]

    def last(p: Column, keys: Column) -> Column:
        return F.filter(p, lambda e, i: e["key"].isNotNull() & (F.size(p) - F.array_position(keys, e["key"]) == i))

    return F.map_from_entries(_once(pairs, lambda p: _once(F.reverse(F.transform(p, key)), lambda keys: last(p, keys))))


def decode_count_map(text: Column) -> Column:
    """``{"7":2}`` -> ``MAP<BIGINT,INT>``; blank or malformed text is an empty map."""
    raw = F.from_json(F.when(~_blank(text), text), "map<string,int>")
    pairs = F.transform(
        F.map_entries(F.coalesce(raw, F.from_json(F.lit("{}"), "map<string,int>"))),
        lambda e: F.struct(e["key"].try_cast("bigint").alias("key"), e["value"].alias("value")),
    )
    return _as_map(pairs)


def decode_site_map(text: Column) -> Column:
    """``{"7":[1,2]}`` or ``{"7":2}`` (sites 0..1) -> ``MAP<BIGINT,ARRAY<INT>>``."""
    as_text = F.coalesce(
        F.from_json(F.when(~_blank(text), text), "map<string,string>"),
        F.from_json(F.lit("{}"), "map<string,string>"),
    )

    def sites(v: Column) -> Column:
        listed = F.from_json(v, "array<int>")

        def either(n: Column) -> Column:
            counted = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
            return F.when(n.isNotNull(), counted).otherwise(listed)

        return _once(v.try_cast("int"), either)

    pairs = F.transform(
        F.map_entries(as_text),
        lambda e: F.struct(e["key"].try_cast("bigint").alias("key"), sites(e["value"]).alias("value")),
    )
    return _as_map(pairs)


def encode_map(values: Column) -> Column:
    """Map to JSON text with keys in order."""
    entries = F.array_sort(F.map_entries(values))
    return F.to_json(
        F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["key"].cast("string"), e["value"]))
        )
    )
