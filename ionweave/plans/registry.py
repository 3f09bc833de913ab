"""Query registry: each entry is a Spark callable and, where SQL can say it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.session import counted_broadcasts, tune

# Added before rounding on both sides: means of two-decimal readings land exactly on rounding
# ties, where the last bit of a sum decides; the shift moves the ties away from such values.
NUDGE = 3.3e-10


def rounded(value: Column, places: int) -> Column:
    """``F.round`` of a double, which goes through decimal text; whole steps away from a tie are found in plain arithmetic, with the same result."""
    scale = 10.0**places
    steps = value * scale
    sure = (F.abs(steps) < 2.0**40) & (F.abs(steps - F.floor(steps) - 0.5) > 1e-3)
    return F.when(sure, F.floor(steps + 0.5).cast("double") / F.lit(scale)).otherwise(F.round(value, places))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TEXTS: dict[str, tuple[str, tuple[str, ...], dict[str, int]]] = {}

WEEK = "CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7) AS BIGINT)"


def _spot(e: str, a: int, b: int) -> str:
    return f"CAST(({e} * {a} + frame * {b}) % 2000 AS DOUBLE) / CAST(100 AS DOUBLE)"


_S = "SELECT frame, center_id"
CTES: dict[str, str] = {
    "contacts": f"""SELECT {WEEK} AS frame, l_suppkey AS center_id,
 CASE WHEN l_returnflag = 'N' THEN 'anion' ELSE 'polymer' END AS ligand_kind,
 CASE WHEN l_returnflag = 'N' THEN l_suppkey // 2 + l_partkey % 3 ELSE l_suppkey // 4 + l_partkey % 2 END AS ligand_id,
 CAST(p_size AS BIGINT) AS site_index,
 min(CAST(1.5 AS DOUBLE) + CAST((l_partkey * 31 + l_orderkey * 17) % 250 AS DOUBLE) / CAST(100 AS DOUBLE)) AS distance
 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4, 5""",
    "frames": f"SELECT unnest(range(min({WEEK}), max({WEEK}) + 1)) AS frame FROM lineitem",
    "bounds": "SELECT min(frame) AS f0, max(frame) AS f1, count(*) AS nf FROM frames",
    "grid": "SELECT frame, s_suppkey AS center_id FROM frames CROSS JOIN supplier",
    "chains": """SELECT frame, chain_id FROM frames CROSS JOIN
 (SELECT DISTINCT s_suppkey // 4 + o AS chain_id FROM supplier CROSS JOIN (SELECT unnest([0, 1]) AS o))""",
    "lig": """SELECT frame, center_id, ligand_kind, ligand_id, count(*) AS denticity,
 min(distance) AS min_distance, avg(distance) AS mean_distance FROM contacts GROUP BY 1, 2, 3, 4""",
    "numbers": """SELECT g.frame, g.center_id,
 CAST(coalesce(sum(denticity) FILTER (ligand_kind = 'polymer'), 0) AS BIGINT) AS n_site,
 count(*) FILTER (ligand_kind = 'polymer') AS n_chain,
 CAST(coalesce(sum(denticity) FILTER (ligand_kind = 'anion'), 0) AS BIGINT) AS n_anion_site,
 count(*) FILTER (ligand_kind = 'anion') AS n_anion,
 CAST(coalesce(sum(denticity), 0) AS BIGINT) AS n_total
 FROM grid g LEFT JOIN lig l ON g.frame = l.frame AND g.center_id = l.center_id GROUP BY 1, 2""",
    "states": """SELECT *, CASE WHEN n_site > 0 AND n_anion > 0 THEN 'PT' WHEN n_site > 0 THEN 'P'
 WHEN n_anion > 0 THEN 'T' ELSE 'F' END AS state FROM numbers""",
    "blocks": "SELECT frame, ntile(5) OVER (ORDER BY frame) AS block FROM frames",
    "edges": "SELECT DISTINCT frame, center_id, ligand_id AS anion_id FROM contacts WHERE ligand_kind = 'anion'",
    "pairs": f"""SELECT frame, center_id, ligand_id AS anion_id, count(*) AS n_sites, min(distance) AS min_distance,
 avg(distance) AS mean_distance, {_spot('center_id', 7919, 104729)} AS cx, {_spot('center_id', 6101, 15485863)} AS cy,
 {_spot('center_id', 3571, 49979687)} AS cz, {_spot('ligand_id', 7907, 104723)} AS ax,
 {_spot('ligand_id', 6089, 15485857)} AS ay, {_spot('ligand_id', 3559, 49979681)} AS az, CAST(20 AS DOUBLE) AS box
 FROM contacts WHERE ligand_kind = 'anion' GROUP BY frame, center_id, ligand_id""",
    "track": """SELECT CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS BIGINT) AS frame, user_id AS entity_id,
 CASE user_id % 3 WHEN 0 THEN 'metal' WHEN 1 THEN 'cation' ELSE 'anion' END AS species,
 value % CAST(20 AS DOUBLE) AS x, CAST((event_id * 7919) % 2000 AS DOUBLE) / CAST(100 AS DOUBLE) AS y,
 CAST((event_id * 104729) % 2000 AS DOUBLE) / CAST(100 AS DOUBLE) AS z, CAST(20 AS DOUBLE) AS box FROM events""",
    "sites": """SELECT vec_id % 5 AS frame, vec_id AS site_id,
 CASE WHEN label < 3 THEN 'center' WHEN label < 7 THEN 'polymer' ELSE 'anion' END AS role, vec_id % 40 AS ligand_id,
 CAST(embedding[1] AS DOUBLE) * 30 + 15 AS x, CAST(embedding[2] AS DOUBLE) * 30 + 15 AS y,
 CAST(embedding[3] AS DOUBLE) * 30 + 15 AS z, CAST(30 AS DOUBLE) AS box FROM embeddings""",
}
HEADS: dict[str, str] = {}
NEEDS = {
    "bounds": ["frames"],
    "grid": ["frames"],
    "chains": ["frames"],
    "lig": ["contacts"],
    "numbers": ["grid", "lig"],
    "states": ["numbers"],
    "blocks": ["frames"],
    "edges": ["contacts"],
    "pairs": ["contacts"],
}


def define(name: str, sql: str, *needs: str, head: str = "") -> None:
    """Add a named common table expression for oracle texts; ``head`` names its columns and, if recursive by key, the key."""
    CTES[name] = sql
    HEADS[name] = head
    NEEDS[name] = list(needs)


def with_tables(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named expressions and what they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in NEEDS.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    head = ",\n".join(f"{n}{HEADS.get(n, '')} AS ({CTES[n]})" for n in order)
    kind = "WITH RECURSIVE" if any("UNION" in CTES[n] and f"FROM {n} " in CTES[n] for n in order) else "WITH"
    return f"{kind} {head}\n{sql}"


def register(
    name: str,
    build: Callable[[SparkSession, str], DataFrame],
    sql: str | None = None,
    needs: Sequence[str] = (),
    rounds: Sequence[str] | Mapping[str, int] = (),
    digits: int = 6,
) -> None:
    """Register a query; ``rounds`` lists the double columns both sides round."""
    places = dict(rounds) if isinstance(rounds, Mapping) else {c: digits for c in rounds}

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = build(counted_broadcasts(tune(spark)), sf)
        return df.withColumns({c: rounded(F.col(c) + NUDGE, d) + 0.0 for c, d in places.items()})

    QUERIES[name] = run
    if sql is not None:
        _TEXTS[name] = (sql, tuple(needs), places)


def oracle_texts() -> dict[str, str]:
    """DuckDB text of every query that has one; call after all query modules are imported."""
    out = {}
    for name, (sql, needs, places) in _TEXTS.items():
        text = with_tables(sql, *needs)
        if places:
            swap = ", ".join(f"round({c} + CAST({NUDGE} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in places.items())
            text = f"SELECT * REPLACE ({swap}) FROM (\n{text}\n)"
        out[name] = text
    return out
