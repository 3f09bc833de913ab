"""Typed table reads, sinks, selections and the frame clock."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.functions.codecs import decode_count_map, decode_site_map, encode_map
from ionweave.functions.states import nan_to_null

QUOTE = '"'  # fixed value: quotes inside CSV cells are doubled
_L, _D, _S, _I = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


MASTER_SCHEMA = _schema(
    frame=_L, time_ps=_D, center_id=_L, n_site=_L, n_chain=_L, n_anion_site=_L, n_anion=_L,
    n_total=_L, state=_S, site_ids=_S, chain_ids=_S, anion_ids=_S, chain_sites=_S, anion_counts=_S,
)
PAIR_SCHEMA = _schema(
    frame=_L, time_ps=_D, pair_id=_S, pair_instance_id=_S, center_id=_L, anion_id=_L, n_sites=_L,
    min_distance=_D, mean_distance=_D, continuing=_I, new_event=_I, age_frames=_L, age_ps=_D,
    cx=_D, cy=_D, cz=_D, ax=_D, ay=_D, az=_D, box=_D,
)


# Column names of existing master and pair files, and the names used here.
FILE_NAMES = {
    "metal_atom_id": "center_id",
    "metal_id": "center_id",
    "tfsi_resid": "anion_id",
    "n_peo_oxygen": "n_site",
    "n_peo_chains": "n_chain",
    "n_tfsi_oxygen": "n_anion_site",
    "n_tfsi_molecules": "n_anion",
    "total_oxygen_cn": "n_total",
    "coordination_state": "state",
    "peo_oxygen_atom_ids": "site_ids",
    "peo_chain_resids": "chain_ids",
    "tfsi_resids": "anion_ids",
    "peo_chain_eo_mapping": "chain_sites",
    "tfsi_denticity": "anion_counts",
    "n_coordinating_oxygens": "n_sites",
    "min_metal_oxygen_distance_A": "min_distance",
    "mean_metal_oxygen_distance_A": "mean_distance",
    "continuing_pair": "continuing",
    "new_pair_event": "new_event",
    "pair_age_frames": "age_frames",
    "pair_age_ps": "age_ps",
    "metal_x_A": "cx",
    "metal_y_A": "cy",
    "metal_z_A": "cz",
    "tfsi_x_A": "ax",
    "tfsi_y_A": "ay",
    "tfsi_z_A": "az",
    "box_a_A": "box",
}


def with_role_names(df: DataFrame) -> DataFrame:
    """Rename known file columns to role names where the role name is not taken yet."""
    swap = {a: b for a, b in FILE_NAMES.items() if a in df.columns and b not in df.columns}
    return df.withColumnsRenamed(swap)


def contacts_from_master(master: DataFrame) -> DataFrame:
    """Contact rows from the chain-site and anion-count texts of a master table.

    Anion sites have no numbers in the text, so they count from 1; distances are unknown.
    """
    def rows(kind: str, ligands: Column, sites: Callable[[Column], Column]) -> Column:
        each = lambda e: F.struct(F.lit(kind).alias("ligand_kind"), e["key"].alias("ligand_id"), sites(e["value"]).alias("sites"))
        return F.coalesce(F.transform(F.map_entries(ligands), each), F.array())

    counted = lambda n: F.when(n > 0, F.sequence(F.lit(1), n))
    polymer = rows("polymer", decode_site_map(F.col("chain_sites")), lambda s: s)
    anion = rows("anion", decode_count_map(F.col("anion_counts")), counted)
    # Both texts of a row are read in one pass over the table.
    ligands = master.select("frame", "center_id", F.explode(F.concat(polymer, anion)).alias("l"))
    return ligands.select("frame", "center_id", "l.ligand_kind", "l.ligand_id", F.explode("l.sites").alias("site_index")).withColumn(
        "site_index", F.col("site_index").cast("bigint")
    )


def master_texts(contacts: DataFrame) -> DataFrame:
    """The text cells of a master row.  A cell holds one center's shell, as the file format demands."""
    lig = contacts.groupBy("frame", "center_id", "ligand_kind", "ligand_id").agg(
        F.sort_array(F.collect_list("site_index")).alias("sites")
    )
    poly = F.col("ligand_kind") == "polymer"
    rows = lig.groupBy("frame", "center_id").agg(
        F.map_from_entries(F.collect_list(F.when(poly, F.struct("ligand_id", "sites")))).alias("c"),
        F.map_from_entries(F.collect_list(F.when(~poly, F.struct("ligand_id", F.size("sites"))))).alias("a"),
    )
    return rows.select("frame", "center_id", encode_map(F.col("c")).alias("chain_sites"), encode_map(F.col("a")).alias("anion_counts"))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, required: Iterable[str] = (), fmt: str = "parquet"
) -> DataFrame:
    """Read CSV (plain or gzip) or Parquet with an explicit schema; NaN becomes NULL.

    CSV columns are matched by header name, so files may carry more columns than ``schema``.
    Only files written as CSV.gz are unsplittable: convert those once with ``write_tables``.
    """
    if fmt == "csv":
        raw = with_role_names(spark.read.options(header=True, escape=QUOTE).csv(path))
        require_columns(raw, required)
        kept = [f for f in schema.fields if f.name in raw.columns]
        df = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kept])
    else:
        df = with_role_names(spark.read.format(fmt).load(path))
        require_columns(df, required)
        kept = [f for f in schema.fields if f.name in df.columns]
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kept])
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in doubles})


def read_master(spark: SparkSession, path: str, required: Iterable[str] = ("frame", "center_id"), fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, MASTER_SCHEMA, required, fmt)


def read_pairs(spark: SparkSession, path: str, required: Iterable[str] = ("frame", "center_id", "anion_id"), fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, PAIR_SCHEMA, required, fmt)


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", order: str = "frame") -> None:
    """Write each table under ``folder/name``, range-partitioned by frame for pruning."""
    for name, df in tables.items():
        out = df.repartitionByRange(order).sortWithinPartitions(order) if order in df.columns else df
        writer = out.write.mode("overwrite")
        if fmt in ("csv", "csv.gz"):
            writer = writer.options(header=True, escape=QUOTE)
            if fmt == "csv.gz":
                writer = writer.option("compression", "gzip")
            writer.csv(f"{folder}/{name}")
        else:
            writer.format(fmt).save(f"{folder}/{name}")


def select_atoms(atoms: DataFrame, topology: DataFrame, predicate: Column, key: str = "atom_id") -> DataFrame:
    """Rows of the atoms whose topology entry satisfies ``predicate``; an empty selection is an error."""
    chosen = topology.filter(predicate)
    if chosen.limit(1).count() == 0:
        raise ValueError("selection matched no atoms")
    return atoms.join(chosen, key)


def frame_slice(df: DataFrame, start: int = 0, stop: int | None = None, stride: int = 1, frame: str = "frame") -> DataFrame:
    """Frames ``start, start+stride, ...`` before ``stop``; the range test reaches the scan."""
    out = df.filter(F.col(frame) >= start)
    if stop is not None:
        out = out.filter(F.col(frame) < stop)
    return out if stride == 1 else out.filter((F.col(frame) - start) % stride == 0)


def frame_time(df: DataFrame, dt_ps: float, frame: str = "frame", time: str | None = None) -> DataFrame:
    """Adds ``time_ps``: the recorded time where finite, else ``frame * dt``."""
    clock = F.col(frame) * F.lit(float(dt_ps))
    if time is not None:
        t = F.col(time)
        bad = F.isnan(t) | (F.abs(t) == float("inf"))
        clock = F.coalesce(F.when(~bad, t), clock)
    return df.withColumn("time_ps", clock)
