"""Reading and writing observation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.columns import drop_containing, drop_flagged

# Column names.
MEASURES = ("patch_h", "patch_b", "tail", "tarsus", "wing", "mass", "beak")

# Columns of the two published table layouts (fixed values).
V1_COLUMNS = (
    "ring_nb", "yearAreaBox", "year", "nestbox", "species", "sex", "age_category",
    "patch_h", "patch_b", "tail", "tarsus", "wing", "mass", "beak",
    "sum_of_white_on_primaries", "fledge_nb",
)
V2_COLUMNS = (
    "X", "ring_nb", "yearAreaBox", "year", "nestbox", "species", "sex",
    "age_category_corrected", "patch_h", "patch_b", "tail", "tarsus", "wing", "mass",
    "beak", "sum_of_white_on_primaries", "measurer", "early", "laying_date",
    "day_real_hatch", "hq", "habitat_quality", "fledge_nb_new", "recruitnb_new",
    "total_mass_d12_new", "mean_mass_d12_new", "predation", "predation_date", "nb_eggs",
    "experiment",
)
# Column names.
V2_UNUSED = (
    "X", "recruitnb_new", "total_mass_d12_new", "mean_mass_d12_new", "fledge_nb_new",
    "predation", "predation_date", "nb_eggs", "experiment",
)


def text_schema(columns: Sequence[str]) -> T.StructType:
    """Every column as text; numbers are parsed later with `to_double`."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_observations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header. `NA` and blank fields are NULL, and NaN numbers become NULL."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "NA")
        .option("enforceSchema", False)
        .csv(path)
    )
    clean = []
    for field in schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = F.when(F.trim(c) != "", c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        clean.append(c.alias(field.name.replace(".", "_")))
    return df.select(*clean)


def to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to number; what does not parse (and NaN) is NULL."""
    parsed = {c: F.col(c).try_cast("double") for c in cols}
    return df.withColumns({c: F.when(~F.isnan(v), v) for c, v in parsed.items()})


def normalize(
    df: DataFrame,
    version: str,
    keep_observer: bool = False,
    site_filters: bool = True,
    renames: Mapping[str, str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One layout for both table versions.

    Version 2 loses its unused columns but those to `keep` (and the observer unless asked for), the rows
    whose site code contains `AVI` and the rows flagged early. Missing columns are
    skipped, so a table that already went through here passes unchanged.
    """
    if version not in ("v1", "v2"):
        raise ValueError(f"unknown table version {version!r}")
    if version == "v2":
        unused = V2_UNUSED if keep_observer else (*V2_UNUSED, "measurer")
        df = df.drop(*[c for c in unused if c not in keep])
        if site_filters:
            df = drop_containing(df, "nestbox", "AVI")
            if "early" in df.columns:
                df = drop_flagged(df, F.col("early").try_cast("int") == 1)
        df = df.drop("early")
        renames = {"age_category_corrected": "age_category", **(renames or {})}
    return df.withColumnsRenamed(dict(renames or {}))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def save(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write parquet. With partition columns, rows are routed so each folder gets few files.

    `rebalance` lets adaptive execution split a folder that holds most rows.
    """
    writer = df
    if partition_by:
        writer = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
