"""Observation, pair and level tables derived from the order-line tables.

One order line is one observation: the order is the group, part and supplier together
the individual, line status the role, return flag the kind, shipping year the period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.functions.columns import null_out_of_range
from pairlab.operators.groups import clean_groups, conflicting_ids, touched_groups
from pairlab.operators.pairs import build_pairs
from pairlab.sources.observations import load

SIDES = ("F", "O")
KINDS = ("A", "R")
CONFLICTS = ("role", "kind")
BOUNDS = {"size_a": (None, 46), "mass": (2000, 90000)}
PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "lineitem").filter(F.col("l_returnflag").isin(*KINDS))
    return lines.select(
        F.col("l_orderkey").alias("grp"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("ind"),
        F.col("l_suppkey").alias("ind_hist"),
        F.col("l_linestatus").alias("role"),
        F.col("l_returnflag").alias("kind"),
        F.year("l_shipdate").alias("period"),
        F.col("l_quantity").alias("size_a"),
        F.col("l_extendedprice").alias("mass"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.dayofyear("l_shipdate").alias("day"),
        F.col("l_linenumber").alias("line"),
    )


def measured(spark: SparkSession, folder: str) -> DataFrame:
    """Observations with out-of-range measures set to NULL and the size-adjusted ratio."""
    ranged = null_out_of_range(observations(spark, folder), BOUNDS)
    return ranged.withColumn("adj", F.try_divide("mass", "size_a"))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_groups(measured(spark, folder), "ind", "grp", "kind", CONFLICTS)


def pairs(spark: SparkSession, folder: str, keep_unmatched: bool = False) -> DataFrame:
    rows = measured(spark, folder)
    bad = conflicting_ids(rows, "ind", CONFLICTS)
    excluded = touched_groups(rows, bad, "ind", "grp")
    wide = build_pairs(
        rows, "grp", "role", SIDES, ["grp"], partner_id="ind",
        keep_unmatched=keep_unmatched,
        differs={"mixed": "kind"}, excluded=excluded,
    )
    return wide.withColumnRenamed("period_f", "period")


def with_priority(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Add the order's priority, the stand-in for a level or observer of the group."""
    orders = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("_order"), F.col("o_orderpriority").alias("priority")
    )
    return df.join(orders, F.col("grp") == F.col("_order"), "left").drop("_order")


def paired_second_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Second-side rows of groups of two, with clean measures."""
    return clean(spark, folder).filter((F.col("role") == SIDES[1]) & (F.col("n_rows") == 2))
