"""Counts, rates, means, medians, shares and two-way tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.operators.spread import (
    attach, kept, null_safe_join, per_key, select_quantiles, settle,
)


def count_by(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def repeat_positive_ids(df: DataFrame, id_col: str, flag: str, out: str = "n_flagged") -> DataFrame:
    """Individuals whose flag adds up to more than one."""
    return df.groupBy(id_col).agg(F.sum(flag).alias(out)).filter(F.col(out) > 1)


def repeat_counts(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Keys that occur more than once."""
    return count_by(df, keys, out).filter(F.col(out) > 1)


def share_by(
    df: DataFrame, by: Sequence[str], flag: str,
    hits: str = "hits", total: str = "total", share: str = "share",
) -> DataFrame:
    """Flagged rows, all rows and their ratio per key; an unknown flag counts in the total only."""
    return df.groupBy(*by).agg(
        F.sum(F.when(F.col(flag) == 1, 1).otherwise(0)).alias(hits),
        F.count(F.lit(1)).alias(total),
    ).withColumn(share, F.col(hits) / F.col(total))


def rate_by(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Mean, sum and count of a flag per key."""
    return df.groupBy(*keys).agg(
        F.avg(flag).alias("rate"), F.sum(flag).alias("n_flagged"), F.count(F.lit(1)).alias("n")
    )


def mean_of(df: DataFrame, by: Sequence[str], cols: Sequence[str], prefix: str = "avg_") -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(prefix + c) for c in cols])


def sd_of(df: DataFrame, by: Sequence[str], cols: Sequence[str], prefix: str = "sd_") -> DataFrame:
    """Sample standard deviation; NULL for a single value."""
    return df.groupBy(*by).agg(*[F.stddev_samp(c).alias(prefix + c) for c in cols])


def median_of(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], prefix: str = "median_", approx: bool = False
) -> DataFrame:
    """Median per key and column, NULLs ignored; a key with no value at all gives NULL.

    Exact medians of all keys and columns are found together, by narrowing (`select_quantiles`).
    `approx=True` uses a bounded sketch in one pass instead.
    """
    if approx:
        return df.groupBy(*by).agg(
            *[F.percentile_approx(c, 0.5, 10_000).alias(prefix + c) for c in cols]
        )
    keys = [*by, "_name"]
    with kept(df.select(*by, *cols)) as rows:
        long = rows.select(*by, F.explode(F.array(*[
            F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in cols
        ])).alias("_s")).select(*by, "_s.*")
        middle = select_quantiles(long, keys, [0.5], "_q")
        every = settle(rows.select(*by).distinct())
    wide = middle.groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == c, F.col("_q")[0])).alias(prefix + c) for c in cols]
    )
    return null_safe_join(every, wide, by, "left")


def all_any(df: DataFrame, by: Sequence[str], condition: Column, other: Column) -> DataFrame:
    """Rows, whether `condition` holds on all of them, and whether `other` holds on any."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.every(condition).alias("all_match"),
        F.bool_or(other).alias("any_other"),
    )


def switching_ids(df: DataFrame, id_col: str, period: str, flag: str) -> DataFrame:
    """Individuals with both flag values, and the number of periods they were seen in."""
    by_period = df.groupBy(id_col, period).agg(F.min(flag).alias("_low"), F.max(flag).alias("_high"))
    return (
        by_period.groupBy(id_col)
        .agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.count(F.lit(1)).alias("n_periods"))
        .filter("_low <> _high")
        .select(id_col, F.lit(2).cast("bigint").alias("flag_values"), "n_periods")
    )


def always_positive_ids(df: DataFrame, id_col: str, period: str, flag: str) -> DataFrame:
    """Individuals whose known flags are all 1, with rows and distinct periods."""
    known = df.filter(F.col(flag).isNotNull())
    by_period = known.groupBy(id_col, period).agg(
        F.count(F.lit(1)).alias("_n"), F.every(F.col(flag) == 1).alias("_all")
    )
    return (
        by_period.groupBy(id_col)
        .agg(
            F.sum("_n").alias("n_obs"),
            F.count(F.lit(1)).alias("n_periods"),
            F.every("_all").alias("_all"),
        )
        .filter("_all")
        .drop("_all")
    )


def crosstab(df: DataFrame, a: str, b: str, keep_null: bool = False) -> DataFrame:
    """Two-way counts in long form. NULL categories are dropped unless asked for."""
    rows = df if keep_null else df.dropna(subset=[a, b])
    return count_by(rows, [a, b])


def crosstab_wide(df: DataFrame, a: str, b: str, levels: Sequence) -> DataFrame:
    """Two-way counts with one column per listed level of `b`."""
    rows = df.dropna(subset=[a, b])
    return rows.groupBy(a).agg(
        *[F.sum(F.when(F.col(b) == v, 1).otherwise(0)).alias(f"{b}_{v}") for v in levels]
    )


def share_within(counts: DataFrame, by: Sequence[str], n: str = "n", out: str = "share") -> DataFrame:
    """Each count as a share of its key's total, from an aggregate and a look-up."""
    counts = settle(counts)
    totals = per_key(counts, by, F.sum(n).alias("_total"))
    return (
        attach(counts, totals, by, few=True)
        .withColumn(out, F.col(n) / F.col("_total"))
        .drop("_total")
    )


def crosstab_share(table: DataFrame, margin: str) -> DataFrame:
    """Proportions of a long two-way table within each level of `margin`."""
    return share_within(table, [margin])


def overall_share(df: DataFrame, flag: str, out: str = "share") -> DataFrame:
    return df.agg(F.avg(flag).alias(out))


def first_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """First n rows in order; each task keeps its own n before the merge."""
    return df.orderBy(*order).limit(n)
