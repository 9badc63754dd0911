"""Centring, z-scores and running history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.operators.spread import attach, per_key, running_fold


def zscore(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], prefix: str = "z_",
    centered: str | None = None,
) -> DataFrame:
    """(x - mean) / sample sd within the key; NULL where the sd is 0 or undefined.

    `centered` names a suffix under which x - mean is kept as well.
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    rows = attach(df, per_key(df, by, *aggs), by, few=True)
    out = {}
    for c in cols:
        shifted = F.col(c) - F.col(f"_m_{c}")
        out[prefix + c] = F.try_divide(shifted, F.col(f"_s_{c}"))
        if centered:
            out[c + centered] = shifted
    return rows.withColumns(out).drop(*[f"_{s}_{c}" for c in cols for s in "ms"])


def center(df: DataFrame, by: Sequence[str], col: str, out: str | None = None) -> DataFrame:
    """x minus the mean of its key."""
    rows = attach(df, per_key(df, by, F.avg(col).alias("_mean")), by, few=True)
    return rows.withColumn(out or f"{col}_centered", F.col(col) - F.col("_mean")).drop("_mean")


def prior_total(
    df: DataFrame, id_col: str, order: Sequence[Column | str], flag: str, out: str = "prior"
) -> DataFrame:
    """Running total of the flag over the individual's earlier rows; 0 on its first row.

    `order` needs a tie-break after the period, because one period can hold several rows.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = running_fold(df, [id_col], columns, F.col(flag), out, inclusive=False)
    return rows.withColumn(out, F.coalesce(out, F.lit(0)))
