"""Row-wise column expressions and filters with explicit NULL rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inclusive bounds outside which a measure is an error: (low, high), either may be None.
# Bounds of valid measures.
VALID_RANGES = {
    "tarsus": (2, 50),
    "tail": (None, 100),
    "beak": (None, 22),
    "mass": (4, 80),
    "wing": (8, None),
    "sum_of_white_on_primaries": (None, 200),
    "patch_size": (None, 300),
}


def with_product(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(a) * F.col(b))


def with_ratio(df: DataFrame, num: str, den: str, out: str) -> DataFrame:
    """num / den; NULL when the denominator is zero."""
    return df.withColumn(out, F.try_divide(num, den))


def with_scaled(df: DataFrame, col: str, factor: float, out: str) -> DataFrame:
    return df.withColumn(out, F.col(col) * F.lit(factor))


def suffix_columns(df: DataFrame, suffix: str, except_: Sequence[str]) -> DataFrame:
    keep = set(except_)
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns])


def null_out_of_range(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """Values at or beyond a bound become NULL."""
    out = {}
    for col, (low, high) in bounds.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(col) <= low)
        if high is not None:
            bad = bad | (F.col(col) >= high)
        out[col] = F.when(~bad, F.col(col))
    return df.withColumns(out)


def keep_kinds(df: DataFrame, col: str, kinds: Sequence[str]) -> DataFrame:
    return df.filter(F.col(col).isin(*kinds))


def drop_containing(df: DataFrame, col: str, token: str) -> DataFrame:
    """Drop rows whose text contains the token; rows without text stay."""
    return df.filter(~F.coalesce(F.col(col).contains(token), F.lit(False)))


def drop_sentinel(df: DataFrame, col: str, value: str) -> DataFrame:
    """Drop rows holding the sentinel; rows with NULL go too."""
    return df.filter(F.col(col) != value)


def drop_flagged(df: DataFrame, flag: Column) -> DataFrame:
    """Drop rows whose flag is true or unknown."""
    return df.filter(~flag)


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def between_open(col: str, low: float | None, high: float | None) -> Column:
    """low < col < high, either side may be open-ended."""
    condition = F.lit(True)
    if low is not None:
        condition = condition & (F.col(col) > low)
    if high is not None:
        condition = condition & (F.col(col) < high)
    return condition


def fill_label(df: DataFrame, col: str, label: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(label)))


def binarize(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, (F.col(col) > 0).cast("int"))


def with_levels(
    df: DataFrame, col: str, levels: Sequence, labels: Sequence[str] | None = None
) -> DataFrame:
    """Add `<col>_rank` (0-based place in `levels`) and `<col>_label`; unlisted values are NULL."""
    labels = list(labels or levels)
    ranks = F.create_map(*[F.lit(x) for pair in zip(levels, range(len(levels))) for x in pair])
    names = F.create_map(*[F.lit(x) for pair in zip(levels, labels) for x in pair])
    return df.withColumns(
        {f"{col}_rank": F.try_element_at(ranks, F.col(col)),
         f"{col}_label": F.try_element_at(names, F.col(col))}
    )


def interaction_key(*cols: str) -> Column:
    """One text key from several columns; NULL parts are written as `NA`."""
    return F.concat_ws(".", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols])


def percent_label(col: str, digits: int = 0) -> Column:
    return F.when(F.col(col).isNotNull(), F.format_string(f"%.{digits}f%%", F.col(col) * 100.0))


def inv_logit(col: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col))
