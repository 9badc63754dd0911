"""Tables behind charts: bins, boxes, bars, lines, cells. All are aggregates of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.columns import inv_logit
from pairlab.functions.tails import normal_quantile
from pairlab.operators.regression import Z95, fit_long
from pairlab.operators.spread import (
    attach_few, exact_quantiles, kept, select_quantiles, settle,
)
from pairlab.operators.summary import share_by, share_within


def _range_of(df: DataFrame, col: str) -> tuple[Column, Column]:
    """Smallest and largest value as one scalar subquery each."""
    ends = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")))
    both = ends.scalar()
    return both.getField("lo"), both.getField("hi")


def _bin(col: str, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the largest value falls into the last bin."""
    width = (high - low) / F.lit(float(bins))
    place = F.floor(F.try_divide(F.col(col).cast("double") - low, width)).cast("int")
    return F.when(F.col(col).isNotNull(), F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)))


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins over the common range: (by..., bin, low, high, n)."""
    low, high = _range_of(df, col)
    counts = (
        df.filter(F.col(col).isNotNull())
        .select(*by, _bin(col, low, high, bins).alias("bin"))
        .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    width = (high - low) / F.lit(float(bins))
    return counts.select(
        *by, "bin", (low + F.col("bin") * width).alias("low"),
        (low + (F.col("bin") + 1) * width).alias("high"), "n",
    )


def mirror_histogram(
    df: DataFrame, col: str, width: float, side: str, down: str, flag: str
) -> DataFrame:
    """Fixed-width counts per side, `down` counted negative, with the flagged part next to all."""
    sign = F.when(F.col(side) == down, -1).otherwise(1)
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(side, (F.floor(F.col(col) / F.lit(width)) * F.lit(width)).cast("double").alias("low"))
        .agg(
            F.sum(sign).alias("n_signed"),
            F.sum(F.when(F.col(flag) == 1, sign).otherwise(0)).alias("n_flagged_signed"),
        )
    )


def box_stats(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and the number of points beyond them, per key.

    The rows are evaluated once, and passed over for the quartiles and for what lies beyond the fences.
    """
    with kept(df.select(*by, F.col(col).cast("double").alias("_v")).dropna(subset=["_v"])) as rows:
        quartiles = select_quantiles(rows, by, [0.25, 0.5, 0.75], "_q").select(
            *by, F.col("n").alias("_rows"), "n",
            *[F.col("_q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))],
        )
        values = attach_few(rows, quartiles, by)
        reach = 1.5 * (F.col("q3") - F.col("q1"))
        inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
        return settle(values.groupBy(*by).agg(
            *[F.max(c).alias(c) for c in ("n", "q1", "median", "q3")],
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(1)).alias("n_outliers"),
        ))


def density_table(df: DataFrame, col: str, by: Sequence[str], bins: int) -> DataFrame:
    """Histogram with each bin's share of its key and the share per unit of `col`."""
    shares = share_within(histogram(df, col, bins, by), by)
    return shares.withColumn("density", F.try_divide("share", F.col("high") - F.col("low")))


def bar_counts(df: DataFrame, x: str, fill: str, facet: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*facet, x, fill).agg(F.count(F.lit(1)).alias("n"))


def bar_shares(df: DataFrame, x: str, fill: str, facet: Sequence[str] = ()) -> DataFrame:
    """Bars filled to 1: share of each fill level within its bar."""
    return share_within(bar_counts(df, x, fill, facet), [*facet, x])


def line_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares line per key from one aggregate."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
    )


def logistic_curve(df: DataFrame, x: str, y: str, by: str, steps: int = 80) -> DataFrame:
    """Logistic fit per level of `by` on an even grid over that level's range, with a 95 % band.

    All levels, however many, are fitted in shared passes. A level without a fit (no variation, or no convergence)
    has a grid without predictions.
    """
    long = df.dropna(subset=[x, y, by]).select(
        F.col(by).alias("spec"), F.lit("binomial").alias("family"),
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
    )
    with kept(long) as rows:
        state = fit_long(rows)
    names = {"lo": "_lo", "hi": "_hi", "m": "_m", "s": "_s", "b0": "_a", "b1": "_b", "v00": "_va", "v01": "_vab", "v11": "_vb"}
    fitted = state.select(F.col("spec").alias(by), *[F.col(c).alias(n) for c, n in names.items()])
    place = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    grid = fitted.withColumn("_k", place).withColumn(
        x, F.col("_lo") + F.col("_k") * (F.col("_hi") - F.col("_lo")) / F.lit(steps - 1)
    )
    z = (F.col(x) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))
    eta = F.col("_a") + F.col("_b") * z
    se = F.sqrt(F.greatest(F.col("_va") + 2 * F.col("_vab") * z + F.col("_vb") * z * z, F.lit(0.0)))
    half = F.lit(Z95) * se
    return grid.select(
        by, x, inv_logit(eta).alias("predicted"), se.alias("se_link"),
        inv_logit(eta - half).alias("low"), inv_logit(eta + half).alias("high"),
    )


def qq_table(df: DataFrame, col: str, points: int = 50) -> DataFrame:
    """Sample quantiles next to normal ones at `points` even probabilities.

    `line` is the reference line through the quartiles of both.
    """
    probs = [(i + 0.5) / points for i in range(points)]
    sample = exact_quantiles(df, [], col, [*probs, 0.25, 0.75], "_q")
    pairs = F.array(*[
        F.struct(F.lit(p).alias("p"), F.col("_q")[i].alias("sample")) for i, p in enumerate(probs)
    ])
    low, high = F.col("_q")[points], F.col("_q")[points + 1]
    quartile = 0.6744897501960817
    rows = sample.select(
        F.explode(pairs).alias("_s"),
        ((high - low) / (2 * quartile)).alias("_slope"), ((high + low) / 2).alias("_middle"),
    )
    return rows.select(
        F.col("_s.p").alias("p"), normal_quantile(F.col("_s.p")).alias("theoretical"),
        F.col("_s.sample").alias("sample"), "_slope", "_middle",
    ).withColumn("line", F.col("_middle") + F.col("_slope") * F.col("theoretical")).drop("_slope", "_middle")


def period_series(df: DataFrame, period: str, by: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """One row per period and key with the given aggregates."""
    return df.groupBy(period, *by).agg(*[c.alias(name) for name, c in aggs.items()])


def count_and_share_series(df: DataFrame, period: str, flag: str, factor: float) -> DataFrame:
    """Flagged count per period with the share rescaled for a second axis."""
    series = share_by(df, [period], flag)
    return series.withColumn("share_scaled", F.col("share") * F.lit(float(factor)))


def scatter_cells(
    df: DataFrame, x: str, y: str, nx: int, ny: int, by: Sequence[str] = ()
) -> DataFrame:
    """Points per cell of an nx by ny grid over the common range."""
    rows = df.dropna(subset=[x, y])
    xlow, xhigh = _range_of(rows, x)
    ylow, yhigh = _range_of(rows, y)
    cells = rows.select(
        *by, _bin(x, xlow, xhigh, nx).alias("x_bin"), _bin(y, ylow, yhigh, ny).alias("y_bin")
    )
    return cells.groupBy(*by, "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def scatter_sample(df: DataFrame, keys: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """A repeatable share of the points: a row is in by the hash of its key columns and the seed."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.filter(place < F.lit(int(share * 2**32)))


def pair_cells(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """Cell counts for every pair of columns, one row copy per pair of (few) columns."""
    ends = df.agg(
        *[f(c).cast("double").alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    )
    bounds = ends.select(F.struct(*ends.columns)).scalar()
    place = {
        c: _bin(c, bounds.getField(f"lo_{c}"), bounds.getField(f"hi_{c}"), bins) for c in cols
    }
    binned = df.select(*[place[c].alias(c) for c in cols])
    pairs = F.array(*[
        F.struct(
            F.lit(a).alias("x_name"), F.lit(b).alias("y_name"),
            F.col(a).alias("x_bin"), F.col(b).alias("y_bin"),
        )
        for a, b in combinations(cols, 2)
    ])
    long = binned.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return (
        long.select(F.explode(pairs).alias("_p"), "_n").select("_p.*", "_n")
        .dropna(subset=["x_bin", "y_bin"])
        .groupBy("x_name", "y_name", "x_bin", "y_bin").agg(F.sum("_n").alias("n"))
    )


def trajectories(
    df: DataFrame, id_col: str, period: str, value: str, others: Sequence[str] = ()
) -> DataFrame:
    """Points of each individual's line, in individual and period order."""
    return df.select(id_col, period, value, *others).orderBy(id_col, period, *others)
