"""Correlation, variance inflation, principal components and count tests."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.tails import chi2_sf
from pairlab.operators.spread import ROWS, attach, per_key, running_fold, settle


def corr_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlations of complete rows, long: (by..., var_i, var_j, r). One pass."""
    rows = df.dropna(subset=list(cols))
    pairs = list(combinations(cols, 2))
    wide = rows.groupBy(*by).agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [(c, c, F.lit(1.0)) for c in cols]
    for i, (a, b) in enumerate(pairs):
        cells += [(a, b, F.col(f"_{i}")), (b, a, F.col(f"_{i}"))]
    long = F.array(*[
        F.struct(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"), r.alias("r")) for a, b, r in cells
    ])
    return wide.select(*by, F.explode(long).alias("_c")).select(*by, "_c.*")


def _corr_array(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    place = {c: i for i, c in enumerate(cols)}
    out = np.eye(len(cols))
    for row in corr_matrix(df, cols).collect():
        out[place[row.var_i], place[row.var_j]] = np.nan if row.r is None else row.r
    return out


def vif(df: DataFrame, cols: Sequence[str], blocks: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Variance inflation per term.

    `blocks` groups the dummy columns of one factor into a term; the value is then the
    generalised det(R11) det(R22) / det(R), and `scaled` its 1/(2 df) power.
    """
    blocks = blocks or {c: [c] for c in cols}
    order = [c for members in blocks.values() for c in members]
    at = {c: i for i, c in enumerate(order)}
    return generalised_vif(df.sparkSession, _corr_array(df, order), {t: [at[c] for c in m] for t, m in blocks.items()})


def generalised_vif(spark, r: np.ndarray, blocks: dict[str, Sequence[int]]) -> DataFrame:
    """det(R11) det(R22) / det(R) per block of places in a correlation matrix; NULL where the matrix is singular."""

    def log_det(m: np.ndarray) -> float:  # many dummies underflow a determinant
        sign, value = np.linalg.slogdet(m)
        return value if sign > 0 else np.nan

    out = []
    whole = log_det(r)
    for term, places in blocks.items():
        inside = np.isin(np.arange(len(r)), places)
        value = np.exp(log_det(r[np.ix_(inside, inside)]) + log_det(r[np.ix_(~inside, ~inside)]) - whole)
        known = bool(np.isfinite(value))
        out.append((term, len(places), float(value) if known else None, float(value ** (0.5 / len(places))) if known else None))
    return spark.createDataFrame(out, "term string, df int, vif double, scaled double")


class Pca:
    """Principal components of standardised columns, from their correlation matrix."""

    def __init__(self, df: DataFrame, cols: Sequence[str], k: int | None = None):
        self.cols = list(cols)
        complete = df.dropna(subset=self.cols)
        stats = complete.agg(
            *[f(c).alias(f"{n}{i}") for i, c in enumerate(self.cols)
              for n, f in (("m", F.avg), ("s", F.stddev_samp))]
        ).first()
        self.mean = [stats[f"m{i}"] for i in range(len(self.cols))]
        self.sd = [stats[f"s{i}"] for i in range(len(self.cols))]
        values, vectors = np.linalg.eigh(_corr_array(df, self.cols))
        keep = np.argsort(values)[::-1][: k or len(self.cols)]
        self.values = values[keep]
        vectors = vectors[:, keep]
        # sign: the first of the largest loadings of each component is positive
        size = np.abs(vectors)
        lead = (size > size.max(axis=0) - 1e-9).argmax(axis=0)
        self.vectors = vectors * np.sign(vectors[lead, range(vectors.shape[1])])
        self._spark = df.sparkSession

    def loadings(self) -> DataFrame:
        """(component, variable, loading, sd, share of variance)."""
        rows = [
            (f"PC{j + 1}", c, float(self.vectors[i, j]), float(np.sqrt(max(self.values[j], 0.0))),
             float(self.values[j] / len(self.cols)))
            for j in range(len(self.values)) for i, c in enumerate(self.cols)
        ]
        return self._spark.createDataFrame(
            rows, "component string, variable string, loading double, sd double, share double"
        )

    def with_scores(self, df: DataFrame) -> DataFrame:
        """Add PC1..PCk; NULL on rows with a missing input."""
        scaled = [
            F.try_divide(F.col(c) - F.lit(m), F.lit(s))
            for c, m, s in zip(self.cols, self.mean, self.sd)
        ]
        return df.withColumns({
            f"PC{j + 1}": sum((z * F.lit(float(v)) for z, v in zip(scaled, self.vectors[:, j])), F.lit(0.0))
            for j in range(len(self.values))
        })


def pca(df: DataFrame, cols: Sequence[str], k: int | None = None) -> Pca:
    return Pca(df, cols, k)


def chi_square(df: DataFrame, a: str, b: str, correct: bool = True) -> DataFrame:
    """Pearson test of independence: (n, levels_a, levels_b, statistic, df, p_value).

    Empty cells are covered by sum(o^2/e) - n, so the full grid is never built. A 2 by 2
    table is continuity-corrected unless `correct=False`.
    """
    cells = settle(df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("_o")))
    rows = per_key(cells, [a], F.sum("_o").alias("_ra"))
    cols = per_key(cells, [b], F.sum("_o").alias("_cb"))
    full = attach(attach(cells, rows, [a], few=True), cols, [b], few=True)
    # for 2 by 2 every cell is off by the same |d|; sum of 1/e is n^3 / product of margins
    parts = full.agg(
        F.sum("_o").alias("n"),
        F.sum(F.col("_o") * F.col("_o") / (F.col("_ra") * F.col("_cb"))).alias("_q"),
        F.max(F.struct(F.col("_o"), F.col("_ra"), F.col("_cb"))).alias("_cell"),
        F.count(F.lit(1)).alias("_cells"),
    )
    one = (
        parts
        .withColumn("levels_a", rows.agg(F.count(F.lit(1))).scalar())
        .withColumn("levels_b", cols.agg(F.count(F.lit(1))).scalar())
    )
    n = F.col("n").cast("double")
    ra, cb = F.col("_cell._ra").cast("double"), F.col("_cell._cb").cast("double")
    plain = n * (F.col("_q") - 1.0)
    d = F.abs(F.col("_cell._o") - ra * cb / n)
    inverse = n * n * n / (ra * (n - ra) * cb * (n - cb))
    yates = F.pow(d - F.least(F.lit(0.5), d), 2) * inverse
    two = (F.col("levels_a") == 2) & (F.col("levels_b") == 2)
    statistic = F.when(two, yates).otherwise(plain) if correct else plain
    out = one.withColumn("statistic", statistic).withColumn(
        "df", ((F.col("levels_a") - 1) * (F.col("levels_b") - 1)).cast("int")
    )
    return out.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("df"))).select(
        "n", "levels_a", "levels_b", "statistic", "df", "p_value"
    )


def proportion_statistic(hits: Column, total: Column, p0: Column) -> Column:
    """Continuity-corrected one-sample statistic, 1 degree of freedom."""
    d = F.abs(hits - total * p0)
    return F.try_divide(F.pow(d - F.least(F.lit(0.5), d), 2), total * p0 * (1 - p0))


def proportion_test(df: DataFrame, by: Sequence[str], flag: str, p0: float | None = None) -> DataFrame:
    """Each key's share of flagged rows against `p0` (default: the share over all rows)."""
    groups = settle(
        df.groupBy(*by).agg(F.sum(flag).alias("hits"), F.count(F.lit(1)).alias("total"))
    )
    against = F.lit(p0)
    if p0 is None:
        against = groups.agg(F.sum("hits") / F.sum("total")).scalar()
    tested = groups.withColumns({"share": F.col("hits") / F.col("total"), "p0": against})
    tested = tested.withColumn(
        "statistic", proportion_statistic(F.col("hits"), F.col("total"), F.col("p0"))
    )
    return tested.withColumn("p_value", chi2_sf(F.col("statistic"), F.lit(1)))


def adjust_bh(df: DataFrame, p: str, family: Sequence[str] = (), out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg adjusted p per family; NULL p stays NULL and does not count."""
    family = list(family)
    df = settle(df)
    ranked = running_fold(
        df, family, [F.col(p).asc_nulls_last()], F.col(p).isNotNull().cast("bigint"), "_rank"
    )
    totals = df.groupBy(*family).agg(F.count(p).alias("_tests"), F.count(F.lit(1)).alias(ROWS))
    if family:
        ranked = attach(ranked, totals, family, few=True)
    else:
        ranked = ranked.withColumn("_tests", totals.select("_tests").scalar())
    candidate = F.col("_tests") / F.col("_rank") * F.col(p)
    best = running_fold(
        ranked, family, [F.col("_rank").desc()], candidate, "_best", fold=F.min
    )
    adjusted = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("_best")))
    return best.withColumn(out, adjusted).drop("_rank", "_tests", "_best")
