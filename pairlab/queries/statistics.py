"""Correlation, inflation, components and tests (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions.tails import chi2_sf, normal_p
from pairlab.operators import inference as t
from pairlab.operators import regression as reg
from pairlab.operators.design import Factor
from pairlab.plans.standin import measured, pairs
from pairlab.queries.base import OBS, PAIRS, erfc, more, query, r, rnd, rounded

_COLS = ["mass", "size_a", "disc", "tax"]
_COMPLETE = "full_rows AS (SELECT * FROM measured WHERE mass IS NOT NULL AND size_a IS NOT NULL)"


def _corr_sql(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    parts = [
        f"SELECT {lead}'{a}' AS var_i, '{b}' AS var_j, "
        + (r(f"corr({a}, {b})") if a != b else "max(CAST(1.0 AS DOUBLE))") + f" AS r FROM full_rows {group}"
        for a in _COLS for b in _COLS
    ]
    return more(OBS, _COMPLETE) + " UNION ALL ".join(parts)


@query("T1_correlations", _corr_sql())
def correlations(spark, folder):
    return rounded(t.corr_matrix(measured(spark, folder), _COLS), ["r"])


@query("T1_correlations_by_kind", _corr_sql("kind"))
def correlations_by_kind(spark, folder):
    return rounded(t.corr_matrix(measured(spark, folder), _COLS, ["kind"]), ["r"])


@query("T2_variance_inflation", more(OBS, _COMPLETE, """
c AS (SELECT corr(mass, size_a) AS ab, corr(mass, adj) AS ac, corr(size_a, adj) AS bc FROM full_rows),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)""") + f"""
SELECT 'mass' AS term, CAST(1 AS INTEGER) AS df, {r('(1 - bc * bc) / det')} AS vif, {r('sqrt((1 - bc * bc) / det)')} AS scaled FROM d
UNION ALL SELECT 'size_a', 1, {r('(1 - ac * ac) / det')}, {r('sqrt((1 - ac * ac) / det)')} FROM d
UNION ALL SELECT 'adj', 1, {r('(1 - ab * ab) / det')}, {r('sqrt((1 - ab * ab) / det)')} FROM d""")
def inflation(spark, folder):
    return rounded(t.vif(measured(spark, folder), ["mass", "size_a", "adj"]), ["vif", "scaled"])


@query("T2_inflation_with_factor", more(OBS, """
g AS (SELECT period, count(*) AS n, avg(size_a) AS m FROM measured WHERE mass IS NOT NULL AND size_a IS NOT NULL GROUP BY period),
a AS (SELECT sum(n * (m - mean) * (m - mean)) AS between_, any_value(total) AS total, count(*) - 1 AS k
      FROM g, (SELECT avg(size_a) AS mean, var_pop(size_a) * count(*) AS total
               FROM measured WHERE mass IS NOT NULL AND size_a IS NOT NULL))""") + f"""
SELECT 'size_a' AS term, CAST(1 AS INTEGER) AS df, {r('total / (total - between_)')} AS vif,
  {r('sqrt(total / (total - between_))')} AS scaled FROM a
UNION ALL SELECT 'period', CAST(k AS INTEGER), {r('total / (total - between_)')}, {r('pow(total / (total - between_), 0.5 / k)')} FROM a""")
def inflation_with_factor(spark, folder):
    rows = measured(spark, folder)
    fit = reg.fit_lm(rows, "mass", ["size_a", Factor("period")])
    return rounded(reg.vif_of(rows, fit), ["vif", "scaled"])


_PCA = more(OBS, _COMPLETE, """
s AS (SELECT corr(mass, size_a) AS r, avg(mass) AS ma, stddev_samp(mass) AS sa,
             avg(size_a) AS mb, stddev_samp(size_a) AS sb FROM full_rows)""")


@query("T3_pca_loadings", _PCA + f"""
SELECT component, variable, {r('loading')} AS loading, {r('sqrt(v)')} AS sd, {r('v / 2')} AS share FROM (
  SELECT 'PC1' AS component, 'mass' AS variable, sqrt(0.5) AS loading, 1 + abs(r) AS v FROM s
  UNION ALL SELECT 'PC1', 'size_a', sign(r) * sqrt(0.5), 1 + abs(r) FROM s
  UNION ALL SELECT 'PC2', 'mass', sqrt(0.5), 1 - abs(r) FROM s
  UNION ALL SELECT 'PC2', 'size_a', -sign(r) * sqrt(0.5), 1 - abs(r) FROM s)""")
def pca_loadings(spark, folder):
    out = t.pca(measured(spark, folder), ["mass", "size_a"]).loadings()
    return rounded(out, ["loading", "sd", "share"])


@query("T3_pca_scores", _PCA + f"""
SELECT grp, line, ind, {r('((mass - ma) / sa + sign(r) * (size_a - mb) / sb) * sqrt(0.5)')} AS "PC1"
FROM measured, s""")
def pca_scores(spark, folder):
    df = measured(spark, folder)
    scored = t.pca(df, ["mass", "size_a"], k=1).with_scores(df)
    return rounded(scored.select("grp", "line", "ind", "PC1"), ["PC1"])


def _chi_sql(a: str, b: str, base: str, table: str, correct: bool) -> str:
    d = "abs(o - e)"
    piece = f"pow({d} - least(0.5, {d}), 2) / e" if correct else "pow(o - e, 2) / e"
    return more(base, f"""
cells AS (SELECT x.a, y.b, (SELECT count(*) FROM {table} t WHERE t.{a} = x.a AND t.{b} = y.b) AS o,
  x.n * y.n / CAST((SELECT count(*) FROM {table}) AS DOUBLE) AS e
  FROM (SELECT {a} AS a, count(*) AS n FROM {table} GROUP BY {a}) x,
       (SELECT {b} AS b, count(*) AS n FROM {table} GROUP BY {b}) y)""") + f"""
SELECT CAST(sum(o) AS BIGINT) AS n, count(DISTINCT a) AS levels_a, count(DISTINCT b) AS levels_b,
  {r(f'sum({piece})')} AS statistic,
  CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS INTEGER) AS df FROM cells"""


@query("T4_chi_square", _chi_sql("period", "mixed", PAIRS, "pairs", False))
def chi_square(spark, folder):
    out = t.chi_square(pairs(spark, folder), "period", "mixed")
    return rounded(out.drop("p_value"), ["statistic"])


@query("T4_chi_square_two_by_two", _chi_sql("kind_f", "mixed", PAIRS, "pairs", True))
def chi_square_two(spark, folder):
    out = t.chi_square(pairs(spark, folder), "kind_f", "mixed")
    return rounded(out.drop("p_value"), ["statistic"])


_SIX = "exp(-q / 2) * (1 + q / 2 + q * q / 8)"


@query("T4_chi_square_p", _chi_sql("period", "mixed", PAIRS, "pairs", False).replace(
    "\nSELECT CAST", ", test AS (SELECT CAST") + f""")
SELECT n, levels_a, levels_b, statistic, df, {r(_SIX, 5)} AS p_value FROM (SELECT *, statistic AS q FROM test)
WHERE df = 6""")
def chi_square_p(spark, folder):
    return rounded(t.chi_square(pairs(spark, folder), "period", "mixed"), {"statistic": 6, "p_value": 5})


_PROP = more(PAIRS, """
by_period AS (SELECT period, sum(mixed)::BIGINT AS hits, count(*) AS total,
  (SELECT avg(mixed) FROM pairs) AS p0 FROM pairs GROUP BY period),
tested AS (SELECT *, abs(hits - total * p0) AS d FROM by_period)""")


@query("T5_proportion_test", _PROP + f"""
SELECT period, hits, total, {r('hits / total')} AS share, {r('p0')} AS p0,
  {r('pow(d - least(0.5, d), 2) / (total * p0 * (1 - p0))')} AS statistic FROM tested""")
def proportion_test(spark, folder):
    out = t.proportion_test(pairs(spark, folder), ["period"], "mixed")
    return rounded(out.drop("p_value"), ["share", "p0", "statistic"])


# Tails of whole-number degrees of freedom 2 and 4 have closed forms DuckDB can compute.
@query("T6_tails", PAIRS + f"""
SELECT period, {r('exp(-q / 2)')} AS p_df2, {r('exp(-q / 2) * (1 + q / 2)')} AS p_df4
FROM (SELECT period, 12.0 * avg(mixed) AS q FROM pairs GROUP BY period)""")
def tails(spark, folder):
    q = pairs(spark, folder).groupBy("period").agg((12.0 * F.avg("mixed")).alias("q"))
    return q.select(
        "period", rnd(chi2_sf(F.col("q"), F.lit(2))).alias("p_df2"),
        rnd(chi2_sf(F.col("q"), F.lit(4))).alias("p_df4"),
    )


@query("T6_normal_tail", PAIRS + f"""
SELECT period, {r(erfc('4.0 * avg(mixed) / sqrt(2)'))} AS p FROM pairs GROUP BY period""")
def normal_tail(spark, folder):
    z = pairs(spark, folder).groupBy("period").agg((4.0 * F.avg("mixed")).alias("z"))
    return z.select("period", rnd(normal_p(F.col("z"))).alias("p"))
