"""Chart tables (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import charts as c
from pairlab.operators.spread import null_safe_join
from pairlab.operators.summary import median_of
from pairlab.plans.standin import clean, measured, pairs, with_priority
from pairlab.queries.base import CLEAN, LEVELED, OBS, PAIRS, erfc, more, query, r, rounded
from pairlab.session import cut_lineage

_RANGE = """ends AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t} WHERE {c} IS NOT NULL)"""


def _bin_sql(col: str, bins: int, lo: str = "lo", hi: str = "hi") -> str:
    return f"CAST(least(floor(({col} - {lo}) / (({hi} - {lo}) / {bins}.0)), {bins - 1}) AS INTEGER)"


@query("C1_histogram", more(OBS, _RANGE.format(c="mass", t="measured")) + f"""
SELECT bin, {r('lo + bin * (hi - lo) / 100.0', 3)} AS low, {r('lo + (bin + 1) * (hi - lo) / 100.0', 3)} AS high, n
FROM (SELECT {_bin_sql('mass', 100)} AS bin, count(*) AS n FROM measured, ends WHERE mass IS NOT NULL GROUP BY bin), ends""")
def histogram(spark, folder):
    return rounded(c.histogram(measured(spark, folder), "mass", 100), ["low", "high"], 3)


@query("C1_histogram_by", more(PAIRS, _RANGE.format(c="day_f", t="pairs")) + f"""
SELECT period, kind_f, {_bin_sql('day_f', 20)} AS bin, count(*) AS n FROM pairs, ends
GROUP BY period, kind_f, bin""")
def histogram_by(spark, folder):
    return c.histogram(pairs(spark, folder), "day_f", 20, ["period", "kind_f"]).drop("low", "high")


@query("C2_mirror_histogram", PAIRS + """
SELECT kind_f, CAST(floor(day_f / 2) * 2 AS DOUBLE) AS low,
  CAST(sum(CASE WHEN kind_f = 'R' THEN -1 ELSE 1 END) AS BIGINT) AS n_signed,
  CAST(sum(CASE WHEN mixed = 0 THEN 0 WHEN kind_f = 'R' THEN -1 ELSE 1 END) AS BIGINT) AS n_flagged_signed
FROM pairs GROUP BY kind_f, low""")
def mirror_histogram(spark, folder):
    return c.mirror_histogram(pairs(spark, folder), "day_f", 2.0, "kind_f", "R", "mixed")


_BOX = """
q AS (SELECT {by}, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
             quantile_cont({c}, 0.75) AS q3, count({c}) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {by})"""


@query("C3_box_stats", more(PAIRS, _BOX.format(by="mixed, kind_f", c="adj_m", t="pairs")) + f"""
SELECT mixed, kind_f, any_value(n) AS n, {r('any_value(q1)', 4)} AS q1, {r('any_value(median)', 4)} AS median,
  {r('any_value(q3)', 4)} AS q3,
  {r('min(adj_m) FILTER (inside)', 4)} AS whisker_low, {r('max(adj_m) FILTER (inside)', 4)} AS whisker_high,
  count(*) FILTER (NOT inside) AS n_outliers
FROM (SELECT p.mixed, p.kind_f, adj_m, q1, median, q3, n,
             adj_m BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM pairs p JOIN q USING (mixed, kind_f) WHERE adj_m IS NOT NULL)
GROUP BY mixed, kind_f""")
def box_stats(spark, folder):
    out = c.box_stats(pairs(spark, folder), "adj_m", ["mixed", "kind_f"])
    return rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high"], 4)


@query("C4_density_table", more(PAIRS, _RANGE.format(c="size_a_m", t="pairs")) + f"""
SELECT period, kind_m, bin, n, {r('n / sum(n) OVER (PARTITION BY period, kind_m)')} AS share
FROM (SELECT period, kind_m, {_bin_sql('size_a_m', 12)} AS bin, count(*) AS n
      FROM pairs, ends WHERE size_a_m IS NOT NULL GROUP BY period, kind_m, bin)""")
def density_table(spark, folder):
    out = c.density_table(pairs(spark, folder), "size_a_m", ["period", "kind_m"], 12)
    return rounded(out.select("period", "kind_m", "bin", "n", "share"), ["share"])


@query("C5_bar_counts", PAIRS + "SELECT kind_f, period, mixed, count(*) AS n FROM pairs GROUP BY ALL")
def bar_counts(spark, folder):
    return c.bar_counts(pairs(spark, folder), "period", "mixed", ["kind_f"])


@query("C6_bar_shares", LEVELED + f"""
SELECT kind_f, priority, mixed, n, {r('n / sum(n) OVER (PARTITION BY kind_f, priority)')} AS share
FROM (SELECT kind_f, priority, mixed, count(*) AS n FROM leveled GROUP BY ALL)""")
def bar_shares(spark, folder):
    df = with_priority(pairs(spark, folder), spark, folder)
    return rounded(c.bar_shares(df, "priority", "mixed", ["kind_f"]), ["share"])


@query("C7_line_fit", OBS + f"""
SELECT kind, CAST(regr_count(mass, size_a) AS BIGINT) AS n, {r('regr_slope(mass, size_a)', 4)} AS slope,
  {r('regr_intercept(mass, size_a)', 3)} AS intercept, {r('regr_r2(mass, size_a)')} AS r2
FROM measured GROUP BY kind""")
def line_fit(spark, folder):
    out = c.line_fit(measured(spark, folder), "size_a", "mass", ["kind"])
    return rounded(out, {"slope": 4, "intercept": 3, "r2": 6})


_PROBS = ", ".join(str((i + 0.5) / 50) for i in range(50))


@query("C9_qq_table", CLEAN + f"""
SELECT {r('(k - 0.5) / 50.0')} AS p, {r('qs[k]', 4)} AS sample
FROM (SELECT quantile_cont(mass, [{_PROBS}]) AS qs FROM clean), (SELECT unnest(range(1, 51)) AS k)""")
def qq_table(spark, folder):
    out = c.qq_table(clean(spark, folder), "mass", 50).select("p", "sample")
    return rounded(out, {"p": 6, "sample": 4})


# Normal quantiles by halving an interval around them.
_NORMAL = f"""
probs AS (SELECT (k + 0.5) / 50.0 AS p FROM range(50) t(k)),
halves AS (
  SELECT 0 AS i, p, CAST(-4 AS DOUBLE) AS lo, CAST(4 AS DOUBLE) AS hi FROM probs
  UNION ALL
  SELECT i + 1, p, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END
  FROM (SELECT *, (lo + hi) / 2 AS mid, 1 - 0.5 * {erfc('((lo + hi) / 2 / sqrt(2))')} < p AS below
        FROM halves WHERE i < 48)),
q AS (SELECT quantile_cont(mass, [{_PROBS}]) AS qs, quantile_cont(mass, 0.25) AS q1,
             quantile_cont(mass, 0.75) AS q3 FROM clean)"""


@query("C9_qq_theoretical", more(CLEAN, _NORMAL) + f"""
SELECT {r('p')} AS p, {r('(lo + hi) / 2')} AS theoretical, {r('qs[CAST(round(p * 50 + 0.5) AS INTEGER)]', 4)} AS sample,
  {r('(q1 + q3) / 2 + (q3 - q1) / 1.3489795003921634 * (lo + hi) / 2', 4)} AS line
FROM halves, q WHERE i = 48""")
def qq_theoretical(spark, folder):
    out = c.qq_table(clean(spark, folder), "mass", 50)
    return rounded(out, {"p": 6, "theoretical": 6, "sample": 4, "line": 4})


@query("C10_period_series", PAIRS + f"""
SELECT period, kind_f, {r('avg(day_f)')} AS mean_day, {r('median(day_f)')} AS median_day,
  {r('avg(mixed)')} AS share FROM pairs GROUP BY period, kind_f""")
def period_series(spark, folder):
    df = cut_lineage(pairs(spark, folder).select("period", "kind_f", "day_f", "mixed"))  # means and medians start from the same pairs
    means = c.period_series(df, "period", ["kind_f"], {"mean_day": F.avg("day_f"), "share": F.avg("mixed")})
    medians = median_of(df, ["period", "kind_f"], ["day_f"]).withColumnRenamed("median_day_f", "median_day")
    return rounded(null_safe_join(means, medians, ["period", "kind_f"], "left"), ["mean_day", "median_day", "share"])


@query("C11_count_and_share", PAIRS + f"""
SELECT period, count(*) FILTER (mixed = 1) AS hits, count(*) AS total, {r('avg(mixed)')} AS share,
  {r('avg(mixed) * 200')} AS share_scaled FROM pairs GROUP BY period""")
def count_and_share(spark, folder):
    out = c.count_and_share_series(pairs(spark, folder), "period", "mixed", 200)
    return rounded(out, ["share", "share_scaled"])


_TWO = """ends AS (SELECT min(mass) AS xlo, max(mass) AS xhi, min(size_a) AS ylo, max(size_a) AS yhi
  FROM measured WHERE mass IS NOT NULL AND size_a IS NOT NULL)"""


@query("C12_scatter_cells", more(OBS, _TWO) + f"""
SELECT kind, {_bin_sql('mass', 30, 'xlo', 'xhi')} AS x_bin, {_bin_sql('size_a', 20, 'ylo', 'yhi')} AS y_bin,
  count(*) AS n FROM measured, ends WHERE mass IS NOT NULL AND size_a IS NOT NULL GROUP BY ALL""")
def scatter_cells(spark, folder):
    return c.scatter_cells(measured(spark, folder), "mass", "size_a", 30, 20, ["kind"])


@query("C12_scatter_sample", OBS + """
SELECT grp, line, ind, mass, size_a, kind FROM measured
WHERE CAST('0x' || substr(md5(concat_ws('|', '42', grp, line, ind)), 1, 8) AS BIGINT) < 429496729""")
def scatter_sample(spark, folder):
    df = measured(spark, folder).select("grp", "line", "ind", "mass", "size_a", "kind")
    return c.scatter_sample(df, ["grp", "line", "ind"], 0.1)


def _pair_sql() -> str:
    cols = ["mass", "size_a", "disc", "tax"]
    ends = ", ".join(f"min({x}) AS lo_{x}, max({x}) AS hi_{x}" for x in cols)
    bins = ", ".join(
        f"CASE WHEN {x} IS NOT NULL THEN {_bin_sql(x, 8, f'lo_{x}', f'hi_{x}')} END AS {x}" for x in cols
    )
    parts = [
        f"SELECT '{a}' AS x_name, '{b}' AS y_name, {a} AS x_bin, {b} AS y_bin, count(*) AS n "
        f"FROM binned WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"
        for i, a in enumerate(cols) for b in cols[i + 1:]
    ]
    return more(
        OBS, f"ends AS (SELECT {ends} FROM measured)",
        f"binned AS (SELECT {bins} FROM (SELECT mass, size_a, disc, tax FROM measured) m, ends)",
    ) + " UNION ALL ".join(parts)


@query("C13_pair_cells", _pair_sql())
def pair_cells(spark, folder):
    return c.pair_cells(measured(spark, folder), ["mass", "size_a", "disc", "tax"], 8)


@query("C14_trajectories", PAIRS + f"""
SELECT ind_hist_f, period, {r('adj_m', 8)} AS adj_m, grp FROM pairs ORDER BY ind_hist_f, period, grp""")
def trajectories(spark, folder):
    return rounded(c.trajectories(pairs(spark, folder), "ind_hist_f", "period", "adj_m", ["grp"]), ["adj_m"], 8)
