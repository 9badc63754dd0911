"""Facts of a group, individual or period on every row (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import groups as g
from pairlab.operators import inference, scaling
from pairlab.operators.summary import count_by, share_within
from pairlab.plans.standin import clean, measured, observations, pairs
from pairlab.queries.base import CLEAN, OBS, PAIRS, more, query, r, rounded


@query("W1_group_size", OBS + "SELECT grp, line, ind, count(*) OVER (PARTITION BY grp) AS n_rows FROM obs")
def group_size(spark, folder):
    return g.with_group_size(observations(spark, folder).select("grp", "line", "ind"), "grp", "n_rows")


@query("W2_mixed_flag", OBS + """SELECT grp, line, ind, kind,
  CAST(min(kind) OVER w <> max(kind) OVER w AS INTEGER) AS mixed FROM obs WINDOW w AS (PARTITION BY grp)""")
def mixed_flag(spark, folder):
    df = observations(spark, folder).select("grp", "line", "ind", "kind")
    return g.with_mixed_flag(df, "grp", "kind", "mixed")


@query("W3_groups_with_any", OBS + """SELECT grp, line, ind FROM obs
QUALIFY bool_or(role = 'F' AND kind = 'A') OVER (PARTITION BY grp)""")
def groups_with_any(spark, folder):
    df = observations(spark, folder).select("grp", "line", "ind", "role", "kind")
    hit = (F.col("role") == "F") & (F.col("kind") == "A")
    return g.keep_groups_any(df, "grp", hit).drop("role", "kind")


@query("W4_groups_by_distinct", OBS + """SELECT grp, line, ind, kind FROM obs
WHERE grp IN (SELECT grp FROM obs GROUP BY grp HAVING count(DISTINCT kind) > 1)""")
def groups_by_distinct(spark, folder):
    df = observations(spark, folder).select("grp", "line", "ind", "kind")
    return g.keep_groups_ndistinct(df, "grp", "kind", ">", 1)


@query("W5_repeated", CLEAN + """SELECT ind_hist, period, grp, n_entries FROM (
  SELECT ind_hist, period, grp, mixed, count(*) OVER (PARTITION BY ind_hist, period) AS n_entries
  FROM clean WHERE role = 'O' AND n_rows = 2) WHERE n_entries > 1 AND mixed = 1""")
def repeated(spark, folder):
    df = clean(spark, folder).filter("role = 'O' AND n_rows = 2")
    kept = g.keep_repeated(df, ["ind_hist", "period"], F.col("mixed") == 1)
    return kept.select("ind_hist", "period", "grp", "n_entries")


@query("W6_zscore", OBS + """SELECT grp, line, ind, """ + ", ".join(
    r(f"({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0)") + f" AS z_{c}" for c in ("mass", "size_a", "adj")
) + """ FROM measured WHERE mass IS NOT NULL AND size_a IS NOT NULL WINDOW w AS (PARTITION BY period, kind)""")
def zscore(spark, folder):
    df = measured(spark, folder).dropna(subset=["mass", "size_a"])
    cols = ["mass", "size_a", "adj"]
    out = scaling.zscore(df, ["period", "kind"], cols)
    return rounded(out.select("grp", "line", "ind", *[f"z_{c}" for c in cols]), [f"z_{c}" for c in cols])


@query("W7_center", PAIRS + f"""SELECT grp, period, {r('day_f - avg(day_f) OVER (PARTITION BY period)')} AS day_relative
FROM pairs""")
def center(spark, folder):
    out = scaling.center(pairs(spark, folder).select("grp", "period", "day_f"), ["period"], "day_f", "day_relative")
    return rounded(out.drop("day_f"), ["day_relative"])


@query("W8_share_within", PAIRS + f"""SELECT kind_f, mixed, n, {r('n / sum(n) OVER (PARTITION BY kind_f)')} AS share
FROM (SELECT kind_f, mixed, count(*) AS n FROM pairs GROUP BY kind_f, mixed)""")
def shares(spark, folder):
    counts = count_by(pairs(spark, folder), ["kind_f", "mixed"])
    return rounded(share_within(counts, ["kind_f"]), ["share"])


_HISTORY = """
SELECT grp, ind_hist_f, period, mixed, coalesce(sum(mixed) OVER (PARTITION BY ind_hist_f
  ORDER BY period, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
FROM pairs"""


@query("W9_prior_total", PAIRS + _HISTORY)
def prior(spark, folder):
    df = pairs(spark, folder).select("grp", "ind_hist_f", "period", "mixed")
    return scaling.prior_total(df, "ind_hist_f", ["period", "grp"], "mixed")


@query("W10_history_totals", PAIRS + f"""SELECT p.grp, p.ind_hist_f, t.n_periods, t.n_flagged,
  {r('t.n_flagged / t.n_periods')} AS share_flagged
FROM pairs p JOIN (SELECT ind_hist_f, count(DISTINCT period) AS n_periods, sum(mixed)::BIGINT AS n_flagged
  FROM pairs GROUP BY ind_hist_f) t USING (ind_hist_f)""")
def history_totals(spark, folder):
    df = pairs(spark, folder).select("grp", "ind_hist_f", "period", "mixed")
    out = g.with_history_totals(df, "ind_hist_f", "period", "mixed")
    return rounded(out.drop("period", "mixed"), ["share_flagged"])


@query("W11_group_id", OBS + "SELECT grp, line, ind, dense_rank() OVER (ORDER BY grp) AS group_id FROM obs")
def group_id(spark, folder):
    return g.with_group_id(observations(spark, folder).select("grp", "line", "ind"), "grp", "group_id")


@query("W12_total_kept", PAIRS + """SELECT grp, ind_hist_f, n_flagged FROM (
  SELECT grp, ind_hist_f, mixed, sum(mixed) OVER (PARTITION BY ind_hist_f)::BIGINT AS n_flagged FROM pairs)
WHERE mixed = 0""")
def total_kept(spark, folder):
    df = pairs(spark, folder).select("grp", "ind_hist_f", "mixed")
    out = g.with_group_total(df, "ind_hist_f", F.col("mixed"), "n_flagged")
    return out.filter("mixed = 0").drop("mixed")


# Cheap p-like value per supplier and kind: distance of its discount mean from 0.05.
_P = """p_values AS (
  SELECT kind, ind_hist, least(1.0, abs(avg(disc) - 0.05) * 40) AS p FROM obs GROUP BY kind, ind_hist
  UNION ALL SELECT kind, -1 AS ind_hist, NULL AS p FROM obs GROUP BY kind),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY p, ind_hist) AS i,
                  count(p) OVER (PARTITION BY {by}) AS n FROM p_values)"""
_ADJ = """SELECT kind, ind_hist, {p} AS p, {adj} AS p_adj FROM ranked"""


def _p_values(spark, folder):
    df = observations(spark, folder)
    p = F.least(F.lit(1.0), F.abs(F.avg("disc") - 0.05) * 40)
    means = df.groupBy("kind", "ind_hist").agg(p.alias("p"))
    missing = df.groupBy("kind").agg(F.lit(None).cast("double").alias("p"))
    return means.unionByName(missing.withColumn("ind_hist", F.lit(-1).cast("bigint")))


def _adj_sql(by: str) -> str:
    best = f"min(n / i * p) OVER (PARTITION BY {by} ORDER BY i DESC)"
    adjusted = f"CASE WHEN p IS NOT NULL THEN {r(f'least(1.0, {best})')} END"
    return more(OBS, _P.format(by=by)) + _ADJ.format(p=r("p"), adj=adjusted)


@query("W13_adjust_bh", _adj_sql("1"))
def adjust(spark, folder):
    return rounded(inference.adjust_bh(_p_values(spark, folder), "p"), ["p", "p_adj"])


@query("W13_adjust_bh_family", _adj_sql("kind"))
def adjust_family(spark, folder):
    return rounded(inference.adjust_bh(_p_values(spark, folder), "p", ["kind"]), ["p", "p_adj"])
