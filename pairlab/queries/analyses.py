"""Whole analyses (Q)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pairlab.operators import charts, inference, mixed
from pairlab.operators import groups as g
from pairlab.operators import regression as reg
from pairlab.operators.design import Factor
from pairlab.operators.members import attach_scores
from pairlab.operators.pairs import build_pairs
from pairlab.operators.scaling import zscore
from pairlab.operators.summary import count_by, crosstab, crosstab_share, median_of
from pairlab.plans import analyses as plan
from pairlab.plans.standin import (
    KINDS, PRIORITIES, SIDES, clean, measured, paired_second_sides, pairs, with_priority,
)
from pairlab.queries.base import CLEAN, LEVELED, PAIRS, erfc, more, query, r, rounded
from pairlab.queries.models import (
    BATCH_COEFS, OBSERVER, PROFILE, batch_models, batch_rounded, batch_specs, observer_ctes, observer_rounded, profiles,
)
from pairlab.session import cut_lineage

_CLEAN_COLS = ["grp", "line", "ind", "role", "kind", "period", "size_a", "mass", "disc", "tax", "mixed", "n_rows"]


@query("Q1_clean_observations", CLEAN + f"SELECT {', '.join(_CLEAN_COLS)}, {r('adj', 8)} AS adj FROM clean")
def clean_observations(spark, folder):
    return rounded(clean(spark, folder).select(*_CLEAN_COLS, "adj"), ["adj"], 8)


_PAIR_COLS = [
    "grp", "mixed", "period", "period_m", *[f"{c}_{s}" for s in "fm" for c in (
        "ind", "ind_hist", "role", "kind", "size_a", "mass", "disc", "tax", "day", "line")],
]


@query("Q2_wide_pairs", PAIRS + f"SELECT {', '.join(_PAIR_COLS)} FROM pairs")
def wide_pairs(spark, folder):
    return pairs(spark, folder).select(*_PAIR_COLS)


@query("Q3_share_by_kind", PAIRS + f"""
SELECT kind_f, mixed, n, {r('n / sum(n) OVER (PARTITION BY kind_f)')} AS share
FROM (SELECT kind_f, mixed, count(*) AS n FROM pairs GROUP BY kind_f, mixed)""")
def share_by_kind(spark, folder):
    return rounded(plan.share_by_kind(pairs(spark, folder), "kind_f", "mixed"), ["share"])


_TESTS = """
by_period AS (SELECT period, sum(mixed)::BIGINT AS hits, count(*) AS total,
  (SELECT avg(mixed) FROM pairs) AS p0 FROM pairs GROUP BY period),
tested AS (SELECT *, pow(abs(hits - total * p0) - least(0.5, abs(hits - total * p0)), 2)
  / (total * p0 * (1 - p0)) AS statistic FROM by_period),
valued AS (SELECT *, {p} AS p_value FROM tested),
ranked AS (SELECT *, row_number() OVER (ORDER BY p_value) AS i, count(*) OVER () AS n FROM valued)""".format(
    p=erfc("sqrt(statistic / 2)")
)


@query("Q4_share_by_period_tests", more(PAIRS, _TESTS) + f"""
SELECT period, hits, total, {r('hits / total')} AS share, {r('statistic')} AS statistic, {r('p_value')} AS p_value,
  {r('least(1.0, min(n / i * p_value) OVER (ORDER BY i DESC))')} AS p_adj FROM ranked""")
def share_by_period(spark, folder):
    out = plan.share_by_period(pairs(spark, folder), "period", "mixed").drop("p0")
    return rounded(out, ["share", "statistic", "p_value", "p_adj"])


_SCORES = """scores AS (
  SELECT grp, ind, {z} FROM clean WHERE role = 'O' AND mass IS NOT NULL AND size_a IS NOT NULL
  WINDOW w AS (PARTITION BY period, kind))""".format(z=", ".join(
    f"({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) AS z_{c}" for c in ("mass", "size_a", "adj")
))


@query("Q5_scored_pairs", more(PAIRS, _SCORES) + f"""
SELECT p.grp, p.kind_f, p.mixed, {r('z_mass')} AS z_mass_m, {r('z_size_a')} AS z_size_a_m, {r('z_adj')} AS z_adj_m
FROM pairs p LEFT JOIN scores s ON p.grp = s.grp AND p.ind_m = s.ind""")
def scored_pairs(spark, folder):
    cols = ["mass", "size_a", "adj"]
    # pairs, scores and their means all start from the clean rows: write those once
    rows = cut_lineage(clean(spark, folder).select("grp", "ind", "role", "kind", "period", *cols, "mixed", "n_rows"))
    side = rows.filter("role = 'O'").dropna(subset=["mass", "size_a"])
    scores = zscore(side, ["period", "kind"], cols).select("grp", "ind", *[f"z_{c}" for c in cols])
    wide = build_pairs(
        rows.filter("n_rows = 2").select("grp", "ind", "role", "kind", "mixed"), "grp", "role", SIDES,
        ["grp", "mixed"], partner_id="ind",
    )
    out = attach_scores(
        wide.select("grp", "ind_m", "kind_f", "mixed"), scores,
        {"grp": "grp", "ind_m": "ind"}, {f"z_{c}": f"z_{c}_m" for c in cols},
    )
    return rounded(out.drop("ind_m"), [f"z_{c}_m" for c in cols])


@query("Q6_switching_individuals", PAIRS + """
SELECT ind_hist_f, period, grp, mixed, kind_m FROM pairs
WHERE ind_hist_f IN (SELECT ind_hist_f FROM pairs GROUP BY ind_hist_f HAVING count(DISTINCT mixed) > 1)
ORDER BY ind_hist_f, period""")
def switching(spark, folder):
    rows = plan.switchers(pairs(spark, folder), "ind_hist_f", "period", "mixed")
    return rows.select("ind_hist_f", "period", "grp", "mixed", "kind_m").orderBy("ind_hist_f", "period")


@query("Q6_switching_histories", PAIRS + """
SELECT ind_hist_f, period, mixed, count(*) AS n FROM pairs
WHERE ind_hist_f IN (SELECT ind_hist_f FROM pairs GROUP BY ind_hist_f HAVING count(DISTINCT mixed) > 1)
GROUP BY ALL""")
def switching_histories(spark, folder):
    rows = plan.switchers(pairs(spark, folder), "ind_hist_f", "period", "mixed")
    return count_by(rows, ["ind_hist_f", "period", "mixed"])


def _predictor_models() -> list[tuple[reg.Spec, str]]:
    """Every response, predictor and kind, over all individuals and those with several partners."""
    return [
        (reg.Spec(f"{kind}:{s.name}{label}", s.family, s.response, s.predictor),
         f"kind_f = '{kind}' AND {several}")
        for s in batch_specs(("avg_mass", "avg_size", "avg_disc", "avg_adj"))
        for kind in ("A", "R")
        for label, several in (("", "true"), (":several", "n_partners > 1"))
    ]


@query("Q7_partner_predictors", batch_models(
    more(PAIRS, PROFILE), _predictor_models()) + BATCH_COEFS)
def partner_predictors(spark, folder):
    specs = [replace(s, subset=F.expr(where)) for s, where in _predictor_models()]
    return batch_rounded(reg.fit_glm_grid(profiles(spark, folder), specs))


_HIST = """hist AS (SELECT *, coalesce(sum(mixed) OVER (PARTITION BY ind_hist_f ORDER BY period, grp
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM pairs),
several AS (SELECT *, CAST(prior > 0 AS INTEGER) AS any_prior FROM hist
  WHERE ind_hist_f IN (SELECT ind_hist_f FROM pairs GROUP BY ind_hist_f HAVING count(*) > 1))"""


def _history(spark, folder):
    df = pairs(spark, folder).select("grp", "period", "ind_hist_f", "kind_f", "mixed")
    return plan.history(df, "ind_hist_f", "period", "grp", "mixed")


@query("Q8_repeatability_rates", more(PAIRS, _HIST) + f"""
SELECT kind_f, any_prior, {r('avg(mixed)')} AS rate, sum(mixed)::BIGINT AS n_flagged, count(*) AS n
FROM several GROUP BY kind_f, any_prior""")
def repeatability_rates(spark, folder):
    several = g.keep_repeated(_history(spark, folder), ["ind_hist_f"])
    return rounded(plan.history_rates(several, "kind_f", "mixed"), ["rate"])


@query("Q8_repeatability_individuals", more(PAIRS, _HIST) + """
SELECT kind_f, count(DISTINCT ind_hist_f) AS n_individuals FROM several GROUP BY kind_f""")
def repeatability_individuals(spark, folder):
    several = g.keep_repeated(_history(spark, folder), ["ind_hist_f"])
    return g.n_distinct(several, ["kind_f"], "ind_hist_f", "n_individuals", count_null=False).select(
        "kind_f", "n_individuals"
    )


@query("Q8_repeatability_models")
def repeatability_models(spark, folder):
    """All five models on all pairs, and again on individuals of several pairs."""
    hist = cut_lineage(_history(spark, folder))
    several = cut_lineage(g.keep_repeated(hist, ["ind_hist_f"]))
    fits = plan.history_models(hist, "kind_f", "mixed", "period")
    fits |= {f"{k}:several": f for k, f in plan.history_models(several, "kind_f", "mixed", "period").items()}
    return reg.coef_tables(spark, fits)


@query("Q8_repeatability_predictions")
def repeatability_predictions(spark, folder):
    """By the number of earlier mixed pairs: 0 to 2, and 0 or any."""
    hist = cut_lineage(_history(spark, folder))
    tables = [
        plan.history_predictions(hist, "kind_f", "mixed", "period", prior, values).withColumnRenamed(prior, "value")
        .withColumn("history", F.lit(prior)) for prior, values in (("prior", (0, 1, 2)), ("any_prior", (0, 1)))
    ]
    return tables[0].unionByName(tables[1])


_DAYS = f"""
SELECT grp, period, kind_f, mixed, {r('day_f - avg(day_f) OVER w')} AS day_f_relative,
  {r('(day_f - avg(day_f) OVER w) / nullif(stddev_samp(day_f) OVER w, 0)')} AS z_day_f
FROM pairs WINDOW w AS (PARTITION BY """


def _timed(spark, folder, by):
    df = pairs(spark, folder).select("grp", "period", "kind_f", "mixed", "day_f")
    return plan.timing(df, by, "day_f")


@query("Q9_timing", PAIRS + _DAYS + "period)")
def timing(spark, folder):
    return rounded(_timed(spark, folder, ["period"]).drop("day_f"), ["day_f_relative", "z_day_f"])


@query("Q9_timing_by_kind", PAIRS + _DAYS + "period, kind_f)")
def timing_by_kind(spark, folder):
    return rounded(_timed(spark, folder, ["period", "kind_f"]).drop("day_f"), ["day_f_relative", "z_day_f"])


@query("Q9_timing_model")
def timing_model(spark, folder):
    """Eight models: days about the mean of the period or of period and kind, centred or scaled, with the kind or not."""
    fits = {}
    for label, by in (("", ["period"]), (":by_kind", ["period", "kind_f"])):
        rows = cut_lineage(_timed(spark, folder, by))
        fits |= {k + label: f for k, f in plan.timing_models(rows, "day_f", "kind_f", "mixed", "period").items()}
    return reg.coef_tables(spark, fits)


@query("Q10_habitat_shares", LEVELED + f"""
SELECT kind_f, priority, mixed, n, {r('n / sum(n) OVER (PARTITION BY kind_f, priority)')} AS share
FROM (SELECT kind_f, priority, mixed, count(*) AS n FROM leveled WHERE priority IS NOT NULL GROUP BY ALL)""")
def habitat_shares(spark, folder):
    df = with_priority(pairs(spark, folder), spark, folder).dropna(subset=["priority"])
    return rounded(charts.bar_shares(df, "priority", "mixed", ["kind_f"]), ["share"])


@query("Q10_habitat_predictions")
def habitat_predictions(spark, folder):
    df = with_priority(pairs(spark, folder), spark, folder)
    return plan.level_effect(df, "priority", "kind_f", "mixed", "period", PRIORITIES)


@query("Q11_age_shares", LEVELED + f"""
SELECT priority, mixed, n, {r('n / sum(n) OVER (PARTITION BY mixed)')} AS share
FROM (SELECT priority, mixed, count(*) AS n FROM leveled WHERE kind_m = 'A' GROUP BY ALL)""")
def age_shares(spark, folder):
    df = with_priority(pairs(spark, folder), spark, folder).filter("kind_m = 'A'")
    return rounded(crosstab_share(crosstab(df, "priority", "mixed"), "mixed"), ["share"])


_AGE_CHI = """
sub AS (SELECT * FROM leveled WHERE kind_m = 'A'),
cells AS (SELECT x.a, y.b, (SELECT count(*) FROM sub t WHERE t.priority = x.a AND t.mixed = y.b) AS o,
  x.n * y.n / CAST((SELECT count(*) FROM sub) AS DOUBLE) AS e
  FROM (SELECT priority AS a, count(*) AS n FROM sub GROUP BY priority) x,
       (SELECT mixed AS b, count(*) AS n FROM sub GROUP BY mixed) y),
test AS (SELECT CAST(sum(o) AS BIGINT) AS n, count(DISTINCT a) AS levels_a, count(DISTINCT b) AS levels_b,
  sum(pow(o - e, 2) / e) AS q FROM cells)"""


@query("Q11_age_test", more(LEVELED, _AGE_CHI) + f"""
SELECT n, levels_a, levels_b, {r('q')} AS statistic,
  CAST((levels_a - 1) * (levels_b - 1) AS INTEGER) AS df, {r('exp(-q / 2) * (1 + q / 2)')} AS p_value
FROM test WHERE (levels_a - 1) * (levels_b - 1) = 4""")
def age_test(spark, folder):
    df = with_priority(pairs(spark, folder), spark, folder).filter("kind_m = 'A'")
    return rounded(inference.chi_square(df, "priority", "mixed"), ["statistic", "p_value"])


@query("Q11_age_counts", LEVELED + """
SELECT kind_f, mixed, priority, count(*) AS individuals FROM leveled GROUP BY ALL""")
def age_counts(spark, folder):
    df = with_priority(pairs(spark, folder), spark, folder)
    return count_by(df, ["kind_f", "mixed", "priority"], "individuals")


@query("Q11_age_model")
def age_model(spark, folder):
    """Four models: the level of either side, alone and with the kind."""
    df = cut_lineage(with_priority(pairs(spark, folder), spark, folder).select("priority", "line_m", "kind_f", "mixed", "period"))
    return reg.coef_tables(spark, plan.level_models(df, ["priority", Factor("line_m")], "kind_f", "mixed", "period"))


_FIRST = {
    "m1": ["size_a_m", "mass_m"], "m2": ["adj_m", "mass_m"], "m3": ["adj_m"], "m4": ["mass_m"], "m5": ["size_a_m"],
}


def _first_models(spark, folder):
    df = cut_lineage(pairs(spark, folder).select("mixed", "period", *dict.fromkeys(c for terms in _FIRST.values() for c in terms)))
    return plan.intercept_models(df, "mixed", _FIRST, "period")


@query("Q17_first_models")
def first_models(spark, folder):
    """Five models of the second side's measures with a period intercept."""
    return reg.coef_tables(spark, _first_models(spark, folder))


@query("Q17_first_models_aic")
def first_models_aic(spark, folder):
    """The same five, compared."""
    fits = _first_models(spark, folder)
    return reg.compare_fits(spark, {k: f for k, f in fits.items() if f.status == "ok"})


_INDIVIDUAL = {
    "m6": ["adj_k", "mass_k"], "m8": ["disc_k", "tax_k", "mass_k"], "m9": ["adj_k", "mass_k", "disc_k"],
    "m10": ["adj_k", "mass_k", "priority", "disc_k"],
}


def _individual_models(spark, folder):
    """Which side an observation is of, by its scaled measures, with an intercept per individual."""
    # the means and the models start from the same join: write it once
    df = with_priority(measured(spark, folder), spark, folder).dropna(subset=["mass", "size_a"])
    df = cut_lineage(df.select("ind", "role", "kind", "priority", "adj", "mass", "disc", "tax"))
    z = zscore(df, ["kind"], ["adj", "mass", "disc", "tax"])
    z = z.withColumns({f"{c}_k": F.col(f"z_{c}") for c in ("adj", "mass", "disc", "tax")})
    z = z.withColumn("first_side", (F.col("role") == "F").cast("int"))
    return plan.intercept_models(z, "first_side", _INDIVIDUAL, "ind")


@query("Q17_individual_models")
def individual_models(spark, folder):
    """Four models with an intercept per individual."""
    return reg.coef_tables(spark, _individual_models(spark, folder))


@query("Q17_individual_models_vif")
def individual_models_vif(spark, folder):
    """Variance inflation of the widest of them."""
    return reg.vif_of_coefficients(spark, _individual_models(spark, folder)["m10"])


@query("Q12_measures_by_period", PAIRS + f"""
SELECT period, kind_m, {r('median(mass_m)', 4)} AS median_mass_m, {r('median(size_a_m)', 4)} AS median_size_a_m,
  {r('median(disc_m)')} AS median_disc_m FROM pairs GROUP BY period, kind_m""")
def measures_by_period(spark, folder):
    out = median_of(pairs(spark, folder), ["period", "kind_m"], ["mass_m", "size_a_m", "disc_m"])
    return rounded(out, {"median_mass_m": 4, "median_size_a_m": 4, "median_disc_m": 6})


@query("Q12_boxes_by_period", PAIRS + f"""
SELECT period, kind_m, count(mass_m) AS n, {r('quantile_cont(mass_m, 0.25)', 4)} AS q1,
  {r('median(mass_m)', 4)} AS median, {r('quantile_cont(mass_m, 0.75)', 4)} AS q3
FROM pairs GROUP BY period, kind_m""")
def boxes_by_period(spark, folder):
    out = charts.box_stats(pairs(spark, folder), "mass_m", ["period", "kind_m"])
    return rounded(out.select("period", "kind_m", "n", "q1", "median", "q3"), ["q1", "median", "q3"], 4)


@query("Q13_observer_effect", more(CLEAN, "second AS (SELECT * FROM clean WHERE role = 'O' AND n_rows = 2)",
                                   *observer_ctes("second", ["mass", "size_a", "disc", "adj"])) + OBSERVER)
def observer_effect(spark, folder):
    side = with_priority(paired_second_sides(spark, folder), spark, folder)
    return observer_rounded(mixed.observer_effect(side, "priority", ["mass", "size_a", "disc", "adj"], "period"))


_SIDE_M = "side AS (SELECT * FROM clean WHERE role = 'O' AND n_rows = 2 AND mass IS NOT NULL AND size_a IS NOT NULL)"


@query("Q14_condition_correlations", more(CLEAN, _SIDE_M) + " UNION ALL ".join(
    f"SELECT kind, '{a}' AS var_i, '{b}' AS var_j, "
    + (r(f"corr({a}, {b})") if a != b else "max(CAST(1.0 AS DOUBLE))") + " AS r FROM side GROUP BY kind"
    for a in ("mass", "size_a", "disc") for b in ("mass", "size_a", "disc")))
def condition_correlations(spark, folder):
    out = inference.corr_matrix(paired_second_sides(spark, folder), ["mass", "size_a", "disc"], ["kind"])
    return rounded(out, ["r"])


@query("Q14_condition_index")
def condition_index(spark, folder):
    side = paired_second_sides(spark, folder).filter("kind = 'A'")
    out = plan.condition_index(side, "mass", ["size_a", "disc"], "ind_hist", "period")
    return out.select("grp", "ind", "mass", "condition")


@query("Q14_condition_vif")
def condition_vif(spark, folder):
    """Variance inflation of the size measures in the model of the index."""
    side = paired_second_sides(spark, folder).filter("kind = 'A'")
    return reg.vif_of_coefficients(spark, plan.condition_fit(side, "mass", ["size_a", "disc"], "ind_hist", "period"))


_COMPONENTS = """s AS (SELECT kind, corr(size_a, disc) AS r, avg(size_a) AS ma, stddev_samp(size_a) AS sa,
  avg(disc) AS mb, stddev_samp(disc) AS sb FROM clean
  WHERE role = 'O' AND n_rows = 2 AND size_a IS NOT NULL AND disc IS NOT NULL GROUP BY kind)"""


def _components(spark, folder):
    side = paired_second_sides(spark, folder)
    return plan.size_components(side, ["size_a", "disc"], "kind", KINDS)


@query("Q14_condition_components", more(CLEAN, _COMPONENTS) + f"""
SELECT kind, component, variable, {r('loading')} AS loading, {r('sqrt(v)')} AS sd, {r('v / 2')} AS share FROM (
  SELECT kind, 'PC1' AS component, 'size_a' AS variable, sqrt(0.5) AS loading, 1 + abs(r) AS v FROM s
  UNION ALL SELECT kind, 'PC1', 'disc', sign(r) * sqrt(0.5), 1 + abs(r) FROM s
  UNION ALL SELECT kind, 'PC2', 'size_a', sqrt(0.5), 1 - abs(r) FROM s
  UNION ALL SELECT kind, 'PC2', 'disc', -sign(r) * sqrt(0.5), 1 - abs(r) FROM s)""")
def condition_components(spark, folder):
    return rounded(_components(spark, folder)[0], ["loading", "sd", "share"])


@query("Q14_condition_scores", more(CLEAN, _COMPONENTS) + f"""
SELECT kind, grp, line, {r('((size_a - ma) / sa + sign(r) * (disc - mb) / sb) * sqrt(0.5)', 5)} AS "PC1"
FROM clean JOIN s USING (kind) WHERE role = 'O' AND n_rows = 2""")
def condition_scores(spark, folder):
    return rounded(_components(spark, folder)[1].select("kind", "grp", "line", "PC1"), ["PC1"], 5)


@query("Q15_several_partners", CLEAN + """
SELECT ind_hist, period, grp, n_entries FROM (
  SELECT ind_hist, period, grp, mixed, count(*) OVER (PARTITION BY ind_hist, period) AS n_entries
  FROM clean WHERE role = 'O' AND n_rows = 2) WHERE n_entries > 1 AND mixed = 1""")
def several_partners(spark, folder):
    side = paired_second_sides(spark, folder)
    out = g.keep_repeated(side, ["ind_hist", "period"], F.col("mixed") == 1)
    return out.select("ind_hist", "period", "grp", "n_entries")


_CLASSES = """classes AS (
  SELECT grp, CASE WHEN n_rows = 1 THEN 'unknown' WHEN n_rows > 2 THEN 'extra_pair'
    WHEN crossed THEN 'FA_OR' ELSE 'FA_OA' END AS pair, dense_rank() OVER (ORDER BY grp) AS pair_id
  FROM (SELECT *, bool_or(role = 'F' AND kind = 'A') OVER w AS anchored,
               bool_or(role = 'O' AND kind = 'R') OVER w AS crossed FROM clean WINDOW w AS (PARTITION BY grp))
  WHERE anchored)"""


def _classes(spark, folder):
    df = clean(spark, folder).select("grp", "role", "kind", "n_rows")
    return g.classify_pairs(
        df, "grp", "role", "kind", "F", "O", "A", "R", size="n_rows", group_id="pair_id"
    )


@query("Q16_pair_classes", more(CLEAN, _CLASSES) + "SELECT grp, pair, pair_id FROM classes")
def pair_classes(spark, folder):
    return _classes(spark, folder).select("grp", "pair", "pair_id")


@query("Q16_pair_class_counts", more(CLEAN, _CLASSES) + """
SELECT pair, count(DISTINCT pair_id) AS n_groups, count(*) AS n_rows FROM classes GROUP BY pair""")
def pair_class_counts(spark, folder):
    return plan.pair_class_counts(_classes(spark, folder), "pair_id", "pair")
