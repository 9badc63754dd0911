"""Regressions, mixed models and predictions (M), logistic curves (C8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import charts, mixed
from pairlab.operators import regression as m
from pairlab.operators.design import Factor, design
from pairlab.operators.members import level_grid
from pairlab.operators.pairs import partner_profile
from pairlab.plans.standin import PRIORITIES, measured, observations, pairs, with_priority
from pairlab.queries.base import LEVELED, OBS, PAIRS, more, query, r, rounded

_LM = """
s AS (SELECT {by} CAST(regr_count(mass, size_a) AS DOUBLE) AS n, regr_slope(mass, size_a) AS b,
             regr_intercept(mass, size_a) AS a, regr_syy(mass, size_a) AS syy,
             regr_sxx(mass, size_a) AS sxx, regr_sxy(mass, size_a) AS sxy, regr_avgx(mass, size_a) AS mx
      FROM measured {where}),
f AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM s)"""


@query("M1_linear_regression", more(OBS, _LM.format(by="", where="")) + f"""
SELECT '(Intercept)' AS term, {r('a', 4)} AS estimate, {r('sqrt(s2 * (1 / n + mx * mx / sxx))', 4)} AS se FROM f
UNION ALL SELECT 'size_a', {r('b', 4)}, {r('sqrt(s2 / sxx)', 4)} FROM f""")
def linear(spark, folder):
    fit = m.fit_lm(measured(spark, folder), "mass", ["size_a"])
    out = m.coef_table(spark, fit).select("term", "estimate", "se")
    return rounded(out, ["estimate", "se"], 4)


@query("M1_linear_with_factor", more(OBS, """
g AS (SELECT kind, count(*) AS n, avg(mass) AS m, var_samp(mass) * (count(*) - 1) AS ss
      FROM ranged WHERE mass IS NOT NULL GROUP BY kind),
s AS (SELECT sum(ss) / (sum(n) - 2) AS s2 FROM g)""") + f"""
SELECT '(Intercept)' AS term, {r('a.m', 3)} AS estimate, {r('sqrt(s2 / a.n)', 4)} AS se FROM g a, s WHERE a.kind = 'A'
UNION ALL SELECT 'kind[R]', {r('b.m - a.m', 3)}, {r('sqrt(s2 / a.n + s2 / b.n)', 4)}
FROM g a, g b, s WHERE a.kind = 'A' AND b.kind = 'R'""")
def linear_factor(spark, folder):
    fit = m.fit_lm(measured(spark, folder), "mass", ["kind"])
    return rounded(m.coef_table(spark, fit).select("term", "estimate", "se"), {"estimate": 3, "se": 4})


def _irls(base: str, source: str, family: str, rounds: int = 12) -> str:
    """Newton steps of a one-predictor model as a recursive query (x standardised)."""
    mu = "1 / (1 + exp(-(a + b * z)))" if family == "binomial" else "exp(a + b * z)"
    weight = "mu * (1 - mu)" if family == "binomial" else "mu"
    start = "ln(avg(y) / (1 - avg(y)))" if family == "binomial" else "ln(avg(y))"
    return more(
        base, f"src AS ({source})",
        "d AS (SELECT (x - mx) / sx AS z, y FROM src, (SELECT avg(x) AS mx, stddev_samp(x) AS sx FROM src))",
        f"""steps AS (
  SELECT 0 AS i, (SELECT {start} FROM d) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS va,
         CAST(0 AS DOUBLE) AS vb, CAST(0 AS DOUBLE) AS vab
  UNION ALL
  SELECT i + 1, a + (w2 * g0 - w1 * g1) / (w0 * w2 - w1 * w1), b + (w0 * g1 - w1 * g0) / (w0 * w2 - w1 * w1),
         w2 / (w0 * w2 - w1 * w1), w0 / (w0 * w2 - w1 * w1), -w1 / (w0 * w2 - w1 * w1)
  FROM (SELECT i, any_value(a) AS a, any_value(b) AS b, sum(w) AS w0, sum(w * z) AS w1, sum(w * z * z) AS w2,
               sum(y - mu) AS g0, sum((y - mu) * z) AS g1
        FROM (SELECT *, {weight} AS w FROM (SELECT i, a, b, z, y, {mu} AS mu FROM steps, d WHERE i < {rounds}))
        GROUP BY i))""",
        f"""est AS (SELECT a - b * mx / sx AS b0, b / sx AS b1,
  sqrt(va + vb * mx * mx / sx / sx - 2 * vab * mx / sx) AS se0, sqrt(vb) / sx AS se1
  FROM steps, (SELECT avg(x) AS mx, stddev_samp(x) AS sx FROM src) WHERE i = {rounds})""",
    )


_COEFS = f"""
SELECT '(Intercept)' AS term, {r('b0', 5)} AS estimate, {r('se0', 5)} AS se FROM est
UNION ALL SELECT '{{x}}', {r('b1', 7)}, {r('se1', 7)} FROM est"""


def _coefs(spark, fit):
    out = m.coef_table(spark, fit).select("term", "estimate", "se")
    digits = F.when(F.col("term") == "(Intercept)", 5).otherwise(7)
    return out.withColumns({
        c: F.when(digits == 5, F.round(c, 5)).otherwise(F.round(c, 7)) + 0.0 for c in ("estimate", "se")
    })


@query("M2_logistic_regression", _irls(PAIRS, "SELECT day_f AS x, mixed AS y FROM pairs", "binomial")
       + _COEFS.format(x="day_f"))
def logistic(spark, folder):
    return _coefs(spark, m.fit_glm(pairs(spark, folder), "mixed", ["day_f"], "binomial"))


@query("M2_logistic_rows", _irls(
    OBS, "SELECT mass AS x, CAST(kind = 'R' AS INTEGER) AS y FROM measured WHERE mass IS NOT NULL", "binomial")
    + f"""SELECT '(Intercept)' AS term, {r('b0', 5)} AS estimate, {r('se0', 5)} AS se FROM est
UNION ALL SELECT 'mass', {r('b1', 9)}, {r('se1', 9)} FROM est""")
def logistic_rows(spark, folder):
    df = measured(spark, folder).withColumn("is_r", (F.col("kind") == "R").cast("int"))
    out = m.coef_table(spark, m.fit_glm(df, "is_r", ["mass"], "binomial")).select("term", "estimate", "se")
    return out.withColumns({
        c: F.when(F.col("term") == "mass", F.round(c, 9)).otherwise(F.round(c, 5)) + 0.0
        for c in ("estimate", "se")
    })


_HISTORY = """hist AS (SELECT ind_hist_f, count(*) AS n_pairs, sum(mixed) AS n_mixed, max(kind_f) AS kind_f
  FROM pairs GROUP BY ind_hist_f)"""


def _histories(spark, folder):
    return pairs(spark, folder).groupBy("ind_hist_f").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("mixed").alias("n_mixed"), F.max("kind_f").alias("kind_f")
    )


@query("M3_poisson_regression", _irls(
    more(PAIRS, _HISTORY), "SELECT n_pairs AS x, n_mixed AS y FROM hist", "poisson") + _COEFS.format(x="n_pairs"))
def poisson(spark, folder):
    return _coefs(spark, m.fit_glm(_histories(spark, folder), "n_mixed", ["n_pairs"], "poisson"))


_SATURATED = """
g AS (SELECT period, CAST(sum(mixed) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY period),
l AS (SELECT period, ln(s / (n - s)) AS b, 1 / s + 1 / (n - s) AS v FROM g),
base AS (SELECT * FROM l ORDER BY period LIMIT 1)"""


@query("M4_factor_terms", more(PAIRS, _SATURATED) + f"""
SELECT '(Intercept)' AS term, {r('b')} AS estimate, {r('sqrt(v)')} AS se FROM base
UNION ALL SELECT concat('period[', l.period, ']'), {r('l.b - base.b')}, {r('sqrt(l.v + base.v)')}
FROM l, base WHERE l.period <> base.period""")
def factor_terms(spark, folder):
    fit = m.fit_glm(pairs(spark, folder), "mixed", [Factor("period")], "binomial")
    return rounded(m.coef_table(spark, fit).select("term", "estimate", "se"), ["estimate", "se"])


@query("M4_design_columns", LEVELED + """
SELECT grp, CAST(priority = '4-NOT SPECIFIED' AS INTEGER) AS x0, CAST(priority = '3-MEDIUM' AS INTEGER) AS x1,
  CAST(priority = '2-HIGH' AS INTEGER) AS x2, CAST(priority = '1-URGENT' AS INTEGER) AS x3 FROM leveled""")
def design_columns(spark, folder):
    df = with_priority(pairs(spark, folder), spark, folder)
    d = design(df, [Factor("priority", PRIORITIES)])
    out = d.select(df, F.col("grp"))
    return out.withColumns({f"x{i}": F.col(f"x{i}").cast("int") for i in range(4)})


_INTERACTION = """
g AS (SELECT kind_f AS k, CAST(disc_m > 0.05 AS INTEGER) AS h, CAST(sum(mixed) AS DOUBLE) AS s,
             CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY ALL),
l AS (SELECT k, h, ln(s / (n - s)) AS b, 1 / s + 1 / (n - s) AS v FROM g),
w AS (SELECT max(b) FILTER (k = 'A' AND h = 0) AS a0, max(b) FILTER (k = 'A' AND h = 1) AS a1,
             max(b) FILTER (k = 'R' AND h = 0) AS r0, max(b) FILTER (k = 'R' AND h = 1) AS r1,
             max(v) FILTER (k = 'A' AND h = 0) AS va0, max(v) FILTER (k = 'A' AND h = 1) AS va1,
             max(v) FILTER (k = 'R' AND h = 0) AS vr0, max(v) FILTER (k = 'R' AND h = 1) AS vr1 FROM l)"""


@query("M1_absorbed_individuals", more(OBS, """
src AS (SELECT ind, mass AS y, size_a AS a, disc AS b FROM measured
        WHERE ind IS NOT NULL AND mass IS NOT NULL AND size_a IS NOT NULL AND disc IS NOT NULL),
w AS (SELECT y - avg(y) OVER i AS y, a - avg(a) OVER i AS a, b - avg(b) OVER i AS b FROM src WINDOW i AS (PARTITION BY ind)),
s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS bo, sum(y * y) AS yy,
  count(*) - 2 - (SELECT count(DISTINCT ind) FROM src) AS df FROM w),
f AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * bo) / (aa * bb - ab * ab) AS ba,
  (aa * bo - ab * ay) / (aa * bb - ab * ab) AS b2 FROM s),
e AS (SELECT *, (yy - ba * ay - b2 * bo) / df AS s2 FROM f)""") + f"""
SELECT 'size_a' AS term, {r('ba', 4)} AS estimate, {r('sqrt(s2 * bb / det)', 4)} AS se FROM e
UNION ALL SELECT 'disc', {r('b2', 4)}, {r('sqrt(s2 * aa / det)', 4)} FROM e""")
def absorbed_individuals(spark, folder):
    """Slopes within individuals: one intercept for each of them, no column."""
    fit = m.fit_lm_within(measured(spark, folder), "mass", ["size_a", "disc"], "ind")
    table = m.coef_table(spark, fit).filter("term <> '(Intercept)'").select("term", "estimate", "se")
    return rounded(table, ["estimate", "se"], 4)


def _high(spark, folder):
    return pairs(spark, folder).withColumn("high", (F.col("disc_m") > 0.05).cast("int"))


@query("M5_interaction", more(PAIRS, _INTERACTION) + f"""
SELECT '(Intercept)' AS term, {r('a0')} AS estimate, {r('sqrt(va0)')} AS se FROM w
UNION ALL SELECT 'high', {r('a1 - a0')}, {r('sqrt(va0 + va1)')} FROM w
UNION ALL SELECT 'kind_f[R]', {r('r0 - a0')}, {r('sqrt(va0 + vr0)')} FROM w
UNION ALL SELECT 'high:kind_f[R]', {r('r1 - r0 - a1 + a0')}, {r('sqrt(va0 + va1 + vr0 + vr1)')} FROM w""")
def interaction(spark, folder):
    fit = m.fit_glm(_high(spark, folder), "mixed", [("high", "kind_f")], "binomial")
    return rounded(m.coef_table(spark, fit).select("term", "estimate", "se"), ["estimate", "se"])


@query("M6_fit_report", more(PAIRS, _SATURATED, """
dev AS (SELECT -2 * sum(s * ln(s / n) + (n - s) * ln(1 - s / n)) AS d, sum(n) AS n, count(*) AS k,
  -2 * (sum(s) * ln(sum(s) / sum(n)) + (sum(n) - sum(s)) * ln(1 - sum(s) / sum(n))) AS d0 FROM g)""") + f"""
SELECT 'by_period' AS model, 'n' AS name, n AS value FROM dev
UNION ALL SELECT 'by_period', 'parameters', CAST(k AS DOUBLE) FROM dev
UNION ALL SELECT 'by_period', 'df_residual', n - k FROM dev
UNION ALL SELECT 'by_period', 'deviance', {r('d', 5)} FROM dev
UNION ALL SELECT 'by_period', 'null_deviance', {r('d0', 5)} FROM dev
UNION ALL SELECT 'by_period', 'log_likelihood', {r('-d / 2', 5)} FROM dev
UNION ALL SELECT 'by_period', 'aic', {r('d + 2 * k', 5)} FROM dev""")
def fit_report(spark, folder):
    fit = m.fit_glm(pairs(spark, folder), "mixed", [Factor("period")], "binomial")
    return rounded(m.fit_stats(spark, {"by_period": fit}), ["value"], 5)


PROFILE = """profile AS (
  SELECT ind_hist_f, count(*) FILTER (mixed = 0) AS n_partners, max(kind_f) AS kind_f, sum(mixed) AS n_flagged, CAST(sum(mixed) > 2 AS INTEGER) AS often,
    CAST(sum(mixed) > 0 AS INTEGER) AS ever_flagged,
    sum(mixed) / count(DISTINCT period) AS share_periods,
    avg(mass_m) FILTER (mixed = 0) AS avg_mass, avg(size_a_m) FILTER (mixed = 0) AS avg_size,
    avg(disc_m) FILTER (mixed = 0) AS avg_disc, avg(adj_m) FILTER (mixed = 0) AS avg_adj
  FROM pairs GROUP BY ind_hist_f HAVING count(*) FILTER (mixed = 0) > 0)"""


def batch_specs(predictors: tuple[str, ...] = ("avg_mass", "avg_size")) -> list[m.Spec]:
    """Four responses by the predictors."""
    return [
        m.Spec(f"{y}~{x}", family, y, x)
        for y, family in (
            ("often", "binomial"), ("ever_flagged", "binomial"), ("n_flagged", "poisson"), ("share_periods", "poisson"))
        for x in predictors
    ]


def profiles(spark, folder):
    out = partner_profile(
        pairs(spark, folder), "ind_hist_f", "mixed",
        {"avg_mass": "mass_m", "avg_size": "size_a_m", "avg_disc": "disc_m", "avg_adj": "adj_m"}, constants=["kind_f"], period="period",
    )
    return out.withColumn("often", (F.col("n_flagged") > 2).cast("int"))


def batch_models(base: str, models: list[tuple[m.Spec, str]]) -> str:
    """`batch_ctes` of specs, each with the condition on the rows it is fitted to."""
    return batch_ctes(
        base, " UNION ALL ".join(batch_part(s, where) for s, where in models),
        "VALUES " + ", ".join(f"('{s.name}', '{s.predictor}')" for s, _ in models),
    )


def batch_ctes(base: str, parts: str, listed: str) -> str:
    """Newton steps of many one-predictor models in one recursive query, a state row per model.

    `parts` selects (model, pred, family, x, y) for all models, `listed` their names and predictors.
    """
    w = "CASE family WHEN 'binomial' THEN mu * (1 - mu) ELSE mu END"
    return more(
        base, f"listed(model, pred) AS ({listed})", f"src AS MATERIALIZED ({parts})",
        """scale AS MATERIALIZED (SELECT model, any_value(pred) AS pred, avg(x) AS mx, stddev_samp(x) AS sx,
  min(x) AS lo, max(x) AS hi, CASE any_value(family) WHEN 'binomial' THEN ln(avg(y) / (1 - avg(y))) ELSE ln(avg(y)) END AS start
  FROM src GROUP BY model
  HAVING stddev_samp(x) > 0 AND avg(y) > 0 AND (any_value(family) <> 'binomial' OR avg(y) < 1))""",
        "d AS MATERIALIZED (SELECT src.*, (x - mx) / sx AS z FROM src JOIN scale USING (model))",
        f"""steps AS (
  SELECT 0 AS i, model, start AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS va,
         CAST(0 AS DOUBLE) AS vb, CAST(0 AS DOUBLE) AS vab FROM scale
  UNION ALL
  SELECT i + 1, model, a + (w2 * g0 - w1 * g1) / (w0 * w2 - w1 * w1),
         b + (w0 * g1 - w1 * g0) / (w0 * w2 - w1 * w1),
         w2 / (w0 * w2 - w1 * w1), w0 / (w0 * w2 - w1 * w1), -w1 / (w0 * w2 - w1 * w1)
  FROM (SELECT i, model, any_value(a) AS a, any_value(b) AS b, sum(w) AS w0, sum(w * z) AS w1,
               sum(w * z * z) AS w2, sum(y - mu) AS g0, sum((y - mu) * z) AS g1
        FROM (SELECT *, {w} AS w FROM (
          SELECT i, model, a, b, z, y, family,
                 CASE family WHEN 'binomial' THEN 1 / (1 + exp(-(a + b * z))) ELSE exp(a + b * z) END AS mu
          FROM steps JOIN d USING (model) WHERE i < 12))
        GROUP BY i, model))""",
        """est AS (SELECT model, pred, a - b * mx / sx AS b0, b / sx AS b1,
  sqrt(va + vb * mx * mx / sx / sx - 2 * vab * mx / sx) AS se0, sqrt(vb) / sx AS se1
  FROM steps JOIN scale USING (model) WHERE i = 12),
last AS (SELECT model, max(a) FILTER (i = 12) - max(a) FILTER (i = 11) AS da,
  max(b) FILTER (i = 12) - max(b) FILTER (i = 11) AS db FROM steps GROUP BY model),
told AS (SELECT m.model, m.pred, CASE WHEN s.model IS NULL THEN 'no variation'
    WHEN abs(da) < 1e-6 AND abs(db) < 1e-6 THEN 'ok' ELSE 'not converged' END AS status
  FROM listed m LEFT JOIN scale s USING (model) LEFT JOIN last USING (model))""",
    )


def batch_part(spec: m.Spec, where: str = "true") -> str:
    return (
        f"SELECT '{spec.name}' AS model, '{spec.predictor}' AS pred, '{spec.family}' AS family, "
        f"{spec.predictor} AS x, CAST({spec.response} AS DOUBLE) AS y FROM profile "
        f"WHERE {spec.predictor} IS NOT NULL AND {where}"
    )


BATCH_COEFS = f"""
SELECT model, '(Intercept)' AS term, CASE status WHEN 'ok' THEN {r('b0', 4)} END AS estimate,
  CASE status WHEN 'ok' THEN {r('se0', 4)} END AS se, status FROM told LEFT JOIN est USING (model)
UNION ALL SELECT model, told.pred, CASE status WHEN 'ok' THEN {r('b1', 8)} END, CASE status WHEN 'ok' THEN {r('se1', 8)} END, status
FROM told LEFT JOIN est USING (model)"""


def batch_rounded(fits):
    return fits.select("model", "term", "estimate", "se", "status").withColumns({
        c: F.when(F.col("term") == "(Intercept)", F.round(c, 4)).otherwise(F.round(c, 8)) + 0.0
        for c in ("estimate", "se")
    })


def _batch_sql() -> str:
    return batch_models(more(PAIRS, PROFILE), [(s, "true") for s in batch_specs()]) + BATCH_COEFS


@query("M7_model_batch", _batch_sql())
def batch(spark, folder):
    return batch_rounded(m.fit_glm_grid(profiles(spark, folder), batch_specs()))


def _shifted(spark, folder):
    """Measures with a real effect of supplier and period, so variance parts are not zero."""
    df = measured(spark, folder).dropna(subset=["mass", "size_a"])
    shift = 12000 * F.sin(F.col("ind_hist").cast("double")) + 4000 * F.cos(F.col("period").cast("double"))
    return df.withColumn("shifted", (F.col("mass") + shift) / 1000.0)


_LMM = """
src AS (SELECT ind_hist AS g, size_a AS x,
               (mass + 12000 * sin(ind_hist) + 4000 * cos(period)) / 1000.0 AS y
        FROM measured WHERE mass IS NOT NULL AND size_a IS NOT NULL),
grp_sums AS MATERIALIZED (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy FROM src GROUP BY g),
tot AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx,
        sum(x * y) AS sxy, sum(y * y) AS syy FROM src),
search AS (
  SELECT 0 AS i, CAST(-6 AS DOUBLE) AS lo, CAST(4 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, best - (hi - lo) / 20, best + (hi - lo) / 20 FROM (
    SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, arg_min(lt, crit) AS best FROM (
      SELECT i, lo, hi, lt, (n - 2) * ln((m33 - (m13 * m13 * m22 - 2 * m12 * m13 * m23 + m23 * m23 * m11) / det)) + ld + ln(det) AS crit
      FROM (SELECT *, m11 * m22 - m12 * m12 AS det FROM (
        SELECT i, lo, hi, lt, any_value(t.n) AS n, sum(ln(1 + s.n * pow(10, lt))) AS ld,
          any_value(t.n) - sum(c * s.n * s.n) AS m11, any_value(t.sx) - sum(c * s.n * s.sx) AS m12,
          any_value(t.sxx) - sum(c * s.sx * s.sx) AS m22, any_value(t.sy) - sum(c * s.n * s.sy) AS m13,
          any_value(t.sxy) - sum(c * s.sx * s.sy) AS m23, any_value(t.syy) - sum(c * s.sy * s.sy) AS m33
        FROM (SELECT i, lo, hi, lt, gs.n, gs.sx, gs.sy, pow(10, lt) / (1 + gs.n * pow(10, lt)) AS c
              FROM (SELECT i, lo, hi, lo + (hi - lo) * k / 40.0 AS lt FROM search, range(41) r(k) WHERE i < 9) p, grp_sums gs) s, tot t
        GROUP BY i, lo, hi, lt)))
    GROUP BY i)),
theta AS (SELECT pow(10, (lo + hi) / 2) AS th FROM search WHERE i = 9),
mm AS (SELECT any_value(t.n) AS n, any_value(t.n) - sum(c * s.n * s.n) AS m11, any_value(t.sx) - sum(c * s.n * s.sx) AS m12,
          any_value(t.sxx) - sum(c * s.sx * s.sx) AS m22, any_value(t.sy) - sum(c * s.n * s.sy) AS m13,
          any_value(t.sxy) - sum(c * s.sx * s.sy) AS m23, any_value(t.syy) - sum(c * s.sy * s.sy) AS m33, any_value(th) AS th
       FROM (SELECT gs.*, th, th / (1 + gs.n * th) AS c FROM grp_sums gs, theta) s, tot t),
fitted AS (SELECT *, m11 * m22 - m12 * m12 AS det,
  (m33 - (m13 * m13 * m22 - 2 * m12 * m13 * m23 + m23 * m23 * m11) / (m11 * m22 - m12 * m12)) / (n - 2) AS s2 FROM mm)"""


@query("M8_random_intercept", more(OBS, _LMM) + f"""
SELECT '(Intercept)' AS term, {r('(m22 * m13 - m12 * m23) / det', 4)} AS estimate, {r('sqrt(s2 * m22 / det)', 4)} AS se FROM fitted
UNION ALL SELECT 'size_a', {r('(m11 * m23 - m12 * m13) / det', 4)}, {r('sqrt(s2 * m11 / det)', 4)} FROM fitted
UNION ALL SELECT 'sd group', {r('sqrt(s2 * th)', 4)}, NULL FROM fitted
UNION ALL SELECT 'sd residual', {r('sqrt(s2)', 4)}, NULL FROM fitted""")
def random_intercept(spark, folder):
    fit = mixed.fit_lmm(_shifted(spark, folder), "shifted", ["size_a"], "ind_hist")
    out = m.coef_table(spark, fit).select("term", "estimate", "se")
    parts = spark.createDataFrame(
        [("sd group", fit.stats["group_sd"], None), ("sd residual", fit.stats["sigma"], None)],
        "term string, estimate double, se double",
    )
    return rounded(out.union(parts), ["estimate", "se"], 4)


@query("M9_crossed_intercepts")
def crossed_intercepts(spark, folder):
    df = _shifted(spark, folder).withColumn("high", (F.col("disc") > 0.05).cast("int"))
    fit = mixed.fit_lmm(df, "shifted", ["size_a", ("high", "kind")], "ind_hist", "period")
    out = m.coef_table(spark, fit)
    sds = spark.createDataFrame(
        [(k, float(v), None, None, None, fit.status) for k, v in fit.stats.items() if k.endswith("sd") or k == "sigma"],
        out.schema,
    )
    return out.union(sds)


def _binary(spark, folder):
    """0/1 response with a supplier effect, and two covariates."""
    df = observations(spark, folder)
    cut = 25 + 8 * F.sin(F.col("ind_hist").cast("double"))
    return df.withColumns({
        "large": (F.col("size_a") > cut).cast("int"), "mass_k": F.col("mass") / 1000.0,
        "high": (F.col("disc") > 0.05).cast("int"),
    })


@query("M10_logistic_intercepts")
def logistic_intercepts(spark, folder):
    fit = mixed.fit_glmm(_binary(spark, folder), "large", [("high", "kind")], "ind_hist")
    out = m.coef_table(spark, fit)
    return out.union(spark.createDataFrame(
        [("group sd", fit.stats.get("group_sd"), None, None, None, fit.status)], out.schema
    ))


@query("M10_logistic_intercepts_continuous")
def logistic_intercepts_continuous(spark, folder):
    df = _binary(spark, folder)
    fit = mixed.fit_glmm(df, "high", ["mass_k"], "period")
    return m.coef_table(spark, fit)


@query("M10_individual_intercepts")
def individual_intercepts(spark, folder):
    """Continuous predictors, and an intercept for each of thousands of individuals."""
    fit = mixed.fit_glmm(_binary(spark, folder), "large", ["disc", "tax"], "ind")
    out = m.coef_table(spark, fit)
    return out.union(spark.createDataFrame(
        [("group sd", fit.stats.get("group_sd"), None, None, None, fit.status)], out.schema
    ))


_AIC = """
k AS (SELECT kind_f, CAST(sum(mixed) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY kind_f),
p AS (SELECT period, CAST(sum(mixed) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY period),
aics AS (
  SELECT 'by_kind' AS model, CAST(count(*) AS INTEGER) AS parameters,
    -2 * sum(s * ln(s / n) + (n - s) * ln(1 - s / n)) + 2 * count(*) AS aic FROM k
  UNION ALL SELECT 'by_period', CAST(count(*) AS INTEGER),
    -2 * sum(s * ln(s / n) + (n - s) * ln(1 - s / n)) + 2 * count(*) FROM p)"""


@query("M11_compare_fits", more(PAIRS, _AIC) + f"""
SELECT model, parameters, {r('aic', 5)} AS aic, {r('aic - (SELECT min(aic) FROM aics)', 5)} AS delta FROM aics""")
def compare(spark, folder):
    df = pairs(spark, folder)
    fits = {
        "by_kind": m.fit_glm(df, "mixed", ["kind_f"], "binomial"),
        "by_period": m.fit_glm(df, "mixed", [Factor("period")], "binomial"),
    }
    return rounded(m.compare_fits(spark, fits), ["aic", "delta"], 5)


@query("M12_predict_grid", more(PAIRS, _INTERACTION) + f"""
SELECT k AS kind_f, h AS high, {r('1 / (1 + exp(-b))')} AS predicted FROM l""")
def predict(spark, folder):
    df = _high(spark, folder)
    fit = m.fit_glm(df, "mixed", [("high", "kind_f")], "binomial")
    grid = level_grid(spark, {"kind_f": ["A", "R"], "high": [0, 1]})
    return rounded(m.predict_grid(fit, grid), ["predicted"])


_Z = "1.959963984540054"


@query("M13_marginal_predictions", more(PAIRS, _INTERACTION) + f"""
SELECT k AS kind_f, h AS high, {r('1 / (1 + exp(-b))')} AS predicted, {r('sqrt(v)')} AS se_link,
  {r(f'1 / (1 + exp(-(b - {_Z} * sqrt(v))))')} AS low, {r(f'1 / (1 + exp(-(b + {_Z} * sqrt(v))))')} AS high_end FROM l""")
def marginal(spark, folder):
    fit = m.fit_glm(_high(spark, folder), "mixed", [("high", "kind_f")], "binomial")
    grid = level_grid(spark, {"kind_f": ["A", "R"], "high": [0, 1]}).withColumn("_h", F.col("high"))
    out = m.marginal_predictions(fit, grid).withColumnsRenamed({"high": "high_end", "_h": "high"})
    return rounded(out, ["predicted", "se_link", "low", "high_end"])


@query("M14_residuals", OBS + f""", l AS (SELECT regr_slope(mass, size_a) AS b, regr_intercept(mass, size_a) AS a FROM measured)
SELECT grp, line, ind, {r('mass - a - b * size_a', 3)} AS residual FROM measured, l""")
def residuals(spark, folder):
    df = measured(spark, folder)
    out = m.with_residual(df, m.fit_lm(df, "mass", ["size_a"]))
    return rounded(out.select("grp", "line", "ind", "residual"), ["residual"], 3)


@query("M15_term_test", more(OBS, """
g AS (SELECT period, CAST(count(*) AS DOUBLE) AS n, avg(mass) AS m, var_samp(mass) * (count(*) - 1) AS ss
      FROM ranged WHERE mass IS NOT NULL GROUP BY period),
t AS (SELECT sum(n * m) / sum(n) AS mean, sum(ss) / (sum(n) - count(*)) AS s2 FROM g)""") + f"""
SELECT 'period' AS term, {r('sum(n * (m - mean) * (m - mean)) / any_value(s2)', 5)} AS statistic,
  CAST(count(*) - 1 AS INTEGER) AS df FROM g, t""")
def effect_test(spark, folder):
    fit = m.fit_lm(measured(spark, folder), "mass", [Factor("period")])
    test = m.term_test(fit, "period")
    out = spark.createDataFrame(
        [("period", float(test["statistic"]), test["df"])], "term string, statistic double, df int"
    )
    return rounded(out, ["statistic"], 5)


def observer_ctes(table: str, measures: list[str]) -> list[str]:
    """Restricted likelihood of measures on the five order priorities, random period, by a grid narrowed in rounds.

    A matrix row per point holds the cross-products of the five levels and the measure; sweeping the levels
    leaves the residual squares. The test compares them with those of the mean alone.
    """
    sweep = "m, ld FROM (SELECT * FROM m{i})"
    for k in range(1, 6):
        sweep = (f"[[m[i][j] - m[i][{k}] * m[{k}][j] / m[{k}][{k}] FOR j IN range(1, 7)] FOR i IN range(1, 7)] AS m, "
                 f"ld + ln(m[{k}][{k}]) AS ld FROM (SELECT measure, th, alone, {sweep})")
    out = [
        "lng AS MATERIALIZED (" + " UNION ALL ".join(
            f"SELECT '{m}' AS measure, o_orderpriority AS l, period AS g, CAST({m} AS DOUBLE) AS y "
            f"FROM {table} JOIN orders ON grp = o_orderkey WHERE {m} IS NOT NULL AND period IS NOT NULL" for m in measures) + ")",
        """cen AS MATERIALIZED (SELECT measure, g, dense_rank() OVER (PARTITION BY measure ORDER BY l) AS l,
  y - avg(y) OVER (PARTITION BY measure) AS y FROM lng)""",
        "gn AS MATERIALIZED (SELECT measure, g, CAST(count(*) AS DOUBLE) AS n FROM cen GROUP BY ALL)",
        """v AS MATERIALIZED (SELECT measure, g, j, sum(v) AS v FROM (
  SELECT measure, g, l AS j, 1.0::DOUBLE AS v FROM cen UNION ALL SELECT measure, g, 6, y FROM cen
  UNION ALL SELECT measure, g, unnest(range(1, 7)), 0 FROM gn) GROUP BY ALL)""",
        """tot AS MATERIALIZED (SELECT measure, l AS a, l AS b, CAST(count(*) AS DOUBLE) AS t FROM cen GROUP BY ALL
  UNION ALL SELECT measure, l, 6, sum(y) FROM cen GROUP BY ALL UNION ALL SELECT measure, 6, l, sum(y) FROM cen GROUP BY ALL
  UNION ALL SELECT measure, 6, 6, sum(y * y) FROM cen GROUP BY ALL)""",
        f"""p0 AS (SELECT DISTINCT measure, unnest(list_append([pow(10, {mixed.LEAST} + k * ({mixed.MOST} - ({mixed.LEAST})) / 32.0)
  FOR k IN range(0, 33)], 0)) AS th FROM gn)""",
    ]
    for i in range(6):
        width = f"({mixed.MOST} - ({mixed.LEAST})) / 32.0 / pow(16, {i})"
        out += [
            f"""o{i} AS (SELECT measure, th, x.j AS a, z.j AS b, sum(th / (1 + n * th) * x.v * z.v) AS o
  FROM p{i} JOIN gn USING (measure) JOIN v x USING (measure, g) JOIN v z USING (measure, g) GROUP BY ALL)""",
            f"""m{i} AS (SELECT measure, th, list(vals ORDER BY a) AS m, CAST(0 AS DOUBLE) AS ld,
    sum(part) FILTER (a < 6) AS mm, sum(tail) FILTER (a < 6) AS my, sum(tail) FILTER (a = 6) AS yy, yy - my * my / mm AS alone
  FROM (SELECT measure, th, a, list(coalesce(t, 0) - o ORDER BY b) AS vals,
          sum(coalesce(t, 0) - o) FILTER (b < 6) AS part, sum(coalesce(t, 0) - o) FILTER (b = 6) AS tail
        FROM o{i} LEFT JOIN tot USING (measure, a, b) GROUP BY measure, th, a) GROUP BY measure, th)""",
            f"""c{i} AS MATERIALIZED (SELECT s.measure, th, any_value(alone) AS alone, any_value(m[6][6]) AS rss, sum(n) AS n,
    (sum(n) - 5) * ln(any_value(m[6][6])) + any_value(ld) + sum(ln(1 + n * th)) AS crit
  FROM (SELECT measure, th, alone, {sweep.format(i=i)}) s JOIN gn USING (measure) GROUP BY s.measure, th)""",
            f"b{i} AS MATERIALIZED (SELECT measure, arg_min(th, crit) AS th FROM c{i} GROUP BY measure)",
            f"""p{i + 1} AS (SELECT measure, unnest(CASE WHEN th = 0 THEN [CAST(0 AS DOUBLE)] ELSE list_distinct(list_append([pow(10, log10(th) - {width}
  + k * {width} / 16) FOR k IN range(0, 33)], th)) END) AS th FROM b{i})""",
        ]
    return [*out, """told AS (SELECT measure, CAST(n AS BIGINT) AS n, sqrt(rss / (n - 5)) AS sigma, sqrt(rss / (n - 5) * th) AS group_sd,
  (alone - rss) / (rss / (n - 5)) AS statistic FROM c5 JOIN b5 USING (measure, th))"""]


# One statistic on four degrees of freedom.
OBSERVER = f"""SELECT measure, n, {r('sigma', 4)} AS sigma, {r('group_sd', 2)} AS group_sd, {r('statistic', 4)} AS statistic,
  CAST(4 AS INTEGER) AS df, {r('exp(-statistic / 2) * (1 + statistic / 2)', 5)} AS p_value FROM told"""


def observer_rounded(df):
    return rounded(df, {"sigma": 4, "group_sd": 2, "statistic": 4, "p_value": 5})


@query("M16_observer_effect", more(OBS, *observer_ctes("measured", ["mass", "size_a"])) + OBSERVER)
def observer(spark, folder):
    df = with_priority(measured(spark, folder), spark, folder)
    return observer_rounded(mixed.observer_effect(df, "priority", ["mass", "size_a"], "period"))


_CURVE = batch_ctes(
    PAIRS, "SELECT kind_f AS model, 'day_f' AS pred, 'binomial' AS family, "
    "CAST(day_f AS DOUBLE) AS x, CAST(mixed AS DOUBLE) AS y FROM pairs",
    "SELECT DISTINCT kind_f, 'day_f' FROM pairs",
)
_ETA = "(a + b * (x - mx) / sx)"
_SE = "sqrt(va + 2 * vab * (x - mx) / sx + vb * (x - mx) / sx * (x - mx) / sx)"


@query("C8_logistic_curve", _CURVE + f"""
SELECT kind_f, day_f, CASE status WHEN 'ok' THEN predicted END AS predicted, CASE status WHEN 'ok' THEN se_link END AS se_link,
  CASE status WHEN 'ok' THEN low END AS low, CASE status WHEN 'ok' THEN high END AS high
FROM (SELECT model AS kind_f, status, {r('x', 6)} AS day_f, {r(f'1 / (1 + exp(-{_ETA}))', 5)} AS predicted,
  {r(_SE, 5)} AS se_link, {r(f'1 / (1 + exp(-({_ETA} - {_Z} * {_SE})))', 5)} AS low,
  {r(f'1 / (1 + exp(-({_ETA} + {_Z} * {_SE})))', 5)} AS high
FROM (SELECT *, lo + k * (hi - lo) / 39 AS x FROM steps JOIN scale USING (model) JOIN (SELECT model, status FROM told) USING (model),
      range(40) t(k) WHERE i = 12))""")
def logistic_curve(spark, folder):
    curve = charts.logistic_curve(pairs(spark, folder), "day_f", "mixed", "kind_f", 40)
    return rounded(curve, {"day_f": 6, "predicted": 5, "se_link": 5, "low": 5, "high": 5})
