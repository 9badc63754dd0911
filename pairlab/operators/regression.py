"""Linear, logistic and Poisson regression, predictions, residuals and term tests."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.columns import inv_logit
from pairlab.functions.tails import chi2_tail, normal_p, normal_two_sided, student_two_sided
from pairlab.operators.design import Design, Factor, Term, design
from pairlab.operators.spread import ROWS, attach, attach_few, kept, per_key, small_table
from pairlab.session import cut_lineage

Z95 = 1.959963984540054
# Cross-products of up to this many columns (78 sums) stay in generated code.
JVM_WIDTH = 12


@dataclass
class Fit:
    """A fitted model: coefficients (intercept first), their covariance and one-row statistics."""

    family: str
    response: str
    design: Design
    beta: np.ndarray
    cov: np.ndarray
    stats: dict[str, float]
    p_values: list[float] | None = None
    group: str | None = None
    group_effects: DataFrame | None = None
    period: str | None = None
    period_effects: Mapping = field(default_factory=dict)
    # Terms that the others determine: no estimate, and no prediction where they are not 0.
    aliased: Mapping[str, Column] = field(default_factory=dict)
    # Those of them that are constant in every level of `group`: the level's effect holds them.
    absorbed: tuple[str, ...] = ()
    status: str = "ok"

    @property
    def names(self) -> list[str]:
        return ["(Intercept)", *self.design.names]

    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))


def coef_table(spark: SparkSession, fit: Fit) -> DataFrame:
    """(term, estimate, se, statistic, p_value, status). p is Wald z unless the fit brought its own.

    Terms that the others determine are `aliased`, with no numbers; nor has a model that
    did not converge any.
    """
    rows = []
    for i, (name, b, s) in enumerate(zip(fit.names, fit.beta, fit.se())):
        if fit.status != "ok":
            rows.append((name, None, None, None, None, fit.status))
            continue
        z = float(b / s) if s > 0 else None
        p = fit.p_values[i] if fit.p_values else (None if z is None else normal_two_sided(z))
        rows.append((name, float(b), float(s), z, None if p is None else float(p), fit.status))
    rows += [(name, None, None, None, None, "aliased") for name in fit.aliased]
    return spark.createDataFrame(
        rows, "term string, estimate double, se double, statistic double, p_value double, status string"
    )


def fit_stats(spark: SparkSession, fits: Mapping[str, Fit]) -> DataFrame:
    """One row per fit and statistic: (model, name, value)."""
    rows = [(m, k, float(v)) for m, f in fits.items() for k, v in f.stats.items()]
    return spark.createDataFrame(rows, "model string, name string, value double")


def compare_fits(spark: SparkSession, fits: Mapping[str, Fit]) -> DataFrame:
    """Parameters and AIC per model, with the distance to the best AIC.

    Fits without AIC (linear mixed models, models that did not converge) cannot be compared.
    """
    without = [m for m, f in fits.items() if "aic" not in f.stats]
    if without:
        raise ValueError(f"no AIC for {', '.join(without)}")
    if len({f.stats["n"] for f in fits.values()}) > 1:
        raise ValueError("models fitted to different rows cannot be compared by AIC")
    best = min((f.stats["aic"] for f in fits.values()), default=0.0)
    rows = [
        (m, int(f.stats["parameters"]), float(f.stats["aic"]), float(f.stats["aic"] - best))
        for m, f in fits.items()
    ]
    return spark.createDataFrame(rows, "model string, parameters int, aic double, delta double")


def gram(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> np.ndarray:
    """Weighted cross-products of columns.

    A narrow set is summed by Spark itself; a wide one (many dummy columns) goes through
    Arrow, each task returning one small matrix.
    """
    cols = list(cols)
    width = len(cols)
    if width <= JVM_WIDTH:
        cells = [(i, j) for i in range(width) for j in range(i, width)]
        w = F.col(weight) if weight else F.lit(1.0)
        sums = df.agg(*[
            F.sum(F.col(cols[i]) * F.col(cols[j]) * w).alias(f"{i}_{j}") for i, j in cells
        ]).first()
        out = np.zeros((width, width))
        for (i, j), value in zip(cells, sums):
            out[i, j] = out[j, i] = value
        return out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch[cols].to_numpy(dtype=float)
            w = batch[weight].to_numpy(dtype=float)[:, None] if weight else 1.0
            total += x.T @ (x * w)
        yield pd.DataFrame({"cell": np.arange(width * width), "value": total.ravel()})

    names = cols if weight is None or weight in cols else [*cols, weight]
    sums = (
        df.select(*names).mapInPandas(partial, "cell int, value double")
        .groupBy("cell").agg(F.sum("value").alias("value")).collect()
    )
    out = np.zeros(width * width)
    for row in sums:
        out[row.cell] = row.value
    return out.reshape(width, width)


def model_frame(df: DataFrame, y: str, d: Design, family: str) -> DataFrame:
    """Complete rows as (y, x0, x1, ..., w); equal rows of discrete models are counted once.

    With only factors and whole numbers the frame has one row per covariate pattern, so
    iterations no longer depend on the number of observations. For `binomial` a pattern
    carries its share of ones.
    """
    rows = df.dropna(subset=[y, *d.inputs])
    frame = d.select(rows, F.col(y).cast("double").alias("y"))
    if not d.discrete:
        return frame.withColumn("w", F.lit(1.0))
    count = F.count(F.lit(1)).cast("double").alias("w")
    if family == "binomial":
        xs = [f"x{i}" for i in range(d.width)]
        return frame.groupBy(*xs).agg(F.avg("y").alias("y"), count)
    return frame.groupBy(*frame.columns).agg(count)


def independent(cross: np.ndarray, tol: float = 1e-11) -> list[int]:
    """Columns that those before them do not determine, from their cross-products (intercept first)."""
    kept: list[int] = []
    for j in range(len(cross)):
        rest = cross[j, j]
        if kept and rest > 0:
            rest -= cross[j, kept] @ np.linalg.solve(cross[np.ix_(kept, kept)], cross[kept, j])
        if rest > tol * abs(cross[j, j]):
            kept.append(j)
    return kept


def estimable(rows: DataFrame, d: Design) -> tuple[Design, dict[str, Column]]:
    """The design without the columns that others determine, and those.

    Columns are scaled to their largest value; what is left of one besides those before it decides.
    """
    if not d.width:
        return d, {}
    xs = [f"x{i}" for i in range(d.width)]
    frame = d.select(rows)
    largest = frame.agg(*[F.max(F.abs(x)).alias(x) for x in xs]).first()
    scaled = frame.select(F.lit(1.0).alias("_one"), *[
        (F.col(x) / F.lit(float(largest[x] or 1.0))).alias(x) for x in xs
    ])
    cross = np.nan_to_num(np.array(gram(scaled, ["_one", *xs]), dtype=float))
    kept = [j - 1 for j in independent(cross) if j]
    aliased = {d.names[i]: d.columns[i] for i in range(d.width) if i not in kept}
    return (d.only(kept) if aliased else d), aliased


@contextmanager
def model_rows(df: DataFrame, *cols: str):
    """The complete rows of the model columns, kept while a fit passes over them."""
    rows = df.select(*dict.fromkeys(cols)).dropna().persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def term_inputs(terms: Sequence[Term]) -> list[str]:
    """Input columns named by a list of terms."""
    out = []
    for term in terms:
        for t in term if isinstance(term, tuple) else (term,):
            out.append(t.col if isinstance(t, Factor) else t)
    return list(dict.fromkeys(out))


def _assembled(frame: DataFrame, d: Design) -> DataFrame:
    columns = [f"x{i}" for i in range(d.width)]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(frame)


def fit_lm(df: DataFrame, y: str, terms: Sequence[Term]) -> Fit:
    """Least squares with t statistics."""
    with model_rows(df, y, *term_inputs(terms)) as rows:
        return _fit_lm(rows, y, terms)


def _fit_lm(rows: DataFrame, y: str, terms: Sequence[Term]) -> Fit:
    """Two passes, of sums alone: means, then cross-products about them."""
    d, aliased = estimable(rows.dropna(subset=[y]), design(rows, terms))
    xs = [f"x{i}" for i in range(d.width)]
    frame = d.select(rows, F.col(y).cast("double").alias("y"))
    means = frame.agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(c).alias(c) for c in (*xs, "y")]).first()
    n, p = float(means["n"]), d.width + 1
    centre = np.array([means[c] if means[c] is not None else np.nan for c in xs], dtype=float)
    if n <= p:
        nothing = np.full(p, np.nan)
        return Fit("gaussian", y, d, nothing, np.full((p, p), np.nan), {"n": n, "parameters": p, "df_residual": n - p},
                   aliased=aliased, status="too few rows")
    about = frame.select(*[(F.col(c) - F.lit(float(means[c]))).alias(c) for c in (*xs, "y")])
    cross = gram(about, [*xs, "y"])
    slopes = np.linalg.solve(cross[:-1, :-1], cross[:-1, -1]) if xs else np.zeros(0)
    beta = np.append(means["y"] - slopes @ centre, slopes)
    total = cross[-1, -1]
    residual = max(total - slopes @ cross[:-1, -1], 0.0)
    sigma2 = residual / (n - p)
    inverse = np.linalg.inv(cross[:-1, :-1])
    cov = sigma2 * np.block([
        [np.array([[1 / n + centre @ inverse @ centre]]), -(centre @ inverse)[None, :]],
        [-(inverse @ centre)[:, None], inverse],
    ])
    loglik = -n / 2 * (np.log(2 * np.pi * residual / n) + 1) if residual else np.inf
    stats = {
        "n": n, "parameters": p, "df_residual": n - p, "sigma": float(np.sqrt(sigma2)),
        "r2": float(1 - residual / total) if total else np.nan, "deviance": float(residual),
        "log_likelihood": float(loglik), "aic": float(-2 * loglik + 2 * (p + 1)),
    }
    tails = [student_two_sided(b / s, n - p) if s > 0 else None for b, s in zip(beta, np.sqrt(np.diag(cov)))]
    return Fit("gaussian", y, d, beta, cov, stats, p_values=tails, aliased=aliased)


def fit_lm_within(df: DataFrame, y: str, terms: Sequence[Term], absorb: str) -> Fit:
    """Least squares with an intercept for every level of `absorb`, however many, without a column for any.

    Cross-products about the levels' means are those about the overall means less those of the levels' means,
    so no row meets its level, nothing per level comes to the driver, and a level holding most rows
    costs its scan. Slopes are those of a fit with `absorb` as a factor; the intercept is the mean of the
    levels' over the rows, `group_effects` their distances to it. Terms constant in every level are aliased.
    """
    with model_rows(df, y, absorb, *term_inputs(terms)) as rows:
        return _fit_lm_within(rows, y, terms, absorb)


def _fit_lm_within(rows: DataFrame, y: str, terms: Sequence[Term], absorb: str) -> Fit:
    d = design(rows, terms)
    names = [*[f"x{i}" for i in range(d.width)], "y"]
    frame = d.select(rows, F.col(absorb).alias("_g"), F.col(y).cast("double").alias("y"))
    means = frame.agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(c).alias(c) for c in names]).first()
    n = float(means["n"])
    about = frame.select("_g", *[(F.col(c) - F.lit(means[c])).alias(c) for c in names])
    levels = cut_lineage(per_key(about, ["_g"], *[F.sum(c).alias(c) for c in names]))
    apart = levels.select(*[(F.col(c) / F.sqrt(ROWS)).alias(c) for c in names])
    whole = np.array(gram(about, names), dtype=float)
    within = whole - np.array(gram(apart, names), dtype=float)
    varying = [j for j in range(d.width) if within[j, j] > 1e-11 * whole[j, j]]
    used = [varying[j] for j in independent(within[np.ix_(varying, varying)])]
    aliased, names_of = {d.names[j]: d.columns[j] for j in range(d.width) if j not in used}, d.names
    d = d.only(used) if aliased else d
    p, n_levels = len(used) + 1, levels.count()
    left = n - n_levels - len(used)
    stats = {"n": n, "parameters": n_levels + len(used), "levels": n_levels, "df_residual": left}
    if left <= 0:
        return Fit("gaussian", y, d, np.full(p, np.nan), np.full((p, p), np.nan), stats, aliased=aliased, status="too few rows")
    cross, right = within[np.ix_(used, used)], within[used, -1]
    slopes = np.linalg.solve(cross, right) if used else np.zeros(0)
    centre = np.array([means[names[j]] for j in used], dtype=float)
    residual = max(within[-1, -1] - slopes @ right, 0.0)
    sigma2 = residual / left
    inverse = np.linalg.inv(cross) if used else np.zeros((0, 0))
    cov = sigma2 * np.block([
        [np.array([[1 / n + centre @ inverse @ centre]]), -(centre @ inverse)[None, :]],
        [-(inverse @ centre)[:, None], inverse],
    ])
    beta = np.append(means["y"] - slopes @ centre, slopes)
    stats |= {
        "sigma": float(np.sqrt(sigma2)), "deviance": float(residual),
        "r2": float(1 - residual / whole[-1, -1]) if whole[-1, -1] else np.nan,
        "r2_within": float(1 - residual / within[-1, -1]) if within[-1, -1] > 0 else np.nan,
    }
    effect = F.col("y")
    for j, b in zip(used, slopes):
        effect = effect - F.lit(float(b)) * F.col(names[j])
    effects = levels.select(F.col("_g").alias(absorb), ROWS, (effect / F.col(ROWS)).alias("_effect"))
    tails = [student_two_sided(b / s, left) if s > 0 else None for b, s in zip(beta, np.sqrt(np.diag(cov)))]
    return Fit(
        "gaussian", y, d, beta, cov, stats, p_values=tails, group=absorb, group_effects=effects, aliased=aliased,
        absorbed=tuple(names_of[j] for j in range(len(names_of)) if j not in varying),
    )


def fit_glm(df: DataFrame, y: str, terms: Sequence[Term], family: str) -> Fit:
    """Logistic (`binomial`) or Poisson regression on Spark's own solver."""
    if family not in ("binomial", "poisson"):
        raise ValueError(f"family must be binomial or poisson, not {family!r}")
    with model_rows(df, y, *term_inputs(terms)) as rows:
        return fit_glm_rows(rows, y, terms, family)


def fit_glm_rows(rows: DataFrame, y: str, terms: Sequence[Term], family: str, rounds: int = 60) -> Fit:
    """`fit_glm` on complete rows that are already kept.

    Aliased terms are left out. A model that does not converge, as on separable data, has a
    status that says so and no estimates.
    """
    d, aliased = estimable(rows.dropna(subset=[y]), design(rows, terms))
    p = d.width + 1

    def failed(n: float, status: str) -> Fit:
        nothing = np.full((p, p), np.nan)
        return Fit(family, y, d, nothing[0], nothing, {"n": n, "parameters": p, "df_residual": n - p},
                   aliased=aliased, status=status)

    frame = model_frame(rows, y, d, family)
    frame = _assembled(frame, d) if d.width else frame
    if d.discrete:
        frame = frame.persist()
    try:
        n, ones = frame.agg(F.sum("w"), F.sum(F.expr("w * y"))).first()
        if not n:
            return failed(0.0, "too few rows")
        if not d.width or ones == 0 or (family == "binomial" and ones == n):
            return failed(n, "no variation")
        model = GeneralizedLinearRegression(
            family=family, labelCol="y", weightCol="w", tol=1e-12, maxIter=rounds
        ).fit(frame)
        summary = model.summary
        if summary.numIterations >= rounds:
            return failed(n, "not converged")
        beta = np.concatenate([[model.intercept], model.coefficients.toArray()])
        eta = F.lit(float(beta[0]))
        for i, b in enumerate(beta[1:]):
            eta = eta + F.lit(float(b)) * F.col(f"x{i}")
        mu = inv_logit(eta) if family == "binomial" else F.exp(eta)
        weight = F.col("w") * (mu * (1 - mu) if family == "binomial" else mu)
        xs = [f"x{i}" for i in range(d.width)]
        work = frame.withColumns({"_one": F.lit(1.0), "_w": weight})
        information = gram(work, ["_one", *xs], "_w")
        # where the response is certain, nothing is left to tell the terms apart
        if len(independent(information)) < p:
            return failed(n, "not converged")
        cov = np.linalg.inv(information)
        likelihood = F.expr("w") * (F.col("y") * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta))))
        loglik = frame.agg(F.sum(likelihood)).first()[0]
        stats = {"n": n, "parameters": p, "df_residual": n - p}
        if family == "binomial":
            # of single 0/1 rows, whether or not they were counted by pattern
            share = ones / n
            null = n * (share * np.log(share) + (1 - share) * np.log1p(-share))
            stats |= {
                "deviance": -2 * loglik, "null_deviance": float(-2 * null), "log_likelihood": float(loglik),
                "aic": -2 * loglik + 2 * p,
            }
        else:
            stats |= {
                "deviance": summary.deviance, "null_deviance": summary.nullDeviance,
                "log_likelihood": p - summary.aic / 2, "aic": summary.aic,
            }
    finally:
        frame.unpersist()
    return Fit(family, y, d, beta, cov, stats, aliased=aliased)


def linear_predictor(fit: Fit) -> Column:
    if fit.status != "ok":
        return F.lit(None).cast("double")
    eta = F.lit(float(fit.beta[0]))
    for c, b in zip(fit.design.columns, fit.beta[1:]):
        eta = eta + F.lit(float(b)) * c
    for c in fit.aliased.values():
        eta = eta + F.when(c == 0, F.lit(0.0))
    for condition in fit.design.known.values():
        eta = F.when(condition, eta)
    return eta


def response_scale(fit: Fit, eta: Column) -> Column:
    if fit.family == "binomial":
        return inv_logit(eta)
    return F.exp(eta) if fit.family == "poisson" else eta


def predict_grid(fit: Fit, grid: DataFrame, out: str = "predicted") -> DataFrame:
    """Predicted response for each row of a grid, random part at zero."""
    return grid.withColumn(out, response_scale(fit, linear_predictor(fit)))


def at_typical(fit: Fit, grid: DataFrame, rows: DataFrame) -> DataFrame:
    """`grid` with the model's columns that it lacks: factors at their reference, numbers at the mean of
    the complete `rows`."""
    missing = [c for c in fit.design.inputs if c not in grid.columns]
    numbers = [c for c in missing if c not in fit.design.reference]
    means = {}
    if numbers:
        complete = rows.dropna(subset=[fit.response, *fit.design.inputs])
        means = complete.agg(*[F.avg(c).alias(c) for c in numbers]).first().asDict()
    return grid.withColumns({c: F.lit(fit.design.reference.get(c, means.get(c))) for c in missing})


def marginal_predictions(fit: Fit, grid: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Prediction with a 95 % interval: normal on the link scale, then back-transformed.

    With the model's `rows` the grid may name some of the terms only; the others are held as in
    `at_typical`.
    """
    grid = grid if rows is None else at_typical(fit, grid, rows)
    columns = [F.lit(1.0), *fit.design.columns]
    variance = F.lit(0.0)
    for i, a in enumerate(columns if fit.status == "ok" else []):
        for j in range(i, len(columns)):
            scale = float(fit.cov[i, j]) * (1.0 if i == j else 2.0)
            variance = variance + F.lit(scale) * a * columns[j]
    work = grid.withColumns({"_eta": linear_predictor(fit), "_se": F.sqrt(F.greatest(variance, F.lit(0.0)))})
    eta, half = F.col("_eta"), F.lit(Z95) * F.col("_se")
    return work.withColumns({
        "predicted": response_scale(fit, eta),
        "se_link": F.col("_se"),
        "low": response_scale(fit, eta - half),
        "high": response_scale(fit, eta + half),
    }).drop("_eta", "_se")


def with_residual(df: DataFrame, fit: Fit, out: str = "residual") -> DataFrame:
    """Response minus fitted value; NULL on rows with a missing model column.

    Random intercepts, where the fit has them, count as fitted.
    """
    open_terms = {name: c for name, c in fit.aliased.items() if name not in fit.absorbed}
    fitted = response_scale(fit, linear_predictor(replace(fit, aliased=open_terms)))
    if fit.period_effects:
        pairs = [F.lit(v) for kv in fit.period_effects.items() for v in kv]
        fitted = fitted + F.try_element_at(F.create_map(*pairs), F.col(fit.period))
    rows = df
    if fit.group_effects is not None:
        rows = attach(df, fit.group_effects, [fit.group], how="left")
        fitted = fitted + F.col("_effect")
    return rows.withColumn(out, F.col(fit.response) - fitted).drop("_effect")


def term_test(fit: Fit, term: str) -> dict[str, float]:
    """Wald chi-square that all coefficients of a term are zero."""
    place = [fit.names.index(n) for n in fit.design.blocks[term]]
    if not place or fit.status != "ok":
        return {"statistic": None, "df": 0, "p_value": None}
    b, v = fit.beta[place], fit.cov[np.ix_(place, place)]
    statistic = float(b @ np.linalg.solve(v, b))
    return {"statistic": statistic, "df": len(place), "p_value": chi2_tail(statistic, len(place))}


def vif_of(df: DataFrame, fit: Fit) -> DataFrame:
    """Variance inflation of the terms of a fit, factors as blocks."""
    from pairlab.operators.inference import vif

    frame = fit.design.select(df.dropna(subset=[fit.response, *fit.design.inputs]))
    index = {n: f"x{i}" for i, n in enumerate(fit.design.names)}
    blocks = {t: [index[n] for n in members] for t, members in fit.design.blocks.items() if members}
    return vif(frame, list(index.values()), blocks)


def vif_of_coefficients(spark: SparkSession, fit: Fit) -> DataFrame:
    """Variance inflation of a fit's terms from the covariance of its coefficients, as for models with random parts.

    Nothing for a fit without estimates; terms that nothing tells apart have no value.
    """
    from pairlab.operators.inference import generalised_vif

    place = {n: i for i, n in enumerate(fit.design.names)}
    blocks = {t: [place[n] for n in members] for t, members in fit.design.blocks.items() if members}
    spread = np.sqrt(np.diag(fit.cov)[1:])
    r = fit.cov[1:, 1:] / np.outer(spread, spread)
    return generalised_vif(spark, r, blocks if fit.status == "ok" else {})


def coef_tables(spark: SparkSession, fits: Mapping[str, Fit]) -> DataFrame:
    """The coefficient tables of several fits, with the model's name in front."""
    tables = [coef_table(spark, fit).select(F.lit(name).alias("model"), "*") for name, fit in fits.items()]
    return reduce(DataFrame.unionByName, tables)


@dataclass(frozen=True)
class Spec:
    """One single-predictor model of a batch."""

    name: str
    family: str
    response: str
    predictor: str
    subset: Column | None = None


def fit_glm_grid(df: DataFrame, specs: Sequence[Spec], rounds: int = 50, tol: float = 1e-10) -> DataFrame:
    """Many single-predictor fits at once, in passes that they share.

    Returns (model, term, estimate, se, statistic, p_value, n, deviance, status), two rows for every
    model. Where the predictor or the response does not vary (`no variation`), or the steps do
    not settle within `rounds` or run off to infinity (`not converged`), there are no numbers.
    """
    spark = df.sparkSession
    needed = dict.fromkeys(c for s in specs for c in (s.response, s.predictor))
    flags = {
        f"_subset{i}": s.subset if s.subset is not None else F.lit(True) for i, s in enumerate(specs)
    }
    rows = df.select(
        *[F.col(c).cast("double").alias(c) for c in needed], *[f.alias(n) for n, f in flags.items()]
    ).persist()
    cells = [
        F.when(
            F.col(f"_subset{i}") & F.col(s.response).isNotNull() & F.col(s.predictor).isNotNull(),
            F.struct(
                F.lit(i).alias("spec"), F.lit(s.family).alias("family"),
                F.col(s.predictor).alias("x"), F.col(s.response).alias("y"),
            ),
        )
        for i, s in enumerate(specs)
    ]
    # one copy of a row per model it takes part in
    long = rows.select(F.explode(F.array(*cells)).alias("_m")).filter("_m is not null").select("_m.*")
    try:
        state = fit_long(long, rounds, tol)
    finally:
        rows.unpersist()
    named = spark.createDataFrame(
        [(i, s.name, s.predictor) for i, s in enumerate(specs)], "spec int, model string, predictor string"
    )
    # back from the standardised predictor
    size = F.when(F.col("s") > 0, F.col("s"))
    shift = F.col("m") / size
    both = F.array(
        F.struct(
            F.lit("(Intercept)").alias("term"), (F.col("b0") - shift * F.col("b1")).alias("estimate"),
            F.sqrt(F.col("v00") - 2 * shift * F.col("v01") + shift * shift * F.col("v11")).alias("se"),
        ),
        F.struct(
            F.col("predictor").alias("term"), (F.col("b1") / size).alias("estimate"), (F.sqrt("v11") / size).alias("se"),
        ),
    )
    out = named.join(state, "spec", "left").select(
        "model", F.explode(both).alias("_t"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "deviance",
        F.coalesce("status", F.lit("no variation")).alias("status"),
    ).select("model", "_t.*", "n", "deviance", "status").withColumn("statistic", F.col("estimate") / F.col("se"))
    return out.select(
        "model", "term", "estimate", "se", "statistic", normal_p(F.col("statistic")).alias("p_value"), "n", "deviance", "status"
    )


#: Rows of one model that a task holds when a batch is fitted.
PIECE_ROWS = 500_000


def fit_long(long: DataFrame, rounds: int = 50, tol: float = 1e-10) -> DataFrame:
    """One-predictor fits of all models of a long table (spec, family, x, y); any number of models.

    Returns an evaluated table with a row per spec: `n`, mean `m` and deviation `s` of the predictor, its ends `lo` and
    `hi`, estimates `b0`, `b1` and covariance `v00`, `v01`, `v11` for the standardised predictor, `deviance`, `status`.
    Models without variation in predictor or response, or without convergence, have no estimates.

    Rows are dealt once by model, large models in pieces; a pass joins the models' state to them where they are, and
    takes a step of all unfinished models in column expressions. Of more than 10,000 models only whether any is left comes to the driver.
    """
    binomial = F.col("family") == "binomial"
    varies = (F.col("s") > 0) & ~F.isnan("s") & (F.col("my") > 0) & ~(binomial & (F.col("my") >= 1))
    inner = F.when(binomial, F.col("my") / F.when(F.col("my") < 1, 1 - F.col("my"))).otherwise(F.col("my"))
    null = F.lit(None).cast("double")
    written = cut_lineage(per_key(
        long, ["spec"], F.first("family").alias("family"), F.avg("y").alias("my"), F.avg("x").alias("m"),
        F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"),
    ).select(
        "spec", F.col(ROWS).alias("n"), "m", "s", "lo", "hi", F.when(varies, F.log(inner)).alias("b0"),
        F.when(varies, F.lit(0.0)).alias("b1"), *[null.alias(c) for c in ("v00", "v01", "v11", "deviance")],
        F.when(varies, F.lit("open")).otherwise(F.lit("no variation")).alias("status"),
    ))
    # up to 10,000 models their state is a local table, which joins without a shuffle; else a written one
    local = small_table(written)
    state, keep = (written, cut_lineage) if local is None else (local, small_table)
    pieces = F.ceil(F.col("n") / PIECE_ROWS).cast("int")
    tasks = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = state.filter("status = 'open'").select("spec", "m", "s", F.col("n").alias(ROWS))
    dealt = attach_few(long, sizes, ["spec"]).select("spec", "family", ((F.col("x") - F.col("m")) / F.col("s")).alias("z"), "y")
    large = state.filter(F.col("n") > PIECE_ROWS).select("spec", pieces.alias("_parts"))  # at most rows / PIECE_ROWS models
    keys = ["spec"]
    if not large.isEmpty():
        piece = F.pmod(F.xxhash64("z", "y") + F.spark_partition_id(), F.coalesce("_parts", F.lit(1))).cast("int")
        dealt = dealt.join(F.broadcast(large), "spec", "left").withColumn("_piece", piece).drop("_parts")
        keys = ["spec", "_piece"]
    with kept(dealt.repartition(tasks, *keys)) as rows:
        for _ in range(rounds):
            open_ = state.filter("status = 'open'")
            if open_.isEmpty():
                break
            if len(keys) > 1:
                open_ = open_.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
            stepped = _step(_irls_sums(rows, open_, keys), state.columns, tol)
            state = keep(stepped.unionByName(state.filter("status <> 'open'")))
    lost = F.col("status") == "open"
    return state.withColumns({
        **{c: F.when(F.col("status") == "ok", F.col(c)) for c in ("b0", "b1", "v00", "v01", "v11", "deviance")},
        "status": F.when(lost, F.lit("not converged")).otherwise(F.col("status")),
    })


def _irls_sums(rows: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """Every unfinished model with its score, information and deviance sums; per piece first, where the rows are."""
    eta = F.col("b0") + F.col("b1") * F.col("z")
    binomial = F.col("family") == "binomial"
    y, mu = F.col("y"), F.col("mu")
    log_y = F.when(y > 0, y * (F.log(F.when(y > 0, y)) - F.log(mu))).otherwise(0.0)
    log_n = F.when(y < 1, (1 - y) * (F.log(F.when(y < 1, 1 - y)) - F.log(1 - mu))).otherwise(0.0)
    names = ("w0", "w1", "w2", "g0", "g1", "dev")
    carried = [F.first(c).alias(c) for c in open_.columns if c not in keys]
    parts = (
        rows.join(open_, keys)
        .withColumn("mu", F.when(binomial, inv_logit(eta)).otherwise(F.exp(eta)))
        .withColumn("w", F.when(binomial, mu * (1 - mu)).otherwise(mu))
        .withColumn("dev", F.when(binomial, log_y + log_n).otherwise(log_y - (y - mu)))
        .groupBy(*keys)
        .agg(
            *carried, F.sum("w").alias("w0"), F.sum(F.expr("w * z")).alias("w1"), F.sum(F.expr("w * z * z")).alias("w2"),
            F.sum(y - mu).alias("g0"), F.sum((y - mu) * F.col("z")).alias("g1"), F.sum("dev").alias("dev"),
        )
    )
    if len(keys) == 1:
        return parts
    return parts.groupBy("spec").agg(*carried, *[F.sum(c).alias(c) for c in names])


def _step(sums: DataFrame, columns: list[str], tol: float) -> DataFrame:
    """The state of unfinished models after one Newton step."""
    det = F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")
    solvable = ~F.isnan(det) & (det < float("inf")) & (det > 1e-11 * F.col("w0") * F.col("w2"))
    det = F.when(solvable, det)
    moved = sums.withColumns({
        "_d0": (F.col("w2") * F.col("g0") - F.col("w1") * F.col("g1")) / det,
        "_d1": (F.col("w0") * F.col("g1") - F.col("w1") * F.col("g0")) / det,
        "_v00": F.col("w2") / det, "_v01": -F.col("w1") / det, "_v11": F.col("w0") / det,
    })
    settled = F.greatest(F.abs("_d0"), F.abs("_d1")) < tol
    new = {
        **{b: F.col(b) + F.coalesce(f"_d{i}", F.lit(0.0)) for i, b in enumerate(("b0", "b1"))},
        **{c: F.coalesce(f"_{c}", c) for c in ("v00", "v01", "v11")}, "deviance": 2 * F.col("dev"),
        "status": F.when(F.col("_v00").isNull(), F.lit("not converged")).when(settled, F.lit("ok")).otherwise(F.lit("open")),
    }
    return moved.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])
