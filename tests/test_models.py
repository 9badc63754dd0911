"""Fits against closed forms, dense algebra and direct likelihoods."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlab.functions import tails
from pairlab.operators import charts, inference, laplace, mixed
from pairlab.operators import regression as reg
from pairlab.operators.design import Factor, design
from pairlab.operators.members import level_grid, levels_of
from pairlab.plans import analyses
from pairlab.queries import analyses as whole


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    n, groups, periods = 900, 25, 5
    pdf = pd.DataFrame({
        "g": rng.integers(0, groups, n), "t": rng.integers(2000, 2000 + periods, n),
        "x": rng.normal(size=n), "k": rng.choice(["a", "b"], n), "h": rng.integers(0, 3, n),
    })
    pdf["y"] = (
        1 + 0.5 * pdf.x + 0.7 * (pdf.k == "b") + rng.normal(size=groups)[pdf.g] * 0.8
        + rng.normal(size=periods)[pdf.t - 2000] * 0.5 + rng.normal(size=n)
    )
    eta = -0.6 + 0.5 * pdf.x + 0.7 * (pdf.k == "b") + rng.normal(size=groups)[pdf.g] * 0.9
    pdf["b"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    pdf["c"] = rng.poisson(np.exp(0.2 + 0.3 * pdf.x))
    return spark.createDataFrame(pdf).repartition(4).cache(), pdf


def dense(pdf, *cols):
    return np.column_stack([np.ones(len(pdf)), *[np.asarray(c, dtype=float) for c in cols]])


def newton(x, y, mean, weight, rounds=40):
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        mu = mean(x @ beta)
        beta = beta + np.linalg.solve((x * weight(mu)[:, None]).T @ x, x.T @ (y - mu))
    return beta, np.linalg.inv((x * weight(mean(x @ beta))[:, None]).T @ x)


def logistic(eta):
    return 1 / (1 + np.exp(-eta))


def test_linear(sample):
    df, pdf = sample
    x = dense(pdf, pdf.x, pdf.k == "b")
    fit = reg.fit_lm(df, "y", ["x", "k"])
    beta = np.linalg.lstsq(x, pdf.y, rcond=None)[0]
    residual = pdf.y - x @ beta
    cov = residual @ residual / (len(pdf) - 3) * np.linalg.inv(x.T @ x)
    assert np.allclose(fit.beta, beta) and np.allclose(fit.cov, cov)
    assert fit.stats["r2"] == pytest.approx(1 - residual @ residual / ((pdf.y - pdf.y.mean()) ** 2).sum())


def test_residuals_skip_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 1.0)], "x double, y double")
    fit = reg.fit_lm(df, "y", ["x"])
    got = reg.with_residual(df, fit).orderBy("x").collect()
    assert got[0].residual is None
    assert sum(r.residual for r in got[1:]) == pytest.approx(0, abs=1e-9)


def test_logistic_and_poisson(sample):
    df, pdf = sample
    x = dense(pdf, pdf.x, pdf.k == "b", pdf.x * (pdf.k == "b"))
    beta, cov = newton(x, pdf.b, logistic, lambda m: m * (1 - m))
    fit = reg.fit_glm(df, "b", [("x", "k")], "binomial")
    assert fit.names == ["(Intercept)", "x", "k[b]", "x:k[b]"]
    assert np.allclose(fit.beta, beta, atol=1e-7) and np.allclose(fit.cov, cov, atol=1e-8)
    mu = logistic(x @ beta)
    deviance = -2 * (pdf.b * np.log(mu) + (1 - pdf.b) * np.log(1 - mu)).sum()
    assert fit.stats["deviance"] == pytest.approx(deviance)
    assert fit.stats["aic"] == pytest.approx(deviance + 8)

    beta, cov = newton(x[:, :2], pdf.c, np.exp, lambda m: m)
    fit = reg.fit_glm(df, "c", ["x"], "poisson")
    assert np.allclose(fit.beta, beta, atol=1e-7) and np.allclose(fit.cov, cov, atol=1e-8)


def test_patterns_give_the_same_fit(sample):
    df, pdf = sample
    d = design(df, ["k", Factor("h")])
    frame = reg.model_frame(df, "b", d, "binomial")
    assert frame.count() == 6
    x = dense(pdf, pdf.k == "b", pdf.h == 1, pdf.h == 2)
    beta, cov = newton(x, pdf.b, logistic, lambda m: m * (1 - m))
    fit = reg.fit_glm(df, "b", ["k", Factor("h")], "binomial")
    assert np.allclose(fit.beta, beta, atol=1e-7) and np.allclose(fit.cov, cov, atol=1e-8)
    assert fit.stats["n"] == len(pdf)


def test_binary_predictor_is_the_log_odds_ratio(spark):
    cells = [(0, 0, 30), (0, 1, 10), (1, 0, 12), (1, 1, 18)]
    df = spark.createDataFrame([(x, y) for x, y, n in cells for _ in range(n)], "x int, y int")
    fit = reg.fit_glm(df, "y", ["x"], "binomial")
    assert fit.beta[1] == pytest.approx(math.log(18 * 30 / (12 * 10)))
    assert fit.se()[1] == pytest.approx(math.sqrt(1 / 30 + 1 / 10 + 1 / 12 + 1 / 18))


def test_batch_equals_single_fits(sample):
    df, _ = sample
    specs = [
        reg.Spec("b~x", "binomial", "b", "x"), reg.Spec("c~x", "poisson", "c", "x"),
        reg.Spec("b~y|a", "binomial", "b", "y", F.col("k") == "a"),
        reg.Spec("constant", "binomial", "b", "one"),
    ]
    got = reg.fit_glm_grid(df.withColumn("one", F.lit(1.0)), specs).toPandas().set_index(["model", "term"])
    assert (got.loc["constant"].status == "no variation").all() and got.loc["constant"].estimate.isna().all()
    for name, family, y, x, rows in (
        ("b~x", "binomial", "b", "x", df), ("c~x", "poisson", "c", "x", df),
        ("b~y|a", "binomial", "b", "y", df.filter("k = 'a'")),
    ):
        fit = reg.fit_glm(rows, y, [x], family)
        one = got.loc[name]
        assert np.allclose(one.estimate.to_numpy(), fit.beta, atol=1e-6)
        assert np.allclose(one.se.to_numpy(), fit.se(), atol=1e-6)
        assert one.deviance.iloc[0] == pytest.approx(fit.stats["deviance"], rel=1e-6)


def reml(pdf, x, y, blocks, thetas):
    v = np.eye(len(pdf))
    for column, theta in zip(blocks, thetas):
        z = (pdf[column].to_numpy()[:, None] == np.unique(pdf[column])[None, :]).astype(float)
        v = v + theta * z @ z.T
    inverse = np.linalg.inv(v)
    xvx = x.T @ inverse @ x
    beta = np.linalg.solve(xvx, x.T @ inverse @ y)
    e = y - x @ beta
    n, p = x.shape
    sigma2 = e @ inverse @ e / (n - p)
    value = (n - p) * (1 + np.log(2 * np.pi * sigma2)) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1]
    return value, beta, sigma2 * np.linalg.inv(xvx), sigma2


@pytest.mark.parametrize("second, few", [(None, 10_000), ("t", 10_000), ("t", 3)])
def test_mixed_linear_equals_dense_algebra(sample, monkeypatch, second, few):
    df, pdf = sample
    monkeypatch.setattr(mixed, "FEW_KEYS", few)
    fit = mixed.fit_lmm(df, "y", ["x", "k"], "g", second)
    x, y = dense(pdf, pdf.x, pdf.k == "b"), pdf.y.to_numpy()
    blocks = ["g"] if second is None else ["g", "t"]
    ratios = [(fit.stats[s] / fit.stats["sigma"]) ** 2 for s in ("group_sd", "group2_sd")[: len(blocks)]]
    value, beta, cov, sigma2 = reml(pdf, x, y, blocks, ratios)
    assert fit.stats["reml"] == pytest.approx(value, abs=1e-6)
    assert np.allclose(fit.beta, beta, atol=1e-7) and np.allclose(fit.cov, cov, atol=1e-8)
    assert fit.stats["sigma"] == pytest.approx(math.sqrt(sigma2))
    for i in range(len(ratios)):  # no nearby ratio is better
        for factor in (0.98, 1.02):
            moved = [r * (factor if i == j else 1) for j, r in enumerate(ratios)]
            assert reml(pdf, x, y, blocks, moved)[0] >= value - 1e-7


def test_mixed_linear_residuals(sample):
    df, pdf = sample
    fit = mixed.fit_lmm(df, "y", ["x", "k"], "g", "t")
    got = reg.with_residual(df, fit).select("g", "t", "x", "residual").toPandas()
    ratios = [(fit.stats[s] / fit.stats["sigma"]) ** 2 for s in ("group_sd", "group2_sd")]
    x, y = dense(pdf, pdf.x, pdf.k == "b"), pdf.y.to_numpy()
    v = np.eye(len(pdf))
    fitted = x @ fit.beta
    zs = []
    for column, theta in zip(("g", "t"), ratios):
        z = (pdf[column].to_numpy()[:, None] == np.unique(pdf[column])[None, :]).astype(float)
        v = v + theta * z @ z.T
        zs.append((z, theta))
    weights = np.linalg.solve(v, y - fitted)
    for z, theta in zs:
        fitted = fitted + theta * z @ (z.T @ weights)
    want = pd.DataFrame({"x": pdf.x, "want": y - fitted}).merge(got, on="x")
    assert np.allclose(want.want, want.residual, atol=1e-6)


def test_many_groups_in_few_jobs(spark):
    """Thousands of groups: a fit takes one pass per Newton step, and finds what made the data."""
    rng = np.random.default_rng(5)
    n, groups = 30_000, 6_000
    pdf = pd.DataFrame({"g": rng.integers(0, groups, n), "x": rng.normal(size=n), "z": rng.normal(size=n)})
    eta = -0.4 + 0.6 * pdf.x + rng.normal(size=groups)[pdf.g] * 1.1
    pdf["b"] = (rng.random(n) < logistic(eta)).astype(int)
    fit = mixed.fit_glmm(spark.createDataFrame(pdf), "b", ["x", "z"], "g")
    assert fit.status == "ok" and fit.stats["passes"] < 12 and fit.level_effects.count() == pdf.g.nunique()
    assert np.abs((fit.beta - [-0.4, 0.6, 0.0]) / fit.se()).max() < 4 and fit.stats["group_sd"] == pytest.approx(1.1, abs=0.15)


def test_mixed_linear_without_group_effect(spark):
    df = spark.createDataFrame([(i % 7, float((i * 37) % 11), float((i * 53) % 13)) for i in range(210)], "g int, x double, y double")
    fit = mixed.fit_lmm(df, "y", ["x"], "g")
    if fit.stats["group_sd"] == 0:
        assert np.allclose(fit.beta, reg.fit_lm(df, "y", ["x"]).beta)


def direct(beta, sigma, groups):
    """Sum over groups of the Laplace log-likelihood, modes by Newton."""
    total = 0.0
    for x, y in groups:
        u = 0.0
        for _ in range(60):
            p = logistic(x @ beta + sigma * u)
            u += (sigma * (y - p).sum() - u) / (1 + sigma**2 * (p * (1 - p)).sum())
        eta = x @ beta + sigma * u
        p = logistic(eta)
        total += (y * eta - np.logaddexp(0, eta)).sum() - u * u / 2 - 0.5 * np.log(1 + sigma**2 * (p * (1 - p)).sum())
    return total


@pytest.mark.parametrize("terms, piece", [
    (["x", "k"], None), (["k"], None), ([], None), (["x", "k"], 36), (["k"], 1), (["x"], 5),
])
def test_mixed_logistic_maximises_the_laplace_likelihood(sample, monkeypatch, terms, piece):
    """Groups whole, some or all of them in pieces."""
    df, pdf = sample
    if piece:
        monkeypatch.setattr(laplace, "piece_rows", lambda spark: piece)
    monkeypatch.setattr(laplace, "LEAST_ROWS", 100)
    fit = mixed.fit_glmm(df, "b", terms, "g")
    columns = {"x": pdf.x, "k": pdf.k == "b"}
    x = dense(pdf, *[columns[t] for t in terms])
    groups = [(x[pdf.g == g], pdf.b[pdf.g == g].to_numpy()) for g in pdf.g.unique()]
    at = np.append(fit.beta, fit.stats["group_sd"])
    best = direct(at[:-1], at[-1], groups)
    assert fit.stats["log_likelihood"] == pytest.approx(best, abs=1e-6)
    steps = np.append(fit.se(), 0.1)

    def value(point):
        return direct(point[:-1], point[-1], groups)

    width = len(at)
    eye = np.eye(width)
    slope = np.array([(value(at + 1e-4 * eye[i]) - value(at - 1e-4 * eye[i])) / 2e-4 for i in range(width)])
    assert np.abs(slope * steps).max() < 1e-3
    h = 2e-3
    hessian = np.array([[
        (value(at + h * (eye[i] + eye[j])) - value(at + h * (eye[i] - eye[j]))
         - value(at - h * (eye[i] - eye[j])) + value(at - h * (eye[i] + eye[j]))) / (4 * h * h)
        for j in range(width)] for i in range(width)])
    assert np.allclose(fit.se(), np.sqrt(np.diag(np.linalg.inv(-hessian)))[:-1], rtol=1e-3)


@pytest.mark.parametrize("point", [(0.2, -0.5, 0.3, 0.8), (0.2, -0.5, 0.3, 2.7), (0.2, 0.1, 0.3, 0.0)])
def test_curvature_of_the_laplace_likelihood(point):
    """Gradient and curvature against differences, of groups of one row in two ways."""
    rng, point, h = np.random.default_rng(8), np.array(point), 1e-5
    for sizes in ([1] * 60, [2, 5, 1, 40, 3] * 4):
        n = sum(sizes)
        x, w = np.vstack([np.ones(n), rng.normal(size=(2, n))]), rng.integers(1, 4, n).astype(float)
        y, starts = rng.binomial(w.astype(int), 0.4).astype(float), np.cumsum([0, *sizes[:-1]])
        at = lambda p: laplace.several_rows(p, x, y, w, starts)[0]
        moves, here = h * np.eye(4), at(point)
        assert np.allclose(here.slope, [(at(point + m).value - at(point - m).value) / (2 * h) for m in moves], atol=1e-6)
        assert np.allclose(here.bend, [(at(point + m).slope - at(point - m).slope) / (2 * h) for m in moves], atol=1e-4)
        if max(sizes) == 1:
            one = laplace.single_rows(point, x, y, w)[0]
            assert np.allclose(one.flat(), here.flat(), rtol=1e-12, atol=1e-10)


def test_no_group_effect_in_few_passes(spark):
    """Nearly every group is one row and the random sd is 0: steps in the sd would only cut it by a third each."""
    rng = np.random.default_rng(2)
    n = 20_000
    pdf = pd.DataFrame({"g": np.where(np.arange(n) < n // 20, np.arange(n) // 2, np.arange(n)), "x": rng.normal(size=n)})
    pdf["b"] = (rng.random(n) < logistic(0.1 + 0.2 * pdf.x)).astype(int)
    # a pair of opposites each: the rows of a group are less alike than chance makes them
    pdf.loc[: n // 20 - 1, "b"] = np.arange(n // 20) % 2
    df = spark.createDataFrame(pdf)
    fit = mixed.fit_glmm(df, "b", ["x"], "g")
    plain = reg.fit_glm(df, "b", ["x"], "binomial")
    assert fit.stats["boundary"] and fit.stats["group_sd"] == 0 and fit.stats["passes"] <= 6
    assert np.allclose(fit.beta, plain.beta, atol=1e-7) and np.allclose(fit.cov, plain.cov, rtol=1e-5)
    assert fit.level_effects.filter("effect = 0").count() == pdf.g.nunique()


@pytest.mark.parametrize("piece", [None, 36])
def test_models_of_the_same_rows_are_dealt_once(sample, monkeypatch, piece):
    """Each as if fitted alone: rows of unlisted levels count for the models that do not list levels."""
    df, pdf = sample
    alone = {
        "x": mixed.fit_glmm(df, "b", ["x"], "g"), "both": mixed.fit_glmm(df, "b", ["x", "k"], "g"),
        "some": mixed.fit_glmm(df.filter("h < 2"), "b", ["x", Factor("h")], "g"), "again": mixed.fit_glmm(df, "b", ["x", "h"], "g"),
    }
    if piece:
        monkeypatch.setattr(laplace, "piece_rows", lambda spark: piece)
    monkeypatch.setattr(laplace, "LEAST_ROWS", 300)
    dealt = []
    monkeypatch.setattr(laplace, "Blocks", lambda *a, real=laplace.Blocks: dealt.append(real(*a)) or dealt[-1])
    models = {"x": ["x"], "both": ["x", "k"], "some": ["x", Factor("h", (0, 1))], "again": ["x", "h", "one"]}
    fits = analyses.intercept_models(df.withColumn("one", F.lit(1.0)), "b", models, "g")
    assert len(dealt) == 1 and list(fits) == list(models) and list(fits["again"].aliased) == ["one"]
    for name, fit in fits.items():
        assert fit.stats["n"] == alone[name].stats["n"] == ((pdf.h < 2).sum() if name == "some" else len(pdf))
        assert fit.stats["log_likelihood"] == pytest.approx(alone[name].stats["log_likelihood"], abs=1e-7)
        assert np.allclose(fit.beta, alone[name].beta, atol=1e-6) and np.allclose(fit.cov, alone[name].cov, rtol=1e-4)
        effects, same = ({r["g"]: r["effect"] for r in f.level_effects.collect()} for f in (fit, alone[name]))
        assert effects == pytest.approx(same, abs=1e-6) and len(effects) == pdf.g.nunique()


def test_inflation_of_the_individual_models(spark, monkeypatch):
    """All four models of the query from one deal of rows whose join was evaluated once."""
    folder, dealt, fitted, joined = "/root/testdata/sf0.001", [], [], []
    monkeypatch.setattr(laplace, "Blocks", lambda *a, real=laplace.Blocks: dealt.append(real(*a)) or dealt[-1])
    monkeypatch.setattr(mixed, "fit_glmms", lambda *a, real=mixed.fit_glmms: fitted.append(real(*a)) or fitted[-1])
    monkeypatch.setattr(whole, "zscore", lambda df, *a, real=whole.zscore: joined.append(df) or real(df, *a))
    got = {r["term"]: r for r in whole.individual_models_vif(spark, folder).collect()}
    assert len(dealt) == len(fitted) == 1 and list(fitted[0]) == ["m6", "m8", "m9", "m10"]
    assert "Join" not in joined[0]._jdf.queryExecution().optimizedPlan().toString()
    fit = fitted[0]["m10"]
    assert fit.status == "ok" and list(got) and got["priority"]["df"] == 4
    by_hand = np.diag(fit.cov)[1:] * np.diag(np.linalg.inv(fit.cov[1:, 1:]))
    for name, value in zip(fit.design.names, by_hand):
        if name in got:
            assert got[name]["vif"] == pytest.approx(value, rel=1e-9)


def test_many_dummies_travel_as_bits(spark):
    """More columns of 0 and 1 than one whole number holds, next to a number, against the plain fit."""
    rng = np.random.default_rng(4)
    n = 4_000
    pdf = pd.DataFrame({"g": np.arange(n), "x": rng.normal(size=n), "k": rng.integers(0, 70, n), "h": rng.choice(["a", "b"], n)})
    pdf["b"] = (rng.random(n) < logistic(0.4 * pdf.x + 0.05 * (pdf.k - 35) - (pdf.h == "b"))).astype(int)
    df = spark.createDataFrame(pdf)
    fit, plain = mixed.fit_glmm(df, "b", ["x", Factor("k"), "h"], "g"), reg.fit_glm(df, "b", ["x", Factor("k"), "h"], "binomial")
    assert fit.names == plain.names and fit.status == "ok" and len(fit.names) == 72
    if fit.stats["boundary"]:
        assert np.allclose(fit.beta, plain.beta, atol=1e-5) and np.allclose(fit.se(), plain.se(), rtol=1e-3)
    assert np.abs(fit.beta / fit.se() - plain.beta / plain.se()).max() < 0.5


def test_predictions_and_band(sample, spark):
    df, _ = sample
    fit = reg.fit_glm(df, "b", [("h", "k")], "binomial")
    grid = level_grid(spark, {"h": [0, 1, 2], "k": ["a", "b"]})
    plain = {(r.h, r.k): r.predicted for r in reg.predict_grid(fit, grid).collect()}
    for r in reg.marginal_predictions(fit, grid).collect():
        x = np.array([1, r.h, r.k == "b", r.h * (r.k == "b")], dtype=float)
        assert r.predicted == pytest.approx(plain[(r.h, r.k)])
        se = math.sqrt(x @ fit.cov @ x)
        assert r.low == pytest.approx(logistic(x @ fit.beta - reg.Z95 * se))
        assert r.low < r.predicted < r.high


def test_terms(sample):
    df, pdf = sample
    d = design(df, [("x", "k"), Factor("h"), "x"])
    assert d.names == ["x", "k[b]", "h[1]", "h[2]", "x:k[b]"]
    assert d.blocks["h"] == ["h[1]", "h[2]"]
    with pytest.raises(ValueError):
        design(df.filter("k = 'a'"), ["k"])
    test = reg.term_test(reg.fit_lm(df, "y", ["x", Factor("h")]), "h")
    assert test["df"] == 2 and 0 <= test["p_value"] <= 1


def test_comparison_needs_the_same_rows(sample, spark):
    df, _ = sample
    a, b = reg.fit_glm(df, "b", ["k"], "binomial"), reg.fit_glm(df, "b", ["x"], "binomial")
    table = {r.model: r for r in reg.compare_fits(spark, {"a": a, "b": b}).collect()}
    assert min(r.delta for r in table.values()) == 0
    part = reg.fit_glm(df.filter("h < 2"), "b", ["k"], "binomial")
    with pytest.raises(ValueError):
        reg.compare_fits(spark, {"a": a, "part": part})


def test_vif_of_factor_terms(sample):
    df, _ = sample
    fit = reg.fit_lm(df, "y", ["x", "t", Factor("h")])
    got = {r.term: (r.df, r.vif) for r in reg.vif_of(df, fit).collect()}
    assert got["h"][0] == 2 and all(v >= 1 - 1e-9 for _, v in got.values())


def test_tails():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert tails.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert tails.chi2_tail(0.0, 4) == 1.0
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert tails.student_two_sided(2.0859634472658364, 20) == pytest.approx(0.05)
    assert tails.student_two_sided(0.0, 20) == 1.0


def test_tail_columns(spark):
    asked = [(q, d) for q in (0.0, -1.0, 1e-9, 0.1, 3.84, 50.0, 400.0, 2000.0) for d in (1, 2, 3, 10, 51, 300)]
    df = spark.createDataFrame([*asked, (None, 1), (1.0, None), (float("nan"), 2), (1.0, 0)], "q double, d int")
    got = [r[0] for r in df.select(tails.chi2_sf(F.col("q"), F.col("d"))).collect()]
    assert got == [pytest.approx(tails.chi2_tail(q, d), rel=1e-10) for q, d in asked] + [None] * 4
    zs = [0.0, 1e-9, 0.5, 2.8, 2.83, 2.9, 6.0, 30.0, -1.0]
    df = spark.createDataFrame([(z,) for z in [*zs, None]], "z double")
    got = [r[0] for r in df.select(tails.normal_p(F.col("z"))).collect()]
    assert got == [pytest.approx(tails.normal_two_sided(z), rel=1e-10) for z in zs] + [None]
    ps = [1e-300, 1e-10, 0.01, 0.3, 0.5, 0.7, 0.975, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double")
    out = df.select(tails.normal_quantile(F.col("p")))
    assert "Python" not in out._jdf.queryExecution().toString()
    assert [r[0] for r in out.collect()] == [pytest.approx(NormalDist().inv_cdf(p), abs=1e-10) for p in ps] + [None] * 3


def test_batch_of_many_models(spark, monkeypatch):
    """Thousands of levels, one of them with a third of all rows in pieces, against dense fits of some."""
    monkeypatch.setattr(reg, "PIECE_ROWS", 1_000)
    rng = np.random.default_rng(5)
    level = np.where(rng.random(60_000) < 1 / 3, 0, rng.integers(0, 2_000, 60_000))
    x = rng.normal(size=60_000)
    y = (rng.random(60_000) < 1 / (1 + np.exp(0.3 - 0.8 * x))).astype(float)
    pdf = pd.DataFrame({"spec": level, "family": "binomial", "x": x, "y": y})
    got = reg.fit_long(spark.createDataFrame(pdf)).toPandas().set_index("spec")
    assert len(got) == len(set(level)) and set(got.status) <= {"ok", "no variation", "not converged"}
    assert (got.status == "ok").mean() > 0.95 and got.n.sum() == 60_000
    for spec in (0, 1, 17, 500, 1_999):
        part, row = pdf[pdf.spec == spec], got.loc[spec]
        z, b = np.column_stack([np.ones(len(part)), (part.x - row.m) / row.s]), np.zeros(2)
        for _ in range(40):
            mu = 1 / (1 + np.exp(-z @ b))
            info = z.T @ (z * (mu * (1 - mu))[:, None])
            b = b + np.linalg.solve(info, z.T @ (part.y - mu))
        assert row.status == "ok" and [row.b0, row.b1] == pytest.approx(list(b), abs=1e-7)
        assert [row.v00, row.v01, row.v11] == pytest.approx(np.linalg.inv(info)[[0, 0, 1], [0, 1, 1]].tolist(), rel=1e-6)


def test_proportion_and_chi_square(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("a", 0)] * 15, "k string, f int")
    row = inference.proportion_test(df, ["k"], "f", p0=0.5).first()
    assert row.statistic == pytest.approx(4.05) and row.p_value == pytest.approx(tails.chi2_tail(4.05, 1))
    table = [("a", "x", 12), ("a", "y", 5), ("b", "x", 7), ("b", "y", 0), ("c", "y", 9)]
    df = spark.createDataFrame([(a, b) for a, b, n in table for _ in range(n)], "a string, b string")
    row = inference.chi_square(df, "a", "b").first()
    o = np.array([[12, 5], [7, 0], [0, 9]])
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert row.statistic == pytest.approx(((o - e) ** 2 / e).sum()) and row.df == 2
    two = inference.chi_square(df.filter("a != 'c'"), "a", "b").first()
    o = o[:2]
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    d = np.abs(o - e)
    assert two.statistic == pytest.approx(((d - np.minimum(0.5, d)) ** 2 / e).sum())


def test_components(spark, sample):
    df, pdf = sample
    found = inference.pca(df, ["x", "y", "c"], k=2)
    z = (pdf[["x", "y", "c"]] - pdf[["x", "y", "c"]].mean()) / pdf[["x", "y", "c"]].std()
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(z.T)))[::-1]
    assert np.allclose(found.values, values[:2])
    scores = found.with_scores(df).select(F.var_samp("PC1"), F.corr("PC1", "PC2")).first()
    assert scores[0] == pytest.approx(values[0]) and scores[1] == pytest.approx(0, abs=1e-9)


def test_chart_tables(spark, sample):
    df, pdf = sample
    bins = charts.histogram(df, "y", 15).toPandas()
    counts, edges = np.histogram(pdf.y, bins=15)
    assert (bins.set_index("bin")["n"].reindex(range(15), fill_value=0).to_numpy() == counts).all()
    assert charts.scatter_cells(df, "x", "y", 5, 5, ["k"]).agg(F.sum("n")).first()[0] == len(pdf)
    for r in charts.box_stats(df, "y", ["k"]).collect():
        y = pdf[pdf.k == r.k].y
        q1, q3 = np.quantile(y, [0.25, 0.75])
        inside = y[(y >= q1 - 1.5 * (q3 - q1)) & (y <= q3 + 1.5 * (q3 - q1))]
        assert (r.whisker_low, r.whisker_high) == (inside.min(), inside.max())
        assert r.n_outliers == len(y) - len(inside)
    shares = charts.bar_shares(df, "h", "b", ["k"]).groupBy("k", "h").agg(F.sum("share").alias("s"))
    assert all(r.s == pytest.approx(1) for r in shares.collect())
    qq = charts.qq_table(df, "y", 9).orderBy("p").toPandas()
    assert np.allclose(qq["sample"], np.quantile(pdf.y, (np.arange(9) + 0.5) / 9))
    assert qq["theoretical"].iloc[4] == pytest.approx(0, abs=1e-12)
    sampled = charts.scatter_sample(df, ["g", "x"], 0.3).count()
    assert 0 < sampled < len(pdf)


# --- what cannot be estimated ------------------------------------------------------------


def table(spark, fit):
    return {r["term"]: r for r in reg.coef_table(spark, fit).collect()}


def test_unlisted_level_is_missing(spark):
    """Rows of a level that is not listed are dropped; they are no reference rows."""
    rows = [("a", 1.0), ("a", 1.2), ("b", 3.0), ("b", 3.2), ("c", 50.0), ("c", 51.0)]
    df = spark.createDataFrame(rows, "k string, y double")
    fit = reg.fit_lm(df, "y", [Factor("k", ("a", "b"))])
    assert fit.stats["n"] == 4 and fit.beta == pytest.approx([1.1, 2.0])
    seen = {(r["k"], r["predicted"] is None) for r in reg.predict_grid(fit, df).collect()}
    assert seen == {("a", False), ("b", False), ("c", True)}


def test_absent_level_is_aliased(spark, sample):
    df, pdf = sample
    for fit in (
        reg.fit_lm(df, "y", ["x", Factor("k", ("a", "b", "z"))]),
        reg.fit_glm(df, "b", ["x", Factor("k", ("a", "b", "z"))], "binomial"),
        mixed.fit_lmm(df, "y", ["x", Factor("k", ("a", "b", "z"))], "g"),
    ):
        rows = table(spark, fit)
        assert rows["k[z]"]["status"] == "aliased" and rows["k[z]"]["estimate"] is None
        assert rows["k[b]"]["estimate"] is not None and len(rows) == 4
        grid = level_grid(spark, {"x": [0.0], "k": ["a", "z"]})
        assert {r["k"]: r["predicted"] is None for r in reg.predict_grid(fit, grid).collect()} == {"a": False, "z": True}
    doubled = reg.fit_lm(df.withColumn("x2", F.col("x") * 2), "y", ["x", "x2"])
    assert list(doubled.aliased) == ["x2"]


def test_separable_and_constant(spark):
    rows = [(float(i), int(i > 9), 1, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, sep int, one int, y int")
    assert table(spark, reg.fit_glm(df, "sep", ["x"], "binomial"))["x"]["status"] == "not converged"
    assert table(spark, reg.fit_glm(df, "one", ["x"], "binomial"))["x"]["status"] == "no variation"
    assert mixed.fit_glmm(df, "sep", ["x"], "y").status == "not converged"
    specs = [reg.Spec("sep", "binomial", "sep", "x"), reg.Spec("constant", "binomial", "y", "one"),
             reg.Spec("all ones", "binomial", "one", "x"), reg.Spec("none", "binomial", "y", "x", F.col("x") > 99),
             reg.Spec("good", "binomial", "y", "x")]
    got = {(r["model"], r["term"]): r for r in reg.fit_glm_grid(df, specs).collect()}
    assert len(got) == 10
    status = {m: r["status"] for (m, _), r in got.items()}
    assert status == {"sep": "not converged", "constant": "no variation", "all ones": "no variation",
                      "none": "no variation", "good": "ok"}
    assert all((r["estimate"] is None) == (r["status"] != "ok") for r in got.values())
    curve = charts.logistic_curve(df.withColumn("k", F.lit("a")), "x", "sep", "k", 5)
    assert [r["predicted"] for r in curve.collect()] == [None] * 5


def test_large_grids_and_levels(spark):
    grid = level_grid(spark, {"a": list(range(300)), "b": list(range(50))})
    assert grid.count() == 15_000 and grid.distinct().count() == 15_000
    wide = spark.range(10_500).selectExpr("cast(id as string) as k")
    with pytest.raises(ValueError, match="not categorical"):
        design(wide, ["k"])
    assert len(levels_of(wide, "k", most=20_000)) == 10_500


def test_gaussian_on_offset_predictor(spark, sample):
    df, pdf = sample
    x = dense(pdf, pdf.t, pdf.x)
    beta, *_ = np.linalg.lstsq(x - [0, 2002, 0], pdf.y, rcond=None)
    fit = reg.fit_lm(df, "y", ["t", "x"])
    assert fit.beta[1:] == pytest.approx(beta[1:], rel=1e-8)
    rss = ((pdf.y - (x - [0, 2002, 0]) @ beta) ** 2).sum()
    n = len(pdf)
    assert fit.stats["log_likelihood"] == pytest.approx(-n / 2 * (np.log(2 * np.pi * rss / n) + 1))


def test_terms_that_the_grid_leaves_out(spark, sample):
    """They are held at the reference level and the mean."""
    df, pdf = sample
    fit = reg.fit_glm(df, "b", ["x", "k"], "binomial")
    short = reg.marginal_predictions(fit, level_grid(spark, {"x": [0.5]}), df).first()
    full = reg.marginal_predictions(fit, level_grid(spark, {"x": [0.5], "k": ["a"]})).first()
    assert short["predicted"] == full["predicted"] and short["low"] == full["low"]
    mean = reg.marginal_predictions(fit, level_grid(spark, {"k": ["b"]}), df).first()
    assert mean["x"] == pytest.approx(pdf.x.mean())


def test_absorbed_levels_equal_dummies(sample):
    df, pdf = sample
    with_nulls = df.withColumns({"same": F.col("g") * 2.0, "g": F.when(F.col("g") != 3, F.col("g"))})
    fit = reg.fit_lm_within(with_nulls, "y", ["x", "same", "k"], "g")
    kept = pdf[pdf.g != 3]
    levels = sorted(kept.g.unique())
    x = np.column_stack([kept.x, kept.k == "b", *[kept.g == v for v in levels]]).astype(float)
    beta, (rss,), *_ = np.linalg.lstsq(x, kept.y, rcond=None)
    left = len(kept) - x.shape[1]
    cov = rss / left * np.linalg.inv(x.T @ x)
    share = np.array([(kept.g == v).mean() for v in levels])
    to_fit = np.zeros((3, x.shape[1]))
    to_fit[0, 2:], to_fit[1, 0], to_fit[2, 1] = share, 1, 1
    assert fit.names == ["(Intercept)", "x", "k[b]"] and list(fit.aliased) == ["same"]
    assert np.allclose(fit.beta, to_fit @ beta) and np.allclose(fit.cov, to_fit @ cov @ to_fit.T)
    assert (fit.stats["levels"], fit.stats["df_residual"]) == (len(levels), left)
    assert fit.stats["sigma"] == pytest.approx(np.sqrt(rss / left))
    effects = {r.g: r._effect for r in fit.group_effects.collect()}
    assert np.allclose([effects[v] for v in levels], beta[2:] - share @ beta[2:])
    residual = reg.with_residual(with_nulls, fit).toPandas()
    assert residual.residual.isna().sum() == (pdf.g == 3).sum()
    assert np.allclose(np.sort(residual.residual.dropna()), np.sort(kept.y - x @ beta))


def test_absorbing_fifty_thousand_levels(spark):
    """A third of the rows has one level; far more levels than a factor may list."""
    n = 200_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50_000).alias("g"),
        F.sin(F.col("id").cast("double")).alias("x"), F.cos(F.col("id") * 7.0).alias("noise"),
    ).withColumn("y", 2 * F.col("x") + F.sqrt(F.abs(F.col("g")).cast("double")) + F.col("noise") / 10)
    fit = reg.fit_lm_within(df, "y", ["x"], "g")
    pdf = df.toPandas()
    within = pdf[["x", "y"]] - pdf.groupby("g")[["x", "y"]].transform("mean")
    assert fit.beta[1] == pytest.approx(within.x @ within.y / (within.x @ within.x))
    assert fit.stats["levels"] == pdf.g.nunique() == 50_001


def test_absorbing_needs_rows(spark):
    one_each = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(6)], "g int, x double, y double")
    for df in (one_each, one_each.filter("false")):
        fit = reg.fit_lm_within(df, "y", ["x"], "g")
        assert fit.status == "too few rows"
        assert {r.estimate for r in reg.coef_table(spark, fit).collect()} == {None}
    alone = reg.fit_lm_within(one_each.withColumn("g", F.col("g") % 2), "y", [], "g")
    assert np.allclose(alone.beta, [55 / 6]) and alone.stats["df_residual"] == 4


def test_vif_of_a_mixed_fit(sample, spark):
    df, pdf = sample
    fit = mixed.fit_lmm(df, "y", ["x", "h"], "g")
    theta = (fit.stats["group_sd"] / fit.stats["sigma"]) ** 2
    x = dense(pdf, pdf.x, pdf.h)
    same = np.equal.outer(pdf.g.to_numpy(), pdf.g.to_numpy())
    cov = np.linalg.inv(x.T @ np.linalg.solve(np.eye(len(pdf)) + theta * same, x))
    r = cov[1, 2] ** 2 / cov[1, 1] / cov[2, 2]
    got = {row.term: row.vif for row in reg.vif_of_coefficients(spark, fit).collect()}
    assert got == pytest.approx({"x": 1 / (1 - r), "h": 1 / (1 - r)})
