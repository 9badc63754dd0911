"""Random-intercept models, linear (REML) and logistic (Laplace).

Spark computes sums per group level; the driver solves systems whose size is the number
of coefficients. The linear model follows Henderson's mixed model equations, the
logistic one Breslow and Clayton's Laplace approximation with its exact gradient (`laplace`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.operators import laplace
from pairlab.operators.design import Design, Factor, Term, design
from pairlab.operators.members import levels_of
from pairlab.operators.regression import Fit, estimable, gram, independent, model_rows, term_inputs, term_test
from pairlab.operators.spread import FEW_KEYS, ROWS
from pairlab.session import cut_lineage

# Range of log10 of the variance ratio; an optimum at 0 or at one of its ends is a `boundary` in the statistics.
LEAST, MOST = -6.0, 4.0

# Levels of the second, small factor of a linear model: the driver solves a system this wide.
FEW_SECOND = 500


# --- linear ---------------------------------------------------------------------------


def _outer(batches: Iterable[pd.DataFrame], width: int, thetas: Sequence[float]) -> np.ndarray:
    """Per variance ratio the flat sum of theta/(1+n theta) s s' over groups, and that of log(1+n theta) behind it."""
    flat = np.zeros((len(thetas), width * width + 1))
    for batch in batches:
        s = batch.drop(columns=["n"]).to_numpy(dtype=float)
        n = batch["n"].to_numpy(dtype=float)
        for k, theta in enumerate(thetas):
            flat[k, :-1] += (s.T @ (s * (theta / (1.0 + n * theta))[:, None])).ravel()
            flat[k, -1] += np.log1p(n * theta).sum()
    return flat


def _absorbed(groups: DataFrame | pd.DataFrame, width: int, thetas: Sequence[float]) -> dict[int, tuple]:
    """For each variance ratio: sum over groups of theta/(1+n theta) s s', and of log(1+n theta).

    Sums of few groups are here already; those of many take one pass for all ratios.
    """
    thetas = list(thetas)
    if isinstance(groups, pd.DataFrame):
        flat = _outer([groups], width, thetas)
    else:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = _outer(batches, width, thetas)
            for k in range(len(thetas)):
                yield pd.DataFrame({"theta": k, "cell": np.arange(own.shape[1]), "value": own[k]})

        sums = groups.mapInPandas(partial, "theta int, cell int, value double")
        flat = np.zeros((len(thetas), width * width + 1))
        for row in sums.groupBy("theta", "cell").agg(F.sum("value").alias("value")).collect():
            flat[row.theta, row.cell] = row.value
    return {k: (flat[k, :-1].reshape(width, width), flat[k, -1]) for k in range(len(thetas))}


class _Reml:
    """Restricted likelihood for given variance ratios, from absorbed cross-products."""

    def __init__(self, total: np.ndarray, n: float, p: int, q2: int):
        self.total, self.n, self.p, self.q2 = total, n, p, q2
        self.xy = np.r_[0:p, p + q2]
        self.z = np.r_[p:p + q2]

    def solve(self, absorbed: tuple, theta2: float) -> dict:
        outer, logdet = absorbed
        a = self.total - outer
        m = a[np.ix_(self.xy, self.xy)]
        effects = None
        if self.q2:
            azz = a[np.ix_(self.z, self.z)]
            azx = a[np.ix_(self.z, self.xy)]
            if theta2 > 0:
                inverse = np.linalg.solve(azz + np.eye(self.q2) / theta2, azx)
                m = m - azx.T @ inverse
                logdet = logdet + np.linalg.slogdet(np.eye(self.q2) + theta2 * azz)[1]
        p = self.p
        beta = np.linalg.solve(m[:p, :p], m[:p, p])
        rss = max(m[p, p] - beta @ m[:p, p], 1e-300)
        sigma2 = rss / (self.n - p)
        criterion = (
            (self.n - p) * (1 + np.log(2 * np.pi * sigma2)) + logdet
            + np.linalg.slogdet(m[:p, :p])[1]
        )
        if self.q2:
            effects = inverse @ np.append(-beta, 1.0) if theta2 > 0 else np.zeros(self.q2)
        return {
            "criterion": criterion, "beta": beta, "sigma2": sigma2, "theta2": theta2,
            "cov": sigma2 * np.linalg.inv(m[:p, :p]), "effects2": effects,
        }

    def criteria(self, absorbed: tuple, thetas2: np.ndarray) -> np.ndarray:
        """The criterion at many second ratios: with the levels' block diagonal, each is a sum over levels."""
        outer, logdet = absorbed
        a, p = self.total - outer, self.p
        roots, vectors = np.linalg.eigh(a[np.ix_(self.z, self.z)])
        roots = np.maximum(roots, 0.0)
        turned = vectors.T @ a[np.ix_(self.z, self.xy)]
        weight = thetas2[:, None] / (1.0 + thetas2[:, None] * roots)
        m = a[np.ix_(self.xy, self.xy)] - np.einsum("tq,qi,qj->tij", weight, turned, turned, optimize=True)
        x, xy = m[:, :p, :p], m[:, :p, p]
        beta = np.linalg.solve(x, xy[..., None])[..., 0]
        rss = np.maximum(m[:, p, p] - (beta * xy).sum(1), 1e-300)
        return (
            (self.n - p) * (1 + np.log(2 * np.pi * rss / (self.n - p))) + logdet
            + np.log1p(thetas2[:, None] * roots).sum(1) + np.linalg.slogdet(x)[1]
        )

    def best_theta2(self, absorbed: tuple) -> dict:
        """Best second ratio for a fixed first one, on the driver."""
        best = self.solve(absorbed, 0.0)
        if not self.q2:
            return best
        low, high, points = -8.0, 6.0, 29
        found, least = 0.0, best["criterion"]
        for _ in range(14):
            grid = np.linspace(low, high, points)
            values = self.criteria(absorbed, 10.0**grid)
            k = int(values.argmin())
            if values[k] < least:
                found, least = 10.0 ** grid[k], values[k]
            width = (high - low) / (points - 1)
            low, high, points = grid[k] - width, grid[k] + width, 9
        return self.solve(absorbed, found) if found else best


def fit_lmm(
    df: DataFrame, y: str, terms: Sequence[Term], group: str, group2: str | None = None
) -> Fit:
    """Linear model with a random intercept per `group`, and per level of the small `group2`.

    One pass sums every group level. The variance ratio of `group` is refined on a grid, in six rounds; the
    sums of up to `FEW_KEYS` levels are searched where they are, those of more take one pass over the
    per-level sums for all points of a round. P-values are Wald z.
    """
    needed = [y, group, *term_inputs(terms), *([group2] if group2 else [])]
    with model_rows(df, *needed) as rows:
        return _fit_lmm(rows, y, terms, group, group2)


def _fit_lmm(
    rows: DataFrame, y: str, terms: Sequence[Term], group: str, group2: str | None
) -> Fit:
    d, aliased = estimable(rows, design(rows, terms))
    levels2 = levels_of(rows, group2) if group2 else []
    if len(levels2) > FEW_SECOND:
        raise ValueError(f"{group2} has {len(levels2)} levels; give the larger factor as `group`")
    xs = [f"x{i}" for i in range(d.width)]
    frame = d.select(
        rows, F.col(group).alias("_g"),
        *([F.col(group2).alias("_t")] if group2 else []),
        F.lit(1.0).alias("_one"), F.col(y).cast("double").alias("_y"),
    )
    p, q2 = d.width + 1, len(levels2)
    width = p + q2 + 1
    order = ["_one", *xs, *[f"z{i}" for i in range(q2)], "_y"]
    dummies = {f"z{i}": (F.col("_t") == F.lit(v)).cast("double") for i, v in enumerate(levels2)}
    per_group = frame.withColumns(dummies).groupBy("_g").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(c) for c in order]
    ).persist()
    try:
        total = np.zeros((width, width))
        fixed = np.r_[0:p, p + q2]
        total[np.ix_(fixed, fixed)] = gram(frame, ["_one", *xs, "_y"])
        if q2:
            place = {v: p + i for i, v in enumerate(levels2)}
            by_level = frame.groupBy("_t").agg(*[F.sum(c).alias(c) for c in ("_one", *xs, "_y")])
            for row in by_level.collect():
                k = place[row["_t"]]
                total[k, k] = row["_one"]
                for j, c in zip(fixed, ("_one", *xs, "_y")):
                    total[k, j] = total[j, k] = row[c]
        reml = _Reml(total, total[0, 0], p, q2)
        stats_only = per_group.select("n", *order)
        few = stats_only.limit(FEW_KEYS + 1).toPandas()
        stats_only = few if len(few) <= FEW_KEYS else stats_only
        best, best_theta, best_absorbed = None, 0.0, None
        low, high, points = LEAST, MOST, 33
        for step in range(6):  # each narrows the search 16 times
            grid = list(10.0 ** np.linspace(low, high, points))
            thetas = [0.0, *grid] if step == 0 else grid
            absorbed = _absorbed(stats_only, width, thetas)
            fits = [reml.best_theta2(absorbed[k]) for k in range(len(thetas))]
            k = int(np.argmin([f["criterion"] for f in fits]))
            if best is None or fits[k]["criterion"] < best["criterion"]:
                best, best_theta, best_absorbed = fits[k], thetas[k], absorbed[k]
            if best_theta == 0.0:
                break
            spacing = (high - low) / (points - 1)
            middle = np.log10(best_theta)
            low, high = middle - spacing, middle + spacing
        sigma2 = best["sigma2"]
        stats = {
            "n": total[0, 0], "parameters": p, "reml": best["criterion"],
            "sigma": float(np.sqrt(sigma2)), "group_sd": float(np.sqrt(sigma2 * best_theta)),
            "boundary": float(best_theta == 0.0 or not LEAST < np.log10(best_theta) < MOST),
        }
        if group2:
            stats["group2_sd"] = float(np.sqrt(sigma2 * best["theta2"]))
        effect = F.col("_y")
        for c, b in zip(["_one", *xs], best["beta"]):
            effect = effect - F.lit(float(b)) * F.col(c)
        effects2 = {}
        if group2:
            effects2 = {v: float(e) for v, e in zip(levels2, best["effects2"])}
            for i, v in enumerate(levels2):
                effect = effect - F.lit(effects2[v]) * F.col(f"z{i}")
        shrink = F.lit(float(best_theta)) / (1.0 + F.col("n") * F.lit(float(best_theta)))
        # residuals need the level effects long after the sums are let go
        levels = cut_lineage(per_group.select(
            F.col("_g").alias(group), F.col("n").cast("bigint").alias(ROWS),
            (shrink * effect).alias("_effect"),
        ))
    finally:
        per_group.unpersist()
    return Fit(
        "gaussian", y, d, best["beta"], best["cov"], stats, group=group, group_effects=levels,
        period=group2, period_effects=effects2, aliased=aliased,
    )


def observer_effect(
    df: DataFrame, observer: str, measures: Sequence[str], group: str
) -> DataFrame:
    """Per measure: does the observer shift it, next to a random intercept per group?"""
    rows = []
    kept = df.select(observer, group, *measures).persist()
    try:
        levels = tuple(levels_of(kept, observer))
        for measure in measures:
            fit = fit_lmm(kept, measure, [Factor(observer, levels)], group)
            test = term_test(fit, observer)
            rows.append((
                measure, int(fit.stats["n"]), fit.stats["sigma"], fit.stats["group_sd"],
                test["statistic"], test["df"], test["p_value"],
            ))
    finally:
        kept.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "measure string, n long, sigma double, group_sd double, statistic double, "
        "df int, p_value double",
    )


# --- logistic -------------------------------------------------------------------------


def fit_glmm(
    df: DataFrame, y: str, terms: Sequence[Term], group: str, max_rounds: int = 40
) -> Fit:
    """Logistic model with a random intercept per `group`, fitted by Laplace approximation.

    Newton steps on (coefficients, random sd), each one pass over blocks of whole groups, whatever
    the number of groups (see `laplace`). Discrete models are first reduced to one row per group and
    covariate pattern. Aliased terms are left out; without terms there is an intercept alone. A fit
    that does not converge within `max_rounds` says so in its status and has no estimates. A random sd at
    its bound of 0 is told by `boundary` in the statistics.
    """
    with model_rows(df, y, group, *term_inputs(terms)) as rows:
        return fit_glmms(rows, y, {"": terms}, group, max_rounds)[""]


def fit_glmms(
    rows: DataFrame, y: str, models: Mapping[str, Sequence[Term]], group: str, max_rounds: int = 40
) -> dict[str, Fit]:
    """`fit_glmm` of several sets of terms on the same complete rows, which are dealt once and passed over together.

    `rows` should be written or kept: they are read a few times before they are dealt.
    """
    designs = {name: design(rows, terms) for name, terms in models.items()}
    fits = {}
    for discrete in (True, False):  # only discrete models have rows that can be counted
        some = {name: d for name, d in designs.items() if d.discrete == discrete}
        if some:
            fits |= _fit_glmms(rows, y, some, group, max_rounds, discrete)
    return {name: fits[name] for name in models}


def _fit_glmms(
    rows: DataFrame, y: str, designs: Mapping[str, Design], group: str, max_rounds: int, discrete: bool
) -> dict[str, Fit]:
    numbers: dict[str, Column] = {}
    flags: dict[str | tuple, Column] = {}
    masks = []
    for d in designs.values():
        dummies = {name for c in d.reference for name in d.blocks[c]}
        for name, c in zip(d.names, d.columns):
            if name in dummies:
                flags[name] = c == 1.0
            else:
                numbers[name] = c
        masks.append(tuple((c, d.reference[c], *d.blocks[c]) for c in d.known))
        if d.known:  # rows of levels that a model does not list are none of its rows
            flags[masks[-1]] = reduce(lambda a, b: a & b, d.known.values())
    order = {key: i for i, key in enumerate([*numbers, *flags])}
    bits = [F.when(c, F.lit(1 << i % laplace.WORD)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(flags.values())]
    words = [reduce(lambda a, b: a + b, bits[i : i + laplace.WORD]) for i in range(0, len(bits), laplace.WORD)]
    columns = [c.alias(f"{kind}{i}") for kind, some in (("x", numbers.values()), ("f", words)) for i, c in enumerate(some)]
    frame = rows.select(F.col(group).alias("_g"), F.col(y).cast("double").alias("y"), *columns)
    if discrete:
        patterns = [c for c in frame.columns if c != "y"]
        frame = frame.groupBy(*patterns).agg(F.sum("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w")).persist()
    try:
        blocks = laplace.Blocks(frame, [isinstance(key, tuple) for key in flags])
    finally:
        if discrete:
            frame.unpersist()
    models = [laplace.Model([order[c] for c in d.names], order.get(mask)) for d, mask in zip(designs.values(), masks)]
    fits: dict[str, Fit] = {}
    open_ = {}
    for (name, d), model, found in zip(designs.items(), models, blocks.moments(models)):
        cross, n, ones = found.cross, float(found.cross[0, 0]), found.ones
        size = np.sqrt(np.maximum(np.diag(cross), 1e-300))
        kept = [j - 1 for j in independent(cross / np.outer(size, size)) if j]
        aliased = {d.names[j]: d.columns[j] for j in range(d.width) if j not in kept}
        d = d.only(kept) if aliased else d
        p = d.width + 1
        nothing = np.full((p, p), np.nan)
        fits[name] = Fit("binomial", y, d, nothing[0], nothing, {"n": n, "parameters": p + 1}, group=group, aliased=aliased)
        if not n or ones == 0 or ones == n:
            fits[name].status = "no variation" if n else "too few rows"
            continue
        # columns about their means in units of their spread: one step fits all
        places_ = [j + 1 for j in kept]
        mean = cross[0, places_] / n
        spread = np.sqrt(np.maximum(np.diag(cross)[places_] / n - mean**2, 0.0))
        spread[spread == 0] = 1.0
        share = ones / n
        scale = np.full(p + 1, 1.0 / np.sqrt(n * share * (1 - share)))
        scale[-1] = max(scale[-1], 0.1 / np.sqrt(found.groups))
        start = np.array([np.log(share / (1 - share)), *np.zeros(p - 1), 0.5])
        level = laplace.Model([model.columns[j] for j in kept], model.mask, mean, spread)
        open_[name] = (level, start, scale)
    reached = laplace.maximise(blocks, *(list(a) for a in zip(*open_.values())), max_rounds) if open_ else []
    for (name, (level, _, _)), at in zip(open_.items(), reached):
        _estimates(fits[name], level, at)
    ended = [(fits[name], level, at.point) for (name, (level, _, _)), at in zip(open_.items(), reached) if fits[name].status == "ok"]
    if ended:
        done, levels, points = zip(*ended)
        for fit, effects in zip(done, blocks.effects(levels, points)):
            fit.level_effects = effects.withColumnRenamed("_g", group)
    return fits


def _estimates(fit: Fit, level: laplace.Model, reached: laplace.Reached) -> None:
    """What a search of the levelled columns has found, in terms of the columns themselves."""
    p, at, bend = fit.design.width + 1, reached.point, reached.sums.bend
    information = -bend[:p, :p]
    if not reached.converged or len(independent(information, 1e-7)) < p:
        fit.status = "not converged"
        fit.stats |= {"rounds": reached.rounds}
        return
    at = np.append(at[:-1], abs(at[-1]))
    boundary = bool(at[-1] < 1e-3)
    curve = information if boundary else -bend  # at the bound the sd says nothing about the coefficients
    back = np.eye(p)
    back[1:, 1:] = np.diag(1.0 / level.spread)
    back[0, 1:] = -level.mean / level.spread
    fit.beta, fit.cov = back @ at[:p], back @ np.linalg.inv(curve)[:p, :p] @ back.T
    value = reached.sums.value
    fit.stats |= {
        "log_likelihood": float(value), "aic": float(-2 * value + 2 * (p + 1)),
        "group_sd": float(at[-1]), "boundary": float(boundary), "rounds": reached.rounds, "passes": reached.passes,
    }
