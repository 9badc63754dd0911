"""Whole analyses over a pairs table, composed from the operators.

Functions take column names, so they serve any table of the pair layout.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.columns import binarize
from pairlab.operators import mixed
from pairlab.operators import regression as reg
from pairlab.operators.design import Factor
from pairlab.operators.inference import adjust_bh, pca, proportion_test
from pairlab.operators.members import flag_members, level_grid, levels_of
from pairlab.operators.scaling import prior_total, zscore
from pairlab.operators.summary import count_by, rate_by, share_within, switching_ids
from pairlab.session import cut_lineage


def share_by_kind(pairs: DataFrame, kind: str, flag: str) -> DataFrame:
    """Counts of flagged and plain pairs per kind and their share of the kind."""
    return share_within(count_by(pairs, [kind, flag]), [kind])


def share_by_period(pairs: DataFrame, period: str, flag: str) -> DataFrame:
    """Share per period, tested against the overall share, with adjusted p."""
    return adjust_bh(proportion_test(pairs, [period], flag), "p_value")


def switchers(pairs: DataFrame, id_col: str, period: str, flag: str) -> DataFrame:
    """Pairs of the individuals that were seen in both states."""
    ids = switching_ids(pairs, id_col, period, flag)
    return flag_members(pairs, ids, id_col, "switches").filter("switches").drop("switches")


def history(pairs: DataFrame, id_col: str, period: str, tie: str, flag: str) -> DataFrame:
    """Pairs with the number of earlier flagged pairs of the individual, and whether any."""
    # history is read by several models: keep its input
    rows = prior_total(cut_lineage(pairs), id_col, [period, tie], flag, "prior")
    return binarize(rows, "prior", "any_prior")


def history_rates(hist: DataFrame, kind: str, flag: str) -> DataFrame:
    return rate_by(hist, [kind, "any_prior"], flag)


def history_models(hist: DataFrame, kind: str, flag: str, period: str) -> dict[str, reg.Fit]:
    """Five models of the history effect: fixed periods, then random periods with the number of earlier
    flagged pairs or whether there were any, with and without its product with the kind."""
    return {
        "m1": reg.fit_glm(hist, flag, ["prior", kind, Factor(period)], "binomial"),
        "m2": mixed.fit_glmm(hist, flag, [("prior", kind)], period),
        "m3": mixed.fit_glmm(hist, flag, ["prior", kind], period),
        "m4": mixed.fit_glmm(hist, flag, ["any_prior", kind], period),
        "m5": mixed.fit_glmm(hist, flag, [("any_prior", kind)], period),
    }


def history_predictions(
    hist: DataFrame, kind: str, flag: str, period: str, prior: str, values: Sequence[int]
) -> DataFrame:
    """Predicted share per kind and history with an interval, random period at zero."""
    fit = mixed.fit_glmm(hist, flag, [prior, kind], period)
    grid = level_grid(hist.sparkSession, {prior: list(values), kind: levels_of(hist, kind)})
    return reg.marginal_predictions(fit, grid)


def timing_models(timed: DataFrame, day: str, kind: str, flag: str, period: str) -> dict[str, reg.Fit]:
    """Models of the centred and the scaled day, alone and with the kind, random periods."""
    return {
        f"{d}{label}": mixed.fit_glmm(timed, flag, [(d, kind) if label else d], period)
        for d in (f"{day}_relative", f"z_{day}") for label in ("", ":kind")
    }


def level_models(pairs: DataFrame, levels: Sequence, kind: str, flag: str, period: str) -> dict[str, reg.Fit]:
    """Models of each categorical term, alone and with the kind, random periods."""
    name = lambda t: t.col if isinstance(t, Factor) else t
    return {
        f"{name(t)}{label}": mixed.fit_glmm(pairs, flag, [(t, kind) if label else t], period)
        for t in levels for label in ("", ":kind")
    }


def intercept_models(df: DataFrame, flag: str, models: dict[str, Sequence], group: str) -> dict[str, reg.Fit]:
    """Logistic models of several sets of terms on the same complete rows, random `group`.

    `df` is read a few times: what is costly to find should be written.
    """
    rows = df.select(*dict.fromkeys([flag, group, *(c for terms in models.values() for c in reg.term_inputs(terms))])).dropna()
    return mixed.fit_glmms(rows, flag, models, group)


def timing(pairs: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """Day relative to the mean of its key, and its z-score."""
    return zscore(pairs, by, [day], centered="_relative")


def level_effect(pairs: DataFrame, level: str, kind: str, flag: str, period: str, levels: Sequence[str]) -> DataFrame:
    """Predicted share per level and kind with an interval, random period at zero."""
    fit = mixed.fit_glmm(pairs, flag, [(Factor(level, tuple(levels)), kind)], period)
    grid = level_grid(pairs.sparkSession, {level: list(levels), kind: levels_of(pairs, kind)})
    return reg.marginal_predictions(fit, grid)


def condition_fit(df: DataFrame, y: str, terms: Sequence, id_col: str, period: str) -> reg.Fit:
    """A measure on size, next to random intercepts of individual and period."""
    return mixed.fit_lmm(df, y, terms, id_col, period)


def condition_index(df: DataFrame, y: str, terms: Sequence, id_col: str, period: str) -> DataFrame:
    """Residual of a measure on size, next to random intercepts of individual and period."""
    return reg.with_residual(df, condition_fit(df, y, terms, id_col, period), "condition")


def size_components(df: DataFrame, cols: Sequence[str], kind: str, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Principal components of size measures, each kind by itself: loadings, and the rows with their first score."""
    loadings, scored = [], []
    for k in kinds:
        of = df.filter(F.col(kind) == k)
        fit = pca(of, cols)
        loadings.append(fit.loadings().select(F.lit(k).alias(kind), "*"))
        scored.append(fit.with_scores(of).drop(*[f"PC{j + 2}" for j in range(len(cols) - 1)]))
    return reduce(DataFrame.unionByName, loadings), reduce(DataFrame.unionByName, scored)


def pair_class_counts(classes: DataFrame, group_id: str, pair: str) -> DataFrame:
    """Groups and rows per pair class."""
    per_group = classes.groupBy(group_id, pair).agg(F.count(F.lit(1)).alias("_n"))
    return per_group.groupBy(pair).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("_n").alias("n_rows"))
