"""Group-level facts on rows: size, mixed flag, conflicts, repeat rows, group numbers."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.operators.spread import ROWS, attach, hot_rows, per_key, running_fold
from pairlab.session import cut_lineage

_BAD = "_bad"
_KEPT = "_kept"

_COMPARE = {
    "==": operator.eq, "!=": operator.ne, ">": operator.gt,
    ">=": operator.ge, "<": operator.lt, "<=": operator.le,
}


def several_values(cols: Sequence[str], where: Column | None = None) -> Column:
    """Aggregate: whether the rows (those of `where`) hold more than one combination of `cols`, NULL being a value.

    Smallest and largest of two 64-bit hashes, so that Spark combines plain numbers and never sorts.
    """
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    hashes = [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]
    if where is not None:
        hashes = [F.when(where, h) for h in hashes]
    return F.coalesce((F.min(hashes[0]) != F.max(hashes[0])) | (F.min(hashes[1]) != F.max(hashes[1])), F.lit(False))


def per_group_of(df: DataFrame, key: str, kind: str, out: str) -> DataFrame:
    """Per group: its rows (`_rows`) and whether it holds several distinct values of `kind`.

    One combined aggregate, so a large group is spread. NULL counts as a value.
    """
    return per_key(df, [key], several_values([kind]).cast("int").alias(out))


def n_distinct(df: DataFrame, by: Sequence[str], col: str, out: str, count_null: bool = True) -> DataFrame:
    """Distinct values of `col` per key, in two combined steps so a hot key is spread."""
    pairs = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    counted = F.count(F.lit(1)) if count_null else F.count(col)
    return pairs.groupBy(*by).agg(counted.alias(out), F.sum("_n").alias(ROWS))


def conflicting_ids(
    df: DataFrame, id_col: str, cols: Sequence[str], null_id: str = "match"
) -> DataFrame:
    """Individuals recorded with more than one value of any of `cols` (plus their row count).

    `null_id="match"` treats unknown individuals as one individual; `"ignore"` leaves
    them out.
    """
    return _conflicts(df, id_col, cols, null_id).filter(_BAD).drop(_BAD)


def _conflicts(df: DataFrame, id_col: str, cols: Sequence[str], null_id: str) -> DataFrame:
    """Every individual with its rows and whether it is in conflict (`_bad`)."""
    if null_id not in ("match", "ignore"):
        raise ValueError(f"null_id must be 'match' or 'ignore', not {null_id!r}")
    bad = several_values(cols)
    if null_id == "ignore":
        bad = bad & F.col(id_col).isNotNull()
    return per_key(df, [id_col], bad.alias(_BAD))


def touched_groups(df: DataFrame, ids: DataFrame, id_col: str, group: str) -> DataFrame:
    """Groups holding a row of any of `ids` (one row per individual, with `_rows`)."""
    narrow = df.select(id_col, group)
    return attach(narrow, ids, [id_col], few=True).select(group).distinct()


def _untouched(
    df: DataFrame, id_col: str, group: str, cols: Sequence[str], null_id: str,
    keep: Column | None = None, facts_of: Sequence[str] = (),
    facts: Callable[[Column], list[Column]] = lambda kept: [],
) -> DataFrame:
    """Groups without a conflicting individual, with their kept rows (`_rows`) and `facts` of these (from `facts_of`).

    Few conflicting individuals are marked on the rows where they are; many are brought there by a
    salted join, for which individuals of very many rows are listed whether in conflict or not.
    """
    found = _conflicts(df, id_col, cols, null_id)
    listed = found.filter(F.col(_BAD) | (F.col(ROWS) > hot_rows(df.sparkSession)))
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    narrow = df.select(*dict.fromkeys([id_col, group, *facts_of]), kept.alias(_KEPT))
    marked = attach(narrow, listed, [id_col], "left", few=True)
    return marked.groupBy(group).agg(
        F.count_if(_KEPT).alias(ROWS), F.max(F.coalesce(_BAD, F.lit(False))).alias(_BAD), *facts(F.col(_KEPT)),
    ).filter((F.col(ROWS) > 0) & ~F.col(_BAD)).drop(_BAD)


def exclude_conflicts(
    df: DataFrame,
    id_col: str,
    group: str,
    cols: Sequence[str],
    scope: str = "groups",
    null_id: str = "match",
) -> DataFrame:
    """Remove conflicting individuals: their whole groups, or (`scope="rows"`) only their rows."""
    if scope == "rows":
        good = _conflicts(df, id_col, cols, null_id).filter(~F.col(_BAD)).drop(_BAD)
        return attach(df, good, [id_col])
    if scope != "groups":
        raise ValueError(f"scope must be 'rows' or 'groups', not {scope!r}")
    return attach(df, _untouched(df, id_col, group, cols, null_id), [group], few=True)


def with_group_size(df: DataFrame, key: str | Sequence[str], out: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    stats = per_key(df, keys)
    return attach(df, stats.withColumn(out, F.col(ROWS)), keys)


def with_mixed_flag(df: DataFrame, key: str, kind: str, out: str) -> DataFrame:
    return attach(df, per_group_of(df, key, kind, out), [key])


def clean_groups(
    df: DataFrame,
    id_col: str,
    group: str,
    kind: str,
    conflict_cols: Sequence[str],
    keep: Column | None = None,
    mixed: str = "mixed",
    size: str = "n_rows",
    null_id: str = "match",
) -> DataFrame:
    """Exclude conflict groups and flag the rest: one aggregate per individual, one per group, one row-level shuffle.

    Conflicts are looked for in all of `df`; `keep` filters the rows afterwards, before
    sizes and flags are taken. Same result as `exclude_conflicts`, the filter,
    `with_mixed_flag` and `with_group_size` one after the other.
    """
    good = _untouched(
        df, id_col, group, conflict_cols, null_id, keep, [kind],
        lambda kept: [several_values([kind], kept).cast("int").alias(mixed)],
    )
    rows = df if keep is None else df.filter(keep)
    return attach(rows, good.withColumn(size, F.col(ROWS)), [group], few=True)


def keep_groups_any(df: DataFrame, key: str, predicate: Column) -> DataFrame:
    """Rows of the groups in which at least one row meets the predicate."""
    stats = per_key(df, [key], F.max(F.coalesce(predicate, F.lit(False))).alias("_any"))
    return attach(df, stats.filter("_any").drop("_any"), [key])


def keep_groups_ndistinct(
    df: DataFrame, key: str, col: str, op: str, n: int, count_null: bool = True
) -> DataFrame:
    """Rows of the groups whose number of distinct values of `col` compares to `n`."""
    stats = n_distinct(df, [key], col, "_distinct", count_null)
    return attach(df, stats.filter(_COMPARE[op](F.col("_distinct"), n)).drop("_distinct"), [key])


def keep_repeated(
    df: DataFrame, keys: Sequence[str], predicate: Column | None = None, out: str = "n_entries"
) -> DataFrame:
    """Rows of keys that occur more than once; `predicate` then filters the rows themselves."""
    keys = list(keys)
    stats = per_key(df, keys).filter(F.col(ROWS) > 1).withColumn(out, F.col(ROWS))
    rows = df if predicate is None else df.filter(predicate)
    return attach(rows, stats, keys)


def with_group_total(df: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """Sum over the group on every row; a later filter does not change it."""
    return attach(df, per_key(df, [key], F.sum(value).alias(out)), [key])


def with_history_totals(
    df: DataFrame, id_col: str, period: str, flag: str,
    n_periods: str = "n_periods", n_flagged: str = "n_flagged", share: str = "share_flagged",
) -> DataFrame:
    """Distinct periods, flag total and total / periods of each individual on its rows."""
    by_period = df.groupBy(id_col, period).agg(
        F.sum(flag).alias("_f"), F.count(F.lit(1)).alias("_n")
    )
    totals = by_period.groupBy(id_col).agg(
        F.count(F.lit(1)).alias(n_periods), F.sum("_f").alias(n_flagged), F.sum("_n").alias(ROWS)
    )
    return attach(df, totals.withColumn(share, F.try_divide(n_flagged, n_periods)), [id_col])


def with_group_id(df: DataFrame, key: str, out: str) -> DataFrame:
    """Dense 1-based number of the group in key order."""
    stats = cut_lineage(per_key(df, [key]))
    numbered = running_fold(stats, [], [F.col(key).asc()], F.lit(1), out)
    return attach(df, numbered, [key])


def classify_pairs(
    df: DataFrame, group: str, role: str, kind: str,
    first: str, second: str, home: str, other: str, size: str | None = None,
    out: str = "pair", group_id: str | None = None,
) -> DataFrame:
    """Keep groups whose first side is of kind `home` and label them.

    One row: `unknown`; more than two: `extra_pair`; otherwise by whether the second
    side is of kind `other`. `size` names an existing group size column; without it
    rows are counted here.
    """
    anchored = F.max(
        F.coalesce((F.col(role) == first) & (F.col(kind) == home), F.lit(False))
    ).alias("_anchored")
    crossed = F.max(
        F.coalesce((F.col(role) == second) & (F.col(kind) == other), F.lit(False))
    ).alias("_crossed")
    rows = (F.max(size) if size else F.count(F.lit(1))).alias("_size")
    stats = per_key(df, [group], anchored, crossed, rows).filter("_anchored")
    label = (
        F.when(F.col("_size") == 1, "unknown")
        .when(F.col("_size") > 2, "extra_pair")
        .when(F.col("_crossed"), f"{first}{home}_{second}{other}")
        .otherwise(f"{first}{home}_{second}{home}")
    )
    stats = stats.withColumn(out, label).drop("_anchored", "_crossed", "_size")
    if group_id:
        stats = running_fold(cut_lineage(stats), [], [F.col(group).asc()], F.lit(1), group_id)
    return attach(df, stats, [group])
