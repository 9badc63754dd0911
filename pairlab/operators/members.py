"""Membership by id list, flags from subsets, score look-ups and level grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.operators.spread import FEW_KEYS, attach, null_safe_join, per_key


def keep_members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in `ids` (column `key`); NULL matches NULL.

    Membership is decided once per key, then the listed keys are attached to the rows,
    so a key holding most rows is spread over tasks.
    """
    found = null_safe_join(per_key(df, [key]), ids.select(key).distinct(), [key], "left_semi")
    return attach(df, found, [key])


def drop_members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in `ids`; never NULL, unlike SQL NOT IN."""
    found = null_safe_join(per_key(df, [key]), ids.select(key).distinct(), [key], "left_anti")
    return attach(df, found, [key])


def union_ids(lists: Sequence[DataFrame], key: str) -> DataFrame:
    together = lists[0].select(key)
    for ids in lists[1:]:
        together = together.union(ids.select(key))
    return together.distinct()


def keep_members_any(df: DataFrame, lists: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in at least one of the lists."""
    return keep_members(df, union_ids(lists, key), key)


def flag_members(df: DataFrame, ids: DataFrame, key: str, out: str) -> DataFrame:
    """Boolean column: is the key in `ids`. Never NULL."""
    listed = ids.select(key).distinct().withColumn(out, F.lit(True))
    stats = null_safe_join(per_key(df, [key]), listed, [key], "left")
    return attach(df, stats.withColumn(out, F.coalesce(out, F.lit(False))), [key])


def mark_from_subset(
    df: DataFrame, subset: DataFrame, keys: Sequence[str], out: str, dedupe: bool = True
) -> DataFrame:
    """1 on rows whose keys occur in `subset`, else 0.

    `dedupe=False` repeats a row once per match, as a plain left join does. The repeat
    count is attached as a number and expanded row by row.
    """
    keys = list(keys)
    hits = subset.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hits"))
    stats = null_safe_join(per_key(df, keys), hits, keys, "left")
    marked = attach(df, stats, keys).withColumn(out, F.col("_hits").isNotNull().cast("int"))
    if not dedupe:
        times = F.coalesce("_hits", F.lit(1))
        marked = marked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    return marked.drop("_hits", "_copy")


def attach_scores(
    pairs: DataFrame, scores: DataFrame, on: Mapping[str, str], renames: Mapping[str, str] | None = None
) -> DataFrame:
    """Left join scores whose key columns are named differently (`on`: pairs name -> scores name).

    Both tables hold one row per individual and group, so keys are near-unique on both
    sides; adaptive execution splits an uneven left side.
    """
    right = scores.withColumnsRenamed({s: p for p, s in on.items()})
    right = right.withColumnsRenamed(dict(renames or {}))
    return null_safe_join(pairs, right, list(on), "left")


def level_grid(spark: SparkSession, levels: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the listed levels, of any number; the last listed varies fastest."""
    size, columns = 1, {}
    for name, values in reversed(levels.items()):
        place = F.floor(F.col("id") / F.lit(size)) % F.lit(len(values))
        columns[name] = F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))
        size *= len(values)
    return spark.range(size).select(*[columns[name].alias(name) for name in levels])


def levels_of(df: DataFrame, col: str | Column, most: int = FEW_KEYS) -> list:
    """Sorted distinct non-NULL values of a categorical column.

    They become columns of a model or rows of a grid, so `most` of them may be collected; list the
    levels of a `Factor` to have more.
    """
    c = F.col(col) if isinstance(col, str) else col
    rows = (
        df.select(c.alias("_level")).filter(F.col("_level").isNotNull()).distinct()
        .limit(most + 1).collect()
    )
    if len(rows) > most:
        raise ValueError(f"{col} has more than {most} levels: not categorical")
    return sorted(r[0] for r in rows)
