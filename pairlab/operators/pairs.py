"""Two-sided pairs from groups of two rows, and partner profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.columns import suffix_columns
from pairlab.operators.spread import ROWS, hot_rows, keep_keys, null_safe_join, per_key


def pair_by_join(
    df: DataFrame,
    role: str,
    sides: tuple[str, str],
    keys: Sequence[str],
    suffixes: tuple[str, str] = ("_f", "_m"),
    size: str = "n_rows",
    partner_id: str | None = None,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Definition of a pair: first sides left-joined to second sides on all shared columns.

    Only groups of two rows take part, so a key never multiplies rows.
    """
    two = df.filter(F.col(size) == 2)
    first = suffix_columns(two.filter(F.col(role) == sides[0]), suffixes[0], keys)
    second = suffix_columns(two.filter(F.col(role) == sides[1]), suffixes[1], keys)
    joined = null_safe_join(first, second, list(keys), "left")
    if keep_unmatched:
        return joined
    return joined.filter(F.col(partner_id + suffixes[1]).isNotNull())


def build_pairs(
    df: DataFrame,
    group: str,
    role: str,
    sides: tuple[str, str],
    keys: Sequence[str],
    suffixes: tuple[str, str] = ("_f", "_m"),
    partner_id: str | None = None,
    keep_unmatched: bool = False,
    differs: Mapping[str, str] | None = None,
    excluded: DataFrame | None = None,
) -> DataFrame:
    """Wide pairs, their rows moved once.

    `keys` are the columns shared by both sides (must include `group`); a pair needs all
    of them equal, NULL equal to NULL. `differs` adds 0/1 columns saying whether the two
    rows differ in a column (a mixed flag), `excluded` lists groups to leave out (one row
    each). Equals `pair_by_join`. Groups that can be pairs are found first, by counts that hash; only
    their rows are aggregated column by column, so a group holding most rows costs nothing more than its scan.
    """
    shared = [k for k in keys if k != group]
    rest = [c for c in df.columns if c not in keys]
    build = _either_side if keep_unmatched else _matched
    rows = _rows_of_two(df, group, role, sides, None if keep_unmatched else partner_id, excluded)
    return build(rows, group, role, sides, shared, rest, suffixes, partner_id, differs or {})


def _rows_of_two(df, group, role, sides, partner_id, excluded) -> DataFrame:
    """Rows of the groups of two that have a first side and, with `partner_id`, a known second one."""
    second = F.lit(True) if partner_id is None else F.max(
        F.coalesce((F.col(role) == sides[1]) & F.col(partner_id).isNotNull(), F.lit(False)))
    stats = per_key(
        df, [group], F.max(F.coalesce(F.col(role) == sides[0], F.lit(False))).alias("_first"), second.alias("_second"),
    )
    two = (F.col(ROWS) == 2) & F.col("_first") & F.col("_second")
    hot = F.col(ROWS) > hot_rows(df.sparkSession)
    listed = stats.filter(two | hot)
    if excluded is not None:
        marked = null_safe_join(listed, excluded.select(group, F.lit(True).alias("_out")), [group], "left")
        listed = marked.filter(F.col("_out").isNull() | hot)
    return keep_keys(df, listed, [group])


def _matched(df, group, role, sides, shared, rest, suffixes, partner_id, differs) -> DataFrame:
    """Groups of one row per side. One aggregate per output column, so unused ones are pruned."""
    is_side = [F.col(role) == s for s in sides]

    def of(side: int, c: Column) -> Column:
        return F.max(F.when(is_side[side], c))

    found = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(is_side[0]).alias("_n0"),
        F.count_if(is_side[1]).alias("_n1"),
        of(1, F.col(partner_id).isNotNull()).alias("_known"),
        *[of(s, F.col(c)).alias(f"_{s}_{c}") for c in [*shared, *rest] if c != role for s in (0, 1)],
    )

    def value(side: int, c: str) -> Column:
        return F.lit(sides[side]) if c == role else F.col(f"_{side}_{c}")

    same = F.lit(True)
    for k in shared:
        same = same & value(0, k).eqNullSafe(value(1, k))
    pairs = found.filter("_n = 2 AND _n0 = 1 AND _n1 = 1 AND _known").filter(same)
    return pairs.select(
        group,
        *[(~value(0, c).eqNullSafe(value(1, c))).cast("int").alias(n) for n, c in differs.items()],
        *[value(0, k).alias(k) for k in shared],
        *[value(s, c).alias(c + suffixes[s]) for s in (0, 1) for c in rest],
    )


def _either_side(df, group, role, sides, shared, rest, suffixes, partner_id, differs) -> DataFrame:
    """First sides of groups of two with their partner or NULL.

    The two rows of such a group are its smallest and its largest row.
    """
    row = F.struct(role, *[c for c in df.columns if c != role])
    small = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.min(row).alias("_a"), F.max(row).alias("_b")
    ).filter("_n = 2")
    same = F.lit(True)
    for k in shared:
        same = same & F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}"))

    def side(a: str, b: str) -> Column:
        is_first = F.col(f"{a}.{role}") == sides[0]
        matched = same & F.coalesce(F.col(f"{b}.{role}") == sides[1], F.lit(False))
        return F.when(
            is_first,
            F.struct(F.col(a).alias("x"), F.when(matched, F.col(b)).alias("y")),
        )

    both = F.filter(F.array(side("_a", "_b"), side("_b", "_a")), lambda s: s.isNotNull())
    flags = [
        (~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).cast("int").alias(n)
        for n, c in differs.items()
    ]
    pairs = small.select(group, *flags, F.explode(both).alias("_p"))
    return pairs.select(
        group, *differs,
        *[F.col(f"_p.x.{k}").alias(k) for k in shared],
        *[F.col(f"_p.x.{c}").alias(c + suffixes[0]) for c in rest],
        *[F.col(f"_p.y.{c}").alias(c + suffixes[1]) for c in rest],
    )


def _sd_of_parts(out: str) -> Column:
    """Sample sd from the numbers, means and variances of parts: squares within them and between them."""
    n, mean, var = (F.col(f"_{c}_{out}") for c in "kav")
    total = F.sum(n * mean)
    between = F.greatest(F.sum(n * mean * mean) - F.try_divide(total * total, F.sum(n)), F.lit(0.0))
    return F.sqrt(F.try_divide(F.sum(n * var) + between, F.sum(n) - 1))


def partner_profile(
    pairs: DataFrame,
    id_col: str,
    flag: str,
    measures: Mapping[str, str],
    constants: Sequence[str] = (),
    sd_of: Mapping[str, str] | None = None,
    period: str | None = None,
) -> DataFrame:
    """Per individual: mean of its partners' measures over unflagged pairs.

    `n_flagged` counts all flagged pairs, taken before flagged pairs are set aside, and
    individuals with no unflagged pair are dropped. `measures` and `sd_of` map output
    name to input column. With `period`, `share_periods` = flagged pairs / distinct
    periods over all pairs (it can exceed 1).
    """
    plain = F.col(flag) == 0
    kept = {out: F.when(plain, F.col(c)) for out, c in measures.items()}
    spread = {out: F.when(plain, F.col(c)).cast("double") for out, c in (sd_of or {}).items()}
    if not period:
        profile = pairs.groupBy(id_col).agg(
            F.sum(flag).alias("n_flagged"), F.sum(plain.cast("int")).alias("n_partners"),
            *[F.max(c).alias(c) for c in constants], *[F.avg(c).alias(out) for out, c in kept.items()],
            *[F.stddev_samp(c).alias(out) for out, c in spread.items()],
        )
    else:
        # One pass: a row per individual and period, whose sums add up and whose number is the periods'.
        by_period = pairs.groupBy(id_col, period).agg(
            F.sum(flag).alias("_f"), F.sum(plain.cast("int")).alias("_p"),
            *[F.max(c).alias(c) for c in constants],
            *[e for out, c in kept.items() for e in (
                F.sum(c.cast("double")).alias(f"_s_{out}"), F.count(c).alias(f"_n_{out}"))],
            *[e for out, c in spread.items() for e in (
                F.count(c).alias(f"_k_{out}"), F.avg(c).alias(f"_a_{out}"), F.var_pop(c).alias(f"_v_{out}"))],
        )
        profile = by_period.groupBy(id_col).agg(
            F.sum("_f").alias("n_flagged"), F.sum("_p").alias("n_partners"),
            *[F.max(c).alias(c) for c in constants],
            *[F.try_divide(F.sum(f"_s_{out}"), F.sum(f"_n_{out}")).alias(out) for out in kept],
            F.count(F.lit(1)).alias("_periods"), *[_sd_of_parts(out).alias(out) for out in spread],
        )
        profile = profile.withColumn("share_periods", F.try_divide("n_flagged", "_periods")).drop("_periods")
    return profile.filter("n_partners > 0").withColumn(
        "ever_flagged", (F.col("n_flagged") > 0).cast("int")
    )
