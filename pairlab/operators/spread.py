"""Joins, running folds and quantiles that stay balanced when one key holds most rows.

The pattern used everywhere: aggregate per key (map-side combined, so a hot key
costs one row per task), decide on that small table, then bring the result back to
the rows with `attach`, which splits hot keys over many tasks. No row-level window
is ever opened over a key that was not first shown to be small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.session import cut_lineage

ROWS = "_rows"
_SALT = "_salt"
_PARTS = "_parts"
_BLOCK = "_block"
_TIE = "_tie"

# Keys of a categorical column (period, kind, level): above this they are treated as many.
FEW_KEYS = 10_000

# Key tables of at most this many bytes in memory are sent to the rows.
BROADCAST_BYTES = 64 << 20


def hot_rows(spark: SparkSession) -> int:
    """Rows one task may hold of one key. At most total/hot_rows keys can be hot."""
    return int(spark.conf.get("spark.pairlab.hotKeyRows", "4000000"))


def per_key(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """One row per key with its row count in `_rows` and the given aggregates."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS), *aggs)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join where NULL matches NULL; the key columns of `left` are kept."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    )
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__{k}" for k in keys])


def small_table(df: DataFrame, limit: int = FEW_KEYS) -> DataFrame | None:
    """`df` as a local table if it has at most `limit` rows, else None."""
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return None
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    return df.sparkSession.createDataFrame(rows, schema)


def settle(df: DataFrame) -> DataFrame:
    """Evaluate a summary table that is about to be used several times, once.

    It is written to the shared folder, and read back as a local table when it is small.
    """
    written = cut_lineage(df)
    local = small_table(written)
    return written if local is None else local


def attach(
    rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner", few: bool = False
) -> DataFrame:
    """Bring per-key values back to the rows of that key.

    `stats` comes from `per_key` (possibly filtered): one row per key, `_rows` = rows
    of that key in `rows`. With `few=True` the key is expected to be categorical: the
    table is counted, and broadcast when it has at most `FEW_KEYS` rows. Otherwise both
    sides are shuffled (the counted table is kept, not computed again), and a key above `hot_rows` is spread over
    ceil(_rows / hot_rows) tasks. The list of hot keys is broadcast; it has at most
    total rows / hot_rows entries. The salt depends only on row content and input
    partition, so a retried task produces the same rows.
    """
    if few:
        stats = cut_lineage(stats)
        local = small_table(stats)
        if local is not None:
            return null_safe_join(rows, F.broadcast(local.drop(ROWS)), keys, how)
    limit = hot_rows(rows.sparkSession)
    parts = F.ceil(F.col(ROWS) / F.lit(limit)).cast("int")
    hot = stats.filter(F.col(ROWS) > limit).select(*keys, parts.alias(_PARTS))
    spread = F.pmod(F.xxhash64(*rows.columns) + F.spark_partition_id(), F.col(_PARTS)).cast("int")
    salted = (
        null_safe_join(rows, F.broadcast(hot), keys, "left")
        .withColumn(_SALT, F.when(F.col(_PARTS).isNull(), F.lit(0)).otherwise(spread))
        .drop(_PARTS)
    )
    last = F.when(F.col(ROWS) > limit, parts - 1).otherwise(F.lit(0))
    copies = stats.withColumn(_SALT, F.explode(F.sequence(F.lit(0), last))).drop(ROWS)
    return null_safe_join(salted, copies, [*keys, _SALT], how).drop(_SALT)


def keep_keys(rows: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the `listed` keys of up to `hot_rows` rows; `listed` (one row each, with `_rows`) is evaluated once.

    Keys that fill at most `BROADCAST_BYTES`, by their number and longest value, go to the rows where they
    are. More meet them in a shuffle, from which a broadcast keeps the rows of hot keys away: these
    have to be listed, and are at most total rows / hot_rows.
    """
    listed = cut_lineage(listed.select(*keys, ROWS))
    hot = F.col(ROWS) > hot_rows(rows.sparkSession)
    wanted = listed.filter(~hot).drop(ROWS)
    n, *longest = wanted.agg(
        F.count(F.lit(1)), *[F.max(F.octet_length(F.col(k).cast("string"))) for k in keys]).first()
    if n * (64 + sum(size or 0 for size in longest)) <= BROADCAST_BYTES:
        return null_safe_join(rows, F.broadcast(wanted), keys, "left_semi")
    rest = null_safe_join(rows, F.broadcast(listed.filter(hot).drop(ROWS)), keys, "left_anti")
    return null_safe_join(rest, wanted, keys, "left_semi")


def attach_few(rows: DataFrame, settled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`attach` of a table that `settle` has returned: a small one is local already and goes straight to the rows."""
    local = small_table(settled)
    if local is None:
        return attach(rows, settled, keys)
    return null_safe_join(rows, F.broadcast(local.drop(ROWS)), keys, "inner")


def _split_blocks(
    df: DataFrame, by: Sequence[str], order: Sequence[Column]
) -> tuple[DataFrame, bool]:
    """Cut keys above `hot_rows` into ordered blocks; says whether it had to.

    Without a key all rows are one, which is always cut: no task ever holds the whole table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if by:
        limit = hot_rows(df.sparkSession)
        largest, total = per_key(df, by).agg(F.max(ROWS), F.sum(ROWS)).first()
        if not largest or largest <= limit:
            return df, False
        parts = max(parts, -(-total // limit))
    ranged = (
        df.withColumn(_TIE, F.spark_partition_id())
        .repartitionByRange(parts, *by, *order, _TIE)
        .withColumn(_BLOCK, F.spark_partition_id())
    )
    # Block numbers come from sampled range bounds: fix them before using them twice.
    return cut_lineage(ranged), True


def running_fold(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    value: Column,
    out: str,
    fold: Callable[[str], Column] = F.sum,
    inclusive: bool = True,
) -> DataFrame:
    """Running `F.sum` or `F.min` of `value` per key in `order`.

    `inclusive=False` stops before the row itself, so the first row gets NULL.

    Keys that fit a task use one window. If some key does not, or there is no key, rows are range
    partitioned on (key, order), each block is folded on its own, and the folded blocks
    (at most one per shuffle partition and key) carry over into the next ones.
    """
    order = list(order)
    work = df.withColumn("_value", value)
    work, split = _split_blocks(work, by, order)
    end = 0 if inclusive else -1
    if not split:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return work.withColumn(out, fold("_value").over(window)).drop("_value")

    keys = [*by, _BLOCK]
    before = (
        Window.partitionBy(*by).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = work.groupBy(*keys).agg(fold("_value").alias("_block_value"))
    carried = blocks.select(*keys, fold("_block_value").over(before).alias("_carried"))
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*order, _TIE)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    folded = work.withColumn("_inside", fold("_value").over(inside))
    joined = null_safe_join(folded, carried, keys, "left")
    both = F.coalesce(F.col("_inside") + F.col("_carried"), F.col("_inside"), F.col("_carried"))
    if fold is F.min:
        both = F.least("_inside", "_carried")
    return joined.withColumn(out, both).drop(
        "_value", "_inside", "_carried", _BLOCK, _TIE
    )


def quantiles_of_counts(
    present: DataFrame, by: Sequence[str], probs: Sequence[float], out: str, order: Sequence[Column]
) -> DataFrame:
    """Interpolated quantiles (position (n-1)q) per key as an array column `out`, plus `n`.

    `present` has counts `_c` of values `_v` in `order`. Ranks come from a running count that
    splits large keys, so no task buffers a group.
    """
    largest = per_key(present, by).agg(F.max(ROWS)).first()[0] if by else None
    if by and (largest or 0) <= hot_rows(present.sparkSession):
        window = Window.partitionBy(*by)
        upto = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        placed = present.select("*", F.sum("_c").over(upto).alias("_upto"), F.sum("_c").over(window).alias("n"))
    else:
        ranked = running_fold(present, by, order, F.col("_c"), "_upto")
        totals = present.groupBy(*by).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias(ROWS))
        if by:
            placed = attach(ranked, totals, by, few=True)
        else:
            placed = ranked.withColumn("n", totals.select("n").scalar())
    picks = []
    for i, q in enumerate(probs):
        low = F.floor((F.col("n") - 1) * F.lit(float(q)))
        high = F.ceil((F.col("n") - 1) * F.lit(float(q)))
        for name, rank in ((f"_lo{i}", low), (f"_hi{i}", high)):
            here = (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(name))
    grouped = placed.groupBy(*by).agg(F.max("n").alias("n"), *picks)
    values = []
    for i, q in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(q))
        part = position - F.floor(position)
        values.append(
            F.col(f"_lo{i}") + part * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
        )
    return grouped.select(*by, "n", F.array(*values).alias(out))


@contextmanager
def kept(df: DataFrame):
    """`df` evaluated once while several passes go over it."""
    rows = df.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def _bracketed(rows: DataFrame, by: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """Rows per key and value `_v` near the quantiles, and per key and gap between them (`_v` NULL)."""
    asked = [min(1.0, max(0.0, q + side * 2.0 / accuracy)) for q in sorted(probs) for side in (-1, 1)]
    marks = per_key(rows, by, F.percentile_approx("_v", F.array(*[F.lit(q) for q in asked]), accuracy).alias("_marks"))
    few = F.col(ROWS) <= 2 * accuracy
    ends = [F.array(*[F.col("_marks")[2 * i + side] for i in range(len(probs))]) for side in (0, 1)]
    marks = marks.select(*by, ROWS, *[
        F.when(few, F.array(F.lit(bound))).otherwise(e).alias(name)
        for e, bound, name in zip(ends, (float("-inf"), float("inf")), ("_low", "_high"))
    ])
    if by:
        near = attach_few(rows, settle(marks), by)
    else:
        only = marks.first()
        near = rows.withColumns({c: F.array(*[F.lit(float(v)) for v in only[c]]) for c in ("_low", "_high")})
    started = F.size(F.filter("_low", lambda m: m <= F.col("_v")))
    ended = F.size(F.filter("_high", lambda m: m < F.col("_v")))
    cells = near.select(*by, (started + ended).alias("_cell"), F.when(started > ended, F.col("_v")).alias("_v"))
    return cut_lineage(cells.groupBy(*by, "_cell", "_v").agg(F.count(F.lit(1)).alias("_c")))


def select_quantiles(
    rows: DataFrame, by: Sequence[str], probs: Sequence[float], out: str, accuracy: int = 5_000
) -> DataFrame:
    """Exact interpolated quantiles of `_v` per key, NULLs ignored, as an array `out` next to `n`; evaluated.

    Two passes: a mergeable sketch brackets every quantile of every key, then only the values inside
    the brackets, about 4 / `accuracy` of a key's rows per quantile, are counted one by one; the rest is
    counted per gap. Keys of up to 2 `accuracy` rows are counted whole. Should a bracket have missed its
    quantile, the passes are repeated with wider ones, at last the whole range.
    """
    present = rows.filter(F.col("_v").isNotNull()).withColumn("_v", F.col("_v").cast("double"))
    order = [F.col("_cell").asc(), F.col("_v").asc()]
    if not by and present.isEmpty():
        return present.groupBy().agg(F.count(F.lit(1)).alias("n")).select("n", F.array(*[F.lit(None).cast("double") for _ in probs]).alias(out))
    for width in (accuracy, -(-accuracy // 50), 1):
        found = settle(quantiles_of_counts(_bracketed(present, by, probs, width), by, probs, out, order))
        if found.filter(F.exists(out, lambda v: v.isNull())).isEmpty():
            break
    return found


def exact_quantiles(
    df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], out: str
) -> DataFrame:
    """Interpolated quantiles of `col` per key; `df` is evaluated once."""
    with kept(df.select(*by, F.col(col).alias("_v"))) as rows:
        return select_quantiles(rows, by, probs, out)
