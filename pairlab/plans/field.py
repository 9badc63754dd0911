"""The nest-box study: from a CSV of either layout to clean observations, pairs and scores.

Column names are those of the study tables; `pairlab.operators` itself is neutral.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.functions.columns import (
    VALID_RANGES, complete_rows, keep_kinds, null_out_of_range, with_product, with_ratio,
)
from pairlab.operators.groups import clean_groups
from pairlab.operators.members import attach_scores
from pairlab.operators.pairs import build_pairs, pair_by_join
from pairlab.operators.scaling import zscore
from pairlab.sources.observations import (
    MEASURES, V1_COLUMNS, V2_COLUMNS, normalize, read_observations, text_schema, to_double,
)

# Fixed values of the study tables.
KINDS = ("PF", "CF")
SIDES = ("female", "male")
SHARED = {
    "v1": ("yearAreaBox", "year", "nestbox", "fledge_nb", "hybridnest", "n_birds"),
    "v2": (
        "yearAreaBox", "year", "nestbox", "laying_date", "day_real_hatch", "hq",
        "habitat_quality", "hybridnest", "n_birds",
    ),
}
SCORED = ("mass", "patch_size", "sum_of_white_on_primaries", "adj_wing_patch", "adj_patch_size")


def read(
    spark: SparkSession, path: str, version: str = "v2", keep_observer: bool = False,
    site_filters: bool = True, columns: tuple | None = None, keep: tuple = (),
) -> DataFrame:
    """Typed rows of the two kinds, before any grouping; `keep` names unused columns to keep."""
    names = columns or {"v1": V1_COLUMNS, "v2": V2_COLUMNS}[version]
    raw = read_observations(spark, path, text_schema(names))
    numbers = [*MEASURES, "sum_of_white_on_primaries", "laying_date", "year"]
    df = to_double(raw, [c for c in numbers if c in raw.columns])
    df = df.withColumn("year", F.col("year").cast("int"))
    df = with_product(df, "patch_h", "patch_b", "patch_size")
    df = keep_kinds(df, "species", KINDS)
    return normalize(df, version, keep_observer, site_filters, keep=keep)


def clean(df: DataFrame, conflict_cols=("sex", "species"), null_id: str = "match") -> DataFrame:
    """Conflict groups removed, groups flagged and sized, impossible measures set to NULL."""
    known = F.col("nestbox") != "NANA"
    flagged = clean_groups(
        df, "ring_nb", "yearAreaBox", "species", conflict_cols, keep=known,
        mixed="hybridnest", size="n_birds", null_id=null_id,
    )
    ranged = null_out_of_range(flagged, VALID_RANGES)
    ranged = with_ratio(ranged, "sum_of_white_on_primaries", "mass", "adj_wing_patch")
    return with_ratio(ranged, "patch_size", "mass", "adj_patch_size")


def pairs(
    cleaned: DataFrame, version: str = "v2", keep_unmatched: bool = False, more_keys: tuple = ()
) -> DataFrame:
    """Female columns with `_f`, male columns with `_m`, shared columns (and `more_keys`) once."""
    shared = [c for c in (*SHARED[version], *more_keys) if c in cleaned.columns]
    return build_pairs(
        cleaned, "yearAreaBox", "sex", SIDES, shared, partner_id="ring_nb",
        keep_unmatched=keep_unmatched,
    )


def pairs_by_join(cleaned: DataFrame, version: str = "v2", keep_unmatched: bool = False) -> DataFrame:
    shared = [c for c in SHARED[version] if c in cleaned.columns]
    return pair_by_join(
        cleaned, "sex", SIDES, shared, size="n_birds", partner_id="ring_nb",
        keep_unmatched=keep_unmatched,
    )


def male_scores(cleaned: DataFrame) -> DataFrame:
    """Z-scores of complete male rows within year and kind."""
    males = complete_rows(cleaned.filter(F.col("sex") == SIDES[1]), SCORED)
    scored = zscore(males, ["year", "species"], SCORED)
    return scored.select("yearAreaBox", "ring_nb", *[f"z_{c}" for c in SCORED])


def with_male_scores(wide: DataFrame, scores: DataFrame) -> DataFrame:
    return attach_scores(
        wide, scores, {"yearAreaBox": "yearAreaBox", "ring_nb_m": "ring_nb"},
        {f"z_{c}": f"z_{c}_m" for c in SCORED},
    )

