"""NULL, blank, tie and zero cases, each where the obvious call gives another answer."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions import columns as c
from pairlab.operators import groups as g
from pairlab.operators import members as m
from pairlab.operators import summary as s
from pairlab.operators.pairs import build_pairs, pair_by_join
from pairlab.operators.scaling import center, prior_total, zscore
from pairlab.operators.spread import ROWS
from pairlab.sources.observations import read_observations, text_schema, to_double


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_distinct_count_with_and_without_null(spark):
    df = rows(spark, "k string, v string", ("a", "m"), ("a", None), ("b", "m"), ("b", "m"))
    with_null = {r.k: r.n for r in g.n_distinct(df, ["k"], "v", "n").collect()}
    without = {r.k: r.n for r in g.n_distinct(df, ["k"], "v", "n", count_null=False).collect()}
    assert with_null == {"a": 2, "b": 1} and without == {"a": 1, "b": 1}


def test_null_role_is_a_conflict(spark):
    df = rows(spark, "id string, role string", ("x", "male"), ("x", None), ("y", None), ("y", None))
    assert [r.id for r in g.conflicting_ids(df, "id", ["role"]).collect()] == ["x"]


@pytest.mark.parametrize("null_id, left", [("match", {"3"}), ("ignore", {"1", "2", "3"})])
def test_unknown_individuals(spark, null_id, left):
    df = rows(
        spark, "id string, grp string, role string",
        (None, "1", "male"), (None, "2", "female"), ("a", "2", "male"), ("b", "3", "male"),
    )
    kept = g.exclude_conflicts(df, "id", "grp", ["role"], null_id=null_id)
    assert {r.grp for r in kept.collect()} == left


def test_conflict_rows_scope(spark):
    df = rows(spark, "id string, grp string, kind string", ("a", "1", "P"), ("a", "2", "C"), ("b", "2", "C"))
    kept = g.exclude_conflicts(df, "id", "grp", ["kind"], scope="rows")
    assert [(r.id, r.grp) for r in kept.collect()] == [("b", "2")]


def test_membership_is_never_null(spark):
    df = rows(spark, "k string", ("a",), ("b",), (None,))
    ids = rows(spark, "k string", ("a",), (None,), (None,))
    assert sorted(m.keep_members(df, ids, "k").collect(), key=str) == sorted([("a",), (None,)], key=str)
    assert [r.k for r in m.drop_members(df, ids, "k").collect()] == ["b"]
    assert {(r.k, r.f) for r in m.flag_members(df, ids, "k", "f").collect()} == {
        ("a", True), ("b", False), (None, True),
    }


def test_subset_mark_repeats_only_when_asked(spark):
    df = rows(spark, "k string", ("a",), ("b",))
    hits = rows(spark, "k string", ("a",), ("a",), ("a",))
    assert sorted(m.mark_from_subset(df, hits, ["k"], "f").collect()) == [("a", 1), ("b", 0)]
    repeated = m.mark_from_subset(df, hits, ["k"], "f", dedupe=False)
    assert sorted(repeated.collect()) == [("a", 1)] * 3 + [("b", 0)]


def test_pairs_match_null_to_null(spark):
    df = rows(
        spark, "grp string, hatch int, role string, id string, n_rows long",
        ("1", None, "f", "a", 2), ("1", None, "m", "b", 2),
        ("2", 5, "f", "c", 2), ("2", None, "m", "d", 2),
        ("3", 5, "m", "e", 2), ("3", 5, "m", "f", 2),
        ("4", 5, "f", "g", 2), ("4", 5, None, "h", 2),
    )
    keys = ["grp", "hatch", "n_rows"]
    joined = pair_by_join(df, "role", ("f", "m"), keys, partner_id="id")
    fast = build_pairs(df, "grp", "role", ("f", "m"), keys, partner_id="id")
    assert [(r.id_f, r.id_m) for r in joined.collect()] == [("a", "b")]
    assert [(r.id_f, r.id_m) for r in fast.collect()] == [("a", "b")]
    both = [
        sorted((r.id_f, r.id_m or "") for r in build(keep_unmatched=True).collect())
        for build in (
            lambda **k: pair_by_join(df, "role", ("f", "m"), keys, partner_id="id", **k),
            lambda **k: build_pairs(df, "grp", "role", ("f", "m"), keys, partner_id="id", **k),
        )
    ]
    assert both[0] == both[1] == [("a", "b"), ("c", ""), ("g", "")]


def test_identical_rows_of_one_group(spark):
    df = rows(spark, "grp string, role string, id string, n_rows long", *[("1", "f", "a", 2)] * 2)
    fast = build_pairs(df, "grp", "role", ("f", "m"), ["grp", "n_rows"], partner_id="id", keep_unmatched=True)
    assert [(r.id_f, r.id_m) for r in fast.collect()] == [("a", None)] * 2


def test_filters_and_null(spark):
    df = rows(spark, "box string, early int", ("AVI1", 0), (None, 1), ("X", None), ("NANA", 0))
    assert {r.box for r in c.drop_containing(df, "box", "AVI").collect()} == {None, "X", "NANA"}
    assert {r.box for r in c.drop_sentinel(df, "box", "NANA").collect()} == {"AVI1", "X"}
    assert {r.box for r in c.drop_flagged(df, F.col("early") == 1).collect()} == {"AVI1", "NANA"}


def test_numbers_ratios_and_ranges(spark):
    df = to_double(rows(spark, "a string, b string", ("1.5", "0"), ("x", "2"), ("NaN", "4"), (None, "4")), ["a", "b"])
    assert [r.a for r in df.collect()] == [1.5, None, None, None]
    assert [r.q for r in c.with_ratio(df, "a", "b", "q").collect()] == [None] * 4
    ranged = rows(spark, "m double", (4.0,), (4.1,), (80.0,), (None,))
    assert [r.m for r in c.null_out_of_range(ranged, {"m": (4, 80)}).collect()] == [None, 4.1, None, None]


def test_zscore_of_one_row_and_of_constants(spark):
    df = rows(spark, "k string, x double", ("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 3.0))
    z = {(r.k, r.x): r.z_x for r in zscore(df, ["k"], ["x"]).collect()}
    assert z[("a", 1.0)] is None and z[("b", 2.0)] is None
    assert z[("c", 3.0)] == pytest.approx(0.5**0.5)
    assert {r.x_centered for r in center(df, ["k"], "x").collect()} == {0.0, -1.0, 1.0}


def test_history_with_two_groups_in_one_period(spark):
    df = rows(
        spark, "id string, period int, grp string, flag int",
        ("a", 1, "y", 1), ("a", 1, "x", 1), ("a", 2, "z", 0), ("b", 1, "w", 1),
    )
    hist = prior_total(df, "id", ["period", "grp"], "flag")
    assert {r.grp: r.prior for r in hist.collect()} == {"x": 0, "y": 1, "z": 2, "w": 0}


def test_levels_labels_and_crosstab(spark):
    df = rows(spark, "q string, f int", ("good", 1), ("bad", 0), ("odd", 0), (None, 1))
    ranked = c.with_levels(df, "q", ["bad", "good"], ["low", "high"])
    assert [(r.q_rank, r.q_label) for r in ranked.collect()] == [(1, "high"), (0, "low"), (None, None), (None, None)]
    assert s.crosstab(df, "q", "f").count() == 3
    assert s.crosstab(df, "q", "f", keep_null=True).count() == 4
    assert {r.q for r in c.fill_label(df, "q", "unknown").collect()} == {"good", "bad", "odd", "unknown"}


def test_csv_reading(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,"",NA\n2,,NaN\nNA, ,3\n')
    schema = T.StructType([*text_schema(["a", "b"]).fields, T.StructField("c", T.DoubleType())])
    got = [tuple(r) for r in read_observations(spark, str(path), schema).collect()]
    assert got == [("1", None, None), ("2", None, None), (None, None, 3.0)]


def test_always_positive_skips_unknown_flags(spark):
    df = rows(spark, "id string, period int, f int", ("a", 1, 1), ("a", 2, None), ("b", 1, 1), ("b", 1, 0))
    got = s.always_positive_ids(df, "id", "period", "f").collect()
    assert [(r.id, r.n_obs, r.n_periods) for r in got] == [("a", 1, 1)]


def test_conflicts_carry_row_counts(spark):
    df = rows(spark, "id string, role string", ("x", "m"), ("x", "f"), ("x", "f"))
    assert g.conflicting_ids(df, "id", ["role"]).first()[ROWS] == 3
