"""The hand fixture: from CSV text to pairs, histories and profiles."""

import csv

import pytest
from pyspark.sql import functions as F

from pairlab.operators import groups as g
from pairlab.operators import summary as s
from pairlab.operators.pairs import partner_profile
from pairlab.operators.scaling import prior_total
from pairlab.plans import field
from pairlab.sources.observations import V2_COLUMNS

# ring_nb, yearAreaBox, nestbox, year, sex, species, mass
ROWS = [
    ("A1", "2001X1", "X1", 2001, "female", "PF", "13"),
    ("A2", "2001X1", "X1", 2001, "male", "CF", "14"),
    ("A1", "2002X2", "X2", 2002, "female", "PF", "12"),
    ("A3", "2002X2", "X2", 2002, "male", "PF", "15"),
    ("A1", "2003X3", "X3", 2003, "female", "PF", "abc"),
    ("A2", "2003X3", "X3", 2003, "male", "CF", "80"),
    ("A4", "2001X4", "X4", 2001, "female", "CF", "13"),
    ("A5", "2001X5", "X5", 2001, "female", "CF", "13"),
    ("A6", "2001X5", "X5", 2001, "female", "CF", "13"),
    ("A7", "2001X6", "X6", 2001, "male", "CF", "13"),
    ("A7", "2002X7", "X7", 2002, "female", "CF", "13"),
    ("A8", "2002X7", "X7", 2002, "male", "CF", "13"),
    ("A9", "2001NANA", "NANA", 2001, "female", "PF", "13"),
    ("A10", "2001AVI1", "AVI1", 2001, "female", "PF", "13"),
    ("A11", "2001X4", "X4", 2001, "male", "GT", "13"),
]
NAMES = ("ring_nb", "yearAreaBox", "nestbox", "year", "sex", "species", "mass")


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("field") / "observations.csv"
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, V2_COLUMNS)
        out.writeheader()
        for row in ROWS:
            cells = dict.fromkeys(V2_COLUMNS, "NA") | {"early": 0, "tarsus": "20", "patch_h": "7", "patch_b": "8"}
            out.writerow(cells | dict(zip(NAMES, row)))
    return field.read(spark, str(path), "v2")


@pytest.fixture(scope="module")
def cleaned(raw):
    return field.clean(raw).cache()


@pytest.fixture(scope="module")
def wide(cleaned):
    return field.pairs(cleaned).cache()


def test_rows_dropped_before_grouping(raw):
    assert {r.ring_nb for r in raw.collect()} == {f"A{i}" for i in range(1, 10)}


def test_layout_columns(raw):
    assert not {"X", "measurer", "early", "nb_eggs"} & set(raw.columns)
    assert {"age_category", "patch_size"} <= set(raw.columns)


def test_conflicts_and_excluded_groups(raw):
    bad = g.conflicting_ids(raw, "ring_nb", ["sex"])
    assert [r.ring_nb for r in bad.collect()] == ["A7"]
    groups = g.touched_groups(raw, bad, "ring_nb", "yearAreaBox")
    assert {r[0] for r in groups.collect()} == {"2001X6", "2002X7"}


def test_clean_groups_equal_separate_steps(raw, cleaned):
    step = g.exclude_conflicts(raw, "ring_nb", "yearAreaBox", ["sex", "species"])
    step = step.filter("nestbox != 'NANA'")
    step = g.with_mixed_flag(step, "yearAreaBox", "species", "hybridnest")
    step = g.with_group_size(step, "yearAreaBox", "n_birds")
    cols = ["ring_nb", "yearAreaBox", "hybridnest", "n_birds"]
    assert sorted(step.select(cols).collect()) == sorted(cleaned.select(cols).collect())


def test_mass_after_cleaning(cleaned):
    rows = cleaned.filter("yearAreaBox = '2003X3'").select("mass").collect()
    assert [r.mass for r in rows] == [None, None]


def test_group_sizes(cleaned):
    sizes = {r.yearAreaBox: r.n_birds for r in cleaned.collect()}
    assert sizes == {"2001X1": 2, "2002X2": 2, "2003X3": 2, "2001X4": 1, "2001X5": 2}


def test_pairs(wide):
    got = {r.yearAreaBox: r.hybridnest for r in wide.collect()}
    assert got == {"2001X1": 1, "2002X2": 0, "2003X3": 1}
    assert "year" in wide.columns and "year_f" not in wide.columns


@pytest.mark.parametrize("keep", [False, True])
def test_fast_pairs_equal_the_join(cleaned, keep):
    fast = field.pairs(cleaned, keep_unmatched=keep)
    joined = field.pairs_by_join(cleaned, keep_unmatched=keep)
    key = lambda r: (r.yearAreaBox, r.ring_nb_f)
    assert sorted(fast.columns) == sorted(joined.columns)
    a = sorted(fast.select(joined.columns).collect(), key=key)
    assert a == sorted(joined.collect(), key=key)
    unmatched = [r for r in a if r.ring_nb_m is None]
    assert len(unmatched) == (2 if keep else 0)


def test_share_of_kind(wide):
    share = s.share_by(wide, ["species_f"], "hybridnest").collect()
    assert [(r.species_f, r.hits, r.total) for r in share] == [("PF", 2, 3)]


def test_history_and_switching(wide):
    hist = prior_total(wide, "ring_nb_f", ["year", "yearAreaBox"], "hybridnest")
    assert [r.prior for r in hist.orderBy("year").collect()] == [0, 1, 1]
    found = s.switching_ids(wide, "ring_nb_f", "year", "hybridnest").collect()
    assert [(r.ring_nb_f, r.n_periods, r.flag_values) for r in found] == [("A1", 3, 2)]


def test_profile(wide):
    profile = partner_profile(
        wide, "ring_nb_f", "hybridnest", {"avg_mass_m": "mass_m"}, period="year",
        sd_of={"sd_mass_m": "mass_m"},
    ).first()
    assert (profile.avg_mass_m, profile.n_partners, profile.n_flagged) == (15, 1, 2)
    assert profile.share_periods == pytest.approx(2 / 3)
    assert profile.sd_mass_m is None and profile.ever_flagged == 1


def test_profile_sd_over_periods(spark):
    """Periods with one, several and no measures; flagged rows and NULLs do not count."""
    rows = [
        ("a", 1, 0, 10.0), ("a", 1, 0, 14.0), ("a", 2, 0, 30.0), ("a", 3, 1, 99.0), ("a", 3, 0, None), ("a", 4, 0, -2.5),
        ("b", 1, 0, 7.0), ("b", 2, 0, None), ("c", 1, 0, 1e6), ("c", 2, 0, 1e6), (None, 1, 0, 1.0), (None, 2, 0, 2.0),
    ]
    df = spark.createDataFrame(rows, "i string, t int, f int, x double")
    args = (df, "i", "f", {"mean": "x"})
    whole = {r.i: (r.mean, r.sd) for r in partner_profile(*args, sd_of={"sd": "x"}).collect()}
    parts = {r.i: (r.mean, r.sd) for r in partner_profile(*args, sd_of={"sd": "x"}, period="t").collect()}
    assert set(whole) == set(parts) == {"a", "b", "c", None}
    for i in whole:
        assert parts[i] == pytest.approx(whole[i])


def test_scores_of_single_rows_are_null(cleaned, wide):
    patched = cleaned.withColumns({"sum_of_white_on_primaries": F.lit(50.0), "adj_wing_patch": F.lit(3.0)})
    scores = field.male_scores(patched)
    assert scores.count() == 2
    assert {r.z_mass for r in scores.collect()} == {None}
    assert field.with_male_scores(wide, scores).count() == 3


def test_kept_column_as_a_pair_key(spark, tmp_path):
    """The layout that keeps the new fledgling count: a pair needs it to be equal."""
    path = tmp_path / "observations.csv"
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, V2_COLUMNS)
        out.writeheader()
        for i, row in enumerate(ROWS[:4]):
            cells = dict.fromkeys(V2_COLUMNS, "NA") | {"early": 0, "fledge_nb_new": 5 if i < 2 else i}
            out.writerow(cells | dict(zip(NAMES, row)))
    cleaned = field.clean(field.read(spark, str(path), "v2", keep=("fledge_nb_new",)))
    pairs = field.pairs(cleaned, more_keys=("fledge_nb_new",)).collect()
    assert [(r["yearAreaBox"], r["fledge_nb_new"]) for r in pairs] == [("2001X1", "5")]
    assert "fledge_nb_new" not in field.read(spark, str(path), "v2").columns
