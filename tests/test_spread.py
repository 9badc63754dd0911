"""Hot keys: results stay the same and no task holds a whole key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlab.operators import groups as g
from pairlab.operators import members as m
from pairlab.operators import spread
from pairlab.operators.inference import adjust_bh
from pairlab.operators.pairs import build_pairs, pair_by_join
from pairlab.operators.scaling import prior_total
from pairlab.operators.spread import (
    _bracketed, attach, exact_quantiles, null_safe_join, per_key, running_fold, select_quantiles, small_table,
)
from pairlab.operators.summary import median_of


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belongs to key 0, another block has no key; 40 rows are exact copies."""
    rng = np.random.default_rng(7)
    key = np.where(rng.random(600) < 0.4, 0, rng.integers(1, 60, 600))
    pdf = pd.DataFrame({
        "k": [None if x == 7 else int(x) for x in key],
        "t": rng.integers(2000, 2006, 600), "flag": rng.integers(0, 2, 600),
        "x": np.round(rng.normal(10, 3, 600), 1), "i": np.arange(600),
    })
    copies = pd.DataFrame({"k": [0] * 40, "t": 2001, "flag": 1, "x": 5.0, "i": -1})
    pdf = pd.concat([pdf, copies], ignore_index=True)
    rows = [
        (None if pd.isna(r.k) else int(r.k), int(r.t), int(r.flag), float(r.x), int(r.i))
        for r in pdf.itertuples()
    ]
    df = spark.createDataFrame(rows, "k int, t int, flag int, x double, i int").repartition(6, "i").cache()
    return df, df.toPandas()


def test_attach_keeps_every_row(tiny_tasks, skewed):
    df, pdf = skewed
    got = g.with_group_size(df, "k", "n").toPandas()
    sizes = pdf.groupby("k", dropna=False).size()
    assert len(got) == len(pdf)
    for k, n in got.groupby("k", dropna=False)["n"].first().items():
        assert n == (sizes[sizes.index.isna()].iloc[0] if pd.isna(k) else sizes[k])


def test_attach_spreads_the_hot_key(tiny_tasks, skewed):
    df, _ = skewed
    tiny_tasks.conf.set("spark.sql.adaptive.enabled", "false")
    tiny_tasks.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach(df, per_key(df, ["k"], F.max("x").alias("top")), ["k"])
        holds = out.filter("k = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        tiny_tasks.conf.set("spark.sql.adaptive.enabled", "true")
        tiny_tasks.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(holds) == 4  # all shuffle partitions


def test_members_and_marks(tiny_tasks, skewed):
    df, pdf = skewed
    ids = df.filter("k = 0 or k is null or k = 3").select("k")
    kept = m.keep_members(df, ids, "k").count()
    assert kept == int((pdf.k.isin([0, 3]) | pdf.k.isna()).sum())
    assert m.drop_members(df, ids, "k").count() == len(pdf) - kept


def test_running_total_over_blocks(tiny_tasks, skewed):
    df, pdf = skewed
    got = prior_total(df.filter("i >= 0"), "k", ["t", "i"], "flag").toPandas().set_index("i")["prior"]
    want = pdf[pdf.i >= 0].sort_values(["t", "i"]).copy()
    grouped = want.groupby(want["k"].fillna(-1))["flag"]
    want["prior"] = grouped.cumsum() - want["flag"]
    assert (got.sort_index() == want.set_index("i")["prior"].sort_index()).all()


def test_running_total_with_copies(tiny_tasks, skewed):
    df, _ = skewed
    ones = prior_total(df.filter("i = -1"), "k", ["t", "i"], "flag")
    assert sorted(r.prior for r in ones.collect()) == list(range(40))


def test_running_min_over_blocks(tiny_tasks, skewed):
    df, pdf = skewed
    rows = df.filter("i >= 0")
    got = running_fold(rows, [], [F.col("i")], F.col("x"), "low", fold=F.min).toPandas()
    want = pdf[pdf.i >= 0].sort_values("i")["x"].cummin().to_numpy()
    assert np.allclose(got.sort_values("i")["low"].to_numpy(), want)


def test_group_numbers(tiny_tasks, skewed):
    df, pdf = skewed
    got = g.with_group_id(df.filter("k is not null"), "k", "number").toPandas()
    ranks = pdf.dropna(subset=["k"]).k.rank(method="dense")
    want = dict(zip(pdf.k.dropna(), ranks.astype(int)))
    assert all(want[r.k] == r.number for r in got.itertuples())


@pytest.mark.parametrize("limit", ["5", "4000000"])
def test_quantiles(spark, skewed, limit):
    df, pdf = skewed
    spark.conf.set("spark.pairlab.hotKeyRows", limit)
    try:
        got = exact_quantiles(df, ["t"], "x", [0.0, 0.1, 0.5, 0.9, 1.0], "q").collect()
    finally:
        spark.conf.unset("spark.pairlab.hotKeyRows")
    for r in got:
        x = pdf[pdf.t == r.t].x
        assert r.n == len(x)
        assert np.allclose(r.q, np.quantile(x, [0, 0.1, 0.5, 0.9, 1]))


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("accuracy", [5_000, 40, 7])
def test_quantiles_by_narrowing(spark, by, accuracy):
    """Sketches this coarse leave only the values near a quantile to be counted; ties, spread over many magnitudes, NULLs."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({
        "k": rng.choice(["a", "a", "a", "b", None], 6000), "_v": np.exp(rng.normal(0, 20, 6000)) * rng.choice([-1, 1], 6000),
    })
    pdf.loc[::3, "_v"] = rng.integers(0, 4, 2000)
    pdf.loc[::50, "_v"] = None
    rows = spark.createDataFrame([(k, None if np.isnan(v) else float(v)) for k, v in pdf.itertuples(index=False)], "k string, _v double").repartition(5)
    probs = [0.5, 0.0, 0.25, 0.26, 0.75, 0.999, 1.0]
    bracketed = _bracketed(rows.dropna(subset=["_v"]), by, probs, accuracy)
    if accuracy == 40:
        assert bracketed.count() < 0.8 * pdf._v.nunique() and bracketed.filter("_v is null").count() > 0
    got = select_quantiles(rows, by, probs, "q", accuracy).collect()
    assert len(got) == (3 if by else 1)
    for r in got:
        x = pdf._v[pdf.k.isna() if r.k is None else pdf.k == r.k] if by else pdf._v
        assert r.n == x.notna().sum() and np.allclose(r.q, np.quantile(x.dropna(), probs), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    nothing = spark.createDataFrame([], "k string, _v double")
    assert select_quantiles(nothing, [], [0.5], "q").first()["q"] == [None]
    assert select_quantiles(nothing, ["k"], [0.5], "q").count() == 0


def test_median_of_an_empty_column(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, None)], "k string, x double, y double")
    row = median_of(df, ["k"], ["x", "y"]).first()
    assert (row.median_x, row.median_y) == (1.5, None)


@pytest.mark.parametrize("limit", ["5", "4000000"])
def test_adjusted_p(spark, limit):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(50), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(99, None)], "i int, p double")
    spark.conf.set("spark.pairlab.hotKeyRows", limit)
    try:
        got = {r.i: r.p_adj for r in adjust_bh(df, "p").collect()}
    finally:
        spark.conf.unset("spark.pairlab.hotKeyRows")
    order = np.argsort(-p, kind="stable")
    want = np.minimum(1, np.minimum.accumulate(len(p) / np.arange(len(p), 0, -1) * p[order]))
    assert got.pop(99) is None
    assert np.allclose([got[i] for i in order], want)
    assert all(got[i] >= p[i] for i in got)


def test_adjusted_p_of_the_fixture(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    got = sorted((r.p_adj for r in adjust_bh(df, "p").collect()), key=lambda v: (v is None, v))
    assert got[:3] == pytest.approx([0.03, 0.04, 0.04]) and got[3] is None


def test_small_table_respects_its_bound(spark):
    assert small_table(spark.range(11), 10) is None
    assert small_table(spark.range(10), 10).count() == 10


def test_null_safe_join_is_an_equi_join(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(None, "z")], "k int, w string")
    out = null_safe_join(a, b, ["k"], "inner")
    assert [tuple(r) for r in out.collect()] == [(None, "y", "z")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_results_do_not_depend_on_partitioning(tiny_tasks, skewed):
    df, _ = skewed
    a = sorted(g.keep_repeated(df, ["k", "t"]).collect(), key=str)
    b = sorted(g.keep_repeated(df.repartition(3).orderBy(F.desc("i")), ["k", "t"]).collect(), key=str)
    assert a == b


@pytest.fixture(scope="module")
def observed(spark):
    """Groups of one to three rows and one of 40, an individual with many of the rows, NULLs in every column."""
    rng = np.random.default_rng(11)
    size = rng.choice([1, 2, 2, 2, 3], 120)
    grp = np.concatenate([np.repeat(np.arange(120), size), np.full(40, 999)])
    n = len(grp)
    pick = lambda values: [values[i] for i in rng.integers(0, len(values), n)]
    ind = [0 if rng.random() < 0.2 else int(i) for i in rng.integers(1, 150, n)]
    rows = list(zip(
        [None if x == 5 else int(x) for x in grp], [None if i == 3 else i for i in ind],
        pick(["F", "O", "F", "O", None]), pick(["A", "R", "A", None]), [int(i) for i in range(n)],
    ))
    return spark.createDataFrame(rows, "g int, i int, role string, kind string, x int").repartition(5, "x").cache()


def _same(a, b):
    key = lambda d: sorted(map(repr, (tuple(r[c] for c in sorted(d.columns)) for r in d.collect())))
    assert sorted(a.columns) == sorted(b.columns)
    assert key(a) == key(b)


def test_several_values_counts_null(spark):
    rows = [(1, None, "a"), (1, "a", None), (2, "a", "b"), (2, "a", "b"), (3, None, None), (4, "a", None), (4, None, None)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = df.groupBy("k").agg(g.several_values(["a", "b"]).alias("s"), g.several_values(["a"], F.lit(False)).alias("none"))
    assert {r.k: (r.s, r.none) for r in got.collect()} == {1: (True, False), 2: (False, False), 3: (False, False), 4: (True, False)}


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("null_id", ["match", "ignore"])
def test_conflict_groups_few_and_many(tiny_tasks, observed, monkeypatch, few, null_id):
    if not few:
        monkeypatch.setattr(spread, "small_table", lambda df, limit=0: None)
    pdf = observed.toPandas().astype(object)
    pdf = pdf.where(pdf.notna(), None)
    of = {}
    for r in pdf.itertuples():
        of.setdefault(r.i, set()).add((r.role, r.kind))
    bad = {i for i, s in of.items() if len(s) > 1 and (null_id == "match" or i is not None)}
    touched = {r.g for r in pdf.itertuples() if r.i in bad}
    want = sorted(r.x for r in pdf.itertuples() if r.g not in touched)
    got = g.exclude_conflicts(observed, "i", "g", ["role", "kind"], null_id=null_id)
    assert sorted(r.x for r in got.collect()) == want
    rows = g.exclude_conflicts(observed, "i", "g", ["role", "kind"], "rows", null_id)
    assert sorted(r.x for r in rows.collect()) == sorted(r.x for r in pdf.itertuples() if r.i not in bad)

    keep = F.col("x") % 3 != 0
    kept = got.filter(keep)
    steps = g.with_group_size(g.with_mixed_flag(kept, "g", "kind", "mixed"), "g", "n_rows")
    _same(g.clean_groups(observed, "i", "g", "kind", ["role", "kind"], keep, null_id=null_id), steps)


@pytest.mark.parametrize("most", [1 << 20, 0])
@pytest.mark.parametrize("unmatched", [True, False])
def test_pairs_of_listed_groups(tiny_tasks, observed, monkeypatch, most, unmatched):
    """By broadcast and by shuffle, with a hot group that is among the excluded ones."""
    monkeypatch.setattr(spread, "BROADCAST_BYTES", most)
    excluded = observed.filter("g IN (999, 10, 11)").select("g").distinct()
    got = build_pairs(
        observed, "g", "role", ("F", "O"), ["g"], partner_id="i", keep_unmatched=unmatched, excluded=excluded)
    rows = null_safe_join(g.with_group_size(observed, "g", "n_rows"), excluded, ["g"], "left_anti")
    want = pair_by_join(rows, "role", ("F", "O"), ["g"], partner_id="i", keep_unmatched=unmatched)
    _same(got, want.drop("n_rows_f", "n_rows_m"))
