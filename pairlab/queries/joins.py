"""Joins by id list, pair builds, look-ups and grids (J), sorts and sets (O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlab.operators import members as m
from pairlab.operators.groups import conflicting_ids, touched_groups, with_mixed_flag
from pairlab.operators.pairs import pair_by_join
from pairlab.operators.scaling import zscore
from pairlab.operators.summary import first_rows
from pairlab.plans.standin import SIDES, clean, observations, pairs
from pairlab.queries.base import CLEAN, OBS, PAIRS, more, query, r, rnd

_SWITCH = "switch AS (SELECT ind FROM obs GROUP BY ind HAVING count(DISTINCT kind) > 1)"
_ROLES = "roles AS (SELECT ind FROM obs GROUP BY ind HAVING count(DISTINCT role) > 1)"


@query("J1_keep_members", more(OBS, _SWITCH) + "SELECT grp, line, ind FROM obs WHERE ind IN (SELECT ind FROM switch)")
def keep_members(spark, folder):
    df = observations(spark, folder)
    return m.keep_members(df.select("grp", "line", "ind"), conflicting_ids(df, "ind", ["kind"]), "ind")


@query("J2_drop_members", more(OBS, _SWITCH) + """
SELECT grp, line, ind FROM obs
WHERE grp NOT IN (SELECT grp FROM obs WHERE ind IN (SELECT ind FROM switch))""")
def drop_members(spark, folder):
    df = observations(spark, folder)
    groups = touched_groups(df, conflicting_ids(df, "ind", ["kind"]), "ind", "grp")
    return m.drop_members(df.select("grp", "line", "ind"), groups, "grp")


@query("J3_keep_members_any", more(OBS, _SWITCH, _ROLES) + """
SELECT grp, line, ind FROM obs
WHERE ind IN (SELECT ind FROM switch) OR ind IN (SELECT ind FROM roles)""")
def keep_members_any(spark, folder):
    df = observations(spark, folder)
    lists = [conflicting_ids(df, "ind", [c]) for c in ("kind", "role")]
    return m.keep_members_any(df.select("grp", "line", "ind"), lists, "ind")


_J4 = ["grp", "mixed", "ind_f", "kind_f", "mass_f", "ind_m", "kind_m", "mass_m"]


@query("J4_pair_build", CLEAN + """
SELECT f.grp, f.mixed, f.ind AS ind_f, f.kind AS kind_f, f.mass AS mass_f,
       m.ind AS ind_m, m.kind AS kind_m, m.mass AS mass_m
FROM clean f LEFT JOIN clean m ON f.grp = m.grp AND m.role = 'O' AND m.n_rows = 2
WHERE f.role = 'F' AND f.n_rows = 2""")
def pair_build(spark, folder):
    return pairs(spark, folder, keep_unmatched=True).select(*_J4)


@query("J5_matched_pairs", PAIRS + """
SELECT grp, mixed, ind_f, kind_f, mass_f, ind_m, kind_m, mass_m FROM pairs""")
def matched_pairs(spark, folder):
    keys = ["grp", "mixed", "n_rows"]
    wide = pair_by_join(clean(spark, folder), "role", SIDES, keys, partner_id="ind")
    return wide.select(*_J4)


@query("J6_attach_scores", more(PAIRS, """
scores AS (
  SELECT grp, ind, (mass - avg(mass) OVER w) / nullif(stddev_samp(mass) OVER w, 0) AS z_mass
  FROM clean WHERE role = 'O' AND mass IS NOT NULL AND size_a IS NOT NULL
  WINDOW w AS (PARTITION BY period, kind))""") + f"""
SELECT p.grp, p.ind_f, p.ind_m, {r('s.z_mass')} AS z_mass_m
FROM pairs p LEFT JOIN scores s ON p.grp = s.grp AND p.ind_m = s.ind""")
def attach_scores(spark, folder):
    side = clean(spark, folder).filter(F.col("role") == "O").dropna(subset=["mass", "size_a"])
    scores = zscore(side, ["period", "kind"], ["mass"]).select("grp", "ind", "z_mass")
    out = m.attach_scores(
        pairs(spark, folder).select("grp", "ind_f", "ind_m"), scores,
        {"grp": "grp", "ind_m": "ind"}, {"z_mass": "z_mass_m"},
    )
    return out.withColumn("z_mass_m", rnd("z_mass_m"))


@query("J7_mark_from_subset", more(OBS, """
mixed_groups AS (SELECT grp FROM obs GROUP BY grp HAVING min(kind) <> max(kind)),
hits AS (SELECT DISTINCT grp, ind FROM obs WHERE grp IN (SELECT grp FROM mixed_groups) AND disc > 0.02)""") + """
SELECT o.grp, o.line, o.ind, CAST(h.grp IS NOT NULL AS INTEGER) AS marked
FROM obs o LEFT JOIN hits h ON o.grp = h.grp AND o.ind = h.ind""")
def mark_from_subset(spark, folder):
    df = observations(spark, folder)
    hits = with_mixed_flag(df, "grp", "kind", "mixed").filter("mixed = 1 AND disc > 0.02")
    return m.mark_from_subset(df.select("grp", "line", "ind"), hits, ["grp", "ind"], "marked")


@query("J7_mark_with_repeats", more(OBS, """
hits AS (SELECT ind_hist, kind FROM obs WHERE disc > 0.09 AND mass > 60000)""") + """
SELECT o.ind_hist, o.kind, CAST(h.kind IS NOT NULL AS INTEGER) AS marked, count(*) AS n
FROM obs o LEFT JOIN hits h ON o.ind_hist = h.ind_hist AND o.kind = h.kind GROUP BY ALL""")
def mark_with_repeats(spark, folder):
    df = observations(spark, folder)
    hits = df.filter("disc > 0.09 AND mass > 60000")
    marked = m.mark_from_subset(
        df.select("ind_hist", "kind"), hits, ["ind_hist", "kind"], "marked", dedupe=False
    )
    return marked.groupBy("ind_hist", "kind", "marked").agg(F.count(F.lit(1)).alias("n"))


@query("J8_level_grid", OBS + """
SELECT k.kind, p.period, o.o_orderpriority AS priority
FROM (SELECT DISTINCT kind FROM obs) k, (SELECT DISTINCT period FROM obs) p,
     (SELECT DISTINCT o_orderpriority FROM orders) o""")
def level_grid(spark, folder):
    df = observations(spark, folder)
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return m.level_grid(spark, {
        "kind": m.levels_of(df, "kind"), "period": m.levels_of(df, "period"),
        "priority": m.levels_of(orders, "o_orderpriority"),
    })


@query("O1_sort_two_keys", PAIRS + "SELECT ind_hist_f, period, grp FROM pairs ORDER BY ind_hist_f, period, grp")
def sort_two_keys(spark, folder):
    return pairs(spark, folder).select("ind_hist_f", "period", "grp").orderBy("ind_hist_f", "period", "grp")


@query("O2_sort_within_group", OBS + """
SELECT ind_hist, period, kind, n, lag(n) OVER (PARTITION BY ind_hist ORDER BY period, kind) AS n_before
FROM (SELECT ind_hist, period, kind, count(*) AS n FROM obs GROUP BY ALL)""")
def sort_within_group(spark, folder):
    counts = observations(spark, folder).groupBy("ind_hist", "period", "kind").agg(
        F.count(F.lit(1)).alias("n")
    )
    # one row per period and kind: a key holds few rows whatever the data size
    order = Window.partitionBy("ind_hist").orderBy("period", "kind")
    return counts.withColumn("n_before", F.lag("n").over(order))


@query("O3_first_rows", OBS + """
SELECT ind_hist, n FROM (SELECT ind_hist, count(*) AS n FROM obs GROUP BY ind_hist)
ORDER BY n DESC, ind_hist LIMIT 38""")
def first(spark, folder):
    counts = observations(spark, folder).groupBy("ind_hist").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(counts, [F.desc("n"), "ind_hist"], 38)


@query("O4_distinct", OBS + "SELECT DISTINCT ind_hist, kind FROM obs")
def distinct(spark, folder):
    return observations(spark, folder).select("ind_hist", "kind").distinct()


@query("O5_union_ids", more(OBS, _SWITCH, _ROLES) + "SELECT ind FROM switch UNION SELECT ind FROM roles")
def union_ids(spark, folder):
    df = observations(spark, folder)
    return m.union_ids([conflicting_ids(df, "ind", [c]) for c in ("kind", "role")], "ind")
