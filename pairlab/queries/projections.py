"""Row-wise columns and filters (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import columns as c
from pairlab.operators.groups import classify_pairs, conflicting_ids
from pairlab.operators.members import flag_members
from pairlab.plans.standin import PRIORITIES, clean, measured, observations
from pairlab.queries.base import CLEAN, OBS, query, r, rnd
from pairlab.sources.observations import load


@query("P1_select", OBS + "SELECT grp, ind, kind FROM obs")
def select(spark, folder):
    return observations(spark, folder).select("grp", "ind", "kind")


@query("P2_drop", OBS + "SELECT grp, ind, role, kind, period, size_a FROM obs")
def drop(spark, folder):
    return observations(spark, folder).drop("mass", "disc", "tax", "day", "line", "ind_hist")


@query("P3_product", OBS + f"SELECT grp, line, ind, {r('mass * disc', 4)} AS area FROM obs")
def product(spark, folder):
    df = c.with_product(observations(spark, folder), "mass", "disc", "area")
    return df.select("grp", "line", "ind", rnd("area", 4).alias("area"))


@query("P4_suffix", OBS + 'SELECT grp, period, ind AS ind_f, kind AS kind_f, size_a AS size_a_f FROM obs')
def suffix(spark, folder):
    df = observations(spark, folder).select("grp", "period", "ind", "kind", "size_a")
    return c.suffix_columns(df, "_f", ["grp", "period"])


@query("P5_rename", OBS + "SELECT grp, size_a AS z_size_m, mass AS z_mass_m FROM obs")
def rename(spark, folder):
    df = observations(spark, folder).select("grp", "size_a", "mass")
    return df.withColumnsRenamed({"size_a": "z_size_m", "mass": "z_mass_m"})


@query("P6_null_out_of_range", OBS + """SELECT grp, line, ind, size_a, mass,
       CASE WHEN disc > 0.01 AND disc < 0.09 THEN disc END AS disc FROM ranged""")
def null_out_of_range(spark, folder):
    bounds = {"size_a": (None, 46), "mass": (2000, 90000), "disc": (0.01, 0.09)}
    df = c.null_out_of_range(observations(spark, folder), bounds)
    return df.select("grp", "line", "ind", "size_a", "mass", "disc")


@query("P7_ratio", OBS + f"""SELECT grp, line, ind, {r('adj', 8)} AS adj,
       {r('mass / nullif(disc, 0)', 3)} AS per_disc FROM measured""")
def ratio(spark, folder):
    df = c.with_ratio(measured(spark, folder), "mass", "disc", "per_disc")
    return df.select("grp", "line", "ind", rnd("adj", 8).alias("adj"), rnd("per_disc", 3).alias("per_disc"))


@query("P8_keep_kinds", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def keep_kinds(spark, folder):
    df = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return c.keep_kinds(df, "l_returnflag", ["A", "R"])


@query("P9_drop_containing", """
SELECT o_orderkey, priority FROM (
  SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)
WHERE NOT coalesce(contains(priority, 'URG'), false)""")
def drop_containing(spark, folder):
    df = load(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    )
    return c.drop_containing(df, "priority", "URG")


@query("P10_drop_sentinel", """
SELECT o_orderkey, priority FROM (
  SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)
WHERE priority <> '1-URGENT'""")
def drop_sentinel(spark, folder):
    df = load(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    )
    return c.drop_sentinel(df, "priority", "1-URGENT")


@query("P11_drop_flagged", OBS + """
SELECT grp, line, ind, early FROM (
  SELECT *, CASE WHEN disc > 0.08 THEN NULL WHEN day < 60 THEN 1 ELSE 0 END AS early FROM obs)
WHERE NOT (early = 1)""")
def drop_flagged(spark, folder):
    early = F.when(F.col("disc") > 0.08, None).when(F.col("day") < 60, 1).otherwise(0)
    df = observations(spark, folder).withColumn("early", early)
    return c.drop_flagged(df, F.col("early") == 1).select("grp", "line", "ind", "early")


@query("P12_complete_rows", OBS + """SELECT grp, line, ind, size_a, mass FROM measured
WHERE size_a IS NOT NULL AND mass IS NOT NULL""")
def complete_rows(spark, folder):
    df = measured(spark, folder).select("grp", "line", "ind", "size_a", "mass")
    return c.complete_rows(df, ["size_a", "mass"])


@query("P13_range_predicate", OBS + """SELECT grp, line, ind, size_a, mass FROM obs
WHERE 2 < size_a AND size_a < 40 AND mass < 60000 AND tax > 0.01""")
def range_predicate(spark, folder):
    df = observations(spark, folder).filter(
        c.between_open("size_a", 2, 40) & c.between_open("mass", None, 60000)
        & c.between_open("tax", 0.01, None)
    )
    return df.select("grp", "line", "ind", "size_a", "mass")


@query("P14_fill_label", """SELECT o_orderkey,
  coalesce(nullif(o_orderpriority, '5-LOW'), 'unknown') AS priority FROM orders""")
def fill_label(spark, folder):
    df = load(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    )
    return c.fill_label(df, "priority", "unknown")


@query("P15_binarize", OBS + """SELECT ind_hist, count(*) FILTER (kind = 'R') AS n_r,
  CAST(count(*) FILTER (kind = 'R') > 0 AS INTEGER) AS any_r FROM obs GROUP BY ind_hist""")
def binarize(spark, folder):
    df = observations(spark, folder).groupBy("ind_hist").agg(
        F.count_if(F.col("kind") == "R").alias("n_r")
    )
    return c.binarize(df, "n_r", "any_r")


@query("P16_levels", """
SELECT o_orderkey, o_orderpriority,
  CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
       WHEN '2-HIGH' THEN 3 END AS o_orderpriority_rank,
  CASE o_orderpriority WHEN '5-LOW' THEN 'bad' WHEN '4-NOT SPECIFIED' THEN 'average'
       WHEN '3-MEDIUM' THEN 'good' WHEN '2-HIGH' THEN 'very good' END AS o_orderpriority_label
FROM orders""")
def levels(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return c.with_levels(df, "o_orderpriority", PRIORITIES[:4], ["bad", "average", "good", "very good"])


@query("P17_log", OBS + f"""SELECT grp, line, ind, {r('ln(mass)')} AS log_mass,
  CASE WHEN disc > 0 THEN {r('ln(CASE WHEN disc > 0 THEN disc ELSE 1 END)')} END AS log_disc FROM obs""")
def log(spark, folder):
    return observations(spark, folder).select(
        "grp", "line", "ind", rnd(F.log("mass")).alias("log_mass"), rnd(F.log("disc")).alias("log_disc")
    )


@query("P18_classify_pairs", CLEAN + """
SELECT grp, ind, role, kind,
  CASE WHEN n_rows = 1 THEN 'unknown' WHEN n_rows > 2 THEN 'extra_pair'
       WHEN crossed THEN 'FA_OR' ELSE 'FA_OA' END AS pair
FROM (SELECT *, bool_or(role = 'F' AND kind = 'A') OVER g AS anchored,
             bool_or(role = 'O' AND kind = 'R') OVER g AS crossed
      FROM clean WINDOW g AS (PARTITION BY grp))
WHERE anchored""")
def classify(spark, folder):
    df = clean(spark, folder).select("grp", "ind", "role", "kind", "n_rows")
    return classify_pairs(df, "grp", "role", "kind", "F", "O", "A", "R", size="n_rows").drop("n_rows")


@query("P19_flag_members", OBS + """, bad AS (SELECT ind FROM obs GROUP BY ind HAVING count(DISTINCT kind) > 1)
SELECT grp, line, ind, ind IN (SELECT ind FROM bad) AS switches FROM obs""")
def member_flag(spark, folder):
    df = observations(spark, folder)
    ids = conflicting_ids(df, "ind", ["kind"])
    return flag_members(df.select("grp", "line", "ind"), ids, "ind", "switches")


@query("P20_interaction_key", OBS + """SELECT concat_ws('.', ind_hist, kind) AS both_keys, count(*) AS n
FROM obs GROUP BY both_keys""")
def interaction(spark, folder):
    df = observations(spark, folder)
    return df.groupBy(c.interaction_key("ind_hist", "kind").alias("both_keys")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("P21_subset", OBS + """SELECT grp, line, ind, mass, disc FROM obs
WHERE mass < 60000 AND disc IS NOT NULL AND kind = 'A' AND role = 'O'""")
def subset(spark, folder):
    df = observations(spark, folder).filter(
        (F.col("mass") < 60000) & F.col("disc").isNotNull()
        & (F.col("kind") == "A") & (F.col("role") == "O")
    )
    return df.select("grp", "line", "ind", "mass", "disc")


@query("P22_percent_label", OBS + """
SELECT kind, period, concat(CAST(CAST(round(100.0 * share, 0) AS BIGINT) AS VARCHAR), '%') AS label,
       printf('%.1f%%', 100.0 * share) AS label_1
FROM (SELECT kind, period, count(*) FILTER (role = 'O') / count(*) AS share FROM obs GROUP BY kind, period)""")
def percent(spark, folder):
    shares = observations(spark, folder).groupBy("kind", "period").agg(
        (F.count_if(F.col("role") == "O") / F.count(F.lit(1))).alias("share")
    )
    return shares.select(
        "kind", "period", c.percent_label("share").alias("label"), c.percent_label("share", 1).alias("label_1")
    )


@query("P23_inverse_logit", OBS + f"""SELECT grp, line, ind,
  {r('1 / (1 + exp(-(-2.5 + 0.08 * size_a)))')} AS p FROM obs""")
def inverse_logit(spark, folder):
    return observations(spark, folder).select(
        "grp", "line", "ind", rnd(c.inv_logit(F.lit(-2.5) + 0.08 * F.col("size_a"))).alias("p")
    )


@query("P24_scaled_axis", OBS + f"""SELECT period, {r('200 * avg(CAST(kind = $$R$$ AS INTEGER))')} AS share_scaled
FROM obs GROUP BY period""")
def scaled_axis(spark, folder):
    shares = observations(spark, folder).groupBy("period").agg(
        F.avg((F.col("kind") == "R").cast("int")).alias("share")
    )
    return c.with_scaled(shares, "share", 200.0, "share_scaled").select(
        "period", rnd("share_scaled").alias("share_scaled")
    )
