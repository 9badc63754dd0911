"""Sources and sinks (S) over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.plans.standin import observations
from pairlab.queries.base import OBS, query, rnd, r
from pairlab.session import scratch_path
from pairlab.sources.observations import load, normalize, read_observations, save, text_schema, to_double

_RAW = ("grp", "ind", "role", "kind", "period", "size_a", "mass")


def _as_csv(spark, folder: str, name: str) -> str:
    """Observations as a CSV in which a zero discount is the missing token."""
    path = scratch_path(spark, name)
    rows = observations(spark, folder).select(
        *[F.col(c).cast("string").alias(c) for c in _RAW],
        F.when(F.col("disc") == 0, "NA").otherwise(F.col("disc").cast("string")).alias("disc"),
        F.when(F.col("tax") == 0, "unknown").otherwise(F.col("tax").cast("string")).alias("tax"),
        F.when(F.col("line") == 1, "").otherwise(F.concat(F.lit("L"), "line")).alias("site"),
    )
    rows.write.mode("overwrite").option("header", True).csv(path)
    return path


@query("S1_read_observations", OBS + """
SELECT grp, kind, disc_missing, site_missing, count(*) AS n, """ + r("sum(d)", 4) + """ AS disc_sum
FROM (SELECT CAST(grp AS VARCHAR) AS grp, kind, CAST(disc = 0 AS INTEGER) AS disc_missing,
             CAST(line = 1 AS INTEGER) AS site_missing, nullif(disc, 0) AS d FROM obs)
GROUP BY ALL""")
def read_csv(spark, folder):
    schema = T.StructType([
        *text_schema([*_RAW]).fields,
        T.StructField("disc", T.DoubleType()),
        *text_schema(["tax", "site"]).fields,
    ])
    df = read_observations(spark, _as_csv(spark, folder, "s1"), schema)
    return df.groupBy(
        "grp", "kind",
        F.col("disc").isNull().cast("int").alias("disc_missing"),
        F.col("site").isNull().cast("int").alias("site_missing"),
    ).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("disc"), 4).alias("disc_sum"))


@query("S2_to_double", OBS + """
SELECT kind, period, count(*) AS n, count(nullif(tax, 0)) AS n_tax,
       """ + r("avg(nullif(tax, 0))") + """ AS avg_tax, """ + r("avg(mass)", 3) + """ AS avg_mass
FROM obs GROUP BY kind, period""")
def parse_numbers(spark, folder):
    columns = [*_RAW, "disc", "tax", "site"]
    raw = read_observations(spark, _as_csv(spark, folder, "s2"), text_schema(columns))
    df = to_double(raw, ["mass", "tax"]).withColumn("period", F.col("period").cast("int"))
    return df.groupBy("kind", "period").agg(
        F.count(F.lit(1)).alias("n"), F.count("tax").alias("n_tax"),
        rnd(F.avg("tax")).alias("avg_tax"), rnd(F.avg("mass"), 3).alias("avg_mass"),
    )


@query("S3_normalize", """
SELECT l_orderkey AS "yearAreaBox", concat('AV', l_linenumber) AS nestbox, l_quantity AS mass,
       l_returnflag AS age_category
FROM lineitem WHERE l_linenumber <> 3 AND l_linestatus = 'F'""")
def normalize_layout(spark, folder):
    raw = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("yearAreaBox"),
        F.when(F.col("l_linenumber") == 3, "xAVI3")
        .otherwise(F.concat(F.lit("AV"), F.col("l_linenumber").cast("string"))).alias("nestbox"),
        F.col("l_quantity").alias("mass"),
        F.col("l_returnflag").alias("age_category_corrected"),
        (F.col("l_linestatus") == "O").cast("string").alias("_o"),
        F.when(F.col("l_linestatus") == "O", "1").otherwise("0").alias("early"),
        F.col("l_tax").alias("nb_eggs"), F.lit("x").alias("measurer"), F.lit(1).alias("X"),
    ).drop("_o")
    return normalize(raw, "v2")


@query("S4_parquet_round_trip", OBS + """
SELECT period, kind, count(*) AS n, """ + r("sum(size_a)", 2) + """ AS size_sum
FROM obs GROUP BY period, kind""")
def parquet_round_trip(spark, folder):
    path = scratch_path(spark, "s4")
    save(observations(spark, folder), f"{path}/observations.parquet", partition_by=["period"])
    back = load(spark, path, "observations")
    return back.groupBy("period", "kind").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("size_a"), 2).alias("size_sum")
    )
