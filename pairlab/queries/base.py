"""Registration of queries and their SQL counterparts over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Common table expressions mirroring pairlab.plans.standin.
_OBS = """
obs AS (
  SELECT l_orderkey AS grp, concat_ws('-', l_partkey, l_suppkey) AS ind,
         l_suppkey AS ind_hist, l_linestatus AS role, l_returnflag AS kind,
         CAST(year(l_shipdate) AS INTEGER) AS period, l_quantity AS size_a,
         l_extendedprice AS mass, l_discount AS disc, l_tax AS tax,
         CAST(dayofyear(l_shipdate) AS INTEGER) AS day, l_linenumber AS line
  FROM lineitem WHERE l_returnflag IN ('A', 'R')),
ranged AS (
  SELECT * REPLACE (CASE WHEN size_a < 46 THEN size_a END AS size_a,
                    CASE WHEN mass > 2000 AND mass < 90000 THEN mass END AS mass)
  FROM obs),
measured AS (SELECT *, mass / nullif(size_a, 0) AS adj FROM ranged)"""
_CLEAN = """,
bad AS (SELECT ind FROM obs GROUP BY ind
        HAVING count(DISTINCT role) > 1 OR count(DISTINCT kind) > 1),
bad_groups AS (SELECT DISTINCT grp FROM obs WHERE ind IN (SELECT ind FROM bad)),
clean AS (
  SELECT *, CAST(min(kind) OVER g <> max(kind) OVER g AS INTEGER) AS mixed,
         count(*) OVER g AS n_rows
  FROM measured WHERE grp NOT IN (SELECT grp FROM bad_groups)
  WINDOW g AS (PARTITION BY grp))"""
_SIDE = ("ind", "ind_hist", "role", "kind", "size_a", "mass", "disc", "tax", "day", "line", "adj")
_PAIRS = """,
pairs AS (
  SELECT f.grp, f.mixed, f.n_rows, f.period, m.period AS period_m,
         {sides}
  FROM clean f JOIN clean m ON f.grp = m.grp
  WHERE f.n_rows = 2 AND f.role = 'F' AND m.role = 'O')""".format(
    sides=", ".join([f"f.{c} AS {c}_f" for c in _SIDE] + [f"m.{c} AS {c}_m" for c in _SIDE])
)
_LEVELS = """,
leveled AS (SELECT p.*, o.o_orderpriority AS priority FROM pairs p
            LEFT JOIN orders o ON p.grp = o.o_orderkey)"""

OBS = "WITH RECURSIVE" + _OBS + "\n"
CLEAN = "WITH RECURSIVE" + _OBS + _CLEAN + "\n"
PAIRS = "WITH RECURSIVE" + _OBS + _CLEAN + _PAIRS + "\n"
LEVELED = "WITH RECURSIVE" + _OBS + _CLEAN + _PAIRS + _LEVELS + "\n"


def more(base: str, *ctes: str) -> str:
    """`base` with further common table expressions appended."""
    return base.rstrip() + ",\n" + ",\n".join(ctes) + "\n"


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is the statement that must give the same rows."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Rounded, with -0.0 turned into 0.0, so both engines print the same number."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, cols: dict[str, int] | list[str], digits: int = 6) -> DataFrame:
    places = cols if isinstance(cols, dict) else {c: digits for c in cols}
    return df.withColumns({c: rnd(c, d) for c, d in places.items()})


def r(expression: str, digits: int = 6) -> str:
    """SQL text of `rnd`."""
    return f"(round({expression}, {digits}) + 0.0)"


def erfc(x: str) -> str:
    """SQL text of the complementary error function, by its power series (for x below 5)."""
    terms = f"pow(-1, k) * pow({x}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))"
    return f"(1 - 2 / sqrt(pi()) * list_sum([{terms} FOR k IN range(0, 120)]))"
