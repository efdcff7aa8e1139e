"""Query registration and the SQL fragments shared by the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}

# Means of amounts in cents often end exactly halfway between two rounded
# values, where the last bit of a sum decides. Both sides add the same small
# offset before rounding, so such values round alike in both engines.
OFFSET = 1.37e-7


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` states the same rows for another engine."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip().replace("round(", f"round({OFFSET} + ")
        return fn
    return add


def rounded(df: DataFrame, digits: int | dict = 4, **per_column: int) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    out = []
    for name, kind in df.dtypes:
        d = per_column.get(name, digits)
        out.append(F.round(F.lit(OFFSET) + F.col(name), d).alias(name) if kind == "double" else F.col(name))
    return df.select(*out)


WEEK = "CAST({d} + CAST((12 - dayofweek({d})) % 7 AS INTEGER) AS DATE)"


def week(d: str = "d") -> str:
    return WEEK.format(d=d)


SEG_DAILY = """seg_daily AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)"""

DRV_DAILY = """drv_wide AS (
  SELECT CAST(l_shipdate AS DATE) AS d, avg(l_discount) AS DISCOUNT, sum(l_extendedprice) AS PRICE,
         avg(l_tax) AS TAX, sum(l_quantity) AS QUANTITY
  FROM lineitem GROUP BY 1),
drv_daily AS (
  SELECT 'DISCOUNT' AS series, d, DISCOUNT AS value FROM drv_wide
  UNION ALL SELECT 'PRICE', d, PRICE FROM drv_wide
  UNION ALL SELECT 'TAX', d, TAX FROM drv_wide
  UNION ALL SELECT 'QUANTITY', d, QUANTITY FROM drv_wide)"""

# The same by market segment: series are called segment|name.
FRAMED_SEG_DAILY = """seg_daily AS (
  SELECT c_mktsegment || '|' || o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS value
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""

FRAMED_DRV_DAILY = """drv_wide AS (
  SELECT c_mktsegment AS frame, CAST(l_shipdate AS DATE) AS d, avg(l_discount) AS DISCOUNT, sum(l_extendedprice) AS PRICE,
         avg(l_tax) AS TAX, sum(l_quantity) AS QUANTITY
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
drv_daily AS (
  SELECT frame || '|DISCOUNT' AS series, d, DISCOUNT AS value FROM drv_wide
  UNION ALL SELECT frame || '|PRICE', d, PRICE FROM drv_wide
  UNION ALL SELECT frame || '|TAX', d, TAX FROM drv_wide
  UNION ALL SELECT frame || '|QUANTITY', d, QUANTITY FROM drv_wide)"""


def framed(sql: str) -> str:
    """The SQL of the panels with one frame per market segment."""
    return sql.replace(SEG_DAILY, FRAMED_SEG_DAILY).replace(DRV_DAILY, FRAMED_DRV_DAILY)


FLAG_WIDE = """flag_wide AS (
  SELECT CAST(l_shipdate AS DATE) AS observation_date,
         avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS A_price,
         avg(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS N_price,
         avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS R_price
  FROM lineitem GROUP BY 1)"""


def dense(daily: str, out: str) -> str:
    """Own-extent daily calendar with time interpolation of ``(series, d, value)``."""
    return f"""{out}_next AS (
  SELECT series, d, value, lead(d) OVER w AS d1, lead(value) OVER w AS v1
  FROM {daily} WINDOW w AS (PARTITION BY series ORDER BY d)),
{out}_days AS (
  SELECT series, d AS d0, value, d1, v1, unnest(range(coalesce(d1 - d, 1))) AS k FROM {out}_next),
{out} AS (
  SELECT series, CAST(d0 + CAST(k AS INTEGER) AS DATE) AS d,
         CASE WHEN k = 0 THEN value ELSE value + (v1 - value) * k / (d1 - d0) END AS value
  FROM {out}_days)"""


def weekly(dense_name: str, out: str, how: str = "avg(value)") -> str:
    return f"""{out} AS (
  SELECT series, {week()} AS week_end_date, {how} AS level
  FROM {dense_name} GROUP BY 1, 2)"""


SEG_WEEKLY = ",\n".join([SEG_DAILY, dense("seg_daily", "seg_dense"), weekly("seg_dense", "seg_weekly")])
DRV_WEEKLY = ",\n".join([DRV_DAILY, dense("drv_daily", "drv_dense"),
                         weekly("drv_dense", "drv_weekly", "arg_max(value, d)")])

MODEL = """seg_diff AS (
  SELECT series, week_end_date, level,
         level - lag(level) OVER (PARTITION BY series ORDER BY week_end_date) AS diff
  FROM seg_weekly),
seg_num AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY week_end_date) AS rn,
         count(*) OVER (PARTITION BY series) AS n
  FROM seg_diff WHERE diff IS NOT NULL),
seg_model AS (
  SELECT *, CASE WHEN rn <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'test' END AS split
  FROM seg_num)"""

SEG_MODEL = SEG_WEEKLY + ",\n" + MODEL

FORECASTS = SEG_MODEL + """,
fc_wide AS (
  SELECT series, week_end_date, split, diff AS actual, rn,
         CAST(0 AS DOUBLE) AS rw, lag(diff) OVER w AS pe,
         CASE WHEN count(diff) OVER b = 4 THEN avg(diff) OVER b END AS m4
  FROM seg_model
  WINDOW w AS (PARTITION BY series ORDER BY week_end_date),
         b AS (PARTITION BY series ORDER BY week_end_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
fc AS (
  SELECT 'Rolling 1-step' AS method, series, 1 AS horizon, week_end_date, split, 'Random Walk' AS model,
         actual, rw AS pred FROM fc_wide
  UNION ALL SELECT 'Rolling 1-step', series, 1, week_end_date, split, 'Persistence', actual, pe FROM fc_wide
  UNION ALL SELECT 'Rolling 1-step', series, 1, week_end_date, split, 'Mean4', actual, m4 FROM fc_wide),
fct AS (SELECT * FROM fc WHERE split = 'test')"""


def erfc_p(z: str) -> str:
    """Two-sided normal p-value by the same published approximation (A&S 7.1.26)."""
    x = f"(abs({z}) / sqrt(CAST(2 AS DOUBLE)))"
    t = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    return (f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t}"
            f" + 0.254829592) * {t} * exp(-{x} * {x}))")


def chi2_p(x: str, df: int) -> str:
    import math

    terms = " + ".join(f"pow({x} / 2, {k}) / {math.factorial(k)}" for k in range(df // 2))
    return f"(exp(-({x}) / 2) * ({terms}))"


def normal_cdf(z: str) -> str:
    return f"(CASE WHEN {z} > 0 THEN 1 - {erfc_p(z)} / 2 ELSE {erfc_p(z)} / 2 END)"


def f_p(f: str, d1: int, d2: str) -> str:
    """Survival function of F with an even first number of degrees of freedom: a finite sum."""
    import math

    x, a = f"({d2} / ({d2} + {d1} * {f}))", f"({d2} / 2.0)"
    terms = []
    for j in range(d1 // 2):
        rising = " * ".join(["1.0", *[f"({a} + {i})" for i in range(j)]])
        terms.append(f"{rising} / {math.factorial(j)} * pow(1 - {x}, {j})")
    return f"(pow({x}, {a}) * ({' + '.join(terms)}))"


def cross_products(columns) -> str:
    """The full matrix of summed products, row by row, as a list."""
    return "[" + ", ".join(f"sum({a} * {b})" for a in columns for b in columns) + "]"


def sweep_step(a: str, n: int, p: str) -> str:
    """Matrix ``a`` (n x n, a list) swept on pivot ``p`` (from 0); as it is where the pivot has vanished."""
    at = lambda i, j: f"{a}[{i} * {n} + {j} + 1]"
    i, j, d = f"(t // {n})", f"(t % {n})", at(p, p)
    moved = (f"CASE WHEN {i} = {p} AND {j} = {p} THEN -1 / {d} WHEN {i} = {p} OR {j} = {p} THEN {a}[t + 1] / {d}"
             f" ELSE {a}[t + 1] - {at(i, p)} * {at(p, j)} / {d} END")
    return f"(CASE WHEN {d} > 1e-10 THEN list_transform(range({n * n}), lambda t: {moved}) ELSE {a} END)"


def swept(source: str, out: str, n: int, steps: str, pivot: str = "k", keys: str = "series") -> str:
    """``out(keys, k, a)``: matrices of ``source(keys, a, ...)`` after k sweeps, k from 0 to ``steps``."""
    return f"""{out} AS (
  SELECT {keys}, 0 AS k, a FROM {source}
  UNION ALL
  SELECT {keys}, k + 1, {sweep_step("a", n, pivot)} FROM {out} WHERE k < {steps})"""
