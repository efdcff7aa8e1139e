"""Windows, splits, smoothing and feature frames."""

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import windows as W
from ..operators.cleaning import max_abs_scale, relabel
from ..operators.joins import panel_to_wide
from ..plans import panels as P
from .base import DRV_WEEKLY, FORECASTS, SEG_MODEL, SEG_WEEKLY, framed, query, rounded
from .joins import DRV_WIDE

WIN = "WINDOW w AS (PARTITION BY series ORDER BY week_end_date)"


@query("diff", sql=f"""
WITH {SEG_WEEKLY} SELECT series, week_end_date, round(level, 4) AS level, round(level - lag(level) OVER w, 4) AS diff
FROM seg_weekly {WIN}""")
def diff(spark, sf):
    return rounded(W.diff(P.segment_weekly(spark, sf), "level", "diff"))


@query("add_lags", sql=f"""
WITH {SEG_WEEKLY} SELECT series, week_end_date, round(level, 4) AS level, round(lag(level, 1) OVER w, 4) AS level_lag1,
  round(lag(level, 2) OVER w, 4) AS level_lag2, round(lag(level, 8) OVER w, 4) AS level_lag8 FROM seg_weekly {WIN}""")
def add_lags(spark, sf):
    return rounded(W.add_lags(P.segment_weekly(spark, sf), ["level", "absent"], (1, 2, 8)))


@query("lead_target", sql=f"""
WITH {SEG_WEEKLY} SELECT series, week_end_date, round(level, 4) AS level, round(lead(level, 4) OVER w - level, 4) AS target,
  lead(week_end_date, 4) OVER w AS target_date FROM seg_weekly {WIN}""")
def lead_target(spark, sf):
    return rounded(W.lead_target(P.segment_weekly(spark, sf), 4))


def _roll(fn: str, c: str, n: int) -> str:
    over = f"(PARTITION BY series ORDER BY week_end_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {over} = {n} THEN {fn}({c}) OVER {over} END"


@query("rolling_mean_std", sql=f"""
WITH {SEG_MODEL} SELECT series, week_end_date, {", ".join(
    f"round({_roll('avg', 'diff', n)}, 4) AS diff_mean_{n}, round({_roll('stddev_samp', 'diff', n)}, 4) AS diff_std_{n}"
    for n in (4, 13, 26))} FROM seg_model""")
def rolling(spark, sf):
    return rounded(W.rolling(P.segment_model(spark, sf).select("series", "week_end_date", "diff"), "diff").drop("diff"))


@query("rolling_z", sql=f"""
WITH {SEG_WEEKLY} SELECT series, week_end_date,
  round((level - {_roll('avg', 'level', 26)}) / nullif({_roll('stddev_samp', 'level', 26)}, 0), 6) AS level_z FROM seg_weekly""")
def rolling_z(spark, sf):
    return rounded(W.rolling_z(P.segment_weekly(spark, sf), "level").drop("level"), 6)


@query("returns", sql=f"""
WITH {SEG_WEEKLY} SELECT series, week_end_date, round((level / lag(level) OVER w - 1) * 100, 6) AS return_pct,
  round(ln(level) - ln(lag(level) OVER w), 6) AS log_return FROM seg_weekly {WIN}""")
def returns(spark, sf):
    return rounded(W.returns(P.segment_weekly(spark, sf), "level").drop("level"), 6)


@query("cumulative_advantage", sql=f"""
WITH {FORECASTS}
SELECT series, model, week_end_date, round(sum(pow(actual - 0, 2) - pow(actual - pred, 2)) OVER (PARTITION BY series, model ORDER BY week_end_date
  ROWS UNBOUNDED PRECEDING) / 1e9, 6) AS cum_advantage FROM fct""")
def cumulative_advantage(spark, sf):
    fc = P.forecast_fixture(P.segment_model(spark, sf)).filter(F.col("split") == "test")
    out = W.cumulative_advantage(fc.withColumn("base_pred", F.lit(0.0)), ("series", "model"))
    return rounded(out.select("series", "model", "week_end_date", (F.col("cum_advantage") / 1e9).alias("cum_advantage")), 6)


@query("chronological_split", sql=f"WITH {SEG_MODEL} SELECT series, week_end_date, rn, n, split FROM seg_model")
def split(spark, sf):
    return P.segment_model(spark, sf).select("series", "week_end_date", "rn", "n", "split")


@query("purged_split", sql=f"""
WITH {SEG_WEEKLY},
t AS (SELECT *, lead(level, 4) OVER w - level AS target, lead(week_end_date, 4) OVER w AS target_date FROM seg_weekly {WIN}),
k AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series) AS n FROM t WHERE target_date IS NOT NULL {WIN}),
s AS (SELECT series, week_end_date AS split_start FROM k WHERE rn = floor(CAST(0.8 AS DOUBLE) * n) + 1)
SELECT k.series, week_end_date, round(level, 4) AS level, round(target, 4) AS target, target_date, split_start,
  CASE WHEN week_end_date >= split_start THEN 'test' ELSE 'train' END AS split
FROM k JOIN s ON s.series = k.series WHERE week_end_date >= split_start OR target_date < split_start""")
def purged(spark, sf):
    return rounded(W.purged_split(P.segment_weekly(spark, sf), 4))


# Smoothing weights over five points, degree 3 (published table), as SQL.
def _sg_sql() -> str:
    smooth = [(69, 4, -6, 4, -1), (4, 54, 24, -16, 4), (-6, 24, 34, 24, -6)]
    slope = [(-125, 136, 48, -88, 29), (-38, -2, 24, 26, -10), (7, -56, 0, 56, -7)]

    def at(o):
        return "level" if o == 0 else f"lead(level, {o}) OVER w" if o > 0 else f"lag(level, {-o}) OVER w"

    def fit(weights, r, scale):
        return "(" + " + ".join(f"({c}) * {at(k - r)}" for k, c in enumerate(weights)) + f") / {scale}.0"

    def cases(table, scale, sign):
        last = [tuple(sign * x for x in reversed(row)) for row in table[:2]]
        return (f"CASE WHEN rn = 1 THEN {fit(table[0], 0, scale)} WHEN rn = 2 THEN {fit(table[1], 1, scale)} "
                f"WHEN rn = n THEN {fit(last[0], 4, scale)} WHEN rn = n - 1 THEN {fit(last[1], 3, scale)} "
                f"ELSE {fit(table[2], 2, scale)} END")

    return f"""sgn AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series) AS n FROM seg_weekly {WIN}),
sg AS (SELECT series, week_end_date, level, {cases(smooth, 70, 1)} AS smoothed, {cases(slope, 84, -1)} AS slope FROM sgn {WIN})"""


SG = SEG_WEEKLY + ",\n" + _sg_sql()
SCALED = SG + """,
sgs AS (SELECT *, 0.9 / max(greatest(abs(smoothed), abs(slope))) OVER (PARTITION BY series) AS factor FROM sg),
scaled AS (SELECT series, week_end_date, smoothed * factor AS scaled_original, slope * factor AS scaled_derivative FROM sgs)"""


def smoothed(spark, sf):
    return max_abs_scale(W.savgol(P.segment_weekly(spark, sf), "level"), "smoothed", "slope")


@query("savgol", sql=f"""
WITH {SG} SELECT series, week_end_date, round(level, 4) AS level, round(smoothed, 4) AS smoothed, round(slope, 4) AS slope FROM sg""")
def savgol(spark, sf):
    return rounded(W.savgol(P.segment_weekly(spark, sf), "level"))


@query("sliding_windows", sql=f"""
WITH {SCALED},
t AS (SELECT series, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series) AS n, lead(week_end_date, 5) OVER w AS forecast_start_date,
  {", ".join(f"lead(scaled_original, {i}) OVER w AS o{i}" for i in range(9))},
  {", ".join(f"lead(scaled_derivative, {i}) OVER w AS d{i}" for i in range(8))} FROM scaled {WIN})
SELECT series, rn - 10 AS row, forecast_start_date, {", ".join(f"round(o{i}, 6) AS i{i}" for i in range(5))},
  {", ".join(f"round(d{i}, 6) AS s{i}" for i in range(4))}, {", ".join(f"round(o{5 + i}, 6) AS o{i}" for i in range(4))},
  {", ".join(f"round(d{4 + i}, 6) AS d{i}" for i in range(4))}
FROM t WHERE rn <= n - 9 AND rn > 10""")
def sliding(spark, sf):
    win = W.sliding_windows(smoothed(spark, sf))

    def spread(column, prefix, n):
        return [F.col(column)[i].alias(f"{prefix}{i}") for i in range(n)]

    return rounded(win.select("series", "row", "forecast_start_date", *spread("inputs", "i", 5),
                              *spread("input_slopes", "s", 4), *spread("outputs", "o", 4),
                              *spread("output_slopes", "d", 4)), 6)


@query("sign_disagreement", sql=f"""
WITH {SCALED},
m AS (SELECT series, scaled_original - lag(scaled_original) OVER w AS mv, lag(scaled_derivative) OVER w AS dv FROM scaled {WIN})
SELECT series, count(CASE WHEN mv * dv < 0 THEN 1 END) AS n_discrepancies, count(*) - 1 AS n_comparisons,
  round(count(CASE WHEN mv * dv < 0 THEN 1 END) / CAST(count(*) - 1 AS DOUBLE), 6) AS discrepancy_rate FROM m GROUP BY 1""")
def sign_disagreement(spark, sf):
    return rounded(W.sign_disagreement(smoothed(spark, sf), "scaled_original", "scaled_derivative"), 6)


@query("cumulate_horizon", sql=f"""
WITH {SEG_MODEL} SELECT series, week_end_date, round(diff, 4) AS delta_h1,
  round(diff + lead(diff, 1) OVER w + lead(diff, 2) OVER w + lead(diff, 3) OVER w, 4) AS delta_h4 FROM seg_model {WIN}""")
def cumulate(spark, sf):
    w = W.ordered()
    path = P.segment_model(spark, sf).select("series", "week_end_date", F.array(
        F.col("diff"), *[F.lead("diff", k).over(w) for k in (1, 2, 3)]).alias("path"))
    return rounded(W.cumulate_horizon(path, "path", (1, 4)).drop("path"))


SHORT = {"1-URGENT": "URGENT", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM", "4-NOT SPECIFIED": "NOTSPEC", "5-LOW": "LOW"}
CREDIT = tuple(SHORT.values())
GAPS = (("HIGH", "URGENT"), ("MEDIUM", "URGENT"), ("NOTSPEC", "MEDIUM"), ("LOW", "NOTSPEC"), ("LOW", "MEDIUM"), ("HIGH", "MEDIUM"))

SEG_COLS = """seg_cols AS (
  SELECT week_end_date, """ + ",\n         ".join(
    f"max(CASE WHEN series = '{s}' THEN level END) AS {n}" for s, n in SHORT.items()) + """
  FROM seg_weekly GROUP BY 1)"""


def wide_columns(out: str, weekly: str, names: dict[str, str]) -> str:
    """Levels of ``segment|name`` series, one column per name and one row per frame and week."""
    part = "split_part(series, '|', {})".format
    return f"""{out} AS (
  SELECT {part(1)} AS frame, week_end_date, {", ".join(f"max(CASE WHEN {part(2)} = '{s}' THEN level END) AS {n}" for s, n in names.items())}
  FROM {weekly} GROUP BY 1, 2)"""


FRAMED_WIDE = f"{framed(SEG_WEEKLY)}, {wide_columns('seg_cols', 'seg_weekly', SHORT)}, {framed(DRV_WEEKLY)}, {wide_columns('drv_cols', 'drv_weekly', {d: d for d in P.DRIVERS})}"


def credit_wide(spark, sf, by_segment=False):
    if by_segment:
        panel = relabel(P.with_frame(P.framed_segment_weekly(spark, sf)), "series", SHORT)
    else:
        panel = relabel(P.segment_weekly(spark, sf), "series", SHORT).withColumn("frame", F.lit("all"))
    return panel_to_wide(panel, CREDIT, "level", "week_end_date", ("frame",))


def market_wide(spark, sf, by_segment=False):
    panel = P.with_frame(P.framed_driver_weekly(spark, sf)) if by_segment else P.driver_weekly(spark, sf).withColumn("frame", F.lit("all"))
    return panel_to_wide(panel, P.DRIVERS, "level", "week_end_date", ("frame",))


def feature_frame(spark, sf, by_segment=False):
    """Credit and market levels on all weeks of either, with every derived feature."""
    wide = credit_wide(spark, sf, by_segment).join(market_wide(spark, sf, by_segment), ["frame", "week_end_date"], "full")
    return X.direct_features(wide, CREDIT, GAPS, price="PRICE", fear="QUANTITY", long_rate="DISCOUNT", short_rate="TAX")


def by_frame(sql: str) -> str:
    """A query on one frame of all weeks as the same on every market segment's frame."""
    head = f"{SEG_WEEKLY}, {SEG_COLS}, {DRV_WEEKLY}, {DRV_WIDE}"
    assert head in sql
    return (sql.replace(head, FRAMED_WIDE).replace("(ORDER BY week_end_date", "(PARTITION BY frame ORDER BY week_end_date")
            .replace("USING (week_end_date)", "USING (frame, week_end_date)").replace("SELECT 'all' AS frame", "SELECT frame")
            .replace("l AS (SELECT week_end_date", "l AS (SELECT frame, week_end_date"))


def _direct_sql() -> str:
    gaps = [f"{a}_{b}_gap" for a, b in GAPS]
    macro = ["PRICE_ret", "QUANTITY", "QUANTITY_change", "DISCOUNT", "TAX", "DISCOUNT_change", "TAX_change", "slope", "slope_change"]

    def step(c):
        return f"{c} - lag({c}) OVER w"

    def roll(fn, c, n):
        over = f"(ORDER BY week_end_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count({c}) OVER {over} = {n} THEN {fn}({c}) OVER {over} END"

    one = [f"{step(s)} AS {s}_diff" for s in CREDIT] + [f"{step(g)} AS {g}_diff" for g in gaps]
    one += ["ln(PRICE) - lag(ln(PRICE)) OVER w AS PRICE_ret"] + [f"{step(c)} AS {c}_change" for c in ("QUANTITY", "DISCOUNT", "TAX", "slope")]
    two = [f"lag({s}, {k}) OVER w AS {s}_lag{k}" for s in CREDIT for k in range(1, 5)]
    two += [f"lag({s}_diff, {k}) OVER w AS {s}_diff_lag{k}" for s in CREDIT for k in range(1, 9)]
    for s in CREDIT:
        for n in (4, 13, 26):
            two += [f"{roll('avg', s + '_diff', n)} AS {s}_diff_mean_{n}", f"{roll('stddev_samp', s + '_diff', n)} AS {s}_diff_vol_{n}",
                    f"{roll('avg', s, n)} AS {s}_mean_{n}"]
        two.append(f"({s} - {roll('avg', s, 26)}) / nullif({roll('stddev_samp', s, 26)}, 0) AS {s}_z_26")
    two += [f"lag({c}, {k}) OVER w AS {c}_lag{k}" for c in macro for k in range(1, 5)]
    names = list(CREDIT) + list(P.DRIVERS) + ["slope"] + gaps + [c.rsplit(" AS ", 1)[1] for c in one + two]
    return f"""
WITH {SEG_WEEKLY}, {SEG_COLS}, {DRV_WEEKLY}, {DRV_WIDE},
base AS (SELECT *, DISCOUNT - TAX AS slope, {", ".join(f"{a} - {b} AS {a}_{b}_gap" for a, b in GAPS)}
         FROM seg_cols FULL JOIN drv_cols USING (week_end_date)),
one AS (SELECT *, {", ".join(one)} FROM base WINDOW w AS (ORDER BY week_end_date)),
two AS (SELECT *, {", ".join(two)} FROM one WINDOW w AS (ORDER BY week_end_date))
SELECT 'all' AS frame, week_end_date, {", ".join(f"round({c}, 4) AS {c}" for c in names)} FROM two"""


@query("direct_features", sql=_direct_sql())
def direct_features(spark, sf):
    return rounded(feature_frame(spark, sf))


@query("direct_features_by_segment", sql=by_frame(_direct_sql()))
def direct_features_by_segment(spark, sf):
    """One frame per market segment: windows of all frames run apart."""
    return rounded(feature_frame(spark, sf, by_segment=True))


ARX_GAPS = GAPS[:4]


def arx_frame(spark, sf, by_segment=False):
    """Regression frame: lagged credit, gap and market columns, complete weeks only."""
    w = W.ordered(keys=("frame",))
    market = market_wide(spark, sf, by_segment).select(
        "*", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_diff") for c in ("DISCOUNT", "TAX", "QUANTITY")],
        ((F.col("PRICE") / F.lag("PRICE").over(w) - 1) * 100).alias("PRICE_return"))
    columns = ["QUANTITY", "QUANTITY_diff", "PRICE_return", "DISCOUNT", "DISCOUNT_diff", "TAX", "TAX_diff", "ABSENT"]
    return X.arx_dataset(credit_wide(spark, sf, by_segment), market, CREDIT, ARX_GAPS, columns, term=("DISCOUNT", "TAX"))


def _arx_sql() -> str:
    gaps = [f"{a}_{b}_gap" for a, b in ARX_GAPS]
    market = ["QUANTITY", "QUANTITY_diff", "PRICE_return", "DISCOUNT", "DISCOUNT_diff", "TAX", "TAX_diff"]
    stepped = list(CREDIT) + gaps + ["term_spread"]
    regressors = [c for n in CREDIT for c in (f"{n}_diff", n)] + gaps + [f"{g}_diff" for g in gaps] + market + ["term_spread", "term_spread_diff"]
    lags = [f"lag({c}) OVER w AS {c}_lag1" for c in regressors]
    names = [f"{n}_diff" for n in CREDIT] + [f"{c}_lag1" for c in regressors]
    return f"""
WITH {SEG_WEEKLY}, {SEG_COLS}, {DRV_WEEKLY}, {DRV_WIDE},
mk AS (SELECT *, {", ".join(f"{c} - lag({c}) OVER w AS {c}_diff" for c in ("DISCOUNT", "TAX", "QUANTITY"))},
       (PRICE / lag(PRICE) OVER w - 1) * 100 AS PRICE_return FROM drv_cols WINDOW w AS (ORDER BY week_end_date)),
cr AS (SELECT * FROM seg_cols WHERE {" AND ".join(f"{c} IS NOT NULL" for c in CREDIT)}),
j AS (SELECT *, DISCOUNT - TAX AS term_spread, {", ".join(f"{a} - {b} AS {a}_{b}_gap" for a, b in ARX_GAPS)}
      FROM cr LEFT JOIN mk USING (week_end_date)),
c AS (SELECT *, {", ".join(f"{c} - lag({c}) OVER w AS {c}_diff" for c in stepped)} FROM j WINDOW w AS (ORDER BY week_end_date)),
l AS (SELECT week_end_date, {", ".join(f"{n}_diff" for n in CREDIT)}, {", ".join(lags)} FROM c WINDOW w AS (ORDER BY week_end_date))
SELECT 'all' AS frame, week_end_date, {", ".join(f"round({n}, 4) AS {n}" for n in names)} FROM l
WHERE {" AND ".join(f"{n} IS NOT NULL" for n in names)}"""


@query("arx_dataset", sql=_arx_sql())
def arx_dataset(spark, sf):
    return rounded(arx_frame(spark, sf))


@query("arx_dataset_by_segment", sql=by_frame(_arx_sql()))
def arx_dataset_by_segment(spark, sf):
    return rounded(arx_frame(spark, sf, by_segment=True))


BLOCK = ("PRICE", "QUANTITY", "DISCOUNT", "TAX")
BLOCK_TARGETS = CREDIT


MACRO_SQL = f"""
WITH {SEG_WEEKLY}, {SEG_COLS}, {DRV_WEEKLY}, {DRV_WIDE},
j AS (SELECT * FROM seg_cols FULL JOIN drv_cols USING (week_end_date))
{" UNION ALL ".join(f'''
SELECT 'describe' AS part, '{c}' AS a, CAST(NULL AS VARCHAR) AS b, CAST(count({c}) AS DOUBLE) AS n_obs, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(median({c}), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max, CAST(NULL AS DOUBLE) AS corr FROM j''' for c in BLOCK)}
{"".join(f''' UNION ALL SELECT 'corr', '{t}', '{c}', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(corr({t}, {c}), 6) FROM j'''
         for t in BLOCK_TARGETS for c in BLOCK)}"""


@query("macro_block", sql=MACRO_SQL)
def macro_block(spark, sf):
    return macro_rows(spark, sf)


@query("macro_block_by_segment", sql="WITH " + FRAMED_WIDE + """,
j AS (SELECT * FROM seg_cols FULL JOIN drv_cols USING (frame, week_end_date))"""
       + MACRO_SQL[MACRO_SQL.index("USING (week_end_date))") + len("USING (week_end_date))"):]
       .replace("SELECT 'describe'", "SELECT frame, 'describe'").replace("SELECT 'corr'", "SELECT frame, 'corr'").replace(" FROM j", " FROM j GROUP BY frame"))
def macro_block_by_segment(spark, sf):
    return macro_rows(spark, sf, by_segment=True)


def macro_rows(spark, sf, by_segment=False):
    keys = ["frame"] if by_segment else []
    wide = credit_wide(spark, sf, by_segment).join(market_wide(spark, sf, by_segment), ["frame", "week_end_date"], "full")
    described, corr = X.macro_block(wide, BLOCK_TARGETS, [*BLOCK, "ABSENT"], keys)
    both = (described.withColumnRenamed("variable", "a").withColumn("part", F.lit("describe"))
            .unionByName(corr.withColumn("part", F.lit("corr")), allowMissingColumns=True))
    return rounded(both, 4, corr=6, n_obs=0)
