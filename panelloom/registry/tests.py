"""Statistical tests."""

from pyspark.sql import functions as F

from ..functions.math import PPF_A, PPF_B, PPF_C, PPF_D
from ..operators import diagnostics as D
from ..operators import evaluation as E
from ..operators import models as M
from ..operators.moments import moment_matrix, triangle
from ..plans import calibration as C
from ..plans import panels as P
from ..session import durable
from .aggregates import FCT, test_rows
from .base import SEG_MODEL, chi2_p, cross_products, erfc_p, framed, f_p, normal_cdf, query, rounded, swept
from .features import WIN
from .models import FILTERED


@query("jarque_bera", sql=f"""
WITH {SEG_MODEL}, c AS (SELECT series, diff - avg(diff) OVER (PARTITION BY series) AS x FROM seg_model),
m AS (SELECT series, count(*) AS n, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM c GROUP BY 1),
j AS (SELECT series, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM m)
SELECT series, round(jb, 4) AS jb_stat, round(exp(-jb / 2), 6) AS jb_pvalue FROM j""")
def jarque_bera(spark, sf):
    return rounded(D.jarque_bera(P.segment_model(spark, sf), "diff"), 4, jb_pvalue=6)


def _acf(value: str = "diff", source: str = "seg_model", lags: int = 20, name: str = "ac") -> str:
    return f"""{name}c AS (SELECT series, week_end_date, {value} - avg({value}) OVER (PARTITION BY series) AS x,
  row_number() OVER (PARTITION BY series ORDER BY week_end_date) AS i, count(*) OVER (PARTITION BY series) AS nn FROM {source}),
{name} AS (SELECT a.series, b.k AS lag, max(a.nn) AS n, sum(a.x * c.x) / max(s.ss) AS r
  FROM {name}c a, (SELECT unnest(range(1, {lags + 1})) AS k) b, {name}c c, (SELECT series, sum(x * x) AS ss FROM {name}c GROUP BY 1) s
  WHERE c.series = a.series AND c.i = a.i - b.k AND s.series = a.series GROUP BY 1, 2)"""


@query("acf", sql=f"WITH {SEG_MODEL}, {_acf()} SELECT series, lag, round(r, 6) AS acf FROM ac")
def acf(spark, sf):
    return rounded(D.acf(P.segment_model(spark, sf), "diff"), 6)


@query("pacf", sql=f"""
WITH RECURSIVE {SEG_MODEL}, {_acf()},
r AS (SELECT series, list_prepend(CAST(1 AS DOUBLE), list(r ORDER BY lag)) AS r FROM ac GROUP BY 1),
toeplitz AS (SELECT series, list_transform(range(441), lambda t: r[abs(t // 21 - t % 21) + 1]) AS a FROM r),
{swept("toeplitz", "sw", 21, "19", "(k + 1)")}
SELECT series, CAST(k + 1 AS BIGINT) AS lag, round(a[k + 2] / sqrt(a[1] * a[(k + 1) * 22 + 1]), 6) AS pacf FROM sw""")
def pacf(spark, sf):
    return rounded(D.pacf(P.segment_model(spark, sf), "diff"), 6)


def _lb(name: str, label: str) -> str:
    return " UNION ALL ".join(f"""
SELECT series, '{label}' AS variable, CAST({h} AS BIGINT) AS lag, round(q, 4) AS lb_stat, round({chi2_p("q", h)}, 6) AS lb_pvalue
FROM (SELECT series, max(n) * (max(n) + 2) * sum(r * r / (n - lag)) AS q FROM {name} WHERE lag <= {h} GROUP BY 1)""" for h in (4, 8, 12))


@query("ljung_box", sql=f"""
WITH {SEG_MODEL}, sq AS (SELECT series, week_end_date, diff * diff AS v FROM seg_model), {_acf(lags=12)}, {_acf("v", "sq", 12, "sa")}
{_lb("ac", "change")} UNION ALL {_lb("sa", "squared")}""")
def ljung_box(spark, sf):
    return rounded(D.ljung_box(P.segment_model(spark, sf), "diff"), 4, lb_pvalue=6)


ARCH = ["one", *[f"q{k}" for k in range(1, 9)], "q"]
SEG_V = SEG_MODEL + ", sv AS (SELECT series, week_end_date, diff AS v FROM seg_model)"


def arch_ctes(src: str, p: str) -> str:
    """``{p}(series, n, lm, f)`` of the rows of ``src(series, week_end_date, v)``."""
    return f"""{p}sq AS (SELECT series, week_end_date, v * v AS v FROM {src} WHERE v IS NOT NULL),
{p}st AS (SELECT series, week_end_date, (v - avg(v) OVER (PARTITION BY series)) / nullif(stddev_pop(v) OVER (PARTITION BY series), 0) AS q FROM {p}sq),
{p}d AS (SELECT series, CAST(1 AS DOUBLE) AS one, q, {", ".join(f"lag(q, {k}) OVER w AS q{k}" for k in range(1, 9))} FROM {p}st {WIN}),
{p}m AS (SELECT series, count(*) AS n, sum(q) AS sy, sum(q * q) AS syy, {cross_products(ARCH)} AS a FROM {p}d WHERE q8 IS NOT NULL AND q IS NOT NULL GROUP BY 1),
{swept(f"{p}m", f"{p}sw", 10, "9")},
{p}f AS (SELECT m.series, n, 1 - s.a[100] / (syy - sy * sy / n) AS r2 FROM {p}m AS m JOIN {p}sw AS s ON s.series = m.series AND k = 9),
{p} AS (SELECT *, n * r2 AS lm, (r2 / 8) / ((1 - r2) / (n - 9)) AS f FROM {p}f WHERE n > 9)"""


def lb12_ctes(value: str, src: str, p: str) -> str:
    """``{p}(series, q)``: the portmanteau statistic at twelve lags."""
    return f"""{_acf(value, src, 12, p + "a")},
{p} AS (SELECT series, max(n) * (max(n) + 2) * sum(r * r / (n - lag)) AS q FROM {p}a GROUP BY 1)"""


@query("arch_lm", sql=f"""
WITH RECURSIVE {SEG_V}, {arch_ctes("sv", "ar")}
SELECT series, n AS n_obs, round(lm, 6) AS lm_stat, round({chi2_p("lm", 8)}, 6) AS lm_pvalue, round(f, 6) AS f_stat,
       round({f_p("f", 8, "(n - 9)")}, 6) AS f_pvalue FROM ar""")
def arch_lm(spark, sf):
    return rounded(D.arch_lm(P.segment_model(spark, sf), "diff"), 6)


# More lag columns than any series of the tables has; those beyond a series' own limit are zero and never pivots.
ADF_MOST = 20
ADF = ["one", "prev", *[f"d{k}" for k in range(1, ADF_MOST + 1)], "d"]
ADF_N = len(ADF)


def adf_ctes(src: str, p: str) -> str:
    """``{p}(series, stat, p, lag, n)`` of ``src(series, week_end_date, v)``."""
    def used(limit, rows):
        lags = ", ".join(f"CASE WHEN {k} <= {limit} THEN coalesce(d{k}, 0) ELSE 0 END AS d{k}" for k in range(1, ADF_MOST + 1))
        return f"SELECT series, {limit} AS top, CAST(1 AS DOUBLE) AS one, prev, d, {lags} FROM {rows} WHERE t >= {limit} + 2"

    return f"""{p}v AS (SELECT series, week_end_date, v, count(v) OVER p AS n, avg(v) OVER p AS mean, stddev_pop(v) OVER p AS sd
      FROM {src} WHERE v IS NOT NULL WINDOW p AS (PARTITION BY series)),
{p}y AS (SELECT series, week_end_date, (v - mean) / sd AS y, CAST(greatest(0, least(ceil(12 * pow(n / 100.0, 0.25)), floor(n / 2.0) - 2)) AS INTEGER) AS most
      FROM {p}v WHERE sd > 0),
{p}s AS (SELECT *, row_number() OVER w AS t, lag(y) OVER w AS prev, y - lag(y) OVER w AS d FROM {p}y {WIN}),
{p}l AS (SELECT *, {", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in range(1, ADF_MOST + 1))} FROM {p}s {WIN}),
{p}c AS ({used("most", f"{p}l")}),
{p}m AS (SELECT series, any_value(top) AS top, count(*) AS n, {cross_products(ADF)} AS a FROM {p}c GROUP BY 1),
{swept(f"{p}m", f"{p}sw", ADF_N, str(ADF_N - 1))},
{p}aic AS (SELECT m.series, k - 2 AS lag, n * ln(s.a[{ADF_N * ADF_N}] / n) + 2 * k AS aic FROM {p}m AS m JOIN {p}sw AS s USING (series) WHERE k >= 2 AND k - 2 <= top),
{p}b AS (SELECT series, arg_min(lag, (aic, lag)) AS lag FROM {p}aic GROUP BY 1),
{p}u AS ({used("lag", f"{p}l JOIN {p}b USING (series)")}),
{p}m2 AS (SELECT series, any_value(top) AS lag, count(*) AS n, {cross_products(ADF)} AS a FROM {p}u GROUP BY 1),
{swept(f"{p}m2", f"{p}sw2", ADF_N, str(ADF_N - 1))},
{p}st AS (SELECT m.series, lag, n, s.a[{2 * ADF_N}] / sqrt(s.a[{ADF_N * ADF_N}] / (n - 2 - lag) * -s.a[{ADF_N + 2}]) AS stat
       FROM {p}m2 AS m JOIN {p}sw2 AS s ON s.series = m.series AND k = {ADF_N - 1}),
{p}z AS (SELECT *, CASE WHEN stat <= -1.61 THEN 2.1659 + 1.4412 * stat + 0.038269 * stat * stat
             ELSE 1.7339 + 0.93202 * stat - 0.12745 * stat * stat - 0.010368 * stat * stat * stat END AS z FROM {p}st),
{p} AS (SELECT series, stat, CASE WHEN stat > 2.74 THEN 1 WHEN stat < -18.83 THEN 0 ELSE {normal_cdf("z")} END AS p, lag, n FROM {p}z)"""


@query("adf", sql=f"""
WITH RECURSIVE {SEG_V}, {adf_ctes("sv", "df")}
SELECT series, round(stat, 6) AS adf_stat, round(p, 6) AS adf_pvalue, CAST(lag AS BIGINT) AS lags_used, n AS n_used FROM df""")
def adf(spark, sf):
    # Sizing the lag columns reads the panel once more, so it is kept.
    return rounded(D.adf(durable(P.segment_model(spark, sf)), "diff"), 6)


def kpss_ctes(src: str, p: str) -> str:
    """``{p}(series, n, st, bw, p)`` of ``src(series, week_end_date, v)``."""
    return f"""{p}c AS (SELECT series, v - avg(v) OVER (PARTITION BY series) AS e, row_number() OVER w AS i, count(*) OVER (PARTITION BY series) AS n
      FROM {src} WHERE v IS NOT NULL {WIN}),
{p}s AS (SELECT series, e, i, n, sum(e) OVER (PARTITION BY series ORDER BY i ROWS UNBOUNDED PRECEDING) AS cs FROM {p}c),
{p}t AS (SELECT series, max(n) AS n, sum(e * e) AS ee, sum(cs * cs) AS ss, CAST(floor(pow(max(n), CAST(2 AS DOUBLE) / 9)) AS INTEGER) AS c FROM {p}s GROUP BY 1),
{p}g AS (SELECT a.series, a.i - b.i AS k, sum(a.e * b.e) AS g FROM {p}s a JOIN {p}s b ON b.series = a.series AND b.i < a.i GROUP BY 1, 2),
{p}z AS (SELECT t.series, any_value(t.n) AS n, any_value(ee) AS ee, any_value(ss) AS ss, (any_value(ee) + 2 * sum(g)) / any_value(t.n) AS s0, 2 * sum(k * g) / any_value(t.n) AS s1
      FROM {p}t AS t JOIN {p}g AS g ON g.series = t.series AND g.k <= t.c GROUP BY 1),
{p}l AS (SELECT *, CAST(least(n - 1, floor(1.1447 * pow(pow(s1 / s0, 2), CAST(1 AS DOUBLE) / 3) * pow(n, CAST(1 AS DOUBLE) / 3))) AS BIGINT) AS bw FROM {p}z),
{p}v AS (SELECT l.series, any_value(n) AS n, any_value(ss) AS ss, any_value(bw) AS bw,
      (any_value(ee) + 2 * coalesce(sum((1 - g.k / (l.bw + 1.0)) * g.g), 0)) / any_value(n) AS lr
      FROM {p}l AS l LEFT JOIN {p}g AS g ON g.series = l.series AND g.k <= l.bw GROUP BY 1),
{p}f AS (SELECT series, n, bw, ss / (CAST(n AS DOUBLE) * n) / lr AS st FROM {p}v),
{p} AS (SELECT *, CASE WHEN st <= 0.347 THEN 0.1 WHEN st >= 0.739 THEN 0.01 WHEN st < 0.463 THEN 0.1 - (st - 0.347) * 0.05 / 0.116
        WHEN st < 0.574 THEN 0.05 - (st - 0.463) * 0.025 / 0.111 ELSE 0.025 - (st - 0.574) * 0.015 / 0.165 END AS p FROM {p}f)"""


@query("kpss", sql=f"""
WITH {SEG_MODEL}, lv AS (SELECT series, week_end_date, level AS v FROM seg_model), {kpss_ctes("lv", "kp")}
SELECT series, n AS n_obs, round(st, 6) AS kpss_stat, bw AS bandwidth, round(p, 6) AS kpss_pvalue FROM kp""")
def kpss(spark, sf):
    return rounded(D.kpss(P.segment_model(spark, sf), "level"), 6)


# The labels are stated on made p-values of the data, so that SQL can state them too.
@query("stationarity_verdict", sql=f"""
WITH {SEG_MODEL}, k AS (SELECT series, week_end_date, rn, abs(diff) / max(abs(diff)) OVER (PARTITION BY series) AS a,
  abs(level) / max(abs(level)) OVER (PARTITION BY series) - 0.4 AS b FROM seg_model)
SELECT series, week_end_date, CASE WHEN rn < 20 THEN 'Too few observations'
  WHEN a < 0.05 AND b > 0.05 THEN 'Stationary by both ADF and KPSS'
  WHEN a < 0.05 THEN 'Mixed: ADF rejects unit root, KPSS rejects stationarity'
  WHEN b > 0.05 THEN 'Mixed: ADF does not reject unit root, KPSS does not reject stationarity'
  ELSE 'Likely non-stationary / weak evidence of stationarity' END AS stationarity_reading FROM k""")
def verdict(spark, sf):
    from pyspark.sql import Window

    whole = Window.partitionBy("series")
    m = P.segment_model(spark, sf).select(
        "series", "week_end_date", "rn", (F.abs("diff") / F.max(F.abs("diff")).over(whole)).alias("a"),
        (F.abs("level") / F.max(F.abs("level")).over(whole) - 0.4).alias("b"))
    return m.select("series", "week_end_date",
                    D.stationarity_label(F.col("rn"), F.col("a"), F.col("b")).alias("stationarity_reading"))


@query("stationarity_table", sql=f"""
WITH RECURSIVE {SEG_MODEL},
bv AS (SELECT series || '|level' AS series, week_end_date, level AS v FROM seg_model
       UNION ALL SELECT series || '|weekly change', week_end_date, diff FROM seg_model),
{kpss_ctes("bv", "kp")}, {adf_ctes("bv", "df")},
j AS (SELECT kp.series, kp.n AS n_obs, stat, df.p AS ap, st, kp.p AS pp FROM kp LEFT JOIN df ON df.series = kp.series)
SELECT split_part(series, '|', 1) AS series, split_part(series, '|', 2) AS variable, n_obs,
       round(CASE WHEN n_obs >= 20 THEN stat END, 6) AS adf_stat, round(CASE WHEN n_obs >= 20 THEN ap END, 6) AS adf_pvalue,
       round(CASE WHEN n_obs >= 20 THEN st END, 6) AS kpss_stat, round(CASE WHEN n_obs >= 20 THEN pp END, 6) AS kpss_pvalue,
       CASE WHEN n_obs < 20 THEN 'Too few observations'
            WHEN ap < 0.05 AND pp > 0.05 THEN 'Stationary by both ADF and KPSS'
            WHEN ap < 0.05 THEN 'Mixed: ADF rejects unit root, KPSS rejects stationarity'
            WHEN pp > 0.05 THEN 'Mixed: ADF does not reject unit root, KPSS does not reject stationarity'
            ELSE 'Likely non-stationary / weak evidence of stationarity' END AS stationarity_reading
FROM j""")
def stationarity(spark, sf):
    m = durable(P.segment_model(spark, sf))
    both = D.stationarity_verdict(m, "level", "level").unionByName(D.stationarity_verdict(m, "diff", "weekly change"))
    return rounded(both, 6)


DM_WIDE = FCT + """,
dw AS (SELECT series, week_end_date, actual, max(CASE WHEN model = 'Random Walk' THEN pred END) AS rw,
  max(CASE WHEN model = 'Mean4' THEN pred END) AS m4, max(CASE WHEN model = 'Persistence' THEN pred END) AS pe FROM ft GROUP BY 1, 2, 3)"""


def wide_test(spark, sf):
    def of(model):
        return F.max(F.when(F.col("model") == model, F.col("pred")))

    return test_rows(spark, sf).groupBy("series", "week_end_date", "actual").agg(
        of("Random Walk").alias("rw"), of("Mean4").alias("m4"), of("Persistence").alias("pe"))


def dm_sql(rows: str, keys: str, h: int, min_obs: int) -> str:
    """Test on ``rows(keys, week_end_date, d)``."""
    covs = "".join(f", covar_samp(CASE WHEN d{j} IS NOT NULL THEN d END, d{j}) AS c{j}" for j in range(1, h))
    lags = "".join(f", lag(d, {j}) OVER w AS d{j}" for j in range(1, h))
    lrv = " + ".join(["v"] + [f"2 * c{j}" for j in range(1, h)])
    return f"""dl AS (SELECT *{lags} FROM {rows} WINDOW w AS (PARTITION BY {keys} ORDER BY week_end_date)),
da AS (SELECT {keys}, count(d) AS n_obs, avg(d) AS m, var_samp(d) AS v{covs} FROM dl GROUP BY {keys}),
dz AS (SELECT *, CASE WHEN n_obs >= {min_obs} AND {lrv} > 0 THEN m / sqrt(({lrv}) / n_obs) END AS st FROM da)
SELECT {keys}, n_obs, round(CASE WHEN n_obs >= {min_obs} THEN m END / 1e6, 4) AS mean_loss_diff, round(st, 6) AS dm_stat, round({erfc_p("st")}, 6) AS p_value FROM dz"""


def dm_out(df):
    return rounded(df.withColumn("mean_loss_diff", F.col("mean_loss_diff") / 1e6), 6, mean_loss_diff=4)


@query("diebold_mariano", sql=f"""
WITH {DM_WIDE}, dd AS (SELECT series, week_end_date, pow(abs(actual - rw), 2) - pow(abs(actual - m4), 2) AS d FROM dw), {dm_sql("dd", "series", 1, 0)}""")
def dm(spark, sf):
    return dm_out(E.diebold_mariano(wide_test(spark, sf), "rw", "m4", min_obs=0))


@query("diebold_mariano_h4", sql=f"""
WITH {DM_WIDE}, dd AS (SELECT series, week_end_date, pow(abs(actual - pe), 2) - pow(abs(actual - m4), 2) AS d FROM dw), {dm_sql("dd", "series", 4, 10)}""")
def dm_h4(spark, sf):
    return dm_out(E.diebold_mariano(wide_test(spark, sf), "pe", "m4", h=4, min_obs=10))


@query("diebold_mariano_multi", sql=f"""
WITH {DM_WIDE}, dd AS (SELECT 'all' AS system, week_end_date, avg(pow(abs(actual - rw), 2) - pow(abs(actual - m4), 2)) AS d FROM dw GROUP BY 2),
{dm_sql("dd", "system", 1, 0)}""")
def dm_multi(spark, sf):
    return dm_out(E.diebold_mariano_multi(wide_test(spark, sf).withColumn("system", F.lit("all")), "rw", "m4"))


@query("diebold_mariano_by_segment", sql=f"""
WITH {framed(DM_WIDE)}, dd AS (SELECT split_part(series, '|', 1) AS system, week_end_date, avg(pow(abs(actual - rw), 2) - pow(abs(actual - m4), 2)) AS d FROM dw GROUP BY 1, 2),
{dm_sql("dd", "system", 1, 0)}""")
def dm_by_segment(spark, sf):
    """One test per market segment, over the mean loss difference of its series."""
    rows = P.forecast_fixture(P.framed_segment_model(spark, sf)).filter((F.col("split") == "test") & F.col("pred").isNotNull())
    of = lambda model: F.max(F.when(F.col("model") == model, F.col("pred")))
    wide = rows.groupBy("series", "week_end_date", "actual").agg(of("Random Walk").alias("rw"), of("Mean4").alias("m4"))
    return dm_out(E.diebold_mariano_multi(wide.withColumn("system", F.split("series", r"\|")[0]), "rw", "m4"))


@query("pairwise_dm", sql=f"""
WITH {FCT},
dd AS (SELECT a.series, a.horizon, b.model AS baseline, a.model AS model, a.week_end_date, pow(abs(a.actual - b.pred), 2) - pow(abs(a.actual - a.pred), 2) AS d
  FROM ft a JOIN ft b ON a.series = b.series AND a.horizon = b.horizon AND a.week_end_date = b.week_end_date
  WHERE (b.model = 'Random Walk' AND a.model <> 'Random Walk') OR (b.model = 'Persistence' AND a.model = 'Mean4')),
o AS ({'''WITH ''' + dm_sql("dd", "series, horizon, baseline, model", 1, 10)})
SELECT *, baseline || ' vs ' || model AS comparison FROM o""")
def pairwise(spark, sf):
    return dm_out(E.pairwise_dm(test_rows(spark, sf), ["Random Walk", "Persistence"]))


@query("histogram_density", sql=f"""
WITH {SEG_MODEL}, e AS (SELECT series, min(diff) AS lo, max(diff) AS hi, count(*) AS n FROM seg_model GROUP BY 1),
b AS (SELECT m.series, least(CAST(floor((diff - lo) / ((hi - lo) / 35)) AS BIGINT), 34) AS bin, count(*) AS c
      FROM seg_model m JOIN e ON e.series = m.series GROUP BY 1, 2),
g AS (SELECT series, lo, hi, n, unnest(range(35)) AS bin FROM e)
SELECT g.series, g.bin, round(lo + g.bin * (hi - lo) / 35, 4) AS left_edge, round(coalesce(c, 0) / (n * (hi - lo) / 35) * 1e4, 6) AS density
FROM g LEFT JOIN b ON b.series = g.series AND b.bin = g.bin""")
def histogram(spark, sf):
    out = D.histogram_density(P.segment_model(spark, sf), "diff")
    return rounded(out.withColumn("density", F.col("density") * 1e4), 6, left_edge=4)


@query("kde_grid", sql=f"""
WITH {SEG_MODEL}, e AS (SELECT series, min(diff) AS lo, max(diff) AS hi, count(*) AS n, stddev_samp(diff) * pow(count(*), -0.2) AS h FROM seg_model GROUP BY 1),
g AS (SELECT *, unnest(range(300)) AS point FROM e)
SELECT g.series, point, round(lo + point * (hi - lo) / 299, 4) AS x,
  round(sum(exp(-0.5 * pow((lo + point * (hi - lo) / 299 - m.diff) / g.h, 2))) / (g.n * g.h * sqrt(2 * pi())) * 1e4, 6) AS density
FROM g JOIN seg_model m ON m.series = g.series GROUP BY g.series, point, g.lo, g.hi, g.n, g.h""")
def kde(spark, sf):
    out = D.kde_grid(P.segment_model(spark, sf), "diff")
    return rounded(out.withColumn("density", F.col("density") * 1e4), 6, x=4)


def _poly(x: str, coefficients) -> str:
    out = f"CAST({coefficients[0]} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c})"
    return out


def ppf_sql(p: str) -> str:
    """Inverse normal by the same published rational approximation."""
    def tail(s):
        return f"{_poly(s, PPF_C)} / {_poly(s, PPF_D + (1.0,))}"

    r = f"(({p} - 0.5) * ({p} - 0.5))"
    return (f"CASE WHEN {p} < 0.02425 THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > 0.97575 THEN -({tail(f'sqrt(-2 * ln(1 - {p}))')}) "
            f"ELSE {_poly(r, PPF_A)} * ({p} - 0.5) / {_poly(r, PPF_B + (1.0,))} END")


@query("qq_points", sql=f"""
WITH {SEG_MODEL}, p AS (SELECT series, diff, row_number() OVER (PARTITION BY series ORDER BY diff) AS rank,
  row_number() OVER (PARTITION BY series ORDER BY diff) / (count(*) OVER (PARTITION BY series) + CAST(1 AS DOUBLE)) AS p,
  avg(diff) OVER (PARTITION BY series) AS m, stddev_pop(diff) OVER (PARTITION BY series) AS s FROM seg_model),
q AS (SELECT *, {ppf_sql("p")} AS t FROM p)
SELECT series, rank, round(diff, 4) AS sample_q, round(t, 6) AS theoretical_q, round(m + s * t, 4) AS line FROM q""")
def qq(spark, sf):
    return rounded(D.qq_points(P.segment_model(spark, sf), "diff"), 4, theoretical_q=6)


@query("flat_forecast_check", sql=f"""
WITH {FCT} SELECT method, series, model, round(stddev_samp(pred), 4) AS pred_std, stddev_samp(pred) < 1e-6 AS is_flat FROM ft GROUP BY 1, 2, 3""")
def flat(spark, sf):
    return rounded(E.flat_forecast_check(test_rows(spark, sf)))


@query("ar1_fit", sql=f"""
WITH {SEG_MODEL}, p AS (SELECT series, diff AS y, lag(diff) OVER w AS x FROM seg_model WHERE split = 'train' {WIN}),
f AS (SELECT series, count(*) AS n, regr_intercept(y, x) AS c, regr_slope(y, x) AS phi, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS ssr
      FROM p WHERE x IS NOT NULL GROUP BY 1)
SELECT series, n AS n_obs, round(c, 4) AS const, round(phi, 6) AS phi, round(ssr / n / 1e6, 4) AS sigma2,
  round(n * (ln(2 * pi() * ssr / n) + 1) + 6, 4) AS aic, round(n * (ln(2 * pi() * ssr / n) + 1) + 3 * ln(n), 4) AS bic FROM f""")
def ar1(spark, sf):
    fit = M.ar1_fit(P.segment_model(spark, sf).filter(F.col("split") == "train"), "diff")
    return rounded(fit.withColumn("sigma2", F.col("sigma2") / 1e6), 4, phi=6)


MOMENTS = ["one", "y1", "y2", "level_k", "y"]


@query("moment_matrix", sql=f"""
WITH {SEG_MODEL}, r AS (SELECT series, CAST(1 AS DOUBLE) AS one, lag(diff, 1) OVER w / 1000 AS y1, lag(diff, 2) OVER w / 1000 AS y2,
  level / 1000 AS level_k, diff / 1000 AS y FROM seg_model {WIN}), k AS (SELECT * FROM r WHERE y2 IS NOT NULL)
{" UNION ALL ".join(f"SELECT series, {i} AS i, {j} AS j, round(sum({MOMENTS[i]} * {MOMENTS[j]}), 3) AS value FROM k GROUP BY 1"
                    for i in range(5) for j in range(i, 5))}""")
def moments(spark, sf):
    from ..operators.windows import ordered

    w = ordered()
    rows = P.segment_model(spark, sf).select(
        "series", F.lit(1.0).alias("one"), (F.lag("diff", 1).over(w) / 1000).alias("y1"),
        (F.lag("diff", 2).over(w) / 1000).alias("y2"), (F.col("level") / 1000).alias("level_k"),
        (F.col("diff") / 1000).alias("y")).na.drop()
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in triangle(len(MOMENTS))])
    m = moment_matrix(rows, ["series"], MOMENTS).select("series", F.explode(F.arrays_zip(places.alias("at"), F.col("m").alias("value"))).alias("z"))
    return rounded(m.select("series", "z.at.i", "z.at.j", "z.value"), 3)


def dependence_sql(src: str, label: str) -> tuple[str, str, str]:
    """CTEs, columns and joins (on alias t) of the dependence tests of ``src(series, week_end_date, v)``."""
    ctes = f"""{lb12_ctes("v", src, "lb")}, {lb12_ctes("v * v", src, "ls")}, {arch_ctes(src, "ar")},
jc AS (SELECT series, v - avg(v) OVER (PARTITION BY series) AS x FROM {src}),
jm AS (SELECT series, count(*) AS n, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM jc GROUP BY 1),
jb AS (SELECT series, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM jm)"""
    columns = f"""round(exp(-jb / 2), 6) AS jb_pvalue, round({chi2_p("lb.q", 12)}, 6) AS lb_{label}_pvalue_lag12,
       round({chi2_p("ls.q", 12)}, 6) AS lb_sq_{label}_pvalue_lag12, round({chi2_p("ar.lm", 8)}, 6) AS arch_lm_pvalue"""
    return ctes, columns, "JOIN jb USING (series) JOIN lb USING (series) JOIN ls USING (series) LEFT JOIN ar USING (series)"


RESID = dependence_sql("rv", "resid")


@query("residual_diagnostics", sql=f"""
WITH RECURSIVE {FILTERED},
rl AS (SELECT series, week_end_date, diff, lag(diff) OVER w AS p FROM seg_model WHERE split = 'train' {WIN}),
rf AS (SELECT series, count(*) AS n, regr_slope(diff, p) AS phi, regr_intercept(diff, p) AS c FROM rl WHERE p IS NOT NULL GROUP BY 1),
rv AS (SELECT series || '|AR(1)' AS series, week_end_date, diff - c - phi * p AS v FROM rl JOIN rf USING (series) WHERE p IS NOT NULL
       UNION ALL SELECT series || '|Random Walk', week_end_date, diff FROM rl
       UNION ALL SELECT series || '|ARMA', week_end_date, y - pred FROM fl WHERE split = 'train' AND pred IS NOT NULL),
cr AS (SELECT split_part(series, '|', 1) AS series, count(*) AS n, sum(v * v) AS ssr FROM rv WHERE series LIKE '%|AR(1)' GROUP BY 1),
ic AS (SELECT series || '|AR(1)' AS series, n * (ln(2 * pi() * ssr / n) + 1) + 6 AS aic, n * (ln(2 * pi() * ssr / n) + 1) + 3 * ln(n) AS bic FROM cr
       UNION ALL SELECT series || '|ARMA', aic, bic FROM sel),
t AS (SELECT series, avg(v) AS m, stddev_samp(v) AS s FROM rv GROUP BY 1),
{RESID[0]}
SELECT split_part(series, '|', 1) AS series, split_part(series, '|', 2) AS model, round(m / 1e3, 6) AS resid_mean, round(s / 1e3, 6) AS resid_std,
       {RESID[1]}, round(aic, 6) AS aic, round(bic, 6) AS bic
FROM t {RESID[2]} LEFT JOIN ic USING (series)""")
def residual_diagnostics(spark, sf):
    """The families that SQL can fit: no change, AR(1) and ARMA by AIC."""
    train = durable(P.segment_model(spark, sf).filter(F.col("split") == "train"))
    resid, criteria = C.mean_families(train)
    out = D.residual_diagnostics(durable(resid), criteria)
    return rounded(out.withColumns({c: F.col(c) / 1e3 for c in ("resid_mean", "resid_std")}), 6)


@query("calibration_diagnostics")
def calibration_diagnostics(spark, sf):
    """All seven families: those, three volatility models of the ARMA residuals and the switching model."""
    train = durable(P.segment_model(spark, sf).filter(F.col("split") == "train"))
    return rounded(C.calibration_diagnostics(train), 6)


EDA = dependence_sql("sv", "change")


@query("eda_summary", sql=f"""
WITH RECURSIVE {SEG_V},
t AS (SELECT series, count(v) AS n_obs, avg(v) AS m, stddev_samp(v) AS s, skewness(v) AS sk, kurtosis(v) AS ku FROM sv GROUP BY 1),
{EDA[0]}
SELECT series, n_obs, round(m / 1e3, 6) AS mean, round(s / 1e3, 6) AS std, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, {EDA[1]}
FROM t {EDA[2]}""")
def eda(spark, sf):
    out = D.eda_summary(durable(P.segment_model(spark, sf)), "diff")
    return rounded(out.withColumns({c: F.col(c) / 1e3 for c in ("mean", "std")}), 6)
