"""Forecasting models."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import arma as A
from ..operators import volatility as V
from ..plans import panels as P
from ..session import durable
from .base import SEG_MODEL, cross_products, dense, query, rounded, sweep_step, swept, weekly
from .features import CREDIT, SHORT, arx_frame


def is_train():
    return F.col("split") == "train"


LONG, DESIGN = ["one", *[f"s{k}" for k in range(1, 9)], "y"], ["one", "y1", "y2", "y3", "e1", "e2", "e3", "y"]
ORDERS = ", ".join(f"({p}, {q}, [{', '.join(map(str, A.order_positions(p, q, 3, 3, 0)))}])" for p, q in A.order_grid())

# Every candidate order of every series: shocks of a long autoregression, then the design swept on the order's columns.
CANDIDATES = SEG_MODEL + f""",
lg AS (SELECT series, week_end_date, split, rn, diff AS y, CAST(1 AS DOUBLE) AS one, {", ".join(f"lag(diff, {k}) OVER w AS s{k}" for k in range(1, 9))}
       FROM seg_model WINDOW w AS (PARTITION BY series ORDER BY week_end_date)),
lm AS (SELECT series, {cross_products(LONG)} AS a FROM lg WHERE split = 'train' AND s8 IS NOT NULL GROUP BY 1),
{swept("lm", "lsw", 10, "9")},
sh AS (SELECT lg.*, y - ({" + ".join(f"a[{10 * (i + 1)}] * {c}" for i, c in enumerate(LONG[:-1]))}) AS e
       FROM lg JOIN lsw ON lsw.series = lg.series AND k = 9),
dz AS (SELECT series, split, one, y, {", ".join(f"lag(y, {k}) OVER w AS y{k}, lag(e, {k}) OVER w AS e{k}" for k in (1, 2, 3))}
       FROM sh WINDOW w AS (PARTITION BY series ORDER BY week_end_date)),
dm AS (SELECT series, count(*) AS n, {cross_products(DESIGN)} AS a FROM dz WHERE split = 'train' AND e3 IS NOT NULL AND y3 IS NOT NULL GROUP BY 1),
ord AS (SELECT * FROM (VALUES {ORDERS}) AS o(p, q, x)),
om AS (SELECT series, n, p, q, x, a FROM dm CROSS JOIN ord WHERE n > p + q + 1),
{swept("om", "osw", 8, "len(x)", "x[k + 1]", "series, n, p, q, x")},
cf AS (SELECT series, p, q, n, a[8] AS const, a[64] AS ssr,
              {", ".join(f"CASE WHEN p >= {i} THEN a[{8 * (i + 1)}] ELSE 0 END AS ar{i}" for i in (1, 2, 3))},
              {", ".join(f"CASE WHEN q >= {j} THEN a[{8 * (j + 4)}] ELSE 0 END AS ma{j}" for j in (1, 2, 3))}
       FROM osw WHERE k = len(x) AND a[64] > 0),
cand AS (SELECT *, n * (ln(2 * pi() * ssr / n) + 1) + 2 * (p + q + 2) AS aic, n * (ln(2 * pi() * ssr / n) + 1) + ln(n) * (p + q + 2) AS bic,
                {" AND ".join(f"1 - {a} - {b} - {c} > 0 AND 1 + {a} - {b} + {c} > 0 AND abs({c}) < 1 AND 1 - {c} * {c} > abs({b} + {a} * {c})"
                              for a, b, c in (("ar1", "ar2", "ar3"), ("(-ma1)", "(-ma2)", "(-ma3)")))} AS stable FROM cf)"""
SELECTED = CANDIDATES + """,
best AS (SELECT series, arg_min((p, q), CASE WHEN stable THEN (aic, p, q) END) AS o FROM cand GROUP BY 1),
sel AS (SELECT cand.* FROM cand JOIN best ON best.series = cand.series AND cand.p = best.o[1] AND cand.q = best.o[2])"""


@query("arma_select", sql=f"""
WITH RECURSIVE {SELECTED}
SELECT series, p, q, round(const, 4) AS const, {", ".join(f"round({c}{i}, 4) AS {c}{i}" for c in ("ar", "ma") for i in (1, 2, 3))},
       round(ssr / n / 1e6, 4) AS sigma2, n AS n_obs, round(aic, 4) AS aic, round(bic, 4) AS bic, 'ok' AS fit_status FROM sel""")
def arma_select(spark, sf):
    out = A.arma_select(A.arma_candidates(P.segment_model(spark, sf), "diff", is_train()))
    lags = [F.col(c)[i].alias(f"{c}{i + 1}") for c in ("ar", "ma") for i in range(3)]
    return rounded(out.select("series", "p", "q", "const", *lags, (F.col("sigma2") / 1e6).alias("sigma2"), "n_obs", "aic", "bic", "fit_status"), 4)


@query("arma_candidates", sql=f"""
WITH RECURSIVE {CANDIDATES}
SELECT series, p, q, round(const, 4) AS const, round(ssr / n / 1e6, 4) AS sigma2, n AS n_obs, round(aic, 4) AS aic, round(bic, 4) AS bic, stable FROM cand""")
def arma_candidates(spark, sf):
    out = A.arma_candidates(P.segment_model(spark, sf), "diff", is_train())
    return rounded(out.select("series", "p", "q", "const", (F.col("sigma2") / 1e6).alias("sigma2"), "n_obs", "aic", "bic", "stable"), 4)


def selected(model):
    return A.arma_select(A.arma_candidates(model, "diff", is_train()))


# One step of the filter per week: the last three values and shocks are carried along.
FILTERED = SELECTED + """,
fs AS (SELECT m.series, m.rn, m.week_end_date, m.split, m.diff AS y, s.p, s.const, s.ar1, s.ar2, s.ar3, s.ma1, s.ma2, s.ma3
       FROM seg_model AS m JOIN sel AS s USING (series)),
fl AS (
  SELECT series, rn, week_end_date, split, y, CAST(NULL AS DOUBLE) AS pred, y AS y1, CAST(0 AS DOUBLE) AS y2, CAST(0 AS DOUBLE) AS y3,
         CAST(0 AS DOUBLE) AS e1, CAST(0 AS DOUBLE) AS e2, CAST(0 AS DOUBLE) AS e3 FROM fs WHERE rn = 1 AND p > 0
  UNION ALL
  SELECT series, rn, week_end_date, split, y, const AS pred, y, 0, 0, y - const, 0, 0 FROM fs WHERE rn = 1 AND p = 0
  UNION ALL
  SELECT series, rn, week_end_date, split, y, pred, y, y1, y2, coalesce(y - pred, 0), e1, e2
  FROM (SELECT fs.series, fs.rn, fs.week_end_date, fs.split, fs.y, l.y1, l.y2, l.e1, l.e2,
               CASE WHEN fs.rn > p THEN const + ar1 * l.y1 + ar2 * l.y2 + ar3 * l.y3 + ma1 * l.e1 + ma2 * l.e2 + ma3 * l.e3 END AS pred
        FROM fl AS l JOIN fs ON fs.series = l.series AND fs.rn = l.rn + 1) AS x)"""
PATHS = FILTERED + """,
te AS (SELECT series, max(rn) AS rn FROM fl WHERE split = 'train' GROUP BY 1),
pt AS (
  SELECT fl.series, fl.rn, 0 AS step, CAST(NULL AS DOUBLE) AS pred, y1, y2, y3, e1, e2, e3 FROM fl JOIN te ON te.series = fl.series AND te.rn = fl.rn
  UNION ALL
  SELECT series, rn + 1, step + 1, pred, pred, y1, y2, 0, e1, e2
  FROM (SELECT pt.*, const + ar1 * y1 + ar2 * y2 + ar3 * y3 + ma1 * e1 + ma2 * e2 + ma3 * e3 AS pred_next
        FROM pt JOIN sel USING (series)) AS x(series, rn, step, old, y1, y2, y3, e1, e2, e3, pred)
  WHERE step < 2000 AND EXISTS (SELECT 1 FROM fs WHERE fs.series = x.series AND fs.rn = x.rn + 1))"""


@query("arma_static_path", sql=f"""
WITH RECURSIVE {PATHS}
SELECT pt.series, week_end_date, round(y, 4) AS actual, step, round(pt.pred, 4) AS pred FROM pt JOIN fs ON fs.series = pt.series AND fs.rn = pt.rn WHERE step > 0""")
def arma_static_path(spark, sf):
    model = P.segment_model(spark, sf)
    return rounded(A.arma_static_path(model, selected(model), "diff"))


@query("arma_rolling_one_step", sql=f"""
WITH RECURSIVE {FILTERED}
SELECT series, week_end_date, round(y, 4) AS actual, round(pred, 4) AS pred, round(y - pred, 4) AS resid, split FROM fl""")
def arma_rolling(spark, sf):
    model = P.segment_model(spark, sf)
    return rounded(A.arma_filter(model, selected(model), "diff", carry=("split",)))


# Orders as data: a series that isn't named gets (1, 2).
GIVEN_ORDERS = [("1-URGENT", 1, 2), ("2-HIGH", 2, 1), ("3-MEDIUM", 3, 0), ("4-NOT SPECIFIED", 0, 1)]
GIVEN_FILTERED = FILTERED.replace(SELECTED, CANDIDATES + f""",
giv AS (SELECT * FROM (VALUES {", ".join(map(str, GIVEN_ORDERS))}) AS g(series, p, q)),
sel AS (SELECT cand.* FROM cand LEFT JOIN giv ON giv.series = cand.series WHERE cand.p = coalesce(giv.p, 1) AND cand.q = coalesce(giv.q, 2) AND stable)""")


def given_orders(spark):
    return spark.createDataFrame(GIVEN_ORDERS, "series string, p int, q int")


@query("arma_given_orders", sql=f"""
WITH RECURSIVE {GIVEN_FILTERED}
SELECT fl.series, p AS order_p, q AS order_q, week_end_date, round(y, 4) AS actual, round(pred, 4) AS pred, split FROM fl JOIN sel ON sel.series = fl.series""")
def arma_given_orders(spark, sf):
    """Rolling forecasts of series of unlike orders, fitted in one job from one design."""
    model = durable(P.segment_model(spark, sf))
    params = durable(A.arma_select(A.arma_given(model, "diff", is_train(), given_orders(spark))))
    rows = A.arma_filter(model, params, "diff", carry=("split",))
    named = rows.join(params.where("fit_status = 'ok'").select("series", F.col("p").alias("order_p"), F.col("q").alias("order_q")), "series")
    return rounded(named.select("series", "order_p", "order_q", "week_end_date", "actual", "pred", "split"))


@query("arx_given_orders")
def arx_given_orders(spark, sf):
    """Rolling refits with regressors, each series at its own order."""
    frame, exog = arx_panel(spark, sf)
    own = spark.createDataFrame([(SHORT[s], p, q) for s, p, q in GIVEN_ORDERS], "series string, p int, q int")
    out = A.arx_rolling_refit(frame, "y", exog, own)
    return rounded(out.filter((F.col("split") == "test") & F.col("pred").isNotNull()).drop("split"))


@query("arma_rolling_suppliers")
def arma_rolling_suppliers(spark, sf):
    """Selection and rolling forecasts on a panel whose number of series grows with the data."""
    model = durable(supplier_model(spark, sf))
    return rounded(A.arma_filter(model, selected(model), "diff", carry=("split",)))


def supplier_model(spark, sf):
    from ..operators.calendar import interpolate_time, resample_week
    from ..operators.windows import chronological_split, diff

    weekly = resample_week(interpolate_time(P.supplier_daily(spark, sf)))
    return chronological_split(diff(weekly, "level", "diff").filter(F.col("diff").isNotNull()))


HORIZON = ["one", "y1", "e1", "e2", "y"]


@query("arma_horizon_recursive", sql=f"""
WITH RECURSIVE {CANDIDATES},
hz AS (SELECT series, split, one, y, lag(y) OVER w AS y1, lag(e) OVER w AS e1, lag(e, 2) OVER w AS e2
       FROM sh WINDOW w AS (PARTITION BY series ORDER BY week_end_date)),
hm AS (SELECT series, count(*) AS n, {cross_products(HORIZON)} AS a FROM hz WHERE split = 'train' AND e2 IS NOT NULL AND y1 IS NOT NULL GROUP BY 1),
{swept("hm", "hsw", 5, "4")},
hp AS (SELECT hm.series, n, s.a[5] AS c, s.a[10] AS ar, s.a[15] AS m1, s.a[20] AS m2 FROM hm JOIN hsw AS s ON s.series = hm.series AND k = 4),
hs AS (SELECT m.series, m.rn, m.week_end_date, m.split, m.diff AS y, hp.n, c, ar, m1, m2 FROM seg_model AS m JOIN hp USING (series)),
hf AS (
  SELECT series, rn, y, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS e1 FROM hs WHERE rn = 1
  UNION ALL
  SELECT hs.series, hs.rn, hs.y, hs.y - (c + ar * f.y + m1 * f.e + m2 * f.e1), f.e FROM hf AS f JOIN hs ON hs.series = f.series AND hs.rn = f.rn + 1),
p1 AS (SELECT hs.*, f.e, f.e1, c + ar * hs.y + m1 * f.e + m2 * f.e1 AS s1 FROM hs JOIN hf AS f ON f.series = hs.series AND f.rn = hs.rn),
p2 AS (SELECT *, c + ar * s1 + m2 * e AS s2 FROM p1), p3 AS (SELECT *, c + ar * s2 AS s3 FROM p2), p4 AS (SELECT *, c + ar * s3 AS s4 FROM p3),
ah AS (SELECT *, lead(y, 1) OVER w AS a1, lead(y, 2) OVER w AS a2, lead(y, 3) OVER w AS a3, lead(y, 4) OVER w AS a4
       FROM p4 WINDOW w AS (PARTITION BY series ORDER BY rn)),
bo AS (SELECT series, week_end_date, split, 1 AS horizon, a1 AS actual, CASE WHEN n >= 80 THEN s1 END AS pred FROM ah
       UNION ALL SELECT series, week_end_date, split, 4, a1 + a2 + a3 + a4, CASE WHEN n >= 80 THEN s1 + s2 + s3 + s4 END FROM ah)
SELECT series, week_end_date, split, horizon, round(actual, 4) AS actual, round(pred, 4) AS pred FROM bo WHERE actual IS NOT NULL""")
def arma_horizon(spark, sf):
    model = P.segment_model(spark, sf)
    params = A.arma_select(A.arma_candidates(model, "diff", is_train(), orders=[(1, 2)]))
    return rounded(A.arma_horizon_recursive(model, params, "diff"))


def train_residuals(model):
    filtered = A.arma_filter(model, selected(model), "diff", carry=("split",))
    return filtered


@query("garch_family_fit")
def garch_family(spark, sf):
    from functools import reduce

    train = durable(train_residuals(P.segment_model(spark, sf)).filter(is_train()))
    fits = [V.volatility_fit(train, "resid", m) for m in V.MODELS]
    return rounded(reduce(lambda a, b: a.unionByName(b), fits), 6)


@query("standardised_residuals")
def standardised_residuals(spark, sf):
    """Training residuals over the fitted sigma of each volatility model."""
    from functools import reduce

    train = durable(train_residuals(P.segment_model(spark, sf)).filter(is_train()))
    rows = [V.variance_recursion(train, V.volatility_fit(train, "resid", m), "resid", model=m).withColumn("vol_model", F.lit(m)) for m in V.MODELS]
    return rounded(reduce(lambda a, b: a.unionByName(b), rows).select("series", "vol_model", "week_end_date", "sigma", "z"), 4)


# Given parameters, so that a recursive query can state the same path.
GJR = {"alpha": 0.05, "gamma": 0.1, "beta": 0.85, "omega_share": 0.05}


@query("gjr_variance_recursion", sql=f"""
WITH RECURSIVE {SEG_MODEL},
s AS (SELECT series, week_end_date, rn, diff AS e, var_pop(diff) OVER (PARTITION BY series) AS v FROM seg_model),
r AS (SELECT series, week_end_date, rn, e, v, v AS h FROM s WHERE rn = 1
  UNION ALL SELECT s.series, s.week_end_date, s.rn, s.e, s.v,
    0.05 * s.v + (0.05 + CASE WHEN r.e < 0 THEN 0.1 ELSE 0 END) * r.e * r.e + 0.85 * r.h
  FROM r JOIN s ON s.series = r.series AND s.rn = r.rn + 1)
SELECT series, week_end_date, round(e, 4) AS diff, round(h / 1e6, 4) AS h, round(sqrt(h), 4) AS sigma, round(e / sqrt(h), 6) AS z FROM r""")
def gjr_recursion(spark, sf):
    model = P.segment_model(spark, sf)
    params = given_gjr(model)
    out = V.variance_recursion(model, params, "diff")
    return rounded(out.withColumn("h", F.col("h") / 1e6), 4, z=6)


def given_gjr(model):
    v = model.groupBy("series").agg(F.var_pop("diff").alias("h0"))
    return v.select("series", (GJR["omega_share"] * F.col("h0")).alias("omega"),
                    *[F.lit(GJR[c]).alias(c) for c in ("alpha", "gamma", "beta")], "h0")


@query("gjr_static_path", sql=f"""
WITH RECURSIVE {SEG_MODEL},
s AS (SELECT series, var_pop(diff) AS v, count(CASE WHEN split = 'test' THEN 1 END) AS n FROM seg_model GROUP BY 1),
r AS (SELECT series, v, n, 1 AS step, v * 1.5 AS h FROM s
  UNION ALL SELECT series, v, n, step + 1, 0.05 * v + (0.05 + 0.05 + 0.85) * h FROM r WHERE step < n)
SELECT series, step, round(h / 1e6, 4) AS h, round(sqrt(h), 4) AS sigma FROM r""")
def gjr_path(spark, sf):
    model = P.segment_model(spark, sf)
    sizes = model.filter(F.col("split") == "test").groupBy("series").agg(F.count(F.lit(1)).cast("int").alias("_h"))
    state = given_gjr(model).join(sizes, "series").withColumn("h1", F.col("h0") * 1.5)
    out = V.variance_path(state, F.col("_h"))
    return rounded(out.withColumn("h", F.col("h") / 1e6))


def arx_panel(spark, sf):
    """Regression frame of one target per series: all share the regressors of their week; computed once."""
    from ..operators.windows import chronological_split

    frame = arx_frame(spark, sf)
    targets = [c for c in frame.columns if c.endswith("_diff")]
    exog = [c for c in frame.columns if c.endswith("_lag1")]
    tagged = F.array(*[F.struct(F.lit(t.removesuffix("_diff")).alias("series"), F.col(t).alias("y")) for t in targets])
    rows = frame.select("week_end_date", *exog, F.explode(tagged).alias("t")).select("week_end_date", *exog, "t.*")
    return durable(chronological_split(rows)), exog


@query("arx_fit_forecast")
def arx_static(spark, sf):
    frame, exog = arx_panel(spark, sf)
    return rounded(A.arx_static_forecast(frame, "y", exog, (1, 2)))


@query("arx_rolling_refit")
def arx_rolling(spark, sf):
    """Expanding forecasts with volatility bands from the training residuals."""
    frame, exog = arx_panel(spark, sf)
    fc = A.arx_rolling_refit(frame, "y", exog, (1, 2))
    params = V.volatility_fit(fc.filter(is_train()), "resid", "gjr")
    vol = V.variance_recursion(fc, params, "resid", floor=1e-12).select("series", "week_end_date", "sigma")
    out = V.with_band(fc.filter((F.col("split") == "test") & F.col("pred").isNotNull()).join(vol, ["series", "week_end_date"]))
    return rounded(out.drop("split"))


# Systems: one per order status, a series for each of the priorities.
SYSTEM_SERIES = SHORT
SYSTEM_NAMES = CREDIT


def systems(spark, sf):
    """Wide weekly changes of each system with the chronological split."""
    from ..operators.calendar import interpolate_time, resample_week
    from ..operators.cleaning import relabel
    from ..operators.joins import panel_to_wide
    from ..operators.windows import chronological_split, diff

    sep = "|"
    daily = (P.table(spark, sf, "orders")
             .groupBy(F.concat_ws(sep, "o_orderstatus", "o_orderpriority").alias("series"), P.day("o_orderdate").alias("ts"))
             .agg(F.avg("o_totalprice").alias("value")))
    weekly = diff(resample_week(interpolate_time(daily)), "level", "diff").filter(F.col("diff").isNotNull())
    parts = F.split("series", r"\|")
    named = weekly.select(parts[0].alias("system"), parts[1].alias("series"), "week_end_date", "diff")
    wide = panel_to_wide(relabel(named, "series", SYSTEM_SERIES), SYSTEM_NAMES, "diff", "week_end_date", ("system",))
    # The models below read the frame several times; the raw table is scanned once.
    return durable(chronological_split(wide.na.drop(), keys=("system",)))


VAR_LAGS = 8
VAR_X = ["one", *[f"{n}_{k}" for k in range(1, VAR_LAGS + 1) for n in SYSTEM_NAMES]]
VAR_K, VAR_N = len(VAR_X), len(VAR_X) + len(SYSTEM_NAMES)


def _own_lags(limit: str) -> str:
    return ", ".join(f"CASE WHEN {k} <= {limit} THEN {n}_{k} ELSE 0 END AS {n}_{k}" for k in range(1, VAR_LAGS + 1) for n in SYSTEM_NAMES)


# Lag orders by the log determinant of the residual products: the targets' own columns are swept after the lags.
VAR_ORDERS = f"""sys_daily AS (
  SELECT o_orderstatus || '|' || o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2),
{dense("sys_daily", "sys_dense")}, {weekly("sys_dense", "sys_weekly")},
sdf AS (SELECT split_part(series, '|', 1) AS system, split_part(series, '|', 2) AS part, week_end_date,
               level - lag(level) OVER (PARTITION BY series ORDER BY week_end_date) AS diff FROM sys_weekly),
swd AS (SELECT system, week_end_date, {", ".join(f"max(CASE WHEN part = '{p}' THEN diff END) AS {n}" for p, n in SYSTEM_SERIES.items())}
        FROM sdf WHERE diff IS NOT NULL GROUP BY 1, 2),
snm AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY week_end_date) AS rn, count(*) OVER (PARTITION BY system) AS nn
        FROM swd WHERE {" AND ".join(f"{n} IS NOT NULL" for n in SYSTEM_NAMES)}),
svl AS (SELECT *, CASE WHEN rn <= floor(CAST(0.8 AS DOUBLE) * nn) THEN 'train' ELSE 'test' END AS split, CAST(1 AS DOUBLE) AS one,
               {", ".join(f"lag({n}, {k}) OVER w AS {n}_{k}" for k in range(1, VAR_LAGS + 1) for n in SYSTEM_NAMES)}
        FROM snm WINDOW w AS (PARTITION BY system ORDER BY week_end_date)),
svm AS (SELECT system, count(*) AS n, {cross_products([*VAR_X, *SYSTEM_NAMES])} AS a FROM svl WHERE split = 'train' AND rn > {VAR_LAGS} GROUP BY 1),
{swept("svm", "svs", VAR_N, str(VAR_K), keys="system, n")},
sv0 AS (SELECT system, n, CAST((k - 1) / {len(SYSTEM_NAMES)} AS INTEGER) AS p, a FROM svs WHERE k > 1 AND (k - 1) % {len(SYSTEM_NAMES)} = 0 AND n > k),
svd AS (
  SELECT system, n, p, 0 AS j, CAST(0 AS DOUBLE) AS ld, a FROM sv0
  UNION ALL
  SELECT system, n, p, j + 1, ld + ln(a[({VAR_K} + j) * {VAR_N + 1} + 1]), {sweep_step("a", VAR_N, f"({VAR_K} + j)")} FROM svd WHERE j < {len(SYSTEM_NAMES)}),
svo AS (SELECT system, arg_min(p, (ld - {len(SYSTEM_NAMES)} * ln(n) + 2.0 * (p * {len(SYSTEM_NAMES) ** 2} + {len(SYSTEM_NAMES)}) / n, p)) AS lag_order
        FROM svd WHERE j = {len(SYSTEM_NAMES)} GROUP BY 1),
ord AS (SELECT DISTINCT svl.system, coalesce(lag_order, 1) AS lag_order FROM svl LEFT JOIN svo USING (system))"""


@query("var_lag_select", sql=f"WITH RECURSIVE {VAR_ORDERS} SELECT system, lag_order FROM svo")
def var_lags(spark, sf):
    from ..operators import vector as Y

    return Y.var_lag_select(systems(spark, sf).filter(is_train()), SYSTEM_NAMES)


@query("var_fit_static", sql=f"""
WITH RECURSIVE {VAR_ORDERS},
own AS (SELECT svl.system, one, {_own_lags("lag_order")}, {", ".join(SYSTEM_NAMES)} FROM svl JOIN ord USING (system) WHERE split = 'train' AND rn > lag_order),
om AS (SELECT system, {cross_products([*VAR_X, *SYSTEM_NAMES])} AS a FROM own GROUP BY 1),
{swept("om", "os", VAR_N, str(VAR_K), keys="system")},
co AS (SELECT system, list_transform(range({len(SYSTEM_NAMES)}), lambda j: a[{VAR_K} + j + 1]) AS c0,
              [{", ".join(f"list_transform(range({VAR_K - 1}), lambda i: a[(i + 1) * {VAR_N} + {VAR_K + j} + 1])" for j in range(len(SYSTEM_NAMES)))}] AS cl
       FROM os WHERE k = {VAR_K}),
te AS (SELECT system, max(rn) AS rn FROM svl WHERE split = 'train' GROUP BY 1),
pa AS (
  SELECT svl.system, svl.rn, nn, [{", ".join([*SYSTEM_NAMES, *[f"{n}_{k}" for k in range(1, VAR_LAGS) for n in SYSTEM_NAMES]])}] AS s
  FROM svl JOIN te ON te.system = svl.system AND te.rn = svl.rn
  UNION ALL
  SELECT pa.system, rn + 1, nn, list_concat([{", ".join(f"c0[{j + 1}] + list_dot_product(cl[{j + 1}], s)" for j in range(len(SYSTEM_NAMES)))}], s[1:{(VAR_LAGS - 1) * len(SYSTEM_NAMES)}])
  FROM pa JOIN co USING (system) WHERE rn < nn)
{" UNION ALL ".join(f"SELECT svl.system, svl.week_end_date, '{n}' AS series, round({n}, 4) AS actual, round(s[{j + 1}], 4) AS pred FROM svl JOIN pa ON pa.system = svl.system AND pa.rn = svl.rn WHERE split = 'test'" for j, n in enumerate(SYSTEM_NAMES))}""")
def var_static(spark, sf):
    from ..operators import vector as Y

    return rounded(Y.var_static(systems(spark, sf), SYSTEM_NAMES))


@query("var_residual_checks")
def var_residual_checks(spark, sf):
    from ..operators import diagnostics as D
    from ..operators import vector as Y

    train = systems(spark, sf).filter(is_train())
    fit = Y.var_fit(train, SYSTEM_NAMES, Y.var_lag_select(train, SYSTEM_NAMES))
    resid = durable(Y.var_residuals(train, SYSTEM_NAMES, fit))
    return rounded(D.ljung_box(resid, "resid", keys=("system", "series"))
                   .join(D.jarque_bera(resid, "resid", ("system", "series")), ["system", "series"]), 6)


@query("var_rolling")
def var_rolling(spark, sf):
    from ..operators import vector as Y

    return rounded(Y.var_rolling(systems(spark, sf), SYSTEM_NAMES))


@query("first_factor")
def first_factor(spark, sf):
    from ..operators import regimes as G

    out = G.first_factor(systems(spark, sf), SYSTEM_NAMES)
    return rounded(out.select("system", "week_end_date", "split", "factor", "explained", "flipped"), 6)


@query("two_regime_switching")
def switching(spark, sf):
    from ..operators import regimes as G

    factored = G.first_factor(systems(spark, sf), SYSTEM_NAMES).filter(is_train())
    _, rows = G.two_regime_switching(factored, "factor")
    return rounded(rows.withColumn("p_stress", F.col("p_regime")[1]).drop("p_regime"), 4)


# Given parameters, so that recursive queries can state both passes.
@query("regime_probabilities", sql=f"""
WITH RECURSIVE {SEG_MODEL},
g AS (SELECT series, avg(diff) AS m, stddev_pop(diff) AS s FROM seg_model GROUP BY 1),
x AS (SELECT series, week_end_date, seg_model.rn, diff, exp(-0.5 * pow((diff - m + 0.5 * s) / (0.5 * s), 2)) / (0.5 * s) AS d0,
        exp(-0.5 * pow((diff - m - s) / s, 2)) / s AS d1 FROM seg_model JOIN g USING (series)),
fw AS (
  SELECT series, rn, CAST(0.3 AS DOUBLE) AS prior, 0.3 * d1 / (0.7 * d0 + 0.3 * d1) AS f, 0.7 * d0 + 0.3 * d1 AS norm FROM x WHERE rn = 1
  UNION ALL
  SELECT series, rn, prior, prior * d1 / ((1 - prior) * d0 + prior * d1), (1 - prior) * d0 + prior * d1
  FROM (SELECT x.series, x.rn, d0, d1, (1 - f) * 0.1 + f * 0.8 AS prior FROM fw JOIN x ON x.series = fw.series AND x.rn = fw.rn + 1) AS n),
bw AS (
  SELECT series, rn, prior, f AS p FROM fw WHERE (series, rn) IN (SELECT (series, max(rn)) FROM fw GROUP BY series)
  UNION ALL
  SELECT fw.series, fw.rn, fw.prior, fw.f * (0.2 * (1 - bw.p) / (1 - bw.prior) + 0.8 * bw.p / bw.prior)
  FROM bw JOIN fw ON fw.series = bw.series AND fw.rn = bw.rn - 1)
SELECT x.series, week_end_date, round(diff, 4) AS diff, round(f, 6) AS p_filtered, round(p, 6) AS p_smoothed, round(ln(norm / sqrt(2 * pi())), 6) AS loglik
FROM x JOIN fw ON fw.series = x.series AND fw.rn = x.rn JOIN bw ON bw.series = x.series AND bw.rn = x.rn""")
def regime_probabilities(spark, sf):
    from ..operators import switching as H

    model = durable(P.segment_model(spark, sf))
    m, s = F.avg("diff"), F.stddev_pop("diff")
    given = {"mu0": m - 0.5 * s, "mu1": m + s, "sd0": 0.5 * s, "sd1": s, "stay0": F.lit(0.9), "stay1": F.lit(0.8), "start1": F.lit(0.3)}
    params = model.groupBy("series").agg(*[v.alias(c) for c, v in given.items()])
    return rounded(H.regime_probabilities(model, params, "diff"), 6, diff=4)


@query("switching_by_steps")
def switching_by_steps(spark, sf):
    """The switching fit of each series without gathering it; ten steps from the halves around the mean."""
    from ..operators import switching as H

    train = durable(P.segment_model(spark, sf).filter(is_train()))
    return rounded(H.fit_switching(train, "diff", rounds=10), 4)


@query("regime_var")
def regime_var(spark, sf):
    from ..operators import regimes as G

    _, _, fits = G.fit_regimes(systems(spark, sf), SYSTEM_NAMES)
    return rounded(fits.select("system", "regime", "lag_order", "n_obs", "own_fit", F.col("coef")[0][0].alias("const_first")))


@query("regime_static")
def regime_static(spark, sf):
    from ..operators import regimes as G

    return rounded(G.regime_static(systems(spark, sf), SYSTEM_NAMES))


@query("regime_rolling")
def regime_rolling(spark, sf):
    from ..operators import regimes as G

    return rounded(G.regime_rolling(systems(spark, sf), SYSTEM_NAMES))


def learner_rows(spark, sf, horizons=(1, 4)):
    """Direct rows of every (series, horizon): all features imputed, purged split, checkpointed."""
    from functools import reduce

    from ..operators.cleaning import median_impute
    from ..operators.windows import purged_split
    from .features import CREDIT, feature_frame

    frame = durable(feature_frame(spark, sf))
    features = [c for c in frame.columns if c not in ("frame", "week_end_date")]
    levels = F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).alias("_level")) for s in CREDIT])
    known = (frame.withColumn("_s", F.explode(levels)).select("*", "_s.*").drop("_s")
             .filter(F.col("_level").isNotNull()))
    rows = reduce(lambda a, b: a.unionByName(b),
                  [purged_split(known, h, level="_level").withColumn("horizon", F.lit(h)) for h in horizons])
    return durable(median_impute(durable(rows.drop("_level")), features, is_train(), ("series", "horizon"))), features


@query("elastic_net_cv")
def elastic_net(spark, sf):
    from ..operators import learners as L

    rows, features = learner_rows(spark, sf)
    fit = L.elastic_net_cv(rows.filter(is_train()), features)
    out = L.linear_forecast(rows.filter(F.col("split") == "test"), fit, features)
    return rounded(out.select("series", "horizon", "week_end_date", F.col("target").alias("actual"), "pred"), 4)


def tree_models():
    """The forest and the boosted variants: all rows a round, and a random share of them."""
    from ..operators import learners as L

    return {"Random Forest": L.random_forest(), "Gradient Boosting": L.gradient_boosting(),
            "Subsampled Boosting": L.gradient_boosting(subsample=0.8)}


def tree_rows(spark, sf, rows=None, features=None):
    """Vectors of every (series, horizon) in one table."""
    from ..operators import learners as L

    if rows is None:
        rows, features = learner_rows(spark, sf)
    return durable(L.pooled_rows(rows, features).select("series", "horizon", "week_end_date", "split", "target", "features")), features


def tree_forecasts(assembled, names):
    """Test forecasts of one pooled model per name."""
    from functools import reduce

    from ..operators import learners as L

    fitted = {n: L.fit_pooled(assembled, tree_models()[n]) for n in names}
    test = assembled.filter(F.col("split") == "test")
    out = reduce(lambda a, b: a.unionByName(b), [m.transform(test).withColumn("model", F.lit(n)) for n, m in fitted.items()])
    return fitted, out.select("series", "horizon", "week_end_date", "model", F.col("target").alias("actual"), "pred")


def tree_query(spark, sf, *names):
    assembled, _ = tree_rows(spark, sf)
    return rounded(tree_forecasts(assembled, names)[1], 4)


@query("random_forest")
def random_forest(spark, sf):
    return tree_query(spark, sf, "Random Forest")


@query("gradient_boosting")
def gradient_boosting(spark, sf):
    return tree_query(spark, sf, "Gradient Boosting", "Subsampled Boosting")


@query("permutation_importance")
def importance(spark, sf):
    """Of the best learner of each series and horizon, the twelve features it needs most.

    The elastic net, the forest and both boosted variants compete; the least squared error of the test rows wins.
    """
    from ..operators import evaluation as E
    from ..operators import learners as L

    rows, features = learner_rows(spark, sf)
    assembled, _ = tree_rows(spark, sf, rows, features)
    fitted, fc = tree_forecasts(assembled, list(tree_models()))
    linear = L.LinearModel(durable(L.elastic_net_cv(rows.filter(is_train()), features)))
    fitted["Elastic Net"] = linear
    test = assembled.filter(F.col("split") == "test")
    fc = fc.unionByName(linear.transform(test).select("series", "horizon", "week_end_date", F.lit("Elastic Net").alias("model"),
                                                      F.col("target").alias("actual"), "pred"))
    loss = durable(fc.groupBy("series", "horizon", "model").agg(F.avg(F.pow(E.error(), F.lit(2.0))).alias("mse")).filter("mse IS NOT NULL"))
    best = loss.groupBy("series", "horizon").agg(F.min_by("model", F.struct("mse", "model")).alias("model"))
    rises = L.permutation_importance(fitted, durable(test.join(best, ["series", "horizon"])), features)
    rank = F.row_number().over(Window.partitionBy("series", "horizon").orderBy(F.desc("importance"), "feature"))
    return rounded(rises.withColumn("rank", rank).filter(F.col("rank") <= 12), 4)


# Given models of the streamed series: an ARMA(1, 1) around the mean with asymmetric variance.
def stream_params(events):
    stats = events.groupBy("series").agg(F.avg("value").alias("_m"), F.var_pop("value").alias("h0"))
    return stats.filter(F.col("h0") > 0).select(
        "series", (0.7 * F.col("_m")).alias("const"), F.array(F.lit(0.3)).alias("ar"), F.array(F.lit(0.2)).alias("ma"),
        (0.05 * F.col("h0")).alias("omega"), F.lit(0.05).alias("alpha"), F.lit(0.1).alias("gamma"), F.lit(0.85).alias("beta"), "h0")


def event_bins(spark, sf):
    """Hourly mean per user: at most one row per user and hour, however busy a user is."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return (P.table(spark, sf, "events")
            .groupBy(F.col("user_id").cast("string").alias("series"), hour.alias("ts"))
            .agg(F.min("event_id").alias("event_id"), F.avg("value").alias("value")))


def stage_stream(bins, staged: str, delay_hours: int, files: int | None = None):
    """Files in time order, then a heartbeat of every series that lies beyond the delay."""
    ordered = bins.repartitionByRange(files, "ts") if files else bins.repartitionByRange("ts")
    ordered.sortWithinPartitions("ts").write.parquet(staged)
    end = bins.agg(F.max("ts").alias("end")).first()["end"]
    beat = bins.select("series").distinct().select(
        "series", (F.lit(end) + F.expr(f"INTERVAL {delay_hours + 24} HOURS")).alias("ts"),
        F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("value"))
    beat.write.mode("append").parquet(staged)


def scored_stream(spark, bins, params, files: int | None = None, per_trigger: int | None = None, delay_hours: int = 48):
    from ..session import fresh_path
    from ..streaming.scorer import online_scorer as score, run_to_table

    staged, path = fresh_path(spark, "staged"), fresh_path(spark, "scored")
    stage_stream(bins, staged, delay_hours, files)
    reader = spark.readStream.schema(bins.schema)
    stream = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(staged)
    run_to_table(score(stream, params, delay_hours), path, fresh_path(spark, "scored-checkpoint"))
    return spark.read.parquet(path)


def with_hour(df, *more):
    return df.select("series", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("hour"), "event_id", "actual", "pred", "sigma", "lower_95", "upper_95", *more)


# Both scorers' rows from the given parameters: one recursion step per hour of a series.
SCORES = """
WITH RECURSIVE bins AS (
  SELECT CAST(user_id AS VARCHAR) AS series, date_trunc('hour', ts) AS ts, min(event_id) AS event_id, avg(value) AS value
  FROM events GROUP BY 1, 2),
par AS (SELECT series, 0.7 * avg(value) AS c, var_pop(value) AS h0 FROM bins GROUP BY 1 HAVING var_pop(value) > 0),
s AS (SELECT bins.*, c, h0, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn FROM bins JOIN par USING (series)),
r AS (
  SELECT series, ts, event_id, rn, value, h0, CAST(NULL AS DOUBLE) AS pred, h0 AS h,
         CAST(0 AS DOUBLE) AS shock, CAST(NULL AS DOUBLE) AS e, CAST(NULL AS DOUBLE) AS eh
  FROM s WHERE rn = 1
  UNION ALL
  SELECT series, ts, event_id, rn, value, h0, pred, h, value - pred, value - pred, h
  FROM (SELECT s.series, s.ts, s.event_id, s.rn, s.value, s.h0, s.c + 0.3 * r.value + 0.2 * r.shock AS pred,
               CASE WHEN r.e IS NULL THEN s.h0
                    ELSE 0.05 * s.h0 + (0.05 + CASE WHEN r.e < 0 THEN 0.1 ELSE 0 END) * r.e * r.e + 0.85 * r.eh END AS h
        FROM r JOIN s ON s.series = r.series AND s.rn = r.rn + 1) AS x)
SELECT series, strftime(ts, '%Y-%m-%d %H:%M') AS hour, event_id, false AS late, round(value, 6) AS actual, round(pred, 6) AS pred, round(sqrt(h), 6) AS sigma,
       round(pred - 1.96 * sqrt(h), 6) AS lower_95, round(pred + 1.96 * sqrt(h), 6) AS upper_95
FROM r
UNION ALL
SELECT series, strftime(ts, '%Y-%m-%d %H:%M'), event_id, false, round(value, 6), NULL, NULL, NULL, NULL
FROM bins WHERE series NOT IN (SELECT series FROM par)"""


@query("online_scorer", sql=SCORES)
def online_scorer(spark, sf):
    """Score a stream of hourly values of every user, staged as files; none of its rows is late. Users without a model keep their rows."""
    bins = durable(event_bins(spark, sf))
    scored = scored_stream(spark, bins, durable(stream_params(bins)))
    return rounded(with_hour(scored, "late"), 6)


@query("online_scorer_batch_twin", sql=SCORES)
def online_scorer_twin(spark, sf):
    """The same rows by the batch operators."""
    bins = durable(event_bins(spark, sf))
    params = durable(stream_params(bins))
    keyed = bins.withColumn("key", F.struct("ts", "event_id"))
    means = A.arma_filter(keyed, params.withColumn("p", F.lit(1)), "value", ts="key", max_p=1, max_q=1)
    vol = V.variance_recursion(means, params, "resid", ts="key").select("series", "key", "sigma")
    both = V.with_band(means.join(vol, ["series", "key"]))
    return rounded(with_hour(both.select("*", "key.ts", "key.event_id", F.lit(False).alias("late")), "late"), 6)


@query("univariate_report")
def univariate_report(spark, sf):
    """Static and rolling forecasts of all base models: accuracy, direction, coverage, loss test."""
    from ..plans.univariate import full_report

    return rounded(full_report(durable(P.segment_model(spark, sf))), 4)


@query("direct_report")
def direct_report(spark, sf):
    """Benchmarks and the elastic net on the weeks all of them cover, with winners."""
    from ..operators.models import model_comparison

    rows, features = learner_rows(spark, sf)
    model = durable(P.segment_model(spark, sf))
    return rounded(model_comparison(durable(all_direct(spark, sf, rows, features, model)), len(DIRECT_MODELS)), 4)


DIRECT_MODELS = ("Random Walk", "ARMA(1, 2)", "Elastic Net", "Random Forest", "Gradient Boosting", "Subsampled Boosting")


def all_direct(spark, sf, rows, features, model):
    """Forecasts of every benchmark and learner at both horizons."""
    from ..plans.direct import direct_forecasts
    from .features import SHORT

    trees = tree_forecasts(tree_rows(spark, sf, rows, features)[0], DIRECT_MODELS[3:])[1]
    return direct_forecasts(rows, features, model, SHORT).unionByName(trees)


@query("direct_pairwise")
def direct_pairwise(spark, sf):
    """Every learner against both benchmarks, per series and horizon, with the horizon's lag count."""
    from ..operators import evaluation as E

    rows, features = learner_rows(spark, sf)
    fc = all_direct(spark, sf, rows, features, durable(P.segment_model(spark, sf)))
    return rounded(E.pairwise_dm(durable(fc), list(DIRECT_MODELS[:2])), 4)
