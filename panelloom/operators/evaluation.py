"""Accuracy tables, equal-accuracy tests and winners on the long forecast table.

The table has one row per ``(keys, ts, model)`` with ``actual`` and ``pred``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import finite, same_sign, two_sided_p

KEYS = ("method", "series", "model")


def error(actual: str = "actual", pred: str = "pred") -> Column:
    return F.col(actual) - F.col(pred)


def rmse(actual: str = "actual", pred: str = "pred") -> Column:
    return F.sqrt(F.avg(error(actual, pred) * error(actual, pred)))


def mae(actual: str = "actual", pred: str = "pred") -> Column:
    return F.avg(F.abs(error(actual, pred)))


def forecast_metrics(fc: DataFrame, keys=KEYS) -> DataFrame:
    return fc.groupBy(*keys).agg(rmse().alias("rmse"), mae().alias("mae"))


def pooled_metrics(fc: DataFrame, model: str = "model", series: str = "series") -> DataFrame:
    """Per series, plus a row "average" pooled over all errors of a model."""
    by_series, pooled = [F.col(model), F.col(series)], [F.col(model)]
    return (fc.groupingSets([by_series, pooled], F.col(model), F.col(series))
            .agg(rmse().alias("rmse"), mae().alias("mae"))
            .select(model, F.coalesce(series, F.lit("average")).alias(series), "rmse", "mae"))


def step_rmse(df: DataFrame, actual: str, pred: str, keys=("series",)) -> DataFrame:
    """RMSE of array forecasts per output step and over all steps (step 0)."""
    steps = (df.select(*keys, F.posexplode(F.arrays_zip(F.col(actual).alias("a"), F.col(pred).alias("p")))
                       .alias("pos", "z"))
             .select(*keys, (F.col("pos") + 1).alias("step"), F.col("z.a").alias("actual"),
                     F.col("z.p").alias("pred")))
    names = [F.col(k) for k in keys]
    return (steps.groupingSets([names + [F.col("step")], names], *names, F.col("step"))
            .agg(rmse().alias("rmse"))
            .select(*keys, F.coalesce("step", F.lit(0)).cast("long").alias("step"), "rmse"))


def directional_accuracy(fc: DataFrame, keys=KEYS) -> DataFrame:
    """Share of equal signs over finite pairs; null where there is none."""
    both = finite(F.col("actual")) & finite(F.col("pred"))
    hit = F.when(both, same_sign(F.col("actual"), F.col("pred")).cast("double"))
    return fc.groupBy(*keys).agg(F.avg(hit).alias("directional_accuracy"))


def improvement_vs_baseline(metrics: DataFrame, baseline: str = "Random Walk", group=("series",)) -> DataFrame:
    base = F.max(F.when(F.col("model") == baseline, F.col("rmse"))).over(Window.partitionBy(*group))
    return metrics.withColumn("improvement_pct", 100 * (base - F.col("rmse")) / F.when(base != 0, base))


def interval_coverage(fc: DataFrame, keys=KEYS, z: float = 1.96) -> DataFrame:
    """Share of actual values inside ``pred +/- z * sigma``."""
    lower, upper = F.col("pred") - z * F.col("sigma"), F.col("pred") + z * F.col("sigma")
    return fc.groupBy(*keys).agg(F.avg(F.col("actual").between(lower, upper).cast("double")).alias("coverage_95"))


def pivot_report(metrics: DataFrame, value: str, series, index=("method", "model")) -> DataFrame:
    """One column per series, mean on ties; rows with no value at all are dropped."""
    names = list(series)
    wide = metrics.groupBy(*index).agg(
        *[F.avg(F.when(F.col("series") == s, F.col(value))).alias(s) for s in names])
    return wide.na.drop(how="all", subset=names)


def winner_table(metrics: DataFrame, group=("series", "horizon")) -> DataFrame:
    """Lowest RMSE per group, ties by model name: a combining aggregate, no ranking sort."""
    rest = [c for c in metrics.columns if c not in (*group, "rmse", "model")]
    best = metrics.filter(F.col("rmse").isNotNull()).groupBy(*group).agg(
        F.min(F.struct("rmse", "model", *rest)).alias("b"))
    return best.select(*group, "b.*")


def rank_nulls_last(metrics: DataFrame, criterion: str = "aic", key: str = "series") -> DataFrame:
    """Models of a series ordered by a criterion, those without one at the end."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last(criterion), "model")
    return metrics.withColumn("rank", F.row_number().over(w).cast("long"))


def top_k(df: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), F.asc(tie)).limit(k)


def repeat_stats(runs: DataFrame, value: str = "value", keys=("series", "metric")) -> DataFrame:
    """Mean, deviation, 95 percent interval and range over repeated runs; one run has no spread."""
    n = F.count(value)
    std = F.when(n > 1, F.stddev_samp(value)).otherwise(0.0)
    half = 1.96 * std / F.sqrt(n)
    return runs.groupBy(*keys).agg(
        F.avg(value).alias("mean"), std.alias("std"), (F.avg(value) - half).alias("ci_lb"),
        (F.avg(value) + half).alias("ci_ub"), F.min(value).alias("min"), F.max(value).alias("max"))


def compact_summary(stats: DataFrame, metrics, key: str = "series") -> DataFrame:
    """Selected run means side by side, one row per series."""
    return stats.groupBy(key).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("mean"))).alias(f"{m}_mean") for m in metrics])


def union_reports(**tables: DataFrame) -> DataFrame:
    """Tagged row-bind of report tables; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [t.withColumn("report", F.lit(name)) for name, t in tables.items()])


def group_mean_by_label(df: DataFrame, value: str, label: str = "regime", keys=("series",)) -> DataFrame:
    """Mean per label; the label with the highest one is the stress label."""
    means = df.groupBy(*keys, label).agg(F.avg(value).alias("label_mean"), F.count(value).alias("n_obs"))
    top = F.max_by(label, "label_mean").over(Window.partitionBy(*keys))
    return means.withColumn("is_stress", F.col(label) == top)


def error_table(fc: DataFrame) -> DataFrame:
    return (fc.withColumn("residual", error()).withColumn("abs_error", F.abs(error()))
            .withColumn("correct_direction", same_sign(F.col("actual"), F.col("pred"))))


def complete_for_all(fc: DataFrame, n_models: int, keys=("series", "horizon"), ts: str = "week_end_date") -> DataFrame:
    """Rows of dates on which every model and the actual value are known."""
    w = Window.partitionBy(*keys, ts)
    have = F.count(F.when(F.col("pred").isNotNull() & F.col("actual").isNotNull(), 1)).over(w)
    return fc.withColumn("_have", have).filter(F.col("_have") == n_models).drop("_have")


def _loss_test(df: DataFrame, keys, h: int, min_obs: int, ts: str) -> DataFrame:
    """Loss-difference column ``d`` to statistic and p-value per key."""
    w = Window.partitionBy(*keys).orderBy(ts)
    lagged = df if h == 1 else df.select("*", *[F.lag("d", j).over(w).alias(f"d{j}") for j in range(1, h)])
    sums = lagged.groupBy(*keys).agg(
        F.count("d").alias("n_obs"), F.avg("d").alias("_mean"), F.var_samp("d").alias("_var"),
        *[F.covar_samp(F.when(F.col(f"d{j}").isNotNull(), F.col("d")), f"d{j}").alias(f"_cov{j}")
          for j in range(1, h)])
    var = reduce(lambda a, b: a + b, [F.col("_var")] + [2 * F.col(f"_cov{j}") for j in range(1, h)])
    enough = F.col("n_obs") >= min_obs
    stat = F.when(enough & (F.col("_long_var") > 0),
                  F.col("_mean") / F.sqrt(F.col("_long_var") / F.col("n_obs")))
    return (sums.withColumn("_long_var", var).withColumn("dm_stat", stat)
            .select(*keys, "n_obs", F.when(enough, F.col("_mean")).alias("mean_loss_diff"), "dm_stat",
                    two_sided_p(F.col("dm_stat")).alias("p_value")))


def _loss(actual: str, pred: str, power: float) -> Column:
    return F.pow(F.abs(error(actual, pred)), F.lit(float(power)))


def diebold_mariano(df: DataFrame, pred_1: str, pred_2: str, keys=("series",), power: float = 2.0, h: int = 1,
                    min_obs: int = 10, actual: str = "actual", ts: str = "week_end_date") -> DataFrame:
    """Equal-accuracy test of two forecasts; a positive mean favours the second.

    ``min_obs=0`` gives the unguarded variant.
    """
    known = finite(F.col(actual)) & finite(F.col(pred_1)) & finite(F.col(pred_2))
    rows = df.filter(known).withColumn("d", _loss(actual, pred_1, power) - _loss(actual, pred_2, power))
    return _loss_test(rows, list(keys), h, min_obs, ts)


def diebold_mariano_multi(df: DataFrame, pred_1: str, pred_2: str, keys=("system",), power: float = 2.0,
                          h: int = 1, min_obs: int = 0, actual: str = "actual",
                          ts: str = "week_end_date") -> DataFrame:
    """The same test on the loss averaged over the series of a system at each date."""
    both = _loss(actual, pred_1, power) - _loss(actual, pred_2, power)
    averaged = df.groupBy(*keys, ts).agg(F.avg(both).alias("d")).filter(F.col("d").isNotNull())
    return _loss_test(averaged, list(keys), h, min_obs, ts)


def pairwise_dm(fc: DataFrame, baselines, keys=("series", "horizon"), horizons=None,
                min_obs: int = 10, ts: str = "week_end_date") -> DataFrame:
    """Every model against each baseline, per key.

    The baseline forecasts are spread over the rows of their date by a window,
    so the forecast table is shuffled once and never joined to itself. Each
    horizon is tested with its own lag count; ``horizons`` (default: those of the table) limits them.
    """
    horizons = horizons or sorted(r[0] for r in fc.select("horizon").distinct().collect() if r[0] is not None)
    if not horizons:
        horizons = [1]
    w = Window.partitionBy(*keys, ts)
    spread = fc.select("*", *[F.max(F.when(F.col("model") == b, F.col("pred"))).over(w).alias(f"_base{i}")
                              for i, b in enumerate(baselines)])
    rows = spread.select(*keys, ts, "model", "actual", "pred", F.explode(F.array(*[
        F.struct(F.lit(b).alias("baseline"), F.col(f"_base{i}").alias("base_pred"))
        for i, b in enumerate(baselines)])).alias("b")).select("*", "b.*").drop("b")
    # Each baseline against a learner, and an earlier baseline against a later one, once.
    rank = F.create_map(*[F.lit(x) for i, b in enumerate(baselines) for x in (b, i)])
    rows = rows.filter(F.coalesce(rank[F.col("model")] > rank[F.col("baseline")], F.lit(True)))
    full = (*keys, "baseline", "model")

    def tested(part, lag):
        return diebold_mariano(part, "base_pred", "pred", full, h=lag, min_obs=min_obs, ts=ts)

    out = reduce(lambda a, b: a.unionByName(b),
                 [tested(rows.filter(F.col("horizon") == h), h) for h in horizons])
    return out.withColumn("comparison", F.concat_ws(" vs ", "baseline", "model"))


def flat_forecast_check(fc: DataFrame, keys=KEYS, tolerance: float = 1e-6) -> DataFrame:
    """Deviation of the forecasts and whether they are practically flat."""
    return (fc.groupBy(*keys).agg(F.stddev_samp("pred").alias("pred_std"))
            .withColumn("is_flat", F.col("pred_std") < tolerance))
