"""Base report: weekly changes, benchmark and autoregressions, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arma as A
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import volatility as V
from ..operators.joins import lookup_metrics
from ..session import durable
from . import panels as P

WEEK = "week_end_date"


def baseline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No change against a first-order autoregression on the test weeks of each segment."""
    model = P.segment_model(spark, sf_dir)
    params = M.ar1_fit(model.filter(F.col("split") == "train"), "diff")
    columns = ["series", "week_end_date", "split", "actual", "pred", "model"]
    zero = M.zero_change_forecast(model, "diff").withColumn("model", F.lit("Random Walk")).select(columns)
    ar1 = M.ar1_forecast(model, params, "diff").withColumn("model", F.lit("AR(1)")).select(columns)
    test = zero.unionByName(ar1).filter(F.col("split") == "test").withColumn("horizon", F.lit(1))
    return M.model_comparison(test, 2)


def forecast_table(model: DataFrame) -> DataFrame:
    """Static and rolling forecasts of no change, the selected ARMA and the ARMA with volatility.

    The two ARMA entries share point forecasts; the second adds sigma.
    """
    train = F.col("split") == "train"
    params = durable(A.arma_select(A.arma_candidates(model, "diff", train)))
    filtered = durable(A.arma_filter(model, params, "diff", carry=("split",)))
    gjr = durable(V.volatility_fit(filtered.filter(train), "resid", "gjr"))
    vol = V.variance_recursion(filtered, gjr, "resid", carry=("split",))
    rolling = (filtered.join(vol.select("series", WEEK, "sigma"), ["series", WEEK]).filter(F.col("split") == "test")
               .select("series", WEEK, "actual", "pred", "sigma").withColumn("method", F.lit("Rolling 1-step")))
    static = A.arma_static_path(model, params, "diff")
    last = (vol.filter(train).groupBy("series")
            .agg(F.max_by("resid", F.when(F.col("resid").isNotNull(), F.col(WEEK))).alias("_e"),
                 F.max_by("h", F.when(F.col("resid").isNotNull(), F.col(WEEK))).alias("_h")))
    first = V.next_variance(F.col("_e"), F.col("_h"), *[F.col(c) for c in ("omega", "alpha", "gamma", "beta")])
    sizes = static.groupBy("series").agg(F.max("step").alias("_n"))
    state = last.join(gjr, "series").join(sizes, "series").withColumn("h1", first)
    sigma = V.variance_path(state, F.col("_n")).select("series", "step", "sigma")
    static = (static.join(sigma, ["series", "step"], "left").withColumn("method", F.lit("Static OOS"))
              .select("series", WEEK, "actual", "pred", "sigma", "method"))
    both = static.unionByName(rolling)
    named = F.array(
        F.struct(F.lit("Random Walk").alias("model"), F.lit(0.0).alias("p"), F.lit(None).cast("double").alias("s")),
        F.struct(F.lit("Selected ARMA").alias("model"), F.col("pred").alias("p"), F.lit(None).cast("double").alias("s")),
        F.struct(F.lit("Selected ARMA-GJR-GARCH(1,1)").alias("model"), F.col("pred").alias("p"), F.col("sigma").alias("s")))
    return (both.withColumn("_m", F.explode(named))
            .select("method", "series", WEEK, "_m.model", "actual", F.col("_m.p").alias("pred"), F.col("_m.s").alias("sigma")))


def full_report(model: DataFrame) -> DataFrame:
    """One row per method, series and model: accuracy, direction, coverage and the test against no change."""
    fc = durable(forecast_table(model))
    keys = ("method", "series", "model")
    tests = (E.pairwise_dm(fc.withColumn("horizon", F.lit(1)), ["Random Walk"], ("method", "series", "horizon"), (1,))
             .select(*keys, "n_obs", "mean_loss_diff", "dm_stat", "p_value"))
    table = E.forecast_metrics(fc.filter(F.col("pred").isNotNull()), keys)
    extra = (E.directional_accuracy(fc, keys), E.interval_coverage(fc, keys), tests)
    ranked = E.improvement_vs_baseline(table, group=("method", "series"))
    return lookup_metrics(ranked, *extra, on=keys)
