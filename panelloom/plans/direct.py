"""Direct comparison: benchmarks and learners on the same origins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arma as A
from ..operators import learners as L
from ..operators.cleaning import relabel


def direct_forecasts(rows: DataFrame, features, model: DataFrame, names: dict[str, str], order=(1, 2),
                     horizons=(1, 4)) -> DataFrame:
    """Long forecast table of no change, a recursive ARMA and the elastic net.

    ``rows`` are the purged direct rows of every (series, horizon); ``model``
    holds the weekly changes of the same series, whose long names ``names`` maps.
    """
    columns = ["series", "horizon", "week_end_date", "model", "actual", "pred"]
    test = rows.filter(F.col("split") == "test")
    zero = test.select("series", "horizon", "week_end_date", F.lit("Random Walk").alias("model"),
                       F.col("target").alias("actual"), F.lit(0.0).alias("pred"))
    fit = L.elastic_net_cv(rows.filter(F.col("split") == "train"), features)
    net = L.linear_forecast(test, fit, features).select(
        "series", "horizon", "week_end_date", F.lit("Elastic Net").alias("model"), F.col("target").alias("actual"), "pred")
    train = F.col("split") == "train"
    params = A.arma_select(A.arma_candidates(model, "diff", train, orders=[order]))
    recursive = relabel(A.arma_horizon_recursive(model, params, "diff", horizons), "series", names)
    arma = (zero.select("series", "horizon", "week_end_date", "actual")
            .join(recursive.select("series", "horizon", "week_end_date", "pred"), ["series", "horizon", "week_end_date"], "left")
            .withColumn("model", F.lit(f"ARMA{order}")))
    return reduce(lambda a, b: a.unionByName(b), [t.select(columns) for t in (zero, arma, net)])
