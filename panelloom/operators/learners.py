"""Direct learners on the weekly feature frame.

Keys are ``(series, horizon)``. The elastic net reads moment matrices only;
tree ensembles are Spark ML estimators, trained over distributed rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .moments import DOUBLES, unpack

KEYS = ("series", "horizon")
FOLDS = 5
# The searched penalties.
L1_RATIOS = (0.1, 0.5, 0.9)
ALPHAS = tuple(float(a) for a in np.logspace(-4, 1, 30))


def time_folds(train: DataFrame, keys=KEYS, ts: str = "week_end_date", folds: int = FOLDS) -> DataFrame:
    """Consecutive blocks 0..folds; block k validates a fit on all blocks before it."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(ts))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    size = F.floor(n / (folds + 1))
    first = n - folds * size
    return train.withColumn("_block", F.when(rn <= first, 0).otherwise(F.floor((rn - 1 - first) / size) + 1).cast("int"))


def block_moments(blocks: DataFrame, features, target: str = "target", keys=KEYS) -> DataFrame:
    """Moments of ``[1, features, target]`` per key and block.

    A block is a fraction of one series' weeks, so its cross product is taken
    by one matrix product in the task that holds it.
    """
    fields = [f for f in blocks.select(*keys).schema.fields]
    schema = T.StructType([*fields, T.StructField("_block", T.IntegerType()), T.StructField("m", DOUBLES)])
    names = list(keys)

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy()])
        full = x.T @ x
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in names], pdf["_block"].iloc[0],
                              full[np.triu_indices(len(full))].tolist()]], columns=[*names, "_block", "m"])

    rows = blocks.select(*keys, "_block", F.array(*[F.col(c) for c in features]).alias("_x"), F.col(target).alias("_y"))
    return rows.groupBy(*keys, "_block").applyInPandas(cross, schema)


def centred(full: np.ndarray, scale: np.ndarray):
    """Covariances of scaled features with themselves and the target; means."""
    n = full[0, 0]
    mean = full[0, 1:] / n
    cov = full[1:, 1:] / n - np.outer(mean, mean)
    return cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale, mean


def penalised_paths(gram: np.ndarray, cross: np.ndarray, l1: float, alphas, rounds: int = 3000) -> np.ndarray:
    """Elastic-net coefficients of all penalties at once by accelerated proximal steps."""
    alphas = np.asarray(alphas)
    step = 1.0 / (np.linalg.eigvalsh(gram)[-1] + alphas * (1 - l1) + 1e-12)
    w = np.zeros((len(cross), len(alphas)))
    ahead, momentum = w.copy(), 1.0
    for _ in range(rounds):
        gradient = gram @ ahead - cross[:, None] + ahead * (alphas * (1 - l1))
        moved = ahead - step * gradient
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * alphas * l1, 0.0)
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        if np.max(np.abs(new - w)) < 1e-7 * max(1.0, np.max(np.abs(new))):
            return new
        w, momentum = new, following
    return w


CHOICE = T.StructType([T.StructField("mse", T.DoubleType()), T.StructField("alpha", T.DoubleType()),
                       T.StructField("const", T.DoubleType()), T.StructField("coef", DOUBLES)])


@F.pandas_udf(CHOICE)
def _search(blocks: pd.Series, l1: pd.Series) -> pd.DataFrame:
    """Best penalty at one l1 ratio by time-ordered folds, refitted on all blocks."""
    out = []
    for packed, ratio in zip(blocks, l1):
        parts = [unpack(np.asarray(b, dtype=float)) for b in packed]
        total = sum(parts)
        n = total[0, 0]
        mean = total[0, 1:-1] / n
        scale = np.sqrt(np.maximum(np.diag(total)[1:-1] / n - mean ** 2, 0.0))
        scale[scale <= 1e-9 * (1 + np.abs(mean))] = 1.0
        losses = []
        for k in range(1, len(parts)):
            gram, cross, centre = centred(sum(parts[:k]), scale)
            w = penalised_paths(gram, cross, ratio, ALPHAS) / scale[:, None]
            # Squared errors of the validation block, from its own moments.
            constant = centre[-1] - centre[:-1] @ w
            full = np.vstack([constant, w, -np.ones(w.shape[1])])
            losses.append(np.einsum("ia,ij,ja->a", full, parts[k], full) / parts[k][0, 0])
        mse = np.mean(losses, axis=0)
        best = int(np.argmin(mse))
        gram, cross, centre = centred(total, scale)
        w = penalised_paths(gram, cross, ratio, [ALPHAS[best]])[:, 0] / scale
        out.append((float(mse[best]), ALPHAS[best], float(centre[-1] - centre[:-1] @ w), w.tolist()))
    return pd.DataFrame(out, columns=["mse", "alpha", "const", "coef"])


_search = _search.asNondeterministic()


def elastic_net_cv(train: DataFrame, features, keys=KEYS, target: str = "target", ts: str = "week_end_date") -> DataFrame:
    """Penalty and mixing ratio per key by cross-validation; coefficients in feature units."""
    moments = block_moments(time_folds(train, keys, ts), features, target, keys)
    packed = moments.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_block", "m"))),
                                                    lambda b: b["m"]).alias("_blocks"))
    tried = (packed.withColumn("l1_ratio", F.explode(F.array(*[F.lit(r) for r in L1_RATIOS])))
             .repartition(*keys, "l1_ratio").withColumn("_f", _search("_blocks", "l1_ratio")))
    best = F.min_by(F.struct("l1_ratio", "_f.alpha", "_f.mse", "_f.const", "_f.coef"), F.struct("_f.mse", "l1_ratio"))
    return tried.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def linear_forecast(rows: DataFrame, fit: DataFrame, features, keys=KEYS) -> DataFrame:
    x = F.array(*[F.col(c) for c in features])
    value = F.aggregate(F.zip_with(x, F.col("coef"), lambda a, b: a * b), F.col("const"), lambda s, v: s + v)
    joined = rows.join(fit.select(*keys, "const", "coef"), list(keys), "left")
    return joined.withColumn("pred", value).drop("const", "coef")


class LinearModel:
    """Coefficients per key, asked like a pooled model: ``transform`` adds ``pred`` to rows with a ``features`` vector.

    The first entries of the vector are the features that were fitted; those after them tell keys apart and are not
    read. Rows of a key without a fit get a null.
    """

    def __init__(self, fit: DataFrame, keys=KEYS):
        self.fit, self.keys = fit.select(*keys, F.col("const").alias("_const"), F.col("coef").alias("_coef")), list(keys)

    def transform(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        x = F.slice(vector_to_array("features"), F.lit(1), F.size("_coef"))
        value = F.aggregate(F.zip_with(x, F.col("_coef"), lambda a, b: a * b), F.col("_const"), lambda s, v: s + v)
        return rows.join(self.fit, self.keys, "left").withColumn("pred", value).drop("_const", "_coef")


def random_forest(trees: int = 300, depth: int = 4, leaf: int = 10, seed: int = 42):
    # Every split sees all features, as the compared library does by default.
    return RandomForestRegressor(featuresCol="features", labelCol="target", predictionCol="pred", numTrees=trees,
                                 maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all", seed=seed)


def gradient_boosting(rounds: int = 250, rate: float = 0.03, depth: int = 2, leaf: int = 10, subsample: float = 1.0,
                      seed: int = 42):
    return GBTRegressor(featuresCol="features", labelCol="target", predictionCol="pred", maxIter=rounds, stepSize=rate,
                        maxDepth=depth, minInstancesPerNode=leaf, subsamplingRate=subsample, seed=seed)


def assemble(rows: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def pooled_rows(rows: DataFrame, features, keys=KEYS) -> DataFrame:
    """Rows of all keys with one vector ``features``: the given columns, then what tells the keys apart.

    A key is described by numbers that hold for any number of keys: mean and deviation of its training target, and
    its numeric parts (the horizon). One model then serves all keys.
    """
    train = F.when(F.col("split") == "train", F.col("target"))
    stats = rows.groupBy(*keys).agg(F.coalesce(F.avg(train), F.lit(0.0)).alias("_key_mean"),
                                    F.coalesce(F.stddev_samp(train), F.lit(0.0)).alias("_key_std"))
    numeric = [k for k in keys if dict(rows.dtypes)[k] in ("int", "bigint", "double")]
    described = rows.join(stats, list(keys)).select("*", *[F.col(k).cast("double").alias(f"_key_{k}") for k in numeric])
    return assemble(described, [*features, "_key_mean", "_key_std", *[f"_key_{k}" for k in numeric]])


def fit_pooled(rows: DataFrame, estimator):
    """One distributed fit over the training rows of all keys."""
    return estimator.fit(rows.filter(F.col("split") == "train"))


def permutation_importance(models: dict, test: DataFrame, features, keys=KEYS, repeats: int = 8, seed: int = 42,
                           ts: str = "week_end_date") -> DataFrame:
    """Mean and deviation of the rise in squared error when one feature is shuffled inside a key.

    ``test`` names the model to ask in ``model``. In each repeat a row takes the values of the row that follows it in a
    random order of its key, so every value is used exactly once; that pairing is the only shuffle. Features
    are then swapped one by one where the pair is, and the errors summed before they are sent on.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    part = [*keys, "repeat"]
    w = Window.partitionBy(*part).orderBy(F.xxhash64(F.lit(seed), "repeat", ts), ts)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = test.select(*keys, ts, "model", "target", vector_to_array("features").alias("_x"))
    drawn = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    paired = drawn.withColumn("_z", F.coalesce(F.lead("_x").over(w), F.first("_x").over(whole)))
    # Feature 0 swaps nothing: its error is the base that the others are held against.
    swapped = paired.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = F.transform("_x", lambda v, i: F.when(i + 1 == F.col("feature"), F.element_at("_z", i + 1)).otherwise(v))
    ready = swapped.select(*keys, "model", "repeat", "feature", "target", array_to_vector(mixed).alias("features"))
    squared = F.pow(F.col("target") - F.col("pred"), F.lit(2.0))
    scored = reduce(lambda a, b: a.unionByName(b), [m.transform(ready.filter(F.col("model") == n)).select(*part, "feature", "model", squared.alias("_se")) for n, m in models.items()])
    mse = scored.groupBy(*part, "model", "feature").agg(F.avg("_se").alias("_mse"))
    base = F.max(F.when(F.col("feature") == 0, F.col("_mse"))).over(Window.partitionBy(*part))
    names = F.array(*[F.lit(f) for f in features])
    return (mse.withColumn("_rise", F.col("_mse") - base).filter("feature > 0").groupBy(*keys, "model", "feature")
            .agg(F.avg("_rise").alias("importance"), F.stddev_pop("_rise").alias("importance_std"))
            .select(*keys, "model", F.element_at(names, F.col("feature")).alias("feature"), "importance", "importance_std"))
