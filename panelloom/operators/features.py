"""Model frames: spreads between series and the wide feature tables.

Wide frames carry a ``frame`` key, so many independent systems can be built in
one job; their ordered windows run per frame, never over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import corr_block, describe

WEEK = "week_end_date"


def spread_gaps(panel: DataFrame, pairs, value: str = "level", ts: str = WEEK, keys=()) -> DataFrame:
    """Level differences of named series pairs and their first difference.

    A row is sent to the gaps its series takes part in with a sign; summing per
    gap and date replaces the self-join.
    """
    names = sorted({s for pair in pairs for s in pair})
    roles = {n: [(f"{a}-{b}", 1.0 if n == a else -1.0) for a, b in pairs if n in (a, b)] for n in names}
    role_map = F.create_map(*[x for n in names for x in (F.lit(n), F.array(*[
        F.struct(F.lit(g).alias("gap"), F.lit(s).alias("sign")) for g, s in roles[n]]))])
    sides = (panel.filter(F.col("series").isin(names))
             .select(*keys, ts, F.col(value).alias("_v"), F.explode(role_map[F.col("series")]).alias("r")))
    gaps = (sides.groupBy(*keys, F.col("r.gap").alias("gap"), ts)
            .agg(F.sum(F.col("r.sign") * F.col("_v")).alias("gap_level"), F.count("_v").alias("_n"))
            .filter(F.col("_n") == 2).drop("_n"))
    w = Window.partitionBy(*keys, "gap").orderBy(ts)
    return gaps.withColumn("gap_diff", F.col("gap_level") - F.lag("gap_level").over(w))


def _lag_columns(columns, lags, w) -> list[Column]:
    return [F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in columns for k in lags]


def direct_features(wide: DataFrame, credit, gaps, price: str, fear: str, long_rate: str, short_rate: str,
                    keys=("frame",), ts: str = WEEK, level_lags: int = 4, diff_lags: int = 8,
                    windows=(4, 13, 26), z: int = 26, macro_lags: int = 4) -> DataFrame:
    """Full weekly feature frame of the direct forecasters.

    ``wide`` has one level column per name in ``credit`` and one per market
    role: a price (log return), a fear index and two rates (changes, slope).
    Current values are kept next to their lags.
    """
    w = Window.partitionBy(*keys).orderBy(ts)

    def step(c):
        return F.col(c) - F.lag(c).over(w)

    base = wide.na.drop(how="all", subset=[*credit, price, fear, long_rate, short_rate])
    with_levels = base.select("*", (F.col(long_rate) - F.col(short_rate)).alias("slope"),
                              *[(F.col(a) - F.col(b)).alias(f"{a}_{b}_gap") for a, b in gaps])
    gap_names = [f"{a}_{b}_gap" for a, b in gaps]
    changed = with_levels.select(
        "*", *[step(s).alias(f"{s}_diff") for s in credit], *[step(g).alias(f"{g}_diff") for g in gap_names],
        (F.log(price) - F.lag(F.log(price)).over(w)).alias(f"{price}_ret"),
        *[step(c).alias(f"{c}_change") for c in (fear, long_rate, short_rate, "slope")])

    def trailing(value, column, n):
        frame = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(column).over(frame) == n, value(frame))

    rolled = []
    for s in credit:
        d = f"{s}_diff"
        for n in windows:
            rolled += [
                trailing(lambda f, d=d: F.avg(d).over(f), d, n).alias(f"{d}_mean_{n}"),
                trailing(lambda f, d=d: F.stddev_samp(d).over(f), d, n).alias(f"{d}_vol_{n}"),
                trailing(lambda f, s=s: F.avg(s).over(f), s, n).alias(f"{s}_mean_{n}")]
        rolled.append(trailing(
            lambda f, s=s: (F.col(s) - F.avg(s).over(f)) / F.nullif(F.stddev_samp(s).over(f), F.lit(0.0)),
            s, z).alias(f"{s}_z_{z}"))
    macro = [f"{price}_ret", fear, f"{fear}_change", long_rate, short_rate, f"{long_rate}_change",
             f"{short_rate}_change", "slope", "slope_change"]
    return changed.select(
        "*", *_lag_columns(credit, range(1, level_lags + 1), w),
        *_lag_columns([f"{s}_diff" for s in credit], range(1, diff_lags + 1), w),
        *rolled, *_lag_columns(macro, range(1, macro_lags + 1), w))


def arx_dataset(credit: DataFrame, macro: DataFrame, names, gaps, macro_columns, term=None,
                keys=("frame",), ts: str = WEEK) -> DataFrame:
    """Credit levels, changes and gaps with market columns, each lagged once; complete cases.

    Credit series are kept on common weeks, market columns are attached to
    them; market columns that do not exist are left out. ``term`` is an
    optional pair of rates whose spread and its change are added.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    common = credit.na.drop(how="any", subset=list(names))
    present = [c for c in macro_columns if c in macro.columns]
    joined = common.select(*keys, ts, *names).join(macro.select(*keys, ts, *present), [*keys, ts], "left")
    gap_names = [f"{a}_{b}_gap" for a, b in gaps]
    levels = joined.select("*", *[(F.col(a) - F.col(b)).alias(f"{a}_{b}_gap") for a, b in gaps])
    term_columns = []
    if term and set(term) <= set(present):
        levels = levels.withColumn("term_spread", F.col(term[0]) - F.col(term[1]))
        term_columns = ["term_spread"]
    stepped = [*names, *gap_names, *term_columns]
    changed = levels.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_diff") for c in stepped])
    regressors = [*[c for n in names for c in (f"{n}_diff", n)], *gap_names, *[f"{g}_diff" for g in gap_names],
                  *present, *term_columns, *[f"{t}_diff" for t in term_columns]]
    lagged = changed.select(*keys, ts, *[f"{n}_diff" for n in names], *_lag_columns(regressors, (1,), w))
    return lagged.na.drop(how="any")


def macro_block(wide: DataFrame, targets, macro_columns, keys=()) -> tuple[DataFrame, DataFrame]:
    """Market columns that exist: their description and their correlation with the targets, per key."""
    present = [c for c in macro_columns if c in wide.columns]
    return describe(wide, present, keys), corr_block(wide, targets, present, keys)
