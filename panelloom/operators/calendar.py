"""Dense daily calendars, time interpolation and Friday-anchored weeks.

Inputs are unique per ``(series, ts)``, so a window partition holds at most one
row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import auto_unit_scale
from .windows import add_lags, diff


def week_ending(date: str | Column) -> Column:
    """The Friday closing the Saturday-to-Friday week of a date."""
    return F.next_day(F.date_sub(date, 1), "FRI")


def _whole_series():
    """The whole series in date order: shares its sort with the running windows."""
    return Window.partitionBy("series").orderBy("ts").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)


def _extent(panel: DataFrame, extent: str) -> tuple[Column, Column]:
    """First and last date of the grid: of the series, or of the whole panel."""
    if extent == "own":
        w = _whole_series()
        return F.min("ts").over(w), F.max("ts").over(w)
    if extent == "shared":
        return panel.agg(F.min("ts")).scalar(), panel.agg(F.max("ts")).scalar()
    raise ValueError("extent is 'own' or 'shared'")


def _gap_rows(panel: DataFrame, extent: str) -> DataFrame:
    """Each known point with the next one and the days ``[start, stop]`` it stands for.

    Grid and interpolation need no calendar join: a known point owns the days
    up to the next one, the first also those before it, the last those after.
    """
    lo, hi = _extent(panel, extent)
    whole = _whole_series()
    ordered = Window.partitionBy("series").orderBy("ts")
    marked = (panel.withColumn("_lo", lo).withColumn("_hi", hi)
              .withColumn("_known", F.count("value").over(whole))
              .withColumn("_row", F.row_number().over(ordered)))
    # An all-null series keeps one row, so that its grid survives as nulls.
    kept = marked.filter(F.col("value").isNotNull() | ((F.col("_known") == 0) & (F.col("_row") == 1)))
    return (kept
            .withColumn("_next", F.lead("ts").over(ordered))
            .withColumn("_next_value", F.lead("value").over(ordered))
            .withColumn("_first", F.lag("ts").over(ordered).isNull())
            .withColumn("_start", F.when(F.col("_first"), F.col("_lo")).otherwise(F.col("ts")))
            .withColumn("_stop", F.coalesce(F.date_sub("_next", 1), F.col("_hi"))))


def _spread(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn("_day", F.explode(F.sequence("_start", "_stop")))


def densify_daily(panel: DataFrame, extent: str = "own") -> DataFrame:
    """One row per calendar day; days without an observation hold null."""
    return (_spread(_gap_rows(panel, extent))
            .select("series", F.col("_day").alias("ts"),
                    F.when(F.col("_day") == F.col("ts"), F.col("value")).alias("value")))


def interpolate_time(panel: DataFrame, extent: str = "own") -> DataFrame:
    """Dense daily series, linear in time between known points, flat at the edges."""
    elapsed = F.datediff("_day", "ts")
    moved = F.col("value") + (F.col("_next_value") - F.col("value")) * elapsed / F.datediff("_next", "ts")
    inside = (elapsed > 0) & F.col("_next").isNotNull()
    return (_spread(_gap_rows(panel, extent))
            .select("series", F.col("_day").alias("ts"),
                    F.when(inside, moved).otherwise(F.col("value")).alias("value")))


def resample_week(dense: DataFrame, how: str = "mean") -> DataFrame:
    """Friday-labelled weeks of a dense daily panel by ``mean`` or ``last`` known value."""
    grouped = dense.groupBy("series", week_ending("ts").alias("week_end_date"))
    if how == "mean":
        return grouped.agg(F.avg("value").alias("level"))
    if how == "last":
        return grouped.agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))).alias("level"))
    raise ValueError("how is 'mean' or 'last'")


def resample_week_last_ffill(panel: DataFrame) -> DataFrame:
    """Already weekly input: last known value per week, empty weeks carried forward."""
    weekly = (panel.groupBy("series", week_ending("ts").alias("week_end_date"))
              .agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))).alias("level")))
    w = Window.partitionBy("series").orderBy("week_end_date")
    filled = (weekly.withColumn("level", F.last("level", ignorenulls=True).over(w))
              .withColumn("_next", F.lead("week_end_date").over(w)))
    weeks = F.sequence("week_end_date", F.coalesce(F.date_sub("_next", 7), F.col("week_end_date")),
                       F.expr("interval 7 days"))
    return filled.select("series", F.explode(weeks).alias("week_end_date"), "level")


# R6: how each kind of series is reduced to weeks.
WEEKLY_KINDS = ("oas_pct", "rate_pct", "price", "level", "weekly_level")


def weekly_by_kind(panel: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Weekly level, displayed value and change of series of mixed kinds in one job.

    ``oas_pct`` shows basis points and their difference, ``rate_pct`` the rate
    and its difference in basis points, ``price`` the percent return twice,
    ``level`` and ``weekly_level`` the level and its difference.
    """
    unknown = sorted(set(kinds.values()) - set(WEEKLY_KINDS))
    if unknown:
        raise ValueError(f"unknown kind {unknown}; expected one of {WEEKLY_KINDS}")
    names = {k: [s for s, kind in kinds.items() if kind == k] for k in WEEKLY_KINDS}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("series")]
    known = panel.filter(F.col("series").isin(list(kinds)))
    already_weekly = F.col("series").isin(names["weekly_level"])
    dense = interpolate_time(known.filter(~already_weekly))
    reduced = (dense.groupBy("series", week_ending("ts").alias("week_end_date"))
               .agg(F.avg("value").alias("mean"), F.max_by("value", "ts").alias("last"))
               .select("series", "week_end_date",
                       F.when(F.col("series").isin(names["price"]), F.col("last"))
                       .otherwise(F.col("mean")).alias("level")))
    weekly = reduced.unionByName(resample_week_last_ffill(known.filter(already_weekly)))
    before = F.lag("level").over(Window.partitionBy("series").orderBy("week_end_date"))
    k = F.col("kind")
    step = F.col("level") - before
    change = (F.when(k == "oas_pct", F.col("level") * 100 - before * 100)
              .when(k == "rate_pct", step * 100)
              .when(k == "price", (F.col("level") / before - 1) * 100)
              .otherwise(step))
    shown = (F.when(k == "oas_pct", F.col("level") * 100)
             .when(k == "price", change).otherwise(F.col("level")))
    return (weekly.withColumn("kind", kind)
            .select("series", "kind", "week_end_date", "level", shown.alias("value"),
                    change.alias("change")))


def weekly_panel(panel: DataFrame, extent: str = "own", how: str = "mean",
                 unit_rule: str = "abs_above", lags: int = 4) -> DataFrame:
    """Daily panel to weekly levels, basis points, changes and lags of both.

    Everything after the daily reduction is keyed by ``series``, so the plan
    has a single exchange for the calendar, the weeks and all ordered windows.
    """
    weekly = resample_week(interpolate_time(panel, extent), how)
    scaled = auto_unit_scale(weekly, "level", "level_bp", unit_rule)
    changed = diff(scaled, "level_bp", "diff")
    return add_lags(changed, ["level_bp", "diff"], range(1, lags + 1))


def regular_grid_check(weekly: DataFrame, ts: str = "week_end_date") -> DataFrame:
    """Weeks whose distance to the previous row is not seven days."""
    before = F.lag(ts).over(Window.partitionBy("series").orderBy(ts))
    return (weekly.withColumn("gap_days", F.datediff(ts, before))
            .filter(F.col("gap_days") != 7).select("series", ts, "gap_days"))
