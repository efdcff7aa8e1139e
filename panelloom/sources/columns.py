"""Column discovery on schema metadata: none of these read data, but for
``first_numeric_column``, which needs one aggregate pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted date column names.
DATE_NAMES = ("date", "observation_date", "week_end_date", "datetime", "time")


def normalize_name(name: str) -> str:
    """Lower case without spaces, underscores and hyphens."""
    return name.lower().translate(str.maketrans("", "", " _-"))


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


def pick_existing_column(columns, candidates) -> str | None:
    """First candidate present, ignoring case."""
    by_name = {c.lower(): c for c in reversed(list(columns))}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def find_date_column(df: DataFrame, candidates=DATE_NAMES, fallback: str = "first",
                     normalized: bool = False) -> str:
    """The date column by name; else by ``fallback``.

    ``first`` takes the first column; ``contains`` takes the first column with
    "date" in its name and fails where there is none.
    """
    key = normalize_name if normalized else str.lower
    names = {key(c): c for c in reversed(df.columns)}
    for candidate in candidates:
        if key(candidate) in names:
            return names[key(candidate)]
    if fallback == "first":
        return df.columns[0]
    hit = next((c for c in df.columns if "date" in key(c)), None)
    if hit is None:
        raise ValueError(f"no date column among {df.columns}")
    return hit


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def find_value_column(df: DataFrame, candidates, exclude=(), normalized: bool = False,
                      numeric_fallback: str | None = None) -> str | None:
    """Exact name, then equal names, then names containing a candidate.

    ``numeric_fallback`` adds a last step: ``only`` accepts the sole numeric
    column, ``first`` the first one; both fail where that step finds nothing.
    """
    columns = [c for c in df.columns if c not in exclude]
    key = normalize_name if normalized else str.lower
    rules = (
        lambda cand, col: cand == col,
        lambda cand, col: key(cand) == key(col),
        lambda cand, col: key(cand) in key(col),
    )
    for rule in rules:
        for candidate in candidates:
            hit = next((c for c in columns if rule(candidate, c)), None)
            if hit is not None:
                return hit
    if numeric_fallback is None:
        return None
    numeric = numeric_columns(df, exclude)
    if not numeric or (numeric_fallback == "only" and len(numeric) != 1):
        raise ValueError(f"no value column among {columns}")
    return numeric[0]


def claim_columns(df: DataFrame, wanted: dict[str, list[str]], exclude=()) -> dict[str, str]:
    """One column per target name; a column claimed once is not offered again."""
    taken, claimed = list(exclude), {}
    for target, candidates in wanted.items():
        column = find_value_column(df, candidates, exclude=taken)
        if column is None:
            raise ValueError(f"no column for {target} among {df.columns}")
        claimed[target] = column
        taken.append(column)
    return claimed


def first_numeric_column(df: DataFrame, exclude=()) -> str | None:
    """First column holding at least one value that reads as a number (one pass)."""
    columns = [c for c in df.columns if c not in exclude]
    counts = df.agg(*[F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(c)
                      for c in columns]).first()
    return next((c for c in columns if counts[c] > 0), None)


def wide_to_panel(df: DataFrame, date_column: str, columns: dict[str, str]) -> DataFrame:
    """Stack ``{series name: column}`` of a wide frame into ``(series, ts, value)``."""
    renamed = df.select(
        F.to_date(F.col(f"`{date_column}`")).alias("ts"),
        *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(name) for name, c in columns.items()],
    )
    return renamed.unpivot(["ts"], list(columns), "series", "value").select("series", "ts", "value")
