"""Column functions that the operators share. None of them ever gives NaN: what is undefined is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_div(x: Column, y: Column) -> Column:
    """x / y, null where y is zero or null (F-8)."""
    return x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0))


def blank_to_null(x: Column) -> Column:
    """Null for blank or white-space text (F-6)."""
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def month_index(d: Column) -> Column:
    """Calendar month as year * 12 + month, so that neighbours differ by one."""
    return F.year(d) * 12 + F.month(d)


def over(*keys: str, by: str | list | None = None, rows: tuple[int, int] | None = None):
    """A window by keys, ordered and framed where asked."""
    w = Window.partitionBy(*keys)
    if by is not None:
        w = w.orderBy(*([by] if isinstance(by, str) else by))
    return w.rowsBetween(*rows) if rows else w


def at_least(x: Column, n: int, w, counted: Column) -> Column:
    """``x`` where the frame of ``w`` holds n values of ``counted`` at least (min_periods)."""
    return F.when(F.count(counted).over(w) >= n, x)


def percent_rank_average(x: Column, *keys: str) -> Column:
    """Rank with average ties as a share of the values that are not null (W-9)."""
    rank = F.rank().over(over(*keys, by=[x.asc_nulls_last()]))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*keys)))


def require_columns(df: DataFrame, *names: str) -> None:
    """Raises before anything runs if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
