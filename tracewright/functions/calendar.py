"""Calendar features of a timestamp column, null for a null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hour_bin(ts: Column) -> Column:
    h = F.hour(ts)
    return (
        F.when(ts.isNull(), None).when(h.between(4, 7), "Early_Morning").when(h.between(8, 11), "Morning")
        .when(h.between(12, 15), "Afternoon").when(h.between(16, 19), "Late_Afternoon").otherwise("Night")
    )


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(ts.isNull(), None).when(m.isin(12, 1, 2), "Winter").when(m.between(3, 5), "Spring").when(m.between(6, 8), "Summer").otherwise("Fall")


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def week_of_month(ts: Column) -> Column:
    return (F.floor((F.dayofmonth(ts) - 1) / 7) + 1).cast("int")


def with_calendar(log: DataFrame, time: str = "Timestamp") -> DataFrame:
    """The six calendar columns, in their order."""
    ts = F.col(time)
    return log.withColumns({"hour_bin": hour_bin(ts), "day_of_week": day_of_week(ts), "is_weekend": is_weekend(ts), "week_of_month": week_of_month(ts), "season": season(ts), "month": F.month(ts)})
