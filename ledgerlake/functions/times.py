"""Event-time parsing and calendar parts.  All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Text formats of the sale event and of its day label.
EVENT_TIME_FORMAT = "dd/MM/yyyy HH:mm:ss"
DAY_LABEL_FORMAT = "ddMMyyyy"
HOUR_TEXT_FORMAT = "yyyy-MM-dd HH"


def parse_event_time(text: Column) -> Column:
    """Event text to timestamp.  Unreadable text gives NULL instead of failing the job."""
    return F.try_to_timestamp(text, F.lit(EVENT_TIME_FORMAT))


def with_event_parts(df: DataFrame, column: str = "event_date") -> DataFrame:
    """Add the day label and the day, hour, minute, month, second and year of ``column``."""
    at = F.col(column)
    return df.withColumns(
        {
            "partition_date": F.date_format(at, DAY_LABEL_FORMAT),
            "event_day": F.dayofmonth(at),
            "event_hour": F.hour(at),
            "event_minute": F.minute(at),
            "event_month": F.month(at),
            "event_second": F.second(at),
            "event_year": F.year(at),
        }
    )


def hour_start(date: Column, hour: Column) -> Column:
    """Wall-clock start of an hour, without formatting and parsing text per row."""
    zero = F.lit(0)
    return F.try_make_timestamp(
        F.year(date), F.month(date), F.dayofmonth(date), hour.cast("int"), zero, zero
    )


def hour_text(date: Column, hour: Column) -> Column:
    """``yyyy-MM-dd HH`` label of an hour."""
    return F.concat(date.cast("string"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"))


def parse_hour_text(text: Column) -> Column:
    """Inverse of :func:`hour_text`."""
    return F.try_to_timestamp(text, F.lit(HOUR_TEXT_FORMAT))
