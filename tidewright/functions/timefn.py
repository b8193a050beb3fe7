"""Time functions of the warehouse. One zone, the session's, turns instants into dates; columns without a zone keep theirs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ZONE = "Asia/Shanghai"
DATE, DATE_TIME, PARTITION = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd"


def from_seconds(col: Column | str) -> Column:
    """Business change records count seconds."""
    return F.timestamp_seconds(F.col(col) if isinstance(col, str) else col)


def from_millis(col: Column | str) -> Column:
    """Application logs count milliseconds."""
    return F.timestamp_millis((F.col(col) if isinstance(col, str) else col).cast("long"))


def date_text(instant: Column | str) -> Column:
    return F.date_format(instant, DATE)


def date_time_text(instant: Column | str) -> Column:
    return F.date_format(instant, DATE_TIME)


def partition_text(instant: Column | str) -> Column:
    return F.date_format(instant, PARTITION)


def millis_of_text(text: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    """Epoch milliseconds of a date or date-time text that was written in `zone`."""
    local = F.coalesce(F.try_to_timestamp(text, F.lit(DATE_TIME)), F.try_to_timestamp(text, F.lit(DATE))).cast("timestamp_ntz")
    parts = (F.year(local), F.month(local), F.day(local), F.hour(local), F.minute(local), F.second(local).cast("decimal(16,6)"))
    return F.unix_millis(F.make_timestamp(*parts, F.lit(zone)))


def row_op_instant(text: Column | str) -> Column:
    """The instant of a row-operation time such as 2022-04-01 11:10:55.04Z, which compares as time, not as text."""
    return F.try_to_timestamp(text)


def today_partition() -> Column:
    """Today as the integer yyyyMMdd, the default of every dashboard query."""
    return F.date_format(F.current_date(), PARTITION).cast("int")


def epoch_seconds(local: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {local})")
