"""Tumbling event-time windows: group, measure, stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import date_text, date_time_text

LENGTH = "10 seconds"


def tumbling(rows: DataFrame, event_time: str, keys: list[str], measures: list[Column], length: str = LENGTH, delay: str | None = None) -> DataFrame:
    """stt, edt, cur_date, the keys and the measures of each window and key, in batch and in streams.

    delay: the watermark's, for streams; late rows are dropped. Partial aggregation in the tasks that hold the rows keeps
    windows without keys parallel."""
    source = rows.withWatermark(event_time, delay) if delay is not None else rows
    out = source.groupBy(F.window(event_time, length).alias("_w"), *keys).agg(*measures)
    own = [c for c in out.columns if c != "_w"]
    return out.select(date_time_text("_w.start").alias("stt"), date_time_text("_w.end").alias("edt"), date_text("_w.start").alias("cur_date"), *own)


def total(col: str, name: str | None = None, kind: str = "long") -> Column:
    return F.coalesce(F.sum(F.col(col).cast(kind)), F.lit(0).cast(kind)).alias(name or col)
