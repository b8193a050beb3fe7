"""Joins of the detail layer, for batch and for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import from_millis, from_seconds


NAMES = ["id", "order_id", "user_id", "course_id", "province_id", "date_id", "session_id", "source_id", "create_time", "origin_amount", "coupon_reduce_amount", "final_amount", "out_trade_no", "trade_body", "ts"]


def _near(a: str, b: str, hold: str) -> Column:
    return F.expr(f"{b} BETWEEN {a} - INTERVAL {hold} AND {a} + INTERVAL {hold}")


def _with_orders(detail: DataFrame, info: DataFrame, streaming: bool, hold: str) -> DataFrame:
    on = F.col("order_id") == F.col("_order")
    if streaming:
        detail = detail.withColumn("et", from_seconds("ts")).withWatermark("et", "0 seconds")
        info = info.withColumn("info_et", from_seconds("info_ts")).withWatermark("info_et", "0 seconds")
        on &= _near("et", "info_et", hold)
    return detail.join(info.withColumnRenamed("id", "_order"), on).drop("_order")


def _with_visits(both: DataFrame, visits: DataFrame, streaming: bool, hold: str, how: str) -> DataFrame:
    on = F.col("session_id") == F.col("_session")
    return both.join(visits.withColumnRenamed("session_id", "_session"), on & _near("et", "page_et", hold) if streaming else on, how)


def _seen(visits: DataFrame) -> DataFrame:
    return visits.withColumn("page_et", from_millis("page_ts")).withWatermark("page_et", "0 seconds")


def order_details(detail: DataFrame, info: DataFrame, visits: DataFrame, streaming: bool = False, hold: str = "10 seconds") -> DataFrame:
    """Details of orders with their order, and the source of the session if its visit to the order page is known.

    In batch the visits go to the orders, which are fewer, so that details are shuffled once, by their order. In a stream all sides are held for `hold`: pairs further apart in event time aren't joined, and a detail without a
    visit comes out, once, when the watermark has passed it; order_detail_changes gives it at once, and corrects it."""
    if streaming:
        out = _with_visits(_with_orders(detail, info, True, hold), _seen(visits), True, hold, "left")
    else:
        out = _with_orders(detail, _with_visits(info, visits, False, hold, "left"), False, hold)
    return out.select(*NAMES, F.current_timestamp().alias("row_op_ts"), *(["et"] if streaming else []))


def order_detail_changes(detail: DataFrame, info: DataFrame, visits: DataFrame, hold: str = "10 seconds") -> DataFrame:
    """The left outer join of order_details in a stream as changes: a detail with its order comes out at once, without a
    source (_sign 1); when its visit is met, that row is taken back (-1) and the one with the source follows (1). Sums of
    _sign over equal rows are the join's rows; an upsert sink with richer="source_id" takes the rows of sign 1 alone."""
    both = _with_orders(detail, info, True, hold)
    seen = _seen(visits)
    # a session's first visit takes the early row back; all its visits give rows
    first = seen.dropDuplicatesWithinWatermark(["session_id"])
    none = F.lit(None).cast("string").alias("source_id")
    early = lambda rows, sign: rows.select(*(none if n == "source_id" else n for n in NAMES), F.lit(sign).alias("_sign"), "et")
    gone = early(_with_visits(both, first, True, hold, "inner").drop("source_id"), -1)
    found = _with_visits(both, seen, True, hold, "inner").select(*NAMES, F.lit(1).alias("_sign"), "et")
    return early(both, 1).unionByName(gone).unionByName(found)


def paid_details(payments: DataFrame, details: DataFrame, streaming: bool = False, hold: str = "905 seconds") -> DataFrame:
    """Order details of successful payments."""
    pay = payments.select("order_id", "alipay_trade_no", F.col("trade_body").alias("pay_body"), "payment_type", "payment_status", "callback_time", "callback_content", F.col("ts").alias("pay_ts")).withColumnRenamed("order_id", "_order")
    on = F.col("order_id") == F.col("_order")
    if streaming:
        pay = pay.withColumn("pay_et", from_seconds("pay_ts")).withWatermark("pay_et", "0 seconds")
        details = details.withColumn("et", from_seconds("ts")).withWatermark("et", "0 seconds")
        on &= F.expr(f"et BETWEEN pay_et - INTERVAL {hold} AND pay_et + INTERVAL {hold}")
    out = pay.join(details, on)
    return out.select(
        "id", "order_id", "user_id", "course_id", "province_id", "date_id", "alipay_trade_no", F.col("pay_body").alias("trade_body"), "payment_type", "payment_status",
        "callback_time", "callback_content", F.col("origin_amount").alias("original_amount"), "coupon_reduce_amount", "final_amount", F.col("pay_ts").alias("ts"), F.current_timestamp().alias("row_op_ts"),
        *([F.col("pay_et").alias("et")] if streaming else []),
    )
