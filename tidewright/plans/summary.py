"""The twelve summary jobs: steps that keep state per key, then one windowed summary with its dimensions.

A step takes the rows and the module that keeps state: tidewright.operators.stateful in batch,
tidewright.streaming.processors in streams, where every step is a query of its own with a table in between. The windowed
summary is one plan for both. Aggregation stands before the dimension lookups, so few rows are looked up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_array
from ..functions.timefn import date_text, from_millis, from_seconds
from ..operators import dims, parse, stateful
from ..operators.windows import LENGTH, total, tumbling

#: How long a stream remembers that it has met an order; visitors of a day are remembered for a day.
HOUR_MS, DAY_MS = 3_600_000, 86_400_000
Step = Callable[[DataFrame, ModuleType], DataFrame]
Dims = dict[str, DataFrame]


@dataclass(frozen=True)
class Job:
    """prepare: input rows -> rows with event time et; steps; window: rows, dimensions, length and delay -> summary.

    changes: in one streaming query, instead of steps and window: rows, the module that chains state, dimensions and length
    -> summary, without holding rows back, by taking back what is replaced."""

    name: str
    prepare: Callable[[DataFrame], DataFrame]
    window: Callable[[DataFrame, Dims, str, str | None], DataFrame]
    steps: list[Step] = field(default_factory=list)
    delay: str = "0 seconds"
    changes: Callable[[DataFrame, ModuleType, Dims, str], DataFrame] | None = None

    def batch(self, rows: DataFrame, dimensions: Dims | None = None, length: str = LENGTH) -> DataFrame:
        out = self.prepare(rows)
        for step in self.steps:
            out = step(out, stateful)
        return self.window(out, dimensions or {}, length, None)


def _pages(pages: DataFrame) -> DataFrame:
    et = from_millis("ts")
    return pages.select(
        et.alias("et"), date_text(et).alias("day"), "ts", F.col("common.mid").alias("mid"), F.col("common.vc").alias("version_code"), F.col("common.sc").alias("source_id"),
        F.col("common.ar").alias("ar"), F.col("common.is_new").alias("is_new"), F.col("page.page_id").alias("page_id"), F.col("page.last_page_id").alias("last_page_id"),
        F.coalesce("page.during_time", F.lit(0)).alias("during"), F.col("page.item").alias("item"),
    )


def _seconds(rows: DataFrame) -> DataFrame:
    et = from_seconds("ts")
    return rows.withColumn("et", et).withColumn("day", date_text(et))


def _details(rows: DataFrame) -> DataFrame:
    """Details with an arrival number (zero where none is given): the later of two with one row_op_ts wins."""
    return _seconds(rows if "arrival" in rows.columns else rows.withColumn("arrival", F.lit(0)))


_latest: Step = lambda rows, state: state.latest(rows, ["id"], ["row_op_ts", "arrival"])


def _words(pages: DataFrame) -> DataFrame:
    return parse.search_rows(pages).select(from_millis("ts").alias("et"), F.explode(keyword_array("fullword")).alias("keyword"))


def _visitors(rows: DataFrame, d: Dims, length: str, delay: str | None) -> DataFrame:
    session = F.when(F.col("last_page_id").isNull() | (F.col("last_page_id") == ""), 1).otherwise(0)
    out = tumbling(rows.withColumn("session", session), "et", ["version_code", "source_id", "ar", "is_new"], [total("uv", "uv_count"), total("session", "total_session_count"), F.count("*").alias("page_view_count"), total("during", "total_during_time")], length, delay)
    out = dims.lookup(out, d["dim_base_source"], "source_id", {"source_site": "source_name"})
    out = dims.lookup(out, d["dim_base_province"], "ar", {"name": "province_name"}, default={"province_name": ""})
    return out.select("stt", "edt", "cur_date", "version_code", "source_id", "source_name", "ar", "is_new", "province_name", "uv_count", "total_session_count", "page_view_count", "total_during_time")


def _page_visits(rows: DataFrame, d: Dims, length: str, delay: str | None) -> DataFrame:
    of = lambda page, name: F.count(F.when(F.col("page_id") == page, 1)).alias(name)
    return tumbling(rows, "et", [], [of("home", "home_uv_count"), of("course_list", "list_uv_count"), of("course_detail", "detail_uv_count")], length, delay)


def _courses(rows: DataFrame, d: Dims, length: str, delay: str | None) -> DataFrame:
    out = tumbling(rows, "et", ["course_id"], [total("final_amount", "order_total_amount", "double")], length, delay)
    out = dims.lookup(out, d["dim_course_info"], "course_id", {"course_name": "course_name", "subject_id": "subject_id"})
    out = dims.lookup(out, d["dim_base_subject_info"], "subject_id", {"subject_name": "subject_name", "category_id": "category_id"})
    out = dims.lookup(out, d["dim_base_category_info"], "category_id", {"category_name": "category_name"})
    return out.select("stt", "edt", "cur_date", "course_id", "course_name", "subject_id", "subject_name", "category_id", "category_name", "order_total_amount")


def _sources(rows: DataFrame, d: Dims, length: str, delay: str | None) -> DataFrame:
    out = tumbling(rows, "et", ["source_id"], [F.min("order_id").alias("order_id"), total("final_amount", "order_total_amount", "double"), total("uu", "order_uu_count"), total("one", "order_count")], length, delay)
    out = dims.lookup(out, d["dim_base_source"], "source_id", {"source_site": "source_name"})
    return out.select("stt", "edt", "cur_date", "source_id", "source_name", "order_id", "order_total_amount", "order_uu_count", "order_count")


def _provinces(rows: DataFrame, d: Dims, length: str, delay: str | None) -> DataFrame:
    amount = F.sum(F.col("final_amount").cast("decimal(16,2)"))
    # streams reject distinct aggregates; there a set per window and province is what is left
    orders = F.size(F.collect_set("order_id")).cast("long") if rows.isStreaming else F.count_distinct("order_id")
    out = tumbling(rows, "et", ["province_id"], [F.coalesce(amount, F.lit(0).cast("decimal(26,2)")).alias("order_total_amount"), total("uu", "order_uu_count"), orders.alias("order_count")], length, delay)
    return _with_province(out, d)


def _province_changes(rows: DataFrame, chain: ModuleType, d: Dims, length: str) -> DataFrame:
    """Details at once, and taken back when a later version comes. An order counts while a detail of it stands, a user on the
    first detail of the day that stands: first sums by order, then by province."""
    rows = rows.withColumn("amount", F.col("final_amount").cast("decimal(16,2)"))
    out = chain.replacements(rows, "id", ["row_op_ts", "arrival"])
    out = chain.credited(out, ["province_id", "user_id", "day"], ["ts", "id"], "uu")
    sign = F.col("_sign")
    orders = out.groupBy(F.window("et", length).alias("_w"), "province_id", "order_id").agg(F.sum(sign).alias("n"), F.sum(F.col("amount") * sign).alias("amount"), F.sum("uu").alias("uu")).filter("n > 0")
    zero = F.lit(0).cast("decimal(26,2)")
    measures = [F.coalesce(F.sum("amount").cast("decimal(26,2)"), zero).alias("order_total_amount"), F.sum("uu").alias("order_uu_count"), F.count("order_id").alias("order_count")]
    return _with_province(tumbling(orders, "_w", ["province_id"], measures, length), d)


def _with_province(out: DataFrame, d: Dims) -> DataFrame:
    out = dims.lookup(out, d["dim_base_province"], "province_id", {"name": "province_name"}, default={"province_name": ""})
    return out.select("stt", "edt", "cur_date", "province_id", "province_name", F.lit("").alias("user_id"), "order_total_amount", "order_uu_count", "order_count")


def _papers(rows: DataFrame, d: Dims, length: str, delay: str | None) -> DataFrame:
    points = F.coalesce(F.col("score").cast("long"), F.lit(0))
    out = tumbling(rows.withColumn("points", points), "et", ["paper_id"], [F.count("*").alias("exam_taken_count"), total("points", "exam_total_score"), total("duration_sec", "exam_total_during_sec")], length, delay)
    out = dims.lookup(out, d["dim_test_paper"], "paper_id", {"paper_title": "paper_title", "course_id": "course_id"})
    out = dims.lookup(out, d["dim_course_info"], "course_id", {"course_name": "course_name"})
    return out.select("stt", "edt", "cur_date", "paper_id", "paper_title", "course_id", "course_name", "exam_taken_count", "exam_total_score", "exam_total_during_sec")


def _bands(rows: DataFrame, d: Dims, length: str, delay: str | None) -> DataFrame:
    out = tumbling(rows.withColumn("score_duration", parse.score_band(F.coalesce("score", F.lit(0.0)))), "et", ["paper_id", "score_duration"], [F.count("*").alias("user_count")], length, delay)
    return dims.lookup(out, d["dim_test_paper"], "paper_id", {"paper_title": "paper_title"}).select("stt", "edt", "cur_date", "paper_id", "paper_title", "score_duration", "user_count")


def _questions(rows: DataFrame, d: Dims, length: str, delay: str | None) -> DataFrame:
    out = tumbling(rows, "et", ["question_id"], [F.count(F.when(F.col("is_correct") == "1", 1)).alias("correct_answer_count"), F.count("*").alias("answer_count")], length, delay)
    return dims.lookup(out, d["dim_test_question_info"], "question_id", {"question_txt": "question_txt"}).select("stt", "edt", "cur_date", "question_id", "question_txt", "correct_answer_count", "answer_count")


def _sums(*names: str) -> Callable[[DataFrame, Dims, str, str | None], DataFrame]:
    return lambda rows, d, length, delay: tumbling(rows, "et", [], [total(n) for n in names], length, delay)


def _first_visits(literal: bool) -> Step:
    return lambda rows, state: state.first_of_day(rows, ["mid", "page_id"], "day", ["et", "ts"], literal, ttl_ms=DAY_MS)


def _counted(uv: str, new: str, literal: bool) -> Step:
    return lambda rows, state: state.visitors_and_new(rows, "user_id", "day", ["ts", "id"], uv, new, literal)


def summary_jobs(literal: bool = False) -> dict[str, Job]:
    """All twelve by the name of their table. literal: keep to the letter of the original comparisons (day against second,
    state that isn't updated) instead of their meaning."""
    jobs = [
        Job("dws_traffic_source_keyword_page_view_window", _words, lambda r, d, n, w: tumbling(r, "et", ["keyword"], [F.count("*").alias("keyword_count")], n, w)),
        Job("dws_traffic_vc_ch_ar_visitor_category_page_view_window", _pages, _visitors, [lambda r, s: s.flag_first(r, ["mid", "day"], ["ts", "page_id"], "uv", ttl_ms=DAY_MS)]),
        Job("dws_traffic_home_course_detail_page_view_window", lambda p: _pages(parse.pages_in(p)), _page_visits, [_first_visits(literal)]),
        Job("dws_trade_cart_add_window", _seconds, lambda r, d, n, w: tumbling(r, "et", [], [F.count("*").alias("cart_add_uv_count")], n, w), [lambda r, s: s.first_of_day(r, ["user_id"], "day", ["ts"], ttl_ms=DAY_MS)]),
        Job("dws_trade_order_window", _details, _sums("order_uv_count", "new_order_user_count"), [_latest, _counted("order_uv_count", "new_order_user_count", literal)]),
        Job("dws_trade_pay_suc_window", _details, _sums("pay_suc_uv_count", "pay_suc_new_user_count"), [_latest, _counted("pay_suc_uv_count", "pay_suc_new_user_count", literal)], "2 seconds"),
        Job("dws_trade_course_order_window", _details, _courses, [_latest], "2 seconds"),
        Job("dws_trade_source_order_window", lambda r: _details(parse.with_source(r)), _sources, [_latest, lambda r, s: s.flag_first(r, ["user_id", "source_id", "day"], ["ts", "id"], "uu", ttl_ms=DAY_MS), lambda r, s: s.flag_first(r, ["order_id"], ["ts", "id"], "one", ttl_ms=HOUR_MS)]),
        Job("dws_trade_province_order_window", _details, _provinces, [_latest, lambda r, s: s.flag_first(r, ["province_id", "user_id", "day"], ["ts", "id"], "uu", ttl_ms=DAY_MS)], changes=_province_changes),
        Job("dws_examination_paper_exam_window", _seconds, _papers),
        Job("dws_examination_paper_score_duration_exam_window", _seconds, _bands),
        Job("dws_examination_question_answer_window", _seconds, _questions),
    ]
    return {j.name: j for j in jobs}
