"""Dashboard queries over one day of the summary tables, and the chart shapes of their answers.

The day filter prunes partitions, as summary tables are partitioned by cur_date. Ratios over nothing are null."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day(table: DataFrame, date: str | int) -> DataFrame:
    """The rows of a date, given as yyyyMMdd or yyyy-MM-dd."""
    text = str(date).replace("-", "")
    return table.filter(F.col("cur_date") == f"{text[:4]}-{text[4:6]}-{text[6:8]}")


def _ratio(a: str, b: str, name: str):
    return F.try_divide(F.sum(a), F.sum(b)).alias(name)


def _exams(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    taken = F.sum("exam_taken_count").alias("exam_taken_count")
    out = rows.groupBy(*keys).agg(taken, _ratio("exam_total_score", "exam_taken_count", "avg_score"), _ratio("exam_total_during_sec", "exam_taken_count", "avg_during_sec"))
    return out.orderBy(F.col("exam_taken_count").desc(), keys[0]).limit(top)


def paper_stats(exams: DataFrame, date: str | int, top: int = 10) -> DataFrame:
    """The papers most taken, with their average score and duration."""
    return _exams(day(exams, date), ["paper_id", "paper_title"], top)


def course_stats(exams: DataFrame, date: str | int, top: int = 10) -> DataFrame:
    return _exams(day(exams, date), ["course_id", "course_name"], top)


def keyword_cloud(words: DataFrame, date: str | int) -> DataFrame:
    return day(words, date).groupBy("keyword").agg(F.sum("keyword_count").alias("keyword_count")).orderBy(F.col("keyword_count").desc(), "keyword")


def visitors_per_hour(visits: DataFrame, date: str | int) -> DataFrame:
    """Of each of 24 hours, zeros included: visitors, page views, and the summary rows of new visitors."""
    rows = day(visits, date).withColumn("hr", F.substring("stt", 12, 2).cast("int"))
    new = F.sum(F.when(F.col("is_new") == "1", 1).otherwise(0)).alias("new_uv_count")
    found = rows.groupBy("hr").agg(F.sum("uv_count").alias("uv_count"), F.sum("page_view_count").alias("page_view_count"), new)
    hours = visits.sparkSession.range(24).select(F.col("id").cast("int").alias("hr"))
    return hours.join(found, "hr", "left").fillna(0).orderBy("hr")


def _by_source(visits: DataFrame, date: str | int, measure, name: str) -> DataFrame:
    return day(visits, date).groupBy("source_name").agg(measure.alias(name)).orderBy(F.col(name).desc_nulls_last(), "source_name")


def source_visitors(visits: DataFrame, date: str | int) -> DataFrame:
    return _by_source(visits, date, F.sum("uv_count"), "uv_count")


def source_sessions(visits: DataFrame, date: str | int) -> DataFrame:
    return _by_source(visits, date, F.sum("total_session_count"), "total_session_count")


def source_pages_per_session(visits: DataFrame, date: str | int) -> DataFrame:
    return _by_source(visits, date, F.try_divide(F.sum("page_view_count"), F.sum("total_session_count")), "pv_per_session")


def source_duration_per_session(visits: DataFrame, date: str | int) -> DataFrame:
    return _by_source(visits, date, F.try_divide(F.sum("total_during_time"), F.sum("total_session_count")), "dur_per_session")


def province_amounts(orders: DataFrame, date: str | int) -> DataFrame:
    return day(orders, date).groupBy("province_name").agg(F.sum("order_total_amount").alias("order_total_amount")).orderBy(F.col("order_total_amount").desc(), "province_name")


def source_orders(orders: DataFrame, date: str | int) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("order_total_amount", "order_uu_count", "order_count")]
    return day(orders, date).groupBy("source_name").agg(*sums).orderBy(F.col("order_total_amount").desc(), "source_name")


def question_accuracy(answers: DataFrame, date: str | int) -> DataFrame:
    """Accuracy of each question; its text is told by ten digits of its MD5."""
    out = day(answers, date).groupBy("question_id", "question_txt").agg(F.sum("correct_answer_count").alias("correct_answer_count"), F.sum("answer_count").alias("answer_count"))
    return out.select("question_id", F.substring(F.md5(F.col("question_txt")), 1, 10).alias("question_txt"), "correct_answer_count", "answer_count", F.try_divide("correct_answer_count", "answer_count").alias("accuracy_rate")).orderBy(F.col("answer_count").desc(), "question_id")


def score_distribution(bands: DataFrame, date: str | int) -> DataFrame:
    return day(bands, date).groupBy("paper_id", "paper_title", "score_duration").agg(F.sum("user_count").alias("user_count")).orderBy("paper_id", "score_duration")


def _answer(data: Any) -> dict:
    return {"status": 0, "msg": "", "data": data}


def table_chart(df: DataFrame, names: dict[str, str]) -> dict:
    """A table answer: columns with their titles, and the rows of a result that is small by its query."""
    rows = [r.asDict() for r in df.select(*names).collect()]
    return _answer({"columns": [{"id": c, "name": n} for c, n in names.items()], "rows": rows})


def series_chart(df: DataFrame, category: str, values: dict[str, str], pad: int = 0) -> dict:
    """A chart answer: categories and one series a measure; empty lists where there are no rows."""
    rows = df.select(category, *values).collect()
    label = (lambda x: f"{x:0{pad}d}") if pad else (lambda x: x)
    return _answer({"categories": [label(r[category]) for r in rows], "series": [{"name": n, "data": [r[v] for r in rows]} for v, n in values.items()]})


def cloud_chart(df: DataFrame, name: str, value: str) -> dict:
    """All rows, a partition at a time: the answer has as many entries as the query has rows."""
    return _answer([{"name": r[name], "value": r[value]} for r in df.select(name, value).toLocalIterator()])


def endpoints(tables: dict[str, DataFrame], date: str | int | None = None) -> dict[str, Any]:
    """The dashboard's answers by path: path -> function without arguments. The date defaults to today."""
    from datetime import date as today

    d = date or today.today().strftime("%Y%m%d")
    visits, exams = tables["dws_traffic_vc_ch_ar_visitor_category_page_view_window"], tables["dws_examination_paper_exam_window"]
    words = tables["dws_traffic_source_keyword_page_view_window"]
    ratios = {"exam_taken_count": "taken", "avg_score": "average score", "avg_during_sec": "average seconds"}
    return {
        "/edu/realtime/examination/paperStats": lambda: table_chart(paper_stats(exams, d), {"paper_title": "paper"} | ratios),
        "/edu/realtime/examination/courseStats": lambda: table_chart(course_stats(exams, d), {"course_name": "course"} | ratios),
        "/edu/realtime/traffic/keywords": lambda: cloud_chart(keyword_cloud(words, d), "keyword", "keyword_count"),
        "/edu/realtime/traffic/visitorPerHr": lambda: series_chart(visitors_per_hour(visits, d), "hr", {"uv_count": "visitors", "page_view_count": "page views", "new_uv_count": "new visitors"}, pad=2),
        "/edu/realtime/traffic/uvCt": lambda: series_chart(source_visitors(visits, d), "source_name", {"uv_count": "visitors"}),
        "/edu/realtime/traffic/svCt": lambda: series_chart(source_sessions(visits, d), "source_name", {"total_session_count": "sessions"}),
        "/edu/realtime/traffic/pvPerSession": lambda: series_chart(source_pages_per_session(visits, d), "source_name", {"pv_per_session": "page views per session"}),
        "/edu/realtime/traffic/durPerSession": lambda: series_chart(source_duration_per_session(visits, d), "source_name", {"dur_per_session": "duration per session"}),
    }
