"""Schemas of the layers. Amounts travel as text in the detail layer, as the change records have them."""

from __future__ import annotations

CHANGE = "database STRING, table STRING, type STRING, ts BIGINT, data MAP<STRING,STRING>, old MAP<STRING,STRING>"
COMMON = "STRUCT<mid: STRING, is_new: STRING, sid: STRING, sc: STRING, vc: STRING, ar: STRING, uid: STRING, ch: STRING>"
PAGE = "STRUCT<page_id: STRING, last_page_id: STRING, during_time: BIGINT, item: STRING, item_type: STRING>"
LOG = f"common {COMMON}, page {PAGE}, err STRING, start STRING, appVideo STRING, displays ARRAY<MAP<STRING,STRING>>, actions ARRAY<MAP<STRING,STRING>>, ts BIGINT"
CDC = "before MAP<STRING,STRING>, after MAP<STRING,STRING>, op STRING, ts_ms BIGINT"
DIM_CONFIG = ["source_table", "sink_table", "sink_columns", "sink_pk"]
DWD_CONFIG = ["source_table", "source_type", "sink_table", "sink_columns"]

ORDER_DETAIL = "id STRING, order_id STRING, user_id STRING, course_id STRING, province_id STRING, date_id STRING, session_id STRING, source_id STRING, create_time STRING, origin_amount STRING, coupon_reduce_amount STRING, final_amount STRING, out_trade_no STRING, trade_body STRING, ts BIGINT, row_op_ts TIMESTAMP"
PAY_DETAIL = "id STRING, order_id STRING, user_id STRING, course_id STRING, province_id STRING, date_id STRING, alipay_trade_no STRING, trade_body STRING, payment_type STRING, payment_status STRING, callback_time STRING, callback_content STRING, original_amount STRING, coupon_reduce_amount STRING, final_amount STRING, ts BIGINT, row_op_ts TIMESTAMP"
CART_ADD = "user_id STRING, ts BIGINT"
TEST_PAPER = "paper_id STRING, score DOUBLE, duration_sec BIGINT, ts BIGINT"
TEST_QUESTION = "question_id STRING, is_correct STRING, ts BIGINT"

_HEAD = "stt STRING, edt STRING, cur_date STRING"
SUMMARY = {
    "dws_traffic_source_keyword_page_view_window": f"{_HEAD}, keyword STRING, keyword_count BIGINT",
    "dws_traffic_vc_ch_ar_visitor_category_page_view_window": f"{_HEAD}, version_code STRING, source_id STRING, source_name STRING, ar STRING, is_new STRING, province_name STRING, uv_count BIGINT, total_session_count BIGINT, page_view_count BIGINT, total_during_time BIGINT",
    "dws_traffic_home_course_detail_page_view_window": f"{_HEAD}, home_uv_count BIGINT, list_uv_count BIGINT, detail_uv_count BIGINT",
    "dws_trade_cart_add_window": f"{_HEAD}, cart_add_uv_count BIGINT",
    "dws_trade_order_window": f"{_HEAD}, order_uv_count BIGINT, new_order_user_count BIGINT",
    "dws_trade_pay_suc_window": f"{_HEAD}, pay_suc_uv_count BIGINT, pay_suc_new_user_count BIGINT",
    "dws_trade_course_order_window": f"{_HEAD}, course_id STRING, course_name STRING, subject_id STRING, subject_name STRING, category_id STRING, category_name STRING, order_total_amount DOUBLE",
    "dws_trade_source_order_window": f"{_HEAD}, source_id STRING, source_name STRING, order_id STRING, order_total_amount DOUBLE, order_uu_count BIGINT, order_count BIGINT",
    "dws_trade_province_order_window": f"{_HEAD}, province_id STRING, province_name STRING, user_id STRING, order_total_amount DECIMAL(26,2), order_uu_count BIGINT, order_count BIGINT",
    "dws_examination_paper_exam_window": f"{_HEAD}, paper_id STRING, paper_title STRING, course_id STRING, course_name STRING, exam_taken_count BIGINT, exam_total_score BIGINT, exam_total_during_sec BIGINT",
    "dws_examination_paper_score_duration_exam_window": f"{_HEAD}, paper_id STRING, paper_title STRING, score_duration STRING, user_count BIGINT",
    "dws_examination_question_answer_window": f"{_HEAD}, question_id STRING, question_txt STRING, correct_answer_count BIGINT, answer_count BIGINT",
}
