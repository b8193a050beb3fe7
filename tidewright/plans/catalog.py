"""The operators on the driver's tables, a query each, with the same in DuckDB SQL.

Times are without zone, so results don't depend on the session's; money is summed as decimals; every order is total."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import keyword_array, register_keywords
from ..functions.timefn import epoch_seconds
from ..operators import dims, parse, routing, serving, stateful
from ..operators.windows import total, tumbling
from . import job_catalog

HOUR = "1 hour"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with k of their properties, day, and milliseconds."""
    k = F.from_json("props", "k BIGINT")["k"]
    millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return _t(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", k.alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"), millis.alias("millis"))


def json_etl_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Events as change records in JSON, through the dimension ETL."""
    e = _events(spark, sf)
    kind = F.element_at(F.array(*map(F.lit, ("insert", "update", "delete", "bootstrap-insert", "bootstrap-start"))), (F.col("k") % 5 + 1).cast("int"))
    data = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("k"), F.col("k").cast("string"))
    record = F.struct(F.when(F.col("k") % 7 == 0, "other").otherwise("edu").alias("database"), F.col("event_type").alias("table"), kind.alias("type"), epoch_seconds("ts").alias("ts"), F.when(F.col("k") % 11 != 0, data).alias("data"))
    raw = e.select(F.when(F.col("k") % 13 == 0, "{broken").otherwise(F.to_json(record)).alias("value"))
    return parse.dim_etl(parse.changes(raw)).select(F.col("data")["id"].cast("long").alias("event_id"), F.col("table").alias("source_table"), F.col("type").alias("op"), F.col("ts").alias("seconds"), F.col("data")["k"].cast("long").alias("k"))


def log_split_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Events as application logs in JSON, split six ways; rows and the sum of their ids by output."""
    e = _events(spark, sf)
    many = lambda n, key: F.transform(F.sequence(F.lit(1), n), lambda i: F.create_map(F.lit(key), i.cast("string")))
    record = F.struct(
        F.struct(F.col("user_id").cast("string").alias("mid"), F.col("event_id").cast("string").alias("sid")).alias("common"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), F.struct(F.col("event_type").alias("page_id"))).alias("page"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("err"), F.when(F.col("event_type") == "signup", F.lit("started")).alias("start"),
        F.when(F.col("k") % 3 > 0, many((F.col("k") % 3).cast("int"), "item")).alias("displays"), F.when(F.col("k") % 2 > 0, many(F.lit(1), "act")).alias("actions"), F.col("millis").alias("ts"),
    )
    out = parse.log_outputs(e.select(F.when(F.col("k") % 17 == 0, "not json").otherwise(F.to_json(record)).alias("value")))
    return out.groupBy("output").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("common.sid").cast("long"), F.lit(0))).alias("id_sum"))


def config_route(spark: SparkSession, sf: str) -> DataFrame:
    """Events routed to sinks by an inline configuration that has been replayed."""
    cfg = spark.createDataFrame([("view", "insert", "dwd_view", "id,k"), ("click", "insert", "dwd_click", "id"), ("click", "update", "dwd_click_fix", "id,user"), ("purchase", "update", "dwd_buy", "k,user")], "source_table string, source_type string, sink_table string, sink_columns string")
    e = _events(spark, sf)
    data = F.create_map(*(x for n, c in (("id", "event_id"), ("k", "k"), ("user", "user_id")) for x in (F.lit(n), F.col(c).cast("string"))))
    records = e.select(F.col("event_type").alias("table"), F.when(F.col("k") % 2 == 0, "insert").otherwise("update").alias("type"), F.col("event_id").alias("ts"), data.alias("data"))
    out = routing.route_dwd(records, cfg)
    return out.select("sink_table", F.col("data")["id"].alias("id"), F.col("data")["k"].alias("k"), F.col("data")["user"].alias("user_name"), F.col("data")["ts"].cast("long").alias("event_id"))


def new_visitor_fix(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("is_new", (F.col("k") % 2).cast("string"))
    return stateful.repair_new_visitor(e, "user_id", "is_new", "day", ["ts", "event_id"]).select("event_id", "is_new")


def unique_visitor_daily(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).filter("event_type = 'view'")
    return stateful.first_of_day(e, ["user_id"], "day", ["ts", "event_id"]).select("event_id", "user_id", "day")


def page_uv_window(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).filter(F.col("event_type").isin("view", "click", "purchase"))
    first = stateful.first_of_day(e, ["user_id", "event_type"], "day", ["ts", "event_id"])
    of = lambda page, name: F.count(F.when(F.col("event_type") == page, 1)).alias(name)
    return tumbling(first, "ts", [], [of("view", "home_uv_count"), of("click", "list_uv_count"), of("purchase", "detail_uv_count")], HOUR)


def traffic_multi_dim_window(spark: SparkSession, sf: str) -> DataFrame:
    e = stateful.flag_first(_events(spark, sf), ["user_id", "day"], ["ts", "event_id"], "uv").withColumn("ar", (F.col("k") % 30).cast("int")).withColumn("session", F.when(F.col("k") % 3 == 0, 1).otherwise(0))
    out = tumbling(e, "ts", ["event_type", "ar"], [total("uv", "uv_count"), total("session", "total_session_count"), F.count("*").alias("page_view_count"), total("k", "total_during_time")], HOUR)
    return dims.lookup(out, _t(spark, sf, "nation"), "ar", {"n_name": "province_name"}, dim_key="n_nationkey", default={"province_name": ""})


def bounce_detect(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    return stateful.bounces(e, "user_id", F.col("event_type") == "view", "millis", ["ts", "event_id"], within=6 * 3_600_000).select("event_id", "user_id")


def order_detail_join(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with their order, and the customer where in one segment: an inner and a left outer join."""
    li, o = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    c = _t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    both = li.join(o, li.l_orderkey == o.o_orderkey).join(c, "o_custkey", "left")
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "o_custkey", "o_orderstatus", "c_name")


def pay_success_join(spark: SparkSession, sf: str) -> DataFrame:
    pay = _t(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return pay.join(_t(spark, sf, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "o_totalprice", "l_extendedprice")


LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def dedup_latest(spark: SparkSession, sf: str) -> DataFrame:
    return stateful.latest(_t(spark, sf, "lineitem"), ["l_orderkey"], LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def retract_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over each version and the retraction of the one before."""
    rows = _t(spark, sf, "lineitem").withColumn("amount", F.col("l_extendedprice").cast("decimal(16,2)")).select("l_orderkey", "l_returnflag", "amount", *LINE_ORDER)
    out = stateful.retractions(rows, "l_orderkey", LINE_ORDER, ["amount"])
    return out.groupBy("l_returnflag").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"), F.sum("_sign").alias("n"))


def order_uv_new_user(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = stateful.visitors_and_new(o, "o_custkey", "day", ["o_orderdate", "o_orderkey"], "uv", "new")
    return tumbling(out, "o_orderdate", [], [total("uv", "order_uv_count"), total("new", "new_order_user_count")], "1 day")


def course_amount_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts by supplier, and then a chain of lookups: aggregation first."""
    out = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(16,2)")).cast("decimal(38,2)").alias("order_total_amount"))
    out = dims.lookup(out, _t(spark, sf, "supplier"), "l_suppkey", {"s_name": "s_name", "s_nationkey": "s_nationkey"}, "s_suppkey")
    out = dims.lookup(out, _t(spark, sf, "nation"), "s_nationkey", {"n_name": "n_name", "n_regionkey": "n_regionkey"}, "n_nationkey")
    return dims.lookup(out, _t(spark, sf, "region"), "n_regionkey", {"r_name": "r_name"}, "r_regionkey")


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    amount = F.col("l_extendedprice").cast("decimal(16,2)").alias("amount")
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amount).join(o, "l_orderkey")


LINE = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount"]


def source_order_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = stateful.flag_first(_order_lines(spark, sf), ["o_custkey", "o_orderpriority", "day"], LINE, "uu")
    rows = stateful.flag_first(rows, ["l_orderkey"], LINE, "one")
    return tumbling(rows, "o_orderdate", ["o_orderpriority"], [F.sum("amount").cast("decimal(38,2)").alias("order_total_amount"), total("uu", "order_uu_count"), total("one", "order_count"), F.min("l_orderkey").alias("order_id")], "1 day")


def province_distinct_orders(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = stateful.flag_first(_order_lines(spark, sf).join(c, "o_custkey"), ["c_nationkey", "o_custkey", "day"], LINE, "uu")
    out = tumbling(rows, "o_orderdate", ["c_nationkey"], [F.sum("amount").cast("decimal(38,2)").alias("order_total_amount"), total("uu", "order_uu_count"), F.count_distinct("l_orderkey").alias("order_count")], "1 day")
    return dims.lookup(out, _t(spark, sf, "nation"), "c_nationkey", {"n_name": "province_name"}, "n_nationkey", {"province_name": ""})


def score_band(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").withColumn("score_duration", parse.score_band(F.col("l_quantity") * 2.5 - 5))
    return tumbling(rows, "l_shipdate", ["l_linenumber", "score_duration"], [F.count("*").alias("user_count")], "1 day")


def question_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return tumbling(_events(spark, sf), "ts", ["event_type"], [F.count(F.when(F.col("k") % 2 == 1, 1)).alias("correct_answer_count"), F.count("*").alias("answer_count")], HOUR)


def keyword_udtf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty most frequent keywords of all documents; segmentation stays in the JVM."""
    words = _t(spark, sf, "documents").select(F.explode(keyword_array("text")).alias("keyword"))
    return words.groupBy("keyword").agg(F.count("*").alias("keyword_count")).orderBy(F.col("keyword_count").desc(), "keyword").limit(50)


def keyword_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """The same segmentation as a table function in SQL, over conversations."""
    register_keywords(spark)
    _t(spark, sf, "conversations").createOrReplaceTempView("tidewright_conversations")
    return spark.sql("SELECT role, word AS keyword, count(*) AS keyword_count FROM tidewright_conversations c, LATERAL ik_analyze(c.text) GROUP BY role, word")


def hourly_dense24(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups of each hour of one day, zeros included."""
    e = stateful.flag_first(_events(spark, sf).filter("event_type = 'signup'").withColumn("is_new", (F.col("k") % 2).cast("string")), ["user_id", "day"], ["ts", "event_id"], "uv")
    out = tumbling(e, "ts", ["is_new"], [total("uv", "uv_count"), F.count("*").alias("page_view_count")], HOUR)
    return serving.visitors_per_hour(out, 20240105)


def ratio_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """Visitors, sessions, and views and time per session by source, some of which have no session."""
    e = stateful.flag_first(_events(spark, sf), ["user_id", "day"], ["ts", "event_id"], "uv_count").withColumn("source_name", (F.col("k") % 10).cast("string"))
    session = F.when((F.col("k") % 20 == F.col("k") % 10) & (F.col("source_name") != "7"), 1).otherwise(0)
    v = e.withColumn("total_session_count", session).withColumn("page_view_count", F.lit(1)).withColumn("total_during_time", F.col("k")).withColumn("cur_date", F.col("day"))
    out = serving.source_visitors(v, 20240105)
    for part in (serving.source_sessions, serving.source_pages_per_session, serving.source_duration_per_session):
        out = out.join(part(v, 20240105), "source_name")
    return out


def _exams(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines of one day as exams: a part is a paper, its brand the course."""
    x = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("paper"), (F.col("l_quantity") * 2).alias("score"), F.col("l_linenumber").cast("long").alias("sec"), F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("et"))
    out = tumbling(x, "et", ["paper"], [F.count("*").alias("exam_taken_count"), F.sum(F.col("score").cast("long")).alias("exam_total_score"), total("sec", "exam_total_during_sec")], "1 day")
    return dims.lookup(out, _t(spark, sf, "part"), "paper", {"p_name": "paper_title", "p_brand": "course_id"}, "p_partkey").withColumn("course_name", F.col("course_id")).withColumnRenamed("paper", "paper_id")


def dws_then_topk(spark: SparkSession, sf: str) -> DataFrame:
    return serving.paper_stats(_exams(spark, sf), 19980101)


def course_topk(spark: SparkSession, sf: str) -> DataFrame:
    return serving.course_stats(_exams(spark, sf), 19980101)


def dim_merge_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    """Events as puts to a dimension of users: null and empty cells leave what is there, deletions take all."""
    e = _events(spark, sf)
    a = F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, F.col("k").cast("string"))
    puts = e.select("user_id", a.alias("a"), F.when(F.col("k") % 5 != 0, F.col("event_type")).alias("b"), F.when(F.col("k") % 50 == 7, "delete").otherwise("update").alias("type"), "ts", "event_id")
    return dims.merge_dim(puts, "user_id", ["a", "b"], ["ts", "event_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dws_then_topk, json_etl_filter, log_split_explode, config_route, new_visitor_fix, unique_visitor_daily, page_uv_window, traffic_multi_dim_window, bounce_detect, order_detail_join,
        pay_success_join, dedup_latest, retract_sum, order_uv_new_user, course_amount_rollup, source_order_window, province_distinct_orders, score_band, question_accuracy, keyword_udtf_topk,
        keyword_lateral, hourly_dense24, ratio_per_source, course_topk, dim_merge_nonempty,
    )
} | job_catalog.QUERIES

E = f"SELECT event_id, ts, user_id, event_type, {K} AS k, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) // 1000 AS millis FROM events"
STAMP = "strftime(w, '%Y-%m-%d %H:%M:%S') AS stt, strftime(w + INTERVAL {n}, '%Y-%m-%d %H:%M:%S') AS edt, strftime(w, '%Y-%m-%d') AS cur_date"
HOURS, DAYS = STAMP.format(n="1 HOUR"), STAMP.format(n="1 DAY")
LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(16,2)) AS amount, o_custkey, o_orderpriority, o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
BY_LINE = "ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, amount"
EXAMS = "SELECT l_partkey AS paper_id, count(*) AS n, sum(CAST(trunc(l_quantity * 2) AS BIGINT)) AS score, sum(l_linenumber) AS sec FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1"

ORACLE_SQL: dict[str, str] = {
    "json_etl_filter": f"""
        WITH e AS ({E}), r AS (SELECT *, ['insert', 'update', 'delete', 'bootstrap-insert', 'bootstrap-start'][k % 5 + 1] AS op FROM e)
        SELECT event_id, event_type AS source_table, op, millis // 1000 AS seconds, k FROM r
        WHERE k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AND op <> 'bootstrap-start'""",
    "log_split_explode": f"""
        WITH e AS ({E}), c AS (SELECT * FROM e WHERE k % 17 <> 0), p AS (SELECT * FROM c WHERE event_type IN ('view', 'click', 'purchase')),
             u AS (SELECT 'err' AS output, event_id AS id FROM c WHERE event_type = 'error' UNION ALL SELECT 'start', event_id FROM c WHERE event_type = 'signup' UNION ALL SELECT 'page', event_id FROM p
                   UNION ALL SELECT 'display', event_id FROM p, range(3) AS t(i) WHERE i < k % 3 UNION ALL SELECT 'action', event_id FROM p WHERE k % 2 > 0 UNION ALL SELECT 'dirty', 0 FROM e WHERE k % 17 = 0)
        SELECT output, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM u GROUP BY 1""",
    "config_route": f"""
        WITH e AS ({E}), c(t, odd, sink_table, a, b, d) AS (VALUES ('view', 0, 'dwd_view', 1, 1, 0), ('click', 0, 'dwd_click', 1, 0, 0), ('click', 1, 'dwd_click_fix', 1, 0, 1), ('purchase', 1, 'dwd_buy', 0, 1, 1))
        SELECT sink_table, CASE WHEN a = 1 THEN CAST(event_id AS VARCHAR) END AS id, CASE WHEN b = 1 THEN CAST(k AS VARCHAR) END AS k, CASE WHEN d = 1 THEN CAST(user_id AS VARCHAR) END AS user_name, event_id
        FROM e JOIN c ON event_type = t AND k % 2 = odd""",
    "new_visitor_fix": f"""
        WITH e AS ({E}), f AS (SELECT *, first_value(k % 2) OVER w AS first_new, first_value(day) OVER w AS first_day FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, CASE WHEN k % 2 = 1 AND first_new = 1 AND day = first_day THEN '1' ELSE '0' END AS is_new FROM f""",
    "unique_visitor_daily": f"WITH e AS ({E}) SELECT event_id, user_id, day FROM e WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) = 1",
    "page_uv_window": f"""
        WITH e AS ({E}), f AS (SELECT date_trunc('hour', ts) AS w, event_type FROM e WHERE event_type IN ('view', 'click', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY ts, event_id) = 1)
        SELECT {HOURS}, count(*) FILTER (event_type = 'view') AS home_uv_count, count(*) FILTER (event_type = 'click') AS list_uv_count, count(*) FILTER (event_type = 'purchase') AS detail_uv_count FROM f GROUP BY w""",
    "traffic_multi_dim_window": f"""
        WITH e AS ({E}), f AS (SELECT *, date_trunc('hour', ts) AS w, CAST(k % 30 AS INTEGER) AS ar, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) = 1 AS one FROM e),
             g AS (SELECT w, event_type, ar, count(*) FILTER (one) AS uv_count, count(*) FILTER (k % 3 = 0) AS total_session_count, count(*) AS page_view_count, CAST(sum(k) AS BIGINT) AS total_during_time FROM f GROUP BY 1, 2, 3)
        SELECT {HOURS}, event_type, ar, uv_count, total_session_count, page_view_count, total_during_time, coalesce(n_name, '') AS province_name FROM g LEFT JOIN nation ON ar = n_nationkey""",
    "bounce_detect": f"""
        WITH e AS ({E}), f AS (SELECT *, lead(millis) OVER w AS next_ms, lead(event_type) OVER w AS next_type FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, user_id FROM f WHERE event_type = 'view' AND (next_ms IS NULL OR next_ms - millis >= 21600000 OR next_type = 'view')""",
    "order_detail_join": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_custkey, o_orderstatus, c_name
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'""",
    "pay_success_join": "SELECT l_orderkey, l_linenumber, l_partkey, o_totalprice, l_extendedprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'",
    "dedup_latest": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
    "retract_sum": """
        WITH t AS (SELECT *, CAST(l_extendedprice AS DECIMAL(16,2)) AS amount FROM lineitem), w AS (SELECT l_returnflag, amount, lag(l_returnflag) OVER o AS old_flag, lag(amount) OVER o AS old_amount
             FROM t WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
             u AS (SELECT l_returnflag, amount, 1 AS s FROM w UNION ALL SELECT old_flag, -old_amount, -1 FROM w WHERE old_flag IS NOT NULL)
        SELECT l_returnflag, CAST(sum(amount) AS DECIMAL(38,2)) AS amount, CAST(sum(s) AS BIGINT) AS n FROM u GROUP BY 1""",
    "order_uv_new_user": f"""
        WITH f AS (SELECT date_trunc('day', o_orderdate) AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS fresh, row_number() OVER (PARTITION BY o_custkey, date_trunc('day', o_orderdate) ORDER BY o_orderdate, o_orderkey) = 1 AS one FROM orders)
        SELECT {DAYS}, count(*) AS order_uv_count, count(*) FILTER (fresh) AS new_order_user_count FROM f WHERE one GROUP BY w""",
    "course_amount_rollup": """
        WITH g AS (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(16,2))) AS DECIMAL(38,2)) AS order_total_amount FROM lineitem GROUP BY 1)
        SELECT l_suppkey, order_total_amount, s_name, s_nationkey, n_name, n_regionkey, r_name FROM g LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "source_order_window": f"""
        WITH x AS ({LINES}), f AS (SELECT *, date_trunc('day', o_orderdate) AS w, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, day {BY_LINE}) = 1 AS uu, row_number() OVER (PARTITION BY l_orderkey {BY_LINE}) = 1 AS one FROM x)
        SELECT {DAYS}, o_orderpriority, CAST(sum(amount) AS DECIMAL(38,2)) AS order_total_amount, count(*) FILTER (uu) AS order_uu_count, count(*) FILTER (one) AS order_count, min(l_orderkey) AS order_id FROM f GROUP BY w, o_orderpriority""",
    "province_distinct_orders": f"""
        WITH x AS (SELECT l.*, c_nationkey FROM ({LINES}) l JOIN customer ON o_custkey = c_custkey), f AS (SELECT *, date_trunc('day', o_orderdate) AS w, row_number() OVER (PARTITION BY c_nationkey, o_custkey, day {BY_LINE}) = 1 AS uu FROM x),
             g AS (SELECT w, c_nationkey, CAST(sum(amount) AS DECIMAL(38,2)) AS order_total_amount, count(*) FILTER (uu) AS order_uu_count, count(DISTINCT l_orderkey) AS order_count FROM f GROUP BY 1, 2)
        SELECT {DAYS}, c_nationkey, order_total_amount, order_uu_count, order_count, coalesce(n_name, '') AS province_name FROM g LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "score_band": f"""
        WITH f AS (SELECT date_trunc('day', l_shipdate) AS w, l_linenumber, l_quantity * 2.5 - 5 AS s FROM lineitem),
             g AS (SELECT w, l_linenumber, CASE WHEN s < 60 THEN '[0,60)' WHEN s < 70 THEN '[60,70)' WHEN s < 80 THEN '[70,80)' WHEN s < 90 THEN '[80,90)' WHEN s <= 100 THEN '[90,100]' ELSE '' END AS score_duration FROM f)
        SELECT {DAYS}, l_linenumber, score_duration, count(*) AS user_count FROM g GROUP BY w, l_linenumber, score_duration""",
    "question_accuracy": f"WITH e AS ({E}), f AS (SELECT date_trunc('hour', ts) AS w, * FROM e) SELECT {HOURS}, event_type, count(*) FILTER (k % 2 = 1) AS correct_answer_count, count(*) AS answer_count FROM f GROUP BY w, event_type",
    "keyword_udtf_topk": """
        WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[㐀-䶿一-鿿]')) AS keyword FROM documents)
        SELECT keyword, count(*) AS keyword_count FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
    "keyword_lateral": """
        WITH w AS (SELECT role, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[㐀-䶿一-鿿]'))) AS keyword FROM conversations)
        SELECT role, keyword, count(*) AS keyword_count FROM w GROUP BY 1, 2""",
    "hourly_dense24": f"""
        WITH e AS ({E}), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) = 1 AS one FROM e WHERE event_type = 'signup'),
             g AS (SELECT CAST(hour(ts) AS INTEGER) AS hr, count(*) FILTER (one) AS uv_count, count(*) AS page_view_count, count(DISTINCT CASE WHEN k % 2 = 1 THEN 1 END) AS new_uv_count FROM f WHERE day = '2024-01-05' GROUP BY 1)
        SELECT CAST(h AS INTEGER) AS hr, coalesce(uv_count, 0) AS uv_count, coalesce(page_view_count, 0) AS page_view_count, coalesce(new_uv_count, 0) AS new_uv_count FROM range(24) AS t(h) LEFT JOIN g ON hr = h""",
    "ratio_per_source": f"""
        WITH e AS ({E}), f AS (SELECT *, CAST(k % 10 AS VARCHAR) AS source_name, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) = 1 AS one FROM e),
             g AS (SELECT source_name, count(*) FILTER (one) AS uv_count, count(*) FILTER (k % 20 = k % 10 AND source_name <> '7') AS s, count(*) AS pv, sum(k) AS dur FROM f WHERE day = '2024-01-05' GROUP BY 1)
        SELECT source_name, uv_count, s AS total_session_count, pv / nullif(s, 0) AS pv_per_session, dur / nullif(s, 0) AS dur_per_session FROM g""",
    "dws_then_topk": f"""
        WITH x AS ({EXAMS}) SELECT paper_id, p_name AS paper_title, n AS exam_taken_count, score / n AS avg_score, sec / n AS avg_during_sec FROM x LEFT JOIN part ON paper_id = p_partkey ORDER BY n DESC, paper_id LIMIT 10""",
    "course_topk": f"""
        WITH x AS ({EXAMS}), g AS (SELECT p_brand AS course_id, CAST(sum(n) AS BIGINT) AS n, sum(score) AS score, sum(sec) AS sec FROM x LEFT JOIN part ON paper_id = p_partkey GROUP BY 1)
        SELECT course_id, course_id AS course_name, n AS exam_taken_count, score / n AS avg_score, sec / n AS avg_during_sec FROM g ORDER BY n DESC, course_id LIMIT 10""",
    "dim_merge_nonempty": f"""
        WITH e AS ({E}), p AS (SELECT user_id, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN CAST(k AS VARCHAR) END AS a, CASE WHEN k % 5 <> 0 THEN event_type END AS b, k % 50 = 7 AS gone, row_number() OVER (ORDER BY ts, event_id) AS n FROM e),
             l AS (SELECT *, max(CASE WHEN gone THEN n END) OVER (PARTITION BY user_id) AS last FROM p)
        SELECT user_id, arg_max(a, n) FILTER (a <> '') AS a, arg_max(b, n) FILTER (b IS NOT NULL) AS b FROM l WHERE NOT gone AND (last IS NULL OR n > last) GROUP BY 1""",
} | job_catalog.ORACLE_SQL
