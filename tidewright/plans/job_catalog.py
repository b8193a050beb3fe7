"""The shipped jobs on the driver's tables: events become page logs, order lines become change records and details, and
run through parsing, joins, the twelve summary jobs, the dashboard and the stores. Each query has its twin in DuckDB SQL.

Instants are those of a session in UTC, as the test tables have them; amounts are whole numbers, so sums are exact."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timefn
from ..functions.timefn import epoch_seconds
from ..operators import parse, patterns, routing, serving
from ..sources import readers, sinks
from ..sources.config_table import ConfigTable
from ..sources.keyed import KeyedTables
from ..streaming import jobs
from . import detail, schemas
from .session import scratch
from .summary import Dims, summary_jobs

#: Of a file of a simulated topic or source.
RECORDS = 100_000


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a table that is too small to keep all cores busy, dealt out as a topic's partitions would be; a table that is
    read in enough parts stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def _topic(texts: DataFrame, name: str) -> DataFrame:
    """Texts as a topic has them: written once, so that readers don't make them anew in each expression, and compressed, as
    they say the same names in each record. A file holds few records, so that a task that reads some megabytes of them
    doesn't unpack gigabytes."""
    path = f"{scratch(texts.sparkSession)}/{name}-{uuid.uuid4().hex}"
    texts.write.option("compression", "zstd").option("maxRecordsPerFile", RECORDS).parquet(path)
    return texts.sparkSession.read.schema("value STRING").parquet(path)


def log_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a topic of application logs (value): sessions are events, pages go by the type, and errors have none."""
    k = F.col("k")
    millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    e = _dealt(_t(spark, sf, "events")).select("event_id", "ts", "user_id", "event_type", F.from_json("props", "k BIGINT")["k"].alias("k"), millis.alias("millis"))
    page = F.when(F.col("event_type") == "view", "home").when(F.col("event_type") == "click", "course_list").when(F.col("event_type") == "purchase", "course_detail").when(F.col("event_type") == "signup", "order")
    word = k % 4 == 0
    record = F.struct(
        F.struct(_text("user_id").alias("mid"), _text(k % 2).alias("is_new"), F.concat(F.lit("s"), "event_id").alias("sid"), _text(k % 10).alias("sc"), F.concat(F.lit("v"), k % 3).alias("vc"), _text(k % 30).alias("ar")).alias("common"),
        F.when(page.isNotNull(), F.struct(page.alias("page_id"), F.when(k % 3 != 0, "x").alias("last_page_id"), (k * 10).alias("during_time"), F.when(word, F.concat(F.lit("Big Data "), k)).otherwise(F.concat(F.lit("c"), k)).alias("item"), F.when(word, "keyword").otherwise("course").alias("item_type"))).alias("page"),
        F.when(F.col("event_type") == "error", "failed").alias("err"), F.col("millis").alias("ts"),
    )
    return _topic(e.select(F.to_json(record).alias("value")), "topic-log")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return readers.page_log(log_texts(spark, sf)).drop("et")


def _changes(spark: SparkSession, sf: str, part: int | None = None) -> DataFrame:
    """Order lines, orders and their payments as change records (value), not written yet. part: of even orders (0) or odd
    ones (1) alone."""
    def of(table: str, key: str) -> DataFrame:
        rows = _t(spark, sf, table)
        return _dealt(rows if part is None else rows.filter(F.col(key) % 2 == part))

    o = of("orders", "o_orderkey").withColumn("ts", epoch_seconds("o_orderdate"))
    li = of("lineitem", "l_orderkey").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "ts"), "l_orderkey")

    def texts(rows: DataFrame, table: str, kind, **data) -> DataFrame:
        cells = F.create_map(*(x for n, c in data.items() for x in (F.lit(n), _text(c))))
        return rows.select(F.to_json(F.struct(F.lit("edu").alias("database"), F.lit(table).alias("table"), kind.alias("type"), "ts", cells.alias("data"))).alias("value"))

    create = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    lines = texts(li, "order_detail", F.when(F.col("l_linenumber") == 6, "update").otherwise("insert"), id=F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), order_id="l_orderkey", user_id="o_custkey", course_id=F.col("l_partkey") % 50, create_time=create, origin_amount=F.col("l_quantity").cast("long"), coupon_reduce=F.lit(1), final_amount=F.col("l_quantity").cast("long") - 1)
    infos = texts(o, "order_info", F.lit("insert"), id="o_orderkey", province_id=F.col("o_custkey") % 27, out_trade_no=F.concat(F.lit("t"), "o_orderkey"), session_id=F.concat(F.lit("s"), "o_orderkey"), trade_body="o_orderpriority")
    paid = texts(o.withColumn("ts", F.col("ts") + 60), "payment_info", F.lit("update"), order_id="o_orderkey", payment_status=F.when(F.col("o_orderstatus") == "F", "1602").otherwise("1601"), payment_type=F.col("o_custkey") % 3, callback_time=create)
    return lines.unionByName(infos).unionByName(paid)


def change_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines, orders and their payments as a topic of change records (value)."""
    return _topic(_changes(spark, sf), "topic-db")


def _records(spark: SparkSession, sf: str, strict: bool = False) -> DataFrame:
    """The change records, parsed once for all who take one kind of them."""
    return detail.by_table(parse.changes(change_texts(spark, sf), strict=strict), f"{scratch(spark)}/changes-{uuid.uuid4().hex}")


def details(spark: SparkSession, sf: str) -> DataFrame:
    """Order details as the summary jobs take them."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", epoch_seconds("o_orderdate").alias("ts"))
    source = F.when(F.col("l_suppkey") % 3 == 1, "").when(F.col("l_suppkey") % 3 == 2, _text(F.col("l_suppkey") % 10))
    return _t(spark, sf, "lineitem").join(o, "l_orderkey").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), _text("l_orderkey").alias("order_id"), _text("o_custkey").alias("user_id"), _text(F.col("l_partkey") % 50).alias("course_id"), _text(F.col("o_custkey") % 27).alias("province_id"),
        source.alias("source_id"), _text(F.col("l_quantity").cast("long")).alias("final_amount"), "ts", F.col("l_shipdate").alias("row_op_ts"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("arrival"),
    )


def dimensions(spark: SparkSession, sf: str) -> Dims:
    n, p, s, r = (_t(spark, sf, x) for x in ("nation", "part", "supplier", "region"))
    return {
        "dim_base_source": n.select(_text("n_nationkey").alias("id"), F.col("n_name").alias("source_site")), "dim_base_province": n.select(_text("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "dim_course_info": s.select(_text("s_suppkey").alias("id"), F.col("s_name").alias("course_name"), _text("s_nationkey").alias("subject_id")), "dim_base_subject_info": n.select(_text("n_nationkey").alias("id"), F.col("n_name").alias("subject_name"), _text("n_regionkey").alias("category_id")),
        "dim_base_category_info": r.select(_text("r_regionkey").alias("id"), F.col("r_name").alias("category_name")), "dim_test_paper": p.select(_text("p_partkey").alias("id"), F.col("p_name").alias("paper_title"), _text(F.col("p_size") % 9).alias("course_id")),
        "dim_test_question_info": p.select(_text("p_partkey").alias("id"), F.col("p_name").alias("question_txt")),
    }


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 2.5 - 5)
    return _t(spark, sf, "lineitem").select(_text(F.col("l_partkey") % 300).alias("paper_id"), score.alias("score"), F.col("l_linenumber").cast("long").alias("duration_sec"), epoch_seconds("l_shipdate").alias("ts"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select(_text(F.col("l_partkey") % 300).alias("question_id"), F.when(F.col("l_linenumber") != 7, _text(F.col("l_linenumber") % 2)).alias("is_correct"), epoch_seconds("l_shipdate").alias("ts"))


def _carts(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").filter("event_type = 'purchase'")
    return e.select(_text("user_id").alias("user_id"), epoch_seconds("ts").alias("ts"))


def _job(name: str, rows: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A summary job in batch, over whole tables, with its ten-second windows."""
    return lambda spark, sf: summary_jobs()[name].batch(rows(spark, sf), dimensions(spark, sf))


JOBS = {
    "dws_traffic_source_keyword_page_view_window": pages, "dws_traffic_vc_ch_ar_visitor_category_page_view_window": pages, "dws_traffic_home_course_detail_page_view_window": pages, "dws_trade_cart_add_window": _carts,
    "dws_trade_order_window": details, "dws_trade_pay_suc_window": details, "dws_trade_course_order_window": details, "dws_trade_source_order_window": details, "dws_trade_province_order_window": details,
    "dws_examination_paper_exam_window": _papers, "dws_examination_paper_score_duration_exam_window": _papers, "dws_examination_question_answer_window": _answers,
}
DAY = 20240105
SOLD = 19980105


def _run(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _job(name, JOBS[name])(spark, sf)


def dwd_order_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Change records and page logs through the detail job: an inner and a left outer join."""
    out = detail.order_detail(_records(spark, sf), pages(spark, sf))
    return out.drop("row_op_ts")


def dwd_pay_success(spark: SparkSession, sf: str) -> DataFrame:
    """Successful payments with the details of their orders, through both detail jobs."""
    records = _records(spark, sf)
    out = detail.pay_success(records, detail.order_detail(records, pages(spark, sf)))
    return out.select("id", "order_id", "user_id", "course_id", "province_id", "payment_type", "payment_status", "callback_time", "original_amount", "coupon_reduce_amount", "final_amount", "ts")


def _config(spark: SparkSession) -> DataFrame:
    """Configuration events of the dimension job: a change, a deletion, and a table that is dropped and made anew."""
    env = lambda op, ts, table, columns, sink=None: (op, ts, {"source_table": table, "sink_table": sink or f"dim_{table}", "sink_columns": columns, "sink_pk": "id"})
    rows = [env("r", 1, "order_info", "id,province_id"), env("c", 2, "payment_info", "order_id"), env("u", 3, "order_info", "id,province_id,trade_body"), env("d", 4, "payment_info", "order_id"), env("c", 5, "order_detail", "id,course_id")]
    out = spark.createDataFrame(rows, "op string, ts_ms long, row map<string,string>")
    text = F.to_json(F.struct(F.when(F.col("op") == "d", F.col("row")).alias("before"), F.when(F.col("op") != "d", F.col("row")).alias("after"), "op", "ts_ms"))
    return readers.change_capture(out.select(text.alias("value")), "info")


def config_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes of change capture decoded and replayed: the configuration as it stands."""
    now = routing.current_config(_config(spark), ["source_table"])
    return now.select("source_table", F.col("data")["sink_table"].alias("sink_table"), F.col("data")["sink_columns"].alias("sink_columns"))


def cdc_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot and changes of one table, from envelopes: updates follow by the order's priority, finished ones are deleted."""
    o = _t(spark, sf, "orders")
    row = lambda v: F.create_map(F.lit("id"), _text("o_orderkey"), F.lit("v"), v)
    none = F.lit(None).cast("map<string,string>")
    of = lambda rows, op, before, after, ts: rows.select(F.to_json(F.struct(before.alias("before"), after.alias("after"), F.lit(op).alias("op"), F.lit(ts).alias("ts_ms"))).alias("value"))
    raw = of(o, "r", none, row(F.lit("first")), 1).unionByName(of(o.filter("o_orderkey % 3 = 0"), "u", row(F.lit("first")), row(F.col("o_orderpriority")), 2)).unionByName(of(o.filter("o_orderstatus = 'F'"), "d", row(F.lit("x")), none, 3))
    return readers.snapshot(readers.change_capture(raw), "id").select(F.col("data")["id"].cast("long").alias("id"), F.col("data")["v"].alias("v"))


def dim_route(spark: SparkSession, sf: str) -> DataFrame:
    """Change records by the replayed configuration to dimension puts, cut to the columns it names."""
    cfg = routing.current_config(_config(spark), ["source_table"])
    cfg = cfg.select(*(F.col("data")[c].alias(c) for c in ("source_table", "sink_table", "sink_columns", "sink_pk")))
    out = detail.dim_changes(change_texts(spark, sf), cfg)
    return out.select("sink_table", "sink_pk", "type", "ts", *(F.col("data")[c].alias(f"cell_{c}") for c in ("id", "province_id", "trade_body", "course_id", "type")))


def dim_job_table(spark: SparkSession, sf: str) -> DataFrame:
    """The dimension job into keyed tables, all in one write, then one of them read back."""
    root = f"{scratch(spark)}/dims-{uuid.uuid4().hex}"
    config, tables = ConfigTable(spark, f"{root}/config", ["source_table"]), KeyedTables(spark, f"{root}/tables")
    config.apply(_config(spark), 0)
    tables.put(detail.dim_puts(change_texts(spark, sf), config.read()), 0)
    return jobs.dim_table(config, tables, "dim_order_info").select(F.col("id").cast("long").alias("id"), "province_id", "trade_body")


def dim_config_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The dimension job as a stream whose configuration changes half-way: even orders come first; then one table is made
    anew with another column, one is added and one stays, and odd orders follow. All three tables, as they stand."""
    root = f"{scratch(spark)}/dim-stream-{uuid.uuid4().hex}"
    config, tables = ConfigTable(spark, f"{root}/config", ["source_table"]), KeyedTables(spark, f"{root}/tables")
    row = lambda op, ts, table, key, columns: (json.dumps({"op": op, "ts_ms": ts, "after": {"source_table": table, "sink_table": f"dim_{table}", "sink_columns": columns, "sink_pk": key}}),)
    steps = [[row("r", 1, "order_info", "id", "id,province_id"), row("r", 1, "order_detail", "id", "id,course_id")], [row("u", 2, "order_info", "id", "id,trade_body"), row("c", 2, "payment_info", "order_id", "order_id,payment_status"), row("r", 2, "order_detail", "id", "id,course_id")]]
    for k, events in enumerate(steps):
        # each order's records are written once, straight into the topic's part
        _changes(spark, sf, k).write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(f"{root}/all/part={k}")
        spark.createDataFrame(events, "value string").coalesce(1).write.mode("append").text(f"{root}/conf")
        jobs.control(readers.change_capture(readers.file_topic(spark, f"{root}/conf")), config, f"{root}/cp-conf")
        jobs.dim(readers.file_topic(spark, f"{root}/all/part=[0-{k}]"), config, tables, f"{root}/cp")
    of = lambda name, key, cell: jobs.dim_table(config, tables, name).select(F.lit(name).alias("name"), F.col(key).alias("id"), F.col(cell).alias("cell"))
    return of("dim_order_info", "id", "trade_body").unionByName(of("dim_payment_info", "order_id", "payment_status")).unionByName(of("dim_order_detail", "id", "course_id"))


def dwd_base_log(spark: SparkSession, sf: str) -> DataFrame:
    """Application logs, broken and incomplete ones among them, through the log job: every output of every record."""
    event = F.col("event_id").cast("string")
    more = _t(spark, sf, "events").select(F.explode(F.filter(F.array(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"broken '), event)), F.when(F.col("event_id") % 70 == 0, F.concat(F.lit('{"ts": '), event, F.lit("}")))), lambda x: x.isNotNull())).alias("value"))
    out = detail.log_job(log_texts(spark, sf).unionByName(more))
    return out.select("output", F.col("common.mid").alias("mid"), F.col("common.is_new").alias("is_new"), F.col("page.page_id").alias("page_id"), "err", F.when(F.col("output") != "incomplete", F.col("ts")).alias("millis"), "value")


def dwd_base_db(spark: SparkSession, sf: str) -> DataFrame:
    """Change records by table and type to their sinks."""
    cfg = spark.createDataFrame([("order_info", "insert", "dwd_order", "id,trade_body"), ("payment_info", "update", "dwd_paid", "order_id,payment_status"), ("order_detail", "update", "dwd_fixed", "id")], "source_table string, source_type string, sink_table string, sink_columns string")
    out = detail.base_db(change_texts(spark, sf), cfg)
    return out.select("sink_table", F.col("data")["id"].alias("id"), F.col("data")["order_id"].alias("order_id"), F.col("data")["trade_body"].alias("trade_body"), F.col("data")["payment_status"].alias("payment_status"), "ts")


def dwd_unique_visitors(spark: SparkSession, sf: str) -> DataFrame:
    return detail.unique_visitors(pages(spark, sf)).select("mid", "day", F.col("ts").alias("millis"))


def dwd_user_jumps(spark: SparkSession, sf: str) -> DataFrame:
    return detail.user_jumps(pages(spark, sf), within=6 * 3_600_000).select("mid", F.col("ts").alias("millis"))


def sequence_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Three patterns over the events of each user, all matches and timeouts: a bounce, a funnel and a mixed one."""
    e = _t(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("millis"))
    is_ = lambda kind: f"event_type = '{kind}'"
    hour, begin = 3_600_000, patterns.Pattern.begin
    found = {
        "bounce": begin("first", is_("view")).next("second", is_("view")).within(6 * hour),
        "funnel": begin("view", is_("view")).followed_by("click", is_("click")).followed_by("buy", is_("purchase")).within(48 * hour),
        "mixed": begin("signup", is_("signup")).followed_by("view", is_("view")).next("click", is_("click")).within(24 * hour),
    }
    out = None
    for name, pattern in found.items():
        rows = patterns.match(e, pattern, ["user_id"], "millis", ["millis", "event_id"]).select(F.lit(name).alias("pattern"), "event_id", F.col("_outcome").alias("outcome"), F.size("_at").cast("long").alias("steps"), F.try_element_at("_at", F.lit(-1)).alias("last_millis"))
        out = rows if out is None else out.unionByName(rows)
    return out


def session_entries(spark: SparkSession, sf: str) -> DataFrame:
    return parse.session_entries(pages(spark, sf)).select(F.col("common.sid").alias("sid"), F.col("page.page_id").alias("page_id"))


def pages_in(spark: SparkSession, sf: str) -> DataFrame:
    return parse.pages_in(pages(spark, sf)).select(F.col("common.sid").alias("sid"), F.col("page.page_id").alias("page_id"))


def search_rows(spark: SparkSession, sf: str) -> DataFrame:
    return parse.search_rows(pages(spark, sf)).select("fullword", F.col("ts").alias("millis"))


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that the detail jobs take from change records and logs, by kind: parsed strictly, so a broken record fails."""
    records = parse.dwd_etl(_records(spark, sf, strict=True))
    kinds = {"detail": parse.order_detail_rows(records).select("id", F.col("create_time").alias("a"), F.col("final_amount").alias("b"), "ts"), "info": parse.order_info_rows(records).select("id", F.col("session_id").alias("a"), F.col("out_trade_no").alias("b"), F.col("info_ts").alias("ts"))}
    kinds["paid"] = parse.payment_success_rows(records).select(F.col("order_id").alias("id"), F.col("callback_time").alias("a"), F.col("payment_type").alias("b"), "ts")
    kinds["visit"] = parse.order_page_rows(pages(spark, sf)).select(F.col("session_id").alias("id"), F.col("source_id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("page_ts").alias("ts"))
    out = None
    for name, rows in kinds.items():
        rows = rows.withColumn("kind", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def topic_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Change records of a topic with their event time, tombstones and empty payloads skipped."""
    raw = change_texts(spark, sf)
    raw = raw.unionByName(spark.createDataFrame([(None,), ("",)], "value string"))
    return readers.topic_db(raw).groupBy("table", "type", timefn.partition_text("et").alias("day")).agg(F.count("*").alias("n"))


def detail_json(spark: SparkSession, sf: str) -> DataFrame:
    """Details written as JSON texts and read again as a topic: the round trip keeps each."""
    raw = parse.as_json(details(spark, sf).select("id", "order_id", "user_id", "final_amount", "ts"))
    return readers.detail_topic(raw, schemas.ORDER_DETAIL).select("id", "order_id", "user_id", "final_amount", "ts", "session_id")


def upserted_details(spark: SparkSession, sf: str) -> DataFrame:
    """Details upserted in three batches, the middle one twice and compacted after it, then read by key."""
    path, columns = f"{scratch(spark)}/upsert-{uuid.uuid4().hex}", ["id", "final_amount", "version", "row_op_ts", "arrival"]
    # the batches' source, joined once
    details(spark, sf).withColumn("version", F.lit(0)).select(*columns).write.option("compression", "zstd").option("maxRecordsPerFile", RECORDS).parquet(f"{path}-rows")
    rows, write = spark.read.parquet(f"{path}-rows"), sinks.upsert(path, "id", ["row_op_ts", "arrival"], columns)
    write(rows, 0)
    for _ in range(2):
        write(rows.filter("arrival % 2 = 0").withColumn("version", F.lit(1)), 1)
    sinks.compact_upserted(spark, path, "id")
    write(rows.filter("arrival % 5 = 0").withColumn("version", F.lit(2)), 2)
    return sinks.read_upserted(spark, path, "id").select("id", "version")


def summary_store(spark: SparkSession, sf: str) -> DataFrame:
    """Window rows appended to their table by day, and one day of it read by the dashboard's query of sources."""
    root, name = f"{scratch(spark)}/dws-{uuid.uuid4().hex}", "dws_traffic_vc_ch_ar_visitor_category_page_view_window"
    sinks.append_summary(_run(spark, sf, name), root, name)
    return serving.source_visitors(readers.summary_tables(spark, root, [name])[name], DAY)


def source_orders(spark: SparkSession, sf: str) -> DataFrame:
    return serving.source_orders(_run(spark, sf, "dws_trade_source_order_window"), SOLD)


def keyword_cloud(spark: SparkSession, sf: str) -> DataFrame:
    return serving.keyword_cloud(_run(spark, sf, "dws_traffic_source_keyword_page_view_window"), DAY)


def province_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return serving.province_amounts(_run(spark, sf, "dws_trade_province_order_window"), SOLD)


def question_rates(spark: SparkSession, sf: str) -> DataFrame:
    return serving.question_accuracy(_run(spark, sf, "dws_examination_question_answer_window"), SOLD)


def score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return serving.score_distribution(_run(spark, sf, "dws_examination_paper_score_duration_exam_window"), SOLD)


def time_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Each time function on the orders' dates."""
    o = _t(spark, sf, "orders").select("o_orderkey", epoch_seconds("o_orderdate").alias("s"))
    at = timefn.from_seconds("s")
    text = timefn.date_time_text(at)
    return o.select("o_orderkey", timefn.date_text(at).alias("date_text"), text.alias("time_text"), timefn.partition_text(timefn.from_millis(F.col("s") * 1000)).alias("day"), timefn.millis_of_text(text).alias("millis_east"), timefn.row_op_instant(F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit(".5Z"))).cast("double").alias("instant"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _job(n, rows) for n, rows in JOBS.items()} | {
    f.__name__: f
    for f in (
        dwd_order_detail, dwd_pay_success, config_replay, cdc_snapshot, dim_route, dim_job_table, dim_config_stream, dwd_base_db, dwd_base_log, dwd_unique_visitors, dwd_user_jumps, sequence_patterns, session_entries, pages_in, search_rows, order_rows,
        topic_rows, detail_json, upserted_details, summary_store, source_orders, keyword_cloud, province_amounts, question_rates, score_distribution, time_functions,
    )
}

STAMPS = "strftime(w, '%Y-%m-%d %H:%M:%S') AS stt, strftime(w + INTERVAL 10 SECOND, '%Y-%m-%d %H:%M:%S') AS edt, strftime(w, '%Y-%m-%d') AS cur_date"
P = """SELECT *, make_timestamp(millis // 10000 * 10000000) AS w, strftime(make_timestamp(millis * 1000), '%Y-%m-%d') AS day FROM (
    SELECT CAST(user_id AS VARCHAR) AS mid, CAST(k % 2 AS VARCHAR) AS is_new, 's' || event_id AS sid, CAST(k % 10 AS VARCHAR) AS sc, 'v' || (k % 3) AS vc, CAST(k % 30 AS VARCHAR) AS ar,
           CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'course_list' WHEN 'purchase' THEN 'course_detail' WHEN 'signup' THEN 'order' END AS page_id, k % 3 = 0 AS entry, k * 10 AS during, k, epoch_us(ts) // 1000 AS millis
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) WHERE page_id IS NOT NULL"""
D = """SELECT *, make_timestamp(ts // 10 * 10000000) AS w, strftime(sold, '%Y-%m-%d') AS day FROM (
    SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey % 50 AS VARCHAR) AS course_id, CAST(o_custkey % 27 AS VARCHAR) AS province_id,
           CASE l_suppkey % 3 WHEN 1 THEN '' WHEN 2 THEN CAST(l_suppkey % 10 AS VARCHAR) END AS source_id, CAST(trunc(l_quantity) AS BIGINT) AS amount, o_orderdate AS sold, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, l_shipdate AS row_op_ts, l_partkey * 100000 + l_suppkey AS arrival
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
L = f"SELECT * FROM ({D}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_op_ts DESC, arrival DESC) = 1"
S = f"SELECT * FROM ({D}) WHERE source_id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_op_ts DESC, arrival DESC) = 1"
LINES = "SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS made, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
ORDERS = "SELECT *, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS made, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts FROM orders"
X = "SELECT CAST(l_partkey % 300 AS VARCHAR) AS paper, CASE WHEN l_linenumber <> 7 THEN l_quantity * 2.5 - 5 END AS score, l_linenumber AS n, make_timestamp(CAST(floor(epoch(l_shipdate)) AS BIGINT) // 10 * 10000000) AS w FROM lineitem"
BAND = "CASE WHEN coalesce(score, 0) < 60 THEN '[0,60)' WHEN score < 70 THEN '[60,70)' WHEN score < 80 THEN '[70,80)' WHEN score < 90 THEN '[80,90)' WHEN score <= 100 THEN '[90,100]' ELSE '' END"
COUNTED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) = 1 AS fresh FROM ({l}) QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts, id) = 1"
DETAIL = f"""SELECT d.id, CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey % 50 AS VARCHAR) AS course_id, CAST(o_custkey % 27 AS VARCHAR) AS province_id, substr(made, 1, 10) AS date_id, 's' || l_orderkey AS session_id, sc AS source_id, made AS create_time,
    CAST(q AS VARCHAR) AS origin_amount, '1' AS coupon_reduce_amount, CAST(q - 1 AS VARCHAR) AS final_amount, 't' || l_orderkey AS out_trade_no, o_orderpriority AS trade_body, d.ts, o_orderstatus, made, o_custkey
    FROM ({LINES}) d LEFT JOIN (SELECT sid, sc FROM ({P}) WHERE page_id = 'order') v ON sid = 's' || l_orderkey WHERE l_linenumber <> 6"""
SOURCE = f"""SELECT {{stamp}} source_id, n_name AS source_name, min(order_id) AS order_id, CAST(sum(amount) AS DOUBLE) AS order_total_amount, count(*) FILTER (uu) AS order_uu_count, count(*) FILTER (one) AS order_count
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, source_id, day ORDER BY ts, id) = 1 AS uu, row_number() OVER (PARTITION BY order_id ORDER BY ts, id) = 1 AS one FROM ({S})) LEFT JOIN nation ON source_id = CAST(n_nationkey AS VARCHAR) GROUP BY w, source_id, n_name"""
PROVINCE = f"""SELECT {{stamp}} province_id, coalesce(n_name, '') AS province_name, '' AS user_id, CAST(sum(amount) AS DECIMAL(26,2)) AS order_total_amount, count(*) FILTER (uu) AS order_uu_count, count(DISTINCT order_id) AS order_count
    FROM (SELECT *, row_number() OVER (PARTITION BY province_id, user_id, day ORDER BY ts, id) = 1 AS uu FROM ({L})) LEFT JOIN nation ON province_id = CAST(n_nationkey AS VARCHAR) GROUP BY w, province_id, n_name"""
ON_SOLD = "'1998-01-05'"

ORACLE_SQL: dict[str, str] = {
    "sequence_patterns": """
        WITH e AS (SELECT event_id, user_id, event_type AS k, epoch_us(ts) // 1000 AS ms FROM events),
             n AS (SELECT *, lead(k) OVER w AS nk, lead(ms) OVER w AS nx, first_value(CASE WHEN k = 'purchase' THEN ms END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS buy FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
             f AS (SELECT *, first_value(CASE WHEN k = 'click' THEN {'a': ms, 'b': buy} END IGNORE NULLS) OVER w AS c, first_value(CASE WHEN k = 'view' THEN {'a': ms, 'nk': nk, 'nx': nx} END IGNORE NULLS) OVER w AS v
                   FROM n WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
             o AS (SELECT 'bounce' AS pattern, event_id, CASE WHEN nx IS NULL OR nx - ms >= 21600000 THEN 0 WHEN nk = 'view' THEN 1 END AS steps, 1 AS whole, nx AS first_, NULL AS second_ FROM f WHERE k = 'view'
                   UNION ALL SELECT 'funnel', event_id, CASE WHEN c.a IS NULL OR c.a - ms >= 172800000 THEN 0 WHEN c.b IS NULL OR c.b - ms >= 172800000 THEN 1 ELSE 2 END, 2, c.a, c.b FROM f WHERE k = 'view'
                   UNION ALL SELECT 'mixed', event_id, CASE WHEN v.a IS NULL OR v.a - ms >= 86400000 THEN 0 WHEN v.nx IS NULL OR v.nx - ms >= 86400000 THEN 1 WHEN v.nk = 'click' THEN 2 END, 2, v.a, v.nx FROM f WHERE k = 'signup')
        SELECT pattern, event_id, CASE WHEN steps = whole THEN 'match' ELSE 'timeout' END AS outcome, CAST(steps AS BIGINT) AS steps, CASE steps WHEN 1 THEN first_ WHEN 2 THEN second_ END AS last_millis FROM o WHERE steps IS NOT NULL""",
    "dim_config_stream": f"""
        SELECT 'dim_order_info' AS name, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS cell FROM orders WHERE o_orderkey % 2 = 1
        UNION ALL SELECT 'dim_payment_info', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderstatus = 'F' THEN '1602' ELSE '1601' END FROM orders WHERE o_orderkey % 2 = 1
        UNION ALL SELECT DISTINCT 'dim_order_detail', id, CAST(l_partkey % 50 AS VARCHAR) FROM ({LINES})""",
    "dwd_base_log": """
        WITH e AS (SELECT CAST(user_id AS VARCHAR) AS mid, k % 2 AS fresh, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) // 1000 AS millis, CASE event_type WHEN 'error' THEN 'failed' END AS err,
                          CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'course_list' WHEN 'purchase' THEN 'course_detail' WHEN 'signup' THEN 'order' END AS page_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
             f AS (SELECT *, CASE WHEN fresh = 1 AND first_value(fresh) OVER w = 1 AND first_value(day) OVER w = day THEN '1' ELSE '0' END AS is_new FROM e WINDOW w AS (PARTITION BY mid ORDER BY millis))
        SELECT 'page' AS output, mid, is_new, page_id, NULL AS err, millis, NULL AS value FROM f WHERE page_id IS NOT NULL
        UNION ALL SELECT 'err', mid, is_new, page_id, err, millis, NULL FROM f WHERE err IS NOT NULL
        UNION ALL SELECT 'dirty', NULL, NULL, NULL, NULL, NULL, '{"broken ' || event_id FROM events WHERE event_id % 50 = 0
        UNION ALL SELECT 'incomplete', NULL, NULL, NULL, NULL, NULL, '{"ts": ' || event_id || '}' FROM events WHERE event_id % 70 = 0""",
    "dws_traffic_source_keyword_page_view_window": f"SELECT {STAMPS}, keyword, count(*) AS keyword_count FROM (SELECT w, unnest(['big', 'data', CAST(k AS VARCHAR)]) AS keyword FROM ({P}) WHERE k % 4 = 0) GROUP BY w, keyword",
    "dws_traffic_vc_ch_ar_visitor_category_page_view_window": f"""
        WITH f AS (SELECT *, row_number() OVER (PARTITION BY mid, day ORDER BY millis, page_id) = 1 AS uv FROM ({P})),
             g AS (SELECT w, vc, sc, ar, is_new, count(*) FILTER (uv) AS uv_count, count(*) FILTER (entry) AS total_session_count, count(*) AS page_view_count, CAST(sum(during) AS BIGINT) AS total_during_time FROM f GROUP BY ALL)
        SELECT {STAMPS}, vc AS version_code, sc AS source_id, a.n_name AS source_name, ar, is_new, coalesce(b.n_name, '') AS province_name, uv_count, total_session_count, page_view_count, total_during_time
        FROM g LEFT JOIN nation a ON sc = CAST(a.n_nationkey AS VARCHAR) LEFT JOIN nation b ON ar = CAST(b.n_nationkey AS VARCHAR)""",
    "dws_traffic_home_course_detail_page_view_window": f"""
        WITH f AS (SELECT * FROM ({P}) WHERE page_id <> 'order' QUALIFY row_number() OVER (PARTITION BY mid, page_id, day ORDER BY millis) = 1)
        SELECT {STAMPS}, count(*) FILTER (page_id = 'home') AS home_uv_count, count(*) FILTER (page_id = 'course_list') AS list_uv_count, count(*) FILTER (page_id = 'course_detail') AS detail_uv_count FROM f GROUP BY w""",
    "dws_trade_cart_add_window": f"""
        WITH f AS (SELECT *, make_timestamp(s // 10 * 10000000) AS w FROM (SELECT user_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE event_type = 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY s) = 1)
        SELECT {STAMPS}, count(*) AS cart_add_uv_count FROM f GROUP BY w""",
    "dws_trade_order_window": f"SELECT {STAMPS}, count(*) AS order_uv_count, count(*) FILTER (fresh) AS new_order_user_count FROM ({COUNTED.format(l=L)}) GROUP BY w",
    "dws_trade_pay_suc_window": f"SELECT {STAMPS}, count(*) AS pay_suc_uv_count, count(*) FILTER (fresh) AS pay_suc_new_user_count FROM ({COUNTED.format(l=L)}) GROUP BY w",
    "dws_trade_course_order_window": f"""
        WITH g AS (SELECT w, course_id, CAST(sum(amount) AS DOUBLE) AS order_total_amount FROM ({L}) GROUP BY 1, 2)
        SELECT {STAMPS}, course_id, s_name AS course_name, CAST(s_nationkey AS VARCHAR) AS subject_id, n_name AS subject_name, CAST(n_regionkey AS VARCHAR) AS category_id, r_name AS category_name, order_total_amount
        FROM g LEFT JOIN supplier ON course_id = CAST(s_suppkey AS VARCHAR) LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "dws_trade_source_order_window": SOURCE.format(stamp=STAMPS + ","),
    "dws_trade_province_order_window": PROVINCE.format(stamp=STAMPS + ","),
    "dws_examination_paper_exam_window": f"""
        WITH g AS (SELECT w, paper, count(*) AS exam_taken_count, CAST(sum(CAST(trunc(coalesce(score, 0)) AS BIGINT)) AS BIGINT) AS exam_total_score, CAST(sum(n) AS BIGINT) AS exam_total_during_sec FROM ({X}) GROUP BY 1, 2)
        SELECT {STAMPS}, paper AS paper_id, p_name AS paper_title, CAST(p_size % 9 AS VARCHAR) AS course_id, s_name AS course_name, exam_taken_count, exam_total_score, exam_total_during_sec FROM g LEFT JOIN part ON paper = CAST(p_partkey AS VARCHAR) LEFT JOIN supplier ON p_size % 9 = s_suppkey""",
    "dws_examination_paper_score_duration_exam_window": f"SELECT {STAMPS}, paper AS paper_id, p_name AS paper_title, score_duration, count(*) AS user_count FROM (SELECT *, {BAND} AS score_duration FROM ({X})) LEFT JOIN part ON paper = CAST(p_partkey AS VARCHAR) GROUP BY w, paper, p_name, score_duration",
    "dws_examination_question_answer_window": f"SELECT {STAMPS}, paper AS question_id, p_name AS question_txt, count(*) FILTER (n % 2 = 1 AND n <> 7) AS correct_answer_count, count(*) AS answer_count FROM ({X}) LEFT JOIN part ON paper = CAST(p_partkey AS VARCHAR) GROUP BY w, paper, p_name",
    "dwd_order_detail": f"SELECT id, order_id, user_id, course_id, province_id, date_id, session_id, source_id, create_time, origin_amount, coupon_reduce_amount, final_amount, out_trade_no, trade_body, ts FROM ({DETAIL})",
    "dwd_pay_success": f"SELECT id, order_id, user_id, course_id, province_id, CAST(o_custkey % 3 AS VARCHAR) AS payment_type, '1602' AS payment_status, made AS callback_time, origin_amount AS original_amount, coupon_reduce_amount, final_amount, ts + 60 AS ts FROM ({DETAIL}) WHERE o_orderstatus = 'F'",
    "config_replay": "SELECT * FROM (VALUES ('order_info', 'dim_order_info', 'id,province_id,trade_body'), ('order_detail', 'dim_order_detail', 'id,course_id')) AS t(source_table, sink_table, sink_columns)",
    "cdc_snapshot": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'first' END AS v FROM orders WHERE o_orderstatus <> 'F'",
    "dim_route": f"""
        SELECT 'dim_order_info' AS sink_table, 'id' AS sink_pk, 'insert' AS type, ts, CAST(o_orderkey AS VARCHAR) AS cell_id, CAST(o_custkey % 27 AS VARCHAR) AS cell_province_id, o_orderpriority AS cell_trade_body, NULL AS cell_course_id, 'insert' AS cell_type FROM ({ORDERS})
        UNION ALL SELECT 'dim_order_detail', 'id', op, ts, id, NULL, NULL, CAST(l_partkey % 50 AS VARCHAR), op FROM (SELECT *, CASE l_linenumber WHEN 6 THEN 'update' ELSE 'insert' END AS op FROM ({LINES}))""",
    "dim_job_table": "SELECT o_orderkey AS id, CAST(o_custkey % 27 AS VARCHAR) AS province_id, o_orderpriority AS trade_body FROM orders",
    "dwd_base_db": f"""
        SELECT 'dwd_order' AS sink_table, CAST(o_orderkey AS VARCHAR) AS id, NULL AS order_id, o_orderpriority AS trade_body, NULL AS payment_status, ts FROM ({ORDERS})
        UNION ALL SELECT 'dwd_paid', NULL, CAST(o_orderkey AS VARCHAR), NULL, CASE o_orderstatus WHEN 'F' THEN '1602' ELSE '1601' END, ts + 60 FROM ({ORDERS})
        UNION ALL SELECT 'dwd_fixed', id, NULL, NULL, NULL, ts FROM ({LINES}) WHERE l_linenumber = 6""",
    "dwd_unique_visitors": f"SELECT mid, day, millis FROM ({P}) WHERE entry QUALIFY row_number() OVER (PARTITION BY mid, day ORDER BY millis) = 1",
    "dwd_user_jumps": f"""
        WITH f AS (SELECT *, lead(millis) OVER o AS then_ms, lead(entry) OVER o AS then_entry FROM ({P}) WINDOW o AS (PARTITION BY mid ORDER BY millis))
        SELECT mid, millis FROM f WHERE entry AND (then_ms IS NULL OR then_ms - millis >= 21600000 OR then_entry)""",
    "session_entries": f"SELECT sid, page_id FROM ({P}) WHERE entry",
    "pages_in": f"SELECT sid, page_id FROM ({P}) WHERE page_id <> 'order'",
    "search_rows": f"SELECT 'Big Data ' || k AS fullword, millis FROM ({P}) WHERE k % 4 = 0",
    "order_rows": f"""
        SELECT 'detail' AS kind, id, made AS a, CAST(q - 1 AS VARCHAR) AS b, ts FROM ({LINES}) WHERE l_linenumber <> 6
        UNION ALL SELECT 'info', CAST(o_orderkey AS VARCHAR), 's' || o_orderkey, 't' || o_orderkey, ts FROM ({ORDERS})
        UNION ALL SELECT 'paid', CAST(o_orderkey AS VARCHAR), made, CAST(o_custkey % 3 AS VARCHAR), ts + 60 FROM ({ORDERS}) WHERE o_orderstatus = 'F'
        UNION ALL SELECT 'visit', sid, sc, NULL, millis FROM ({P}) WHERE page_id = 'order'""",
    "topic_rows": f"""
        WITH u AS (SELECT 'order_detail' AS "table", CASE l_linenumber WHEN 6 THEN 'update' ELSE 'insert' END AS type, ts FROM ({LINES}) UNION ALL SELECT 'order_info', 'insert', ts FROM ({ORDERS}) UNION ALL SELECT 'payment_info', 'update', ts + 60 FROM ({ORDERS}))
        SELECT "table", type, strftime(make_timestamp(ts * 1000000), '%Y%m%d') AS day, count(*) AS n FROM u GROUP BY ALL""",
    "detail_json": f"SELECT id, order_id, user_id, CAST(amount AS VARCHAR) AS final_amount, ts, CAST(NULL AS VARCHAR) AS session_id FROM ({D})",
    "upserted_details": f"SELECT id, CASE WHEN bool_or(arrival % 5 = 0) THEN 2 WHEN bool_or(arrival % 2 = 0) THEN 1 ELSE 0 END AS version FROM ({D}) GROUP BY id",
    "source_orders": f"SELECT source_name, CAST(sum(order_total_amount) AS DOUBLE) AS order_total_amount, CAST(sum(order_uu_count) AS BIGINT) AS order_uu_count, CAST(sum(order_count) AS BIGINT) AS order_count FROM ({SOURCE.format(stamp=STAMPS + ',')}) WHERE cur_date = {ON_SOLD} GROUP BY 1",
    "summary_store": f"SELECT n_name AS source_name, count(DISTINCT mid) FILTER (first_sc) AS uv_count FROM (SELECT *, row_number() OVER (PARTITION BY mid, day ORDER BY millis, page_id) = 1 AS first_sc FROM ({P})) LEFT JOIN nation ON sc = CAST(n_nationkey AS VARCHAR) WHERE day = '2024-01-05' GROUP BY 1",
    "keyword_cloud": f"SELECT keyword, count(*) AS keyword_count FROM (SELECT unnest(['big', 'data', CAST(k AS VARCHAR)]) AS keyword FROM ({P}) WHERE k % 4 = 0 AND day = '2024-01-05') GROUP BY 1",
    "province_amounts": f"SELECT province_name, CAST(sum(order_total_amount) AS DECIMAL(36,2)) AS order_total_amount FROM ({PROVINCE.format(stamp=STAMPS + ',')}) WHERE cur_date = {ON_SOLD} GROUP BY 1",
    "question_rates": f"""
        WITH g AS (SELECT paper AS question_id, p_name, count(*) FILTER (n % 2 = 1 AND n <> 7) AS c, count(*) AS a FROM ({X}) LEFT JOIN part ON paper = CAST(p_partkey AS VARCHAR) WHERE strftime(w, '%Y-%m-%d') = {ON_SOLD} GROUP BY 1, 2)
        SELECT question_id, substr(md5(p_name), 1, 10) AS question_txt, c AS correct_answer_count, a AS answer_count, c / a AS accuracy_rate FROM g""",
    "score_distribution": f"SELECT paper AS paper_id, p_name AS paper_title, {BAND} AS score_duration, count(*) AS user_count FROM ({X}) LEFT JOIN part ON paper = CAST(p_partkey AS VARCHAR) WHERE strftime(w, '%Y-%m-%d') = {ON_SOLD} GROUP BY ALL",
    "time_functions": f"SELECT o_orderkey, substr(made, 1, 10) AS date_text, made AS time_text, replace(substr(made, 1, 10), '-', '') AS day, (ts - 28800) * 1000 AS millis_east, ts + 0.5 AS instant FROM ({ORDERS})",
}
