"""Jobs on literal rows, in batch and in streams that must agree, and the dashboard over their tables."""

import json

import pytest
from pyspark.sql import functions as F

from tidewright.operators import serving, stateful
from tidewright.operators.windows import tumbling
from tidewright.plans import detail, schemas
from tidewright.plans.summary import summary_jobs
from tidewright.sources import readers, sinks
from tidewright.streaming import flows, processors

T0 = 1_704_067_200  # 2024-01-01 00:00:00 UTC
DIMS = {
    "dim_base_source": [("1", "site one")], "dim_base_province": [("11", "Beijing")], "dim_test_paper": [("p1", "Paper", "c1")], "dim_course_info": [("c1", "Course", "s1")],
    "dim_base_subject_info": [("s1", "Subject", "g1")], "dim_base_category_info": [("g1", "Category")], "dim_test_question_info": [("q1", "What?")],
}
DIM_SCHEMA = {
    "dim_base_source": "id string, source_site string", "dim_base_province": "id string, name string", "dim_test_paper": "id string, paper_title string, course_id string",
    "dim_course_info": "id string, course_name string, subject_id string", "dim_base_subject_info": "id string, subject_name string, category_id string",
    "dim_base_category_info": "id string, category_name string", "dim_test_question_info": "id string, question_txt string",
}


def dimensions(spark):
    return {n: spark.createDataFrame(r, DIM_SCHEMA[n]) for n, r in DIMS.items()}


def details(spark, far=False):
    cols = ["id", "order_id", "user_id", "course_id", "province_id", "source_id", "final_amount", "ts", "row_op_ts"]
    rows = [
        ("d1", "o1", "u1", "c1", "11", "1", "10.5", T0 + 1, 1), ("d1", "o1", "u1", "c1", "11", "1", "11.5", T0 + 1, 3), ("d1", "o1", "u1", "c1", "11", "1", "9.0", T0 + 1, 2), ("d2", "o1", "u1", "c9", "11", "1", "2.0", T0 + 2, 1),
        ("d3", "o2", "u2", "c1", "99", "", "4.0", T0 + 12, 1), ("d4", "o3", "u1", "c1", None, None, "1.0", T0 + 86_401, 1), ("d5", "o4", "u1", None, "11", "2", "3.0", T0 + 86_402, 1),
    ]
    if far:
        rows.append(("far", "far", "far", "far", "far", "far", "0", T0 + 900_000, 1))
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'ts' else 'int' if c == 'row_op_ts' else 'string'}" for c in cols))
    return df.withColumn("row_op_ts", F.timestamp_seconds("row_op_ts"))


def pages(spark, far=False):
    def page(mid, ts, page_id, last=None, new="1", sc="1", ar="11", **more):
        return json.dumps({"common": {"mid": mid, "is_new": new, "sc": sc, "vc": "v1", "ar": ar}, "page": {"page_id": page_id, "last_page_id": last, "during_time": 100} | more, "ts": ts})

    ms = T0 * 1000
    rows = [page("a", ms, "home"), page("a", ms + 1000, "home", "x"), page("a", ms + 2000, "course_list", "home"), page("b", ms + 3000, "course_detail", ar="77"), page("b", ms + 14_000, "home", sc="5"), page("a", ms + 86_400_000, "home"), page("c", ms + 5000, "s", "home", item="Big Data big", item_type="keyword")]
    if far:
        rows.append(page("far", ms + 900_000_000, "home", "x", new="0", item="far", item_type="keyword"))
    return detail.parse.logs(spark.createDataFrame([(r,) for r in rows], "value string")).drop("displays", "actions", "err")


def exams(spark, far=False):
    rows = [("p1", 59.9, 10, T0), ("p1", 60.0, 20, T0 + 1), ("p1", None, None, T0 + 2), ("p2", 100.0, 5, T0 + 11)] + ([("far", 0.0, 0, T0 + 900_000)] if far else [])
    return spark.createDataFrame(rows, schemas.TEST_PAPER)


def answers(spark, far=False):
    rows = [("q1", "1", T0), ("q1", "0", T0), ("q1", None, T0 + 3), ("q2", "1", T0 + 4)] + ([("far", "1", T0 + 900_000)] if far else [])
    return spark.createDataFrame(rows, schemas.TEST_QUESTION)


def carts(spark, far=False):
    rows = [("u1", T0), ("u1", T0 + 1), ("u2", T0 + 2), ("u1", T0 + 86_400)] + ([("far", T0 + 900_000)] if far else [])
    return spark.createDataFrame(rows, schemas.CART_ADD)


INPUT = {"traffic": pages, "cart": carts, "order": details, "pay": details, "course": details, "source": details, "province": details, "paper": exams, "question": answers}


def rows_for(name, spark, far=False):
    kind = "question" if "question" in name else "paper" if "examination" in name else "traffic" if "traffic" in name else name.split("_")[2]
    return INPUT[kind](spark, far)


def plain(df, names):
    return sorted((tuple(str(r[c]) for c in names) for r in df.collect()), key=repr)


def test_summary_results(spark):
    jobs, d = summary_jobs(), dimensions(spark)
    run = lambda name: jobs[name].batch(rows_for(name, spark), d).collect()
    assert [(r.order_uv_count, r.new_order_user_count) for r in sorted(run("dws_trade_order_window"))] == [(1, 1), (1, 1), (1, 0)]
    course = {(r.stt[-8:], r.course_id): r for r in run("dws_trade_course_order_window")}
    assert course["00:00:00", "c1"].order_total_amount in (11.5, 12.5, 1.0) and {r.category_name for r in course.values()} == {"Category", None}
    source = sorted((r.stt, r.source_id, r.source_name, r.order_total_amount, r.order_uu_count, r.order_count) for r in run("dws_trade_source_order_window"))
    assert source == [("2024-01-01 00:00:00", "1", "site one", 13.5, 1, 1), ("2024-01-02 00:00:00", "2", None, 3.0, 1, 1)]
    province = {(r.stt, r.province_id): r for r in run("dws_trade_province_order_window")}
    assert str(province["2024-01-01 00:00:00", "11"].order_total_amount) == "13.50" and province["2024-01-01 00:00:00", "11"].order_count == 1
    assert province["2024-01-01 00:00:10", "99"].province_name == ""
    first = sorted((r.stt, r.home_uv_count, r.list_uv_count, r.detail_uv_count) for r in run("dws_traffic_home_course_detail_page_view_window"))
    assert first == [("2024-01-01 00:00:00", 1, 1, 1), ("2024-01-01 00:00:10", 1, 0, 0), ("2024-01-02 00:00:00", 1, 0, 0)]
    words = {r.keyword: r.keyword_count for r in run("dws_traffic_source_keyword_page_view_window")}
    assert words == {"big": 2, "data": 1}
    paper = {r.paper_id: r for r in run("dws_examination_paper_exam_window")}
    assert (paper["p1"].exam_taken_count, paper["p1"].exam_total_score, paper["p1"].exam_total_during_sec, paper["p1"].course_name) == (3, 119, 30, "Course")
    bands = {(r.paper_id, r.score_duration): r.user_count for r in run("dws_examination_paper_score_duration_exam_window")}
    assert bands == {("p1", "[0,60)"): 2, ("p1", "[60,70)"): 1, ("p2", "[90,100]"): 1}
    asked = {r.question_id: (r.correct_answer_count, r.answer_count, r.question_txt) for r in run("dws_examination_question_answer_window")}
    assert asked == {"q1": (1, 3, "What?"), "q2": (1, 1, None)}
    carts = [r.cart_add_uv_count for r in sorted(run("dws_trade_cart_add_window"))]
    assert carts == [2, 1]


def test_literal_comparisons(spark):
    """To the letter, every later second counts as a visit, and every order of a returning day."""
    jobs = summary_jobs(literal=True)
    name = "dws_traffic_home_course_detail_page_view_window"
    assert sum(r.home_uv_count for r in jobs[name].batch(pages(spark)).collect()) == 4
    assert sum(r.order_uv_count for r in jobs["dws_trade_order_window"].batch(details(spark)).collect()) == 4


@pytest.mark.parametrize("name", sorted(summary_jobs()))
def test_stream_equals_batch(spark, tmp_path, name):
    """A stream over the same rows and a far later one gives the batch's windows; the last one stays open."""
    job, d = summary_jobs()[name], dimensions(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    far = rows_for(name, spark, far=True)
    src = str(tmp_path / "in")
    far.filter("ts < 1800000000000").coalesce(1).write.parquet(src)
    # a held row comes out when the watermark has passed it, so rows that push it on follow in files of their own
    push = far.filter(f"ts >= {(T0 + 800_000) * (1000 if 'traffic' in name else 1)}").withColumn("ts", F.col("ts") + (100_000_000 if "traffic" in name else 100_000))
    if "id" in push.columns:
        push = push.withColumn("id", F.lit("push"))
    push.coalesce(1).write.mode("append").parquet(src)
    stream = readers.table_stream(spark, src, sinks.schema_text(far.schema), most_files=1)
    flows.summary(spark, job, stream, d, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out" / name)).withColumn("cur_date", F.col("cur_date").cast("string"))
    want = job.batch(rows_for(name, spark), d)
    names = [c for c in want.columns if c != "user_id"]
    wanted = plain(want, names)
    assert [r for r in plain(got, names) if not r[0].startswith("2024-01-1")] == wanted


def test_window_stamps(spark):
    df = spark.createDataFrame([(T0 + 9,), (T0 + 10,)], "ts long").withColumn("et", F.timestamp_seconds("ts"))
    assert sorted(map(tuple, tumbling(df, "et", [], [F.count("*").alias("n")]).collect())) == [("2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01", 1), ("2024-01-01 00:00:10", "2024-01-01 00:00:20", "2024-01-01", 1)]


def test_base_log_and_visits(spark):
    ms = T0 * 1000
    rec = lambda ts, new, page: json.dumps({"common": {"mid": "m", "is_new": new}, "page": page, "ts": ts})
    raw = spark.createDataFrame([(rec(ms, "1", {"page_id": "home"}),), (rec(ms + 1000, "1", {"page_id": "b", "last_page_id": "home"}),), (rec(ms + 86_400_000, "1", {"page_id": "home"}),), ("bad",), ('{"ts": 1}',)], "value string")
    out = detail.base_log(raw)
    assert out["dirty"].count() == 1 and out["incomplete"].count() == 1
    assert [r.common.is_new for r in out["page"].orderBy("ts").collect()] == ["1", "1", "0"]
    assert [r.common.is_new for r in detail.base_log(raw, literal=True)["page"].orderBy("ts").collect()] == ["1", "0", "0"]
    assert [r.ts for r in detail.unique_visitors(out["page"]).orderBy("ts").collect()] == [ms, ms + 86_400_000]
    assert [r.ts for r in detail.user_jumps(out["page"]).orderBy("ts").collect()] == [ms + 86_400_000]
    assert detail.user_jumps(out["page"], literal=True).count() == 3


def test_detail_joins_and_upserts(spark, tmp_path):
    ch = lambda table, ts, kind="insert", **d: json.dumps({"database": "edu", "table": table, "type": kind, "ts": ts, "data": d})
    raw = spark.createDataFrame([(ch("order_detail", T0, id="1", order_id="o", user_id="u", create_time="2024-01-01 00:00:00", origin_amount="5", final_amount="4"),), (ch("order_detail", T0, id="2", order_id="p", create_time="2024-01-01 00:00:00"),), (ch("order_info", T0 + 1, id="o", session_id="s", province_id="11"),), (ch("order_info", T0 + 1, id="p", session_id="t"),), (ch("payment_info", T0 + 600, "update", order_id="o", payment_status="1602"),)], "value string")
    records = detail.parse.changes(raw)
    visits = detail.parse.logs(spark.createDataFrame([(json.dumps({"common": {"sid": "s", "sc": "7"}, "page": {"page_id": "order"}, "ts": T0 * 1000}),)], "value string"))
    out = detail.order_detail(records, visits)
    assert sorted((r.id, r.source_id, r.province_id) for r in out.collect()) == [("1", "7", "11"), ("2", None, None)]
    paid = detail.pay_success(records, out)
    assert [(r.id, r.original_amount, r.ts) for r in paid.collect()] == [("1", "5", T0 + 600)]
    write = sinks.upsert(str(tmp_path / "t"), "id", ["row_op_ts"], out.columns, richer="source_id")
    write(out.withColumn("source_id", F.lit(None).cast("string")), 0)
    write(out, 1)
    write(out, 1)
    now = sinks.read_upserted(spark, str(tmp_path / "t"), "id", richer="source_id")
    assert sorted((r.id, r.source_id) for r in now.collect()) == [("1", "7"), ("2", None)]


def test_stream_stream_joins(spark, tmp_path):
    ch = lambda table, ts, **d: json.dumps({"database": "edu", "table": table, "type": "insert", "ts": ts, "data": d})
    rows = [ch("order_detail", T0, id="1", order_id="o", create_time="2024-01-01 00:00:00"), ch("order_info", T0 + 1, id="o", session_id="s"), ch("order_detail", T0, id="2", order_id="q", create_time="2024-01-01 00:00:00"), ch("order_info", T0 + 60, id="q", session_id="s")]
    far = [ch("order_detail", T0 + n, id=f"far{n}", order_id="x") for n in (9000, 9001)] + [ch("order_info", T0 + n, id="y") for n in (9000, 9001)]
    page = lambda sid, ts: json.dumps({"common": {"sid": sid, "sc": "7"}, "page": {"page_id": "order"}, "ts": ts * 1000})
    for k, batch in enumerate((rows, far)):
        spark.createDataFrame([(r,) for r in batch], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "db"))
        spark.createDataFrame([(page("s", T0),) if k == 0 else (page("z", T0 + 9000),)], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "log"))
    db, logs = readers.file_topic(spark, str(tmp_path / "db")), readers.file_topic(spark, str(tmp_path / "log"))
    out = detail.order_detail(detail.parse.changes(db), detail.parse.logs(logs), streaming=True)
    sinks.run(out, sinks.replace_batch(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert [(r.id, r.source_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("1", "7")]


def test_stream_join_gives_early_rows_and_takes_them_back(spark, tmp_path):
    """A detail comes out without its source, and is corrected once, whatever number of visits follow."""
    ch = lambda table, ts, **d: json.dumps({"database": "edu", "table": table, "type": "insert", "ts": ts, "data": d})
    page = lambda sid, ts, sc: json.dumps({"common": {"sid": sid, "sc": sc}, "page": {"page_id": "order"}, "ts": ts * 1000})
    first = [ch("order_detail", T0, id="1", order_id="o", create_time="2024-01-01 00:00:00"), ch("order_info", T0 + 1, id="o", session_id="s"), ch("order_detail", T0, id="2", order_id="p", create_time="2024-01-01 00:00:00"), ch("order_info", T0 + 1, id="p", session_id="nobody")]
    for k, (db, log) in enumerate([(first, [page("z", T0, "0")]), ([ch("order_info", T0 + 2, id="y")], [page("s", T0 + 3, "7"), page("s", T0 + 4, "8")])]):
        spark.createDataFrame([(r,) for r in db], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "db"))
        spark.createDataFrame([(r,) for r in log], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "log"))
        __import__("time").sleep(0.05)
        streams = [readers.file_topic(spark, str(tmp_path / x)) for x in ("db", "log")]
        out = detail.order_detail_changes(detail.parse.changes(streams[0]), detail.parse.logs(streams[1]))
        sinks.run(out, sinks.replace_batch(str(tmp_path / "out")), str(tmp_path / "cp"))
        got = sorted(((r.id, r.source_id, r._sign) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
        assert got == [("1", None, 1), ("2", None, 1)] if k == 0 else got == [("1", "7", 1), ("1", "8", 1), ("1", None, -1), ("1", None, 1), ("2", None, 1)]


def test_dim_cache(spark):
    now, reads = [0.0], []
    table = lambda v: spark.createDataFrame([("1", v), ("2", "")], "id string, name string")
    cache = readers.DimCache(lambda: reads.append(1) or table(f"v{len(reads)}"), most=2, expiry=10, clock=lambda: now[0])
    assert cache.get(["1", "2", None, "9", "1"]) == {"1": {"id": "1", "name": "v1"}, "2": {"id": "2"}} and len(reads) == 1
    assert cache.get(["9", "2"]) == {"2": {"id": "2"}} and len(reads) == 1  # what isn't there is remembered too
    assert cache.get(["1"])["1"]["name"] == "v2" and len(cache.held) == 2  # it was the oldest of three
    now[0] = 11
    assert cache.get(["1"])["1"]["name"] == "v3"
    cache.forget("1")
    assert cache.get(["1"])["1"]["name"] == "v4"
    cache.forget()
    assert not cache.held


def test_database_in_camel_case(spark):
    """JDBC against the embedded database that Spark brings along."""
    where = {"url": "jdbc:derby:memory:tidewright;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.createDataFrame([(1, "dim_a"), (2, None)], "source_id int, sink_table string").write.format("jdbc").options(**where, dbtable="table_process").mode("overwrite").save()
    out = readers.database(spark, where["url"], 'SELECT "source_id" AS "source_id", "sink_table" AS "sink_table" FROM table_process', camel=True, driver=where["driver"])
    assert out.columns == ["sourceId", "sinkTable"] and sorted(map(tuple, out.collect())) == [(1, "dim_a"), (2, None)]


def test_topic_options():
    """What the connector is asked for; its jar isn't here."""
    from unittest.mock import MagicMock, patch

    with patch("tidewright.sources.readers.F"), patch("tidewright.sources.sinks.F"):
        spark, df = MagicMock(), MagicMock()
        readers.topic(spark, "host:1", "topic_log", "group", "earliest")
        spark.readStream.format.assert_called_with("kafka")
        spark.readStream.format().options.assert_called_with(**{"kafka.bootstrap.servers": "host:1", "subscribe": "topic_log", "startingOffsets": "earliest", "kafka.group.id": "group"})
        serialised = MagicMock()
        sinks.to_topic(df, "host:1", "out", "/cp", lambda rows: serialised)
        writer = serialised.writeStream.format("kafka").option("kafka.bootstrap.servers", "host:1").option("checkpointLocation", "/cp")
        writer.option.assert_called_with("topic", "out")
        sinks.to_topic(df, "host:1", None, "/cp")  # to the topic that each row names
        assert df.select.called and not df.select().writeStream.format().option().option().option.called


def test_streaming_processors_equal_batch(spark, tmp_path):
    """Repair, bounces and retractions over files of one row each."""
    rows = [("a", "1", 0, True, 5), ("a", "1", 3_000, False, 6), ("b", "0", 4_000, True, 1), ("a", "1", 90_000_000, True, 2), ("b", "1", 90_001_000, True, 9), ("b", "1", 90_002_000, True, 9), ("z", "0", 999_000_000, False, 0), ("y", "0", 1_999_000_000, False, 0)]
    df = spark.createDataFrame(rows, "mid string, is_new string, ts long, e boolean, amount long").withColumn("et", F.timestamp_millis("ts")).withColumn("day", F.date_format("et", "yyyy-MM-dd"))
    src = str(tmp_path / "in")
    for r in rows:
        df.filter(F.col("ts") == r[2]).coalesce(1).write.mode("append").parquet(src)
    for name in ("repair", "bounce", "retract"):
        stream = readers.table_stream(spark, src, sinks.schema_text(df.schema), most_files=2)
        both = []
        for frame, module in ((df, stateful), (stream, processors)):
            out = {"repair": lambda f=frame, m=module: m.repair_new_visitor(f, "mid", "is_new", "day", ["ts"]), "bounce": lambda f=frame, m=module: m.bounces(f, "mid", F.col("e"), "ts", ["ts"]), "retract": lambda f=frame, m=module: m.retractions(f, "mid", ["ts"], ["amount"])}[name]()
            if frame is stream:
                sinks.run(out, str(tmp_path / name), str(tmp_path / f"cp-{name}"))
                out = spark.read.parquet(str(tmp_path / name))
            names = [c for c in ("mid", "is_new", "ts", "amount", "_sign") if c in out.columns]
            both.append(plain(out, names))
        assert both[0] == both[1], name


@pytest.mark.parametrize("name", ["first", "flag", "retract"])
def test_state_expires(spark, tmp_path, name):
    """A key that isn't met again is forgotten once the watermark has passed its last row by the time to live."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "in")
    for day in (0, 0.5, 4, 8, 12):
        keys = range(20) if day < 1 else [100 + int(day)]
        rows = spark.createDataFrame([(f"k{k}", int(T0 + day * 86_400), k) for k in keys], "k string, ts long, amount long").withColumn("et", F.timestamp_seconds("ts")).withColumn("day", F.date_format("et", "yyyy-MM-dd"))
        rows.coalesce(1).write.mode("append").parquet(src)
        __import__("time").sleep(0.05)
    stream = readers.table_stream(spark, src, sinks.schema_text(rows.schema), most_files=1)
    out = {"first": lambda: processors.first_of_day(stream, ["k"], "day", ["ts"]), "flag": lambda: processors.flag_first(stream, ["k"], ["ts"], "one"), "retract": lambda: processors.retractions(stream, "k", ["ts"], ["amount"], ttl_ms=10_000)}[name]()
    query = sinks.run(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    left = [p["stateOperators"][0]["customMetrics"].get("rocksdbNumKeys", 0) if "rocksdbNumKeys" in p["stateOperators"][0].get("customMetrics", {}) else p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(left) >= 20 and left[-1] < max(left) / 2
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == {"first": 23, "flag": 43, "retract": 63}[name]


def test_dim_job(spark, tmp_path):
    env = lambda op, ts, **d: (json.dumps({"op": op, "ts_ms": ts, "after": d if op != "d" else None, "before": d if op == "d" else None}),)
    ch = lambda kind, ts, **d: (json.dumps({"database": "edu", "table": "base_source", "type": kind, "ts": ts, "data": d}),)
    store = sinks.DimStore(spark, str(tmp_path / "dims"))
    cfg = readers.change_capture(spark.createDataFrame([env("c", 1, source_table="base_source", sink_table="dim_base_source", sink_columns="id,source_site", sink_pk="id"), env("c", 2, source_table="gone", sink_table="dim_gone", sink_columns="id", sink_pk="id"), env("d", 3, source_table="gone", sink_table="dim_gone", sink_columns="id", sink_pk="id")], "value string"))
    detail.dim_job(spark.createDataFrame([ch("insert", 1, id="1", source_site="x", other="o"), ch("update", 2, id="1", source_site=""), ch("insert", 1, id="2", source_site="y"), ch("delete", 2, id="2")], "value string"), cfg, store)
    assert [tuple(r) for r in store.read("dim_base_source").collect()] == [("1", "x")]
    assert not store.exists("dim_gone")
    store.put("dim_base_source", spark.createDataFrame([("1", "z", "update", 1, 0), ("3", "w", "insert", 1, 0)], "id string, source_site string, type string, ts long, tie long"), "id", ["ts", "tie"])
    assert sorted(map(tuple, store.read("dim_base_source").collect())) == [("1", "z"), ("3", "w")]
    assert readers.dim_row(store.read("dim_base_source"), "3") == {"id": "3", "source_site": "w"} and readers.dim_row(store.read("dim_base_source"), "9") is None
    store.apply_config("u", "dim_base_source", ["id", "source_site"])
    assert store.read("dim_base_source").count() == 0
    # events between the last drop and the first making after it change nothing; earlier ones aren't replayed
    more = readers.change_capture(spark.createDataFrame([env("c", 1, source_table="base_source", sink_table="dim_base_source", sink_columns="id,old"), env("d", 4, source_table="base_source", sink_table="dim_base_source", sink_columns="id,old"), env("c", 5, source_table="base_source", sink_table="dim_base_source", sink_columns="id,source_site,more"), env("r", 6, source_table="base_source", sink_table="dim_base_source", sink_columns="id,more")], "value string"))
    for since in (None, 6):
        detail.dim_job(spark.createDataFrame([ch("insert", 7, id="9", source_site="s", more="m")], "value string"), more, store, since=since)
        assert store.read("dim_base_source").columns == ["id", "source_site", "more"] and [r.id for r in store.read("dim_base_source").collect()] == ["9"]


def test_dim_store_changes_and_compaction(spark, tmp_path):
    """Puts write changes alone; a repeated batch changes nothing; compaction keeps the table, and so does a broken write."""
    store = sinks.DimStore(spark, str(tmp_path), most=4)
    store.create("t", ["id", "a", "b"])
    put = lambda n, *rows: store.put("t", spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id string, a string, b string, type string, ts long"), "id", ["ts"], n)
    now = lambda: sorted(map(tuple, store.read("t").collect()))
    put(1, ("1", "x", "y", "insert"), ("2", "p", "q", "insert"), ("3", "m", "n", "insert"))
    assert store._version("t") == 0 and len(store._changes("t", 0)) == 1
    for _ in range(2):
        put(2, ("1", "", "z", "update"), ("2", None, None, "delete"))
        assert now() == [("1", "x", "z"), ("3", "m", "n")]
    (tmp_path / "t" / "c0-000000000009").mkdir()  # a write that failed
    put(3, ("2", None, "new", "insert"), ("3", "k", None, "update"))
    want = [("1", "x", "z"), ("2", None, "new"), ("3", "k", "n")]
    assert now() == want and store._version("t") == 0
    put(4, ("1", None, None, "delete"))
    assert store._version("t") == 1 and now() == want[1:] and store._changes("t", 1) == []
    put(5, ("1", "again", None, "insert"))
    assert now() == [("1", "again", None), *want[1:]]


def test_upserts_are_compacted(spark, tmp_path):
    path = str(tmp_path)
    write = sinks.upsert(path, "id", ["n"], ["id", "v", "n", "gone"], richer="v")
    of = lambda *rows: spark.createDataFrame(list(rows), "id int, v string, n int, gone boolean")
    now = lambda: sorted(map(tuple, sinks.read_upserted(spark, path, "id", richer="v", deleted="gone").select("id", "v", "n").collect()))
    write(of((1, None, 1, False), (2, "b", 1, False)), 0)
    write(of((1, "a", 2, False), (3, None, 1, False)), 1)
    want = [(1, "a", 2), (2, "b", 1), (3, None, 1)]
    assert now() == want
    for _ in range(2):
        sinks.compact_upserted(spark, path, "id", richer="v")
        assert now() == want and sorted(p.name for p in tmp_path.iterdir() if p.name.startswith(("batch", "_base"))) == ["_base-1"]
    (tmp_path / "_base-7").mkdir()  # a compaction that failed
    write(of((1, None, 3, False), (2, "b", 9, True), (3, "c", 2, False)), 2)
    assert now() == [(1, "a", 2), (3, "c", 2)]
    sinks.compact_upserted(spark, path, "id", richer="v")
    assert now() == [(1, "a", 2), (3, "c", 2)]


def test_dashboard(spark, tmp_path):
    jobs, d, root = summary_jobs(), dimensions(spark), str(tmp_path)
    for name, job in jobs.items():
        sinks.append_summary(job.batch(rows_for(name, spark), d), root, name)
    tables = readers.summary_tables(spark, root)
    plan = serving.paper_stats(tables["dws_examination_paper_exam_window"], 20240101)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cur_date" in plan
    ends = serving.endpoints(tables, 20240101)
    answers = {k: f() for k, f in ends.items()}
    assert answers["/edu/realtime/examination/paperStats"]["data"]["rows"][0] == {"paper_title": "Paper", "exam_taken_count": 3, "avg_score": 119 / 3, "avg_during_sec": 10.0}
    hours = answers["/edu/realtime/traffic/visitorPerHr"]["data"]
    assert hours["categories"][:2] == ["00", "01"] and len(hours["series"][0]["data"]) == 24 and hours["series"][0]["data"][0] == 3
    assert {x["name"] for x in answers["/edu/realtime/traffic/keywords"]["data"]} == {"big", "data"}
    assert answers["/edu/realtime/traffic/svCt"]["data"]["series"][0]["data"]
    empty = serving.endpoints(tables, 19990101)["/edu/realtime/traffic/uvCt"]()
    assert empty["data"] == {"categories": [], "series": [{"name": "visitors", "data": []}]}
    assert serving.province_amounts(tables["dws_trade_province_order_window"], 20240101).count() == 2
    assert serving.source_orders(tables["dws_trade_source_order_window"], 20240101).first().order_count == 1
    q = serving.question_accuracy(tables["dws_examination_question_answer_window"], 20240101).first()
    assert q.question_txt == __import__("hashlib").md5(b"What?").hexdigest()[:10] and q.accuracy_rate == pytest.approx(1 / 3)
    assert serving.score_distribution(tables["dws_examination_paper_score_duration_exam_window"], 20240101).count() == 3
