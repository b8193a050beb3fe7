"""Parsing, filtering, routing and splitting on literal records."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewright.functions.names import camel, snake, to_camel, to_snake
from tidewright.functions.text import keyword_array, keywords, register_keywords
from tidewright.functions.timefn import from_millis, millis_of_text, row_op_instant, today_partition
from tidewright.operators import dims, parse, routing
from tidewright.sources import readers


def raw(spark, *values):
    return spark.createDataFrame([(v if v is None or isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def change(table="t", kind="insert", ts=1, db="edu", **data):
    return {"database": db, "table": table, "type": kind, "ts": ts, "data": data}


def log(ts=1, common=None, **more):
    return {"common": common or {"mid": "m", "is_new": "1"}, "ts": ts} | more


def test_dim_etl_drops_bad_records(spark):
    records = parse.changes(raw(spark, change(id="1"), change(db="other", id="2"), change(kind="bootstrap-start", id="3"), change(), "{bad", "", None, change(kind="bootstrap-insert", id="4")))
    assert sorted(r.data["id"] for r in parse.dim_etl(records).collect()) == ["1", "4"]


def test_dwd_etl_drops_bootstrap_and_untyped(spark):
    records = parse.changes(raw(spark, change(id="1"), change(kind="bootstrap-insert", id="2"), {"database": "x", "data": {"id": "3"}}, "{bad", change(db="any", id="4")))
    assert sorted(r.data["id"] for r in parse.dwd_etl(records).collect()) == ["1", "4"]


def test_strict_parsing_fails(spark):
    import pytest

    with pytest.raises(Exception, match="(?i)malformed"):
        parse.logs(raw(spark, "{bad"), strict=True).collect()


def test_dirty_records_are_a_table(spark):
    clean, dirty = parse.split_dirty(raw(spark, {"a": 1}, "nope", "", None, "[1]", '"text"'))
    assert clean.count() == 1
    assert dirty.count() == 5


def test_split_log(spark):
    rows = parse.logs(raw(spark, log(page={"page_id": "home"}, displays=[{"item": "1"}, {"item": "2"}], actions=[{"a": "x"}]), log(err={"code": 1}, page={"page_id": "p"}), log(start={"e": "icon"}, err={"c": 2}), log(appVideo={"play_sec": 3}), log(displays=[{"item": "9"}])))
    out = parse.split_log(rows)
    assert {k: v.count() for k, v in out.items()} == {"err": 2, "start": 1, "appVideo": 1, "page": 2, "display": 2, "action": 1}
    assert "displays" not in out["page"].columns and "err" not in out["start"].columns
    assert sorted(r.display["item"] for r in out["display"].collect()) == ["1", "2"]
    assert json.loads(out["err"].filter("page is not null").first().err) == {"code": 1}


def test_filters_and_projections(spark):
    pages = parse.logs(raw(spark, log(page={"page_id": "home"}), log(page={"page_id": "order", "last_page_id": "home"}, common={"sid": "s", "sc": "7"}), log(page={"page_id": "x", "item_type": "keyword", "item": "Big data"}), log(page={"page_id": "x", "item_type": "keyword"})))
    assert parse.session_entries(pages).count() == 3
    assert parse.pages_in(pages).count() == 1
    assert [tuple(r) for r in parse.order_page_rows(pages).collect()] == [("s", "7", 1)]
    assert [r.fullword for r in parse.search_rows(pages).collect()] == ["Big data"]
    records = parse.changes(raw(spark, change("order_detail", id="1", order_id="9", create_time="2024-12-14 10:49:48"), change("order_detail", "update", id="2"), change("order_info", id="9", session_id="s"), change("payment_info", "update", order_id="9", payment_status="1602"), change("payment_info", order_id="8", payment_status="1601")))
    assert [(r.id, r.date_id, r.origin_amount) for r in parse.order_detail_rows(records).collect()] == [("1", "2024-12-14", None)]
    assert [r.session_id for r in parse.order_info_rows(records).collect()] == ["s"]
    assert [r.order_id for r in parse.payment_success_rows(records).collect()] == ["9"]
    assert parse.with_source(spark.createDataFrame([("",), (None,), ("1",)], "source_id string")).count() == 1


def test_score_bands(spark):
    scores = [-1.0, 0.0, 59.9, 60.0, 70.0, 80.0, 90.0, 100.0, 100.1, None]
    df = spark.createDataFrame([(s,) for s in scores], "s double").select(parse.score_band("s").alias("b"))
    assert [r.b for r in df.collect()] == ["[0,60)"] * 3 + ["[60,70)", "[70,80)", "[80,90)", "[90,100]", "[90,100]", "", ""]


def test_prune_takes_the_list_as_it_is(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2", " c": "3"}, "a, c")], "data map<string,string>, cols string")
    assert df.select(parse.prune("data", "cols").alias("d")).first().d == {"a": "1", " c": "3"}
    assert df.select(parse.with_entry(F.col("data"), "a", F.lit(5)).alias("d")).first().d == {"b": "2", " c": "3", "a": "5"}


def test_configuration_replay_and_routes(spark):
    env = lambda op, ts, before=None, after=None: {"op": op, "ts_ms": ts, "before": before, "after": after}
    row = lambda t, sink, cols: {"source_table": t, "sink_table": sink, "sink_columns": cols, "sink_pk": "id"}
    events = readers.change_capture(raw(spark, env("r", 1, after=row("t", "dim_t", "id,name")), env("u", 2, after=row("t", "dim_t", "id")), env("c", 1, after=row("u", "dim_u", "id")), env("d", 3, before=row("u", "dim_u", "id"))), family="info")
    assert events.filter("sink_family = 'info'").count() == 4
    now = routing.current_config(events, ["source_table"])
    assert [(r.source_table, r.data["sink_columns"]) for r in now.collect()] == [("t", "id")]
    assert [r.data["sink_columns"] for r in readers.snapshot(events, "source_table").collect()] == ["id"]
    cfg = now.select("source_table", *(F.col("data")[c].alias(c) for c in ("sink_table", "sink_columns", "sink_pk")))
    routed = routing.route_dim(parse.dim_etl(parse.changes(raw(spark, change("t", id="1", name="x"), change("u", id="2")))), cfg)
    assert [(r.sink_table, r.data) for r in routed.collect()] == [("dim_t", {"id": "1", "type": "insert"})]
    dwd = spark.createDataFrame([("t", "insert", "dwd_t", "id")], "source_table string, source_type string, sink_table string, sink_columns string")
    routed = routing.route_dwd(parse.dwd_etl(parse.changes(raw(spark, change("t", id="1", ts=7), change("t", "update", id="1")))), dwd)
    assert [r.data for r in routed.collect()] == [{"id": "1", "ts": "7"}]
    assert routing.sink_rows(routed, "dwd_t", ["id", "ts"]).collect() == [Row(id="1", ts="7")]


def test_dim_merge_keeps_what_a_put_leaves_out(spark):
    rows = [("1", "a", "x", "insert", 1), ("1", None, "y", "update", 2), ("1", "", None, "update", 3), ("2", "b", "z", "insert", 1), ("2", None, None, "delete", 2), ("3", "c", "q", "insert", 1), ("3", None, None, "delete", 2), ("3", None, "r", "insert", 3)]
    df = spark.createDataFrame(rows, "id string, p string, q string, type string, n int")
    assert sorted(map(tuple, dims.merge_dim(df, "id", ["p", "q"], ["n"]).collect())) == [("1", "a", "y"), ("3", None, "r")]


def test_lookup_misses_and_null_keys(spark):
    rows = spark.createDataFrame([("1",), ("9",), (None,)], "k string")
    dim = spark.createDataFrame([("1", "one")], "id string, name string")
    assert {(r.k, r.n) for r in dims.lookup(rows, dim, "k", {"name": "n"}).collect()} == {("1", "one"), ("9", None), (None, None)}
    assert {r.n for r in dims.lookup(rows, dim, "k", {"name": "n"}, default={"n": ""}).collect()} == {"one", ""}


def test_keywords(spark):
    assert list(keywords("Big-Data 数据仓库2", frozenset({"数据", "数据仓"}))) == ["big", "data", "数据仓", "库", "2"]
    assert list(keywords(None)) == []
    register_keywords(spark)
    spark.createDataFrame([("Ab cd, 12-x 数据",), (None,), ("",)], "t string").createOrReplaceTempView("some_texts")
    by_function = sorted(r.word for r in spark.sql("SELECT word FROM some_texts, LATERAL ik_analyze(t)").collect())
    by_array = sorted(r.w for r in spark.table("some_texts").select(F.explode(keyword_array("t")).alias("w")).collect())
    assert by_function == by_array == ["12", "ab", "cd", "x", "据", "数"]


def test_times_and_names(spark):
    one = spark.range(1)
    assert one.select(millis_of_text(F.lit("1970-01-01 08:00:00"))).first()[0] == 0
    assert one.select(millis_of_text(F.lit("1970-01-02"), "UTC")).first()[0] == 86_400_000
    assert one.select(F.unix_millis(from_millis(F.lit("1500")))).first()[0] == 1500
    assert one.select(row_op_instant(F.lit("2022-04-01 11:10:55.1Z")) > row_op_instant(F.lit("2022-04-01 11:10:55.04Z"))).first()[0]
    assert one.select(today_partition()).first()[0] > 20240101
    assert (camel("order_uv_count"), snake("orderUvCount"), snake(camel("a_b_c"))) == ("orderUvCount", "order_uv_count", "a_b_c")
    df = spark.createDataFrame([(1, 2)], "order_id int, user_id int")
    assert to_camel(df).columns == ["orderId", "userId"] and to_snake(to_camel(df)).columns == df.columns
    assert json.loads(parse.as_json(df, "user_id").first().value) == {"order_id": 1}


def test_log_outputs_in_one_pass(spark):
    """The one-pass split gives what the split by output gives, from one scan."""
    import json

    page = {"page_id": "home", "during_time": 5}
    texts = [None, "", " ", "x", "5", "[1]", '{"a"', "{}", '{"ts": "late"}', json.dumps({"common": {"mid": "m"}, "page": page, "ts": 1}), json.dumps({"page": page, "displays": [{"i": "1"}, {"i": "2"}], "actions": [{"a": "b"}], "err": "e", "start": "s", "ts": 2}), json.dumps({"displays": [{"i": "9"}], "appVideo": "v", "ts": 3}), json.dumps({"page": page, "displays": [], "actions": None, "ts": "4x"}), '[{"page": {"page_id": "p"}}]']
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    clean, dirty = parse.split_dirty(raw)
    want = [("dirty", r.value) for r in dirty.collect()]
    for name, rows in parse.split_log(parse.logs(clean)).items():
        cells = [c for c in ("common", "page", "err", "start", "appVideo", "display", "actions", "ts") if c in rows.columns and (c != "actions" or name == "action")]
        want += [(name, *(str(r[c]) if c in cells else "None" for c in ("common", "page", "err", "start", "appVideo", "display", "actions", "ts"))) for r in rows.collect()]
    out = parse.log_outputs(raw)
    got = [("dirty", r.value) if r.output == "dirty" else (r.output, *(str(r[c]) for c in ("common", "page", "err", "start", "appVideo", "display", "action", "ts"))) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    plan = out.groupBy("output").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("Scan") == 1
