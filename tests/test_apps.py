"""Bases of jobs, declared lookups, and the dashboard over HTTP."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from test_jobs import dimensions, rows_for

from tidewright.plans.app import App, DimJoin, SqlApp
from tidewright.plans.publisher import server
from tidewright.plans.summary import summary_jobs
from tidewright.sources import readers, sinks


def test_apps(spark, tmp_path):
    record = json.dumps({"database": "edu", "table": "t", "type": "insert", "ts": 5, "data": {"id": "1"}})
    page = json.dumps({"common": {"mid": "m"}, "page": {"page_id": "home"}, "ts": 7000})
    for name, text in (("db", record), ("log", page)):
        spark.createDataFrame([(text,), ("",)], "value string").write.text(str(tmp_path / name))
    db, log = readers.file_topic(spark, str(tmp_path / "db")), readers.file_topic(spark, str(tmp_path / "log"))

    class Copy(App):
        def handle(self, stream):
            return sinks.run(stream, str(tmp_path / "copy"), str(tmp_path / "cp1"))

    class Pages(SqlApp):
        def handle(self, spark):
            out = spark.sql("SELECT page.page_id, unix_seconds(et) AS s FROM page_log")
            return sinks.run(out, str(tmp_path / "pages"), str(tmp_path / "cp2"))

    Copy(spark).start(db)
    assert record in [r.value for r in spark.read.parquet(str(tmp_path / "copy")).collect()]
    Pages(spark).start(db, log, "0 seconds")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "pages")).collect()] == [("home", 7)]
    assert spark.table("topic_db").columns[-2:] == ["pt", "et"]


def test_declared_lookup(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "source_id string")
    out = DimJoin("dim_base_source", "source_id", {"source_site": "source_name"}, default={"source_name": ""}).apply(rows, dimensions(spark))
    assert sorted(map(tuple, out.collect())) == [("1", "site one"), ("2", "")]


def test_http(spark, tmp_path):
    for name, job in summary_jobs().items():
        sinks.append_summary(job.batch(rows_for(name, spark), dimensions(spark)), str(tmp_path), name)
    web = server(lambda: readers.summary_tables(spark, str(tmp_path)), port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{web.server_address[1]}"
    get = lambda path: json.loads(urllib.request.urlopen(base + path).read())
    try:
        assert {x["name"] for x in get("/edu/realtime/traffic/keywords?date=20240101")["data"]} == {"big", "data"}
        assert get("/edu/realtime/traffic/keywords")["data"] == []
        for path, status in (("/none", 404), ("/edu/realtime/traffic/keywords?date=x", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path)
            assert e.value.code == status
    finally:
        web.shutdown()
