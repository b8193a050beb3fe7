"""The dimension job and the detail jobs as streams: routes that change between batches, fan-out, replay."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tidewright.operators import stateful
from tidewright.plans import detail
from tidewright.sources import readers, sinks
from tidewright.sources.config_table import ConfigTable
from tidewright.sources.keyed import KeyedTables
from tidewright.streaming import jobs

T0 = 1_704_067_200


def add(spark, path, *texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(path)


def conf(op, ts, table, sink, columns="id,name", **more):
    row = {"source_table": table, "sink_table": sink, "sink_columns": columns, "sink_pk": "id"} | more
    return json.dumps({"op": op, "ts_ms": ts, "before": row if op == "d" else None, "after": None if op == "d" else row})


def change(table, ts, kind="insert", **data):
    return json.dumps({"database": "edu", "table": table, "type": kind, "ts": ts, "data": data})


def again(checkpoint):
    """As if the last micro-batch had been killed before its commit."""
    last = max(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda f: int(f.rsplit("/", 1)[1]))
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


class Dims:
    """A dimension job with its two topics."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        self.config = ConfigTable(spark, f"{root}/config", ["source_table"])
        self.tables = KeyedTables(spark, f"{root}/dims", buckets=4)

    def configure(self, *events):
        add(self.spark, f"{self.root}/conf", *events)
        jobs.control(readers.change_capture(readers.file_topic(self.spark, f"{self.root}/conf")), self.config, f"{self.root}/cp-conf")

    def feed(self, *records):
        if records:
            add(self.spark, f"{self.root}/db", *records)
        jobs.dim(readers.file_topic(self.spark, f"{self.root}/db"), self.config, self.tables, f"{self.root}/cp-db", compact_every=3)

    def rows(self, table):
        return sorted((tuple(r) for r in jobs.dim_table(self.config, self.tables, table).collect()), key=repr)


def test_routes_change_between_batches(spark, tmp_path):
    d = Dims(spark, tmp_path)
    add(spark, f"{tmp_path}/db", change("a", 1, id="1", name="x", other="o"))
    with pytest.raises(Exception, match="no configuration yet"):
        d.feed()
    d.configure(conf("r", 1, "a", "dim_a"), conf("r", 1, "b", "dim_b"), conf("d", 2, "b", "dim_b"))
    d.feed(change("a", 2, id="2", name="y"), change("b", 2, id="1", name="lost: no route"), "", change("a", 2, id="3", name="z"), change("a", 3, "delete", id="3"))
    assert d.rows("dim_a") == [("1", "x"), ("2", "y")]  # the record that waited for a configuration is there
    with pytest.raises(LookupError):
        d.rows("dim_b")
    d.configure(conf("c", 5, "b", "dim_b"), conf("c", 5, "a", "dim_a"))  # a table more; one that is there already stays
    d.feed(change("b", 6, id="7", name="b7"), change("a", 6, "update", id="1", name=""), change("a", 6, "update", id="2", name="y2"))
    assert d.rows("dim_b") == [("7", "b7")] and d.rows("dim_a") == [("1", "x"), ("2", "y2")]
    d.configure(conf("u", 7, "a", "dim_a", "id,name,other"), conf("d", 7, "b", "dim_b"))  # made anew; dropped
    assert d.rows("dim_a") == []
    d.feed(change("a", 8, id="9", name="n", other="p"), change("b", 8, id="8", name="dead route"))
    assert d.rows("dim_a") == [("9", "n", "p")]
    # killed before its commit, and the table is back when the batch runs again: it goes by the version it began with
    again(f"{tmp_path}/cp-db")
    d.configure(conf("c", 9, "b", "dim_b"), conf("c", 1, "a", "dim_a", "id"))  # the second is older than what is known
    d.feed()
    assert d.rows("dim_a") == [("9", "n", "p")] and d.rows("dim_b") == []
    d.feed(change("b", 10, id="8", name="alive"))
    assert d.rows("dim_b") == [("8", "alive")]
    assert d.config.latest() == 4 and len(d.config.versions()) == 4


def test_a_control_batch_that_runs_again_makes_the_same_version(spark, tmp_path):
    d = Dims(spark, tmp_path)
    d.configure(conf("c", 1, "a", "dim_a"))
    d.configure(conf("u", 2, "a", "dim_a", "id,more"), conf("c", 3, "b", "dim_b"))
    want = sorted(map(str, d.config.read().collect()))
    again(f"{tmp_path}/cp-conf")
    d.configure(conf("d", 4, "b", "dim_b"))
    assert sorted(map(str, d.config.read(2).collect())) == want and d.config.latest() == 3
    assert [(r.source_table, r.generation) for r in d.config.read().collect()] == [("a", 2)]


def test_keyed_tables(spark, tmp_path):
    """Against a loop over all puts, with compactions in between, a batch twice, empty batches and several tables at once."""
    tables, state = KeyedTables(spark, str(tmp_path / "t"), buckets=8), {}
    schema = "table string, generation long, key string, type string, ts long, data map<string,string>"
    assert tables.read("none", 0, ["id", "a"]).collect() == [] and tables.read("none", 0, ["id", "a"]).columns == ["id", "a"]
    for n in range(7):
        rows = [(f"t{k % 2}", k % 3 // 2, str(k * 7 % 11), "delete" if (k + n) % 5 == 0 else "insert", 10 * n + k, {"id": str(k * 7 % 11), "a": "" if k % 4 == 0 else f"{n}-{k}", "b": None if k % 3 else f"b{n}"}) for k in range(20)] if n != 3 else []
        rows.append(("t0", 0, None, "insert", 1, {"a": "no key"}))
        for _ in range(2):
            tables.put(spark.createDataFrame(rows, schema), n)
        for t, g, key, kind, _, data in rows:
            if key is not None:
                own = state.setdefault((t, g), {})
                if kind == "delete":
                    own.pop(key, None)
                else:
                    own.setdefault(key, {}).update({c: v for c, v in data.items() if v})
        if n in (1, 4):
            tables.compact()
            tables.compact()
        for (t, g), own in state.items():
            want = sorted((k, v.get("a"), v.get("b")) for k, v in own.items())
            assert sorted(map(tuple, tables.read(t, g, ["id", "a", "b"]).collect())) == want
    some = spark.createDataFrame([("3",), ("4",), ("3",), ("x",)], "k string")
    assert sorted(r.id for r in tables.read("t1", 0, ["id", "a"], keys=some).collect()) == sorted(k for k in state["t1", 0] if k in "34")
    tables.drop("t1", 0)
    assert tables.read("t1", 0, ["id"]).count() == 0 and tables.read("t0", 0, ["id"]).count() > 0


def test_lookups_open_the_buckets_of_their_keys_alone(spark, tmp_path):
    tables = KeyedTables(spark, str(tmp_path / "t"), buckets=128)
    tables.put(spark.range(3000).selectExpr("'t' AS table", "0 AS generation", "cast(id AS string) AS key", "'insert' AS type", "id AS ts", "map('a', cast(id * 2 AS string)) AS data"), 0)
    tables.compact()
    tables.put(spark.createDataFrame([("t", 0, "5", "update", 1, {"a": "new"})], "table string, generation long, key string, type string, ts long, data map<string,string>"), 1)
    keys = spark.createDataFrame([("5",), ("2999",)], "k string")
    out = tables.read("t", 0, ["id", "a"], keys=keys)
    assert sorted(map(tuple, out.collect())) == [("2999", "5998"), ("5", "new")]
    opened, there = len(out.inputFiles()), len(tables.read("t", 0, ["id", "a"]).inputFiles())
    assert there >= 120 and opened <= 0.05 * there


def test_base_db_stream(spark, tmp_path):
    config = ConfigTable(spark, f"{tmp_path}/config", ["source_table", "source_type"])
    for n, (events, records) in enumerate([([conf("c", 1, "cart", "dwd_cart", "id", source_type="insert")], [change("cart", 1, id="1", x="no"), change("cart", 2, "update", id="2"), change("cart", 2, "bootstrap-insert", id="3")]), ([conf("c", 2, "cart", "dwd_fixed", "id,x", source_type="update"), conf("d", 3, "cart", "dwd_cart", source_type="insert")], [change("cart", 3, "update", id="4", x="y"), change("cart", 3, id="5")])]):
        add(spark, f"{tmp_path}/conf", *events)
        jobs.control(readers.change_capture(readers.file_topic(spark, f"{tmp_path}/conf")), config, f"{tmp_path}/cp-conf")
        add(spark, f"{tmp_path}/db", *records)
        for _ in range(2):
            jobs.base_db(readers.file_topic(spark, f"{tmp_path}/db"), config, f"{tmp_path}/out", f"{tmp_path}/cp")
            if n:
                again(f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out").select("sink_table", F.to_json("data")).collect()
    assert sorted(map(tuple, got)) == [("dwd_cart", '{"id":"1","ts":"1"}'), ("dwd_fixed", '{"id":"4","x":"y","ts":"3"}')]


LOGS = [
    json.dumps({"common": {"mid": "m", "is_new": "1"}, "page": {"page_id": "home"}, "displays": [{"a": "1"}, {"a": "2"}], "actions": [{"b": "1"}], "err": "e", "ts": T0 * 1000}),
    json.dumps({"common": {"mid": "m", "is_new": "1"}, "page": {"page_id": "x", "last_page_id": "home"}, "ts": T0 * 1000 + 1000}),
    json.dumps({"common": {"mid": "m", "is_new": "1"}, "start": "s", "ts": (T0 + 86_400) * 1000}), json.dumps({"common": {"mid": None, "is_new": "1"}, "appVideo": "v", "ts": T0 * 1000}), json.dumps({"common": {"mid": None, "is_new": "1"}, "page": {"page_id": "q"}, "ts": (T0 + 90_000) * 1000}),
    "bad", "[1]", '{"ts": 1}', json.dumps({"common": {"mid": "n", "is_new": "0"}, "page": {"page_id": "home"}}), json.dumps({"common": {"mid": "n", "is_new": "1"}, "err": "f", "ts": T0 * 1000 + 5}),
]


def shown(df):
    return sorted(tuple(map(str, r)) for r in df.select("output", "common.mid", "common.is_new", "page.page_id", "err", "start", "appVideo", "display", "action", "ts", "value").collect())


def test_base_log_is_one_parse_and_the_frames_of_the_split(spark):
    raw = spark.createDataFrame([(t,) for t in LOGS], "value string")
    out = detail.log_job(raw)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    frames, got = detail.base_log(raw.filter("value not like '%null%'")), detail.log_job(raw.filter("value not like '%null%'"))
    for name, frame in frames.items():
        own = got.filter(F.col("output") == name)
        assert own.count() == frame.count(), name
        if name not in ("dirty", "incomplete"):
            flags = lambda df: sorted((r.common.mid, r.common.is_new, r.ts) for r in df.collect())
            assert flags(own) == flags(frame)
    assert {r.common.is_new for r in out.filter("output in ('appVideo', 'page') and common.mid is null").collect()} == {"1"}
    assert sorted(r.value for r in out.filter("output = 'dirty'").collect()) == ["[1]", "bad"] and out.filter("output = 'incomplete'").count() == 2


def test_base_log_stream_equals_batch(spark, tmp_path):
    """A file a batch; the last batch twice. All outputs of a batch come from one write."""
    for t in LOGS:
        add(spark, f"{tmp_path}/log", t)
    for _ in range(2):
        jobs.base_log(readers.file_topic(spark, f"{tmp_path}/log", 4), f"{tmp_path}/out", f"{tmp_path}/cp")
        again(f"{tmp_path}/cp")
    schema = sinks.schema_text(detail.log_job(spark.createDataFrame([], "value string")).schema)
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out")
    assert shown(got) == shown(detail.log_job(spark.createDataFrame([(t,) for t in LOGS], "value string"), stateful))
    assert len(set(got.select(F.col("_metadata.file_path")).rdd.map(lambda r: r[0].split("output=")[1].split("/")[0]).collect())) == 8


def test_visit_streams_equal_batch(spark, tmp_path):
    pages = [json.dumps({"common": {"mid": m}, "page": {"page_id": "home", "last_page_id": last}, "ts": (T0 + t) * 1000}) for m, last, t in (("a", None, 0), ("a", "x", 5), ("b", None, 7), ("b", None, 60), ("a", None, 86_400))]
    far = [json.dumps({"common": {"mid": "far"}, "page": {"page_id": "home", "last_page_id": "x"}, "ts": (T0 + 900_000 + t) * 1000}) for t in (0, 90_000)]
    for t in (*pages, *far):
        add(spark, f"{tmp_path}/log", t)
    want = {"unique_visitors": detail.unique_visitors, "user_jumps": detail.user_jumps}
    batch = detail.parse.logs(spark.createDataFrame([(t,) for t in pages], "value string"))
    for name, plan in want.items():
        stream = detail.parse.logs(readers.file_topic(spark, f"{tmp_path}/log", 1))
        getattr(jobs, name)(stream, f"{tmp_path}/{name}", f"{tmp_path}/cp-{name}")
        got = sorted((r.mid, r.ts) for r in spark.read.parquet(f"{tmp_path}/{name}").filter("mid <> 'far'").collect())
        assert got == sorted((r.mid, r.ts) for r in plan(batch).collect())


def test_upserts_of_empty_batches(spark, tmp_path):
    """An empty first batch is an empty table with its columns; one that was never written is an error with a name."""
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, n int, v string")
    with pytest.raises(LookupError, match="nothing has been written"):
        sinks.read_upserted(spark, path, "id")
    write = sinks.upsert(path, "id", ["n"], ["id", "n", "v"])
    write(rows.limit(0), 0)
    out = sinks.read_upserted(spark, path, "id")
    assert out.columns == ["id", "n", "v"] and out.collect() == []
    sinks.compact_upserted(spark, path, "id")
    write(rows, 1)
    write(rows.limit(0), 2)
    sinks.compact_upserted(spark, path, "id")
    assert [tuple(r) for r in sinks.read_upserted(spark, path, "id").collect()] == [("a", 2, "y")]
    with pytest.raises(LookupError, match="no dimension table"):
        sinks.DimStore(spark, f"{path}-dims").read("dim_a")
