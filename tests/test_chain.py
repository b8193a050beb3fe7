"""Summary jobs as one streaming query each equal their batch form; what is replaced is taken back."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from test_jobs import T0, dimensions, plain, rows_for

from tidewright.plans.summary import summary_jobs
from tidewright.sources import readers, sinks
from tidewright.streaming import flows


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Each stateful step of each micro-batch has a task and a store for each: two show as much as more."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def feed(spark, path, *batches):
    """Files of one batch each, in order of their times."""
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(path)


def summary_of(spark, out, name):
    return spark.read.parquet(f"{out}/{name}").withColumn("cur_date", F.col("cur_date").cast("string"))


@pytest.mark.parametrize("name", sorted(summary_jobs()))
def test_one_query_equals_batch(spark, tmp_path, name):
    job, d, src = summary_jobs()[name], dimensions(spark), str(tmp_path / "in")
    far = rows_for(name, spark, far=True)
    scale = 1000 if "traffic" in name else 1
    push = far.filter(f"ts >= {(T0 + 800_000) * scale}").withColumn("ts", F.col("ts") + 100_000 * scale)
    if "id" in push.columns:
        push = push.withColumn("id", F.lit("push"))
    feed(spark, src, far, push)
    flows.chained(spark, job, readers.table_stream(spark, src, sinks.schema_text(far.schema), most_files=1), d, str(tmp_path / "out"))
    want = job.batch(rows_for(name, spark), d)
    names = [c for c in want.columns if c != "user_id"]
    assert [r for r in plain(summary_of(spark, tmp_path / "out", name), names) if not r[0].startswith("2024-01-1")] == plain(want, names)
    assert len(glob.glob(str(tmp_path / "out/_checkpoints/*"))) == 1 and glob.glob(str(tmp_path / f"out/_checkpoints/{name}/state/*"))


DETAIL = "id string, order_id string, user_id string, course_id string, province_id string, source_id string, final_amount string, ts long, row_op_ts timestamp"


def detail(spark, *rows):
    full = [(i, o, u, "c", p, "1", a, T0 + t, v) for i, o, u, p, a, t, v in rows]
    return spark.createDataFrame(full, DETAIL.replace("row_op_ts timestamp", "row_op_ts int")).withColumn("row_op_ts", F.timestamp_seconds("row_op_ts"))


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 3, 2)])
def test_provinces_take_back_what_is_replaced(spark, tmp_path, order):
    """Versions come in either order, in batches of their own: amounts, orders and users end as in batch, whichever detail
    moves to another order, user or province."""
    job, d, src = summary_jobs()["dws_trade_province_order_window"], dimensions(spark), str(tmp_path / "in")
    batches = [
        detail(spark, ("d1", "o1", "u1", "11", "10.5", 1, 1), ("d2", "o1", "u1", "11", "2", 2, 1), ("d3", "o2", "u1", "11", "1", 3, 1)),
        detail(spark, ("d1", "o1", "u1", "11", "11", 1, 2), ("d4", "o4", "u2", "11", "4", 4, 1), ("d5", None, None, "99", None, 4, 1)),
        detail(spark, ("d3", "o2", "u1", "99", "1.5", 3, 2), ("d4", "o1", "u3", "11", "4", 4, 2), ("d1", "o9", "u1", "11", "12", 6, 3)),
        detail(spark, ("d3", "o2", "u1", "99", "1.25", 3, 3), ("d3", "o2", "u1", "99", "7", 3, 3), ("d2", "o1", "u7", "11", "2", 2, 0)),
    ]
    feed(spark, src, *(batches[k] for k in order))
    feed(spark, src, *(detail(spark, (f"far{k}", "f", "f", "f", "0", 900_000 + 50_000 * k, 1)) for k in range(2)))
    flows.chained(spark, job, readers.table_stream(spark, src, DETAIL, most_files=1), d, str(tmp_path / "out"), hold="30 seconds")
    every = batches[0]
    for b in batches[1:]:
        every = every.unionByName(b)
    # of two versions with one row_op_ts the one that comes later counts: the larger amount here
    want = job.batch(every.withColumn("arrival", F.col("final_amount").cast("double").cast("int")).filter("final_amount is null or final_amount <> '1.25'"), d)
    names = [c for c in want.columns if c != "user_id"]
    got = [r for r in plain(summary_of(spark, tmp_path / "out", job.name), names) if r[0].startswith("2024-01-01")]
    if order == (0, 1, 2, 3):
        assert got == plain(want, names)
    assert {(r[3], r[5], r[6], r[7]) for r in got} == {(r[3], r[5], r[6], r[7]) for r in plain(want, names)}


def test_a_killed_query_goes_on_where_it_was(spark, tmp_path):
    """The source job stopped after each file, its last batch run twice: the summary is that of one run."""
    name = "dws_trade_source_order_window"
    job, d, src, out = summary_jobs()[name], dimensions(spark), str(tmp_path / "in"), str(tmp_path / "out")
    parts = [rows_for(name, spark).filter(c) for c in ("row_op_ts < timestamp_seconds(3) and ts < 1704067210", "row_op_ts >= timestamp_seconds(3)", "ts >= 1704067210")]
    far = detail(spark, ("far", "f", "f", "f", "0", 900_000, 1)), detail(spark, ("far2", "f", "f", "f", "0", 950_000, 1))
    schema = sinks.schema_text(parts[0].schema)
    for b in (*parts, *far):
        feed(spark, src, b.select(*parts[0].columns))
        flows.chained(spark, job, readers.table_stream(spark, src, schema, most_files=1), d, out)
    commits = sorted(glob.glob(f"{out}/_checkpoints/{name}/commits/[0-9]*"), key=lambda f: int(f.rsplit("/", 1)[1]))
    folder, last = os.path.split(commits[-1])
    os.remove(commits[-1])
    os.remove(f"{folder}/.{last}.crc")
    flows.chained(spark, job, readers.table_stream(spark, src, schema, most_files=1), d, out)
    want = job.batch(rows_for(name, spark), d)
    assert [r for r in plain(summary_of(spark, out, name), want.columns) if not r[0].startswith("2024-01-1")] == plain(want, want.columns)
