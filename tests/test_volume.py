"""What queries shuffle and write on their way, and what lands in one task."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidewright.operators import joins
from tidewright.plans import catalog, job_catalog
from tidewright.plans.session import scratch
from tidewright.sources.keyed import KeyedTables

SF = "/root/testdata/sf0.001"


def shared(spark):
    return scratch(spark).removeprefix("file:")


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def made(spark, pattern, run):
    """What run returns, and the folders of that name that it makes."""
    before = set(glob.glob(f"{shared(spark)}/{pattern}"))
    out = run()
    return out, sorted(set(glob.glob(f"{shared(spark)}/{pattern}")) - before)


def test_topic_is_compressed(spark):
    texts, (path,) = made(spark, "topic-db-*", lambda: job_catalog.change_texts(spark, SF))
    assert size(path) * 4 < texts.select(F.sum(F.octet_length("value"))).first()[0]


def test_config_stream_writes_records_once_and_compressed(spark):
    _, paths = made(spark, "*", lambda: job_catalog.dim_config_stream(spark, SF))
    (path,) = paths  # nothing but the stream's own folder
    assert "/dim-stream-" in path
    texts = spark.read.text(f"{path}/all")
    assert size(f"{path}/all") * 4 < texts.select(F.sum(F.octet_length("value"))).first()[0]
    records = texts.select("part", F.get_json_object("value", "$.data").alias("d"))
    key = F.coalesce(F.get_json_object("d", "$.order_id"), F.get_json_object("d", "$.id")).cast("long")
    want = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() * n for t, n in (("lineitem", 1), ("orders", 2)))
    assert records.count() == want and records.filter(key % 2 != F.col("part")).count() == 0


def test_keyed_tables_hash_behind_the_shuffle(spark, tmp_path):
    rows = [("t", 1, str(k), "insert", k, {"id": str(k), "v": "x"}) for k in range(50)]
    df = spark.createDataFrame(rows, "table string, generation long, key string, type string, ts long, data map<string,string>")
    tables = KeyedTables(spark, str(tmp_path / "t"))
    tables.put(df, 0)
    assert glob.glob(f"{tmp_path}/t/changes/batch=0/table=t/generation=1/bucket=*/*.zstd.parquet")
    ties = spark.read.parquet(f"{tmp_path}/t/changes").select("tie", F.xxhash64(F.to_json("data")).alias("want")).collect()
    assert len(ties) == 50 and all(r.tie == r.want for r in ties)
    tables.compact()
    assert glob.glob(f"{tmp_path}/t/base/batch=0/table=t/generation=1/bucket=*/*.zstd.parquet")
    assert tables.read("t", 1, ["id", "v"]).count() == 50


@pytest.mark.parametrize("query", [job_catalog.dim_route, job_catalog.dwd_base_db, catalog.config_route])
def test_routing_does_not_shuffle_records(spark, query):
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the records are small here
    try:
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert "SortMergeJoin" not in plan and "hashpartitioning(table" not in plan and "BroadcastHashJoin" in plan


def test_parsed_records_are_compressed(spark):
    _, (path,) = made(spark, "changes-*", lambda: job_catalog.order_rows(spark, SF))
    files = glob.glob(f"{path}/table=*/part-*")
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_details_are_shuffled_once(spark):
    detail = spark.createDataFrame([(f"d{k}", f"o{k % 4}") for k in range(8)], "id string, order_id string")
    info = spark.createDataFrame([("o0", "s0"), ("o1", "s1"), ("o2", None), ("o1", "s9")], "id string, session_id string")
    visits = spark.createDataFrame([("s0", "7"), ("s0", "8"), ("s9", None)], "session_id string, source_id string")
    rest = [c for c in joins.NAMES if c not in ("id", "order_id", "session_id", "source_id", "ts", "province_id", "out_trade_no", "trade_body")]
    detail = detail.withColumns({c: F.lit(c) for c in rest}).withColumn("ts", F.lit(1).cast("long"))
    info = info.withColumns({c: F.lit(c) for c in ("province_id", "out_trade_no", "trade_body")})
    pay = spark.createDataFrame([("o0",), ("o2",)], "order_id string").withColumns({c: F.lit(c) for c in ("alipay_trade_no", "trade_body", "payment_type", "payment_status", "callback_time", "callback_content")}).withColumn("ts", F.lit(2).cast("long"))
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.order_details(detail, info, visits)
        paid = joins.paid_details(pay, out)
        rows = sorted((r.id, r.session_id, r.source_id) for r in out.fillna("-").collect())
        # by session: orders and visits; by order: both of them, details and payments
        counts = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (out, paid)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert rows == sorted([("d0", "s0", "7"), ("d0", "s0", "8"), ("d4", "s0", "7"), ("d4", "s0", "8"), ("d1", "s1", "-"), ("d1", "s9", "-"), ("d5", "s1", "-"), ("d5", "s9", "-"), ("d2", "-", "-"), ("d6", "-", "-")])
    assert counts == [4, 5]
    assert sorted((r.id, r.ts) for r in paid.collect()) == sorted((r[0], 2) for r in rows if r[0] not in ("d1", "d5"))


def test_upserted_details_are_joined_once(spark):
    out, paths = made(spark, "upsert-*", lambda: job_catalog.upserted_details(spark, SF))
    # the batches read these rows, which are whole
    (rows,) = [p for p in paths if p.endswith("-rows")]
    details = job_catalog.details(spark, SF)
    assert spark.read.parquet(rows).count() == details.count()
    assert out.count() == details.select("id").distinct().count()
    # one shuffle, and no sort before it
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan[plan.index("Exchange") :]
