"""A stream that begins with a snapshot and goes over to the log, killed at every turn."""

import glob
import json
import os
import time
from collections import Counter

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tidewright.operators import parse
from tidewright.sources import sinks
from tidewright.sources.handover import SCHEMA, SnapshotThenLog


def log(folder, first, n):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{first:012d}", "w") as f:
        for pos in range(first, first + n):
            row = {"id": pos % 7, "v": f"v{pos}"}
            f.write(json.dumps({"before": row if pos % 5 == 0 else None, "after": None if pos % 5 == 0 else row, "op": "d" if pos % 5 == 0 else "u", "ts_ms": pos * 10, "pos": pos}) + "\n")
    os.rename(f"{folder}/.{first:012d}", f"{folder}/{first:012d}.json")


def seen(spark, out):
    if not glob.glob(f"{out}/batch=*/*.parquet"):
        return Counter()
    rows = spark.read.schema(f"{SCHEMA}, batch long").parquet(out)
    return Counter((r.pos, (r.after or r.before)["id"] if r.op == "r" else None) for r in rows.collect())


def test_handover(spark, tmp_path):
    snap, logs, out, cp = (str(tmp_path / x) for x in ("snap", "log", "out", "cp"))
    spark.range(40).selectExpr("id", "'first' AS v").repartition(4).write.parquet(snap)
    log(logs, 90, 20)  # positions under 100 are in the snapshot
    spark.dataSource.register(SnapshotThenLog)

    def start():
        stream = spark.readStream.format("snapshot_then_log").options(snapshot=snap, log=logs, low=100, chunks=1, positions=6).load()
        return sinks.run(stream, sinks.replace_batch(out), cp, once=False, every="300 milliseconds")

    def until(done):
        query, begun = start(), time.time()
        try:
            while time.time() - begun < 60:
                assert query.exception() is None, query.exception()
                time.sleep(0.5)
                try:  # a batch that runs again may replace a file while it is read
                    if done(seen(spark, out)):
                        break
                except Py4JJavaError:
                    continue
        finally:
            query.stop()
        return seen(spark, out)

    snapshot = {(99, str(k)) for k in range(40)}
    part = until(lambda s: len(s) >= 5)
    assert set(part) <= snapshot | {(p, None) for p in range(100, 110)}
    for first, upto in ((110, 115), (115, 131)):
        got = until(lambda s, n=first: len(s) >= 40 + n - 100)
        assert set(got) == snapshot | {(p, None) for p in range(100, first)} and set(got.values()) == {1}
        # the last batch runs again, and the log has grown
        last = max(glob.glob(f"{cp}/commits/[0-9]*"), key=lambda f: int(f.rsplit("/", 1)[1]))
        for f in (last, f"{cp}/commits/.{os.path.basename(last)}.crc"):
            os.path.exists(f) and os.remove(f)
        log(logs, first, upto - first)
    got = until(lambda s: len(s) >= 40 + 31)
    assert set(got) == snapshot | {(p, None) for p in range(100, 131)} and set(got.values()) == {1}
    # the batches come in order: all of the snapshot, then the log
    rows = spark.read.schema(f"{SCHEMA}, batch long").parquet(out)
    by_batch = [r.pos for r in rows.groupBy("batch").agg(F.min("pos").alias("pos")).orderBy("batch").collect()]
    assert by_batch == sorted(by_batch)
    now = parse.decode_cdc(rows.withColumn("ts_ms", F.col("pos")))
    assert now.filter("op = 'd'").count() == 7 and now.count() == 71
