"""The committing sink: failed tasks and batches leave nothing, repeated ones add nothing, each row goes to its topic."""

import glob
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewright.sources import readers
from tidewright.sources.transactional import TopicsWriter, TransactionalTopics, read_topic


def values(spark, path, topic):
    return sorted((r.value for r in read_topic(spark, path, topic).collect()), key=str)


def failing(rows, after):
    for k, r in enumerate(rows):
        if k == after:
            raise OSError("lost")
        yield r


def test_a_task_that_fails_twice_leaves_no_row(spark, tmp_path):
    path, rows = str(tmp_path / "t"), [Row(topic="ab"[k % 2], value=f"v{k}\n\"é") for k in range(7)] + [Row(topic=None, value=None)]
    writer = TopicsWriter({"path": path, "rows": "2"})
    for after in (5, 7):
        with pytest.raises(OSError, match="lost"):
            writer.write(failing(rows, after))
        assert glob.glob(f"{path}/staged/*") == []
    good, late = writer.write(iter(rows)), writer.write(iter(rows))  # a task and its speculative copy
    assert values(spark, path, "a") == []  # staged is not committed
    writer.commit([good, None, TopicsWriter({"path": path}).write(iter([]))], 0)
    writer.commit([late], 0)  # the batch again
    assert values(spark, path, "a") == sorted(r.value for r in rows if r.topic == "a") and values(spark, path, "b") == sorted(r.value for r in rows if r.topic == "b")
    assert values(spark, path, None) == [None] and values(spark, path, "c") == []
    writer.abort([writer.write(iter(rows)), None], 1)
    assert len(glob.glob(f"{path}/staged/*")) == len(good.files)


def test_a_stream_that_fails_and_repeats(spark, tmp_path):
    path, src, cp, flag = (str(tmp_path / x) for x in ("t", "in", "cp", "flag"))
    spark.dataSource.register(TransactionalTopics)
    feed = lambda *rows: spark.createDataFrame(rows, "topic string, value string").repartition(3).write.mode("append").parquet(src)

    def maybe(batches):
        for b in batches:
            if os.path.exists(flag) and (b["value"] == "bad").any():
                raise OSError("lost")
            yield b

    def run():
        stream = readers.table_stream(spark, src, "topic string, value string").repartition(3, F.col("value")).mapInPandas(maybe, "topic string, value string")
        query = stream.writeStream.format("transactional_topics").option("path", path).option("label", "x").option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination()

    feed(*[("a", f"{k}") for k in range(9)])
    run()
    feed(("b", "bad"), *[("a", f"more{k}") for k in range(9)])
    open(flag, "w").close()
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run()
        assert len(values(spark, path, "a")) == 9 and values(spark, path, "b") == []
    os.remove(flag)
    run()
    assert len(set(values(spark, path, "a"))) == len(values(spark, path, "a")) == 18 and values(spark, path, "b") == ["bad"]
    last = max(glob.glob(f"{cp}/commits/[0-9]*"), key=lambda f: int(f.rsplit("/", 1)[1]))
    os.remove(last)
    os.remove(f"{cp}/commits/.{os.path.basename(last)}.crc")
    run()  # the batch again, from its own log
    assert len(values(spark, path, "a")) == 18 and values(spark, path, "b") == ["bad"]
