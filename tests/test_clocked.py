"""Holds and times to live by the clock, step by step: a step is a micro-batch at a time of its own."""

import time

import pytest
from pyspark.sql import functions as F

from tidewright.sources import readers, sinks
from tidewright.streaming import clocked

SCHEMA = "k string, day string, v long"


class Steps:
    """A query that runs all the while: processing time goes on without data, so it never has all that is available."""

    def __init__(self, spark, root, make):
        self.spark, self.root, self.begun, self.batch = spark, str(root), None, -1
        spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/in")
        self.query = sinks.run(make(readers.table_stream(spark, f"{root}/in", SCHEMA)), sinks.replace_batch(f"{root}/out"), f"{root}/cp", once=False, every="500 milliseconds")

    def at(self, second, *rows, wait=6):
        """Feed rows `second` seconds after the first ones, and see what has come out `wait` seconds later at most."""
        if self.begun is not None:
            time.sleep(max(0.0, self.begun + second - time.time()))
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        self.begun = self.begun or time.time()
        time.sleep(wait)
        assert self.query.exception() is None
        got = self.spark.read.schema(f"{SCHEMA}, one long, batch long").parquet(f"{self.root}/out").filter(F.col("batch") > self.batch).collect()
        self.batch = max([self.batch, *(r.batch for r in got)])
        return sorted((r.k, r.v, r.one) for r in got)


@pytest.fixture
def steps(spark, tmp_path):
    made = []

    def make(f):
        made.append(Steps(spark, tmp_path / str(len(made)), f))
        return made[-1]

    yield make
    for s in made:
        s.query.stop()


def test_hold_by_the_clock(steps):
    """The last version within the hold comes out once it is over; a version after that begins a hold of its own."""
    s = steps(lambda rows: clocked.latest(rows, ["k"], ["v"], hold_ms=16_000))
    assert s.at(0, ("a", "d", 1)) == []
    assert s.at(6, ("a", "d", 3), ("a", "d", 2)) == []
    assert s.at(20) == [("a", 3, None)]
    assert s.at(27, ("a", "d", 2)) == []
    assert s.at(48) == [("a", 2, None)]


def test_time_to_live_begins_at_writes(steps):
    """A read doesn't prolong what is known (a), a write does (b): on create and write."""
    s = steps(lambda rows: clocked.first_of_day(rows, ["k"], "day", ["v"], ttl_ms=22_000))
    flags = steps(lambda rows: clocked.flag_first(rows, ["k"], ["v"], "one", ttl_ms=22_000))
    assert s.at(0, ("a", "1", 1), ("b", "1", 1), ("a", "1", 2)) == [("a", 1, None), ("b", 1, None)]
    assert flags.at(0, ("a", "1", 1), ("a", "1", 2)) == [("a", 1, 1), ("a", 2, 0)]
    assert s.at(12, ("a", "1", 3), ("b", "2", 3)) == [("b", 3, None)]
    assert flags.at(12, ("a", "1", 3)) == [("a", 3, 0)]
    assert s.at(28, ("a", "1", 4), ("b", "2", 4)) == [("a", 4, None)]
    assert flags.at(30, ("a", "1", 4)) == [("a", 4, 1)]
