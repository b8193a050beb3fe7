"""Sequence patterns against a loop over the events, in batch and in streams."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators import patterns, stateful
from tidewright.operators.patterns import Pattern
from tidewright.sources import readers, sinks
from tidewright.streaming import patterns as runs


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Each stateful step of each micro-batch has a task and a store for each: two show as much as more."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)

T0 = 1_704_067_200_000
PATTERNS = {
    "bounce": Pattern.begin("first", "kind = 'a'").next("second", "kind = 'a'").within(10_000),
    "funnel": Pattern.begin("a", "kind = 'a'").followed_by("b", "kind = 'b'").followed_by("c", "kind = 'c'").within(20_000),
    "mixed": Pattern.begin("a", "kind = 'a'").followed_by("b", "kind = 'b'").next("c", "kind = 'c'").within(15_000),
    "strict": Pattern.begin("a", "kind = 'a'").next("b", "kind IN ('b', 'c')").next("c", "kind = 'c'").within(30_000),
    "single": Pattern.begin("b", "kind = 'b'").within(5),
}
STRICT = {n: [s.strict for s in p.steps] for n, p in PATTERNS.items()}
MEETS = {"bounce": ["a", "a"], "funnel": ["a", "b", "c"], "mixed": ["a", "b", "c"], "strict": ["a", "bc", "c"], "single": ["b"]}


def brute(events, name, within):
    """events: (n, key, millis, kind) -> {n: (outcome, times)}; n begins a run. Each run by itself."""
    out = {}
    ordered = sorted(events, key=lambda e: (e[2], e[0]))
    for i, (n, key, start, kind) in enumerate(ordered):
        if kind is None or kind not in MEETS[name][0]:
            continue
        at, step, outcome = [], 1, "timeout" if within else None
        for _, k, t, other in ordered[i + 1 :]:
            if step == len(MEETS[name]):
                break
            if k != key:
                continue
            if within and t - start >= within:
                break
            if other is not None and other in MEETS[name][step]:
                at.append(t)
                step += 1
            elif STRICT[name][step]:
                outcome = None
                break
        if step == len(MEETS[name]):
            outcome = "match"
        if outcome:
            out[n] = (outcome, at)
    return out


def frame(spark, events):
    return spark.createDataFrame(events, "n long, key string, millis long, kind string").withColumn("et", F.timestamp_millis("millis"))


EVENTS = st.lists(st.tuples(st.sampled_from("xy"), st.integers(0, 60), st.sampled_from(["a", "b", "c", "d", None])), max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events=EVENTS)
def test_batch_patterns(spark, events):
    rows = [(n, k, T0 + 1000 * t, kind) for n, (k, t, kind) in enumerate(events)]
    df = frame(spark, rows).cache()
    for name, pattern in PATTERNS.items():
        for p, within in ((pattern, pattern.millis), (Pattern(pattern.steps), None)):
            got = {r.n: (r._outcome, r._at) for r in patterns.match(df, p, ["key"], "millis", ["millis", "n"]).collect()}
            assert got == brute(rows, name, within), name
    alone = stateful.bounces(df, "key", F.col("kind") == "a", "millis", ["millis", "n"])
    assert sorted(r.n for r in alone.collect()) == sorted(brute(rows, "bounce", 10_000))


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_stream_patterns_equal_batch(spark, tmp_path, name):
    """A file a batch; runs that are open when a batch ends go on in the next, or are timed out by the watermark."""
    kinds = "abcaab d cabbcaacdabc"
    rows = [(n, "xy"[n % 5 == 4], T0 + 3000 * n + (9000 if n > 12 else 0), None if kind == " " else kind) for n, kind in enumerate(kinds)]
    far = [(100 + k, "far", T0 + 900_000 + 100_000 * k, "d") for k in range(3)]
    src = str(tmp_path / "in")
    for part in (rows[:4], rows[4:9], rows[9:15], rows[15:], far[:1], far[1:2], far[2:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
    stream = readers.table_stream(spark, src, sinks.schema_text(frame(spark, []).schema), most_files=1)
    sinks.run(runs.match(stream, PATTERNS[name], ["key"], "millis", ["millis", "n"]), sinks.replace_batch(str(tmp_path / "out")), str(tmp_path / "cp"))
    got = {r.n: (r._outcome, r._at) for r in spark.read.schema("n long, key string, _outcome string, _at array<long>").parquet(str(tmp_path / "out")).collect()}
    assert got == brute(rows, name, PATTERNS[name].millis)
    with pytest.raises(ValueError, match="within"):
        runs.match(stream, Pattern(PATTERNS[name].steps), ["key"], "millis", ["millis"])
