"""Batch stateful operators against plain loops over the rows in order."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators import stateful

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
EVENTS = st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("01"), st.integers(0, 3 * 86_400 - 1)), min_size=1, max_size=14)
SCHEMA = "n int, mid string, flag string, ts int, day int"


def frame(spark, events):
    rows = [(n, m, f, t, t // 86_400) for n, (m, f, t) in enumerate(events)]
    return spark.createDataFrame(rows, SCHEMA), sorted(rows, key=lambda r: (r[3], r[0]))


@FEW
@given(events=EVENTS)
def test_repair_new_visitor(spark, events):
    for literal in (False, True):
        df, rows = frame(spark, events)
        state, want = {}, {}
        for n, mid, flag, ts, day in rows:
            mark = ts if literal else day
            if mid not in state:
                state[mid] = mark if flag == "1" else None
            want[n] = "1" if flag == "1" and state[mid] == mark else "0"
        assert {r.n: r.flag for r in stateful.repair_new_visitor(df, "mid", "flag", "day", ["ts", "n"], literal).collect()} == want


@FEW
@given(events=EVENTS)
def test_first_of_day_and_flags(spark, events):
    df, rows = frame(spark, events)
    last, first = {}, []
    for n, mid, _, _, day in rows:
        if last.get(mid, -1) < day:
            last[mid] = day
            first.append(n)
    assert sorted(r.n for r in stateful.first_of_day(df, ["mid"], "day", ["ts", "n"]).collect()) == sorted(first)
    assert sorted(r.n for r in stateful.flag_first(df, ["mid", "day"], ["ts", "n"], "uv").filter("uv = 1").collect()) == sorted(first)
    instants = {(m, t) for _, m, _, t, _ in rows}
    assert stateful.first_of_day(df, ["mid"], "day", ["ts", "n"], literal=True).count() == len(instants)


@FEW
@given(events=EVENTS)
def test_visitors_and_new(spark, events):
    for literal in (False, True):
        df, rows = frame(spark, events)
        state, want = {}, []
        for n, mid, _, _, day in rows:
            if mid not in state:
                state[mid] = day
                want.append((n, 1, 1))
            elif state[mid] < day:
                want.append((n, 1, 0))
                if not literal:
                    state[mid] = day
        got = stateful.visitors_and_new(df, "mid", "day", ["ts", "n"], "uv", "new", literal).select("n", "uv", "new")
        assert sorted(map(tuple, got.collect())) == sorted(want)


@FEW
@given(events=EVENTS)
def test_latest_and_retractions(spark, events):
    df, rows = frame(spark, events)
    last = {}
    for r in rows:
        last[r[1]] = r
    assert sorted(map(tuple, stateful.latest(df, ["mid"], ["ts", "n"]).collect())) == sorted(last.values())
    out = stateful.retractions(df.withColumn("amount", F.col("ts")), "mid", ["ts", "n"], ["amount"])
    assert out.agg(F.sum("amount")).first()[0] == sum(r[3] for r in last.values())
    assert out.agg(F.sum("_sign")).first()[0] == len(last)


@FEW
@given(events=EVENTS)
def test_bounces(spark, events):
    df, rows = frame(spark, events)
    want = []
    for i, (n, mid, flag, ts, _) in enumerate(rows):
        after = next((r for r in rows[i + 1 :] if r[1] == mid), None)
        if flag == "1" and (after is None or after[3] - ts >= 10_000 or after[2] == "1"):
            want.append(n)
    assert sorted(r.n for r in stateful.bounces(df, "mid", F.col("flag") == "1", "ts", ["ts", "n"], 10_000).collect()) == sorted(want)


def test_bounce_edges(spark):
    """Ten seconds sharp is timed out; a page within ten seconds is no bounce; a null amount stays null when negated."""
    df = spark.createDataFrame([("a", True, 0), ("a", False, 10_000), ("b", True, 0), ("b", False, 9_999), ("c", True, 0)], "mid string, e boolean, ts long")
    assert sorted(r.mid for r in stateful.bounces(df, "mid", F.col("e"), "ts", ["ts"]).collect()) == ["a", "c"]
    everyone = stateful.bounces(df, "mid", F.lit(True), "ts", ["ts"])
    assert everyone.count() == 5
    out = stateful.retractions(spark.createDataFrame([("1", 1, None), ("1", 2, 5)], "id string, n int, amount int"), "id", ["n"], ["amount"])
    assert sorted((r.n, r._sign, r.amount) for r in out.filter("n = 1").collect()) == [(1, -1, None), (1, 1, None)]
