"""Per-key operators by the clock instead of event time: state with the store's own time to live, holds by processing-time
timers. This is how the original jobs run them: a hold is so long after the first sight of a key, and what is known of a
key is forgotten so long after it was last written; reading it doesn't prolong it.

Rows come out without a watermark, so a step is a query of its own (flows.summary with state=clocked, once=False: the clock has no end). Replays may differ
where the clock decides, as they may in the original; tidewright.streaming.processors goes by event time alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from . import processors as p
from .chain import _bare


def _clocked(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: StructType) -> DataFrame:
    return rows.groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")


class _Forgetting:
    """Mixed into a processor with one text of state: the store forgets it, ttl_ms after its last write. Nothing is kept of
    keys and no timer is needed."""

    ttl_ms: int | None = None

    def init(self, handle) -> None:
        self.ttl, self.handle = None, handle
        self.state = handle.getValueState("seen", "value STRING", self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return iter(())


class _FirstOfDay(_Forgetting, p.FirstOfDay):
    def handleInputRows(self, key, rows, timerValues):
        last = known = self.seen()
        for r in p._sorted(rows, self.order):
            if last is None or r[self.day] > last:
                last = r[self.day]
                yield r
        if last != known:  # a write alone prolongs what is known
            self.state.update((last,))


class _FlagFirst(_Forgetting, p.FlagFirst):
    def handleInputRows(self, key, rows, timerValues):
        known = fresh = self.seen() is None
        for r in p._sorted(rows, self.order):
            yield p.Row(**{c: r[c] for c in self.columns}, **{self.name: int(fresh)})
            fresh = False
        if known:
            self.state.update(("1",))


class _Visitors(_Forgetting, p.Visitors):
    pass


class _Latest(p.Latest):
    """Holds the row of largest order until hold_ms after the key was first seen."""

    def handleInputRows(self, key, rows, timerValues):
        best = self.held()
        if best is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hold_ms)
        self.hold(p._sorted([*([best] if best else []), *rows], self.order)[-1])
        return iter(())


def _made(processor: StatefulProcessor, ttl_ms: int | None) -> StatefulProcessor:
    processor.ttl_ms = ttl_ms
    return processor


def first_of_day(rows: DataFrame, keys: list[str], day: str, order: list[str], literal: bool = False, ttl_ms: int | None = p.DAY_MS) -> DataFrame:
    mark = order[0] if literal else day
    out = rows.withColumn("_mark", p.F.date_format(mark, "yyyy-MM-dd HH:mm:ss") if literal and dict(rows.dtypes)[mark].startswith("timestamp") else p.F.col(mark).cast("string"))
    return _clocked(out, keys, _made(_FirstOfDay("_mark", order, None), ttl_ms), _bare(out.schema)).drop("_mark")


def flag_first(rows: DataFrame, keys: list[str], order: list[str], name: str, ttl_ms: int | None = p.DAY_MS) -> DataFrame:
    return _clocked(rows, keys, _made(_FlagFirst(order, name, rows.columns, None), ttl_ms), _bare(rows.schema).add(name, "long"))


def visitors_and_new(rows: DataFrame, user: str, day: str, order: list[str], uv: str, new: str, literal: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """Without ttl_ms, first orders of all are remembered for ever, as they must be."""
    schema = _bare(rows.schema).add(new, "long").add(uv, "long")
    return _clocked(rows, [user], _made(_Visitors(day, order, uv, new, rows.columns, literal), ttl_ms), schema)


def latest(rows: DataFrame, keys: list[str], order: list[str], hold_ms: int = 5_000) -> DataFrame:
    schema = _bare(rows.schema)
    return _clocked(rows, keys, _Latest(schema, order, "et", hold_ms), schema)
