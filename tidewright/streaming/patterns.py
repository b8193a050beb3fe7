"""Sequence patterns in streams: the runs of a key that are under way are its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ..operators.patterns import Pattern, marked
from .chain import _bare
from .processors import _sorted


class Runs(StatefulProcessor):
    """A timer stands at the earliest end of a run; when the watermark has passed it, the run is timed out."""

    def __init__(self, schema: StructType, state: StructType, strict: list[bool], within: int, millis: str, order: list[str]):
        self.schema, self.kept, self.strict, self.within, self.millis, self.order = schema, state, strict, within, millis, order

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", self.kept)

    def _load(self) -> list[dict]:
        return [dict(zip(self.kept.names, r, strict=True)) for r in self.runs.get()] if self.runs.exists() else []

    def _keep(self, runs: list[dict]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if runs:
            self.runs.put([tuple(r[c] for c in self.kept.names) for r in runs])
            self.handle.registerTimer(min(r[self.millis] for r in runs) + self.within)
        else:
            self.runs.clear()

    def _out(self, run: dict, outcome: str) -> Row:
        return Row(**{c: run[c] for c in self.schema.names}, _outcome=outcome, _at=list(run["_at"]))

    def handleInputRows(self, key, rows, timerValues):
        runs = self._load()
        for r in _sorted(rows, self.order):
            going = []
            for run in runs:
                step = len(run["_at"]) + 1
                if r[self.millis] - run[self.millis] >= self.within:
                    yield self._out(run, "timeout")
                elif r[f"_c{step}"]:
                    run = run | {"_at": [*run["_at"], r[self.millis]]}
                    if step == len(self.strict) - 1:
                        yield self._out(run, "match")
                    else:
                        going.append(run)
                elif not self.strict[step]:
                    going.append(run)
            if r["_c0"]:
                run = {c: r[c] for c in self.schema.names} | {"_at": []}
                if len(self.strict) == 1:
                    yield self._out(run, "match")
                else:
                    going.append(run)
            runs = going
        self._keep(runs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, going = expiredTimerInfo.getExpiryTimeInMs(), []
        for run in self._load():
            if run[self.millis] + self.within <= now:
                yield self._out(run, "timeout")
            else:
                going.append(run)
        self._keep(going)

    def close(self) -> None:
        pass


def match(rows: DataFrame, pattern: Pattern, keys: list[str], millis: str, order: list[str], event_time: str = "et", delay: str = "0 seconds") -> DataFrame:
    """As tidewright.operators.patterns.match, in a stream; runs must end, so the pattern has a `within`. Events of a key
    are taken in order within a micro-batch; what comes later than the delay is dropped."""
    if pattern.millis is None:
        raise ValueError("in a stream a pattern needs within(), or its runs would never end")
    own = _bare(rows.schema)
    kept = _bare(own).add("_at", ArrayType(LongType()))
    out = _bare(own).add("_outcome", StringType()).add("_at", ArrayType(LongType()))
    source = marked(rows, pattern).withWatermark(event_time, delay)
    runs = Runs(own, kept, [s.strict for s in pattern.steps], pattern.millis, millis, order)
    return source.groupBy(*keys).transformWithState(statefulProcessor=runs, outputStructType=out, outputMode="Append", timeMode="EventTime")
