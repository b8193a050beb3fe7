"""Per-key operators in their streaming form: the functions of tidewright.operators.stateful, with the same contracts, over
arbitrary-state processors. State is bounded as far as the contract allows: by a time to live in event time where an old
value can't matter any more (a timer clears it once the watermark has passed its last use by that much), else by the number
of keys. Where a time to live holds, rows later than the delay are dropped, as windows after it would.

A micro-batch hands over the rows of a key in no order; processors sort them by the order columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, StructType

DAY_MS = 86_400_000


def _apply(rows: DataFrame, keys: list[str], make: Callable[[], StatefulProcessor], schema: StructType, time: str = "None") -> DataFrame:
    return rows.groupBy(*keys).transformWithState(statefulProcessor=make(), outputStructType=schema, outputMode="Append", timeMode=time)


def _living(rows: DataFrame, ttl_ms: int | None, event_time: str, delay: str) -> tuple[DataFrame, tuple[str, int] | None, str]:
    """Rows with a watermark, what a processor has to know of the time to live, and the time mode; none without ttl_ms, or
    without an event time."""
    if not ttl_ms or dict(rows.dtypes).get(event_time) != "timestamp":
        return rows, None, "None"
    return rows.withWatermark(event_time, delay), (event_time, ttl_ms), "EventTime"


def _plus(rows: DataFrame, *names: str) -> StructType:
    out = StructType([f for f in rows.schema.fields if f.name not in names])
    for n in names:
        out = out.add(n, "long")
    return out


def _sorted(rows: Iterator[Row], order: list[str]) -> list[Row]:
    return sorted(rows, key=lambda r: _rank(r, order))


def _rank(row: Row, order: list[str]) -> tuple:
    return tuple((row[c] is not None, _plain_time(row[c])) for c in order)


def _plain_time(v):
    """Times of rows have a zone, those of state have none, in local time: without one they compare."""
    return v.astimezone().replace(tzinfo=None) if isinstance(v, datetime) and v.tzinfo else v


class _Expiring(StatefulProcessor):
    """A processor whose state a timer clears, `ttl` (event time column, milliseconds) after its last use."""

    ttl: tuple[str, int] | None = None

    def expect(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "value BIGINT") if self.ttl else None

    def used(self, rows: list[Row], timers) -> None:
        if self.ttl is None:
            return
        last = max((int(r[self.ttl[0]].timestamp() * 1000) for r in rows if r[self.ttl[0]] is not None), default=0)
        at = max(last, timers.getCurrentWatermarkInMs()) + self.ttl[1]
        old = self.until.get()[0] if self.until.exists() else None
        if old is None or at > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.until.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


class _OneText(_Expiring):
    """A processor with one text of state."""

    def __init__(self, order: list[str], ttl: tuple[str, int] | None = None):
        self.order, self.ttl = order, ttl

    def init(self, handle) -> None:
        self.expect(handle)
        self.state = handle.getValueState("seen", "value STRING")

    def seen(self) -> str | None:
        found = self.state.get() if self.state.exists() else None
        return found[0] if found else None


class FirstOfDay(_OneText):
    def __init__(self, day: str, order: list[str], ttl: tuple[str, int] | None):
        super().__init__(order, ttl)
        self.day = day

    def handleInputRows(self, key, rows, timerValues):
        last, now = self.seen(), _sorted(rows, self.order)
        for r in now:
            if last is None or r[self.day] > last:
                last = r[self.day]
                yield r
        if last is not None:
            self.state.update((last,))
            self.used(now, timerValues)


class FlagFirst(_OneText):
    def __init__(self, order: list[str], name: str, columns: list[str], ttl: tuple[str, int] | None):
        super().__init__(order, ttl)
        self.name, self.columns = name, columns

    def handleInputRows(self, key, rows, timerValues):
        fresh, now = self.seen() is None, _sorted(rows, self.order)
        for r in now:
            yield Row(**{c: r[c] for c in self.columns}, **{self.name: int(fresh)})
            fresh = False
        self.state.update(("1",))
        self.used(now, timerValues)


class Visitors(_OneText):
    def __init__(self, day: str, order: list[str], uv: str, new: str, columns: list[str], literal: bool):
        super().__init__(order)
        self.day, self.uv, self.new, self.columns, self.literal = day, uv, new, columns, literal

    def handleInputRows(self, key, rows, timerValues):
        last = self.seen()
        for r in _sorted(rows, self.order):
            if last is None or r[self.day] > last:
                yield Row(**{c: r[c] for c in self.columns}, **{self.new: int(last is None), self.uv: 1})
                if last is None or not self.literal:
                    last = r[self.day]
        if last is not None:
            self.state.update((last,))


class RepairNewVisitor(_OneText):
    def __init__(self, is_new: str, mark: str, order: list[str], columns: list[str]):
        super().__init__(order)
        self.is_new, self.mark, self.columns = is_new, mark, columns

    def handleInputRows(self, key, rows, timerValues):
        first = self.seen()
        for r in _sorted(rows, self.order):
            if first is None:
                first = str(r[self.mark]) if r[self.is_new] == "1" else ""
            fixed = "1" if r[self.is_new] == "1" and str(r[self.mark]) == first else "0"
            yield Row(**{c: fixed if c == self.is_new else r[c] for c in self.columns})
        if first is not None:
            self.state.update((first,))


class _Held(_Expiring):
    """A processor that holds one row."""

    def __init__(self, schema: StructType, order: list[str]):
        self.schema, self.order = schema, order

    def init(self, handle) -> None:
        self.expect(handle)
        self.state = handle.getValueState("held", self.schema)

    def held(self) -> Row | None:
        found = self.state.get() if self.state.exists() else None
        return Row(**dict(zip(self.schema.names, found, strict=True))) if found else None

    def hold(self, row: Row) -> None:
        self.state.update(tuple(row[c] for c in self.schema.names))


class Latest(_Held):
    """Holds the row of largest order until the watermark has passed its first sight by hold_ms, and gives it out once."""

    def __init__(self, schema: StructType, order: list[str], event_time: str, hold_ms: int):
        super().__init__(schema, order)
        self.et, self.hold_ms = event_time, hold_ms

    def handleInputRows(self, key, rows, timerValues):
        best = self.held()
        if best is None:
            new = _sorted(rows, self.order)
            at = max(int(min(r[self.et] for r in new).timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.hold_ms
            self.handle.registerTimer(at)
            best = new[-1]
        else:
            best = _sorted([best, *rows], self.order)[-1]
        self.hold(best)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        best = self.held()
        if best is not None:
            self.state.clear()
            yield best


class Retract(_Held):
    def __init__(self, schema: StructType, order: list[str], amounts: list[str], ttl: tuple[str, int] | None):
        super().__init__(schema, order)
        self.amounts, self.ttl = amounts, ttl

    def handleInputRows(self, key, rows, timerValues):
        last, now = self.held(), _sorted(rows, self.order)
        for r in now:
            if last is not None:
                yield Row(**{c: (-last[c] if c in self.amounts and last[c] is not None else last[c]) for c in self.schema.names}, _sign=-1)
            yield Row(**{c: r[c] for c in self.schema.names}, _sign=1)
            last = r
        if last is not None:
            self.hold(last)
            self.used(now, timerValues)


class Bounces(_Held):
    """Holds the last event of a visitor until the next one, or until the watermark has passed it by `within`."""

    def __init__(self, schema: StructType, millis: str, order: list[str], within: int):
        super().__init__(schema, order)
        self.millis, self.within = millis, within

    def handleInputRows(self, key, rows, timerValues):
        last = self.held()
        for r in _sorted(rows, self.order):
            if last is not None and last["_entry"] and (r["_entry"] or r[self.millis] - last[self.millis] >= self.within):
                yield last
            last = r
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if last is not None:
            self.hold(last)
            self.handle.registerTimer(max(last[self.millis], timerValues.getCurrentWatermarkInMs()) + self.within)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.held()
        if last is not None:
            self.state.clear()
            if last["_entry"]:
                yield last


def first_of_day(rows: DataFrame, keys: list[str], day: str, order: list[str], literal: bool = False, ttl_ms: int | None = DAY_MS, event_time: str = "et", delay: str = "1 day") -> DataFrame:
    mark = order[0] if literal else day
    out = rows.withColumn("_mark", F.date_format(mark, "yyyy-MM-dd HH:mm:ss") if literal and dict(rows.dtypes)[mark].startswith("timestamp") else F.col(mark).cast("string"))
    out, ttl, time = _living(out, ttl_ms, event_time, delay)
    return _apply(out, keys, lambda: FirstOfDay("_mark", order, ttl), out.schema, time).drop("_mark")


def flag_first(rows: DataFrame, keys: list[str], order: list[str], name: str, ttl_ms: int | None = DAY_MS, event_time: str = "et", delay: str = "1 day") -> DataFrame:
    schema = _plus(rows, name)
    rows, ttl, time = _living(rows, ttl_ms, event_time, delay)
    return _apply(rows, keys, lambda: FlagFirst(order, name, [c for c in schema.names if c != name], ttl), schema, time)


def visitors_and_new(rows: DataFrame, user: str, day: str, order: list[str], uv: str, new: str, literal: bool = False) -> DataFrame:
    schema = _plus(rows, new, uv)
    return _apply(rows, [user], lambda: Visitors(day, order, uv, new, [c for c in schema.names if c not in (uv, new)], literal), schema)


def repair_new_visitor(rows: DataFrame, mid: str, is_new: str, day: str, order: list[str], literal: bool = False) -> DataFrame:
    return _apply(rows, [mid], lambda: RepairNewVisitor(is_new, order[0] if literal else day, order, rows.columns), rows.schema)


def latest(rows: DataFrame, keys: list[str], order: list[str], event_time: str = "et", delay: str = "0 seconds", hold_ms: int = 5_000) -> DataFrame:
    schema = rows.schema
    return _apply(rows.withWatermark(event_time, delay), keys, lambda: Latest(schema, order, event_time, hold_ms), schema, "EventTime")


def retractions(rows: DataFrame, key: str, order: list[str], amounts: list[str], ttl_ms: int | None = None, event_time: str = "et", delay: str = "1 day") -> DataFrame:
    schema = rows.schema
    rows, ttl, time = _living(rows, ttl_ms, event_time, delay)
    return _apply(rows, [key], lambda: Retract(schema, order, amounts, ttl), StructType([*schema.fields]).add("_sign", IntegerType()), time)


def bounces(rows: DataFrame, mid: str, entry: Column, millis: str, order: list[str], within: int = 10_000, event_time: str = "et", delay: str = "0 seconds") -> DataFrame:
    marked = rows.withColumn("_entry", F.coalesce(entry, F.lit(False))).withWatermark(event_time, delay)
    schema = marked.schema
    return _apply(marked, [mid], lambda: Bounces(schema, millis, order, within), schema, "EventTime").drop("_entry")
