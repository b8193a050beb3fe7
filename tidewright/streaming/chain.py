"""Per-key operators as links of one streaming query: the functions of tidewright.operators.stateful again, for rows that
have a watermark already (begin), under one checkpoint and without tables between the steps.

A link hands its event time on, and Spark holds it to the rule that no row comes out behind the watermark that late rows
are judged by, which is the last micro-batch's. So a link either gives a row out as it comes in, or holds it no longer than
until the watermark reaches it: how long rows are held is the delay of the watermark itself. A timer one millisecond before
the row's time fires in the very micro-batch in which the watermark gets there."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from . import processors as p

ET = "et"


def begin(rows: DataFrame, hold: str) -> DataFrame:
    """Rows with the one watermark of the query, `hold` behind the latest event time."""
    return rows.withWatermark(ET, hold)


def _link(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: StructType) -> DataFrame:
    return rows.groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName=ET)


def _bare(schema: StructType) -> StructType:
    """The fields of a schema without metadata: the mark of a watermark isn't part of a row's type."""
    out = StructType()
    for f in schema.fields:
        out = out.add(f.name, f.dataType)
    return out


def _millis(t: datetime) -> int:
    return int(t.timestamp() * 1000)


class _Latest(p.Latest):
    """Holds the row of largest order until the watermark reaches the earliest one of its key, then gives it out. A row of
    the key that comes after that begins anew."""

    def handleInputRows(self, key, rows, timerValues):
        new, best = p._sorted(rows, self.order), self.held()
        first = min(_millis(r[self.et]) for r in new)
        timers = list(self.handle.listTimers())
        if not timers or first - 1 < timers[0]:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(first - 1)
        self.hold(p._sorted([*([best] if best else []), *new], self.order)[-1])
        return iter(())


class _Replace(p._Held):
    """Gives each row out at once, as `_sign` 1, after taking back the one that it replaces (-1). A row of lower order than
    the one held is an old version and goes. What lies behind the watermark can't be taken back: its window is out."""

    def __init__(self, schema: StructType, order: list[str], ttl_ms: int):
        super().__init__(schema, order)
        self.ttl = (ET, ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        last, now, mark = self.held(), p._sorted(rows, self.order), timerValues.getCurrentWatermarkInMs()
        for r in now:
            if last is not None and p._rank(r, self.order) < p._rank(last, self.order):
                continue
            if last is not None and _millis(last[ET]) > mark:
                yield Row(**{c: last[c] for c in self.schema.names}, _sign=-1)
            yield Row(**{c: r[c] for c in self.schema.names}, _sign=1)
            last = r
        if last is not None:
            self.hold(last)
            self.used(now, timerValues)


class _Credit(p._Expiring):
    """Counts the rows of a key that stand, by version, and keeps one credit with the first of them by `order` (two columns:
    a number and a text). Rows go through with name 0; where the first changes, a row that takes the credit from the old
    one (-1) and one that gives it to the new one (1) follow, with _sign 0. A credit whose window is out stays there."""

    def __init__(self, schema: StructType, order: list[str], name: str, ttl_ms: int):
        self.schema, self.order, self.name, self.ttl = schema, order, name, (ET, ttl_ms)

    def init(self, handle) -> None:
        self.expect(handle)
        self.standing = handle.getMapState("standing", "version STRING", "n BIGINT")
        self.rows = handle.getMapState("rows", "version STRING", self.schema)
        self.state = handle.getValueState("credited", "version STRING")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for s in (self.standing, self.rows, self.state, self.until):
            s.clear()
        return iter(())

    def _row(self, version: str) -> Row:
        return Row(**dict(zip(self.schema.names, self.rows.getValue((version,)), strict=True)))

    def _move(self, version: str, by: int) -> Row:
        own = self._row(version).asDict()
        return Row(**(own | {"_sign": 0}), **{self.name: by})

    def handleInputRows(self, key, rows, timerValues):
        now, mark = list(rows), timerValues.getCurrentWatermarkInMs()
        for r in now:
            a, b = (r[c] for c in self.order)
            version = f"{a:020d} {b} {_millis(r[ET])}"
            n = (self.standing.getValue((version,))[0] if self.standing.containsKey((version,)) else 0) + r["_sign"]
            self.standing.updateValue((version,), (n,))
            if r["_sign"] > 0 or not self.rows.containsKey((version,)):
                self.rows.updateValue((version,), tuple(r[c] for c in self.schema.names))
            yield Row(**{c: r[c] for c in self.schema.names}, **{self.name: 0})
        first = min((v[0] for v, n in self.standing.iterator() if n[0] > 0), default=None)
        old = self.state.get()[0] if self.state.exists() else None
        behind = lambda v: _millis(self._row(v)[ET]) <= mark
        if first != old and not (old is not None and behind(old)) and not (first is not None and behind(first)):
            if old is not None:
                yield self._move(old, -1)
            if first is not None:
                yield self._move(first, 1)
                self.state.update((first,))
            else:
                self.state.clear()
        self.used(now, timerValues)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    schema = _bare(rows.schema)
    return _link(rows, keys, _Latest(schema, order, ET, 0), schema)


def first_of_day(rows: DataFrame, keys: list[str], day: str, order: list[str], literal: bool = False, ttl_ms: int = p.DAY_MS) -> DataFrame:
    mark = order[0] if literal else day
    out = rows.withColumn("_mark", F.date_format(mark, "yyyy-MM-dd HH:mm:ss") if literal and dict(rows.dtypes)[mark].startswith("timestamp") else F.col(mark).cast("string"))
    return _link(out, keys, p.FirstOfDay("_mark", order, (ET, ttl_ms)), _bare(out.schema)).drop("_mark")


def flag_first(rows: DataFrame, keys: list[str], order: list[str], name: str, ttl_ms: int = p.DAY_MS) -> DataFrame:
    schema = _bare(rows.schema).add(name, "long")
    return _link(rows, keys, p.FlagFirst(order, name, rows.columns, (ET, ttl_ms)), schema)


def visitors_and_new(rows: DataFrame, user: str, day: str, order: list[str], uv: str, new: str, literal: bool = False) -> DataFrame:
    schema = _bare(rows.schema).add(new, "long").add(uv, "long")
    return _link(rows, [user], p.Visitors(day, order, uv, new, rows.columns, literal), schema)


def replacements(rows: DataFrame, key: str, order: list[str], ttl_ms: int = p.DAY_MS) -> DataFrame:
    schema = _bare(rows.schema)
    return _link(rows, [key], _Replace(schema, order, ttl_ms), _bare(schema).add("_sign", "integer"))


def credited(rows: DataFrame, keys: list[str], order: list[str], name: str, ttl_ms: int = p.DAY_MS) -> DataFrame:
    """Changes (with _sign) with a column that is 1 in all for the first row standing of each combination of keys."""
    schema = _bare(rows.schema)
    return _link(rows, keys, _Credit(schema, order, name, ttl_ms), _bare(schema).add(name, "long"))
