"""Sequence patterns over the events of a key: begin, next, followed by, within.

    Pattern.begin("view", "kind = 'view'").followed_by("click", cond).next("buy", cond).within(600_000)

Every event that meets the first condition begins a run. `next`: the very next event of the key must meet the condition, or
the run dies. `followed_by`: the first later event that meets it is taken. `within`: a run whose last event comes that many
milliseconds after its first, or later, or not at all, is timed out. Runs don't disturb each other.

`match` finds all runs in batch, by window functions over one sort; tidewright.streaming.patterns keeps runs as state."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    name: str
    where: Column | str
    strict: bool


@dataclass(frozen=True)
class Pattern:
    steps: tuple[Step, ...]
    millis: int | None = None

    @classmethod
    def begin(cls, name: str, where: Column | str) -> Pattern:
        return cls((Step(name, where, True),))

    def next(self, name: str, where: Column | str) -> Pattern:
        return replace(self, steps=(*self.steps, Step(name, where, True)))

    def followed_by(self, name: str, where: Column | str) -> Pattern:
        return replace(self, steps=(*self.steps, Step(name, where, False)))

    def within(self, millis: int) -> Pattern:
        return replace(self, millis=millis)


def marked(rows: DataFrame, pattern: Pattern) -> DataFrame:
    """Rows with a column _c<k> for each condition, a column or SQL; null is false."""
    return rows.withColumns({f"_c{k}": F.coalesce(F.expr(s.where) if isinstance(s.where, str) else s.where, F.lit(False)) for k, s in enumerate(pattern.steps)})


def match(rows: DataFrame, pattern: Pattern, keys: list[str], millis: str, order: list[str]) -> DataFrame:
    """The first event of each run that matched or timed out, with _outcome (match, timeout) and _at, the times of the events
    that its further steps took in time. order: a total order of a key's events, in line with millis.

    From the last step to the first, each event learns what would follow if it were the step's: that is one value from the
    events after it, and all steps use one sort. Windows look back over a falling order, so a key costs its length. Without
    `within` runs that aren't complete give nothing."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    steps, last = pattern.steps, len(pattern.steps) - 1
    none = F.struct(F.array().cast("array<bigint>").alias("at"), F.lit(None).cast("bigint").alias("dead"))
    ms = F.col(millis).cast("bigint")
    out = marked(rows, pattern).withColumn(f"_m{last}", none)
    for k in range(last - 1, -1, -1):
        ahead = F.struct(F.concat(F.array(ms), F.col(f"_m{k + 1}.at")).alias("at"), F.col(f"_m{k + 1}.dead").alias("dead"))
        if steps[k + 1].strict:
            here = F.when(F.col(f"_c{k + 1}"), ahead).otherwise(F.struct(F.array().cast("array<bigint>").alias("at"), ms.alias("dead")))
            found = F.lag(here).over(w)
        else:
            found = F.last(F.when(F.col(f"_c{k + 1}"), ahead), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(f"_m{k}", F.coalesce(found, none)).drop(f"_m{k + 1}")
    whole, dead = F.col("_m0.at"), F.col("_m0.dead")
    limit = pattern.millis
    in_time = whole if limit is None else F.filter(whole, lambda t: t - ms < limit)
    out = out.filter("_c0").withColumn("_at", in_time)
    missed = F.lit(None) if limit is None else F.when((F.size("_at") < F.size(whole)) | dead.isNull() | (dead - ms >= limit), "timeout")
    out = out.withColumn("_outcome", F.when(F.size("_at") == last, "match").otherwise(missed)).filter("_outcome IS NOT NULL")
    return out.select(*rows.columns, "_outcome", "_at")
