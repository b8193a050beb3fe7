"""Per-key operators in their batch form, by window functions. Every order ends in a tie-break column, so results repeat.

The streaming forms are in tidewright.streaming.processors, under the same contracts; ttl_ms, how long those keep what they
know of a key, means nothing here, where all rows are at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(keys: list[str | Column], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1


def repair_new_visitor(rows: DataFrame, mid: str, is_new: str, day: str, order: list[str], literal: bool = False) -> DataFrame:
    """is_new as it should be: 1 only for a visitor whose first record says so, and only on that record's day.

    literal: compare the order's first column (an instant) instead of the day, so that any later second clears it."""
    w = Window.partitionBy(mid).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = order[0] if literal else day
    fresh = (F.col(is_new) == "1") & (F.first(is_new).over(w) == "1") & (F.col(mark) == F.first(mark).over(w))
    return rows.withColumn(is_new, F.when(fresh, "1").otherwise("0"))


def first_of_day(rows: DataFrame, keys: list[str], day: str, order: list[str], literal: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """The first row of each key and day. literal: of each key and instant."""
    return rows.withColumn("_f", _first([*keys, order[0] if literal else day], order)).filter("_f").drop("_f")


def flag_first(rows: DataFrame, keys: list[str], order: list[str], name: str, ttl_ms: int | None = None) -> DataFrame:
    """All rows; name is 1 on the first of each combination of keys, else 0."""
    return rows.withColumn(name, F.when(_first(keys, order), 1).otherwise(0).cast("long"))


def visitors_and_new(rows: DataFrame, user: str, day: str, order: list[str], uv: str, new: str, literal: bool = False) -> DataFrame:
    """The rows that count: the first of a user's day, with uv 1, and new 1 on the first of all. It needs the user's whole
    history, not one day's.

    literal: a returning day's rows all count, and none of the first day's after the first."""
    w = Window.partitionBy(user).orderBy(*order)
    # the first row of all is the first of its day, so days are cut down, before the shuffle, to a row each
    out = rows if literal else first_of_day(rows, [user], day, order)
    out = out.withColumn(new, F.when(F.row_number().over(w) == 1, 1).otherwise(0).cast("long")).withColumn(uv, F.lit(1).cast("long"))
    if not literal:
        return out
    whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("_f", (F.col(new) == 1) | (F.col(day) > F.first(day).over(whole))).filter("_f").drop("_f")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; of equal ones the later arrival, which the last order column tells."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def retractions(rows: DataFrame, key: str, order: list[str], amounts: list[str]) -> DataFrame:
    """Each row, and before each but the first of a key the one it replaces, with its amounts negated; _sign tells which.
    Sums over the result are sums over the last row of each key."""
    before = F.lag(F.struct(*rows.columns)).over(Window.partitionBy(key).orderBy(*order))
    both = rows.withColumn("_before", before)
    old = both.filter(F.col("_before").isNotNull()).select("_before.*")
    old = old.withColumns({a: -F.col(a) for a in amounts}).withColumn("_sign", F.lit(-1))
    return rows.withColumn("_sign", F.lit(1)).unionByName(old)


def bounces(rows: DataFrame, mid: str, entry: Column, millis: str, order: list[str], within: int = 10_000) -> DataFrame:
    """Entries that lead nowhere: the next event of the visitor is another entry, or comes `within` later or more, or
    never. literal behaviour, every event being an entry, is entry = lit(True)."""
    w = Window.partitionBy(mid).orderBy(*order)
    marked = rows.withColumn("_entry", F.coalesce(entry, F.lit(False)))
    after, then = F.lead(millis).over(w), F.lead("_entry").over(w)
    alone = after.isNull() | (after - F.col(millis) >= within) | then
    return marked.withColumn("_alone", alone).filter("_entry AND _alone").drop("_entry", "_alone")
