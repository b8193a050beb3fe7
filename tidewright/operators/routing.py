"""Configuration-driven routing of change records, and the configuration's own replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .parse import prune, with_entry


def current_config(events: DataFrame, keys: list[str], order: str = "ts_ms") -> DataFrame:
    """Replay of decoded configuration events (data, op, order): the last row of each key, unless that is a deletion."""
    key = [F.col("data")[k].alias(k) for k in keys]
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc(), (F.col("op") == "d").desc())
    rows = events.select(*key, "data", "op", order).withColumn("_n", F.row_number().over(last))
    return rows.filter((F.col("_n") == 1) & (F.col("op") != "d")).drop("_n", "op", order)


def route_dim(records: DataFrame, config: DataFrame) -> DataFrame:
    """Change records of configured tables, cut to their columns, with the change type as a column of the data.

    The configuration, a few rows a source table, is broadcast: a shuffle by table would bring all records of one to a single
    task. Where its rows have a generation, the records get it."""
    more = ["generation"] if "generation" in config.columns else []
    cfg = config.select(F.col("source_table").alias("table"), "sink_table", "sink_columns", "sink_pk", *more)
    out = records.join(F.broadcast(cfg), "table").withColumn("data", with_entry(prune("data", "sink_columns"), "type", F.col("type")))
    return out.select("sink_table", "sink_pk", "type", "ts", "data", *more)


def route_dwd(records: DataFrame, config: DataFrame) -> DataFrame:
    """Change records by table and type to their sinks, cut to their columns, with ts as a column of the data. The
    configuration is broadcast, as in route_dim."""
    cfg = config.select(F.col("source_table").alias("table"), F.col("source_type").alias("type"), "sink_table", "sink_columns")
    out = records.join(F.broadcast(cfg), ["table", "type"]).withColumn("data", with_entry(prune("data", "sink_columns"), "ts", F.col("ts")))
    return out.select("sink_table", "ts", "data")


def sink_rows(routed: DataFrame, sink_table: str, columns: list[str]) -> DataFrame:
    """The typed rows of one sink."""
    return routed.filter(F.col("sink_table") == sink_table).select(*(F.col("data")[c].alias(c) for c in columns))
