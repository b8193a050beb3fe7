"""Streaming runs of the dimension job and the six detail jobs.

The configured jobs take two queries: `control` folds configuration events into a versioned table, and each micro-batch of
the data query is routed by the version it began with, so routes change without a restart. Every job is one query over its
topic, with one parse of it, and writes each micro-batch once, whatever number of outputs it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import parse
from ..plans import detail
from ..sources.config_table import ConfigTable
from ..sources.keyed import KeyedTables
from ..sources.sinks import replace_batch, run
from . import processors


def control(events: DataFrame, config: ConfigTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Configuration events (data, op, ts_ms), decoded, into versions of the configuration."""
    return run(events, config.apply, checkpoint, once)


def dim(raw: DataFrame, config: ConfigTable, tables: KeyedTables, checkpoint: str, once: bool = True, compact_every: int = 16) -> StreamingQuery:
    """Change records into dimension tables: one join with the configuration and one write a micro-batch, for all tables."""

    def write(batch: DataFrame, number: int) -> None:
        tables.put(detail.dim_puts(batch, config.read(config.pinned("dim", number))), number)
        if number % compact_every == compact_every - 1:
            tables.compact()
            config.forget("dim", number - 1)

    return run(raw, write, checkpoint, once)


def dim_table(config: ConfigTable, tables: KeyedTables, sink_table: str, keys: DataFrame | None = None) -> DataFrame:
    """A dimension table as the latest configuration has it; empty where a change has just made it anew."""
    row = config.read().filter(F.col("sink_table") == sink_table).first()
    if row is None:
        raise LookupError(f"no configuration has a table {sink_table}")
    return tables.read(sink_table, row["generation"], row["sink_columns"].split(","), row["sink_pk"] or "id", keys)


def base_db(raw: DataFrame, config: ConfigTable, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Change records by table and type to detail sinks, folders by batch and sink_table."""

    def write(batch: DataFrame, number: int) -> None:
        replace_batch(path, ["sink_table"])(detail.base_db(batch, config.read(config.pinned("base_db", number))), number)
        config.forget("base_db", number - 1)

    return run(raw, write, checkpoint, once)


def base_log(raw: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Application logs to their eight outputs, folders by batch and output, the new-visitor flag repaired."""
    return run(detail.log_job(raw, processors), replace_batch(path, ["output"]), checkpoint, once)


def order_details(changes: DataFrame, logs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    return run(detail.order_detail(parse.changes(changes), parse.logs(logs), streaming=True), replace_batch(path), checkpoint, once)


def paid(changes: DataFrame, details: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    return run(detail.pay_success(parse.changes(changes), details, streaming=True), replace_batch(path), checkpoint, once)


def unique_visitors(pages: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    return run(detail.unique_visitors(pages, processors), replace_batch(path), checkpoint, once)


def user_jumps(pages: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    return run(detail.user_jumps(pages, processors), replace_batch(path), checkpoint, once)
