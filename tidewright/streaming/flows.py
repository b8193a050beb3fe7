"""Streaming runs of the jobs. `chained` runs a job as one query, state after state, under one checkpoint. `summary` makes
every step that keeps state a query of its own, with a table between it and the next, for steps to be scaled and replayed
by themselves.

Each query recovers by its own checkpoint; a table between two queries can be replayed. With once=True a run takes what
is there now and stops; windows and held rows then come out as far as the watermark has passed them."""

from __future__ import annotations

from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from ..operators.windows import LENGTH
from ..plans.summary import Dims, Job
from ..sources.readers import table_stream
from ..sources.sinks import run, schema_text, to_summary
from . import chain, processors


def staged(spark: SparkSession, rows: DataFrame, root: str, name: str, most_files: int | None = None, once: bool = True) -> DataFrame:
    """Write a stream to a table under root and read it again as a stream."""
    path = f"{root}/{name}"
    run(rows, path, f"{root}/_checkpoints/{name}", once)
    return table_stream(spark, path, schema_text(rows.schema), most_files)


def summary(spark: SparkSession, job: Job, rows: DataFrame, dimensions: Dims, root: str, length: str = LENGTH, once: bool = True, state: ModuleType = processors) -> None:
    """Run a summary job over a stream of detail rows into its summary table under root. state: processors, by event time, or
    clocked, by the clock; the clock never has all that is there, so that runs on until it is stopped (once=False)."""
    if once and state.__name__.endswith("clocked"):
        raise ValueError("steps by the clock have no end: run them with once=False")
    now = job.prepare(rows)
    for k, step in enumerate(job.steps):
        now = staged(spark, step(now, state), root, f"{job.name}_{k}", once=once)
    to_summary(job.window(now, dimensions, length, job.delay), root, job.name, f"{root}/_checkpoints/{job.name}", once)


def chained(spark: SparkSession, job: Job, rows: DataFrame, dimensions: Dims, root: str, length: str = LENGTH, hold: str = "5 seconds", once: bool = True) -> None:
    """Run a summary job as one query into its summary table. hold: how far the watermark stays behind, which is how long
    rows are held for later versions; jobs with `changes` hold none, and `hold` is how late rows may come."""
    now = chain.begin(job.prepare(rows), hold)
    if job.changes:
        out = job.changes(now, chain, dimensions, length)
    else:
        for step in job.steps:
            now = step(now, chain)
        out = job.window(now, dimensions, length, None)
    to_summary(out, root, job.name, f"{root}/_checkpoints/{job.name}", once)
