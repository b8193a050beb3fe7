"""A table as a stream: first its snapshot, then its change log from where the snapshot was taken.

    spark.dataSource.register(SnapshotThenLog)
    spark.readStream.format("snapshot_then_log").option("snapshot", s).option("log", l).option("low", 100).load()

The snapshot is a folder of Parquet files that doesn't change; the log a folder of files of JSON envelopes (before, after, op,
ts_ms, pos), one a line, whose names sort by their positions. Changes before position `low` are in the snapshot. An offset
is {chunk, pos}: files of the snapshot that have been handed over, then the position in the log, which moves once all of
them have. So a query that is killed goes on where it was, before, in or after the handover. Files are read by the tasks;
the driver lists names, and reads the last file of the log to see where it ends."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "before MAP<STRING,STRING>, after MAP<STRING,STRING>, op STRING, ts_ms BIGINT, pos BIGINT"


@dataclass
class Split(InputPartition):
    """A file of the snapshot (upto None), or the positions since <= pos < upto of a file of the log."""

    path: str
    since: int = 0
    upto: int | None = None


def _files(folder: str) -> list[str]:
    system, path = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _lines(folder: str, path: str) -> Iterator[dict]:
    with fs.FileSystem.from_uri(folder)[0].open_input_stream(path) as f:
        rest = b""
        while block := f.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            yield from (json.loads(x) for x in whole if x.strip())
        if rest.strip():
            yield json.loads(rest)


def _texts(row: dict | None) -> dict[str, str | None] | None:
    return None if row is None else {k: None if v is None else str(v) for k, v in row.items()}


class HandoverReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.snapshot, self.log, self.low = options["snapshot"], options["log"], int(options.get("low", "0"))
        self.chunks, self.most = int(options.get("chunks", "64")), int(options.get("positions", "1000000"))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"chunk": 0, "pos": self.low}

    def _end(self) -> int:
        names = _files(self.log)
        return max((e["pos"] + 1 for e in _lines(self.log, names[-1])), default=self.low) if names else self.low

    def latestOffset(self) -> dict:
        """From where the query is: some files on, or some positions on once there are none left."""
        at, whole = self.at or self.initialOffset(), len(_files(self.snapshot))
        if at["chunk"] < whole:
            return {"chunk": min(whole, at["chunk"] + self.chunks), "pos": at["pos"]}
        return {"chunk": at["chunk"], "pos": max(at["pos"], min(self._end(), at["pos"] + self.most))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """Spark asks for the last batch again when a query restarts, which is how the reader learns where that was."""
        if (end["chunk"], end["pos"]) < (start["chunk"], start["pos"]):
            raise RuntimeError(f"offset {end} is before {start}: the reader doesn't know where its query was")
        self.at = end
        out: list[InputPartition] = [Split(p) for p in _files(self.snapshot)[start["chunk"] : end["chunk"]]]
        if end["pos"] > start["pos"]:
            out += [Split(p, start["pos"], end["pos"]) for p in _files(self.log)]
        return out

    def read(self, partition: Split) -> Iterator[tuple]:
        if partition.upto is None:
            import pyarrow.parquet as pq

            with fs.FileSystem.from_uri(self.snapshot)[0].open_input_file(partition.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(8192):
                    yield from ((None, _texts(r), "r", 0, self.low - 1) for r in batch.to_pylist())
            return
        for e in _lines(self.log, partition.path):
            if partition.since <= e["pos"] < partition.upto:
                yield _texts(e.get("before")), _texts(e.get("after")), e["op"], e.get("ts_ms"), e["pos"]


class SnapshotThenLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot_then_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> HandoverReader:
        return HandoverReader(dict(self.options))
