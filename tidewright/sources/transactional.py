"""A stream sink that commits: rows of a micro-batch are seen all or not at all, and once.

    spark.dataSource.register(TransactionalTopics)
    rows.writeStream.format("transactional_topics").option("path", p).option("label", "orders").start()

Rows have a topic (each its own) and a value. Tasks write staged files, a topic each; the driver's commit publishes a list
of those of the attempts that succeeded, in one rename, under the label and number of the batch. A batch whose label is
published already adds nothing when it runs again. What a failed or repeated attempt has staged is on no list; the task, or
the batch that aborts, deletes it, and what an executor leaves that is lost outright is read by nobody. Readers (read_topic)
open what lists name alone."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # (topic, file under the root)


class _Store:
    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path)

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found)

    def put(self, name: str, data: bytes) -> None:
        """Whole or not at all: written beside its place, then moved there."""
        folder, _, base = name.rpartition("/")
        self.fs.create_dir(f"{self.root}/{folder}")
        beside = f"{self.root}/{folder}/_{base}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(beside) as f:
            f.write(data)
        self.fs.move(beside, f"{self.root}/{name}")


class TopicsWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.label, self.most = options["path"], options.get("label", "stream"), int(options.get("rows", "100000"))

    def write(self, iterator: Iterator[Row]) -> Staged:
        """Staged files of a task, a topic each, of at most `rows` rows: what it holds in memory is bounded by that. The
        names are new in every attempt. A task that fails deletes its own."""
        store, held, files, n = _Store(self.path), {}, [], 0

        def flush() -> None:
            for topic, values in held.items():
                name = f"staged/{uuid.uuid4().hex}.json"
                store.put(name, b"".join(json.dumps({"value": v}).encode() + b"\n" for v in values))
                files.append((topic, name))
            held.clear()

        try:
            for row in iterator:
                held.setdefault(row["topic"], []).append(row["value"])
                n += 1
                if n % self.most == 0:
                    flush()
            flush()
        except BaseException:
            self._drop(files)
            raise
        return Staged(files)

    def _drop(self, files: list[tuple[str, str]]) -> None:
        store = _Store(self.path)
        for _, name in files:
            store.fs.delete_file(f"{store.root}/{name}")

    def _list(self, batch: int) -> str:
        return f"{self.label}-{batch:012d}.json"

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        store, files = _Store(self.path), [f for m in messages if m for f in m.files]
        if self._list(batchId) in store.names("commits"):
            self._drop(files)  # it has been committed before the driver could note it
            return
        store.put(f"commits/{self._list(batchId)}", json.dumps(files).encode())

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._drop([f for m in messages if m for f in m.files])


class TransactionalTopics(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transactional_topics"

    def schema(self) -> str:
        return "topic STRING, value STRING"

    def streamWriter(self, schema, overwrite: bool) -> TopicsWriter:
        missing = {"topic", "value"} - set(schema.names)
        if missing:
            raise ValueError(f"rows need columns topic and value; missing: {sorted(missing)}")
        return TopicsWriter(dict(self.options))


def read_topic(spark: SparkSession, path: str, topic: str | None) -> DataFrame:
    """The committed values of a topic (None: of rows without one). Lists are as many as batches; the rows are read by
    tasks."""
    store, files = _Store(path), []
    for name in store.names("commits"):
        if name[0] != "_":
            with store.fs.open_input_stream(f"{store.root}/commits/{name}") as f:
                files += [f"{path}/{file}" for t, file in json.loads(f.read()) if t == topic]
    return spark.read.schema("value STRING").json(files) if files else spark.createDataFrame([], "value STRING")
