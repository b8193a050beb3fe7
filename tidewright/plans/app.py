"""Bases of streaming jobs: fill in handle(), and start() gives it its source and runs what it returns."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import dims
from ..sources import readers


class App(ABC):
    """A job over one stream of texts."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @abstractmethod
    def handle(self, stream: DataFrame) -> StreamingQuery | None:
        """From the stream to a started query."""

    def start(self, stream: DataFrame) -> StreamingQuery | None:
        return self.handle(stream)


class SqlApp(ABC):
    """A job in SQL over the views topic_db (change records with pt and et) and page_log."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @abstractmethod
    def handle(self, spark: SparkSession) -> StreamingQuery | None:
        """From the views to a started query."""

    def start(self, db: DataFrame | None = None, log: DataFrame | None = None, watermark: str | None = None) -> StreamingQuery | None:
        if db is not None:
            readers.topic_db(db, watermark).createOrReplaceTempView("topic_db")
        if log is not None:
            readers.page_log(log, watermark).createOrReplaceTempView("page_log")
        return self.handle(self.spark)


@dataclass(frozen=True)
class DimJoin:
    """A lookup, declared: the dimension, the column that holds its key, and the attributes that are added."""

    table: str
    key: str
    attributes: dict[str, str]
    dim_key: str = "id"
    default: dict[str, str] | None = None

    def apply(self, rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        return dims.lookup(rows, tables[self.table], self.key, self.attributes, self.dim_key, self.default)
