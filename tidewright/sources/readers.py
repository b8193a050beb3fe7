"""Sources: message topics, change capture, databases and files, each as a DataFrame.

Connectors that Spark doesn't ship (Kafka, JDBC drivers) are thin options, which fail where their jar is missing; file
streams stand in for topics, with the same `value` column."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import to_camel
from ..functions.timefn import from_millis, from_seconds
from ..operators import parse
from ..plans import schemas


def topic(spark: SparkSession, servers: str, name: str, group: str | None = None, offsets: str = "latest") -> DataFrame:
    """A Kafka topic as a stream of texts (value), null where the payload is; from the latest offsets on."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": name, "startingOffsets": offsets} | ({"kafka.group.id": group} if group else {})
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))


def file_topic(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """A folder of text files as a topic: one record a line."""
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(path)


def table_stream(spark: SparkSession, path: str, schema: str, most_files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream of rows."""
    reader = spark.readStream.format("parquet").schema(schema)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(path)


def topic_db(raw: DataFrame, watermark: str | None = None) -> DataFrame:
    """Change records of a topic with processing time pt and event time et."""
    out = parse.changes(raw).withColumn("pt", F.current_timestamp()).withColumn("et", from_seconds("ts"))
    return out.withWatermark("et", watermark) if watermark else out


def page_log(raw: DataFrame, watermark: str | None = None) -> DataFrame:
    """Page records of a topic with event time et."""
    out = parse.logs(parse.present(raw)).filter(F.col("page").isNotNull()).withColumn("et", from_millis("ts"))
    return out.withWatermark("et", watermark) if watermark else out


def detail_topic(raw: DataFrame, schema: str, arrival: str | None = None) -> DataFrame:
    """Rows of a detail topic; tombstones and empty payloads are skipped."""
    out = parse.parse_json(parse.present(raw), schema)
    return out.withColumn("arrival", F.lit(0)) if arrival is None else out


def change_capture(raw: DataFrame, family: str | None = None) -> DataFrame:
    """Envelopes of snapshot and change events of one table: data, op, ts_ms."""
    return parse.decode_cdc(parse.parse_json(parse.present(raw), schemas.CDC), family)


def snapshot(events: DataFrame, key: str) -> DataFrame:
    """The table that change events lead to: the last row of each key that isn't deleted."""
    last = Window.partitionBy("_k").orderBy(F.col("ts_ms").desc(), (F.col("op") == "d").desc())
    out = events.withColumn("_k", F.col("data")[key]).withColumn("_n", F.row_number().over(last))
    return out.filter((F.col("_n") == 1) & (F.col("op") != "d")).select("data")


def database(spark: SparkSession, url: str, query: str, camel: bool = False, **options: str) -> DataFrame:
    """A JDBC query, its columns in camelCase if asked."""
    out = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return to_camel(out) if camel else out


def dim_table(spark: SparkSession, path: str) -> DataFrame:
    """A dimension as it stands."""
    return spark.read.parquet(path)


def dim_rows(dim: DataFrame, keys: Iterable[str], key_col: str = "id") -> dict[str, dict[str, str]]:
    """The rows of some keys, without empty cells, by one query whose filter reaches the scan. For jobs, join instead."""
    rows = dim.filter(F.col(key_col).isin(list(keys))).collect()
    return {r[key_col]: {k: v for k, v in r.asDict().items() if v not in (None, "")} for r in rows}


def dim_row(dim: DataFrame, key: str, key_col: str = "id") -> dict[str, str] | None:
    """The row of one key; None where there is none."""
    return dim_rows(dim, [key], key_col).get(key)


class DimCache:
    """Point lookups for a serving process: rows met within `expiry` seconds are remembered, up to `most` keys, the missing
    ones of a request are read by one query. read: the table as it stands. forget() after a change drops what is held."""

    def __init__(self, read: Callable[[], DataFrame], key_col: str = "id", most: int = 10_000, expiry: float = 86_400, clock: Callable[[], float] = time.monotonic):
        self.read, self.key_col, self.most, self.expiry, self.clock = read, key_col, most, expiry, clock
        self.held: OrderedDict[str, tuple[float, dict[str, str] | None]] = OrderedDict()

    def get(self, keys: Iterable[str]) -> dict[str, dict[str, str]]:
        """The rows of the keys that there are."""
        now, wanted = self.clock(), list(dict.fromkeys(k for k in keys if k is not None))
        known = {k: self.held[k][1] for k in wanted if k in self.held and now - self.held[k][0] < self.expiry}
        if missing := [k for k in wanted if k not in known]:
            found = dim_rows(self.read(), missing, self.key_col)
            for k in missing:
                known[k] = found.get(k)
                self.held[k] = now, known[k]
                self.held.move_to_end(k)
            while len(self.held) > self.most:
                self.held.popitem(last=False)
        return {k: v for k, v in known.items() if v is not None}

    def forget(self, *keys: str) -> None:
        """These keys, or all."""
        for k in keys or list(self.held):
            self.held.pop(k, None)


def summary_tables(spark: SparkSession, root: str, names: Iterable[str] = schemas.SUMMARY) -> dict[str, DataFrame]:
    """Summary tables as the dashboard reads them, partitioned by cur_date."""
    out = {}
    for n in names:
        kind = schemas.SUMMARY[n]
        columns = [c.split()[0] for c in kind.replace("DECIMAL(26,2)", "DECIMAL").split(", ")]
        out[n] = spark.read.option("basePath", f"{root}/{n}").schema(kind).parquet(f"{root}/{n}").select(*columns)
    return out
