"""Sinks: topics, routed topics, append-only summary tables, upsert tables and dimension tables.

Every micro-batch writes into a folder that is named after its number and replaces what an earlier attempt has left
there, so that a batch that runs again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import dims, parse


def to_topic(df: DataFrame, servers: str, name: str | None, checkpoint: str, serialise: Callable[[DataFrame], DataFrame] = parse.as_json) -> StreamingQuery:
    """A stream as texts (JSON unless another serialiser is given) to a Kafka topic; without a name, to the topic in each
    row's sink_table."""
    out = serialise(df) if name else df.select(F.col("sink_table").alias("topic"), F.to_json("data").alias("value"))
    writer = out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint)
    return (writer.option("topic", name) if name else writer).start()


def to_console(df: DataFrame, rows: int = 20) -> StreamingQuery:
    return df.writeStream.format("console").option("numRows", rows).start()


def replace_batch(path: str, by: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends to a table, idempotently by batch number."""

    def write(batch: DataFrame, number: int) -> None:
        writer = batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch", *(by or [])).parquet(path)

    return write


def run(df: DataFrame, write: Callable[[DataFrame, int], None] | str, checkpoint: str, once: bool = True, every: str = "5 seconds") -> StreamingQuery:
    """Start a stream into a foreachBatch function, or append to the table at a path (exactly once by its own log). once:
    all that is there now, then stop, and wait for it; else a micro-batch `every` so often."""
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.format("parquet").option("path", write) if isinstance(write, str) else writer.foreachBatch(write)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
    if once:
        query.awaitTermination()
    return query


def to_summary(df: DataFrame, root: str, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append window rows to a summary table, partitioned by cur_date."""
    return run(df, lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cur_date", "_batch").parquet(f"{root}/{name}"), checkpoint, once)


def append_summary(df: DataFrame, root: str, name: str) -> None:
    """Append to a summary table, few files a day: small days aren't cut into a file for each task, and large ones are spread
    over several."""
    df.hint("rebalance", "cur_date").write.mode("append").partitionBy("cur_date").parquet(f"{root}/{name}")


def upsert(path: str, key: str, order: list[str], columns: list[str], richer: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a table keyed by `key`. Each batch is a folder of changes; read_upserted gives the
    table, and compact_upserted folds changes into it. richer: a column whose non-null value wins over null, whatever the
    order (an outer join's early row)."""

    def write(batch: DataFrame, number: int) -> None:
        rank = [F.col(richer).isNotNull().desc()] if richer else []
        w = Window.partitionBy(key).orderBy(*rank, *(F.col(c).desc() for c in order))
        last = batch.select(*columns).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
        jvm = batch.sparkSession._jvm.org.apache.hadoop.fs.Path
        if not jvm(path).getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(jvm(f"{path}/_columns/_SUCCESS")):
            last.limit(0).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/_columns")
        last.withColumn("batch", F.lit(number)).write.option("compression", "zstd").mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def _upserted(spark: SparkSession, path: str) -> tuple[DataFrame, list[int], int]:
    """All rows of an upsert table that may count, the batches among them, and the number up to which a base holds them."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm(path)):
        raise LookupError(f"nothing has been written to {path} yet, not even an empty batch")
    names = [f.getPath().getName() for f in fs.listStatus(jvm(path))]
    bases = [int(n[6:]) for n in names if n.startswith("_base-") and fs.exists(jvm(f"{path}/{n}/_SUCCESS"))]
    last = max(bases, default=-1)
    batches = sorted(int(n[6:]) for n in names if n.startswith("batch=") and int(n[6:]) > last)
    parts = [spark.read.parquet(f"{path}/_base-{last}")] if bases else []
    parts += [spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in batches))] if batches else []
    if not parts:  # empty batches leave no folders, but the columns are known
        parts = [spark.read.parquet(f"{path}/_columns")]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows, batches, last


def _current(rows: DataFrame, key: str, richer: str | None) -> DataFrame:
    """Of each key the last batch's row. As a batch has a key once, tasks needn't look for the last before the shuffle, which
    would sort all that they read."""
    rank = [F.col(richer).isNotNull().desc()] if richer else []
    w = Window.partitionBy(key).orderBy(*rank, F.col("batch").desc())
    return rows.repartition(F.col(key)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def read_upserted(spark: SparkSession, path: str, key: str, richer: str | None = None, deleted: str | None = None) -> DataFrame:
    """The current rows of an upsert table: of each key the last batch's, without tombstones."""
    out = _current(_upserted(spark, path)[0], key, richer).drop("batch")
    return out.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def compact_upserted(spark: SparkSession, path: str, key: str, richer: str | None = None) -> None:
    """Fold the batches there are into a base of current rows, tombstones included, that reads begin with from then on. A
    compaction that fails leaves the batches as they are. Batches and older bases that it holds are dropped afterwards, so
    readers of an earlier table should be done; the writing stream may go on."""
    rows, batches, last = _upserted(spark, path)
    if not batches:
        return
    top = batches[-1]
    _current(rows, key, richer).write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/_base-{top}")
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in [f"batch={b}" for b in batches] + [f"_base-{last}"]:
        fs.delete(jvm(f"{path}/{name}"), True)


class DimStore:
    """Dimension tables in folders: created and dropped by configuration, put by column, deleted by row.

    A table is a base (v<n>) and the changes put since (c<n>-<batch>); reading merges them by key. Puts write their changes
    alone, under the name of their batch, so that one that runs again replaces what it wrote; every `most` of them, the
    table is written anew as the next base. A folder counts once its writer has left its mark of success, so a reader or a
    failed write never meets half a table. Readers take the table as it is at each micro-batch, which is what invalidating
    a cache was for."""

    def __init__(self, spark: SparkSession, root: str, most: int = 16):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self, table: str) -> list[str]:
        p = self._path(f"{self.root}/{table}")
        names = [f.getPath().getName() for f in self.fs.listStatus(p)] if self.fs.exists(p) else []
        return [n for n in names if self.fs.exists(self._path(f"{self.root}/{table}/{n}/_SUCCESS"))]

    def _version(self, table: str) -> int:
        return max((int(n[1:]) for n in self._folders(table) if n[0] == "v"), default=-1)

    def _changes(self, table: str, version: int) -> list[str]:
        return sorted(n for n in self._folders(table) if n.startswith(f"c{version}-"))

    def exists(self, table: str) -> bool:
        return self._version(table) >= 0

    def create(self, table: str, columns: list[str], key: str = "id") -> None:
        """Nothing happens where the table is there already."""
        if not self.exists(table):
            names = [key, *(c for c in columns if c != key)]
            self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in names)).write.mode("overwrite").parquet(f"{self.root}/{table}/v0")

    def drop(self, table: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{table}"), True)

    def apply_config(self, op: str, table: str, columns: list[str], key: str = "id") -> None:
        """r and c create, d drops, any other change drops and creates."""
        if op not in ("r", "c"):
            self.drop(table)
        if op != "d":
            self.create(table, columns, key)

    def read(self, table: str) -> DataFrame:
        if not self.exists(table):
            raise LookupError(f"there is no dimension table {table}")
        return self._read(table, self._version(table))

    def _read(self, table: str, version: int) -> DataFrame:
        base = self.spark.read.parquet(f"{self.root}/{table}/v{version}")
        names = self._changes(table, version)
        if not names:
            return base
        changes = self.spark.read.parquet(*(f"{self.root}/{table}/{n}" for n in names))
        key, *columns = base.columns
        order = [f for f in changes.schema.fields if f.name not in base.columns and f.name != "type"]
        first = base.withColumn("type", F.lit("insert")).withColumns({f.name: F.lit(0 if f.name == "_batch" else None).cast(f.dataType) for f in order})
        return dims.merge_dim(first.unionByName(changes), key, columns, ["_batch", *(f.name for f in order if f.name != "_batch")])

    def put(self, table: str, puts: DataFrame, key: str, order: list[str], batch: int | None = None) -> None:
        """Apply puts and deletes (type = 'delete') of a batch: empty cells, and columns that aren't put, leave what is
        there. batch: its number, which a
        repeated attempt shares and later batches exceed; else the next one."""
        version = self._version(table)
        names = self._changes(table, version)
        number = batch if batch is not None else max((int(n.partition("-")[2]) for n in names), default=0) + 1
        columns = [c for c in self.spark.read.parquet(f"{self.root}/{table}/v{version}").columns if c != key]
        cells = [F.col(c) if c in puts.columns else F.lit(None).cast("string").alias(c) for c in columns]
        out = puts.select(key, *cells, "type", *order).withColumn("_batch", F.lit(number + 1).cast("long"))
        out.write.mode("overwrite").parquet(f"{self.root}/{table}/c{version}-{number:012d}")
        if len(names) + 1 >= self.most:
            self.compact(table)

    def compact(self, table: str) -> None:
        """Write the table as the next base. The one before stays, for readers that have it open; older ones go."""
        version = self._version(table)
        if self._changes(table, version):
            self._read(table, version).write.mode("overwrite").parquet(f"{self.root}/{table}/v{version + 1}")
            for name in self._folders(table):
                if int(name[1:].partition("-")[0]) < version:
                    self.fs.delete(self._path(f"{self.root}/{table}/{name}"), True)


def schema_text(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
