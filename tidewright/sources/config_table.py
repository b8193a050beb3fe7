"""A configuration table in versions, for jobs whose routes change while they run.

A control stream folds the change events of the configuration into it: each of its micro-batches makes a version, whole and
never changed again. A data stream asks for a version as a micro-batch begins; the answer is kept under the batch's number,
so a batch that runs again is routed as it was at first, whatever has come in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "key STRING, data MAP<STRING,STRING>, op STRING, ts_ms BIGINT, generation BIGINT"


class ConfigTable:
    """keys: the entries of an event's data that tell rows apart. A row has a generation: the version in which its sink came
    to be. A deletion ends it, a change (u) begins another, as the sink is dropped and made anew; r and c keep what is there."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def _folder(self, version: int) -> str:
        return f"{self.root}/v{version:012d}"

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(self.root) if n[0] == "v" and self.fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def latest(self) -> int:
        """0 where there is none."""
        return max(self.versions(), default=0)

    def _rows(self, version: int) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(self._folder(version)) if version else self.spark.createDataFrame([], ROWS)

    def apply(self, events: DataFrame, number: int) -> None:
        """A foreachBatch function of the control stream over decoded events (data, op, ts_ms). Events that aren't later than
        what is known of their key have been applied before, and change nothing; of one instant a deletion comes last."""
        version = number + 1
        before = self._rows(max((v for v in self.versions() if v < version), default=0))
        key = F.concat_ws(":", *(F.coalesce(F.col("data")[k], F.lit("")) for k in self.keys))
        now = events.select(key.alias("key"), "data", "op", "ts_ms").join(before.select("key", F.col("ts_ms").alias("_known")), "key", "left").filter("_known IS NULL OR ts_ms > _known")
        ends = F.col("op").isin("d", "u")
        last = now.groupBy("key").agg(F.max_by(F.struct("data", "op"), F.struct("ts_ms", F.col("op") == "d")).alias("last"), F.max("ts_ms").alias("at"), F.max(ends).alias("ends"))
        begins = F.col("op").isNull() | (F.col("op") == "d") | F.col("ends")
        out = before.join(last, "key", "full").select(
            "key", F.coalesce("last.data", "data").alias("data"), F.coalesce("last.op", "op").alias("op"), F.coalesce("at", "ts_ms").alias("ts_ms"),
            F.when(F.col("last").isNotNull() & begins, F.lit(version)).otherwise(F.col("generation")).cast("long").alias("generation"),
        )
        out.write.mode("overwrite").parquet(self._folder(version))

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows of a version (the latest): the entries of their data, and generation."""
        live = self._rows(self.latest() if version is None else version).filter("op <> 'd'")
        names = ["source_table", "source_type", "sink_table", "sink_columns", "sink_pk"]
        return live.select(*(F.col("data")[n].alias(n) for n in names), "generation")

    def pinned(self, reader: str, batch: int) -> int:
        """The version for a micro-batch of a reader: the latest when it is first asked for, and the same ever after."""
        folder, mark = f"{self.root}/_reads/{reader}", f"{batch:012d}-"
        known = [n for n in self._names(folder) if n.startswith(mark)]
        if known:
            return int(known[0][len(mark) :])
        version = self.latest()
        if not version:
            raise RuntimeError("no configuration yet: run the control stream before the data stream, or records would be lost")
        self.fs.create(self._path(f"{folder}/{mark}{version}"), True).close()
        return version

    def forget(self, reader: str, before: int) -> None:
        """Drop what is kept for micro-batches of a reader that can't run again."""
        for n in self._names(f"{self.root}/_reads/{reader}"):
            if int(n.partition("-")[0]) < before:
                self.fs.delete(self._path(f"{self.root}/_reads/{reader}/{n}"), False)
