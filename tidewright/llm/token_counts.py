"""Token counts by source, language and tokenizer version, as rollups that deltas maintain.

A batch of changes (inserts, deletes, revised counts) becomes one small table of signed sums, added up in the tasks that
hold the rows before anything is shuffled. The table is committed under the batch's name: a batch that is delivered or
run again changes nothing. Totals are sums over committed tables; compaction folds those into a base."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import ByteBpe, default_tokenizer

KEYS = ["source", "lang", "version"]
ROLLUP = "source string, lang string, version string, docs long, tokens long"


def counted(docs: DataFrame, version: str = "byte_bpe_50k", tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """(doc_id, source, lang, version, tokens, chars) of every whole text. A null or empty text has no tokens; null source and
    lang stay null; rows that repeat are counted each."""
    paths = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = pa.array([len(bpe.ids(t)) // 4 if t else 0 for t in part.column(3).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], n, pc.utf8_length(part.column(3)).cast(pa.int64())], names=["doc_id", "source", "lang", "tokens", "chars"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long, chars long")
    return out.select("doc_id", "source", "lang", F.lit(version).alias("version"), "tokens", "chars")


def signed(changes: DataFrame) -> DataFrame:
    """Changes (source, lang, version, op, tokens, old_tokens) -> signed sums. op: insert, delete or revise; a null count
    is zero; rows of another op are an error, not a loss."""
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    more = F.when(op == "insert", tokens).when(op == "delete", -tokens).otherwise(tokens - old)
    return changes.select(*KEYS, docs.cast("long").alias("docs"), more.cast("long").alias("tokens")).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Rollups in a folder that all executors share: deltas/<batch>, base/<number>, and held/<number> with the names of the
    batches that this base took in, in buckets by name. A base takes in the one before, and counts once it and its names are
    both there; names of up to the last base's number hold. Bases older than the one before the last are dropped, and `most`
    folders of names are written as one, so that what a commit reads grows with the bucket of its name alone.

    Batches may have any names. One writer commits or compacts at a time; readers need not wait."""

    def __init__(self, spark: SparkSession, root: str, most: int = 16, buckets: int = 64):
        self.spark, self.root, self.most, self.buckets = spark, root.rstrip("/"), most, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        return f"{self.root}/deltas/b-{quote(batch, safe='')}"

    def _done(self, kind: str) -> list[str]:
        """Committed folders: those whose writer has left its mark of success."""
        top = self._path(f"{self.root}/{kind}")
        names = [f.getPath().getName() for f in self.fs.listStatus(top)] if self.fs.exists(top) else []
        done = [n for n in names if self.fs.exists(self._path(f"{self.root}/{kind}/{n}/_SUCCESS"))]
        return sorted(unquote(n[2:]) if kind == "deltas" else n for n in done)

    def _bucket(self, batch: str) -> int:
        return crc32(batch.encode()) % self.buckets

    def _names(self) -> list[str]:
        """Folders of names that hold: up to the last base."""
        last = (self._done("base") or [""])[-1]
        return [n for n in self._done("held") if n <= last]

    def _held(self, batches: list[str]) -> set[str]:
        """Which of some batches a base has taken in: looked up in the buckets of their names."""
        wanted = sorted({self._bucket(b) for b in batches})
        paths = [p for n in (self._names() if batches else []) for k in wanted if self.fs.exists(self._path(p := f"{self.root}/held/{n}/bucket={k}"))]
        if not paths:
            return set()
        held = self.spark.read.schema("batch string").parquet(*paths)
        return {r[0] for r in held.filter(F.col("batch").isin(batches)).distinct().collect()}

    def _sums(self, deltas: list[str]) -> DataFrame:
        """Totals of the current base and of those deltas that it hasn't taken in."""
        done, held = self._done("base"), self._held(deltas)
        paths = [f"{self.root}/base/{n}" for n in done[-1:]] + [self._folder(b) for b in deltas if b not in held]
        rows = self.spark.read.schema(ROLLUP).parquet(*paths) if paths else self.spark.createDataFrame([], ROLLUP)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether the batch was new. What a failed attempt has left is written over."""
        if batch in self._done("deltas") or self._held([batch]):
            return False
        signed(changes).write.mode("overwrite").parquet(self._folder(batch))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens); groups that have come down to nothing are left out."""
        return self._sums(self._done("deltas"))

    def compact(self) -> None:
        """Fold the deltas committed by now into a new base, and drop them. They are listed once: one that is committed
        meanwhile stays a delta. Deltas that an interrupted compaction has left behind are held already, and go."""
        deltas = self._done("deltas")
        new = [b for b in deltas if b not in self._held(deltas)]
        if new:
            bases, names = self._done("base"), self._names()
            name = f"{int((bases or ['0'])[-1]) + 1:09d}"
            held, fold = self.spark.createDataFrame([(b,) for b in new], "batch string"), len(names) >= self.most
            if fold:
                held = held.unionByName(self.spark.read.schema("batch string").option("recursiveFileLookup", "true").parquet(*(f"{self.root}/held/{n}" for n in names)))
            held.withColumn("bucket", (F.crc32("batch") % self.buckets).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/held/{name}")
            self._sums(deltas).write.mode("overwrite").parquet(f"{self.root}/base/{name}")
            for old in [f"base/{n}" for n in bases[:-1]] + [f"held/{n}" for n in names if fold]:
                self.fs.delete(self._path(f"{self.root}/{old}"), True)
        for b in deltas:
            self.fs.delete(self._path(self._folder(b)), True)


def as_inserts(counts: DataFrame, tokens: str = "tokens", op: str = "insert") -> DataFrame:
    """Inserts, or with op="delete" deletes, of counted rows."""
    return counts.select(*KEYS, F.lit(op).alias("op"), F.col(tokens).cast("long").alias("tokens"), F.lit(None).cast("long").alias("old_tokens"))


def as_revisions(counts: DataFrame, old: str) -> DataFrame:
    return counts.select(*KEYS, F.lit("revise").alias("op"), "tokens", F.col(old).cast("long").alias("old_tokens"))
