"""Plumbing shared by the corpus operators: scratch tables, Arrow batches, skew-proof key lookups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and U+0009 to U+000D, which is also what bytes.split() cuts at.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


_SAVED: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set, a temporary one in local mode; on a
    cluster executors would write elsewhere than is read, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewright-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it again: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _SAVED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession, since: int = 0, last: bool = True) -> None:
    """Delete the scratch tables of this process, once the results that read them have been written: those written since
    a mark (saved_so_far), with or without the last."""
    for path in _SAVED[since : None if last else -1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _SAVED.remove(path)


def saved_so_far() -> int:
    return len(_SAVED)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null text as empty: what an operator reads of a table, whatever else it holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def by_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 512, most_bytes: int = 8 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies work to slices of few rows and few bytes, so that memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(rows, int(most_bytes * batch.num_rows / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                out = work(batch.slice(at, step))
                if out.num_rows:
                    yield out

    return run


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name += "_"
    return name


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str, total: int, share: int = 4096) -> DataFrame:
    """Inner join of rows with table (one row a key; weight: how many rows have the key), safe against hot keys.

    Keys that hold more than 1/share of all rows number less than share, so they are broadcast: that bound is proven,
    whatever the corpus. All other keys hold few rows each and meet in an ordinary shuffle join.
    """
    least = total // share + 1
    hot, cold = table.filter(F.col(weight) >= least), table.filter(F.col(weight) < least)
    keys = [key] if isinstance(key, str) else key
    by_hot = rows.join(F.broadcast(hot), keys)
    by_cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return by_hot.unionByName(by_cold)


def crc32_text(col: str) -> Column:
    """crc32 of an identifier written as text: the fold rule of the label contracts."""
    return F.crc32(F.col(col).cast("string"))
