"""Many tables of rows by key under one root: a batch of puts and deletes of all of them is one write.

Rows lie by table, generation and bucket (a hash of the key), in changes by batch and in bases that compaction writes. A
read lists the folders of its table alone, and a lookup those of its keys' buckets; compaction rewrites only buckets that
have changed since the last one. Generations are lives of a table: what is put to one that has ended is read by nobody."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dims

PLACE = ["table", "generation", "bucket"]
CELLS = "key STRING, type STRING, ts BIGINT, tie BIGINT, data MAP<STRING,STRING>"
_PLACED = "table STRING, generation BIGINT, bucket INT"


class KeyedTables:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str, prefix: str = "") -> list[str]:
        p = self._path(folder)
        return [n for f in (self.fs.listStatus(p) if self.fs.exists(p) else []) if (n := f.getPath().getName()).startswith(prefix)]

    def _done(self, kind: str) -> list[int]:
        """Numbers of the changes or bases that have been written whole."""
        return sorted(int(n.partition("=")[2]) for n in self._names(f"{self.root}/{kind}", "batch=") if self.fs.exists(self._path(f"{self.root}/{kind}/{n}/_SUCCESS")))

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def put(self, rows: DataFrame, batch: int) -> None:
        """rows: table, generation, key, type (delete, or anything else), ts, data. A batch that runs again replaces what it
        wrote. Rows without a key can't be found again and are left out; of equal ts the data decide."""
        out = rows.filter("key IS NOT NULL").select("table", F.col("generation").cast("long").alias("generation"), self._bucket(F.col("key")).alias("bucket"), "key", "type", "ts", "data")
        # few files a bucket, and none too large: adaptive execution splits and joins the parts of a rebalance; ties are hashes,
        # which don't compress, so they are made behind it
        out = out.hint("rebalance", *PLACE).select(*PLACE, "key", "type", "ts", F.xxhash64(F.to_json("data")).alias("tie"), "data")
        out.write.option("compression", "zstd").mode("overwrite").partitionBy(*PLACE).parquet(f"{self.root}/changes/batch={batch}")

    def _folders(self, kind: str, batches: list[int], table: str, generation: int, buckets: set[int] | None) -> dict[int, list[str]]:
        """Folders by bucket, in order of their batches."""
        found: dict[int, list[str]] = {}
        for n in batches:
            at = f"{self.root}/{kind}/batch={n}/table={table}/generation={generation}"
            for name in self._names(at, "bucket="):
                b = int(name[7:])
                if buckets is None or b in buckets:
                    found.setdefault(b, []).append(f"{at}/{name}")
        return found

    def _load(self, kind: str, folders: list[str]) -> DataFrame:
        schema = f"{CELLS}, batch BIGINT, {_PLACED}"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*folders)

    def rows(self, table: str, generation: int, buckets: set[int] | None = None) -> DataFrame:
        """Everything that may count of a table: the newest base of each bucket, and all later changes."""
        bases = self._done("base")
        base = self._folders("base", bases, table, generation, buckets)
        later = self._folders("changes", [n for n in self._done("changes") if n > max(bases, default=-1)], table, generation, buckets)
        both = self._load("base", [f[-1] for f in base.values()]).unionByName(self._load("changes", [f for fs in later.values() for f in fs]))
        return both.filter("key IS NOT NULL")

    def read(self, table: str, generation: int, columns: list[str], key: str = "id", keys: DataFrame | None = None) -> DataFrame:
        """A table as it stands: of each column the last value since the last deletion that is neither null nor empty. keys:
        a column of keys wanted; the folders of other buckets aren't opened. A table without rows is an empty one."""
        wanted = None
        if keys is not None:
            wanted = {r[0] for r in keys.select(self._bucket(F.col(keys.columns[0]).cast("string")).alias("b")).distinct().collect()}  # as many as buckets
        rest = [c for c in dict.fromkeys(columns) if c != key]
        cells = self.rows(table, generation, wanted).select("key", "type", "batch", "ts", "tie", *(F.col("data")[c].alias(c) for c in rest))
        if keys is not None:
            cells = cells.join(keys.select(F.col(keys.columns[0]).cast("string").alias("key")).distinct(), "key", "left_semi")
        return dims.merge_dim(cells, "key", rest, ["batch", "ts", "tie"]).withColumnRenamed("key", key)

    def compact(self) -> None:
        """Fold all changes so far into new bases of the buckets that have any, of all tables in one write. A compaction that
        fails leaves everything as it was. The generation of folders before the last one is dropped afterwards."""
        changes, bases = self._done("changes"), self._done("base")
        upto, last = max(changes, default=-1), max(bases, default=-1)
        if upto <= last:
            return
        new, old = [], []
        for n in (b for b in changes if b > last):
            at = f"{self.root}/changes/batch={n}"
            new += [(t, g) for t in self._names(at, "table=") for g in self._names(f"{at}/{t}", "generation=")]
        later: list[str] = []
        for t, g in dict.fromkeys(new):
            parts = self._folders("changes", [b for b in changes if b > last], t[6:], int(g[11:]), None)
            held = self._folders("base", bases, t[6:], int(g[11:]), set(parts))
            later += [f for fs in parts.values() for f in fs]
            old += [fs[-1] for fs in held.values()]
        both = self._load("base", old).unionByName(self._load("changes", later))
        at = F.struct("batch", "ts", "tie")
        by = [*PLACE, "key"]
        gone = both.filter("type = 'delete'").groupBy(*by).agg(F.max(at).alias("_gone"))
        live = both.filter("key IS NOT NULL AND (type <> 'delete' OR type IS NULL)").withColumn("_at", at).join(gone, by, "left").filter("_gone IS NULL OR _at > _gone")
        cells = live.select(*by, "_at", F.explode_outer("data").alias("name", "value"))
        cells = cells.groupBy(*by, "name").agg(F.max_by("value", F.when(F.col("value") != "", F.col("_at"))).alias("value"))
        data = F.map_from_entries(F.filter(F.collect_list(F.struct("name", "value")), lambda x: x["name"].isNotNull()))
        out = cells.groupBy(*by).agg(data.alias("data")).select(*PLACE, "key", F.lit("insert").alias("type"), F.lit(0).cast("long").alias("ts"), F.lit(0).cast("long").alias("tie"), "data")
        # a bucket whose keys are all gone has a base too, with a row that marks it
        none = [F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in CELLS.split(", "))]
        out = out.unionByName(self._load("changes", later).select(*PLACE).distinct().select(*PLACE, *none))
        out.hint("rebalance", *PLACE).write.option("compression", "zstd").mode("overwrite").partitionBy(*PLACE).parquet(f"{self.root}/base/batch={upto}")
        for n in changes:
            if n <= last:
                self.fs.delete(self._path(f"{self.root}/changes/batch={n}"), True)
        for n in bases[:-1]:
            for t in self._names(f"{self.root}/base/batch={n}", "table="):
                for g in self._names(f"{self.root}/base/batch={n}/{t}", "generation="):
                    for fs in self._folders("base", bases, t[6:], int(g[11:]), None).values():
                        for f in fs[:-1]:
                            if f"/base/batch={n}/" in f:
                                self.fs.delete(self._path(f), True)

    def drop(self, table: str, generation: int) -> None:
        """Delete the folders of a generation that has ended."""
        for kind in ("changes", "base"):
            for n in self._done(kind):
                self.fs.delete(self._path(f"{self.root}/{kind}/batch={n}/table={table}/generation={generation}"), True)
