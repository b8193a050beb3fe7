"""The session that the jobs expect."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

from ..functions.timefn import DEFAULT_ZONE

#: Stateful operators need the RocksDB provider; adaptive execution re-plans joins and skew at run time.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "tidewright", zone: str = DEFAULT_ZONE, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=CONF | {"spark.sql.session.timeZone": zone} | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir), for tables that a query writes on its way. In local mode
    a temporary one where none is set; on a cluster that is an error, as executors would write elsewhere than is read."""
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
