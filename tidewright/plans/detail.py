"""The dimension job and the six detail jobs, as plans over DataFrames."""

from __future__ import annotations

import uuid
from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import date_text, from_millis
from ..operators import joins, parse, routing, stateful
from ..sources.sinks import DimStore


def dim_changes(raw: DataFrame, config: DataFrame) -> DataFrame:
    """Change records -> puts and deletes of dimension tables."""
    return routing.route_dim(parse.dim_etl(parse.changes(raw)), config)


def dim_puts(raw: DataFrame, config: DataFrame) -> DataFrame:
    """Change records -> puts and deletes of all dimension tables at once, as sources.keyed.KeyedTables takes them."""
    routed = dim_changes(raw, config)
    return routed.select(F.col("sink_table").alias("table"), "generation", F.element_at("data", F.coalesce("sink_pk", F.lit("id"))).alias("key"), "type", "ts", "data")


def by_table(records: DataFrame, path: str) -> DataFrame:
    """Change records, read and parsed once, written by table and read again: whoever takes one table's records opens its
    folder alone. Maps say the same names in each row, so they are compressed well."""
    records.select("table", "type", "ts", "data").write.option("compression", "zstd").partitionBy("table").parquet(path)
    return records.sparkSession.read.schema("type STRING, ts BIGINT, data MAP<STRING,STRING>, table STRING").parquet(path)


def dim_job(raw: DataFrame, config_events: DataFrame, store: DimStore, batch: int | None = None, since: int | None = None) -> None:
    """A batch of change records into the dimension store: the configuration is replayed and complete before data. since:
    configuration events up to that ts_ms have made their tables in an earlier batch.

    Records are read, parsed and routed once, into a folder by sink; each table then takes its own part of it. Of the
    configuration's history the driver gets two events a table at most: the last that drops, and the first that makes it
    after that; those between change nothing."""
    name, makes = F.col("data")["sink_table"], F.col("op").isin("r", "c")
    events = config_events.select(name.alias("t"), "op", "ts_ms", "data", makes.alias("makes")).filter("t IS NOT NULL")
    events = events.filter(F.col("ts_ms") > since) if since is not None else events
    cut = events.filter("NOT makes").groupBy("t").agg(F.max("ts_ms").alias("_cut"))
    live = events.join(cut, "t", "left").filter("_cut IS NULL OR ts_ms >= _cut")
    acting = live.groupBy("t", "makes").agg(F.min_by(F.struct("op", "data"), F.struct("ts_ms", F.col("op") != "d")).alias("e"), F.min("ts_ms").alias("ts_ms"))
    for row in acting.orderBy("ts_ms", "makes").collect():
        d = row["e"]["data"]
        store.apply_config(row["e"]["op"], row["t"], d["sink_columns"].split(","), d.get("sink_pk") or "id")
    config = routing.current_config(config_events, ["source_table"])
    config = config.select(*(F.col("data")[c].alias(c) for c in ("source_table", "sink_table", "sink_columns", "sink_pk")))
    path = f"{store.root}/_routed-{uuid.uuid4().hex}"
    dim_changes(raw, config).write.partitionBy("sink_table").parquet(path)
    spark = raw.sparkSession
    routed = spark.read.option("basePath", path).schema("sink_pk STRING, type STRING, ts BIGINT, data MAP<STRING,STRING>, sink_table STRING").parquet(path)
    for row in config.collect():
        columns, key = row["sink_columns"].split(","), row["sink_pk"] or "id"
        own = routed.filter(F.col("sink_table") == row["sink_table"]).select(*(F.col("data")[c].alias(c) for c in dict.fromkeys([key, *columns])), "type", "ts", F.xxhash64(F.to_json("data")).alias("tie"))
        store.put(row["sink_table"], own, key, ["ts", "tie"], batch)
    store.fs.delete(store._path(path), True)


def base_db(raw: DataFrame, config: DataFrame) -> DataFrame:
    """Change records -> detail sinks by configuration (sink_table, ts, data)."""
    return routing.route_dwd(parse.dwd_etl(parse.changes(raw)), config)


def base_log(raw: DataFrame, state: ModuleType = stateful, literal: bool = False) -> dict[str, DataFrame]:
    """Application logs -> dirty records and the six detail outputs, with the new-visitor flag repaired."""
    clean, dirty = parse.split_dirty(raw)
    log = parse.logs(clean)
    whole = log.filter(F.col("common").isNotNull() & F.col("ts").isNotNull())
    et = from_millis("ts")
    flat = whole.withColumn("_mid", F.col("common.mid")).withColumn("_new", F.col("common.is_new")).withColumn("_day", date_text(et)).withColumn("_tie", F.xxhash64(F.to_json("page"), "err"))
    fixed = state.repair_new_visitor(flat, "_mid", "_new", "_day", ["ts", "_tie"], literal)
    fixed = fixed.withColumn("common", F.col("common").withField("is_new", F.col("_new"))).drop("_mid", "_new", "_day", "_tie")
    return {"dirty": dirty, "incomplete": log.filter(F.col("common").isNull() | F.col("ts").isNull())} | parse.split_log(fixed)


def log_job(raw: DataFrame, state: ModuleType = stateful, literal: bool = False) -> DataFrame:
    """base_log as one table: a row for each output of each record, by its name in `output` (dirty, incomplete, err, start,
    appVideo, page, display, action). One scan, one parse, the flag's repair and one explode, in batch and in streams.

    Records that know no visitor (no mid, no common, no ts, no JSON) keep their flag; they are dealt out by their texts, so
    that no key gathers them."""
    parsed = parse.parsed_logs(raw)
    short = F.col("r.common").isNull() | F.col("r.ts").isNull()
    known = ~F.col("_dirty") & ~short & F.col("r.common.mid").isNotNull()
    who = F.when(known, F.concat(F.lit("m"), "r.common.mid")).otherwise(F.concat(F.lit("t"), F.pmod(F.xxhash64("_text"), F.lit(4096))))
    rows = parsed.select("r", "_text", "_dirty", known.alias("_known"), who.alias("_who"), F.col("r.common.is_new").alias("_new"), date_text(from_millis("r.ts")).alias("_day"), F.col("r.ts").alias("ts"), F.xxhash64(F.to_json("r.page"), "r.err").alias("_tie"))
    fixed = state.repair_new_visitor(rows, "_who", "_new", "_day", ["ts", "_tie"], literal)
    r = F.when(F.col("_known"), F.col("r").withField("common.is_new", F.col("_new"))).otherwise(F.col("r"))
    return parse.outputs(fixed.select(r.alias("r"), "_text", "_dirty"), F.coalesce(short, F.lit(True)))


def order_detail(records: DataFrame, pages: DataFrame, streaming: bool = False) -> DataFrame:
    """Change records and page logs -> order details with their source."""
    return joins.order_details(parse.order_detail_rows(records), parse.order_info_rows(records), parse.order_page_rows(pages), streaming)


def order_detail_changes(records: DataFrame, pages: DataFrame) -> DataFrame:
    """The same in a stream, as changes: early rows, and what takes them back."""
    return joins.order_detail_changes(parse.order_detail_rows(records), parse.order_info_rows(records), parse.order_page_rows(pages))


def pay_success(records: DataFrame, details: DataFrame, streaming: bool = False) -> DataFrame:
    return joins.paid_details(parse.payment_success_rows(records), details, streaming)


def _visits(pages: DataFrame) -> DataFrame:
    et = from_millis("ts")
    return pages.withColumn("et", et).withColumn("day", date_text(et)).withColumn("mid", F.col("common.mid")).withColumn("tie", F.xxhash64(F.to_json("page")))


def unique_visitors(pages: DataFrame, state: ModuleType = stateful, literal: bool = False) -> DataFrame:
    """The first session entry of each visitor and day."""
    return state.first_of_day(_visits(parse.session_entries(pages)), ["mid"], "day", ["et", "tie"], literal, ttl_ms=86_400_000)


def user_jumps(pages: DataFrame, state: ModuleType = stateful, literal: bool = False, within: int = 10_000) -> DataFrame:
    """Session entries that lead nowhere. literal: every page counts as an entry."""
    entry = F.lit(True) if literal else F.col("page.last_page_id").isNull()
    return state.bounces(_visits(pages), "mid", entry, "ts", ["ts", "tie"], within)
