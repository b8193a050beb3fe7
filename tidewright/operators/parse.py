"""Parsing, filtering, projecting and splitting of change records and application logs. All of it is declarative, so the
same functions serve batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import schemas

CHANGE_TYPES = ("insert", "update", "delete", "bootstrap-insert")


def parse_json(df: DataFrame, schema: str, col: str = "value", strict: bool = False) -> DataFrame:
    """Columns of a JSON text. strict: a record that can't be read fails the job; otherwise its columns are null."""
    mode = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE"}
    return df.select(F.from_json(col, schema, mode).alias("_r")).select("_r.*")


def present(df: DataFrame, col: str = "value") -> DataFrame:
    """Without tombstones (null) and empty payloads."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != ""))


def changes(df: DataFrame, col: str = "value", strict: bool = False) -> DataFrame:
    return parse_json(present(df, col), schemas.CHANGE, col, strict)


def dim_etl(records: DataFrame, database: str = "edu") -> DataFrame:
    """Change records of the database, of a known type and with data."""
    return records.filter((F.col("database") == database) & F.col("type").isin(*CHANGE_TYPES) & F.col("data").isNotNull() & (F.size("data") > 0))


def dwd_etl(records: DataFrame) -> DataFrame:
    """Change records other than bootstrap ones; those without a type can't be read and go."""
    return records.filter(F.col("type").isNotNull() & ~F.col("type").startswith("bootstrap-"))


def decode_cdc(events: DataFrame, family: str | None = None) -> DataFrame:
    """The row of a change envelope: what was, for a deletion, else what is; with op, and the column family if given."""
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    out = events.select(row.alias("data"), "op", "ts_ms").filter(F.col("data").isNotNull())
    return out.withColumn("sink_family", F.lit(family)) if family else out


def prune(data: Column | str, columns: Column | str) -> Column:
    """The entries of a map whose keys are in a comma-separated list, taken as it is, without trimming."""
    wanted = F.split(columns, ",")
    return F.map_filter(data, lambda k, _: F.array_contains(wanted, k))


def with_entry(data: Column | str, key: str, value: Column) -> Column:
    """A map with one more entry; an entry of that key is replaced."""
    own = F.map_filter(data, lambda k, _: k != key)
    return F.map_concat(own, F.create_map(F.lit(key), value.cast("string")))


def split_dirty(raw: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records that are JSON objects, the others): dirty records are a table of their own instead of vanishing."""
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json(col)).startswith("OBJECT"), F.lit(False))
    return raw.filter(ok), raw.filter(~ok)


def logs(raw: DataFrame, col: str = "value", strict: bool = False) -> DataFrame:
    return parse_json(raw, schemas.LOG, col, strict)


def session_entries(pages: DataFrame) -> DataFrame:
    """Pages that begin a session."""
    return pages.filter(F.col("page.last_page_id").isNull())


def pages_in(pages: DataFrame, *page_ids: str) -> DataFrame:
    return pages.filter(F.col("page.page_id").isin(*(page_ids or ("home", "course_list", "course_detail"))))


def with_source(details: DataFrame) -> DataFrame:
    """Order details that know their source."""
    return details.filter(F.col("source_id").isNotNull() & (F.col("source_id") != ""))


def order_detail_rows(records: DataFrame) -> DataFrame:
    d = F.col("data")
    rows = records.filter((F.col("table") == "order_detail") & (F.col("type") == "insert"))
    return rows.select(
        d["id"].alias("id"), d["order_id"].alias("order_id"), d["user_id"].alias("user_id"), d["course_id"].alias("course_id"),
        F.date_format(d["create_time"], "yyyy-MM-dd").alias("date_id"), d["create_time"].alias("create_time"), d["origin_amount"].alias("origin_amount"),
        d["coupon_reduce"].alias("coupon_reduce_amount"), d["final_amount"].alias("final_amount"), "ts",
    )


def order_info_rows(records: DataFrame) -> DataFrame:
    d = F.col("data")
    rows = records.filter((F.col("table") == "order_info") & (F.col("type") == "insert"))
    return rows.select(*(d[k].alias(k) for k in ("id", "province_id", "out_trade_no", "session_id", "trade_body")), F.col("ts").alias("info_ts"))


def order_page_rows(pages: DataFrame) -> DataFrame:
    """Session and source of the visits to the order page."""
    return pages.filter(F.col("page.page_id") == "order").select(F.col("common.sid").alias("session_id"), F.col("common.sc").alias("source_id"), F.col("ts").alias("page_ts"))


def payment_success_rows(records: DataFrame) -> DataFrame:
    """Successful payments, updates included."""
    d = F.col("data")
    rows = records.filter((F.col("table") == "payment_info") & (d["payment_status"] == "1602"))
    names = ("alipay_trade_no", "trade_body", "order_id", "payment_type", "payment_status", "callback_time", "callback_content")
    return rows.select(*(d[k].alias(k) for k in names), "ts")


def search_rows(pages: DataFrame) -> DataFrame:
    return pages.filter((F.col("page.item_type") == "keyword") & F.col("page.item").isNotNull()).select(F.col("page.item").alias("fullword"), "ts")


def score_band(score: Column | str) -> Column:
    """The band of a score; below zero falls in the first, above a hundred in none."""
    s = F.col(score) if isinstance(score, str) else score
    out = F.when(s < 60, "[0,60)").when(s < 70, "[60,70)").when(s < 80, "[70,80)").when(s < 90, "[80,90)").when(s <= 100, "[90,100]")
    return out.otherwise("")


def as_json(df: DataFrame, *left_out: str) -> DataFrame:
    """One JSON text a row, of the snake_case columns."""
    return df.select(F.to_json(F.struct(*(c for c in df.columns if c not in left_out))).alias("value"))


def split_log(log: DataFrame) -> dict[str, DataFrame]:
    """The six outputs of an application log: err, start, appVideo and page records, and the displays and actions of
    pages one by one. A record may go to several; displays and actions count only where there is a page."""
    pages = log.filter(F.col("page").isNotNull())
    return {
        "err": log.filter(F.col("err").isNotNull()),
        "start": log.filter(F.col("start").isNotNull()).drop("err"),
        "appVideo": log.filter(F.col("appVideo").isNotNull()).drop("err"),
        "page": pages.drop("displays", "actions", "err"),
        "display": pages.select("common", "page", F.explode("displays").alias("display"), "ts"),
        "action": pages.select("common", "page", F.explode("actions").alias("actions"), "ts"),
    }


def parsed_logs(raw: DataFrame, col: str = "value") -> DataFrame:
    """(r, _text, _dirty): application logs parsed once, their texts, and which of those are no JSON objects."""
    # a text that isn't read whole is looked at again: it is dirty unless it is an object, of whatever types
    schema = f"{schemas.LOG}, _broken STRING"
    r = F.from_json(F.when(F.col(col).isNull(), "").otherwise(F.col(col)), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    parsed = raw.select(r.alias("r"), F.col(col).alias("_text"))
    odd = F.col("r").isNull() | F.col("r._broken").isNotNull() | (F.trim("_text") == "")
    dirty = odd & ~F.coalesce(F.schema_of_variant(F.try_parse_json("_text")).startswith("OBJECT"), F.lit(False))
    return parsed.withColumn("_dirty", F.coalesce(dirty, F.lit(True)))


def outputs(parsed: DataFrame, incomplete: Column | None = None) -> DataFrame:
    """A row for each output of each parsed log, by its name in `output` (dirty: value alone), with common, page, err, start,
    appVideo, display, action and ts as the output has them; whole arrays of displays and actions go with none. One explode
    gives all. incomplete: which clean records go to an output of that name alone, with their value."""
    short = F.lit(False) if incomplete is None else incomplete
    clean = ~F.col("_dirty") & ~short

    def one(name: str, **filled) -> Column:
        kinds = {"display": "MAP<STRING,STRING>", "action": "MAP<STRING,STRING>"}
        return F.struct(F.lit(name).alias("output"), *(filled.get(k, F.lit(None).cast(t)).alias(k) for k, t in {"err": "string", "start": "string", "appVideo": "string", **kinds}.items()))

    err, start, video = F.col("r.err"), F.col("r.start"), F.col("r.appVideo")
    paged = clean & F.col("r.page").isNotNull()
    rows = F.array(
        F.when(F.col("_dirty"), one("dirty")), F.when(clean & err.isNotNull(), one("err", err=err, start=start, appVideo=video)), F.when(clean & start.isNotNull(), one("start", start=start, appVideo=video)),
        F.when(clean & video.isNotNull(), one("appVideo", start=start, appVideo=video)), F.when(paged, one("page", start=start, appVideo=video)), F.when(~F.col("_dirty") & short, one("incomplete")),
    )
    many = lambda name, of: F.when(paged & F.col(of).isNotNull(), F.transform(of, lambda x: one(name, **{name: x}))).otherwise(F.array().cast(f"array<{one_type}>"))
    one_type = "struct<output:string,err:string,start:string,appVideo:string,display:map<string,string>,action:map<string,string>>"
    rows = F.concat(F.filter(rows, lambda x: x.isNotNull()), many("display", "r.displays"), many("action", "r.actions"))
    out = parsed.select("r", "_text", F.explode(rows).alias("o"))
    return out.select("o.output", F.col("r.common").alias("common"), F.col("r.page").alias("page"), "o.err", "o.start", "o.appVideo", "o.display", "o.action", F.col("r.ts").alias("ts"), F.when(F.col("o.output").isin("dirty", "incomplete"), F.col("_text")).alias("value"))


def log_outputs(raw: DataFrame, col: str = "value") -> DataFrame:
    """split_dirty and split_log in one pass over the texts: one scan, one parse and one explode give all outputs, to be
    counted or written by output."""
    return outputs(parsed_logs(raw, col))
