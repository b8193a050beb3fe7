"""Dimension tables: replay of puts and deletes, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_dim(puts: DataFrame, key: str, columns: list[str], order: list[str], type_col: str = "type") -> DataFrame:
    """The current rows of a dimension: of each column the last value since the last deletion that is neither null nor
    empty, since a put leaves such cells as they are. A key that has been deleted and not put again is gone.

    puts: key, columns, type_col and the order columns, which must be a total order within a key."""
    at = F.struct(*order)
    gone = F.max(F.when(F.col(type_col) == "delete", at)).over(Window.partitionBy(key))
    live = puts.withColumn("_at", at).withColumn("_gone", gone).filter((F.col(type_col) != "delete") & (F.col("_gone").isNull() | (F.col("_at") > F.col("_gone"))))
    filled = {c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("_at")) for c in columns}
    return live.groupBy(key).agg(*(F.max_by(c, filled[c]).alias(c) for c in columns)) if columns else live.select(key).distinct()


def lookup(rows: DataFrame, dim: DataFrame, key: str, attributes: dict[str, str], dim_key: str = "id", default: dict[str, str] | None = None) -> DataFrame:
    """Left join of attributes {name in the dimension: name in the result}. A missing or null key gives null, or the
    default of the attribute. Whether the dimension is broadcast is for its statistics to decide."""
    side = dim.select(F.col(dim_key).alias("_k"), *(F.col(a).alias(b) for a, b in attributes.items()))
    out = rows.drop(*attributes.values()).join(side, F.col(key) == F.col("_k"), "left").drop("_k")
    return out.fillna(default) if default else out
