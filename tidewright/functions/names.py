"""snake_case and camelCase column names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def snake(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def to_snake(df: DataFrame) -> DataFrame:
    return df.toDF(*map(snake, df.columns))


def to_camel(df: DataFrame) -> DataFrame:
    return df.toDF(*map(camel, df.columns))
