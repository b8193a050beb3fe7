"""Compare queries with their SQL: python tests/check_oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import sys
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns in order of name, in a total order, floats to twelve digits."""
    at = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        if isinstance(v, float):
            return f"{v:.12g}"
        return format(v.normalize(), "f") if isinstance(v, Decimal) else v

    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


def compare(spark, name: str, sf: str) -> str:
    """Empty where query and SQL agree, else what differs."""
    import duckdb

    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf)
    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(entry.oracle_sql()[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, want)
    if a == b:
        return ""
    first = next(((x, y) for x, y in zip(a, b, strict=False) if x != y), None)
    return f"{len(a)} rows and {len(b)}; first difference: {first}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for n in sys.argv[2:] or entry.oracle_sql():
        try:
            print(n, compare(session, n, sys.argv[1]) or "ok", flush=True)
        except Exception as e:
            print(n, "FAILED", str(e)[:600], flush=True)
