"""Keyword segmentation: Latin and digit runs in lower case; CJK by longest match in a dictionary, else by character."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_WORDS = "([a-z0-9]+|[㐀-䶿一-鿿])"
_RUN = re.compile(r"[A-Za-z0-9]+|[㐀-䶿一-鿿]+")


def keywords(text: str | None, dictionary: frozenset[str] = frozenset()) -> Iterator[str]:
    longest = max(map(len, dictionary), default=1)
    for m in _RUN.finditer(text or ""):
        run = m[0]
        if run.isascii():
            yield run.lower()
            continue
        at = 0
        while at < len(run):
            size = next((n for n in range(min(longest, len(run) - at), 1, -1) if run[at : at + n] in dictionary), 1)
            yield run[at : at + size]
            at += size


def register_keywords(spark: SparkSession, name: str = "ik_analyze", dictionary: frozenset[str] = frozenset()) -> None:
    """The table function for SQL: SELECT word FROM t, LATERAL ik_analyze(t.text). Without a dictionary it is a SQL function,
    which the optimizer turns into an explode inside code generation; with one it is Python."""
    if not dictionary:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE(word STRING) RETURN SELECT w FROM explode(regexp_extract_all(lower(text), '{_WORDS}', 1)) AS t(w)")
        return

    class Keywords:
        def eval(self, text: str):
            for word in keywords(text, dictionary):
                yield (word,)

    spark.udtf.register(name, F.udtf(Keywords, returnType="word string"))


def keyword_array(text: Column | str) -> Column:
    """The same for text without a dictionary, inside code generation: explode it instead of calling the table function."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORDS), F.lit(1))
