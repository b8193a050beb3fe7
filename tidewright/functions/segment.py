"""Segmentation by a dictionary, with a choice among overlapping words, in Arrow batches.

Latin and digit runs are words in lower case. In a CJK run all words of the dictionary are found in one pass; words that
overlap, one over the next, are a group, and of a group's selections without overlaps the best is taken:

    most characters covered, then fewest words, then longest span, then latest end, then largest product of lengths, then
    long words late (sum of place times length)

which is the smart mode of the usual segmenter for Chinese. What no chosen word covers comes out by character."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = re.compile(r"[A-Za-z0-9]+|[㐀-䶿一-鿿]+")
CJK = "[㐀-䶿一-鿿]+"


class Segmenter:
    def __init__(self, dictionary: Iterable[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for w in dictionary:
            if len(w) > 1:
                self.automaton.add_word(w, len(w))
        self.automaton.make_automaton() if len(self.automaton) else None

    def _groups(self, run: str) -> Iterator[list[tuple[int, int]]]:
        """(begin, end) of the words in a run, by groups that overlap, in order."""
        found = sorted((end + 1 - n, end + 1) for end, n in self.automaton.iter(run)) if len(self.automaton) else []
        group, upto = [], 0
        for b, e in found:
            if group and b >= upto:
                yield group
                group = []
            group.append((b, e))
            upto = max(upto, e) if len(group) > 1 else e
        if group:
            yield group

    @staticmethod
    def choose(group: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The best selection of a group. By ends: the best selection that ends at a word is that word after the best one
        that ends before it begins, as a word more changes all alike."""
        low = group[0][0]
        size = max(e for _, e in group) - low
        upto: list[tuple | None] = [None] * (size + 1)  # best (covered, -words, -begin, product, late) with an end so far, and its words
        last, best = 0, None
        for b, e in sorted(group, key=lambda w: (w[1], w[0])):
            for k in range(last + 1, e - low + 1):
                upto[k] = upto[k - 1]
            last = e - low
            n, before = e - b, upto[b - low]
            if before:
                (c, w, first, product, late), words = before
                own = (c + n, w - 1, first, product * n, late + (1 - w) * n), [*words, (b, e)]
            else:
                own = (n, -1, -b, n, n), [(b, e)]
            if upto[last] is None or own[0] > upto[last][0]:
                upto[last] = own
            rank = (own[0][0], own[0][1], e + own[0][2], e, *own[0][3:])
            if best is None or rank > best[0]:
                best = rank, own[1]
        return best[1]

    def words(self, text: str | None) -> list[str]:
        out: list[str] = []
        for m in _RUN.finditer(text or ""):
            run = m[0]
            if run.isascii():
                out.append(run.lower())
                continue
            at = 0
            for group in self._groups(run):
                for b, e in self.choose(group) if len(group) > 1 else group:
                    out += run[at:b]
                    out.append(run[b:e])
                    at = e
            out += run[at:]
        return out


@functools.lru_cache(maxsize=4)
def _built(words: frozenset[str]) -> Segmenter:
    return Segmenter(words)


def segments(spark: SparkSession, dictionary: Iterable[str], most: int = 1_000_000):
    """A function of a text column that gives its words as an array, for select or, registered, for SQL. The dictionary goes
    to the executors once; it holds `most` words at most, or that is an error."""
    words = frozenset(dictionary)
    if len(words) > most:
        raise ValueError(f"a dictionary of {len(words)} words; at most {most} are sent to the executors")
    sent: Broadcast = spark.sparkContext.broadcast(words)

    @F.pandas_udf("array<string>")
    def words_of(text: pd.Series) -> pd.Series:
        return text.map(_built(sent.value).words)

    return words_of


def register_segments(spark: SparkSession, dictionary: Iterable[str], name: str = "ik_analyze") -> None:
    """The table function for SQL: SELECT word FROM t, LATERAL ik_analyze(t.text)."""
    spark.udf.register(f"{name}_words", segments(spark, dictionary))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE(word STRING) RETURN SELECT w FROM explode({name}_words(text)) AS t(w)")


def fitted_dictionary(texts: DataFrame, col: str, longest: int = 4, least: int = 5, most: int = 50_000, cohesion: float = 3.0) -> DataFrame:
    """(word, n): words of 2 to `longest` characters that occur `least` times in the CJK runs of a corpus, at least `cohesion`
    times as often as their two halves, put together by chance at any place, would. Counts cover all texts; of more than
    `most` words the most frequent are kept, so that a dictionary can be sent around."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(f"({CJK})"), F.lit(1))).alias("run"))
    place = F.expr(f"flatten(transform(sequence(1, length(run)), i -> transform(sequence(1, least({longest}, length(run) - i + 1)), n -> substr(run, i, n))))")
    counts = runs.select(F.explode(place).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = runs.agg(F.sum(F.length("run"))).first()[0] or 0
    words = counts.filter(f"length(word) > 1 AND n >= {least}")
    parts = words.withColumn("cut", F.explode(F.expr("sequence(1, length(word) - 1)"))).select("word", "n", F.expr("substr(word, 1, cut)").alias("a"), F.expr("substr(word, cut + 1)").alias("b"))
    parts = parts.join(counts.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    kept = parts.groupBy("word", "n").agg(F.min(F.expr(f"n * {total}D / (double(na) * nb)")).alias("tie")).filter(F.col("tie") >= cohesion)
    return kept.select("word", "n").orderBy(F.desc("n"), "word").limit(most)


def keyword_counts(texts: DataFrame, col: str, words_of, keys: list[Column | str] = ()) -> DataFrame:
    return texts.select(*keys, F.explode(words_of(col)).alias("keyword")).groupBy(*keys, "keyword").agg(F.count("*").alias("keyword_count"))
