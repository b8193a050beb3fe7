"""Source divergence audit: how the term shares of the sources of a language differ, on k²-trees of the count matrix.

The matrix has a row for each source of a language and a column for each term kept; a cell that is no zero holds a smoothed
share, all zero cells of a row the same one. It is cut into tiles, by ranges of rows and by hashed terms, frequent ones
first, so that few columns are full and most are empty in most rows. A task builds the k²-trees of a tile's two ranges of
rows and descends both jointly, for all pairs of their sources at once: quadrants that are zero in both are left out, and
come in analytically, as a number of columns times the difference of the two zero shares; cells that one of both has are
priced each. Sums over tiles and over zero columns add up to the exact divergence of every pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: A-Z in lower case; whatever else below U+0080 is no letter parts terms.
_LETTERS = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def terms_of(text: str, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of the terms of a text, in stretches of about `most` bytes."""
    raw, at = text.encode().translate(_LETTERS), 0
    while at < len(raw):
        to = raw.find(b" ", at + most)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def term_counts(docs: DataFrame, text_col: str = "text", most: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and the group's documents with it; a row with null
    term for each group. Tasks sum up at most about `most` terms before they hand them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                words = list(n)
                for k in range(0, len(words) + 1, 50_000):
                    part = words[k : k + 50_000]
                    last = [None] * (k + 50_000 > len(words))
                    size = len(part) + len(last)
                    cols = [pa.array([lang] * size), pa.array([source] * size), pa.array(part + last, pa.binary()).cast(pa.string())]
                    cols += [pa.array([*map(c.__getitem__, part), *([0] * len(last))], pa.int64()) for c in (n, docs)]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            counts.clear()

        held = 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(c) for c in range(3)), strict=True):
                n, docs = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                held -= len(n)
                seen: set[bytes] = set()
                for words in terms_of(text.as_py()):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                held += len(n)
                if held > most:
                    yield from out()
                    held = 0
        yield from out()

    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((text_col, "text"), ("lang", "lang"), ("source", "source"))))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class K2Tree:
    """Cells (row, col) -> value of a square of k^height rows and columns; for each level the bits of the children of all
    nodes, in order, so that the rank of a set bit is the number of the node below."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, height: int, k: int = 2):
        self.height, self.k = height, k
        code = np.zeros(len(rows), np.int64)
        for level in range(height):
            size = k ** (height - 1 - level)
            code = code * k * k + rows // size % k * k + cols // size % k
        order = np.argsort(code)
        code, self.values = code[order], np.append(values[order], 0)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        above = np.zeros(1, np.int64)
        for level in range(height):
            below = np.unique(code // (k * k) ** (height - 1 - level))
            bits = np.zeros(max(1, len(above)) * k * k, bool)
            bits[np.searchsorted(above, below // (k * k)) * k * k + below % (k * k)] = True
            self.levels.append((bits, np.cumsum(bits) - 1))
            above = below

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Numbers of the children in a quadrant, -1 where it is all zero."""
        bits, rank = self.levels[level]
        at = np.maximum(node, 0) * self.k * self.k + quadrant
        return np.where((node >= 0) & bits[at], rank[at], -1)


def joint_sums(a: K2Tree, b: K2Tree, zero_a: np.ndarray, zero_b: np.ndarray, same: bool, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a and each of b: the sum of |value - value| over columns where one of both has a cell, and the
    number of those columns. same: only rows of a below those of b in number. Holds some multiples of `most` quadrants."""
    k, height, ra, rb = a.k, a.height, len(zero_a), len(zero_b)
    sums, seen = np.zeros(ra * rb, np.int64), np.zeros(ra * rb, np.int64)
    ia, ib, j = (x.ravel() for x in np.meshgrid(*[np.arange(k)] * 3, indexing="ij"))
    start = np.zeros(1, np.int64)
    todo = [(0, start, start, start, start)]
    while todo:
        level, na, nb, row_a, row_b = todo.pop()
        if len(na) > most:
            half = len(na) // 2
            todo += [(level, *(x[:half] for x in (na, nb, row_a, row_b))), (level, *(x[half:] for x in (na, nb, row_a, row_b)))]
            continue
        if level == height:
            off = np.abs(np.where(na >= 0, a.values[na], zero_a[row_a]) - np.where(nb >= 0, b.values[nb], zero_b[row_b]))
            pair = row_a * rb + row_b
            sums += np.bincount(pair, off, ra * rb).astype(np.int64)  # below 2^53: whole numbers stay exact
            seen += np.bincount(pair, minlength=ra * rb)
            continue
        size = k ** (height - 1 - level)
        x, y = (row_a[:, None] + ia * size).ravel(), (row_b[:, None] + ib * size).ravel()
        ca = a.child(level, np.repeat(na, k**3), np.tile(ia * k + j, len(na)))
        cb = b.child(level, np.repeat(nb, k**3), np.tile(ib * k + j, len(nb)))
        go = ((ca >= 0) | (cb >= 0)) & (x < ra) & (y < rb)
        if same:
            go &= x < y if size == 1 else x <= y
        if go.any():
            todo.append((level + 1, ca[go], cb[go], x[go], y[go]))
    return sums.reshape(ra, rb), seen.reshape(ra, rb)


def _share(n: str, of: str) -> str:
    """1 + floor(10^9 (n + 5) / of), exact for any long."""
    return f"1 + (cast({n} + 5 as decimal(20,0)) * 1000000000BD) div cast({of} as decimal(20,0))"


def _tile(key: tuple, cells: pd.DataFrame, rows: int) -> pd.DataFrame:
    lang, _, a, b = key
    trees, zeros = [], []
    height = max(1, int(max(cells["col"].max(), rows - 1)).bit_length())
    for block in dict.fromkeys((a, b)):
        own = cells[cells["row"] // rows == block]
        heads = own[own["col"] < 0].sort_values("row")
        own = own[own["col"] >= 0]
        trees.append(K2Tree(own["row"].to_numpy() - block * rows, own["col"].to_numpy(), own["p"].to_numpy(), height))
        zeros.append(heads["p"].to_numpy())
    sums, seen = joint_sums(trees[0], trees[-1], zeros[0], zeros[-1], a == b)
    g, h = np.nonzero(seen)
    return pd.DataFrame({"lang": lang, "g": g + a * rows, "h": h + b * rows, "sum": sums[g, h], "seen": seen[g, h]})


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, rows: int = 64, width: int = 1024, text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has every other source of the language by divergence, part `term`
    the terms that a source has more of than its language, the first `top`.

    Null text, lang and source are ''. Terms are runs of letters and of characters from U+0080 on, A-Z in lower case; a
    language keeps those of at least least_docs of its documents. A group's share of a kept term is
    1 + floor(10^9 (count + 5) / (N + 5 V)), of N occurrences of V kept terms, the language's likewise; a pair's value is the
    sum of the differences over all kept terms, 0 where a language keeps none. Groups without terms take part. Repeated rows
    count each; ties rank by item in UTF-8 order; a language with one source has no pairs; an empty table gives no rows.
    Other columns are not read. A tile is at most 2 `rows` sources by about `width` terms, whatever the corpus; pairs are
    as many as the result asks for."""
    counts = saved(term_counts(docs, text_col), "term-counts")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("total")).filter(F.col("df") >= least_docs)
    kept = saved(kept, "terms-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    terms = kept.join(langs, "lang").withColumn("blocks", F.ceil(F.col("v") / width)).withColumn("block", F.expr("pmod(xxhash64(term), blocks)"))
    # by both: a plan that has met by language would number all of a language's terms in one task
    terms = terms.repartition("lang", "block").withColumn("col", F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.desc("df"), "term")) - 1)
    cells = saved(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "cells")
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = counts.filter("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["own_n", "v", "lang_n"]).withColumn("den", F.expr("own_n + 5 * v"))
    per_lang = Window.partitionBy("lang")
    groups = groups.withColumn("row", F.row_number().over(per_lang.orderBy("source")) - 1).withColumn("last", F.max("row").over(per_lang))
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, F.expr(_share("0L", "den"))).otherwise(F.lit(0)))
    groups = saved(groups.withColumn("strip", F.expr(f"row div {rows}")).withColumn("strips", F.expr(f"last div {rows} + 1")), "groups")

    shares = cells.join(groups.select("lang", "source", "row", "strip", "strips", "den"), ["lang", "source"]).withColumn("p", F.expr(_share("n", "den")))
    heads = groups.filter("v > 0").withColumn("block", F.explode(F.expr(f"sequence(0L, cast(ceil(v / {width}) as long) - 1)"))).withColumn("col", F.lit(-1)).withColumn("p", F.col("p0"))
    wanted = ["lang", "block", "strip", "strips", "row", "col", "p"]
    placed = shares.select(*wanted).unionByName(heads.select(*wanted)).withColumn("other", F.explode(F.expr("sequence(0L, strips - 1)")))
    placed = placed.select("lang", "block", F.least("strip", "other").alias("a"), F.greatest("strip", "other").alias("b"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "p")
    tiles = placed.groupBy("lang", "block", "a", "b").applyInPandas(lambda key, cells: _tile(key, cells, rows), "lang string, g long, h long, sum long, seen long")
    sums = tiles.groupBy("lang", "g", "h").agg(F.sum("sum").alias("sum"), F.sum("seen").alias("seen"))

    each = groups.withColumn("other", F.explode(F.expr("sequence(0L, strips - 1)")))
    left = each.select("lang", F.col("strip").alias("sa"), F.col("other").alias("sb"), "source", F.col("row").alias("i"), F.col("p0").alias("p"), "v")
    right = each.select("lang", F.col("other").alias("sa"), F.col("strip").alias("sb"), F.col("source").alias("item"), F.col("row").alias("j"), F.col("p0").alias("q"))
    pairs = left.join(right, ["lang", "sa", "sb"]).filter("i <> j").withColumn("g", F.least("i", "j").cast("long")).withColumn("h", F.greatest("i", "j").cast("long"))
    pairs = pairs.join(sums, ["lang", "g", "h"], "left").fillna(0, ["sum", "seen"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr("sum + (v - seen) * abs(p - q)").alias("value"))
    more = shares.withColumn("value", F.expr(f"p - ({_share('total', 'lang_n + 5 * v')})")).filter("value > 0")
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
