"""Removal of passages that stand more than once in a corpus, by suffix automata of reference shards.

Holding every document against the automaton of every shard would cost the square of the corpus. Instead, each window of
`size` words is filed under its minimizer, the least hash of the word n-grams in it: equal windows have the same one.
Consecutive windows with the same minimizer form a segment, and a shard is the set of distinct segments of a minimizer,
with their counts. Only documents with a segment in a shard are streamed against its suffix automaton; the matching
statistics give, for every window, how often its word sequence occurs. Spans of repeated windows are removed.

Segments of a minimizer that occurs once in all are unique and end there. A segment that is alone in its shard needs no
automaton: each of its windows occurs as often as it does. Shards beyond a bound are refined to single windows, so that
no task holds more than that bound, whatever a passage is met beside.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slices, fresh, lookup, saved, texts

GRAM = 8


class SuffixAutomaton:
    """Of several word sequences, each with a weight: how often it stands in the corpus.

    Most states have one transition, which stands in two arrays; only those with more have a table. A million words take
    some fifty megabytes."""

    def __init__(self) -> None:
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length, self.count = array("i", [-1]), array("i", [0]), array("q", [0])
        self.ids: dict = {}

    def _get(self, state: int, c: int) -> int:
        """The target of a transition, -1 if there is none."""
        if state in self.more:
            return self.more[state].get(c, -1)
        return self.to[state] if self.word[state] == c else -1

    def _set(self, state: int, c: int, target: int) -> None:
        if state in self.more:
            self.more[state][c] = target
        elif self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, target
        else:
            self.more[state] = {self.word[state]: self.to[state], c: target}

    def _state(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the shorter sequences that reach it by c from p."""
        new = self._state(self.length[p] + 1, self.link[q])
        self.word[new], self.to[new] = self.word[q], self.to[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        while p >= 0 and self._get(p, c) == q:
            self._set(p, c, new)
            p = self.link[p]
        self.link[q] = new
        return new

    def add(self, words: list, weight: int = 1) -> None:
        link, length, ids = self.link, self.length, self.ids
        last = 0
        for w in words:
            c = ids.setdefault(w, len(ids))
            q = self._get(last, c)
            if q >= 0:  # known from another sequence
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
            else:
                new, p = self._state(length[last] + 1, 0), last
                while p >= 0 and (q := self._get(p, c)) < 0:
                    self._set(p, c, new)
                    p = link[p]
                if p >= 0:
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
                last = new
            self.count[last] += weight

    def finish(self) -> SuffixAutomaton:
        """Carry the counts of prefixes over to their suffixes."""
        for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[:0:-1].tolist():
            self.count[self.link[s]] += self.count[s]
        return self

    def occurrences(self, words: list, size: int) -> Iterator[tuple[int, int]]:
        """(start, occurrences) of every window of `size` words that the automaton knows, from matching statistics."""
        link, length, get = self.link, self.length, self._get
        state = matched = 0
        for at, w in enumerate(words):
            c = self.ids.get(w, -2)
            target = get(state, c)
            while state and target < 0:
                state = link[state]
                matched = length[state]
                target = get(state, c)
            if target >= 0:
                state, matched = target, matched + 1
            while state and length[link[state]] >= size:
                state = link[state]
            if matched >= size:
                matched = size
                yield at - size + 1, self.count[state]


def minimizers(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer of each window, hash of each n-gram) of one document."""
    gram = min(GRAM, size)
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(0x9E3779B97F4A7C15)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    g = np.zeros(len(words) - gram + 1, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x94D049BB133111EB) + h[j : len(g) + j]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    least, width, wide = g, 1, size - gram + 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return (np.minimum(least[: len(least) - (wide - width)], least[wide - width :]) if wide > width else least), g


def segments(words: list[bytes], size: int) -> list[tuple[int, int, int, int, int]]:
    """(minimizer, content hash, start, windows, occurrences of the minimizer) of each segment of one document."""
    if len(words) < size:
        return []
    keys, g = minimizers(words, size)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    windows = np.diff(np.r_[starts, len(keys)])
    grams = windows + (len(g) - len(keys))
    ends = np.cumsum(grams)
    place = np.arange(ends[-1]) - np.repeat(ends - grams - starts, grams)
    times = np.add.reduceat(g[place] == np.repeat(keys[starts], grams), ends - grams, dtype=np.int64)
    buffer = memoryview(b" ".join(words))
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.r_[0, stop[:-1] + 1][starts].tolist()
    last = stop[starts + windows + size - 2].tolist()
    content = [xxhash.xxh3_64_intdigest(buffer[a:b]) for a, b in zip(first, last, strict=True)]
    return list(zip(keys[starts].view(np.int64).tolist(), np.array(content, np.uint64).view(np.int64).tolist(), starts.tolist(), windows.tolist(), times.tolist(), strict=True))


RUNS = "key long, seg long, sha binary, start int, n int, times int"


def checked(text: Column) -> tuple[Column]:
    """What a text is known by: the first half of its SHA-256. Rows of one doc_id, or of none, are so told apart, and equal
    texts are one. checks: the same."""
    return (F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16),)


def checks(body: bytes) -> tuple[bytes]:
    return (hashlib.sha256(body).digest()[:16],)


def _runs(size: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for body in batch.column(1).cast(pa.binary()).to_pylist():
            (sha,) = checks(body)
            rows += [(k, s, sha, a, n, t) for k, s, a, n, t in segments(body.split(), size)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RUNS.split(", ")])

    return work


def _ranges(offsets: list[int]) -> list[dict]:
    out: list[dict] = []
    for o in offsets:
        if out and out[-1]["b"] == o - 1:
            out[-1]["b"] = o
        else:
            out.append({"a": o, "b": o})
    return out


RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
FOUND = "key long, seg long, ranges array<struct<a:int,b:int>>"


def shard_matches(size: int):
    """Rows (key, seg, n, body) in order of key -> the repeated windows of each segment. A shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            automaton = SuffixAutomaton()
            for _, _, n, body in shard:
                automaton.add(body.split(b" "), n)
            automaton.finish()
            for key, seg, _, body in shard:
                out.append((key, seg, _ranges([at for at, n in automaton.occurrences(body.split(b" "), size) if n > 1])))

        def flush() -> pa.RecordBatch:
            k, s, r = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(r, RANGES)], names=["key", "seg", "ranges"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "copies", "body")), strict=True):
                if shard and shard[0][0] != row[0]:
                    close()
                    shard = []
                    if len(out) >= 4000:
                        yield flush()
                shard.append(row)
        if shard:
            close()
        if out:
            yield flush()

    return run


def frequent_texts(known: DataFrame) -> DataFrame:
    """(sha) of the texts that more than one row in 4096 has: fewer than 4096, whatever the corpus."""
    counts = saved(known.groupBy("sha").agg(F.count("*").alias("rows")).filter("rows > 1"), "texts-repeated")
    return counts.filter(F.col("rows") > known.count() // 4096 + 1).select("sha")


def repeated_spans(docs: DataFrame, hot: DataFrame, size: int = 35, shard_words: int = 1_000_000) -> DataFrame:
    """(sha, spans): of each text that has any, the repeated windows as ranges of word positions, ends included.
    docs: (doc_id, text, sha); hot: its frequent texts."""
    runs = saved(docs.select("doc_id", "text").mapInArrow(by_slices(_runs(size), rows=128, most_bytes=2 << 20), RUNS), "segments")
    often = saved(runs.groupBy("key").agg(F.sum("times").alias("t"), F.count("*").alias("rows")).filter("t > 1").select("key", "rows"), "minimizers-met")
    kept = saved(lookup(runs, often, "key", "rows", runs.count()).drop("rows"), "segments-met")
    # one row per distinct segment, with one place where its words stand
    own = saved(kept.groupBy("key", "seg").agg(F.count("*").alias("copies"), F.max("n").alias("n"), F.max("times").alias("times"), F.min(F.struct("sha", "start")).alias("at")), "segments-distinct")
    sizes = own.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.col("n") + (size - 1)).alias("words"))
    own = saved(lookup(own, sizes, "key", "members", own.count()), "segments-own")
    alone = own.filter("members = 1 AND (copies > 1 OR times = 1)")
    alone = alone.filter("copies > 1").select("key", "seg", F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))).alias("ranges"))
    wanted = own.filter("NOT (members = 1 AND (copies > 1 OR times = 1))")
    places = wanted.groupBy("at.sha").agg(F.collect_list(F.struct("key", "seg", "copies", F.col("at.start").alias("start"), "n", (F.col("words") > shard_words).alias("large"))).alias("places"))
    light = docs.select("sha", "text")
    each = light.join(F.broadcast(hot), "sha", "left_anti").unionByName(light.join(F.broadcast(hot), "sha", "left_semi").dropDuplicates(["sha"]))
    met = each.join(places, "sha").dropDuplicates(["sha"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for body, wants in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = body.split()
            for p in wants:
                for k in range(p["n"]) if p["large"] else (None,):
                    text = b" ".join(words[p["start"] : p["start"] + p["n"] + size - 1] if k is None else words[p["start"] + k : p["start"] + k + size])
                    rows.append((p["key"], p["seg"], p["copies"], k, xxhash.xxh3_128_digest(text) if p["large"] else None, None if p["large"] else text))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "seg", "copies", "window", "hash", "body"])

    bodies = saved(met.select("text", "places").mapInArrow(by_slices(cut, rows=64), "key long, seg long, copies long, window int, hash binary, body binary"), "segments-text")
    shards = bodies.filter("window IS NULL").select("key", "seg", "copies", "body")
    matched = shards.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(shard_matches(size), FOUND)
    single = bodies.filter("window IS NOT NULL")
    # a window that many segments hold is counted in the tasks, and looked up, not met in one
    counts = single.groupBy("hash").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).filter("n > 1").select("hash", "rows")
    twice = lookup(single.select("key", "seg", "window", "hash"), saved(counts, "windows-met"), "hash", "rows", single.count())
    refined = twice.groupBy("key", "seg").agg(F.transform(F.array_sort(F.collect_list("window")), lambda w: F.struct(w.alias("a"), w.alias("b"))).alias("ranges"))
    ranges = alone.unionByName(matched.filter(F.size("ranges") > 0)).unionByName(refined)
    table = saved(ranges.join(own.select("key", "seg", "copies"), ["key", "seg"]), "segments-found")
    spans = lookup(kept.select("key", "seg", "sha", "start"), table, ["key", "seg"], "copies", kept.count())
    shifted = F.transform("ranges", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + (size - 1)).alias("b")))
    # a set: rows of equal texts say the same
    return saved(spans.groupBy("sha").agg(F.flatten(F.collect_set(shifted)).alias("spans")), "spans")


def with_spans(rows: DataFrame, spans: DataFrame, hot: DataFrame) -> DataFrame:
    """Left join of spans to rows by sha; those of the few frequent texts are broadcast, so that no task gets all their rows."""
    few = F.broadcast(hot)
    common = rows.join(few, "sha", "left_semi").join(F.broadcast(spans.join(few, "sha", "left_semi")), "sha", "left")
    return common.unionByName(rows.join(few, "sha", "left_anti").join(spans, "sha", "left"))


def remove_repeats(docs: DataFrame, size: int = 35, shard_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space), spans (the word
    positions removed, ends included).

    A word goes when a window of `size` consecutive words covers it whose word sequence also starts anywhere else, in the
    same or another row. Windows are judged on the input. Null, empty and wordless texts have no words, and nothing is
    removed from texts of fewer than `size`. Rows that repeat count as elsewhere to each other. A null doc_id stays
    null. An empty table gives an empty result. Other columns are not read.
    """
    known = texts(docs, id_col, text_col).withColumn("sha", checked(F.col("text"))[0])
    hot = frequent_texts(known)
    both = with_spans(known, repeated_spans(known, hot, size, shard_words), hot).select("doc_id", "text", "spans")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(4)]
        for body, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = body.split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in found or ():
                gone[s["a"]] += 1
                gone[s["b"] + 1] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            at = np.flatnonzero(gone).tolist()
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if at else words
            for c, x in zip(cols, (len(words), len(at), b" ".join(kept), _ranges(at)), strict=True):
                c.append(x)
        arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], RANGES)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return both.mapInArrow(by_slices(work, rows=128), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<a:int,b:int>>")


def digests(kept: DataFrame) -> DataFrame:
    """What remove_repeats gives, with the kept text as its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(bodies: list[str | None], size: int = 35) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) of each text by comparing all windows: for tests."""
    words = [(b or "").encode().split() for b in bodies]
    count: dict[tuple, int] = {}
    for ws in words:
        for k in range(len(ws) - size + 1):
            count[t] = count.get(t := tuple(ws[k : k + size]), 0) + 1
    out = []
    for ws in words:
        gone = set()
        for k in range(len(ws) - size + 1):
            if count[tuple(ws[k : k + size])] > 1:
                gone.update(range(k, k + size))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def without_repeats(docs: DataFrame, size: int = 35, shard_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs, with all their columns: a text that has repeated windows is replaced by the words that stay,
    joined by one space, and its length column follows; all others are left as they are."""
    row = fresh("_row", docs)
    known = texts(docs, id_col, text_col).withColumn("sha", checked(F.col("text"))[0])
    hot = frequent_texts(known)
    spans = repeated_spans(known, hot, size, shard_words)
    whole = docs.select(checked(F.coalesce(docs[text_col], F.lit("")))[0].alias("sha"), F.struct(*(docs[c] for c in docs.columns)).alias(row))
    both = with_spans(whole, spans, hot).select(f"{row}.*", F.col("spans").alias(fresh("_spans", docs)))
    names, at = docs.columns, docs.columns.index(text_col)

    def cut(text: str, found: list[dict]) -> str:
        words = text.encode().split()
        gone = np.zeros(len(words) + 1, np.int64)
        for s in found:
            gone[s["a"]] += 1
            gone[s["b"] + 1] -= 1
        return b" ".join(w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g).decode()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [cut(t, f) if f else t for t, f in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names=names)

    kept = both.mapInArrow(by_slices(work, rows=128), docs.schema)
    if length_col not in docs.columns:
        return kept
    return kept.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
